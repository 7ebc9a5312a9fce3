"""Column functions: derived keys, vocabularies, scores, texts, layout and HTML."""
