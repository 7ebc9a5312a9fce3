"""Parameters of a run: defaults, overridden by settings that are whole numbers within their ranges. No credentials are read."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    limit: int = 8
    max_age_hours: int = 24
    per_source: int = 2
    per_category: int = 2
    max_model_requests: int = 3
    scrape_max_articles: int = 10
    ttl_hours: int = 48
    mode: str = "multiple"
    posting_policy: str = "hybrid"
    caption_max: int = 900
    caption_min_per_language: int = 120
    caption_sentences: int = 2
    text_sentences_min: int = 2
    text_sentences_max: int = 4
    min_summary_total: int = 180

    def __post_init__(self):
        if self.mode not in ("single", "multiple"):
            raise ValueError(f"mode {self.mode!r} is neither single nor multiple")


#: Least and most values that a setting may have; others are passed over.
RANGES = {"caption_min_per_language": (60, None), "caption_sentences": (1, 2), "per_source": (0, None), "per_category": (0, None)}


def options(settings: Mapping[str, str]) -> Options:
    """Options from settings by name in any case, such as environment variables."""
    given = {k.lower(): v for k, v in settings.items() if v != ""}
    out = Options()
    for f in fields(Options):
        if f.name not in given:
            continue
        value: object = given[f.name]
        if f.type == "int":
            try:
                value = int(given[f.name])
            except ValueError:
                continue
            low, high = RANGES.get(f.name, (1, None))
            if value < low or (high is not None and value > high) or (f.name == "text_sentences_max" and value < out.text_sentences_min):
                continue
        out = replace(out, **{f.name: value})
    return out
