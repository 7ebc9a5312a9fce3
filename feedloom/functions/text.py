"""Text functions on columns. All treat null as the empty string's place: null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, since Java's \s is ASCII only.
WS = r"[ \t\n\x0B\f\r\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: The same class in RE2's writing, for the SQL that results are held against.
WS_RE2 = r"[ \t\n\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used; as a variable of a lambda it can't be copied into each place."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{WS}+|{WS}+$", "")


def trimmed(s: Column) -> Column:
    """trim() for long texts, which aren't searched unless an end of theirs is white space."""
    return let(s, lambda x: F.when(F.left(x, F.lit(1)).rlike(WS) | F.right(x, F.lit(1)).rlike(WS), trim(x)).otherwise(x))


#: Characters of a text that are searched first for what is usually at its beginning; where they don't decide, the whole text is searched.
HEAD = 1000


def at_head(s: Column, of_head, of_whole, enough: int) -> Column:
    """The first items of an array made of a text: of_head() gives those of its first characters that are the same whatever follows; if they
    are fewer than enough, of_whole() of the text is taken."""
    return let(s, lambda x: let(of_head(F.left(x, F.lit(HEAD))), lambda h: F.when(F.size(h) >= enough, h).otherwise(of_whole(x))))


def without_last(parts: Column) -> Column:
    return let(parts, lambda p: F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))))


def squeezed(s: Column) -> Column:
    """Fields joined by one space each."""
    return trim(F.regexp_replace(s, f"{WS}+", " "))


def byte_cut(s: Column, n: int) -> Column:
    """The longest prefix of whole characters within n bytes."""
    cut = F.make_valid_utf8(F.substring(F.encode(s, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(s) <= n, s).otherwise(F.regexp_replace(cut, r"\uFFFD+$", ""))


def _last_space(s: Column) -> Column:
    """Characters before the last space; -1 if there is none."""
    back = F.locate(" ", F.reverse(s))
    return F.when(back == 0, -1).otherwise(F.char_length(s) - back)


def trim_to_words(s: Column, most: Column | int) -> Column:
    """At most so many characters, cut at the last space if that is within the last 50, and "..." after a cut."""
    most = F.lit(most) if isinstance(most, int) else most

    def short(cut: Column) -> Column:
        at = _last_space(cut)
        kept = trim(F.when((at >= 0) & (F.char_length(cut) - at <= 50), F.left(cut, at)).otherwise(cut))
        return let(kept, lambda k: F.when(k == "", cut).otherwise(F.concat(k, F.lit("..."))))

    return let(trim(s), lambda t: F.when((most <= 0) | (F.char_length(t) <= most), t).otherwise(let(F.left(t, most), short)))


def limit_bytes(s: Column, most: int) -> Column:
    """At most so many bytes, cut at the last space if that is beyond byte 400, and "..." after a cut."""

    def short(cut: Column) -> Column:
        at = _last_space(cut)
        kept = F.when((at >= 0) & (F.octet_length(F.left(cut, at)) > 400), F.left(cut, at)).otherwise(cut)
        return F.concat(trim(kept), F.lit("..."))

    return F.when(F.octet_length(s) <= most, s).otherwise(let(byte_cut(s, most), short))


def condense(s: Column, most: int) -> Column:
    """The first sentences of 15 characters or more; if there is none, the first pieces between full stops."""
    if most <= 0:
        return trim(s)

    def sentences(t: Column) -> Column:
        # Without the tail after the last end of a sentence, over which the pattern would be tried anew from each of its characters.
        ended = F.regexp_extract(t, "(?s)^.*[.!?]", 0)
        return F.filter(F.transform(F.regexp_extract_all(ended, F.lit("[^.!?]*[.!?]"), 0), lambda x: trim(x)), lambda x: F.char_length(x) >= 15)

    def of(t: Column) -> Column:
        whole = at_head(t, sentences, sentences, most)
        pieces = F.transform(F.filter(F.transform(F.split(t, r"\."), lambda x: trim(x)), lambda x: x != ""), lambda x: F.concat(x, F.lit(".")))
        return F.when(t == "", t).otherwise(let(whole, lambda w: trim(F.array_join(F.slice(F.when(F.size(w) > 0, w).otherwise(pieces), 1, most), " "))))

    return let(trimmed(s), of)


def fallback_summary(s: Column) -> Column:
    """The first two pieces between full stops that have 25 bytes or more; if there is none, the first 160 bytes."""

    def long(parts: Column) -> Column:
        return F.filter(F.transform(parts, lambda x: trim(x)), lambda x: F.octet_length(x) >= 25)

    def of(t: Column) -> Column:
        pieces = F.slice(at_head(t, lambda h: long(without_last(F.split(h, r"\."))), lambda x: long(F.split(x, r"\.")), 2), 1, 2)
        rest = F.when(F.octet_length(t) > 160, F.concat(byte_cut(t, 160), F.lit("..."))).otherwise(t)
        return let(pieces, lambda p: F.when(F.size(p) == 0, rest).otherwise(F.concat(F.array_join(p, ". "), F.lit("."))))

    return let(trimmed(s), of)


_SP = r"[ \t\n\f\r]"
_MARKS = "disclaimer|note"
_MACHINE = "this translation is " + "a machine translation"
_CLOSE = r"[)\]]"
#: Notes in brackets, as sentences, and as phrases.
DISCLAIMERS = (
    rf"(?i){_SP}*[(\[]{_SP}*(?:{_MARKS}|ai language model|{_MACHINE})" + r"[^)\]]*" + rf"{_CLOSE}{_SP}*",
    rf"(?i)(?:^|[.!?]{_SP}+)(?:{_MARKS}){_SP}*:{_SP}*[^.!?]*[.!?]",
    rf"(?i)(?:^|{_SP})(?:ai language model|double[- ]?check|for accurate translations|{_MACHINE})" + r"[^.!?\n]*[.!?]",
)
_DISCLAIMER_LINE = rf"(?i)^{_SP}*[(\[]?{_SP}*(?:note|disclaimer)(?:[^0-9A-Za-z_]|$)"


def without_disclaimers(s: Column) -> Column:
    """The text without notes on machine translation; in brackets, as sentences, or as phrases."""
    out = s
    for p in DISCLAIMERS:
        out = F.regexp_replace(out, p, " ")
    return F.when(trim(s) == "", s).otherwise(F.regexp_replace(trim(out), rf"{_SP}{{2,}}", " "))


def sanitized(s: Column) -> Column:
    """A model's answer without disclaimers, empty lines, surrounding quotes and runs of white space."""
    t = without_disclaimers(F.regexp_replace(trim(s), "\r\n|\r", "\n"))
    lines = F.transform(F.split(t, "\n"), lambda x: without_disclaimers(trim(x)))
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike(_DISCLAIMER_LINE))
    out = F.regexp_replace(F.array_join(lines, "\n"), "^[`\"]+|[`\"]+$", "")
    return trim(F.regexp_replace(out, rf"{_SP}{{2,}}", " "))


#: Boilerplate of one publisher, dropped before translation.
BOILERPLATE = (
    "På Ekstra Bladet lægger vi stor vægt " + "på at have en tæt dialog med jer læsere. " + "Jeres input er guld",
    "værd, og mange historier ville ikke " + "kunne lade sig gøre uden jeres tip. " + "Men selv om vi også har",
    "tradition for at turde, når andre " + "tier, værner vi om en sober " + "og konstruktiv tone.",
    "Ekstra Bladet og evt. politianmeldt.",
)


def cleaned_for_translation(s: Column) -> Column:
    """Lines of more than 5 bytes, joined by spaces, without boilerplate."""
    out = s
    for phrase in BOILERPLATE:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), trim), lambda x: F.octet_length(x) > 5), " ")


def cut_for_provider(s: Column, most: int) -> Column:
    return F.when(F.octet_length(s) > most, F.concat(byte_cut(s, most), F.lit("..."))).otherwise(s)


def prompt_ready(s: Column, most: int = 6000, least: int = 1200) -> Column:
    """One line of at most `most` characters, ended at a sentence if that leaves more than `least` bytes, and marked where cut."""

    def short(cut: Column) -> Column:
        back = F.locate(" .", F.reverse(cut))
        upto = F.char_length(cut) - back - 1  # characters before the last ". "
        return F.concat(F.when((back > 0) & (F.octet_length(F.left(cut, upto)) > least), F.left(cut, upto + 1)).otherwise(cut), F.lit("\n[TRUNCATED]"))

    return let(squeezed(F.replace(s, F.lit("\r"), F.lit(""))), lambda t: F.when(F.char_length(t) > most, let(F.left(t, F.lit(most)), short)).otherwise(t))


def without_tags(s: Column) -> Column:
    return F.regexp_replace(s, "<[^>]+>", "")


IRRELEVANT = tuple("dr nyheder har|følg med på|læs også|se også".split("|"))


def snippet(s: Column, original: bool = False) -> Column:
    """Up to three sentences of 15 bytes or more from an HTML snippet, within 500 bytes; irrelevant ones are left out of an original."""
    from .entities import unescaped

    t = F.regexp_replace(unescaped(without_tags(s)), "[\\p{Z}\x85]", " ")
    pieces = F.filter(F.transform(F.split(squeezed(t), r"\."), trim), lambda x: F.octet_length(x) >= 15)
    if original:
        pieces = F.filter(pieces, lambda x: ~F.lower(x).rlike("|".join(IRRELEVANT)))
    joined = F.array_join(F.slice(pieces, 1, 3), ". ")
    return let(let(joined, lambda x: F.when((x != "") & ~x.endswith("."), F.concat(x, F.lit("."))).otherwise(x)), lambda x: cut_for_provider(x, 500))


def looks_ukrainian(s: Column) -> Column:
    return F.regexp_count(s, F.lit("[іїєґЙйЖжШшЩщЮюЯяІЄҐ]")) > 3


def looks_danish(s: Column) -> Column:
    return F.regexp_count(s, F.lit("[æøåÆØÅ]")) > 2


def language_name(code: Column) -> Column:
    return F.when(F.lower(code) == "uk", "Ukrainian").when(F.lower(code) == "da", "Danish").otherwise(code)


SECTIONS = {"summary": "СУТЬ", "danish": "DANSK|ДАНСЬКА", "ukrainian": "UKRAINIAN|УКРАЇНСЬКА МОВА|УКРАЇНСЬКА|УКРАИНСКИЙ"}
LEGACY = {"summary": "СУТЬ:", "danish": "ДАТСКИЙ:", "ukrainian": "УКРАИНСКИЙ:"}


def parsed_response(s: Column) -> Column:
    """summary, danish and ukrainian of a labelled answer, with `complete`.

    A label starts a section and further lines go on with it. Fields still missing are taken from older labels, then from blocks of about
    1200 bytes in order. Danish and Ukrainian that are plainly the other way round are swapped.
    """
    names = list(SECTIONS)

    def add(old: Column, new: Column) -> Column:
        return F.when(new == "", old).when(old == "", new).otherwise(F.concat(old, F.lit(" "), new))

    def labelled(line: Column) -> Column:
        """The section that a line starts, or null, and the line's text."""
        section, rest = F.lit(None).cast("string"), line
        for n in reversed(names):
            label = rf"(?iu)^(?:{SECTIONS[n]})[ \t\n\f\r]*: ?"
            hit = line.rlike(label)
            section = F.when(hit, F.lit(n)).otherwise(section)
            rest = F.when(hit, trim(F.regexp_replace(line, label, ""))).otherwise(rest)
        return F.struct(section.alias("starts"), rest.alias("rest"))

    def step(acc: Column, line: Column) -> Column:
        def of(x: Column) -> Column:
            section = F.coalesce(x["starts"], acc["at"])
            return F.struct(section.alias("at"), *[F.when(section == n, add(acc[n], x["rest"])).otherwise(acc[n]).alias(n) for n in names])

        return let(labelled(line), of)

    def old(lines: Column, label: str) -> Column:
        begun = F.filter(lines, lambda x: x.startswith(label))
        return F.get(F.filter(F.transform(begun, lambda x: trim(F.substr(x, F.lit(len(label) + 1)))), lambda x: x != ""), F.lit(0))

    def block(acc: Column, line: Column) -> Column:
        text = F.concat(acc["text"], line, F.lit(" "))
        return let(text, lambda t: F.struct(F.when(F.octet_length(t) > 1200, F.array_append(acc["done"], trim(t))).otherwise(acc["done"]).alias("done"), F.when(F.octet_length(t) > 1200, F.lit("")).otherwise(t).alias("text")))

    def blocks(lines: Column) -> Column:
        folded = F.aggregate(lines, F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text")), block)
        return let(folded, lambda x: F.when(x["text"] != "", F.array_append(x["done"], trim(x["text"]))).otherwise(x["done"]))

    def filled(x: Column, parts: Column) -> Column:
        missing, out = F.lit(0), []
        for n in names:
            out.append(F.when(x[n] == "", F.coalesce(F.get(parts, missing), F.lit(""))).otherwise(x[n]).alias(n))
            missing = missing + (x[n] == "").cast("int")
        return F.struct(*out)

    def swapped(x: Column) -> Column:
        swap = looks_ukrainian(x["danish"]) & looks_danish(x["ukrainian"])
        whole = (x["summary"] != "") & (x["danish"] != "") & (x["ukrainian"] != "")
        da, uk = F.when(swap, x["ukrainian"]).otherwise(x["danish"]), F.when(swap, x["danish"]).otherwise(x["ukrainian"])
        return F.struct(x["summary"].alias("summary"), da.alias("danish"), uk.alias("ukrainian"), whole.alias("complete"))

    def of(lines: Column) -> Column:
        start = F.struct(F.lit("").alias("at"), *[F.lit("").alias(n) for n in names])
        got = F.aggregate(lines, start, step)
        aged = let(got, lambda x: F.struct(*[F.when(x[n] == "", F.coalesce(old(lines, LEGACY[n]), F.lit(""))).otherwise(trim(x[n])).alias(n) for n in names]))
        return let(let(aged, lambda x: filled(x, blocks(lines))), swapped)

    return let(F.filter(F.transform(F.split(s, "\n"), lambda x: trim(x)), lambda x: x != ""), of)


PROVIDER_PATHS = {"gemini": "$.candidates[0].content.parts[0].text", "groq": "$.choices[0].message.content", "mistral": "$.choices[0].message.content", "cohere": "$.generations[0].text"}


def provider_text(provider: str, body: Column) -> Column:
    """The answer in a provider's JSON; null where it isn't there."""
    if provider == "google":
        rows = F.from_json(F.get_json_object(body, "$[0]"), "array<array<string>>")
        return let(rows, lambda r: F.when(r.isNotNull(), F.array_join(F.transform(r, lambda x: F.coalesce(F.get(x, F.lit(0)), F.lit(""))), "")))
    return F.get_json_object(body, PROVIDER_PATHS[provider])


def translated(s: Column, to: Column, answers: list[Column]) -> Column:
    """The first provider's answer that is neither null, empty nor the input itself, sanitized; else the cleaned text. An empty text, or a
    target but Danish and Ukrainian, leaves the text as it is."""
    known = F.lower(trim(to)).isin("uk", "ukrainian", "da", "danish")
    clean = cleaned_for_translation(s)
    sent = cut_for_provider(clean, 4000)
    out = clean
    for a in reversed(answers):
        out = F.when(a.isNotNull() & (a != "") & (a != sent), sanitized(a)).otherwise(out)
    return F.when((s == "") | ~known, s).otherwise(out)


def summarized(s: Column, answers: list[Column]) -> Column:
    """The first provider's answer that isn't blank, sanitized; empty for a blank text, null where all fail."""
    out = F.lit(None).cast("string")
    for a in reversed(answers):
        out = F.when(a.isNotNull() & (trim(a) != ""), sanitized(a)).otherwise(out)
    return F.when(trim(s) == "", F.lit("")).otherwise(out)
