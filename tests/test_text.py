import re
import time

import pytest
from pyspark.sql import functions as F

from feedloom.functions import keys, text, vocab


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r.v for r in df.select("i", column(F.col("s")).alias("v")).orderBy("i").collect()]


def test_sanitized_drops_disclaimers(spark):
    rows = [
        "🇺🇦 Новина\n(Note: This translation is a machine translation and may err. Always double-check it.) В Марракеші тривають демонстрації.",
        "Note: This translation is a machine translation and may err.\nВ Марракеші та Марокко.",
        "[Note: Machine translation] Це тестовий рядок.",
        '"`Quoted`"',
        "  \r\n ",
        None,
        "Notes are kept. A notebook too.",
    ]
    got = values(spark, text.sanitized, rows)
    assert "note" not in got[0].lower() and "В Марракеші" in got[0]
    assert "note:" not in got[1].lower() and "Марокко" in got[1]
    assert "note" not in got[2].lower() and "Це тестовий рядок" in got[2]
    assert got[3:] == ["Quoted", "", None, "Notes are kept. A notebook too."]


def test_condense_and_fallback(spark):
    assert values(spark, lambda s: text.condense(s, 2), ["Fourteen chrs. Fifteen chars!! Another sentence here? And one more of them.", "no end at all", "A. B. C.", " ", "One long enough sentence. tail"]) == [
        "Another sentence here? And one more of them.",
        "no end at all.",
        "A. B.",
        "",
        "One long enough sentence.",
    ]
    got = values(spark, text.fallback_summary, ["Short. " + "x" * 24 + ". " + "å" * 13 + ". " + "y" * 30 + ". " + "z" * 40, "tiny. bits", "q" * 170, ""])
    assert got == ["å" * 13 + ". " + "y" * 30 + ".", "tiny. bits", "q" * 170 + ".", ""]
    assert values(spark, text.fallback_summary, [("ab. " * 60)]) == [("ab. " * 60).strip()[:160] + "..."]


def test_cuts_keep_characters_whole(spark):
    assert values(spark, lambda s: text.byte_cut(s, 5), ["ååå", "abc", "日本語", None]) == ["åå", "abc", "日", None]
    assert values(spark, lambda s: text.trim_to_words(s, 10), ["one two three", "abcdefghijklmnop", "short", "  pad  "]) == ["one two...", "abcdefghij...", "short", "pad"]
    long = "word " * 120
    got = values(spark, lambda s: text.limit_bytes(s, 450), [long, "short"])
    assert got[1] == "short" and got[0].endswith("word...") and len(got[0]) <= 453


def test_cascades(spark):
    row = spark.createDataFrame([("A text to send", "", "A text to send", "x (Note: y) z")], "s string, a string, b string, c string")
    c = F.col
    got = row.select(
        text.translated(c("s"), F.lit("da"), [F.lit(None).cast("string"), c("a"), c("b"), c("c")]).alias("first"),
        text.translated(c("s"), F.lit("fr"), [c("c")]).alias("other"),
        text.translated(c("s"), F.lit("uk"), [F.lit(None).cast("string")]).alias("none"),
        text.summarized(c("s"), [c("a"), c("c")]).alias("summary"),
        text.summarized(F.lit(" "), [c("c")]).alias("blank"),
        text.summarized(c("s"), [c("a")]).alias("failed"),
        text.provider_text("gemini", F.lit('{"candidates":[{"content":{"parts":[{"text":"g"}]}}]}')).alias("gemini"),
        text.provider_text("google", F.lit('[[["Hej ","Hi",null],["du","you"],[null]],null,"en"]')).alias("google"),
        text.provider_text("cohere", F.lit("not json")).alias("bad"),
    ).first()
    assert got.asDict() == {"first": "x z", "other": "A text to send", "none": "A text to send", "summary": "x z", "blank": "", "failed": None, "gemini": "g", "google": "Hej du", "bad": None}


def plain_parse(s):
    """The answer's fields by a plain loop."""
    import re

    labels = [("summary", "СУТЬ"), ("danish", "DANSK|ДАНСЬКА"), ("ukrainian", "UKRAINIAN|УКРАЇНСЬКА МОВА|УКРАЇНСЬКА|УКРАИНСКИЙ")]
    got, at = {"summary": [], "danish": [], "ukrainian": []}, None
    lines = [x.strip() for x in s.split("\n") if x.strip()]
    for line in lines:
        for name, label in labels:
            m = re.match(rf"(?i)(?:{label})\s*: ?", line)
            if m:
                at, line = name, line[m.end() :].strip()
                break
        if at and line:
            got[at].append(line)
    return {k: " ".join(v) for k, v in got.items()}


@pytest.mark.parametrize("s", ["Суть: a\nb\nDANSK: c æ\n\nУкраїнська: d\ne", "суть: a\nДАНСЬКА: b\nUKRAINIAN: c", "noise first\nСУТЬ:\nx\nDansk : y\nУКРАЇНСЬКА МОВА: z"])
def test_response_matches_plain_loop(spark, s):
    got = values(spark, text.parsed_response, [s])[0].asDict()
    assert got.pop("complete") and got == plain_parse(s)


def test_response_fallbacks_and_swap(spark):
    swap = "Суть: s\nDANSK: їжак єсть їсть щось\nУкраїнська: blåbærgrød på øen"
    legacy = "СУТЬ: s\nДАТСКИЙ: d\nУКРАИНСКИЙ: u"
    got = values(spark, text.parsed_response, [swap, "nothing", legacy, None, ""])
    assert got[0].danish.startswith("blå") and got[0].ukrainian.startswith("їжак")
    assert got[1].summary == "nothing" and not got[1].complete
    assert (got[2].danish, got[2].ukrainian, got[2].complete) == ("d", "u", True)
    assert got[4].summary == "" and not got[4].complete
    blocks = "\n".join(["x" * 700] * 6)
    got = values(spark, text.parsed_response, [blocks])[0]
    assert got.complete and len(got.summary) == len(got.danish) == len(got.ukrainian) == 1401


def test_normal_urls(spark):
    rows = ["HTTPS://WWW.A.dk//x//y/?b=2&utm_source=z&a=1#f", "a.dk/x", "", "http://a.dk/Path/", "http://u:p@A.dk/%7Ex?q=a+b&q=%C3%A5&gclid=1", "http://a.dk/%zz", "https://www.www.a.dk", "http://a.dk?k", "http://a.dk/x?a=1;b=2&c=3", None]
    assert values(spark, keys.normalize_url, rows) == ["https://a.dk/x/y?a=1&b=2", "https://a.dk/x", "", "http://a.dk/Path", "http://a.dk/~x?q=a+b&q=%C3%A5", "http://a.dk/%zz", "https://www.a.dk", "http://a.dk?k=", "http://a.dk/x?c=3", None]


def test_domains_and_hashes(spark):
    import hashlib

    assert values(spark, keys.domain, ["", "http://https://www.A.dk/x", "WWW.a.dk/x", "https://a.dk:80?q", "a"]) == ["unknown", "a.dk", "www.a.dk", "a.dk:80?q", "a"]
    got = values(spark, lambda s: keys.sent_hash(s, F.lit("https://example.com/test")), ["  Test   News\tArticle "])
    assert got == [hashlib.sha256(b"test news article|example.com").hexdigest()[:16]]


def test_similarity_key(spark):
    rows = [("På vej til det store", "", "https://X.dk/a", "2024-01-01 05:59:59"), ("På vej til det store", "", "https://X.dk/a", "2024-01-01 06:00:00"), ("a i på", "", "", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "t string, d string, l string, p string").withColumn("p", F.col("p").cast("timestamp"))
    k = [r.k for r in df.select(keys.similarity_key(F.col("t"), F.col("d"), F.col("l"), F.col("p"), F.lit(""), F.lit("2024-01-01").cast("timestamp")).alias("k")).collect()]
    assert k == ["x.dk|vej_det_store|1704067200", "x.dk|vej_det_store|1704088800", "unknown|a_i_på|1704067200"]
    raw = spark.range(1).select(F.unix_seconds(keys.rfc1123(F.lit("Mon, 01 Jan 2024 02:00:00 +0200"))).alias("a"), F.unix_seconds(keys.rfc1123(F.lit("Mon, 01 Jan 2024 00:00:00 GMT"))).alias("b"), keys.rfc1123(F.lit("soon")).alias("c")).first()
    assert (raw.a, raw.b, raw.c) == (1704067200, 1704067200, None)


def test_word_boundaries(spark):
    test = lambda terms: lambda s: vocab.contains_any(F.lower(s), terms)
    assert values(spark, test(("far",)), ["farø", "farlig", "min far.", "FAR"]) == [True, False, True, True]
    assert values(spark, test(("ai",)), ["he said", "ai!", "x_ai"]) == [False, True, False]
    assert values(spark, test(("eu",)), ["eu-lande", "neu"]) == [True, False]
    assert values(spark, test(("gap year",)), ["my gap years", "gap  year"]) == [True, False]


def test_snippets_and_prompts(spark):
    assert values(spark, lambda s: text.snippet(s, True), ["<p>Læs også denne her</p>. A sentence that stays &amp; counts. tiny. Another one that is fine", ""]) == ["A sentence that stays & counts. Another one that is fine.", ""]
    long = ("Sentence number one of many here. " * 300).strip()
    got = values(spark, text.prompt_ready, [long, "a\r\n b\tc"])
    assert got[0].endswith(".\n[TRUNCATED]") and len(got[0]) < 6020 and got[1] == "a b c"
    assert values(spark, text.language_name, ["UK", "da", "sv"]) == ["Ukrainian", "Danish", "sv"]


def test_character_references_as_html_has_them(spark):
    import html

    from feedloom.functions.entities import unescaped

    texts = ["a &amp; b", "&lt;p&gt;", "&eacute;t&eacute &notit; &notin; &#229;&#xE6; &#x1F600; &#128; &#0; &#xD800; &#99999999999;", "none", "& &; &# &#x; &unknown; &AMP &ampx", "x&NotEqualTilde;y", "", None, "&amp;lt;", "&copy2024 &#00065; &#X41;"]
    texts += ["".join(f"&{n}x " for n in list(html.entities.html5)[k : k + 50]) for k in range(0, len(html.entities.html5), 50)]
    assert values(spark, unescaped, texts) == [None if t is None else html.unescape(t) for t in texts]
    got = values(spark, text.snippet, ["<p>Bl&aring;b&aelig;r&nbsp;og fl&oslash;de til alle &mdash; nu.</p>"])
    assert got == ["Blåbær og fløde til alle — nu."]


def test_what_the_head_of_a_text_decides_and_what_it_does_not(spark):
    """Summaries are looked for in a text's first characters, and in all of it where these don't decide."""
    ends = ["", ".", " .", "..", "!? ", "\n", " "]
    starts = ["", " \n", "Kort. ", "Det er en hel sætning. ", "Det er en hel sætning med mere end femogtyve tegn! ", "En lang og ganske almindelig sætning med punktum. "]
    fills = ["", "å. " * 400, "x" * (text.HEAD - 3), "ø" * (text.HEAD - 20) + ". Og så kommer resten af det hele.", "y z " * 300]
    tails = ["", "Her er den første rigtige sætning i teksten. Og her er så den næste, som er længere.", "Ingen ende her, men en del tegn"]
    all_ = sorted({a + f + t + e for a in starts for f in fills for t in tails for e in ends})

    def summary(s):
        s = s.strip()
        parts = [x for x in (p.strip() for p in s.split(".")) if len(x.encode()) >= 25][:2]
        if parts:
            return ". ".join(parts) + "."
        return s.encode()[:160].decode(errors="ignore") + "..." if len(s.encode()) > 160 else s

    def short(s):
        s = s.strip()
        whole = [x for x in (p.strip() for p in re.findall("[^.!?]*[.!?]", s)) if len(x) >= 15]
        return " ".join((whole or [x + "." for x in (p.strip() for p in s.split(".")) if x])[:2]).strip()

    df = spark.createDataFrame([(s,) for s in all_], "s string")
    for s, got, condensed in df.select("s", text.fallback_summary(F.col("s")), text.condense(F.col("s"), 2)).collect():
        assert (got, condensed) == (summary(s), short(s)), repr(s)


def test_the_text_is_searched_whole_only_where_its_head_does_not_decide(spark):
    """Long texts cost little more than short ones; splitting them whole would take many times as long."""
    def seconds(n: int) -> float:
        df = spark.range(0, 200, 1, 1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit(" er en ganske almindelig sætning."), n)).alias("s"))
        best = 1e9
        for _ in range(3):
            began = time.time()
            df.select(text.fallback_summary(F.col("s")), text.condense(F.col("s"), 2)).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        return best

    assert seconds(3000) < 5 * seconds(30) + 1


def test_similarity_key_of_texts_longer_than_their_head(spark):
    """The words are those that a plain search of the whole text finds, also where the head ends in a word or a tag."""
    starts = ["", " Og det er. ", "<b>Nyt</b> fra byen: ", "en to tre fire fem ", "en to tre fire fem seks syv ", "<a href='x y z'"]
    fills = ["", "og " * 400, "x" * (text.HEAD - 12), "-" * (text.HEAD - 22) + " abcdefghijklmnopqrstu"]
    tails = ["", "> ordene står først her bagefter <i>lige</i> nu", "ord i æøå-teksten, 5 dage"]
    all_ = sorted({a + f + t for a in starts for f in fills for t in tails})

    def picked(s):
        bare = re.sub(r"[^\w]|_", " ", re.sub("<[^>]*>", " ", ("t " + s).strip().lower()))
        found = [w for w in bare.split(" ") if w]
        return "_".join(([w for w in found if len(w.encode()) > 2 and w not in keys.STOP_WORDS] or found)[:6])

    df = spark.createDataFrame([(s,) for s in all_], "s string")
    at = F.timestamp_seconds(F.lit(0))
    for s, got in df.select("s", keys.similarity_key(F.lit("t"), F.col("s"), F.lit("http://h/"), at, F.lit(""), at)).collect():
        assert got == f"h|{picked(s)}|0", repr(s)
