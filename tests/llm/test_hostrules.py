import duckdb
import pytest

from feedloom.llm import hostrules

CAPS = "THERE IS NOTHING!! HERE!! BUT NOISE!! AND MORE!! NOISE!! OF IT!!"
CLEAN = "An ordinary sentence of ordinary words that anyone might have written here."
BARS = "aaa | bbb | ccc | ddd | eee | fff | ggg | hhh"
ONE = "x\n".join(["This very line is here again and again"] * 8)


def rows():
    out = [(i, CLEAN + str(i), "good") for i in range(40)] + [(40, CAPS, "good"), (41, ONE, "good")]
    out += [(100 + i, CAPS, "bad") for i in range(30)] + [(140, ONE, "bad"), (141, CLEAN, "bad")]
    out += [(200, CAPS, "tiny"), (201, BARS, None), (202, CLEAN, None), (None, CLEAN, "good"), (300, None, "good"), (301, "", "good"), (302, "w" * 200_000, "good"), (0, CLEAN + "0", "good")]
    return out


def frames(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, source string").selectExpr("*", "1 host", "2 n_failed", "cast(null as int) host_bad")


def test_matches_sql(spark):
    df = frames(spark)
    got = hostrules.verdicts(df).toPandas()
    documents = df.select("doc_id", "text", "source").toPandas()  # noqa: F841
    want = duckdb.sql(hostrules.sql()).df()
    assert sorted(got.columns) == sorted(want.columns)

    def key(d):
        return sorted(map(str, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist()))

    assert [x.replace(".0", "") for x in key(got)] == [x.replace(".0", "") for x in key(want)]


def test_verdicts(spark):
    got = {}
    for r in hostrules.verdicts(frames(spark)).collect():
        got.setdefault(r.doc_id, r)
    assert got[40].rejected and got[100].rejected  # several rules: anywhere
    assert got[41].n_failed == 1 and not got[41].rejected  # one rule: only on a bad host
    assert got[140].n_failed == 1 and got[140].host_bad and got[140].rejected
    assert not got[141].rejected and got[141].host_bad
    assert got[200].host_rate < 1 and got[200].n_failed >= 2  # one document says little of a host
    assert got[301].fail_word_length == 1 and got[300].fail_word_length == 1
    assert got[201].host is None and got[202].host is None


def test_accepted_is_what_is_not_rejected(spark):
    df = frames(spark)
    kept = hostrules.accepted(df)
    assert kept.columns == df.columns
    want = sorted(str(r.doc_id) for r in hostrules.verdicts(df).collect() if not r.rejected)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


@pytest.mark.parametrize("hosts", [1, 3])
def test_few_hosts_and_empty(spark, hosts):
    df = spark.createDataFrame([(i, CLEAN, f"h{i % hosts}") for i in range(9)], "doc_id long, text string, source string")
    assert all(r.host_rate == 0 and not r.rejected for r in hostrules.verdicts(df).collect())
    assert hostrules.verdicts(df.limit(0)).count() == 0 and hostrules.accepted(df.limit(0)).count() == 0


def test_repeated_words_go_and_plain_texts_stay(spark):
    import random

    r = random.Random(3)
    vocab = ["".join(r.choices("abcdefghijk", k=r.randint(2, 8))) for _ in range(600)]
    plain = [" ".join(r.choices(vocab, [1 / (k + 3) for k in range(600)], k=n)) for n in (3, 30, 300, 3000)]
    junk = ["The " * 40, "Ordinary words first. " + "Ciónmenteueó. " * 60, "\n".join(["Tiny line"] * 30), " ".join(w for x in "the of and to".split() for w in [x] * 25)]
    lines = "\n".join(" ".join([w] * 15) for w in ["Esthes", "Esthes", "Esthes", "Esthes", "Anders"])
    docs = [(i, t, "h") for i, t in enumerate([*plain, "no no no", "", None, ONE])] + [(100 + i, t, "h") for i, t in enumerate([*junk, lines])]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 __text", "2 __failed")
    kept = hostrules.accepted(df)
    assert kept.schema == df.schema
    assert sorted(x.doc_id for x in kept.collect()) == list(range(8))
    assert not any(x.rejected for x in hostrules.verdicts(df).collect())


def test_a_null_text_on_a_bad_host_is_kept(spark):
    rows = [(i, CAPS, "bad") for i in range(30)] + [(100, None, "bad"), (101, "", "bad"), (102, ONE, "bad"), (103, CLEAN, "bad")] + [(200 + i, CLEAN, "good") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in hostrules.accepted(df).collect()}
    assert kept == {100, 103, *range(200, 230)}


def test_domains(spark):
    urls = {"https://WWW.Example.org/a?b#c": "example.org", "http://u:p@h.example:8080/x": "h.example", "//cdn.example/x": "cdn.example", "https://example.org.:443": "example.org", "mailto:a@b.c": None, "": None, None: None, "http:///x": None}
    df = spark.createDataFrame([(i, u, CLEAN) for i, u in enumerate(urls)], "doc_id long, url string, text string")
    got = hostrules.with_domain(df)
    assert [r.source for r in got.orderBy("doc_id").collect()] == list(urls.values())
    assert hostrules.verdicts(got).count() == len(urls)


def test_a_host_far_out_among_its_like_is_bad(spark):
    rows = [(100 * h + k, ONE if k < (30 if h == 0 else 5 + h % 2) else CLEAN, f"h{h}") for h in range(40) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = hostrules.verdicts(df).collect()
    assert {r.host for r in got if r.host_bad} == {"h0"}
    assert {r.doc_id for r in got if r.rejected} == set(range(30)) and max(r.host_rate for r in got) < hostrules.MAX_HOST_RATE
    assert {r.doc_id for r in hostrules.accepted(df).collect()} == {r[0] for r in rows} - set(range(30))
