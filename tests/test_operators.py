import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedloom.operators import dedup, enrich, ledger, select, usage

def NOW():
    return F.lit("2024-01-15 00:00:00").cast("timestamp")


def test_staged_matches_sequential_loop(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(12), r.randrange(12), r.randrange(12)) for i in range(120)]
    seen, want = [set(), set(), set()], []
    for o, *ks in rows:
        for s, k in zip(seen, ks):
            if k in s:
                break
            s.add(k)
        else:
            want.append(o)
    df = spark.createDataFrame(rows, "ord long, a int, b int, c int")
    for parts in (1, 7):
        got = dedup.staged(df.repartition(parts), [F.col("a"), F.col("b"), F.col("c")])
        assert sorted(x.ord for x in got.collect()) == want


def shingles(s):
    import re

    w = re.sub(r"[^0-9a-z\s]+", " ", s.lower(), flags=re.ASCII).split()
    return {" ".join(w[i : i + 2]) for i in range(len(w) - 1)} or set(w)


def greedy(rows):
    kept = []
    for o, t in rows:
        a = shingles(t or "")
        if not any(a and (b := shingles(u or "")) and len(a & b) / len(a | b) >= 0.55 for _, u in kept):
            kept.append((o, t))
    return [o for o, _ in kept]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_titles_match_sequential_loop(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(80):
        w = r.choices("alpha beta gamma delta eps zeta eta".split(), k=r.randint(1, 7))
        rows.append((i, " ".join(w)))
    rows += [(100, "Привіт світ"), (101, "Привіт світ"), (102, ""), (103, None), (104, "København")]
    df = spark.createDataFrame(rows, "ord long, title string").withColumn("s", F.lit(1))
    got = sorted(x.ord for x in dedup.distinct_titles(df.repartition(3)).collect())
    assert got == greedy(rows)


def test_chain_keeps_both_ends(spark):
    rows = [(1, "a b c d e"), (2, "b c d e f"), (3, "c d e f g")]
    got = [x.ord for x in dedup.distinct_titles(spark.createDataFrame(rows, "ord long, title string")).orderBy("ord").collect()]
    assert got == greedy(rows) == [1, 3]
    assert dedup.distinct_titles(spark.createDataFrame([], "ord long, title string")).count() == 0


def test_age(spark):
    rows = [(1, "2024-01-14 00:00:00"), (2, "2024-01-13 23:59:59"), (3, None), (4, "2024-02-01 00:00:00")]
    df = spark.createDataFrame(rows, "ord long, published string").withColumn("published", F.col("published").cast("timestamp"))
    assert sorted(x.ord for x in dedup.young(df, NOW()).collect()) == [1, 3, 4]


def pick(pool, limit, per_source, per_category):
    out, s, k = [], Counter(), Counter()
    for x in pool:
        if len(out) < limit and x[1] and not (per_source and s[x[2]] >= per_source) and not (per_category and k[x[3]] >= per_category):
            out.append(x)
            s[x[2]] += 1
            k[x[3]] += 1
    for x in pool:
        if len(out) < limit and x[1] not in [y[1] for y in out]:
            out.append(x)
    return [x[0] for x in sorted(out, key=lambda x: (-x[4], -x[5]))]


@pytest.mark.parametrize("seed", range(4))
def test_choice_matches_loop(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["", "l1", "l2", f"x{i}", f"x{i}"]), r.choice("abc"), r.choice("pqr"), r.randrange(4) * 10, r.randrange(3)) for i in range(30)]
    df = spark.createDataFrame(rows, "ord long, link string, source_name string, category string, score int, t int").withColumn("published", F.timestamp_seconds("t"))
    pool = sorted(rows, key=lambda x: (-x[4], -x[5], x[0]))[:24]
    for limit, a, b in ((6, 2, 2), (12, 1, 3), (5, 0, 0)):
        got = [x.ord for x in select.diverse(select.ranked(df, 24), limit, a, b).orderBy("position").collect()]
        assert got == pick(pool, limit, a, b)
    assert select.diverse(df, 0).count() == 0


def sent(spark, rows):
    return spark.createDataFrame(rows, "hash string, title string, link string, category string, source string, sent_at string").withColumn("sent_at", F.col("sent_at").cast("timestamp"))


def test_ledger_cutoff_and_stats(spark):
    l = sent(spark, [("a", "t", "l1", "x", "s", "2024-01-13 00:00:00"), ("b", "t", "l2", None, "s", "2024-01-14 00:00:00"), ("c", "u", "l3", "x", "s", "2024-01-14 01:00:00"), ("d", "v", "l4", "y", "s", "2024-01-12 23:59:59")])
    assert sorted(r.hash for r in ledger.active(l, NOW()).collect()) == ["b", "c"]
    assert sorted(r.hash for r in ledger.cleaned(l, NOW()).collect()) == ["a", "b", "c"]
    assert {r.name: r.value for r in ledger.stats(l, NOW()).collect()} == {"total_items": 4, "active_items": 2, "category_x": 1}
    assert [r.hash for r in ledger.recent(l, 2).collect()] == ["c", "b"] and ledger.recent(l, 0).count() == 4
    assert ledger.repeated_titles(l, NOW()).count() == 0


def test_upserts(spark):
    old = sent(spark, [("a", "t", "l1", "x", "s", "2024-01-13 00:00:00"), ("b", "t", "l2", "x", "s", "2024-01-14 00:00:00")])
    new = sent(spark, [("a", "T", "L", None, "S", "2024-01-15 00:00:00"), ("c", "n", "l3", "x", "s", "2024-01-15 00:00:00"), ("c", "n", "l3", "x", "s", "2024-01-14 00:00:00")])
    only = {r.hash: (r.title, r.category, str(r.sent_at)[:10]) for r in ledger.upserted(old, new).collect()}
    assert only == {"a": ("t", "x", "2024-01-15"), "b": ("t", "x", "2024-01-14"), "c": ("n", "x", "2024-01-15")}
    assert {r.hash: (r.title, r.category) for r in ledger.upserted(old, new, True).collect()}["a"] == ("T", None)


def test_send_loop(spark):
    l = sent(spark, [("h0", "t", "k0", "x", "s", "2024-01-14 00:00:00"), ("h9", "t", "k9", "x", "s", "2023-01-14 00:00:00")])
    rows = [(1, "h0", "k1", True), (2, "h2", "k0", True), (3, "h9", "k9", True), (4, "h4", "k4", False), (5, "h4", "k5", True), (6, "h6", "k9", True), (7, "h7", "k7", None), (8, "h8", "k8", True)]
    items = spark.createDataFrame(rows, "ord long, hash string, link string, send_ok boolean")
    assert [(r.ord, r.outcome) for r in ledger.send_loop(items, l, NOW(), 5).orderBy("ord").collect()] == [(3, "sent"), (4, "failed"), (5, "sent"), (6, "duplicate"), (7, "failed")]
    assert ledger.first_unsent(items, l, NOW()).first().ord == 3


def test_json_ledger(spark, tmp_path):
    l = sent(spark, [("a", "t", "l1", "x", "s", "2024-01-14 00:00:00"), ("a", "t2", "l1", "x", "s", "2024-01-14 12:00:00"), ("b", "t", "l2", None, "s", "2023-01-14 00:00:00")])
    path = f"file://{tmp_path}/ledger"
    ledger.write_json(l.coalesce(1), path)
    got = ledger.read_json(spark, path, NOW())
    assert [r.hash for r in got.collect()] == ["a"] and got.columns == l.columns


def test_translation_cache(spark):
    put = spark.createDataFrame([("h", "t", "c", "s", "d", "u", "p")], "content_hash string, title string, content string, summary string, danish_translation string, ukrainian_translation string, ai_provider string")
    empty = put.selectExpr("*", "timestamp '2024-01-01' created_at", "timestamp '2024-01-01' last_used_at", "1 use_count").limit(0)
    once = ledger.cached_translations(empty, put, NOW())
    twice = ledger.cached_translations(once, put.withColumn("summary", F.lit("new")), NOW()).first()
    assert once.first().use_count == 1 and twice.use_count == 2 and twice.summary == "new"
    kv = spark.createDataFrame([("k", "2024-01-15 00:00:00"), ("old", "2024-01-14 00:00:00")], "k string, e string").select("k", F.col("e").cast("timestamp").alias("expires_at"))
    assert [r.k for r in ledger.unexpired(kv, NOW()).collect()] == ["k"]


def test_enrichment(spark):
    items = spark.createDataFrame([(i, f"l{i}", f"old content number {i} that is long enough. x", "t") for i in range(4)], "ord long, link string, content string, title string")
    arts = spark.createDataFrame([("l0", "a" * 201), ("l1", "b" * 150), ("l2", "c" * 300), ("l3", "d" * 300)], "url string, article string")
    got = {r.ord: r.content[:1] for r in enrich.with_articles(items, arts, 3).collect()}
    assert got == {0: "a", 1: "o", 2: "c", 3: "o"}
    main = spark.createDataFrame([("l0", "S", "D", "U"), ("l1", None, None, None), ("l3", "S", "D", "U")], "link string, summary string, danish string, ukrainian string")
    got = {r.ord: r.summary for r in enrich.with_summaries(items, main, 2).collect()}
    assert got[0] == "S" and got[1].startswith("old content") and got[3].startswith("old content")


def test_metrics_and_quotas(spark):
    rows = [("processed", 1, 0, ""), ("time", 2, 10, ""), ("time", 3, 15, ""), ("error", 4, 0, "boom"), ("run", 5, 0, "")]
    e = spark.createDataFrame(rows, "kind string, t long, millis long, message string").select("kind", F.timestamp_seconds("t").alias("at"), "millis", "message")
    m = usage.run_metrics(e).first()
    assert (m.news_processed, m.total_millis, m.average_millis, m.last_millis, m.last_error, m.healthy) == (1, 25, 12, 15, "boom", True)
    none = usage.run_metrics(e.limit(0)).first()
    assert none.average_millis == 0 and none.healthy
    assert usage.hit_rate(spark.createDataFrame([], "hit boolean, tokens long")).first().hit_rate == 0
    day = 86_400
    req = [(1, 0, "a"), (2, 1, "a"), (3, 2, "b"), (4, 3, "b"), (5, 4, "c"), (6, 2 * day, "a"), (7, 2 * day, "z")]
    r = spark.createDataFrame(req, "ord long, t long, provider string").select("ord", F.timestamp_seconds("t").alias("at"), "provider")
    got = {x.ord: x.admitted for x in usage.admitted(r, {"a": 1, "b": 2, "c": 0}, 3).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True}


def test_admission_against_a_plain_loop(spark):
    r = random.Random(12)
    at, rows = 0, []
    for i in range(600):
        at += r.choice([0, 1, 400, 3000])
        rows.append((i, at, r.choice(["a", "b", "c", None])))
    quotas, total, day = {"a": 9, "b": 4, "c": 0}, 20, 86_400
    since, used, spent, want = None, Counter(), 0, {}
    for i, t, p in rows:
        if since is None or t - since > day:
            since, used, spent = t, Counter(), 0
        ok = spent < total and not (quotas.get(p, 0) and used[p] >= quotas[p])
        want[i] = ok
        used[p] += ok
        spent += ok
    df = spark.createDataFrame(rows, "ord long, t long, provider string").select("ord", F.timestamp_seconds("t").alias("at"), "provider").repartition(5)
    assert {x.ord: x.admitted for x in usage.admitted(df, quotas, total).collect()} == want
    assert all(x.admitted for x in usage.admitted(df, {}, 0).collect())
    assert usage.admitted(df.limit(0), quotas, total).count() == 0
    begun = {x.since for x in usage.periods(df).collect()}
    assert len(begun) > 3


def test_cache_look_ups(spark):
    cache = spark.createDataFrame([("a", "old", 50), ("a", "new", 200), ("b", "gone", 99), ("c", "just", 100), ("d", None, 500)], "key string, value string, t long").select("key", "value", F.timestamp_seconds("t").alias("expires_at"))
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, None), (6, "zz"), (7, "a")], "id int, key string")
    got = {x.id: (x.value, x.hit) for x in ledger.looked_up(asked, cache, F.timestamp_seconds(F.lit(100))).collect()}
    assert got == {1: ("new", True), 2: (None, False), 3: ("just", True), 4: (None, True), 5: (None, False), 6: (None, False), 7: ("new", True)}
    kept = spark.createDataFrame([("h", "s", "d", None, "groq")], "content_hash string, summary string, danish_translation string, ukrainian_translation string, ai_provider string")
    asked = spark.createDataFrame([(1, "h"), (2, "x"), (3, None)], "id int, content_hash string")
    got = {x.id: (x.danish_translation, x.found) for x in ledger.translations_of(asked, kept).collect()}
    assert got == {1: ("d", True), 2: (None, False), 3: (None, False)}


def test_articles_and_summaries_for_the_first_few(spark):
    rows = [(i, f"l{i % 7}", "short") for i in range(30)]
    items = spark.createDataFrame(rows, "ord int, link string, content string").repartition(4)
    articles = spark.createDataFrame([(f"l{k}", "w" * 300) for k in range(7)] + [("l1", "w" * 300)], "url string, article string")
    for most in (0, 4):
        got = {x.ord: x.content != "short" for x in enrich.with_articles(items, articles, most).collect()}
        assert got == {i: i < 4 or most == 0 for i in range(30)}
    main = spark.createDataFrame([(f"l{k}", "S", "D", None) for k in range(7)], "link string, summary string, danish string, ukrainian string")
    got = {x.ord: (x.summary, x.danish, x.ukrainian) for x in enrich.with_summaries(items, main, 3).collect()}
    assert all(got[i] == (("S", "D", "short") if i < 3 else ("short",) * 3) for i in range(30))


def test_endpoints(spark):
    import json

    rows = [("processed", 1, 0, ""), ("time", 2, 10, ""), ("error", 4, 0, 'a "boom"'), ("run", 3, 0, "")]
    e = spark.createDataFrame(rows, "kind string, t long, millis long, message string").select("kind", F.timestamp_seconds("t").alias("at"), "millis", "message")
    sick = usage.health_body(usage.run_metrics(e)).first()
    assert sick.code == 503 and json.loads(sick.body) == {"status": "error", "last_error": 'a "boom"', "last_run": "1970-01-01T00:00:03Z"}
    full = json.loads(usage.metrics_body(usage.run_metrics(e)).first().body)
    assert full["last_error_time"] == "1970-01-01T00:00:04Z" and full["average_processing_time_ms"] == 10 and full["is_healthy"] is False
    new = usage.health_body(usage.run_metrics(e.limit(0))).first()
    assert new.code == 200 and json.loads(new.body) == {"status": "ok", "last_error": "", "last_run": "0001-01-01T00:00:00Z"}
    assert json.loads(usage.metrics_body(usage.run_metrics(e.limit(0))).first().body)["last_processing_time_ms"] == 0
