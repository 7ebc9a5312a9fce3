import random

import numpy as np
import pyarrow as pa
import pytest

from feedloom.llm import simhash


def make(seed=3, n=300):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(3000)]
    docs = []
    for i in range(n):
        base = [r.choice(vocab) for _ in range(r.randint(40, 200))]
        docs.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            w = list(base)
            for _ in range(max(1, len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(vocab)
            docs.append(" ".join(w))
    return docs


def brute(texts):
    """Groups of texts whose pairs are within the radius and similar, over all pairs."""
    fp, sk = simhash.signatures(pa.array(texts))
    d = np.bitwise_count(fp[:, None] ^ fp[None, :])
    a, b = np.nonzero(np.triu(d <= simhash.RADIUS, 1))
    good = simhash.similarities([sk[i] for i in a], [sk[i] for i in b]) >= simhash.SIMILARITY
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = set(zip(a[good].tolist(), b[good].tolist()))
    for x, y in pairs:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], pairs


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    v = np.unique(np.concatenate([v, v[:200] ^ (np.uint64(1) << rng.integers(0, 60, 200).astype(np.uint64))]))
    rng.shuffle(v)
    for radius in (0, 3, 12):
        d = np.bitwise_count(v[:, None] ^ v[None, :])
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(d <= radius, 1)))}
        asks = rng.random(len(v)) < 0.5
        some = {(int(a), int(b)) for x in simhash.BkTree(v).pairs(radius, asks) for a, b in zip(x[0], x[1])}
        assert some == {p for p in want if asks[p[1]]}
        assert {(int(a), int(b)) for x in simhash.BkTree(v).pairs(radius, step=5000) for a, b in zip(x[0], x[1])} == want


def test_similarity_is_jaccard():
    sets = [{1, 2, 3, 4}, {3, 4, 5}, set(), {1, 2, 3, 4}]
    raw = [np.array(sorted(s), np.uint32).tobytes() for s in sets]
    got = simhash.similarities([raw[0], raw[0], raw[2]], [raw[1], raw[3], raw[2]])
    assert got.tolist() == [2 / 5, 1.0, 0.0]


def test_groups_match_brute_force(spark):
    texts = make()
    want, pairs = brute(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.groups(df).collect()}
    assert len(got) == len(texts)
    together = sum(got[a].group_id == got[b].group_id for a, b in pairs)
    assert together >= 0.9 * len(pairs) and len(pairs) > 100
    for i, g in enumerate(want):  # never more than brute force joins
        assert want[got[i].group_id] == g
    assert sum(r.keep for r in got.values()) == len({r.group_id for r in got.values()})
    for r in got.values():
        assert r.keep == (r.doc_id == r.group_id)


def test_sharding_keeps_recall(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 32)
    texts = make(5)
    want, pairs = brute(texts)
    got = {r.doc_id: r.group_id for r in simhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_hot_shards_are_split_and_find_the_same(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(make(6, 150))), "doc_id long, text string")
    want = sorted((r.doc_id, r.group_id) for r in simhash.groups(df).collect())
    monkeypatch.setattr(simhash, "HOT", 16)
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    assert {"split", "asks"} <= set(simhash._routed(spark.range(100).selectExpr("id fp", "id node"), 100).columns)
    assert sorted((r.doc_id, r.group_id) for r in simhash.groups(df).collect()) == want
    assert len({g for _, g in want}) < len(want)


def test_recall_and_precision_against_true_jaccard(spark):
    texts = make(11, 250) + ["Ein kurzer Satz, mehr nicht", "ein kurzer satz mehr nicht!"]
    sets = []
    for t in texts:
        w = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        sets.append(set(zip(w, w[1:])))
    index: dict = {}
    for i, x in enumerate(sets):
        for p in x:
            index.setdefault(p, []).append(i)
    pairs = {(a, b) for own in index.values() for a in own for b in own if a < b}
    jaccard = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}
    got = {r.doc_id: r.group_id for r in simhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    near = [p for p, j in jaccard.items() if j >= simhash.SIMILARITY]
    assert len(near) > 100 and sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near)
    # A group holds no text that isn't fairly like another of it.
    for i in got:
        mates = [j for j in got if j != i and got[j] == got[i]]
        assert not mates or max(jaccard.get((min(i, j), max(i, j)), 0) for j in mates) >= simhash.SIMILARITY - 0.15


def test_texts_with_one_fingerprint_that_are_not_alike(spark):
    r = random.Random(2)
    w = ["".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(120)]
    orders = [r.sample(w, len(w)) for _ in range(4)]
    texts = [" ".join(o) for o in orders] + [" ".join([*o[:60], *"seven quite other words stand between these".split(), *o[67:]]) for o in orders]
    fp, _ = simhash.signatures(pa.array(texts))
    assert len(set(fp[:4].tolist())) == 1 and all(f != fp[0] for f in fp[4:])
    got = {x.doc_id: x.group_id for x in simhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i % 4 for i in range(8)}


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    long = "word other thing " * 60_000
    rows = [(5, "same text here again"), (2, "same text here again"), (2, "same text here again"), (None, "same text here again"), (7, None), (7, None), (8, ""), (9, ""), (10, "...!"), (11, long), (12, long), (13, "alone in this")]
    schema = "doc_id long, text string"
    if extra:
        rows, schema = [(*r, "x", 1, 2, None) for r in rows], schema + ", node string, label int, keep int, __node int"
    df = spark.createDataFrame(rows, schema)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([2, 7, 7, 8, 10, 11, 13], key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(df).count() == 0 and simhash.deduplicated(df).count() == 0


def test_masks_reach_the_recall_at_every_size():
    import math

    for n in (250_000, 15_000_000, 300_000_000):
        found = simhash.masks(n)
        k = found[0].bit_count()
        assert 1 - (1 - math.comb(64 - simhash.RECALL_AT, k) / math.comb(64, k)) ** len(found) >= simhash.RECALL


def test_summaries_never_rule_out_what_is_alike():
    rng = np.random.default_rng(4)
    a, b = [], []
    for k in range(600):
        own = rng.integers(0, 1 << 32, rng.choice([1, 2, 5, 60, 130, 400]), dtype=np.uint32)
        other = rng.integers(0, 1 << 32, rng.choice([1, 2, 5, 60, 130, 400]), dtype=np.uint32)
        both = np.concatenate([own[: len(own) * (k % 5) // 4], other])
        a.append(np.unique(own)[: simhash.SKETCH].tobytes())
        b.append(np.unique(both)[: simhash.SKETCH].tobytes())
    most, true = simhash.bounds(simhash.summaries(a), simhash.summaries(b)), simhash.similarities(a, b)
    assert (most >= true - 1e-12).all() and (true >= 0.5).sum() > 100
    unlike = (true < 0.05) & np.array([len(x) == len(y) == 4 * simhash.SKETCH for x, y in zip(a, b)])
    assert unlike.sum() > 10 and (most[unlike] < 0.5).mean() > 0.8


def test_unlike_texts_with_close_fingerprints_cost_no_verification(spark, monkeypatch):
    r = random.Random(8)
    w = ["".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(150)]
    texts = [" ".join(r.sample(w, len(w))) for _ in range(200)]
    assert len(set(simhash.signatures(pa.array(texts))[0].tolist())) == 1
    seen, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    got = {x.doc_id: x.group_id for x in simhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(200)} and sum(seen) < 2000  # of 19,900 pairs


def test_no_link_is_lost_by_texts_with_one_fingerprint(spark):
    r = random.Random(5)
    w = ["".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(150)]
    new = "seven quite other words stand between these".split()
    turned = [*w[:105], *w[:104:-1]]
    begun = [*w[44::-1][:20], *new, *w[44::-1][27:], *w[45:]]  # like w, but not like what has its end turned
    middle = [*w[:45], *w[89:44:-1][:20], *new, *w[89:44:-1][27:], *turned[90:]]  # the other way round
    texts = [" ".join(x) for x in (w, turned, begun, middle)]
    fp, sk = simhash.signatures(pa.array(texts))
    near = {(i, j) for i in range(4) for j in range(i + 1, 4) if simhash.similarities([sk[i]], [sk[j]])[0] >= simhash.SIMILARITY}
    assert near == {(0, 1), (0, 2), (1, 3)} and fp[0] == fp[1] and np.bitwise_count(fp ^ fp[0]).max() <= simhash.RADIUS
    got = {x.doc_id: x.group_id for x in simhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(4)}
