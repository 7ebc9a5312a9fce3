import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import packing


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(0)
    for _ in range(5):
        a, b = rng.random((8, 12)), rng.random(8) * 3
        x = packing.nnls(a, b)
        y, step = np.zeros(12), 1 / np.linalg.norm(a, 2) ** 2
        for _ in range(20_000):
            y = np.maximum(y - step * a.T @ (a @ y - b), 0)
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-6


def test_patterns_are_all_of_them():
    got = {tuple(p) for p in packing.patterns(8, 3).astype(int).tolist()}
    want = set()
    for k in (1, 2, 3):
        for c in itertools.combinations_with_replacement(range(1, 9), k):
            if sum(c) == 8:
                want.add(tuple(c.count(i) for i in range(1, 9)))
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_fill_never_overflows(lengths):
    n = np.array(lengths, np.int64)
    s = packing.fill(n, 64, 16, 3)
    assert (s >= 0).all()
    sums = np.bincount(s, n) if len(n) else np.zeros(0)
    assert (sums <= 64).all() and (sums > 0).all()


def test_fill_is_dense():
    rng = np.random.default_rng(1)
    n = np.minimum(rng.lognormal(5.8, 1, 5000).astype(np.int64) + 1, 2048)
    s = packing.fill(n)
    assert n.sum() / (2048 * (s.max() + 1)) > 0.97


@pytest.mark.parametrize("shard_docs", [10, 10_000])
def test_every_token_once(spark, shard_docs):
    rng = np.random.default_rng(2)
    rows = [(i, int(x)) for i, x in enumerate(rng.lognormal(5, 1.5, 300).astype(int))] + [(7, None), (8, 0), (9, -3), (None, 40), (None, 40), (1000, 50_000), (1000, 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").selectExpr("*", "'a' shard", "2 n", "3 sequence")
    want = Counter((i, n) for i, n in rows if n and n > 0)
    got = packing.pack_lengths(df, shard_docs=shard_docs).collect()
    pieces = defaultdict(list)
    for r in got:
        assert 0 < r.n_tokens == sum(r.lengths) <= packing.CAPACITY
        for d, s, n in zip(r.doc_ids, r.starts, r.lengths):
            pieces[d].append((s, n))
    for d in {i for i, _ in want}:
        covered = Counter(t for s, n in pieces[d] for t in range(s, s + n))
        expected = Counter(t for (i, n), k in want.items() if i == d for _ in range(k) for t in range(n))
        assert covered == expected
    assert len({(r.shard, r.sequence) for r in got}) == len(got)


def test_documents(spark):
    df = spark.createDataFrame([(1, "two words"), (2, ""), (3, None), (4, "x " * 30_000)], "doc_id long, text string")
    got = packing.pack_documents(df).collect()
    assert {d for r in got for d in r.doc_ids} == {1, 4}
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_rows_that_repeat_are_spread(spark):
    df = spark.createDataFrame([(None, 100)] * 3000 + [(5, 100)] * 3000, "doc_id long, n_tokens long")
    got = packing.pack_lengths(df, shard_docs=500).collect()
    per = Counter()
    for r in got:
        per[r.shard] += len(r.doc_ids)
    assert sum(per.values()) == 6000 and len(per) == 12 and max(per.values()) < 700


def fewest(lengths, capacity):
    """The least number of sequences, by trying every subset: for each set of documents, the fewest full sequences and the least fill of
    the last one."""
    n = len(lengths)
    best = [(n + 1, 0)] * (1 << n)
    best[0] = (0, capacity)
    for s in range(1, 1 << n):
        for i in range(n):
            if s >> i & 1:
                k, fill = best[s ^ 1 << i]
                best[s] = min(best[s], (k, fill + lengths[i]) if fill + lengths[i] <= capacity else (k + 1, lengths[i]))
    return best[-1][0]


def test_query_against_exhaustive_packing(spark):
    import random

    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from feedloom.llm import bpe

    r = random.Random(4)
    texts = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "of", "the"]) for _ in range(r.choice([20, 200, 500, 900, 1500])))) for i in range(150)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    counted = packing.count_tokens(df, "text", "n_tokens", bpe.RANKS)
    got = packing.pack_lengths(counted, shard_docs=9).collect()
    ranks = load_tiktoken_bpe(bpe.RANKS)
    plain = tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    length = {i: len(plain.encode_ordinary(t)) for i, t in texts}
    used, least = 0, 0
    for shard in {x.shard for x in got}:
        rows = [x for x in got if x.shard == shard]
        ids = [d for x in rows for d in x.doc_ids]
        assert all(x.n_tokens == sum(length[d] for d in x.doc_ids) <= packing.CAPACITY for x in rows)
        best = fewest([length[d] for d in ids], packing.CAPACITY) if len(ids) <= 14 else len(rows)
        assert best <= len(rows) <= best + 1
        used, least = used + len(rows), least + best
    assert sorted(d for x in got for d in x.doc_ids) == sorted(length) and used <= 1.05 * least
