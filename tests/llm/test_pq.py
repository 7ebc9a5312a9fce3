import numpy as np

from feedloom.llm import pq, queries


def vectors(n=1500, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 5):
        for j in range(1, 4):
            x[i + j] = x[i] + rng.normal(size=dim) * 0.12 * j / 2
    x[n - 1] = x[n - 2] = x[0]
    return x.astype(np.float32)


def brute(x, cosine):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    return {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(s >= cosine, 1)))}


def test_recall_and_precision(spark):
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = pq.near_pairs(df).collect()
    got = {(r.vec_a, r.vec_b) for r in rows}
    assert len(got) == len(rows)
    n = len(x)
    want = {p for p in brute(x, pq.COSINE) if not set(p) & {n - 1, n - 2}} | {(0, n - 2), (0, n - 1)}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert len(want) > 500 and len(got & want) >= 0.9 * len(want)
    assert all(u[a] @ u[b] >= pq.COSINE - 1e-5 for a, b in got)
    assert all(abs(r.cosine - u[r.vec_a] @ u[r.vec_b]) < 1e-4 for r in rows)


def test_all_pairs_against_unaltered_brute_force(spark, monkeypatch):
    x = vectors(800, seed=3)
    x[50:60] = x[5]  # ten more copies of a vector that has near ones
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = brute(x, pq.COSINE)
    pairs = pq.near_pairs(df)
    rows = pq.all_pairs(pairs).collect()
    got = {(r.vec_a, r.vec_b) for r in rows}
    assert len(rows) == len(got) and len(got & want) >= 0.9 * len(want) and got <= brute(x, pq.COSINE - 1e-4)
    assert {p for p in want if set(p) <= {5, *range(50, 60)}} <= got
    # Lists that are searched by several tasks give the same.
    monkeypatch.setattr(pq, "HOT", 7)
    assert sorted(map(tuple, pq.near_pairs(df).collect())) == sorted(map(tuple, pairs.collect()))


def test_look_up_is_the_distance_to_the_decoded():
    rng = np.random.default_rng(1)
    ix = pq.Index(rng.normal(size=(4, 16)).astype(np.float32), rng.normal(size=(8, 256, 2)).astype(np.float32))
    x, q = rng.normal(size=(20, 16)).astype(np.float32), rng.normal(size=(3, 16)).astype(np.float32)
    codes, t = ix.codes(x), ix.tables(q)
    d = sum(t[:, j, :][:, codes[:, j]] for j in range(8))
    assert np.allclose(d, ((q[:, None] - ix.decoded(codes)[None]) ** 2).sum(2), atol=1e-3)


def test_awkward_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [nan, 1.0]), (8, [1.0, None]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 id", "'x' v", "2 a")
    got = {(r.vec_a, r.vec_b): r.cosine for r in pq.near_pairs(df).collect()}
    assert got == {(1, 3): 1.0, (1, 2): 1.0}
    assert pq.near_pairs(df.limit(0)).count() == 0


def test_a_row_for_every_vector_with_its_group_and_links(spark, tmp_path):
    x = vectors(600, seed=7)
    x[50:60] = x[5]  # copies of a vector that has near ones
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = brute(x, pq.COSINE)
    root, links = list(range(len(x))), [0] * len(x)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    pairs = [(r.vec_a, r.vec_b) for r in pq.all_pairs(pq.near_pairs(frame)).collect()]
    assert len(set(pairs) & want) >= 0.9 * len(want) and len(want) > 200 and all(u[a] @ u[b] >= pq.COSINE - 1e-4 for a, b in pairs)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    first: dict = {}
    same = [j if (j := first.setdefault(v.tobytes(), i)) != i else None for i, v in enumerate(x)]
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries.op2_pq_near_dedup(spark, f"{tmp_path}").collect()
    assert sorted(map(tuple, rows), key=lambda r: r[0]) == [(i, find(i), links[i], same[i]) for i in range(len(x))]


def test_groups_of_awkward_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (None, [1.0, 0.0]), (10, [0.0, 1.0])]
    rows += [(20, [0.0, 0.0, 1.0]), (21, [0.0, 0.0, 1.0]), (21, [0.0, 1.0, 0.0]), (22, [0.0, 1.0, 0.0])]  # one id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 id", "'x' v", "2 a", "3 label")
    got = sorted(map(tuple, pq.groups(df).collect()), key=str)
    assert got == sorted([(1, 1, 2, None), (2, 1, 2, None), (3, 1, 2, 1), (3, 1, 2, 1), (4, 4, 0, None), (5, 5, 0, None), (6, 6, 0, None), (None, None, 0, None), (10, 10, 0, None), (20, 20, 1, None), (21, 20, 2, 20), (21, 20, 2, 20), (22, 20, 1, 21)], key=str)
    assert pq.groups(df.limit(0)).count() == 0
