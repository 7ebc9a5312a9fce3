import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from feedloom.llm import bpe, hostrules, queries, simhash, toxicity
from feedloom.llm.secretscan import MASK


def corpus():
    r = random.Random(9)
    vocab = ["".join(r.choices("abcdefghijklmno", k=r.randint(2, 9))) for _ in range(1500)]
    weight = [1 / (k + 3) for k in range(len(vocab))]
    docs, labels = [], []
    for i in range(600):
        w = r.choices(vocab, weight, k=r.randint(40, 150))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(3, len(w) // 20)):
                w.insert(r.randrange(len(w)), r.choice(["vilefool", "grossclod", "dimtoad"]))
        text = " ".join(w) + "."
        if i % 10 == 1:
            text = " ".join(x.upper() + "!!" for x in w)
        if i % 10 == 3:
            text += ' token = "' + "".join(r.choices("0123456789abcdef", k=40)) + '"'
        docs.append((i, text, "en", f"src{i % 4}", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + k, docs[7 * k + 2][1], "en", "src0", docs[7 * k + 2][4]) for k in range(20)]
    near = [t.split(" ") for _, t, *_ in docs[:600:13]]
    docs += [(2000 + k, " ".join([*w[: len(w) // 2], "inserted", *w[len(w) // 2 :]]), "en", "src1", 0) for k, w in enumerate(near)]
    docs += [(3000, None, None, None, None), (3001, "", "en", None, 0), (None, "an ordinary text without an id", "en", "src2", 31)]
    return docs, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"{tmp_path_factory.mktemp('sf')}"
    docs, labels = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_against_plain_ones(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = [r.asDict() for r in docs.collect()], out.collect()
        seen.append(name)
        if k < 4:
            assert out.columns == columns
        ids = Counter(r["doc_id"] for r in after) if k < 4 else None
        if name == "toxicity":
            want = Counter(r.doc_id for r in toxicity.scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if not r.toxic)
            assert ids == want and sum(want.values()) < len(before)
            assert sum(i in ids for i in range(0, 600, 6) if i % 10 != 1) < 10  # of 80 toxic ones
        elif name == "quality rules":
            null = {r["doc_id"] for r in before if r["text"] is None}
            assert null == {3000} <= set(ids)  # kept on any host
            assert ids == Counter(r.doc_id for r in hostrules.verdicts(docs).collect() if not r.rejected or r.doc_id in null)
            assert not any(i in ids for i in range(1, 600, 10))
        elif name == "SimHash near-dedup":
            rows = [r for r in before if r["text"] is not None]
            fp, sk = simhash.signatures(pa.array([r["text"] for r in rows]))
            a, b = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= simhash.RADIUS, 1))
            good = simhash.similarities([sk[i] for i in a], [sk[i] for i in b]) >= simhash.SIMILARITY
            root = list(range(len(rows)))

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for x, y in zip(a[good].tolist(), b[good].tolist()):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
            groups: dict = {}
            for i, row in enumerate(rows):
                groups.setdefault(find(i), []).append(row["doc_id"])
            least = [min((x for x in g if x is not None), default=None) for g in groups.values()]
            assert ids == Counter(least + [r["doc_id"] for r in before if r["text"] is None])
            assert any(len(g) > 1 for g in groups.values())
        elif name == "secret scans":
            assert len(after) == len(before)
            old = {r["doc_id"]: r["text"] for r in before}
            for r in after:
                has = r.doc_id is not None and r.doc_id < 600 and r.doc_id % 10 == 3
                assert (r.text != old[r.doc_id]) == has
                assert not has or (MASK in r.text and r.n_chars == len(r.text))
        else:
            c = bpe.codec(bpe.RANKS)
            need = {r["doc_id"]: int(c.count(pa.array([r["text"]]))[0]) for r in before if r["text"]}
            got = Counter()
            for r in after:
                assert sum(r["lengths"]) == r["n_tokens"] <= 2048
                for d, n in zip(r["doc_ids"], r["lengths"]):
                    got[d] += n
            assert dict(got) == need
        docs = out
    assert seen == ["toxicity", "quality rules", "SimHash near-dedup", "secret scans", "best-fit packing"]


def test_run_and_queries(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
