"""SimHash near-duplicates, found by BK-trees over shards of the fingerprints.

A fingerprint is 64 majority bits over the text's distinct longer words. Fingerprints are sharded by several masks of their bits, as many
as keep a pair ten bits apart together with probability 0.98 at the shard size that is aimed at; so shards stay of one size as the corpus
grows and only the number of masks rises slowly. In each shard a BK-tree, whose children are keyed by their distance to the parent, is
searched with every member, along edges within the radius only. With each fingerprint goes a summary of the text's bottom sketch of word
pairs, which rules out most pairs that aren't alike, and none that is, where they are found. Those left are verified on the sketches: a
first round verifies a spanning forest of what each shard found; a second, every other pair that would still join two groups, which only
groups with a refuted pair can have. So large groups of copies need no quadratic verification, and no pair is left out that could change a
group. Texts count as one only if fingerprint and sketch are the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Chars, checkpointed, columns, fresh, mix, ranges, run_hashes, ship, slices, utf8, words, written

RADIUS = 12
#: Least share of word pairs, in the union of both texts', that copies have in common.
SIMILARITY = 0.5
#: Word pairs kept of a text; a text with no more than these is compared exactly.
SKETCH = 128
SHARD = 512
#: A subtree with no more values is compared as a whole.
LEAF = 128
#: Residues of a sketch's values that go with the fingerprint, so that most pairs that aren't alike are refuted where they are found.
BITS = 320
#: A shard with more members is searched by several tasks, each of which has its tree and so many of its members as queries.
HOT = 8192
#: Shards' sizes are told from one fingerprint in so many; they only say over how many tasks a search is spread.
SAMPLED = 64
RECALL, RECALL_AT = 0.98, 10
#: A broadcast side may have at most so many rows of two numbers; beyond it, the join shuffles.
BROADCAST_ROWS = 1_000_000


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs in order, of the hashes' top 40 bits."""
    key = np.unique((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    return (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1)


_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def _majority(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """For each document, the bits set in more than half of its features."""
    h = mix(h)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    per = np.diff(bounds)
    out = np.zeros(n, np.uint64)
    some = np.flatnonzero(per)
    if not len(some):
        return out
    parts = -(-per[some] // 255)
    starts = np.repeat(bounds[:-1][some], parts) + 255 * ranges(np.zeros(len(some), np.int64), parts)
    packed = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], starts, axis=0)
    counts = np.add.reduceat(packed.view(np.uint8).reshape(len(starts), 64), np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    out[some] = np.packbits(2 * counts > per[some][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def signatures(arr: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Fingerprints and sketches of texts. A text without longer words counts all its words; one without words, itself."""
    n = len(arr)
    chars = Chars(pc.utf8_lower(arr))
    starts, ends, doc = words(chars)
    h = run_hashes(chars.cp, starts, ends)
    whole = run_hashes(chars.cp, chars.off[:-1], chars.off[1:])
    long = ends - starts >= 4
    lacks = np.bincount(doc[long], minlength=n)[:n] == 0
    take = long | lacks[doc]
    wordless = np.flatnonzero(np.bincount(doc, minlength=n)[:n] == 0)
    d, f = _distinct(np.concatenate([doc[take], wordless]), np.concatenate([h[take], whole[wordless]]))
    fp = _majority(d, f, n)
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    s = mix(h[pair] * np.uint64(3) + h[pair + 1]) if len(pair) else np.zeros(0, np.uint64)
    single = np.flatnonzero(np.bincount(doc, minlength=n)[:n] == 1)
    d, f = _distinct(np.concatenate([doc[pair], wordless, single]), np.concatenate([s, whole[wordless], h[np.searchsorted(doc, single)] if len(single) else s[:0]]))
    f32 = (f >> np.uint64(8)).astype(np.uint32)
    bounds = np.searchsorted(d, np.arange(n + 1))
    raw, ends_ = f32.tobytes(), np.minimum(bounds[1:], bounds[:-1] + SKETCH)
    return fp, [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), ends_.tolist())]


def similarities(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Jaccard similarity of sketched sets, pair by pair: over the SKETCH least of the union."""
    n = len(a)
    ka, kb = (np.fromiter((len(x) // 4 for x in s), np.int64, n) for s in (a, b))
    va, vb = (np.frombuffer(b"".join(s), np.uint32).astype(np.uint64) for s in (a, b))
    row = np.concatenate([np.repeat(np.arange(n), ka), np.repeat(np.arange(n), kb)])
    key = np.sort((row.astype(np.uint64) << np.uint64(32)) | np.concatenate([va, vb]))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    both = np.zeros(len(key), bool)
    both[:-1] = ~first[1:]
    key, both = key[first], both[first]
    row = (key >> np.uint64(32)).astype(np.int64)
    starts = np.searchsorted(row, np.arange(n + 1))
    rank = np.arange(len(row)) - starts[row]
    inside = rank < SKETCH
    union = np.minimum(np.diff(starts), SKETCH)
    return np.bincount(row[inside & both], minlength=n)[:n] / np.maximum(union, 1)


def summaries(sketches: list[bytes]) -> np.ndarray:
    """Of each sketch, which of BITS residues its values have, and in a last word how many values there are."""
    n = len(sketches)
    size = np.fromiter((len(x) // 4 for x in sketches), np.int64, n)
    at = np.frombuffer(b"".join(sketches), np.uint32) % np.uint32(BITS)
    flags = np.zeros((n, BITS), bool)
    flags[np.repeat(np.arange(n), size), at] = True
    return np.concatenate([np.packbits(flags, axis=1, bitorder="little").view(np.uint64), size.astype(np.uint64)[:, None]], axis=1)


def bounds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What similarities() of the summarised sketches is at most, pair by pair: a residue that one lacks is a value that it lacks."""
    kx, ky = x[:, -1].astype(np.int64), y[:, -1].astype(np.int64)
    x, y = x[:, :-1], y[:, :-1]
    both = np.minimum(kx - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), ky - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
    return both / np.maximum(np.minimum(kx + ky - both, SKETCH), 1)


Pairs = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


class BkTree:
    """64-bit values in the order of insertion; every node's children have distinct distances to it. A subtree of few values, or of equal ones,
    is a leaf, whose values are compared at once."""

    def __init__(self, values: np.ndarray):
        self.values = values
        #: Of each node, its values (one, but for leaves), and its children with their distances.
        self.nodes: list[tuple[np.ndarray, list[tuple[int, int]]]] = []
        todo = [(np.arange(len(values)), 64, None)] if len(values) else []
        while todo:
            own, edge, siblings = todo.pop()
            if siblings is not None:
                siblings.append((edge, len(self.nodes)))
            if len(own) <= LEAF or not edge:
                self.nodes.append((own, []))
                continue
            self.nodes.append((own[:1], kids := []))
            d = np.bitwise_count(values[own[1:]] ^ values[own[0]])
            order = np.argsort(d, kind="stable")
            cut = np.flatnonzero(np.diff(d[order])) + 1
            todo += [(x, int(y[0]), kids) for x, y in zip(np.split(own[1:][order], cut), np.split(d[order], cut))]

    def pairs(self, radius: int, asks: np.ndarray | None = None, step: int = 1 << 18) -> Pairs:
        """(node, query, distance) of all pairs within the radius whose node was inserted before the query; `asks` says who is a query."""
        n = len(self.values)
        todo = [(0, np.arange(1, n) if asks is None else np.flatnonzero(asks[1:]) + 1)] if n else []
        while todo:
            at, query = todo.pop()
            own, kids = self.nodes[at]
            query = query[query > own[0]]
            if not len(query):
                continue
            if kids:
                d = np.bitwise_count(self.values[query] ^ self.values[own[0]])
                if (hit := d <= radius).any():
                    yield np.repeat(own, np.count_nonzero(hit)), query[hit], d[hit].astype(np.int64)
                todo += [(kid, query[(d >= edge - radius) & (d <= edge + radius)]) for edge, kid in kids]
                continue
            many = max(1, step // len(query))
            for x in range(0, len(own), many):
                node = own[x : x + many]
                for y in range(0, len(query), step):
                    some = query[y : y + step]
                    d = np.bitwise_count(self.values[node][:, None] ^ self.values[some])
                    i, j = np.divmod(np.flatnonzero(d <= radius), len(some))
                    before = node[i] < some[j]
                    i, j = i[before], j[before]
                    if len(i):
                        yield node[i], some[j], d[i, j].astype(np.int64)


def gathered(pairs: Pairs, least: int = 1 << 16) -> Pairs:
    """The pairs in fewer and longer arrays."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0
    for x in pairs:
        held.append(x)
        n += len(x[0])
        if n >= least:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def forest(pairs: Pairs, n: int, alike=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that span the groups of those given, or of those of them that may be `alike`."""
    root, left, right = np.arange(n), [], []
    for a, b, _ in pairs:
        if alike:
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            good = alike(a, b)
            a, b = a[good], b[good]
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            high, first = np.unique(np.maximum(ra, rb), return_index=True)
            left.append(a[first])
            right.append(b[first])
            link = np.arange(n)
            link[high] = np.minimum(ra, rb)[first]
            while not np.array_equal(link[link], link):
                link = link[link]
            root = link[root]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def masks(n: int) -> list[int]:
    """Masks of fingerprint bits by which n fingerprints are sharded."""
    k = max(0, math.ceil(math.log2(max(n, 1) / SHARD)))
    if not k:
        return [0]
    together = math.comb(64 - RECALL_AT, k) / math.comb(64, k)  # the bits of a mask are distinct
    rng = np.random.default_rng(20_240_229)
    bits = [np.sort(rng.permutation(64)[:k]) for _ in range(math.ceil(math.log(1 - RECALL) / math.log(1 - together)))]
    return [sum(1 << int(b) for b in row) for row in bits]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _side(df: DataFrame) -> DataFrame:
    """df broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _routed(fps: DataFrame, n: int) -> DataFrame:
    """The rows of every shard: t and key (which shard) and fps' own columns; where there are hot shards, also split and asks (which of a
    shard's tasks, and whose query)."""
    parts = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks(n))]

    def sharded(rows: DataFrame) -> DataFrame:
        return rows.withColumn("r", F.explode(F.array(*parts))).select("r.t", "r.key", *rows.columns)

    if n <= HOT:
        return sharded(fps)
    size = F.count("*") * SAMPLED
    some = sharded(fps.select("fp").filter(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(SAMPLED)) == 0))
    hot = written(some.groupBy("t", "key").agg(size.alias("size")).filter(F.col("size") > HOT).select("t", "key", F.ceil(F.col("size") / HOT).cast("int").alias("tasks")))
    if not hot.limit(1).count():
        return sharded(fps)
    each = sharded(fps).join(_side(hot), ["t", "key"], "left").withColumn("tasks", F.coalesce("tasks", F.lit(1)))
    each = each.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    return each.withColumn("asks", F.pmod(F.xxhash64("fp"), F.col("tasks")) == F.col("split")).drop("tasks")


def _shards(fps: DataFrame, n: int, radius: int, similarity: float, crossing: bool) -> DataFrame:
    """a, b: nodes whose fingerprints some shard found within the radius and whose summaries don't rule the similarity out; only a spanning
    forest, or, given labels, all with different ones."""
    routed = _routed(fps, n)
    by = [c for c in ("t", "key", "split") if c in routed.columns]
    routed = routed.repartition(*by).sortWithinPartitions(*by, "fp")

    def search(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        fp = rows.column("fp").to_numpy().view(np.uint64)
        node = rows.column("node").to_numpy()
        asks = rows.column("asks").to_numpy() if len(by) > 2 else None
        label = rows.column("label").to_numpy() if crossing else None
        bits = utf8(rows.column("bits"))[0].view(np.uint64).reshape(len(fp), -1)

        def alike(a: np.ndarray, b: np.ndarray, step: int = 1 << 16) -> np.ndarray:
            return np.concatenate([bounds(bits[a[i : i + step]], bits[b[i : i + step]]) >= similarity for i in range(0, max(len(a), 1), step)])

        pairs = gathered(BkTree(fp).pairs(radius, asks))
        if crossing:
            got = []
            for a, b, _ in pairs:
                x = np.flatnonzero(label[a] != label[b])
                x = x[alike(a[x], b[x])]
                got.append((a[x], b[x]))
            a, b = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
        else:
            a, b = forest(pairs, len(fp), alike)
        return np.minimum(node[a], node[b]), np.maximum(node[a], node[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out(t: pa.Table) -> pa.RecordBatch:
            a, b = search(t)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            at = [table.column(c).to_numpy() for c in by]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1
            edges = [0, *cut.tolist(), len(at[0])]
            if held and [held[-1].column(c)[-1].as_py() for c in by] != [x[0] for x in at]:
                yield out(pa.concat_tables(held))
                held = []
            for x, y in zip(edges[:-1], edges[1:]):
                if x and held:
                    yield out(pa.concat_tables(held))
                    held = []
                held.append(table.slice(x, y - x))
        if held:
            yield out(pa.concat_tables(held))

    return routed.mapInArrow(run, "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """a, b, good of the pairs."""
    both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = similarities(batch.column(2).to_pylist(), batch.column(3).to_pylist()) >= similarity
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good)], names=["a", "b", "good"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, good boolean")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that edges (a, b) connect it with, by hooking and pointer jumping."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label"))
    labels = checkpointed(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), "label")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jumped"))
        done = checkpointed(hooked.join(jump, "next", "left").select("node", F.least("next", "jumped").alias("label"), F.col("label").alias("old")))
        changed = done.filter("label <> old").limit(1).count()
        labels = done.select("node", "label")
        if not changed:
            return labels


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, group_id (the group's least doc_id), keep and fingerprint, for every row.

    Just one row of a group has keep: the one with the least doc_id; of rows that repeat whole, one. A null text belongs to no group and is
    kept. Empty texts are copies of each other. A null id comes after all others. Other columns are left out.
    """
    return _grouped(docs, id_col, text_col, radius, similarity).select("doc_id", "group_id", "keep", "fingerprint")


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """What groups() gives, and node, a hash of the text."""
    ship(docs.sparkSession)
    base = columns(docs, id_col, text_col).toDF("doc_id", "text").selectExpr("cast(doc_id as bigint) doc_id", "xxhash64(cast(text as string)) node", "cast(text as string) text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(2)):
                fp, sketch = signatures(batch.column(2).slice(at, n))
                bits = pa.array([x.tobytes() for x in summaries(sketch)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(fp.view(np.int64)), pa.array(sketch, pa.binary()), bits], names=["doc_id", "text", "fp", "sketch", "bits"])

    sig = base.filter("text is not null").mapInArrow(sign, "doc_id bigint, text bigint, fp bigint, sketch binary, bits binary")
    # Texts with the same fingerprint and sketch are one node: no pair tells them apart.
    sig = written(sig.withColumn("node", F.xxhash64("fp", "sketch")))
    fps = written(sig.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bits").alias("bits")))
    n = fps.count()

    def sketched(pairs: DataFrame) -> DataFrame:
        need = written(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"))
        return _verified(pairs, sig.select("node", "sketch").join(_side(need), "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch")), similarity)

    tested = written(sketched(written(_shards(fps, n, radius, similarity, False))))
    good = tested.filter("good").select("a", "b")
    labels = components(good)
    bad = tested.filter("not good")
    if bad.limit(1).count():
        # A pair that was left out lies on a path that a shard found. If it would join two groups, the path has a refuted pair, and going along
        # it from either end one comes, within the end's group, to a node of such a pair.
        labelled = fps.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        ends = bad.select("a").union(bad.select("b")).distinct().withColumnRenamed("a", "node")
        torn = ends.join(labels, "node", "left").select(F.coalesce("label", "node").alias("label")).distinct()
        more = _shards(written(labelled.join(torn, "label", "left_semi").select("fp", "node", "bits", "label")), n, radius, similarity, True)
        again = written(sketched(written(more.join(tested.select("a", "b"), ["a", "b"], "left_anti"))))
        if again.filter("good").limit(1).count():
            labels = components(good.union(again.filter("good").select("a", "b")))
    rows = sig.select("doc_id", F.col("text").alias("own"), "node", "fp").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = rows.select("doc_id", F.col("own").alias("node"), "fp", "label")
    w = Window.partitionBy("label")
    rows = rows.select("doc_id", "node", "fp", F.min("doc_id").over(w).alias("group_id"), (F.row_number().over(w.orderBy(F.col("doc_id").asc_nulls_last(), "node")) == 1).alias("keep"))
    null = base.filter("text is null").select("doc_id", F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), "doc_id", F.lit(True))
    return rows.union(null).toDF("doc_id", "node", "fingerprint", "group_id", "keep")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group; groups() says which. All columns stay as they are."""
    node, mine = fresh(docs, "node"), fresh(docs, "doc")
    found = written(_grouped(docs, id_col, text_col))
    # Rows alike in id and text count as one here; what is dropped is usually the smaller side.
    per = found.filter("node is not null").groupBy("doc_id", "node").agg(F.max("keep").alias("keep"), F.count("*").alias("n"))
    drop = written(per.filter("not keep").select(F.col("doc_id").alias(mine), F.col("node").alias(node)))
    repeated = written(per.filter("keep and n > 1").select(F.col("doc_id").alias(mine), F.col("node").alias(node)))
    keyed = docs.withColumn(node, F.xxhash64(docs[f"`{text_col}`"].cast("string"))).withColumn(mine, docs[f"`{id_col}`"].cast("bigint"))

    def on(df: DataFrame):
        return keyed[mine].eqNullSafe(df[mine]) & (keyed[node] == df[node]) & keyed[f"`{text_col}`"].isNotNull()

    kept = keyed.join(d := _side(drop), on(d), "left_anti")
    if repeated.limit(1).count():
        twice = _side(repeated)
        match = kept[mine].eqNullSafe(twice[mine]) & (kept[node] == twice[node]) & kept[f"`{text_col}`"].isNotNull()
        kept = kept.join(twice, match, "left_anti").union(kept.join(twice, match, "left_semi").dropDuplicates([mine, node]))
    return kept.drop(node, mine)
