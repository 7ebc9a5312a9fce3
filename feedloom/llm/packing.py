"""Pattern packing of documents into training sequences by non-negative least squares.

Documents are spread over shards by a hash of their ids; each shard is packed by itself. Token lengths are rounded up to BINS steps of the
sequence. Patterns are the combinations of a few lengths that fill a sequence. Repeat counts, fitted to the shard's length histogram by
non-negative least squares and rounded down, use up most documents; the residual ones are packed best-fit, longest first, into what room
is left anywhere. A document longer than a sequence is cut into whole sequences and a rest, so no token is dropped.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import RANKS, count_tokens
from .common import columns, ship, written

CAPACITY = 2048
#: Steps of length in a sequence, and most documents in a pattern.
BINS, DEPTH = 32, 4
#: Documents that a shard has on average.
SHARD_DOCS = 20_000


@lru_cache(4)
def patterns(bins: int = BINS, depth: int = DEPTH) -> np.ndarray:
    """Every combination of at most `depth` lengths that add up to `bins`, as counts by length: one row each."""
    found: list[list[int]] = []

    def extend(part: list[int], left: int, least: int) -> None:
        if not left:
            found.append(part)
        elif len(part) < depth:
            for size in range(least, left + 1):
                if size == left or left - size >= size:
                    extend([*part, size], left - size, size)

    extend([], bins, 1)
    out = np.zeros((len(found), bins))
    for row, part in zip(out, found):
        for size in part:
            row[size - 1] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 with the least |ax - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    w = a.T @ (b - a @ x)
    for _ in range(3 * n):
        free = np.where(active, -np.inf, w)
        if active.all() or free.max() <= tolerance * max(1.0, np.abs(b).max()):
            break
        active[free.argmax()] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s[active].min() > 0:
                break
            low = active & (s <= 0)
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
        x = s if active.any() else x
        w = a.T @ (b - a @ x)
    return x


def fill(lengths: np.ndarray, capacity: int = CAPACITY, bins: int = BINS, depth: int = DEPTH) -> np.ndarray:
    """The sequence that each piece goes to; pieces have 1 to `capacity` tokens."""
    n = len(lengths)
    sequence = np.full(n, -1, np.int64)
    if not n:
        return sequence
    step = capacity / bins
    bin_of = np.minimum(np.ceil(lengths / step).astype(np.int64), bins) - 1
    order = np.lexsort((np.arange(n), -lengths, bin_of))
    by_bin = [order[a:b] for a, b in zip(np.searchsorted(bin_of[order], np.arange(bins)), np.searchsorted(bin_of[order], np.arange(bins), side="right"))]
    shapes = patterns(bins, depth)
    histogram = np.bincount(bin_of, minlength=bins).astype(float)
    used, room, made = np.zeros(bins, np.int64), [], 0
    for p, wanted in sorted(enumerate(np.floor(nnls(shapes.T, histogram) + 1e-6)), key=lambda x: -x[1]):
        need = shapes[p].astype(np.int64)
        have = np.array([len(x) for x in by_bin]) - used
        times = int(min([wanted, *(have[k] // need[k] for k in np.flatnonzero(need))]))
        if times <= 0:
            continue
        taken = np.zeros(times, np.int64)
        for k in np.flatnonzero(need):
            pieces = by_bin[k][used[k] : used[k] + times * need[k]].reshape(times, need[k])
            used[k] += times * need[k]
            sequence[pieces] = made + np.arange(times)[:, None]
            taken += lengths[pieces].sum(1)
        room += (capacity - taken).tolist()
        made += times
    rest = np.concatenate([x[u:] for x, u in zip(by_bin, used)])
    open_ = sorted((r, s) for s, r in enumerate(room) if r > 0)
    for i in rest[np.lexsort((rest, -lengths[rest]))].tolist():
        size = int(lengths[i])
        at = bisect.bisect_left(open_, (size, -1))
        if at < len(open_):
            left, s = open_.pop(at)
        else:
            left, s = capacity, made
            made += 1
        sequence[i] = s
        if left > size:
            bisect.insort(open_, (left - size, s))
    return sequence


PACKED = "shard int, sequence bigint, n_tokens bigint, doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>"


def pack_lengths(docs: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row a sequence: its tokens in all, and for each of its pieces the document, the piece's first token in it, and its length.

    Documents with a null length or one below 1 have no tokens and come in no sequence. Rows that repeat are packed each; a null id is
    packed as null. No sequence exceeds the capacity, and every token of every document is in just one. Other columns are left out.
    """
    ship(docs.sparkSession)
    base = columns(docs, id_col, length_col).toDF("doc_id", "n").selectExpr("cast(doc_id as bigint) doc_id", "cast(n as bigint) n").filter("n > 0")
    # The row's number, which is written with it, spreads rows that repeat and those without an id like any others.
    rows = written(base.withColumn("row", F.monotonically_increasing_id()))
    shards = max(1, math.ceil(rows.count() / shard_docs))
    # The id and the length alone cross the network, spread by hash, so neither a hot source nor a long document makes a hot shard.
    spread = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "row"), F.lit(shards)).cast("int")).drop("row")

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids = table.column("doc_id").to_pandas(integer_object_nulls=True).to_numpy()
        n = table.column("n").to_numpy()
        order = np.lexsort((n, np.array([-1 if i is None else i for i in ids], np.int64)))
        n, ids = n[order], ids[order]
        pieces = -(-n // capacity)
        doc = np.repeat(np.arange(len(n)), pieces)
        start = capacity * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        length = np.minimum(capacity, n[doc] - start)
        whole = length == capacity
        sequence = np.zeros(len(doc), np.int64)
        sequence[whole] = np.arange(whole.sum())
        sequence[~whole] = whole.sum() + fill(length[~whole], capacity)
        by = np.argsort(sequence, kind="stable")
        cut = np.searchsorted(sequence[by], np.arange(sequence.max() + 2)) if len(by) else np.zeros(1, np.int64)
        off = pa.array(cut.astype(np.int32))
        total = np.add.reduceat(length[by], cut[:-1]) if len(by) else np.zeros(0, np.int64)
        return pa.table(
            [pa.array(np.full(len(cut) - 1, shard, np.int32)), pa.array(np.arange(len(cut) - 1)), pa.array(total)] + [pa.ListArray.from_arrays(off, x) for x in (pa.array(list(ids[doc[by]]), pa.int64()), pa.array(start[by]), pa.array(length[by]))],
            names=["shard", "sequence", "n_tokens", "doc_ids", "starts", "lengths"],
        )

    return spread.groupBy("shard").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = RANKS, capacity: int = CAPACITY) -> DataFrame:
    """pack_lengths() over the texts' numbers of tokens. A null or empty text has none."""
    base = columns(docs, id_col, text_col).toDF("doc_id", "text").selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return pack_lengths(count_tokens(base, "text", "n_tokens", tokenizer), capacity=capacity)
