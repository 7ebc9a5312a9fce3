"""Simple-8b word-aligned coding of token ids.

The top four bits of a 64-bit word select how many ids, of how many bits each, the other sixty hold. Ids are coded in blocks of BLOCK, and
each block's first word is listed, so that any block decodes alone. Selector 0 is the escape: the following word is one raw 64-bit
value, or, where the escape's low bit is set, the id is null and no word follows. Both directions work on all blocks at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import RANKS, codec, ship_vocabulary
from .common import columns, list_array, ranges, ship, slices

BLOCK = 256
#: Ids in a word, by selector.
FITS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)


def _blocks(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lists' blocks, and how many blocks each list has."""
    per = -(-np.diff(off) // BLOCK)
    starts = np.repeat(off[:-1], per) + BLOCK * ranges(np.zeros(len(per), np.int64), per)
    return starts, np.minimum(starts + BLOCK, np.repeat(off[1:], per)), per


def pack(ids: np.ndarray, off: np.ndarray, null: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all lists, the lists' n + 1 offsets in them, each block's first word within its list, and the n + 1 offsets in those."""
    v = ids.astype(np.int64).view(np.uint64)
    n = len(v)
    starts, ends, per = _blocks(off)
    escape = v >= np.uint64(1 << 60)
    if null is not None:
        v = np.where(null, np.uint64(0), v)
        escape |= null
    else:
        null = np.zeros(n, bool)
    position = np.arange(n, dtype=np.int32)
    block_end = np.repeat(ends, ends - starts).astype(np.int32)
    pick = np.zeros(n, np.uint8)
    for s in range(1, 16):
        too_wide = escape | (v >= np.uint64(1 << int(BITS[s])))
        reach = np.where(too_wide, position, np.int32(n))
        reach = np.minimum.accumulate(reach[::-1])[::-1]
        fits = (pick == 0) & (reach >= np.minimum(position + np.int32(FITS[s]), block_end)) & ~too_wide
        pick[fits] = s
    count = np.minimum(FITS[pick], block_end - position)
    at, seen = starts.copy(), []
    while len(at):
        seen.append(at)
        at = at + count[at]
        inside = at < ends
        at, ends = at[inside], ends[inside]
    first = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
    sel = pick[first]
    size = np.where((sel == 0) & ~null[first], 2, 1)
    place = np.concatenate([[0], np.cumsum(size)])
    words = np.zeros(int(place[-1]), np.uint64)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        begin = first[rows]
        if s == 0:
            words[place[rows]] = null[begin].astype(np.uint64)
            raw = ~null[begin]
            words[place[rows[raw]] + 1] = v[begin[raw]]
            continue
        word = np.full(len(rows), int(s) << 60, np.uint64)
        if BITS[s]:
            have = count[begin]
            for k in range(int(FITS[s])):
                ok = have > k
                word[ok] |= v[begin[ok] + k] << np.uint64(k * int(BITS[s]))
        words[place[rows]] = word
    word_of = place[np.searchsorted(first, off)]
    block_off = np.concatenate([[0], np.cumsum(per)])
    block_word = place[np.searchsorted(first, starts)] - np.repeat(word_of[:-1], per)
    return words, word_of, block_word, block_off


def unpack(words: np.ndarray, counts: np.ndarray, block_word: np.ndarray, block_off: np.ndarray, word_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists end to end, and which are null; `counts` are the lists' lengths."""
    off = np.concatenate([[0], np.cumsum(counts)])
    starts, ends, per = _blocks(off)
    out, null = np.zeros(int(off[-1]), np.uint64), np.zeros(int(off[-1]), bool)
    if not len(words):
        return out.view(np.int64), null
    sel = (words >> np.uint64(60)).astype(np.int64)
    # What looks like an escape with a value behind it is one unless it is itself such a value: in a run of these, every other one.
    like = (sel == 0) & (words & np.uint64(1) == 0)
    at = np.arange(len(words))
    begins = like.copy()
    begins[1:] &= ~like[:-1]
    raw = np.zeros(len(words), bool)
    raw[1:] = (like & ((at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0))[:-1]
    head = np.flatnonzero(~raw)
    first_word = block_word + np.repeat(word_off[:-1], per)
    block = np.searchsorted(first_word, head, side="right") - 1
    n = FITS[sel[head]]
    upto = np.cumsum(n) - n
    first_head = np.searchsorted(head, first_word)
    pos = starts[block] + upto - upto[first_head][block]
    n = np.minimum(n, ends[block] - pos)
    for s in np.unique(sel[head]):
        rows = np.flatnonzero(sel[head] == s)
        w, p, k = head[rows], pos[rows], n[rows]
        if s == 0:
            gone = (words[w] & np.uint64(1)).astype(bool)
            null[p[gone]] = True
            out[p[~gone]] = words[w[~gone] + 1]
        elif BITS[s]:
            low = np.uint64((1 << int(BITS[s])) - 1)
            for j in range(int(FITS[s])):
                ok = k > j
                out[p[ok] + j] = (words[w[ok]] >> np.uint64(j * int(BITS[s]))) & low
    return out.view(np.int64), null


PACKED = "doc_id bigint, n_ids bigint, words binary, block_at array<int>"


def _batch(key: pa.Array, ids: np.ndarray, off: np.ndarray, gone: np.ndarray, null: np.ndarray | None = None) -> pa.RecordBatch:
    words, word_off, block_word, block_off = pack(ids, off, null)
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(word_off.astype(np.int64) * 8), pa.py_buffer(words.astype("<u8"))]).cast(pa.binary())
    if gone.any():
        raw = pa.compute.if_else(pa.array(gone), pa.scalar(None, pa.binary()), raw)
    return pa.RecordBatch.from_arrays([key, pa.array(np.diff(off), pa.int64(), mask=gone), raw, list_array(block_word, block_off, pa.int32(), gone)], names=["doc_id", "n_ids", "words", "block_at"])


def pack_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Each list of ids as little-endian words, with its length and the first word of each block of BLOCK ids.

    A null list gives nulls, an empty one no words; a null id within a list survives as an escape. Negative ids and those of more than 60
    bits take two words. Rows that repeat are coded alike; other columns are left out.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            gone = lists.is_null().to_numpy(zero_copy_only=False)
            counts = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            yield _batch(batch.column(0), flat.fill_null(0).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)]), gone, flat.is_null().to_numpy(zero_copy_only=False))

    return columns(df, id_col, ids_col).selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{ids_col}` as array<bigint>) ids").mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = RANKS) -> DataFrame:
    """Each text's token ids, coded as pack_ids() does, without the ids themselves ever leaving the worker. A null text gives nulls."""
    ship_vocabulary(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            for at, n in slices(batch.column(1)):
                text = batch.column(1).slice(at, n)
                ids, off, _ = c.encode_exact(text)
                yield _batch(batch.column(0).slice(at, n), ids, off, text.is_null().to_numpy(zero_copy_only=False))

    return columns(docs, id_col, text_col).selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, PACKED)


def unpack_ids(packed: DataFrame) -> DataFrame:
    """doc_id and ids of what pack_ids() or pack_documents() gave."""
    ship(packed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            counts = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = b"".join(x or b"" for x in batch.column(2).to_pylist())
            size = np.array([len(x or b"") // 8 for x in batch.column(2).to_pylist()], np.int64)
            blocks = pa.compute.list_value_length(batch.column(3)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, null = unpack(np.frombuffer(raw, "<u8"), counts, batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(blocks)]), np.concatenate([[0], np.cumsum(size)]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(gone, False)), pa.array(ids, pa.int64(), mask=null))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return columns(packed, "doc_id", "n_ids", "words", "block_at").mapInArrow(run, "doc_id bigint, ids array<bigint>")
