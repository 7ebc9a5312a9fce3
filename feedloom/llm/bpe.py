"""Byte-level BPE encoding and decoding.

A batch's texts are laid end to end and cut into the vocabulary's pre-tokens by array operations. Each distinct pre-token goes through
the tokenizers library once and is then looked up, since pre-tokens are encoded independently. Token ends in bytes follow from the byte
table; a byte-to-character map turns them into character offsets.
"""

from __future__ import annotations

import base64
import itertools
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import Chars, columns, list_array, ranges, run_hashes, ship, slices, utf8

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The same vocabulary as ranks; counts and packed ids come from it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens that a worker remembers; beyond it, the memory starts anew, which costs time but changes no result.
REMEMBERED = 1_200_000

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_SENT: set[tuple[str, str]] = set()


@lru_cache(1)
def _class_table() -> np.ndarray:
    import unicodedata

    kinds = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            kinds[c] = _LETTER if k == "L" else _NUMBER
    for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        kinds[a : b + 1] = _SPACE
    return kinds


def pretokens(chars: Chars) -> np.ndarray:
    """Starts of the pre-tokens: a run of letters, of digits or of other signs, with one space before it; apostrophe endings; and runs of
    white space but for what the next run takes. No pre-token crosses a document's end."""
    cp = chars.cp
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = _class_table()[cp]
    edge = np.ones(n, bool)
    edge[1:] = kind[1:] != kind[:-1]
    first = np.zeros(n + 1, bool)
    first[chars.doc_starts] = True
    first[n] = True
    edge |= first[:n]
    rs = np.flatnonzero(edge)
    re_ = np.append(rs[1:], n)
    rk = kind[rs]
    last_in_doc = first[re_]
    mark = edge.copy()
    space = (rk == _SPACE) & ~last_in_doc
    ends = re_[space]
    taken = cp[ends - 1] == 32
    mark[ends[taken]] = False  # the next run starts at the space
    mark[ends - 1] = True
    quote = np.flatnonzero((rk == _OTHER) & (re_ - rs == 1) & (cp[rs] == 39) & mark[rs] & ~last_in_doc)
    quote = quote[rk[quote + 1] == _LETTER] if len(quote) else quote
    if len(quote):
        s, e = rs[quote + 1], re_[quote + 1]
        a, b = cp[s], np.where(e - s > 1, cp[np.minimum(s + 1, n - 1)], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(one, 1, np.where(two, 2, 0))
        hit = size > 0
        s, e, size = s[hit], e[hit], size[hit]
        mark[s] = False
        more = s + size < e
        mark[(s + size)[more]] = True
    return np.flatnonzero(mark)


def _of_json(path: str) -> tuple:
    """Bytes of each id; ids and counts of pre-tokens; ids of whole texts: of a file of the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = json.loads(Path(path).read_text())
    full = Tokenizer.from_str(json.dumps(own))
    own["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    piece = Tokenizer.from_str(json.dumps(own))
    full.encode_special_tokens = piece.encode_special_tokens = True
    vocab = full.get_vocab(with_added_tokens=True)
    special = {t.content for t in full.get_added_tokens_decoder().values()}
    byte_of = {c: b for b, c in byte_chars().items()}
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = token.encode() if token in special else bytes(byte_of[c] for c in token)

    def kinds(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        enc = piece.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.array(enc.ids, np.int32), np.bincount(np.array(enc.word_ids, np.int64), minlength=len(pieces))

    return table, kinds, lambda texts: [e.ids for e in full.encode_batch(texts, add_special_tokens=False)]


def _of_ranks(path: str) -> tuple:
    """The same of a file of ranks."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    one = enc.encode_ordinary

    def kinds(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [one(p) for p in pieces]
        return np.array(list(itertools.chain.from_iterable(lists)), np.int32), np.array([len(x) for x in lists], np.int64)

    return table, kinds, lambda texts: [one(t) for t in texts]


class Codec:
    """A byte-level vocabulary, with the pre-tokens met so far."""

    def __init__(self, path: str):
        table, self.kinds_of, self.whole = _of_ranks(path) if path.endswith(".tiktoken") else _of_json(path)
        self.tok_len = np.array([len(t) for t in table], np.int64)
        self.tok_off = np.concatenate([[0], np.cumsum(self.tok_len)])
        self.tok_bytes = np.frombuffer(b"".join(table), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros((0, 2), np.int32)
        self.pool = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids, counts = self.kinds_of(pieces)
        starts = len(self.pool) + np.cumsum(counts) - counts
        self.pool = np.concatenate([self.pool, ids])
        order = np.argsort(keys)
        where = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, where, keys[order])
        self.at = np.insert(self.at, where, np.stack([starts, counts], 1)[order], axis=0)

    def _find(self, chars: Chars) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the pre-tokens; for each, the index of its kind; for each kind, its ids' start in the pool and their count."""
        starts = pretokens(chars)
        ends = np.append(starts[1:], len(chars.cp))[: len(starts)]
        code, kinds = pd.factorize(run_hashes(chars.cp, starts, ends))

        def look() -> tuple[np.ndarray, np.ndarray]:
            where = np.minimum(np.searchsorted(self.keys, kinds), max(len(self.keys) - 1, 0))
            return where, self.keys[where] != kinds if len(self.keys) else np.ones(len(kinds), bool)

        where, missing = look()
        if missing.any():
            if len(self.keys) + missing.sum() > REMEMBERED:
                self._forget()
                missing[:] = True
            firsts = np.full(len(kinds), len(code), np.int64)
            firsts[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            need = firsts[missing]
            text = chars.text
            self._learn(kinds[missing], [text[a:b] for a, b in zip(starts[need].tolist(), ends[need].tolist())])
            where, _ = look()
        at = self.at[where] if len(kinds) else np.zeros((0, 2), np.int64)
        return starts, code, at[:, 0], at[:, 1]

    def count(self, arr: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        chars = Chars(arr)
        starts, code, _, counts = self._find(chars)
        total = np.concatenate([[0], np.cumsum(counts[code])])
        cut = total[np.searchsorted(starts, chars.off)]
        return cut[1:] - cut[:-1]

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, Chars]:
        """Ids of all texts end to end, and the n + 1 offsets of the texts in them."""
        chars = Chars(arr)
        starts, code, first, counts = self._find(chars)
        per = counts[code]
        ids = self.pool[ranges(first[code], per)]
        total = np.concatenate([[0], np.cumsum(per)])
        return ids, total[np.searchsorted(starts, chars.off)], chars

    def encode_exact(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, Chars]:
        """encode(), held against the bytes; if two pre-tokens ever shared a hash, the texts go through the library whole."""
        ids, off, chars = self.encode(arr)
        back = self.decode_bytes(ids)
        if len(back) != len(chars.raw) or not np.array_equal(back, chars.raw):
            texts = [chars.text[a:b] for a, b in zip(chars.off[:-1], chars.off[1:])]
            lists = self.whole(texts)
            ids = np.array([i for x in lists for i in x], np.int32)
            off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return ids, off, chars

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.tok_bytes[ranges(self.tok_off[ids], self.tok_len[ids])]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """The texts of runs of ids. Where a run starts or ends within a character, its stray bytes become U+FFFD."""
        raw = self.decode_bytes(ids)
        ends = np.concatenate([[0], np.cumsum(self.tok_len[ids])])[off]
        whole = raw.tobytes()
        try:
            whole.decode()
            inside = ends[(ends > 0) & (ends < len(raw))]
            if not ((raw[inside] & 0xC0) == 0x80).any():
                return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(whole)).cast(pa.string())
        except UnicodeDecodeError:
            pass
        return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())

    def offsets(self, ids: np.ndarray, off: np.ndarray, chars: Chars) -> tuple[np.ndarray, np.ndarray]:
        """Each token's first character and the one after its last, within its text; a token that holds part of a character spans it all."""
        end = np.cumsum(self.tok_len[ids])
        start = end - self.tok_len[ids]
        base = np.repeat(chars.off[:-1], np.diff(off))
        if len(chars.text) == len(chars.raw):
            return (start - base).astype(np.int32), (end - base).astype(np.int32)
        char_of = np.cumsum((chars.raw & 0xC0) != 0x80) - 1
        return (char_of[start] - base).astype(np.int32), (char_of[end - 1] + 1 - base).astype(np.int32)


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in shown):
        shown[b] = chr(256 + k)
    return shown


@lru_cache(4)
def codec(path: str = TOKENIZER) -> Codec:
    """This worker's codec, of the file that the driver sent if this machine hasn't the path."""
    return Codec(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def ship_vocabulary(spark: SparkSession, path: str) -> None:
    """Send this package, and outside local mode the vocabulary's file, to the executors."""
    ship(spark)
    app = (spark.sparkContext.applicationId, path)
    if app not in _SENT and os.path.exists(path) and not re.match(r"local(\[|$)", spark.sparkContext.master):
        spark.sparkContext.addFile(path)
    _SENT.add(app)


ENCODED = "doc_id bigint, n_tokens bigint, ids array<int>, starts array<int>, ends array<int>, decoded string"


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a document: its token ids, each token's character span, and the text decoded from the ids again.

    A null text gives nulls; an empty one no ids. Rows that repeat, or whose id is null, are encoded like others. Special tokens' strings
    are ordinary text. Other columns are left out.
    """
    ship_vocabulary(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            for at, n in slices(batch.column(1)):
                text = batch.column(1).slice(at, n)
                ids, off, chars = c.encode_exact(text)
                starts, ends = c.offsets(ids, off, chars)
                null = text.is_null().to_numpy(zero_copy_only=False)
                back = c.decode(ids, off)
                if null.any():
                    back = pa.compute.if_else(pa.array(null), pa.scalar(None, pa.string()), back)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(np.diff(off), pa.int64(), mask=null), *(list_array(x, off, pa.int32(), null) for x in (ids, starts, ends)), back],
                    names=["doc_id", "n_tokens", "ids", "starts", "ends", "decoded"],
                )

    return columns(docs, id_col, text_col).selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, ENCODED)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and text of each list of ids. A null list gives a null text; ids in which a character is split give U+FFFD for its stray bytes."""
    ship_vocabulary(encoded.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            lists = batch.column(1)
            null = lists.is_null().to_numpy(zero_copy_only=False)
            counts = np.where(null, 0, pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            off = np.concatenate([[0], np.cumsum(counts)])
            text = c.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.compute.if_else(pa.array(null), pa.scalar(None, pa.string()), text)], names=["doc_id", "text"])

    return columns(encoded, id_col, ids_col).selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{ids_col}` as array<int>) ids").mapInArrow(run, "doc_id bigint, text string")


def count_tokens(docs: DataFrame, text_col: str, out: str, tokenizer: str = RANKS, keep_text: bool = False) -> DataFrame:
    """docs with a column `out` of token counts, without the text column unless it is kept. A null text has a null count."""
    ship_vocabulary(docs.sparkSession, tokenizer)
    src = docs.schema
    at_text = docs.columns.index(text_col)
    names = [f.name for f in src if keep_text or f.name != text_col] + [out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            text = batch.column(at_text)
            got = [c.count(text.slice(at, n)) for at, n in slices(text)]
            counts = pa.array(np.concatenate(got) if got else np.zeros(0, np.int64), pa.int64(), mask=text.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([col for k, col in enumerate(batch.columns) if keep_text or k != at_text] + [counts], names=names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in src if keep_text or f.name != text_col]
    return docs.mapInArrow(run, ", ".join([*kinds, f"`{out}` bigint"]))
