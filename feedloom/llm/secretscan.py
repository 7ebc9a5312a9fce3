"""Secrets: strings too random to be text.

A candidate is a run of MIN_LENGTH or more characters that keys are written in, cut at '=' but for padding at its end. It is tested whole
and in the stretches between its separators, as keys are glued to names, paths and words, and is a secret if any of these strings passes.
From a string's characters follows an encoding, and it is tested for randomness in that alphabet: chi-squared for uniformity (too uneven
or too even), runs about the alphabet's middle, and serial correlation; Fisher's method combines the three. A string that the battery calls
random is held against ordinary text: a Chernoff bound on the chance that so many characters, drawn at the rates of all documents'
characters, are as improbable as these. That bound falls with length, and the Benjamini-Hochberg procedure is run over the distinct strings
of each length class, so short strings, which chance produces more easily, don't pass on the strength of long ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chars, columns, fresh, ship, slices, utf8, written

MIN_LENGTH = 16
#: Expected share of false discoveries in each length class; and the randomness that the battery must not refute.
FDR, MIN_RANDOM = 0.01, 1e-4
CLASSES = (16, 24, 32, 48)
STEPS = 100  # of p-values, a power of ten
MAX_POWER = 400
MASK = "[SECRET]"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: From the smallest alphabet up; a string's encoding is the first that holds all its characters.
ENCODINGS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "UPPER": _UPPER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "letters": _UPPER + _LOWER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "mixed": _UPPER + _LOWER + _DIGITS + "+/_-",
}
#: Encodings of plain numbers and words, from which keys in them aren't told: these are never secrets.
PLAIN = {"decimal", "lower", "UPPER"}


@lru_cache(1)
def _alphabets() -> list[tuple[str, frozenset, dict]]:
    return [(k, frozenset(v), {c: i for i, c in enumerate(v)}) for k, v in ENCODINGS.items()]


def core(s: str) -> str:
    """What of a candidate is tested first: without padding, and only the longest stretch between dashes and underscores if that is long enough."""
    bare = s.strip("=-_")
    longest = max(bare.replace("_", "-").split("-"), key=len)
    return longest if len(longest) >= MIN_LENGTH else bare


#: The separators between which a candidate's stretches are tested; base64 has '/' in it and base64url the other two, so each is also let be.
SEPARATORS = [re.compile(x) for x in ("[-_]", "/", "[-_/]")]


def tested(s: str) -> list[str]:
    """The distinct strings of MIN_LENGTH or more that a candidate is tested by: its core, the whole, and the stretches between separators."""
    bare = s.strip("=-_")
    found = [core(s), bare, *(x.strip("=-_") for cut in SEPARATORS for x in cut.split(bare))]
    return list(dict.fromkeys(x for x in found if len(x) >= MIN_LENGTH))


def _tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(s: str) -> tuple[str, float]:
    """The encoding, and the combined p-value of the tests under the hypothesis that s is random in it."""
    chars = frozenset(s)
    name, _, index = next(((n, a, i) for n, a, i in _alphabets() if chars <= a), ("mixed", frozenset(), {}))
    if not index:
        return "none", 0.0
    k, n = len(index), len(s)
    x = np.array([index[c] for c in s])
    counts = np.bincount(x, minlength=k)
    chi = float((counts**2).sum()) * k / n - n
    mean, var = k - 1, max(2 * (k - 1) * (n - 1) / n, 1e-9)
    df = 2 * mean**2 / var  # a gamma of the same mean and variance, by Wilson and Hilferty's cube root
    z = ((max(chi, 0) / mean) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    tests = [_tail(z)]
    high = x >= k / 2
    a, b = int(high.sum()), n - int(high.sum())
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        m = 1 + 2 * a * b / n
        v = (m - 1) * (m - 2) / max(n - 1, 1)
        tests.append(_tail((runs - m) / math.sqrt(v)) if v > 0 else 1.0)
    else:
        tests.append(2.0 ** (1 - n))
    c = x - x.mean()
    power = float((c * c).sum())
    tests.append(_tail(float((c * np.roll(c, -1)).sum()) / power * math.sqrt(n)) if power else 0.0)
    h = -sum(math.log(max(p, 1e-300)) for p in tests)
    return name, math.exp(-h) * (1 + h + h * h / 2)


class Ordinary:
    """Rates of the alphabet's characters in ordinary text."""

    def __init__(self, counts: np.ndarray):
        q = (counts + 1) / (counts + 1).sum()
        self.bits = {c: -math.log(p) for c, p in zip(ALPHABET, q)}
        self.grid = [(t, math.log(float((q ** (1 - t)).sum()))) for t in (0.25, 0.5, 0.75, 1.0)]

    def log10_p(self, s: str) -> float:
        """The bound's decimal logarithm, 0 at most."""
        rare = sum(self.bits[c] for c in s)
        return min(0.0, *(-t * rare + len(s) * m for t, m in self.grid)) / math.log(10)


def size_class(n: int) -> int:
    return sum(n >= c for c in CLASSES) - 1


@lru_cache(1)
def _in_alphabet() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in ALPHABET]] = True
    return out


def _inner_equals(cp: np.ndarray, is_in: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where a '=' is that isn't padding: after its run of '=' the alphabet's characters go on."""
    at = np.flatnonzero(cp == ord("="))
    if not len(at):
        return at
    starts = np.zeros(len(cp) + 1, bool)
    starts[doc_starts] = True
    last = np.append((at[1:] != at[:-1] + 1) | starts[at[1:]], True)
    goes_on = np.append(is_in, False)[at[last] + 1] & ~starts[at[last] + 1]
    return at[goes_on[np.cumsum(last) - last]]


def candidates(arr: pa.Array) -> tuple[Chars, np.ndarray, np.ndarray, np.ndarray]:
    """The characters; starts and ends of the candidates, and the index of each one's text."""
    chars = Chars(arr)
    is_in = _in_alphabet()[chars.cp]
    at = chars.doc_starts
    is_in[_inner_equals(chars.cp, is_in, at)] = False
    before, after = np.zeros(len(is_in), bool), np.zeros(len(is_in), bool)
    before[1:], after[:-1] = is_in[:-1], is_in[1:]
    before[at] = False
    after[at[at > 0] - 1] = False
    starts, ends = np.flatnonzero(is_in & ~before), np.flatnonzero(is_in & ~after) + 1
    long = ends - starts >= MIN_LENGTH
    starts, ends = starts[long], ends[long]
    return chars, starts, ends, np.searchsorted(chars.off, starts, side="right") - 1


@dataclass
class Rule:
    """Character counts of all documents, and for each length class the power of ten at or below which a string is a secret."""

    counts: np.ndarray
    limits: list[float]

    def ordinary(self) -> Ordinary:
        return Ordinary(self.counts)

    def secret(self, s: str, ordinary: Ordinary) -> tuple[bool, str, float, float]:
        """Whether s is a secret, and the encoding and p-values of the first of its strings that passes."""
        for c in tested(s):
            power = _stepped(ordinary.log10_p(c))
            if power <= self.limits[size_class(len(c))]:
                encoding, p = battery(c)
                if p >= MIN_RANDOM and encoding not in PLAIN:
                    return True, encoding, p, power
        return False, "none", 0.0, 0.0


def _stepped(log10_p: float) -> float:
    """Rounded up to a step, so that a p-value is never made smaller."""
    return max(math.ceil(log10_p * STEPS - 1e-9) / STEPS, -float(MAX_POWER))


def limits(steps: dict[int, dict[float, int]], fdr: float = FDR) -> list[float]:
    """Benjamini-Hochberg in each length class, from the numbers of strings by power of ten."""
    out = []
    for k in range(len(CLASSES)):
        own = steps.get(k, {})
        m, seen, best = sum(own.values()), 0, -math.inf
        for power in sorted(own):
            seen += own[power]
            if power <= math.log10(fdr * seen / m):
                best = power
        out.append(best)
    return out


FOUND = "doc_id bigint, start bigint, candidate string, counts array<bigint>"


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return columns(docs, id_col, text_col).toDF("doc_id", "text").selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


def _gathered(base: DataFrame) -> DataFrame:
    """Every candidate of every document, and rows with the numbers of the alphabet's characters alone."""
    order = np.array([ord(c) for c in ALPHABET])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(len(ALPHABET), np.int64)
            ids, at, found = [], [], []
            for begin, n in slices(batch.column(1)):
                text = batch.column(1).slice(begin, n)
                chars, starts, ends, doc = candidates(text)
                total += np.bincount(utf8(text)[0], minlength=256)[order]
                key = batch.column(0).slice(begin, n).to_pylist()
                for s, e, d in zip(starts.tolist(), ends.tolist(), doc.tolist()):
                    ids.append(key[d])
                    at.append(s - int(chars.off[d]))
                    found.append(chars.text[s:e])
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ids, None], pa.int64()), pa.array([*at, None], pa.int64()), pa.array([*found, None], pa.string()), pa.array([None] * len(ids) + [total.tolist()], pa.list_(pa.int64()))], names=["doc_id", "start", "candidate", "counts"]
            )

    return base.filter("text is not null").mapInArrow(run, FOUND)


def _rule(found: DataFrame) -> Rule:
    k = len(ALPHABET)
    row = found.filter("counts is not null").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(k)]).first()
    counts = np.array([x or 0 for x in row], np.int64)
    ordinary = Ordinary(counts)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x for c in batch.column(0).to_pylist() for x in tested(c)], pa.string())], names=["string"])

    def powers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([size_class(len(x)) for x in c], pa.int32()), pa.array([_stepped(ordinary.log10_p(x)) for x in c], pa.float64())], names=["k", "power"])

    # Rows by class and step of the p-value: a bounded number, whatever the corpus.
    distinct = found.filter("candidate is not null").select("candidate").distinct().mapInArrow(strings, "string string").distinct()
    rows = distinct.mapInArrow(powers, "k int, power double").groupBy("k", "power").count().collect()
    steps: dict[int, dict[float, int]] = {}
    for r in rows:
        steps.setdefault(r.k, {})[r.power] = r["count"]
    return Rule(counts, limits(steps))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a secret: doc_id, start and end in characters, encoding, p_random, and log10_p_ordinary.

    Texts that are null, empty or short have none. Rows that repeat give their secrets again; the false-discovery control counts a
    string once however often it occurs. Other columns are left out.
    """
    ship(docs.sparkSession)
    found = written(_gathered(_base(docs, id_col, text_col)))
    rule = _rule(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = rule.ordinary()
        for batch in batches:
            rows = []
            for i, s, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                secret, encoding, p, power = rule.secret(c, ordinary)
                if secret:
                    rows.append((i, s, s + len(c), encoding, p, power))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "start", "end", "encoding", "p_random", "log10_p_ordinary"])

    schema = "doc_id bigint, start bigint, end bigint, encoding string, p_random double, log10_p_ordinary double"
    return found.filter("candidate is not null").select("doc_id", "start", "candidate").mapInArrow(run, schema)


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with MASK in place of every secret that scan() finds, and size_col, where docs has it, set anew for such texts. No row goes."""
    ship(docs.sparkSession)
    rule = _rule(written(_gathered(_base(docs, id_col, text_col))))
    new = fresh(docs, "text")
    at = len(docs.columns)
    names = [*docs.columns, new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = rule.ordinary()
        for batch in batches:
            for begin, n in slices(batch.column(at)):
                part = batch.slice(begin, n)
                chars, starts, ends, doc = candidates(part.column(at))
                cuts: dict[int, list[tuple[int, int]]] = {}
                for s, e, d in zip(starts.tolist(), ends.tolist(), doc.tolist()):
                    if rule.secret(chars.text[s:e], ordinary)[0]:
                        cuts.setdefault(d, []).append((s, e))
                changed = [None] * n
                for d, spans in cuts.items():
                    pieces, last = [], int(chars.off[d])
                    for s, e in spans:
                        pieces += [chars.text[last:s], MASK]
                        last = e
                    changed[d] = "".join([*pieces, chars.text[last : int(chars.off[d + 1])]])
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(changed, pa.string())], names=names)

    schema = docs.withColumn(new, F.lit(None).cast("string")).schema
    out = docs.withColumn(new, docs[f"`{text_col}`"].cast("string")).mapInArrow(run, schema)
    values = []
    for f in docs.schema:
        c = F.col(f"`{f.name}`")
        if f.name == text_col:
            c = F.coalesce(F.col(new), c).cast(f.dataType)
        elif f.name == size_col:
            c = F.when(F.col(new).isNotNull(), F.char_length(F.col(new)).cast(f.dataType)).otherwise(c)
        values.append(c.alias(f.name))
    return out.select(values)
