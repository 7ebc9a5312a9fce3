"""Shared plumbing: the shared folder, Arrow slices of text, and vectorised run hashing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.checkpoints import shared_base

#: Text bytes that one vectorised step handles; a longer document is a step of its own.
SLICE_BYTES = 1 << 20

#: Rows of an Arrow batch. At Spark's own 10,000, documents of 100 kB would make a batch of 1 GB on either side.
BATCH_ROWS = 1000

_SHIPPED: set[str] = set()
_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI under spark.checkpoint.dir. Where that is unset, under a temporary folder in local mode; elsewhere an error."""
    if not spark.conf.get("spark.checkpoint.dir", None) and _OWN_DIR:
        base = _OWN_DIR[0]
    else:
        base = shared_base(spark)
        if not spark.conf.get("spark.checkpoint.dir", None):
            _OWN_DIR.append(base)
            atexit.register(shutil.rmtree, base.removeprefix("file://"), True)
    # A folder without a scheme is of the cluster's default file system.
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[5:]
    return f"{base.rstrip('/')}/feedloom-{uuid.uuid4().hex}"


def written(df: DataFrame, uri: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: the lineage ends there and lost executors cost no recomputation."""
    spark = df.sparkSession
    uri = uri or shared_dir(spark)
    df.write.mode("overwrite").parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the session's folder, which is set here only if it is unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def dropped(spark: SparkSession, uri: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors unless their PYTHONPATH has it, and keep Arrow batches of long texts small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in os.environ.get("PYTHONPATH", "").split(":"):
        return
    _SHIPPED.add(app)
    at = os.path.join(tempfile.mkdtemp(prefix="feedloom-zip-"), "feedloom.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "feedloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(at)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name = "_" + name
    return name


def columns(df: DataFrame, *names: str) -> DataFrame:
    """These columns alone, so that other columns can't clash with an operator's own."""
    return df.select(*[df[f"`{n}`"] for n in names])


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array, and its n + 1 offsets into them; a null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if not pa.types.is_binary(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind, len(arr) + 1, arr.offset * kind().itemsize).astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(arr: pa.Array, target: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows with about `target` bytes of text each."""
    _, off = utf8(arr)
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + target, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j - i
        i = j


class Chars:
    """The code points of all texts of an array, laid end to end."""

    def __init__(self, arr: pa.Array):
        raw, off = utf8(arr)
        self.raw, self.byte_off = raw, off
        self.text = raw.tobytes().decode("utf-8", "replace")
        if len(self.text) == len(raw):
            self.cp = raw.astype(np.uint32)
            self.off = off
        else:
            self.cp = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
            lead = np.zeros(len(raw) + 1, np.int64)
            np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
            self.off = lead[off]

    @property
    def doc_starts(self) -> np.ndarray:
        """Where a non-empty document starts."""
        return self.off[:-1][self.off[1:] > self.off[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)


@lru_cache(1)
def _powers_cached() -> list[np.ndarray]:
    return [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers_cached()
    if len(have[0]) < n:
        for k, r in enumerate((_R, _R_INV)):
            a = np.full(max(n, SLICE_BYTES + 1), r, np.uint64)
            a[0] = 1
            have[k] = np.multiply.accumulate(a)
    return have[0][:n], have[1][:n]


@lru_cache(1)
def _cp_values() -> np.ndarray:
    return mix((np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


class Runs:
    """64-bit hashes of runs of characters, from prefix sums of a polynomial in random values of the characters."""

    def __init__(self, cp: np.ndarray):
        power, self.inverse = _powers(len(cp) + 1)
        self.sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(_cp_values()[cp] * power[: len(cp)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each run from start to end."""
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def run_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Runs of cp that are hashed but once."""
    return Runs(cp)(starts, ends)


@lru_cache(1)
def word_table() -> np.ndarray:
    """For each code point, whether it is a letter, digit or mark."""
    import unicodedata

    return np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(0x110000)])


def words(chars: Chars, min_chars: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each word's document."""
    is_word = word_table()[chars.cp]
    before = np.zeros(len(is_word), bool)
    before[1:] = is_word[:-1]
    after = np.zeros(len(is_word), bool)
    after[:-1] = is_word[1:]
    at = chars.doc_starts
    before[at] = False
    after[at[at > 0] - 1] = False
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    if min_chars > 1:
        long = ends - starts >= min_chars
        starts, ends = starts[long], ends[long]
    return starts, ends, np.searchsorted(chars.off, starts, side="right") - 1


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of start .. start + count - 1 over all entries."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType, mask: np.ndarray | None = None) -> pa.Array:
    """An Arrow list array; where mask is true, the list is null."""
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
    if mask is not None and mask.any():
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(mask, False)), pa.array(values, kind))
    return lists
