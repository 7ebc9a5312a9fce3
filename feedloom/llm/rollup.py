"""Delta-maintained token totals.

Totals by source, language and tokenizer version are sums of signed changes: an insert adds a document's tokens, a delete takes them away, a
revision adds the difference. A batch of changes is reduced to one row a group and written to a folder of its own; the commit is a marker
named after the batch, which is made only if it isn't there, by one step of the file system. So of writers of one batch just one applies it,
and a batch may be sent again after any failure. Compaction folds the batches so far into a snapshot, committed in the same way, that
lists them, and deletes their folders and markers. A batch that the snapshot lists counts for nothing, whatever markers come later.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import RANKS, count_tokens
from .common import columns, dropped, shared_dir, written

KEYS = ("source", "lang", "tokenizer_version")
VALUES = ("n_docs", "n_tokens")
SCHEMA = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint"
CHANGES = ("op", "source", "lang", "tokenizer_version", "n_tokens", "old_tokens")


def signed(changes: DataFrame) -> DataFrame:
    """The groups' additive changes. op is insert, delete or revise; n_tokens is what holds after it and old_tokens what held before.

    A null or unknown op changes nothing; a null number of tokens is 0; null keys are groups of their own. Rows that repeat count each.
    """
    c = columns(changes, *CHANGES)
    new, old = F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)), F.coalesce(F.col("old_tokens").cast("bigint"), F.lit(0))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -old).when(F.col("op") == "revise", new - old).otherwise(0)
    return c.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(F.sum(docs.cast("bigint")).alias("n_docs"), F.sum(tokens.cast("bigint")).alias("n_tokens"))


class Rollup:
    """Totals kept under a folder of the shared file system."""

    def __init__(self, spark: SparkSession, uri: str | None = None):
        self.spark, self.uri = spark, (uri or shared_dir(spark)).rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.uri).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.uri))

    def _names(self, prefix: str) -> list[str]:
        return sorted(n for s in self._fs.listStatus(self._path(self.uri)) if (n := s.getPath().getName()).startswith(prefix))

    def _claim(self, name: str, folder: str) -> bool:
        """Make the marker `name`, which says `folder`; whether it was this call that made it. Local disks have links, which fail if the
        name is taken; on other file systems a file is renamed, which does the same."""
        aside = self._path(f"{self.uri}/_marker-{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(folder.encode()))
        out.close()
        target = self._path(f"{self.uri}/{name}")
        try:
            if self._fs.getUri().getScheme() == "file":
                try:
                    os.link(aside.toUri().getPath(), target.toUri().getPath())
                    return True
                except FileExistsError:
                    return False
            return not self._fs.exists(target) and self._fs.rename(aside, target)
        finally:
            self._fs.delete(aside, False)

    def _said(self, name: str) -> str:
        file = self._fs.open(self._path(f"{self.uri}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()

    def _snapshot(self) -> str | None:
        last = (self._names("snapshot-") or [None])[-1]
        return last and self._said(last)

    def _listed(self, snapshot: str | None, ids: list[str]) -> set[str]:
        """Which of these batches the snapshot holds."""
        if not snapshot or not ids:
            return set()
        return {r.batch for r in self.spark.read.parquet(f"{self.uri}/{snapshot}/batches").filter(F.col("batch").isin(ids)).collect()}

    def _open(self, snapshot: str | None) -> list[str]:
        """Markers' names of the batches since the snapshot."""
        names = self._names("batch-")
        done = self._listed(snapshot, [n.removeprefix("batch-") for n in names])
        return [n for n in names if n.removeprefix("batch-") not in done]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; whether it was applied now."""
        if not re.fullmatch(r"[A-Za-z0-9_.]+", batch_id):
            raise ValueError(f"batch id {batch_id!r}")
        name, folder = f"batch-{batch_id}", f"data-{uuid.uuid4().hex}"
        if self._fs.exists(self._path(f"{self.uri}/{name}")) or self._listed(self._snapshot(), [batch_id]):
            return False
        signed(changes).write.parquet(f"{self.uri}/{folder}")
        if self._claim(name, folder):
            # Between the look and the claim a compaction may have folded another writer's batch and removed its marker.
            if not self._listed(self._snapshot(), [batch_id]):
                return True
            dropped(self.spark, f"{self.uri}/{name}")
        dropped(self.spark, f"{self.uri}/{folder}")
        return False

    def _sums(self, snapshot: str | None, names: list[str]) -> DataFrame:
        parts = [f"{self.uri}/{self._said(n)}" for n in names] + ([f"{self.uri}/{snapshot}/totals"] if snapshot else [])
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        sums = self.spark.read.schema(SCHEMA).parquet(*parts).groupBy(*KEYS).agg(*[F.sum(v).alias(v) for v in VALUES])
        return sums.filter("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by group; groups in which no document is left and no token counted are left out. To be read before the next
        compaction but one, which deletes what this one reads."""
        snapshot = self._snapshot()
        return self._sums(snapshot, self._open(snapshot))

    def compact(self) -> bool:
        """Fold all batches into a snapshot; whether it was this call's that counts. What it replaces is deleted only once it counts; the
        snapshot before stays for those who read it."""
        old = self._names("snapshot-")
        snapshot = self._snapshot()
        there = self._names("batch-")
        names = self._open(snapshot)
        folder = f"data-{uuid.uuid4().hex}"
        try:
            self._sums(snapshot, names).write.parquet(f"{self.uri}/{folder}/totals")
            listed = self.spark.createDataFrame([(n.removeprefix("batch-"),) for n in names], "batch string")
            if snapshot:
                listed = listed.union(self.spark.read.parquet(f"{self.uri}/{snapshot}/batches"))
            listed.write.parquet(f"{self.uri}/{folder}/batches")
        except Exception:
            dropped(self.spark, f"{self.uri}/{folder}")
            if self._snapshot() == snapshot:
                raise
            return False  # another compaction has deleted what this one read
        if not self._claim(f"snapshot-{int(old[-1].split('-')[1]) + 1 if old else 0:012d}", folder):
            dropped(self.spark, f"{self.uri}/{folder}")
            return False
        for name in [*there, *old[:-1]]:
            dropped(self.spark, f"{self.uri}/{self._said(name)}")
            dropped(self.spark, f"{self.uri}/{name}")
        return True


def token_counts(docs: DataFrame, version: str, tokenizer: str = RANKS) -> DataFrame:
    """doc_id, source, lang, tokenizer_version and n_tokens of documents; a null text has a null count, which totals take for 0."""
    base = columns(docs, "doc_id", "source", "lang", "text").selectExpr("cast(doc_id as bigint) doc_id", "cast(source as string) source", "cast(lang as string) lang", "cast(text as string) text")
    return count_tokens(base, "text", "n_tokens", tokenizer).withColumn("tokenizer_version", F.lit(version))


def maintained(docs: DataFrame, version: str = "byte_bpe_50k", tokenizer: str = RANKS) -> DataFrame:
    """Totals after three batches: all documents come in; those of every tenth id are deleted, and those of another tenth get an
    end-of-text token, which revises their counts; and the second batch comes once more, to no effect."""
    counts = written(token_counts(docs, version, tokenizer))
    kept = Rollup(docs.sparkSession)
    kept.commit("load", counts.selectExpr("'insert' op", "source", "lang", "tokenizer_version", "n_tokens", "cast(null as bigint) old_tokens"))
    turn = F.pmod("doc_id", F.lit(10))
    op = F.when(turn == 3, "delete").when(turn == 7, "revise")
    second = counts.withColumn("op", op).filter("op is not null").selectExpr("op", "source", "lang", "tokenizer_version", "n_tokens + 1 n_tokens", "n_tokens old_tokens")
    for _ in range(2):
        kept.commit("changes", second)
    kept.compact()
    return kept.totals()
