"""The stateful operators on streams: deduplication under a watermark, and a ledger that each micro-batch is upserted into."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoints import shared_base
from ..operators.ledger import cutoff, unsent, upserted


def distinct_stream(items: DataFrame, keys: list[str], at: str = "published", late: str = "24 hours") -> DataFrame:
    """The first of each key that comes within the watermark; state older than it is dropped."""
    return items.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under shared_base()."""
    return f"{shared_base(spark)}/stream-{uuid.uuid4().hex}"


class LedgerSink:
    """foreachBatch: sends what the ledger doesn't have and upserts it.

    Each batch writes the ledger's next version; the latest one that was written whole is the ledger, also for a sink made anew after a
    restart. A batch that is run again is held against the ledger as it is, so what it recorded before is not sent once more; one that
    failed before its version was whole had recorded nothing and is sent again. All but the last `kept` versions are deleted.
    """

    def __init__(self, spark: SparkSession, uri: str, empty: DataFrame, send: Callable[[DataFrame], DataFrame] | None = None, kept: int = 3):
        self.spark, self.uri, self.schema, self.send, self.kept = spark, uri.rstrip("/"), empty.schema, send or (lambda rows: rows), max(1, kept)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.uri).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Of those that were written whole, in order."""
        root = self._path(self.uri)
        if not self._fs.exists(root):
            return []
        found = [int(n[1:]) for s in self._fs.listStatus(root) if re.fullmatch(r"v\d+", n := s.getPath().getName())]
        return sorted(n for n in found if self._fs.exists(self._path(f"{self.uri}/v{n}/_SUCCESS")))

    def ledger(self) -> DataFrame:
        whole = self.versions()
        if not whole:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.uri}/v{whole[-1]}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        whole, before = self.versions(), self.ledger()
        latest = batch.agg(F.max("sent_at")).first()[0]
        if latest is None:
            return
        fresh = self.send(unsent(batch, before, F.lit(latest), by=("hash",)).dropDuplicates(["hash"]))
        upserted(before, fresh).write.mode("overwrite").parquet(f"{self.uri}/v{whole[-1] + 1 if whole else 0}")
        for n in whole[: -self.kept]:
            self._fs.delete(self._path(f"{self.uri}/v{n}"), True)


def drained_counts(spark: SparkSession, path: str, now: Column, at: Column) -> DataFrame:
    """Events whose time `at` is after the ledger's cutoff, by user and type, counted by a stream over Parquet files that is drained once."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path)
    counts = stream.filter(at > cutoff(now)).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    folder = shared_folder(spark)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    run = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
