"""Run metrics, cache-hit rates, and admission under providers' quotas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def run_metrics(events: DataFrame) -> DataFrame:
    """One row of counters from rows (kind, at, millis, message): kinds processed, ok, failed, duplicate, sent, time, run and error.

    The average time is in whole milliseconds, rounded down. The run is healthy if nothing failed after the last finished run.
    """
    def n(kind: str):
        return F.count_if(F.col("kind") == kind)

    time = F.when(F.col("kind") == "time", F.col("millis"))
    count = n("time")
    last_run, last_error = (F.max(F.when(F.col("kind") == k, F.col("at"))) for k in ("run", "error"))
    return events.agg(
        n("processed").alias("news_processed"),
        n("ok").alias("successful_translations"),
        n("failed").alias("failed_translations"),
        n("duplicate").alias("duplicates_filtered"),
        n("sent").alias("messages_sent"),
        F.coalesce(F.sum(time), F.lit(0)).cast("bigint").alias("total_millis"),
        F.when(count > 0, F.floor(F.sum(time) / count)).otherwise(0).cast("bigint").alias("average_millis"),
        F.max_by("millis", F.when(F.col("kind") == "time", F.col("at"))).alias("last_millis"),
        last_run.alias("last_run"),
        F.max_by("message", F.when(F.col("kind") == "error", F.col("at"))).alias("last_error"),
        last_error.alias("last_error_at"),
        (last_error.isNull() | F.coalesce(last_run >= last_error, F.lit(False))).alias("healthy"),
    )


def _utc(at: Column) -> Column:
    """A time as UTC, in whole seconds; the first of January of year 1 for none."""
    clock = F.timestamp_add("SECOND", F.unix_seconds(at), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.coalesce(F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("0001-01-01T00:00:00Z"))


def metrics_body(metrics: DataFrame) -> DataFrame:
    """body: the row of run_metrics() as JSON."""
    c = F.col
    fields = {
        "average_processing_time_ms": c("average_millis"),
        "duplicates_filtered": c("duplicates_filtered"),
        "failed_translations": c("failed_translations"),
        "is_healthy": c("healthy"),
        "last_error": F.coalesce("last_error", F.lit("")),
        "last_error_time": _utc(c("last_error_at")),
        "last_processing_time_ms": F.coalesce("last_millis", F.lit(0)),
        "last_run_time": _utc(c("last_run")),
        "messages_sent": c("messages_sent"),
        "successful_translations": c("successful_translations"),
        "total_news_processed": c("news_processed"),
    }
    return metrics.select(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("body"))


def health_body(metrics: DataFrame) -> DataFrame:
    """code (200, or 503 where the run isn't healthy) and body of the row of run_metrics()."""
    status = F.when(F.col("healthy"), "ok").otherwise("error")
    body = F.struct(F.coalesce("last_error", F.lit("")).alias("last_error"), _utc(F.col("last_run")).alias("last_run"), status.alias("status"))
    return metrics.select(F.when(F.col("healthy"), 200).otherwise(503).alias("code"), F.to_json(body).alias("body"))


def hit_rate(events: DataFrame) -> DataFrame:
    """hits, misses, tokens_saved and the rate in percent, 0 where nothing was asked for, of rows (hit, tokens)."""
    hits, misses = F.count_if("hit"), F.count_if(~F.col("hit"))
    return events.agg(hits.alias("hits"), misses.alias("misses"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("tokens"))), F.lit(0)).cast("bigint").alias("tokens_saved"), F.coalesce(100.0 * hits / F.nullif(hits + misses, F.lit(0)), F.lit(0.0)).alias("hit_rate"))


def periods(requests: DataFrame, period_seconds: int = 24 * 3600) -> DataFrame:
    """second and since, when its period began, for every second with a request. A period begins with the first request after the one
    before has ended.

    That is a chain along time, so the distinct seconds, and nothing else, go through one task in order; it holds one number.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        since = None
        for batch in batches:
            begun = []
            for s in batch.column(0).to_pylist():
                since = s if since is None or s - since > period_seconds else since
                begun.append(since)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(begun, pa.int64())], names=["second", "since"])

    seconds = requests.select(F.unix_seconds("at").alias("second")).filter("second is not null").distinct()
    return seconds.repartition(1).sortWithinPartitions("second").mapInArrow(chain, "second bigint, since bigint")


def admitted(requests: DataFrame, quotas: dict[str, int], total: int, period_seconds: int = 24 * 3600) -> DataFrame:
    """requests (ord, at, provider) with `admitted`: in order of time and `ord`, while the provider's quota and the total of the period aren't
    used up (0: no bound). A provider without a quota is unbounded; a request without a time is in a period of those.

    Until the total is used up a provider's first requests are admitted, up to its quota, and after that none is; so a request is admitted if
    its rank among its provider's in the period is within the quota and its rank among all such in the period within the total. Both are
    first-k rankings, which Spark cuts before it shuffles.
    """
    second = F.unix_seconds("at")
    rows = requests.select("ord", "at", "provider", second.alias("second")).join(periods(requests, period_seconds), "second", "left").select("ord", "at", "provider", "since")
    bounds = {p: q for p, q in quotas.items() if q > 0}
    ok = rows
    if bounds:
        own = F.col("provider").isin(list(bounds))
        quota = F.create_map(*[F.lit(x) for kv in bounds.items() for x in kv])[F.col("provider")]
        rank = F.row_number().over(Window.partitionBy("since", "provider").orderBy(F.col("at").asc_nulls_first(), "ord"))
        # No rank above the greatest quota counts, which cuts before the shuffle; then each provider's own.
        mine = rows.filter(own).withColumn("__n", rank).filter(F.col("__n") <= max(bounds.values())).filter(F.col("__n") <= quota).drop("__n")
        ok = mine.union(rows.filter(F.coalesce(~own, F.lit(True))))
    if total > 0:
        rank = F.row_number().over(Window.partitionBy("since").orderBy(F.col("at").asc_nulls_first(), "ord"))
        ok = ok.withColumn("__n", rank).filter(F.col("__n") <= total)
    return requests.join(ok.select("ord", F.lit(True).alias("admitted")), "ord", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def usage(admitted_requests: DataFrame) -> DataFrame:
    """Admitted and refused requests by provider."""
    return admitted_requests.groupBy("provider").agg(F.count_if("admitted").alias("used"), F.count_if(~F.col("admitted")).alias("refused"))
