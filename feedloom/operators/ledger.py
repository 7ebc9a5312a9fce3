"""The ledger of sent items: time-to-live tests, upserts, statistics, and the send loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TTL_HOURS = 48
#: JSON's own form leaves out microseconds; read, it may have fewer.
JSON_WRITTEN, JSON_READ = ({"timestampFormat": f"yyyy-MM-dd'T'HH:mm:ss{x}XXX"} for x in (".SSSSSS", "[.SSSSSS][.SSS]"))
SCHEMA = "hash string, title string, link string, category string, source string, sent_at timestamp"


def cutoff(now: Column, ttl_hours: int = TTL_HOURS) -> Column:
    return F.timestamp_micros(F.unix_micros(now) - F.lit(ttl_hours * 3_600_000_000))


def active(ledger: DataFrame, now: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Rows sent after the cutoff; one sent just then is neither active nor cleaned away."""
    return ledger.filter(F.col("sent_at") > cutoff(now, ttl_hours))


def cleaned(ledger: DataFrame, now: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    return ledger.filter(F.col("sent_at") >= cutoff(now, ttl_hours))


def unsent(items: DataFrame, ledger: DataFrame, now: Column, ttl_hours: int = TTL_HOURS, by: tuple[str, ...] = ("hash", "link")) -> DataFrame:
    """Items of which no key is in an active row. A null key matches nothing."""
    live = active(ledger, now, ttl_hours)
    for key in by:
        items = items.join(live.select(key).distinct(), key, "left_anti")
    return items


def latest(rows: DataFrame) -> DataFrame:
    """One row a hash, the last sent."""
    at = Window.partitionBy("hash").orderBy(F.desc_nulls_last("sent_at"), F.desc("title"), F.desc("link"))
    return rows.withColumn("__n", F.row_number().over(at)).filter("__n = 1").drop("__n")


def upserted(ledger: DataFrame, sent: DataFrame, whole_row: bool = False) -> DataFrame:
    """The ledger after items were sent: a new hash comes in; of one that is there only sent_at changes, or, with whole_row, all of it."""
    new = latest(sent).select(*[F.col(c).alias(f"n_{c}") for c in ledger.columns])
    both = ledger.join(new, ledger["hash"] == new["n_hash"], "full_outer")
    there, comes = F.col("hash").isNotNull(), F.col("n_hash").isNotNull()
    out = []
    for c in ledger.columns:
        change = comes & (~there | F.lit(whole_row) | F.lit(c == "sent_at"))
        out.append(F.when(change, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def stats(ledger: DataFrame, now: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """name and value: all rows, active ones, and active ones by category; a null category is only in the totals."""
    live = F.col("sent_at") > cutoff(now, ttl_hours)
    total = ledger.agg(F.count("*").alias("total"), F.count_if(live).alias("active")).select(F.explode(F.create_map(F.lit("total_items"), "total", F.lit("active_items"), "active")).alias("name", "value"))
    return total.union(ledger.filter(live & F.col("category").isNotNull()).groupBy(F.concat(F.lit("category_"), "category").alias("name")).agg(F.count("*").alias("value")))


def recent(ledger: DataFrame, n: int = 10) -> DataFrame:
    return ledger.orderBy(F.desc_nulls_last("sent_at"), "hash", "title", "link").limit(n if n > 0 else 10)


def repeated_titles(ledger: DataFrame, now: Column, hours: int = TTL_HOURS) -> DataFrame:
    return active(ledger, now, hours).groupBy("title").agg(F.count("*").alias("n")).filter("n > 1")


def send_loop(items: DataFrame, ledger: DataFrame, now: Column, most: int = 5, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """ord, and whether the item was sent, was a duplicate by then, or failed.

    Items (ord, hash, link, send_ok) that the ledger has are left out first, by hash or link; the first `most` (5 if that isn't positive) of
    the rest are tried in order. One whose hash or link was sent meanwhile is skipped but has taken a place; one that failed isn't recorded.
    """
    most = most if most > 0 else 5
    tried = unsent(items, ledger, now, ttl_hours).orderBy("ord").limit(most)
    rows = F.array_sort(F.collect_list(F.struct("ord", "hash", "link", F.coalesce("send_ok", F.lit(False)).alias("send_ok"))))

    def step(acc, x):
        again = F.exists(acc, lambda y: (y["outcome"] == "sent") & ((y["hash"] == x["hash"]) | (y["link"] == x["link"])))
        outcome = F.when(again, "duplicate").when(x["send_ok"], "sent").otherwise("failed")
        return F.array_append(acc, F.struct(x["ord"].alias("ord"), x["hash"].alias("hash"), x["link"].alias("link"), outcome.alias("outcome")))

    start = F.array().cast("array<struct<ord:bigint,hash:string,link:string,outcome:string>>")
    done = tried.withColumn("ord", F.col("ord").cast("bigint")).agg(F.aggregate(rows, start, step).alias("x"))
    return done.select(F.explode("x").alias("x")).select("x.ord", "x.hash", "x.link", "x.outcome")


def first_unsent(items: DataFrame, ledger: DataFrame, now: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """The best-placed item that wasn't sent."""
    return unsent(items, ledger, now, ttl_hours).orderBy("ord").limit(1)


def cached_translations(cache: DataFrame, put: DataFrame, now: Column) -> DataFrame:
    """The translation cache after entries were put: payload replaced, use_count one more, last_used_at now; new ones start at 1. A read
    changes nothing and knows no age."""
    keys = ("content_hash", "title", "content", "summary", "danish_translation", "ukrainian_translation", "ai_provider")
    new = put.dropDuplicates(["content_hash"]).select(*[F.col(k).alias(f"n_{k}") for k in keys])
    both = cache.join(new, cache["content_hash"] == new["n_content_hash"], "full_outer")
    comes, there = F.col("n_content_hash").isNotNull(), F.col("content_hash").isNotNull()
    fields = [F.when(comes, F.col(f"n_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return both.select(*fields, F.when(there, F.col("created_at")).otherwise(now).alias("created_at"), F.when(comes, now).otherwise(F.col("last_used_at")).alias("last_used_at"), F.when(comes, F.coalesce("use_count", F.lit(0)) + 1).otherwise(F.col("use_count")).cast("int").alias("use_count"))


def unexpired(cache: DataFrame, now: Column) -> DataFrame:
    """Entries of a key-value cache that haven't expired."""
    return cache.filter(F.col("expires_at") >= now)


def looked_up(requests: DataFrame, cache: DataFrame, now: Column, key: str = "key") -> DataFrame:
    """requests with the `value` that a key-value cache (key, value, expires_at) has for their key and hasn't expired, and `hit`. Of entries
    with one key the one that expires last counts, as it was put last. A null key finds nothing; a value may itself be null."""
    live = unexpired(cache, now).groupBy(F.col(key).alias("__key")).agg(F.max_by("value", "expires_at").alias("value"), F.lit(True).alias("__hit"))
    return requests.join(live, requests[key] == live["__key"], "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")


def translations_of(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (content_hash) with the cached summary and translations, whatever their age, and `found`; an unknown hash has nulls."""
    fields = ("summary", "danish_translation", "ukrainian_translation", "ai_provider")
    known = cache.select(F.col("content_hash").alias("__hash"), *fields)
    return requests.join(known, requests["content_hash"] == known["__hash"], "left").withColumn("found", F.col("__hash").isNotNull()).drop("__hash")


def read_json(spark: SparkSession, path: str, now: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """A ledger kept as one JSON array: active rows; of rows with one hash, the last in the file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>", JSON_READ)).alias("at", "r")).select("at", "r.*")
    last = Window.partitionBy("hash").orderBy(F.desc("at"))
    return active(rows, now, ttl_hours).withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "at")


def write_json(ledger: DataFrame, path: str) -> None:
    """The whole ledger anew, as one JSON array."""
    ledger.agg(F.to_json(F.collect_list(F.struct(*ledger.columns)), JSON_WRITTEN).alias("value")).coalesce(1).write.mode("overwrite").text(path)
