"""The test tables as items, ledger and articles, for Spark and for DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vocabularies with hits in the test tables, in place of the production ones.
DEMO = {
    "refugee": ("pathetic", "ouvr"),
    "visa": ("disgusting",),
    "ukraine": ("stupid", "token"),
    "denmark": ("der", "und", "heit"),
    "conflict": ("moron", "scum", "loser"),
    "tech": ("it", "ai", "data", "software"),
    "ai": ("ai", "artificial intelligence"),
    "medical": ("ción", "mente que"),
    "exclude": ("idiot",),
    "europe": ("les", "una", "que"),
    "youth": ("trend", "unge", "sch"),
    "parent": ("ferie", "elle", "far"),
    "culture": ("bog", "kunst", "tion"),
    "sports": ("em", "klub", "ier"),
    "politics": ("keit", "verb"),
    "economy": ("bank", "ering"),
    "environment": ("green", "andth"),
    "education": ("school", "ingth"),
}
EPOCH = 1_704_067_200  # 2024-01-01
TITLE_CHARS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where a small file would be one task; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: the first line is the title, the text the description, and they came minute by minute."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(
        F.col("doc_id").alias("ord"),
        F.left(F.substring_index("text", "\n", 1), F.lit(TITLE_CHARS)).alias("title"),
        F.col("text").alias("description"),
        F.lit("").alias("content"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.org/d/"), F.col("doc_id").cast("string")).alias("link"),
        F.lit("").alias("published_raw"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id") * 60).alias("published"),
        F.col("source").alias("source_name"),
        F.col("lang").alias("source_lang"),
    )


ITEMS = f"""(select doc_id as ord, left(split_part(text, chr(10), 1), {TITLE_CHARS}) as title, text as description,
 'https://www.' || source || '.example.org/d/' || doc_id as link, {EPOCH} + doc_id * 60 as published, source as source_name, lang as source_lang from documents)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' URLs and variants of them that come to the same: ord and url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    upper = F.concat(F.upper(F.substring_index("url", "/", 3)), F.substr("url", F.char_length(F.substring_index("url", "/", 3)) + 1))
    forms = [F.col("url"), F.concat("url", F.lit("#x")), F.concat(F.substring_index("url", "#", 1), F.when(F.contains(F.col("url"), F.lit("?")), "&").otherwise("?"), F.lit("utm_source=a")), upper]
    return pages.select("page_id", F.posexplode(F.array(*forms)).alias("form", "url")).select((F.col("page_id") * 4 + F.col("form")).alias("ord"), "url")


LINKS = """(select page_id * 4 + form as ord, url from (select page_id, unnest([0, 1, 2, 3]) as form, unnest([url, url || '#x',
 split_part(url, '#', 1) || case when contains(url, '?') then '&' else '?' end || 'utm_source=a',
 upper(split_part(url, '/', 1) || '//' || split_part(url, '/', 3)) || substr(url, length(split_part(url, '/', 1) || '//' || split_part(url, '/', 3)) + 1)]) as url from pages))"""

NOW = "timestamp '2024-01-15 00:00:00'"
NOW_SECONDS = 1_705_276_800
#: Events' times, which are without a zone, as UTC whatever the session's zone is.
EVENT_TIME = "timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', cast(ts as timestamp_ntz)))"


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what was sent: hash, title, link, category, source and sent_at. Hashes repeat."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    return e.select(
        F.left(F.sha2(F.concat(user, "event_type"), 256), F.lit(16)).alias("hash"),
        F.concat("event_type", F.lit("-"), (F.col("user_id") % 20).cast("string")).alias("title"),
        F.concat(F.lit("https://example.org/u/"), user).alias("link"),
        F.when(F.col("user_id") % 11 != 0, F.col("event_type")).alias("category"),
        F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source"),
        F.expr(EVENT_TIME).alias("sent_at"),
    )


SENT = """(select left(sha256(user_id || event_type), 16) as hash, event_type || '-' || (user_id % 20) as title, 'https://example.org/u/' || user_id as link,
 case when user_id % 11 <> 0 then event_type end as category, 'src' || (user_id % 7) as source, ts as sent_at from events)"""
#: One row a hash: a ledger.
LEDGER = f"(select * from (select *, row_number() over (partition by hash order by sent_at desc, title desc, link desc) as n from {SENT}) where n = 1)"
