"""Candidates with cleaned article texts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fallback_summary

#: Most rows of one number that are broadcast.
BROADCAST_ROWS = 100_000


def candidates(items: DataFrame, now: Column) -> DataFrame:
    """Items as candidates: an unknown time is now, an unknown source is empty, the description is the content and the title the image's
    alternative text."""
    return items.withColumns({"published": F.coalesce("published", now), "source_name": F.coalesce("source_name", F.lit("")), "source_lang": F.coalesce("source_lang", F.lit("")), "content": F.col("description"), "image_alt": F.col("title")})


def _among_first(items: DataFrame, most: int, name: str) -> DataFrame:
    """items with whether each is among the first `most` by `ord`, which is unique (0: all are). The first ones are found by a top-k, so no
    task has all items."""
    if most <= 0:
        return items.withColumn(name, F.lit(True))
    first = items.select("ord").orderBy("ord").limit(most).withColumn(name, F.lit(True))
    small = F.broadcast(first) if most <= BROADCAST_ROWS else first
    return items.join(small, "ord", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_articles(items: DataFrame, articles: DataFrame, most: int = 10) -> DataFrame:
    """Candidates with the content of their article where it has more than 200 bytes; only the first `most` by rank, by `ord`, get one.
    Articles (url, article) with 100 bytes or less count as not fetched."""
    use = articles.filter(F.octet_length("article") > 100).dropDuplicates(["url"])
    asked = _among_first(items, most, "__asked")
    both = asked.join(use, (asked["link"] == use["url"]) & F.col("__asked"), "left")
    return both.withColumn("content", F.when(F.octet_length("article") > 200, F.col("article")).otherwise(F.col("content"))).drop("url", "article", "__asked")


def with_summaries(items: DataFrame, main: DataFrame | None = None, most: int = 0) -> DataFrame:
    """summary, danish and ukrainian of each item: of the main model's answers (link, summary, danish, ukrainian) for the first `most` by
    `ord` (0: all), a null standing for a failed call; of the fallback summary for the rest."""
    plain = fallback_summary(F.coalesce("content", F.lit("")))
    names = ("summary", "danish", "ukrainian")
    if main is None:
        return items.withColumns(dict.fromkeys(names, plain))
    got = main.dropDuplicates(["link"]).select(F.col("link").alias("__link"), *[F.col(n).alias(f"__{n}") for n in names])
    asked = _among_first(items, most, "__may")
    both = asked.join(got, (asked["link"] == got["__link"]) & F.col("__may"), "left")
    return both.withColumns({n: F.coalesce(F.nullif(F.col(f"__{n}"), F.lit("")), plain) for n in names}).drop("__link", "__may", *[f"__{n}" for n in names])
