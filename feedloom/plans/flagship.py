"""The whole batch: age, staged deduplication, score, titles, rank, and choice under quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import content_key, normalize_url, similarity_key
from ..functions.scoring import scored
from ..operators.checkpoints import cut
from ..operators.dedup import distinct_titles, staged_rows, young
from ..operators.select import POOL, diverse, ranked


def dedup_keys(now: Column) -> list[Column]:
    c = F.col
    return [normalize_url(c("link")), content_key(c("title"), c("description")), similarity_key(c("title"), c("description"), c("link"), c("published"), c("published_raw"), now)]


def curated(items: DataFrame, now: Column, vocabularies: dict | None = None, limit: int = 8, max_age: int = 24 * 3600, per_source: int = 2, per_category: int = 2) -> DataFrame:
    """position, ord, title, source_name, category and score of the chosen items."""
    keys = dict(zip(("__link", "__content", "__bucket"), dedup_keys(now)))
    # Keys and scores are worked out where the texts are read, so that no text is shuffled; scores of later copies are the price.
    rows = scored(young(items, now, max_age), vocabularies).select("ord", "title", "link", "published", "source_name", "category", "score", *[k.alias(n) for n, k in keys.items()])
    # The titles' rounds and the choice both start from it.
    good = cut(staged_rows(rows, list(keys)).filter("score <> 0").drop(*keys))
    good = distinct_titles(good)
    pool = ranked(good, POOL * limit)
    chosen = diverse(pool, limit, per_source, per_category)
    return pool.join(F.broadcast(chosen), "ord").select("position", "ord", "title", "source_name", "category", "score")  # at most `limit` rows
