"""Ranking, and greedy choice under quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POOL = 4


def ranked(items: DataFrame, most: int) -> DataFrame:
    """The best by score, then by time, then by order; as many as given."""
    return items.orderBy(F.desc("score"), F.col("published").desc_nulls_last(), "ord").limit(most)


def diverse(pool: DataFrame, limit: int, per_source: int = 2, per_category: int = 2) -> DataFrame:
    """ord and position (from 1) of the chosen among a ranked pool of bounded size.

    In order, an item is chosen while neither its source nor its category has reached its quota (0: none) and its link isn't empty; if the
    limit isn't reached so, the pool is gone through again for any whose link isn't chosen yet. The chosen are put in order of score and
    time. The pool is at most a few times the limit, so one task folds it.
    """
    if limit <= 0:
        return pool.select("ord", F.lit(1).alias("position")).limit(0)
    row = F.struct(F.struct((-F.col("score")).alias("score"), (-F.unix_micros(F.coalesce("published", F.timestamp_seconds(F.lit(0))))).alias("published"), F.col("ord").alias("ord")).alias("at"), F.coalesce("link", F.lit("")).alias("link"), F.coalesce("source_name", F.lit("")).alias("source"), F.coalesce("category", F.lit("")).alias("category"))
    rows = F.array_sort(F.collect_list(row))

    def under(acc, x, field: str, most: int):
        return F.size(F.filter(acc, lambda y: y[field] == x[field])) < most if most > 0 else F.lit(True)

    def first(acc, x):
        fits = (F.size(acc) < limit) & (x["link"] != "") & under(acc, x, "source", per_source) & under(acc, x, "category", per_category)
        return F.when(fits, F.array_append(acc, x)).otherwise(acc)

    def second(acc, x):
        fits = (F.size(acc) < limit) & ~F.exists(acc, lambda y: y["link"] == x["link"])
        return F.when(fits, F.array_append(acc, x)).otherwise(acc)

    kept = pool.agg(rows.alias("rows"))
    empty = F.slice("rows", 1, 0)
    kept = kept.select("rows", F.aggregate("rows", empty, first).alias("one")).select(F.aggregate("rows", F.col("one"), second).alias("all"))
    # Equal in score and time, the chosen stay in the order in which they were chosen.
    numbered = F.transform("all", lambda x, i: F.struct(x["at"]["score"].alias("score"), x["at"]["published"].alias("published"), i.alias("i"), x["at"]["ord"].alias("ord")))
    return kept.select(F.posexplode(F.array_sort(numbered)).alias("p", "x")).select(F.col("x.ord").alias("ord"), (F.col("p") + 1).alias("position"))
