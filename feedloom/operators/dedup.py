"""First-wins deduplication in stages, and suppression of near-duplicate titles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let, squeezed
from .checkpoints import cut

SIMILAR = 0.55


def first_by(items: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """The first row of each key. A null key is a key of its own."""
    at = Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last())
    return items.withColumn("__n", F.row_number().over(at)).filter("__n = 1").drop("__n")


def staged_rows(rows: DataFrame, names: list[str], order: str = "ord") -> DataFrame:
    """First by each of these columns in turn among what the columns before left. A row that a later stage drops has still taken its earlier
    keys. Every stage shuffles whole rows, so rows should be narrow."""
    for name in names:
        rows = first_by(rows, F.col(name), order)
    return rows


def staged(items: DataFrame, keys: list[Column], order: str = "ord") -> DataFrame:
    """items that staged_rows() leaves by these keys. The keys are worked out once, and they and `order`, which is unique, alone go through
    the stages; the items meet what is left in one join."""
    names = [f"__k{i}" for i in range(len(keys))]
    rows = items.select(F.col(order), *[k.alias(n) for k, n in zip(keys, names)])
    return items.join(staged_rows(rows, names, order).select(order), order, "left_semi")


def young(items: DataFrame, now: Column, seconds: int = 24 * 3600, published: str = "published") -> DataFrame:
    """Items no older than that, or of unknown age."""
    p = F.col(published)
    return items.filter(p.isNull() | (F.unix_micros(now) - F.unix_micros(p) <= F.lit(seconds * 1_000_000)))


def shingles(title: Column) -> Column:
    """The distinct pairs of neighbouring words, of ASCII letters and digits in lower case; the single word if there is but one."""
    words = F.filter(F.split(squeezed(F.regexp_replace(F.lower(title), r"[^0-9A-Za-z \t\n\x0B\f\r]+", " ")), " "), lambda w: w != "")

    def pairs(w: Column) -> Column:
        return F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))

    return F.array_distinct(let(words, lambda w: F.when(F.size(w) > 1, pairs(w)).otherwise(w)))


def similar_pairs(rows: DataFrame, least: float = SIMILAR) -> DataFrame:
    """a < b and jaccard of rows (ord, s) whose sets s are that similar.

    By prefix filtering: sets so similar share one of their rarest few shingles, so common ones aren't joined on. Each pair is then
    compared whole.
    """
    each = rows.select("ord", F.explode("s").alias("x"))
    rare = each.groupBy("x").agg(F.count("*").alias("n"))
    ordered = each.join(rare, "x").groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda t: t["x"]).alias("r"))
    size = F.size("r")
    prefix = F.slice("r", F.lit(1), (size - F.ceil(size * F.lit(least) - F.lit(1e-9)) + 1).cast("int"))
    keyed = ordered.select("ord", size.alias("n"), F.explode(prefix).alias("x"))
    left, right = keyed.toDF("a", "na", "x"), keyed.toDF("b", "nb", "x")
    near = left.join(right, "x").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    sets = rows.select("ord", "s")
    both = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (inter / (F.size("sa") + F.size("sb") - inter)).alias("jaccard")).filter(F.col("jaccard") >= least)


def distinct_titles(items: DataFrame, order: str = "ord", title: str = "title", least: float = SIMILAR) -> DataFrame:
    """Rows in order, each kept if its title is similar to no earlier kept one's. `order` is unique; score 0 is filtered out before.

    Titles with the same shingles collapse to the first. Then, in rounds, a title is kept once all earlier similar ones are dropped, and
    dropped once one of them is kept; the first undecided title is always decided, so this ends, usually after a few rounds.
    """
    rows = items.select(F.col(order).alias("ord"), shingles(F.coalesce(F.col(title), F.lit(""))).alias("s"))
    worded = rows.filter(F.size("s") > 0)
    firsts = cut(worded.groupBy(F.array_sort("s").alias("s")).agg(F.min("ord").alias("ord")))
    pairs = cut(similar_pairs(firsts, least).select("a", "b"))
    kept = firsts.select("ord").join(pairs.select(F.col("b").alias("ord")), "ord", "left_anti").withColumn("keep", F.lit(True))
    state = cut(firsts.select("ord").join(kept, "ord", "left"))
    while state.filter("keep is null").limit(1).count():
        before = pairs.join(state.select(F.col("ord").alias("a"), "keep"), "a").groupBy(F.col("b").alias("ord"))
        told = before.agg(F.when(F.bool_or("keep"), False).when(F.count_if(F.col("keep").isNull()) == 0, True).alias("told"))
        state = cut(state.join(told, "ord", "left").select("ord", F.coalesce("keep", "told").alias("keep")))
    wordless = rows.filter(F.size("s") <= 0).select("ord")
    stay = state.filter("keep").select("ord").union(wordless).withColumnRenamed("ord", order)
    return items.join(stay, order, "left_semi")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two titles; 0 if either has no words."""

    def of(x: Column, y: Column) -> Column:
        inter = F.size(F.array_intersect(x, y))
        return F.when((F.size(x) > 0) & (F.size(y) > 0), inter / (F.size(x) + F.size(y) - inter)).otherwise(F.lit(0.0))

    return let(shingles(a), lambda x: let(shingles(b), lambda y: of(x, y)))


def prefix_length(n: int, least: float = SIMILAR) -> int:
    """Shingles of a set of n that similar_pairs() joins on."""
    return n - math.ceil(n * least - 1e-9) + 1
