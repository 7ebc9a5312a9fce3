"""The rules that give an item its category and score; the first that holds decides."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocab import NEWS, contains_any, contains_any_sql

#: Name, condition, category, base, and bonuses as (condition, points). All are read by Spark and DuckDB alike.
CONTEXT = "(denmark or ukraine or europe)"
RULES = (
    ("exclude", "", "0"),
    (f"conflict and not {CONTEXT}", "", "0"),
    (
        "ukraine or refugee or visa",
        "ukraine",
        "70 + 15 * cast(denmark as int) + 5 * cast(europe as int) - 15 * cast(conflict and not (refugee or visa or denmark) as int) + 10 * cast(tech as int) + 10 * cast(medical as int)",
    ),
    (f"(tech or medical) and not {CONTEXT}", "", "0"),
    ("medical", "health", "80 + 10 * cast(ai as int) + 10 * cast(denmark as int) + 5 * cast(europe as int)"),
    ("tech", "tech", "80 + 10 * cast(ai as int) + 10 * cast(denmark as int) + 5 * cast(europe as int)"),
    (f"parent and {CONTEXT}", "family", "55 + 10 * cast(denmark as int)"),
    (f"youth and {CONTEXT}", "youth", "50 + 8 * cast(denmark as int)"),
    (f"culture and {CONTEXT}", "culture", "35 + 10 * cast(denmark as int)"),
    (f"sports and {CONTEXT}", "sports", "30 + 8 * cast(denmark as int)"),
    ("denmark", "denmark", "40 + 15 * cast(politics as int)"),
    ("europe", "europe", "25"),
    ("conflict", "conflict", "15"),
    ("economy", "economy", "20"),
    ("environment", "environment", "25"),
    ("education", "education", "22"),
)


def _case(k: int, otherwise: str) -> str:
    arms = " ".join(f"when {r[0]} then " + (f"'{r[1]}'" if k == 1 else r[2]) for r in RULES)
    return f"case {arms} else {otherwise} end"


CATEGORY, SCORE = _case(1, "''"), _case(2, "0")


def _in_struct(sql: str, struct: str, names: Iterable[str]) -> str:
    """sql with these columns' names, but for those within quotes, as fields of the struct."""
    return re.sub(rf"('[^']*')|\b({'|'.join(names)})\b", lambda m: m[1] or f"{struct}.{m[2]}", sql)


def flags(lower_text: Column, vocabularies: dict[str, tuple[str, ...]] | None = None) -> dict[str, Column]:
    return {k: contains_any(lower_text, v) for k, v in (vocabularies or NEWS).items()}


def scored(items: DataFrame, vocabularies: dict[str, tuple[str, ...]] | None = None, title: str = "title", description: str = "description") -> DataFrame:
    """items with category and score; both are empty and 0 where no rule holds. A null text counts as empty. Columns of items that are named
    like a vocabulary stay as they are; one named category or score is replaced."""
    text = F.lower(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(description), F.lit(""))))
    names = list(items.columns)
    # The text in lower case and each flag are worked out once. The flags come from a generator, as a filter by category or score
    # isn't pushed below one; below a projection, it would have the flags, and with each the text, worked out wherever a rule names them.
    held = items.withColumn("__text", text)
    found = F.struct(*[c.alias(k) for k, c in flags(F.col("__text"), vocabularies).items()])
    held = held.select(*[F.col(f"`{n}`") for n in names], F.explode(F.array(found)).alias("__flags"))
    category, score = (_in_struct(x, "__flags", vocabularies or NEWS) for x in (CATEGORY, SCORE))
    kept = [n for n in names if n.lower() not in ("category", "score")]
    return held.select(*[F.col(f"`{n}`") for n in kept], F.expr(category).alias("category"), F.expr(score).cast("int").alias("score"))


def scored_sql(items: str, keep: str, vocabularies: dict[str, tuple[str, ...]] | None = None) -> str:
    """DuckDB SQL of scored(), with the columns `keep` of the relation `items`."""
    flags_ = ", ".join(f"{contains_any_sql('t', v)} as {k}" for k, v in (vocabularies or NEWS).items())
    return f"select {keep}, {CATEGORY} as category, cast({SCORE} as int) as score from (select *, {flags_} from (select *, lower(title || ' ' || description) as t from {items}))"
