"""Feed lists and feeds. Nothing is fetched here: feeds come in as a table of URLs and bodies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import rfc1123

SOURCE = "url string, name string, lang string, priority int, active boolean, categories array<string>"
ITEM = "title string, description string, link string, pubDate string, encoded string, enclosure array<struct<_url:string,_type:string>>"


def _scalar(s: str):
    s = s.strip()
    if s[:1] in "\"'":
        return s[1 : s.index(s[0], 1)]
    s = re.sub(r"\s+#.*$", "", s)
    if s.startswith("["):
        return [_scalar(x) for x in s.strip("[]").split(",") if x.strip()]
    return {"true": True, "false": False}.get(s.lower(), int(s) if re.fullmatch(r"-?\d+", s) else s)


def parsed_list(text: str) -> list[dict]:
    """The entries under `feeds:` of a YAML file of plain mappings."""
    found: list[dict] = []
    key, depth = None, None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "feeds:":
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        if body.startswith("- ") and (depth is None or indent <= depth):
            found.append({})
            depth, body = indent, body[2:]
        elif body.startswith("- ") and key:
            found[-1].setdefault(key, [])
            found[-1][key] = [*(found[-1][key] or []), _scalar(body[2:])]
            continue
        name, _, value = body.partition(":")
        key = name.strip()
        found[-1][key] = _scalar(value) if value.strip() else None
    return found


def sources(spark: SparkSession, path: str) -> DataFrame:
    """The feed list at a local path, read on the driver as a list of settings."""
    with open(path, encoding="utf-8") as f:
        rows = parsed_list(f.read())
    names = [x.split(" ")[0] for x in SOURCE.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SOURCE)


def items(fetched: DataFrame, sources: DataFrame) -> DataFrame:
    """Items of the active sources' feeds, in the order of the feeds (`position`) and within each feed; a feed that isn't there or can't be
    parsed has none. `ord` numbers them by feed and place, so it needs no global sort."""
    live = fetched.join(sources.filter("active"), "url")
    channel = F.from_xml("body", f"channel struct<item:array<struct<{ITEM.replace(' string', ':string').replace(' array', ':array')}>>>", {"mode": "PERMISSIVE"})
    each = live.select("*", F.posexplode(channel["channel"]["item"]).alias("place", "item")).filter(F.col("item.title").isNotNull() | F.col("item.link").isNotNull())
    text = lambda f: F.coalesce(F.col(f"item.{f}"), F.lit(""))
    return each.select(
        (F.col("position").cast("bigint") * 1_000_000 + F.col("place")).alias("ord"),
        text("title").alias("title"),
        text("description").alias("description"),
        text("encoded").alias("content"),
        text("link").alias("link"),
        text("pubDate").alias("published_raw"),
        rfc1123(F.col("item.pubDate")).alias("published"),
        F.transform("item.enclosure", lambda e: F.struct(e["_type"].alias("type"), e["_url"].alias("url"))).alias("enclosures"),
        F.col("name").alias("source_name"),
        F.col("lang").alias("source_lang"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("source_categories"),
    )
