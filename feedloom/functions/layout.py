"""Messages of bounded size in two languages. All lengths are in characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import condense, fallback_summary, let, limit_bytes, trim, trim_to_words, trimmed

CAPTION_MAX, SENTENCES, MIN_PER_LANGUAGE, MIN_TOTAL = 1024, 2, 120, 180
CAPTION_HEAD = "🇩🇰 Danish Feed 🇺🇦\n\n"
TEXT_HEAD = "🇩🇰 <b>Danish Feed</b> 🇺🇦\n\n"
LINE = "━"


def _or(s: Column, other: Column) -> Column:
    return let(trimmed(F.coalesce(s, F.lit(""))), lambda x: F.when(x == "", other).otherwise(x))


def _with_summaries(items: DataFrame, sentences: int) -> DataFrame:
    """items with __da and __uk, the summaries or the fallback's, and __da_short and __uk_short, condensed. Each step is a column of its own,
    so that none is worked out more than once."""
    one = items.withColumn("__plain", fallback_summary(F.coalesce(F.col("content"), F.lit(""))))
    one = one.withColumns({"__da": _or(F.col("danish"), F.col("__plain")), "__uk": _or(F.col("ukrainian"), F.col("__plain"))})
    return one.withColumns({"__da_short": condense(F.col("__da"), sentences), "__uk_short": condense(F.col("__uk"), sentences)})


def _base(da_title: Column, uk_title: Column, head: str) -> Column:
    return F.concat(F.lit(head + "🇩🇰 <b>"), da_title, F.lit("</b>\n\n\n🇺🇦 <b>"), uk_title, F.lit("</b>\n"))


def with_budget(items: DataFrame, most: int = CAPTION_MAX, sentences: int = SENTENCES, least: int = MIN_PER_LANGUAGE, min_total: int = MIN_TOTAL, head: str = CAPTION_HEAD) -> DataFrame:
    """items with `photo_budget`, a struct of titles and summaries as a caption has them, their budgets, and whether a caption has enough room.

    Titles give way first, if no 40 characters would be left. Of what is left each summary has its least share, at most half, and the rest
    goes by their lengths. Reads title, title_ukrainian, danish, ukrainian and content.
    """
    most = most if 0 < most <= CAPTION_MAX else CAPTION_MAX
    sentences, least, min_total = sentences if sentences > 0 else SENTENCES, least if least > 0 else MIN_PER_LANGUAGE, min_total if min_total > 0 else MIN_TOTAL
    names = list(items.columns)
    one = _with_summaries(items, sentences).withColumn("__title", trim(F.coalesce(F.col("title"), F.lit(""))))
    kept = {"da_title": F.col("__title"), "uk_title": _or(F.col("title_ukrainian"), F.col("__title")), "da": F.col("__da"), "uk": F.col("__uk"), "da_short": F.col("__da_short"), "uk_short": F.col("__uk_short")}
    one = one.withColumn("__b", F.struct(*[c.alias(k) for k, c in kept.items()]))
    b = F.col("__b")
    crowded = F.char_length(_base(b["da_title"], b["uk_title"], head)) >= most - 40
    each = max(20, most - len(head) - 8 - 40) // 2
    one = one.withColumn("__t", F.struct(*[F.when(crowded, trim_to_words(b[k], each)).otherwise(b[k]).alias(k) for k in ("da_title", "uk_title")]))
    t = F.col("__t")
    room = F.lit(most) - F.char_length(_base(t["da_title"], t["uk_title"], head))
    one = one.withColumn("__room", room).withColumn("__avail", F.greatest(room, F.lit(40)))
    floor = F.least(F.lit(least), F.expr("__avail div 2").cast("int"))
    one = one.withColumn("__floor", floor).withColumn("__rem", F.greatest(F.col("__avail") - 2 * F.col("__floor"), F.lit(0)))
    one = one.withColumns({"__nd": F.char_length(b["da_short"]), "__nu": F.char_length(b["uk_short"])})
    shared = (F.col("__nd") + F.col("__nu") > 0) & (F.col("__rem") > 0)
    total = "greatest(__nd + __nu, 1)"
    da_budget = F.when(shared, F.expr(f"__floor + (__rem * __nd) div {total}")).otherwise(F.expr("__avail div 2")).cast("int")
    uk_budget = F.when(shared, F.expr(f"__floor + (__rem * __nu) div {total}")).otherwise(F.expr("__avail - __avail div 2")).cast("int")
    one = one.withColumns({"__db": da_budget, "__ub": uk_budget})
    enough = (b["da"] != "") & (b["uk"] != "") & (b["da_short"] != "") & (b["uk_short"] != "") & (F.col("__nd") + F.col("__nu") >= min_total) & (F.col("__room") >= 40) & (F.col("__db") >= least) & (F.col("__ub") >= least)
    fields = [t["da_title"].alias("da_title"), t["uk_title"].alias("uk_title"), b["da_short"].alias("da_short"), b["uk_short"].alias("uk_short"), F.col("__room").alias("room"), F.col("__db").alias("da_budget"), F.col("__ub").alias("uk_budget"), enough.alias("enough")]
    return one.select(*names, F.struct(*fields).alias("photo_budget"))


def caption(budget: Column, most: int = CAPTION_MAX, head: str = CAPTION_HEAD) -> Column:
    """The caption of a with_budget() struct; cut hard, with an ellipsis, if it is still too long."""
    most = most if 0 < most <= CAPTION_MAX else CAPTION_MAX
    da, uk = trim_to_words(budget["da_short"], budget["da_budget"]), trim_to_words(budget["uk_short"], budget["uk_budget"])
    text = F.concat(F.lit(head + "🇩🇰 <b>"), budget["da_title"], F.lit("</b>\n"), da, F.lit("\n\n🇺🇦 <b>"), budget["uk_title"], F.lit("</b>\n"), uk)
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def with_message(items: DataFrame, low: int = 2, high: int = 2, head: str = TEXT_HEAD) -> DataFrame:
    """items with `text_message`: a block for each language and the link; the greater number of sentences is used."""
    names = list(items.columns)
    one = _with_summaries(items, max(low if low > 0 else 2, high))
    title = F.coalesce(F.col("title"), F.lit(""))

    def part(text: Column, before: str, after: str) -> Column:
        return F.when(text == "", "").otherwise(F.concat(F.lit(before), text, F.lit(after)))

    link = F.coalesce(F.col("link"), F.lit(""))
    tail = F.when(trim(link) == "", "").otherwise(F.concat(F.lit("\n🔗 "), link))
    parts = [part(title, "🇩🇰 <b>", "</b>\n"), part(F.col("__da_short"), "", "\n\n"), part(_or(F.col("title_ukrainian"), title), "🇺🇦 <b>", "</b>\n"), part(F.col("__uk_short"), "", "\n")]
    return one.select(*names, F.concat(F.lit(head), *parts, tail).alias("text_message"))


def posts(items: DataFrame, policy: str = "hybrid", sentences: int = 2) -> DataFrame:
    """items with use_photo and message, by the posting policy: a caption where there is an image and room, unless the policy is text-only."""
    policy = policy.strip().lower() or "hybrid"
    held = with_budget(with_message(items, sentences, sentences))
    photo = F.lit(policy in ("photo-only", "hybrid")) & (trim(F.coalesce("image_url", F.lit(""))) != "") & F.col("photo_budget")["enough"]
    return held.withColumns({"use_photo": photo, "message": F.when(photo, caption(F.col("photo_budget"))).otherwise(F.col("text_message"))}).drop("photo_budget", "text_message")


def preview(row: dict[str, Column]) -> Column:
    """Title, summaries that there are, and a line."""
    uk, da = (F.coalesce(row[k], F.lit("")) for k in ("ukrainian", "danish"))
    return F.concat(F.lit("🇩🇰 *"), row["title"], F.lit("*\n"), F.when(uk == "", "").otherwise(F.concat(F.lit("🇺🇦 "), uk, F.lit("\n"))), F.when(da == "", "").otherwise(F.concat(F.lit("🇩🇰 "), da, F.lit("\n"))), F.lit(LINE * 26))


def single(row: dict[str, Column], most: int = 1500, number: Column | None = None) -> Column:
    """An item of a digest: linked title, with its number if given, and summaries within so many bytes."""
    mark = F.when(row["category"] == "ukraine", "🔥").otherwise("📰")
    n = F.lit("") if number is None else F.concat(F.lit("<b>"), number.cast("string"), F.lit(".</b> "))
    uk, da = (F.coalesce(row[k], F.lit("")) for k in ("ukrainian", "danish"))
    body = F.concat(F.when(uk == "", "").otherwise(F.concat(F.lit("🇺🇦 <i>"), limit_bytes(uk, most), F.lit("</i>\n"))), F.when(da == "", "").otherwise(F.concat(F.lit("🇩🇰 "), limit_bytes(da, most), F.lit("\n"))))
    return F.concat(mark, F.lit(" "), n, F.lit('<a href="'), row["link"], F.lit('">'), row["title"], F.lit("</a>\n"), body, F.lit("➖" * 10 + "\n\n"))


def single_message(row: dict[str, Column], most: int = 1000, foot: str = "") -> Column:
    """An item as a message of its own: heading, group, linked title and summaries within so many bytes."""
    ukraine = row["category"] == "ukraine"
    uk, da = (F.coalesce(row[k], F.lit("")) for k in ("ukrainian", "danish"))
    body = F.concat(F.when(uk == "", "").otherwise(F.concat(F.lit("🇺🇦 <i>"), limit_bytes(uk, most), F.lit("</i>\n\n"))), F.when(da == "", "").otherwise(F.concat(F.lit("🇩🇰 "), limit_bytes(da, most), F.lit("\n\n"))))
    group = F.when(ukraine, "🇺🇦 <b>УКРАЇНА В ДАНІЇ</b>").otherwise("🇩🇰 <b>НОВИНИ</b>")
    title = F.concat(F.when(ukraine, "🔥").otherwise("📰"), F.lit(' <a href="'), row["link"], F.lit('">'), row["title"], F.lit("</a>\n\n"))
    return F.concat(F.lit(TEXT_HEAD.rstrip("\n") + "\n" + LINE * 15 + "\n\n"), group, F.lit("\n\n"), title, body, F.lit(LINE * 15 + "\n" + foot))


def _heading(flag: str, words: str) -> str:
    return f"{flag} <b>{words}</b>\n\n"


DIGEST = (("ukraine", _heading("🇺🇦", "УКРАЇНА В ДАНІЇ")), ("denmark", "\n" + _heading("🇩🇰", "ВАЖЛИВІ НОВИНИ")), ("", "\n" + _heading("🌍", "ІНШІ НОВИНИ")))


def _group() -> Column:
    return F.when(F.col("category") == "ukraine", 0).when(F.col("category") == "denmark", 1).otherwise(2)


def digest_items(items: DataFrame, most: int) -> DataFrame:
    """The items that digest() takes; summaries need be made for these alone."""
    return items.orderBy(_group(), "ord").limit(most)


def digest(items: DataFrame, most: int) -> DataFrame:
    """One row: the message. Items on Ukraine come first, then on Denmark, then others, each by `ord`, numbered through up to `most`. A
    heading stands if a number was left for its group."""
    row = {c: F.col(c) for c in ("title", "link", "category", "ukrainian", "danish")}
    first = digest_items(items, most).withColumn("__g", _group())
    numbered = first.withColumn("__n", F.row_number().over(Window.orderBy("__g", "ord")))
    made = numbered.select("__g", "__n", single(row, 1500, F.col("__n")).alias("text"))
    one = made.agg(F.array_sort(F.collect_list(F.struct("__g", "__n", "text"))).alias("rows"))

    def part(g: int) -> Column:
        mine = F.filter("rows", lambda x: x["__g"] == g)
        before = F.size(F.filter("rows", lambda x: x["__g"] < g))
        head = F.when(F.lit(g == 0) | (before < most), DIGEST[g][1]).otherwise("")
        return F.concat(head, F.array_join(F.transform(mine, lambda x: x["text"]), ""))

    return one.select(F.concat(F.lit("🇩🇰 <b>Новини</b> 🇺🇦\n" + LINE * 40 + "\n\n"), part(0), part(1), part(2), F.lit("\n" + LINE * 40 + "\n")).alias("message"))
