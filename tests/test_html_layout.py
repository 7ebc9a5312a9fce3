import pytest
from pyspark.sql import functions as F

from feedloom.functions import html, layout

P = "A paragraph of the article that is long enough to count, number {}."


def page(body, head=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


def paragraphs(source, url="http://x.org/a"):
    t = html._Tree()
    t.feed(source)
    t.close()
    return html.paragraphs(t.nodes, url)


def test_unclosed_paragraphs_and_scripts():
    got = paragraphs(page("<script>var t='</p>';</script><article>" + "".join(f"<p>{P.format(i)}" for i in range(3)) + "<div>no</div></article>"))
    assert got == [P.format(i) for i in range(3)]
    assert paragraphs(page(f"<article><p><b>{P.format(1)}</b></p><p>x</p></article>")) == [P.format(1)] * 2  # by two selectors, as there are too few
    assert paragraphs("") == []


def test_sites():
    body = page("<div class='article-body big'><p>long enough one</p><p>tiny</p></div><article><p>other text here</p></article>")
    assert paragraphs(body, "https://ekstrabladet.dk/1") == ["long enough one"]
    assert paragraphs(body, "https://www.tv2.dk/1") == ["long enough one"]
    assert paragraphs(body, "https://bt.dk/1") == ["long enough one"]
    dr = page("<article><div class='dre-article-body'>" + "".join(f"<p>{P.format(i)}</p>" for i in range(7)) + "<p>Læs også: something else that is long</p></div></article>")
    assert paragraphs(dr, "https://www.dr.dk/1") == [P.format(i) for i in range(5)]
    few = page("".join(f"<p>{P.format(i)} And it goes on.</p>" for i in range(5)))
    assert len(paragraphs(few, "https://www.dr.dk/1")) == 3


def test_cleaning():
    assert html.clean_text("<p>Line one of it\ngoes on here and ends.</p>\nAll about cookies is left out\nshort") == "Line one of it goes on here and ends."
    # A junk phrase goes before lines are looked at, so what is left of its line stays.
    assert html.clean_text("The first sentence of it ends here.<br>Cookie rest of the line.") == "The first sentence of it ends here. rest of the line."
    # A junk line doesn't end a paragraph, a short one does.
    assert html.clean_text("first half of a sentence\nplease print this page now\nand its second half.") == "first half of a sentence and its second half."
    assert html.clean_text("first half of a sentence that is long\nx\nand its second half also is long") == "first half of a sentence that is long\n\nand its second half also is long"
    long = "\n".join(f"{'w' * 500}." for _ in range(5))
    assert html.clean_text(long).count("\n\n") == 2
    assert len(html.clean_text("y" * 3000 + ".")) == 3001
    assert html.clean_text("") == "" and html.clean_text("open <tag that never ends") == ""


def test_titles_and_images():
    t = html.extract(page("<h1> </h1><img src='/a.svg'><article><img srcset='/s.jpg 100w, /l.jpg 900w' src='/x.png'></article>", "<title>T</title>"), "http://h.org/p/q")
    assert t[0] == "T" and t[2] == "http://h.org/l.jpg"
    assert html.extract(page("", '<meta name="twitter:image" content="b.png"><meta property="og:image:url" content="/a.png">'), "http://h.org/p/q")[2] == "http://h.org/a.png"
    assert html.extract(page("<img data-src='data:x' src='http://c.org/cdn/1'>"), "http://h.org")[2] == "http://c.org/cdn/1"
    assert html.extract(None, None) == ("", "", "")


def test_image_columns(spark):
    rows = [("<IMG x='1' srcset='/s.jpg 1x, /t.jpg 2x' src='/u.png'>",), ("<img data-src=\"/d.png\" src='/u.png'>",), ("<img src='/u.png'>",), ("no",)]
    got = [r.u for r in spark.createDataFrame(rows, "h string").select(html.image_in_snippet(F.col("h")).alias("u")).collect()]
    assert got == ["/s.jpg", "/d.png", "/u.png", ""]
    s = spark.createDataFrame([("/a 10w, /b 90w, /c 90w",), ("/a, /b 1x",), ("",)], "s string").select(html.largest_of_srcset(F.col("s")).alias("u"))
    assert [r.u for r in s.collect()] == ["/b", "/a", ""]
    likely = spark.createDataFrame([("x.JPG",), ("data:image/png",), ("a.svg",), ("/images/x",), ("plain",), ("",)], "u string").select(html.is_likely_image(F.col("u")).alias("y"))
    assert [r.y for r in likely.collect()] == [True, False, False, True, False, False]
    e = spark.createDataFrame([([("text/html", "x"), ("IMAGE/png", "p")], "", "", "o"), ([("", "a.webp")], "", "", "o"), ([], "<img src='d'>", "", "o"), (None, "", "", "o"), (None, "", "", "")], "e array<struct<type:string,url:string>>, d string, c string, o string")
    assert [r.i for r in e.select(html.item_image(F.col("e"), F.col("d"), F.col("c"), F.col("o")).alias("i")).collect()] == ["p", "a.webp", "d", "o", ""]


def plain_budget(n_title, da, uk, most=1024, least=120):
    """Titles of equal length that needn't be cut."""
    room = most - len(layout.CAPTION_HEAD) - len("🇩🇰 <b>") - len("</b>\n\n\n🇺🇦 <b>") - len("</b>\n") - 2 * n_title
    available = max(room, 40)
    floor = min(least, available // 2)
    rem = max(available - 2 * floor, 0)
    if da + uk and rem:
        return room, floor + rem * da // (da + uk), floor + rem * uk // (da + uk)
    return room, available // 2, available - available // 2


COLUMNS = "title string, title_ukrainian string, danish string, ukrainian string, content string, link string, image_url string, category string"


@pytest.mark.parametrize("da,uk", [(300, 300), (500, 40), (20, 20)])
def test_budgets(spark, da, uk):
    s = lambda n: ("w" * (n - 1)) + "."
    df = spark.createDataFrame([("Title", "", s(da), s(uk), "", "l", "i", "c")], COLUMNS)
    b = layout.with_budget(df).first().photo_budget
    assert (b.room, b.da_budget, b.uk_budget) == plain_budget(5, da, uk)
    assert b.enough == (da + uk >= 180 and min(b.da_budget, b.uk_budget) >= 120)
    assert len(layout.with_budget(df).select(layout.caption(F.col("photo_budget")).alias("c")).first().c) <= 1024


def test_posts(spark):
    long = "A sentence of the summary that has some length to it, really. " * 3
    rows = [("T", "", long, long, "", "http://l", "http://i", "c"), ("T", "", long, long, "", "http://l", " ", "c"), ("T", None, None, "", "", None, "http://i", "c"), ("W " * 700, "", long, long, "", "l", "i", "c")]
    df = spark.createDataFrame(rows, COLUMNS)
    got = layout.posts(df).collect()
    assert [r.use_photo for r in got] == [True, False, False, False]  # titles cut to their share leave fewer than 40 characters
    assert got[1].message.endswith("\n🔗 http://l") and got[0].message.startswith(layout.CAPTION_HEAD)
    assert got[2].message == layout.TEXT_HEAD + "🇩🇰 <b>T</b>\n🇺🇦 <b>T</b>\n"
    assert not any(r.use_photo for r in layout.posts(df, "text-only").collect())


def test_digest(spark):
    rows = [(i, f"t{i}", "l", c, "u", "d") for i, c in enumerate(["tech", "ukraine", "denmark", "ukraine"])]
    df = spark.createDataFrame(rows, "ord long, title string, link string, category string, ukrainian string, danish string")
    full, short = layout.digest(df, 10).first().message, layout.digest(df, 2).first().message
    assert [full.index(f">t{i}<") for i in (1, 3, 2, 0)] == sorted(full.index(f">t{i}<") for i in range(4)) and "<b>4.</b>" in full
    assert "t2" not in short and "🌍" not in short
    assert layout.digest(df.limit(0), 5).first().message.startswith("🇩🇰")
    line = df.limit(1).select(layout.preview({k: F.col(k) for k in ("title", "ukrainian", "danish")}).alias("m")).first().m
    assert line.startswith("🇩🇰 *t0*\n🇺🇦 u\n🇩🇰 d\n")
