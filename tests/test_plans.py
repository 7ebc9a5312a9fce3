import duckdb
import pytest
from pyspark.sql import functions as F

from feedloom.functions import layout
from feedloom.operators import dedup
from feedloom.plans import items as tables
from feedloom.plans import queries
from feedloom.plans.delivery import delivered
from feedloom.plans.flagship import curated
from feedloom.plans.options import Options, options


def test_options():
    got = options({"LIMIT": "3", "CAPTION_MAX": "-1", "caption_sentences": "5", "CAPTION_MIN_PER_LANGUAGE": "50", "text_sentences_max": "1", "ttl_hours": "x", "MODE": "single", "OTHER": "1"})
    assert got == Options(limit=3, mode="single")
    with pytest.raises(ValueError):
        options({"mode": "many"})


def items(spark):
    rows = [(i, t, d, "", f"https://www.a{i % 3}.dk/{i}", "", f"2024-01-01 0{i % 9}:00:00", f"s{i % 3}", "da") for i, (t, d) in enumerate([
        ("Ny software i Danmark", "danske robotter og software"), ("Ny software i Danmark i dag", "danske robotter igen"), ("Ukraine og Danmark", "ukrainere i danske byer"),
        ("Vejret i morgen", "vejr og sol i Danmark"), ("Kultur", "opera i København, danske scener"), ("Sport", "tennis"), ("Familier", "børn og barsel i danske hjem"),
    ])]
    return spark.createDataFrame(rows, "ord long, title string, description string, content string, link string, published_raw string, published string, source_name string, source_lang string").withColumn("published", F.col("published").cast("timestamp"))


def test_flagship_is_stable_under_partitioning(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    df = items(spark)
    got = [[tuple(r) for r in curated(df.repartition(n), now).orderBy("position").collect()] for n in (1, 7)]
    assert got[0] == got[1]
    assert [(r[1], r[4], r[5]) for r in got[0]] == [(0, "tech", 90), (2, "ukraine", 85), (6, "family", 65), (4, "culture", 45)]


def test_delivery(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    long = "A sentence of the summary that has some length to it, really. " * 3
    chosen = items(spark).filter("ord in (0, 2, 4)").select("ord", "title", "link", "source_name", F.lit("c").alias("category"), F.lit("").alias("title_ukrainian"), F.lit(long).alias("danish"), F.lit(long).alias("ukrainian"), F.lit("").alias("content"), F.lit("http://i/x.png").alias("image_url"), (F.col("ord") != 2).alias("send_ok"))
    empty = spark.createDataFrame([], "hash string, title string, link string, category string, source string, sent_at timestamp")
    made, after = delivered(chosen, empty, now)
    assert {r.ord: r.outcome for r in made.collect()} == {0: "sent", 2: "failed", 4: "sent"}
    assert all(r.use_photo for r in made.collect()) and after.count() == 2
    made, again = delivered(chosen, after, now)
    assert {r.ord: r.outcome for r in made.collect()} == {2: "failed"} and again.count() == 2
    one, _ = delivered(chosen, empty, now, Options(mode="single"))
    assert [r.ord for r in one.collect()] == [0]


def test_single_message(spark):
    df = spark.createDataFrame([("T", "http://l", "ukraine", "u" * 1200, "")], "title string, link string, category string, ukrainian string, danish string")
    m = df.select(layout.single_message({k: F.col(k) for k in df.columns}).alias("m")).first().m
    assert '🔥 <a href="http://l">T</a>' in m and "u" * 1000 + "..." in m and "🇩🇰 <b>Danish Feed" in m


def test_title_greedy_is_of_titles_with_words(spark, tmp_path):
    """A title without words isn't in the query, as it isn't in the SQL; the operator, and so flagship, keeps it."""
    rows = [(0, "Ö Ö"), (1, "One title here\nmore"), (2, "One title here\nother"), (3, "æ"), (4, "x")]
    docs = spark.createDataFrame([(k, t, "da", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.ord for r in queries.QUERIES["title_greedy"](spark, str(tmp_path)).collect()) == [1, 4]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(r[0] for r in con.execute(queries.ORACLE_SQL["title_greedy"]).fetchall()) == [1, 4]
    assert sorted(r.ord for r in dedup.distinct_titles(tables.items(spark, str(tmp_path))).collect()) == [0, 1, 3, 4]
