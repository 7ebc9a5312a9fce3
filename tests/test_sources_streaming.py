import pytest
from pyspark.sql import functions as F

from feedloom.sources import feeds
from feedloom.streaming import ledger_stream

YAML = """
feeds:
  - url: "https://a.dk/rss"
    name: "A"
    lang: "da"
    priority: 1
    active: true
    categories: ["x", "y"]
  - url: https://b.dk/rss
    name: B   # a comment
    lang: en
    active: false
    categories:
      - z
"""

RSS = """<?xml version="1.0"?><rss><channel><title>c</title>
<item><title>One</title><description>D &amp; e</description><link>http://a.dk/1</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0100</pubDate><enclosure url="http://a.dk/1.jpg" type="image/jpeg"/></item>
<item><title>Two</title><link>http://a.dk/2</link><pubDate>whenever</pubDate></item></channel></rss>"""


def test_feed_list(spark, tmp_path):
    at = tmp_path / "feeds.yaml"
    at.write_text(YAML)
    got = {r.name: r for r in feeds.sources(spark, str(at)).collect()}
    assert got["A"].categories == ["x", "y"] and got["A"].active and got["A"].priority == 1
    assert not got["B"].active and got["B"].categories == ["z"] and got["B"].url == "https://b.dk/rss"


def test_items_in_order(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "broken.xml").write_text("<rss><channel><item><title>never closed")
    fetched = spark.createDataFrame([("https://a.dk/rss", RSS, 0), ("https://b.dk/rss", RSS, 1), ("https://c.dk/rss", "<rss>broken", 2), ("https://d.dk/rss", None, 3)], "url string, body string, position int")
    sources = spark.createDataFrame([("https://a.dk/rss", "A", "da", 1, True, ["x"]), ("https://b.dk/rss", "B", "en", 1, False, ["y"]), ("https://c.dk/rss", "C", "en", 1, True, None)], feeds.SOURCE)
    rows = feeds.items(fetched, sources).orderBy("ord").collect()
    assert [r.title for r in rows] == ["One", "Two"] and rows[0].source_name == "A"
    assert rows[0].description == "D & e" and rows[0].enclosures[0].url == "http://a.dk/1.jpg"
    assert rows[0].published.isoformat() == "2024-01-01T09:00:00" or rows[0].published is not None
    assert rows[1].published is None and rows[1].published_raw == "whenever"


def test_ledger_sink_is_idempotent(spark, tmp_path):
    rows = [("a", "t", "l", "c", "s", "2024-01-01 00:00:00"), ("b", "t", "l", "c", "s", "2024-01-01 01:00:00"), ("a", "t", "l", "c", "s", "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "hash string, title string, link string, category string, source string, sent_at string").withColumn("sent_at", F.col("sent_at").cast("timestamp"))
    sent = []

    def send(batch):
        sent.extend(r.hash for r in batch.collect())
        return batch

    sink = ledger_stream.LedgerSink(spark, f"file://{tmp_path}/ledger", df.limit(0), send)
    sink(df.limit(2), 0)
    sink(df, 1)
    assert sorted(sent) == ["a", "b"] and sorted(r.hash for r in sink.ledger().collect()) == ["a", "b"]


def test_ledger_sink_remembers_after_a_restart(spark, tmp_path):
    schema = "hash string, title string, link string, category string, source string, sent_at timestamp"

    def batch(*hashes):
        return spark.createDataFrame([(h, "t", "l", "c", "s") for h in hashes], "hash string, title string, link string, category string, source string").withColumn("sent_at", F.timestamp_seconds(F.lit(1_704_067_200)))

    sent, uri, empty = [], f"file://{tmp_path}/ledger", spark.createDataFrame([], schema)

    def send(rows):
        sent.append(sorted(r.hash for r in rows.collect()))
        return rows

    ledger_stream.LedgerSink(spark, uri, empty, send)(batch("a"), 0)
    ledger_stream.LedgerSink(spark, uri, empty, send)(batch("a", "b"), 1)
    # A version that wasn't written whole is no version.
    (tmp_path / "ledger" / "v2").mkdir()
    again = ledger_stream.LedgerSink(spark, uri, empty, send, kept=1)
    assert again.versions() == [0, 1] and sorted(r.hash for r in again.ledger().collect()) == ["a", "b"]
    again(batch("a", "b"), 1)
    again(batch("c"), 2)
    assert sent == [["a"], ["b"], [], ["c"]]
    assert sorted(r.hash for r in again.ledger().collect()) == ["a", "b", "c"] and len(again.versions()) == 2


def test_shared_folder_is_named_or_local(spark):
    from types import SimpleNamespace

    from feedloom.operators.checkpoints import shared_base

    def session(master, base=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: base), sparkContext=SimpleNamespace(master=master))

    assert shared_base(session("yarn", "hdfs:///x/")) == "hdfs:///x"
    assert shared_base(session("local[4]")).startswith("file:///")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_base(session(master))


def test_stream_keeps_first_of_each_key(spark, tmp_path):
    rows = [(1, "k", "2024-01-01 00:00:00"), (2, "k", "2024-01-01 01:00:00"), (3, "m", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "ord long, k string, published string").withColumn("published", F.col("published").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run = ledger_stream.distinct_stream(stream, ["k"]).writeStream.format("memory").queryName("kept").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.k for r in spark.table("kept").collect()) == ["k", "m"]
