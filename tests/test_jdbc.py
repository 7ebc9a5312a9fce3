import uuid

import pytest
from pyspark.sql import functions as F

from feedloom.operators import ledger
from feedloom.sources import jdbc


@pytest.fixture
def url(spark):
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def test_ledger_in_a_database(spark, url):
    assert jdbc.create_tables(spark, url) == ["sent_news", "translation_cache"]
    assert jdbc.create_tables(spark, url) == []
    rows = [(f"{k:x}{k}", f"t{k}", f"l{k}", "c", "s") for k in range(16)]
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.substr("title", F.lit(2)).cast("int") * 3600)
    first = spark.createDataFrame(rows, "hash string, title string, link string, category string, source string").withColumn("sent_at", at)
    jdbc.append_table(first, url, "sent_news")
    for parts in (1, 5, 40):
        assert sorted(r.hash for r in jdbc.read_table(spark, url, "sent_news", parts=parts).collect()) == sorted(r[0] for r in rows)
    assert jdbc.read_table(spark, url, "sent_news", "category = 'none'").count() == 0
    now = F.timestamp_seconds(F.lit(1_704_067_200 + 50 * 3600))
    old = jdbc.read_table(spark, url, "sent_news")
    assert {r.name: r.value for r in ledger.stats(old, now).collect()}["active_items"] == 13
    new = spark.createDataFrame([("00", "again", "l", "c", "s"), ("zz", "new", "l", "c", "s")], "hash string, title string, link string, category string, source string").withColumn("sent_at", now)
    after = [r.asDict() for r in ledger.upserted(old, new).collect()]
    jdbc.write_table(spark.createDataFrame(after, first.schema), url, "sent_news")
    got = {r.hash: r.title for r in jdbc.read_table(spark, url, "sent_news").collect()}
    assert len(got) == 17 and got["zz"] == "new" and got["00"] == "t0"
    assert jdbc.create_tables(spark, url) == []
