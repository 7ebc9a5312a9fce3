"""The ledger of sent items and the translation cache in a relational database, over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_COLUMNS = "hash varchar(64) not null primary key, title varchar(2000) not null, link varchar(2000) not null, category varchar(50), source varchar(100), sent_at timestamp not null"
CACHE_COLUMNS = "content_hash varchar(64) not null primary key, title varchar(2000) not null, content varchar(20000) not null, summary varchar(20000), danish_translation varchar(20000), ukrainian_translation varchar(20000), ai_provider varchar(50), created_at timestamp not null, last_used_at timestamp not null, use_count integer"
TABLES = {
    "sent_news": (LEDGER_COLUMNS, {"idx_sent_news_sent_at": "sent_at", "idx_sent_news_link": "link"}),
    "translation_cache": (CACHE_COLUMNS, {"idx_translation_cache_created_at": "created_at"}),
}


def create_tables(spark: SparkSession, url: str) -> list[str]:
    """Make the tables and indexes that aren't there; the names of the tables made."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    made = []
    try:
        there, found = set(), connection.getMetaData().getTables(None, None, "%", None)
        while found.next():
            there.add(found.getString("TABLE_NAME").lower())
        statement = connection.createStatement()
        for name, (columns, indexes) in TABLES.items():
            if name not in there:
                statement.executeUpdate(f"create table {name} ({columns})")
                for index, column in indexes.items():
                    statement.executeUpdate(f"create index {index} on {name} ({column})")
                made.append(name)
        statement.close()
    finally:
        connection.close()
    return made


def _lower(df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(c.lower()) for c in df.columns])


def read_table(spark: SparkSession, url: str, table: str, where: str = "1 = 1", parts: int = 1) -> DataFrame:
    """The table's rows; conditions on them are pushed into the database. In parts, each reads the hashes of one first letter or more."""
    if parts <= 1:
        return _lower(spark.read.jdbc(url, table).filter(where))
    key = "hash" if table == "sent_news" else "content_hash"
    cuts = [f"{16 * i // min(parts, 16):x}" for i in range(1, min(parts, 16))]
    bounds = [f"{key} < '{cuts[0]}'", *[f"{key} >= '{a}' and {key} < '{b}'" for a, b in zip(cuts, cuts[1:])], f"{key} >= '{cuts[-1]}'"]
    return _lower(spark.read.jdbc(url, table, predicates=bounds).filter(where))


def write_table(df: DataFrame, url: str, table: str) -> None:
    """df as the table's rows, in place of all that are there, within the table as it was made."""
    df.write.option("truncate", "true").jdbc(url, table, mode="overwrite")


def append_table(df: DataFrame, url: str, table: str) -> None:
    df.write.jdbc(url, table, mode="append")
