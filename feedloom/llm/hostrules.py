"""Quality rules at the level of hosts.

Each document is put to a few rules. Failures are counted by host, and each host's failure rate is shrunk towards the rate of all hosts by a
beta prior whose mean and strength are fitted to the hosts by moments. A host is bad whose shrunk rate is too high, or far out in that prior. The host's verdict goes
back to its documents: one that fails several rules is rejected anywhere, one that fails a single rule only on a bad host, and one that
fails none never.

Repetition of words and word triples is a verdict of its own, which accepted() adds: verdicts() is held against SQL and has the six rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Chars, columns, fresh, mix, run_hashes, ship, slices, words, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
SYMBOLS = "#$%&*+/<=>@\\^_`{|}~!"
MAX_UPPER, MAX_SYMBOLS, MAX_RUNS, MAX_BARS, MIN_DISTINCT_LINES = 0.4, 0.05, 0.1, 0.1, 0.7
MIN_WORD, MAX_WORD = 2.0, 20.0
RULES = ("upper", "symbols", "runs", "bars", "lines", "word_length")
#: A host is bad if its shrunk rate of documents that fail any rule is above this, or so many standard deviations of the prior above its mean.
MAX_HOST_RATE, HOST_SIGMAS = 0.5, 3.0
#: Failures that reject a document on any host.
REJECT_AT = 2
#: The prior's strength, in documents, where hosts don't differ by more than chance.
STRONGEST = 1e6
LEAST_VARIANCE = 1e-9
#: A text of MIN_WORDS or more repeats itself if its commonest word has more than this share of its words, or if more than this share of its
#: word triples were met before in it. A text that is there twice over stays below that.
MIN_WORDS, MAX_TOP_WORD, MAX_REPEATED = 20, 0.3, 0.5


def flags(text: Column) -> dict[str, Column]:
    """Whether a text fails each rule. A null or blank text fails none but `word_length`."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    n_words = n - F.char_length(F.replace(t, F.lit(" "), F.lit(""))) + F.lit(1)
    lines = F.filter(F.split(t, "\n"), lambda x: F.char_length(x) >= 20)
    n_lines, distinct = F.size(lines), F.size(F.array_distinct(lines))
    mean = (n - n_words + 1) / n_words

    def share(kind: str) -> Column:
        return (n - F.char_length(F.translate(t, kind, ""))) / F.greatest(n, F.lit(1))

    return {
        "upper": share(UPPER) > MAX_UPPER,
        "symbols": share(SYMBOLS) > MAX_SYMBOLS,
        "runs": F.regexp_count(t, F.lit("[#$%&*!?~^+]{2,}")) / n_words > MAX_RUNS,
        "bars": F.regexp_count(t, F.lit(" [|*#•] ")) / n_words > MAX_BARS,
        "lines": (n_lines >= 4) & (distinct / F.greatest(n_lines, F.lit(1)) < MIN_DISTINCT_LINES),
        "word_length": (mean < MIN_WORD) | (mean > MAX_WORD),
    }


def _counts(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each distinct (document, key) is met, and its document."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return np.diff(np.append(at, len(key))), doc[at]


def repetitive(text: pa.Array) -> np.ndarray:
    """Whether each text repeats its words or word triples too much."""
    chars = Chars(pc.utf8_lower(text))
    starts, ends, doc = words(chars)
    h, k = run_hashes(chars.cp, starts, ends), len(text)
    n = np.bincount(doc, minlength=k)
    count, of = _counts(h, doc)
    top = np.zeros(k)
    np.maximum.at(top, of, count)
    at = np.flatnonzero(doc[2:] == doc[:-2])
    count, of = _counts(mix(mix(mix(h[at]) + h[at + 1]) + h[at + 2]), doc[at])
    repeated = np.bincount(of, count - 1, minlength=k)
    return (n >= MIN_WORDS) & ((top > MAX_TOP_WORD * n) | (repeated > MAX_REPEATED * (n - 2)))


def judged(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, host, fail_<rule> as 0 or 1, and n_failed."""
    base = columns(docs, id_col, text_col, host_col).toDF("doc_id", "text", "host").selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", "cast(host as string) host")
    found = base.select("doc_id", "host", *[c.cast("int").alias(f"fail_{k}") for k, c in flags(F.col("text")).items()])
    return found.withColumn("n_failed", sum((F.col(f"fail_{r}") for r in RULES[1:]), F.col(f"fail_{RULES[0]}")))


def host_table(found: DataFrame) -> DataFrame:
    """host, n_docs, fails_<rule>, fails_any, host_rate (shrunk), host_bound and host_bad of what judged() gave. A null host is a host of its own."""
    any_ = (F.col("n_failed") > 0).cast("int")
    hosts = found.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(f"fail_{r}").alias(f"fails_{r}") for r in RULES], F.sum(any_).alias("fails_any"))
    rate = F.col("fails_any") / F.col("n_docs")
    stats = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n_docs")).alias("per"))
    # What the hosts' rates vary by beyond the chance of their numbers; one row, however many hosts there are.
    between = F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("per")
    strength = F.when(between <= LEAST_VARIANCE, STRONGEST).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(STRONGEST), F.col("m") * (1 - F.col("m")) / between - 1)))
    prior = stats.select("m", strength.alias("s"))
    shrunk = (F.col("fails_any") + F.col("m") * F.col("s")) / (F.col("n_docs") + F.col("s"))
    bound = F.least(F.lit(MAX_HOST_RATE), F.round(F.col("m") + HOST_SIGMAS * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("s") + 1)), 6))
    rated = hosts.crossJoin(F.broadcast(prior)).withColumns({"host_rate": F.round(shrunk, 6), "host_bound": bound})
    return rated.withColumn("host_bad", F.col("host_rate") > F.col("host_bound")).drop("m", "s")


def _rejects(n_failed: Column, bad: Column) -> Column:
    return (n_failed >= REJECT_AT) | ((n_failed >= 1) & bad)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Every document's failures, its host's shrunk failure rate and verdict, and whether it is rejected.

    A null or empty text fails `word_length` alone. A null host is a host of its own. Rows that repeat are all counted. Other columns are
    left out.
    """
    found = written(judged(docs, id_col, text_col, host_col))
    hosts = written(host_table(found).select(F.col("host").alias("h"), "host_rate", "host_bound", "host_bad"))
    return found.join(hosts, found.host.eqNullSafe(hosts.h)).drop("h").withColumn("rejected", _rejects(F.col("n_failed"), F.col("host_bad")))


def domain(url: Column) -> Column:
    """The host of a URL, in lower case, without user, port, final dot and a leading "www."; null where there is none."""
    authority = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r":\d*$|\.(:\d*)?$", "")
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def with_domain(pages: DataFrame, url_col: str = "url", host_col: str = "source") -> DataFrame:
    """pages with the URL's domain as host_col, for verdicts() and accepted()."""
    return pages.withColumn(host_col, domain(pages[f"`{url_col}`"].cast("string")))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs but for the rows that verdicts() rejects and for repetitive() texts; all columns stay as they are. A null text is kept on any
    host, though it counts for its host as in verdicts().

    The rules are put to each text once: the rows are written with their numbers of failures, from which the hosts are judged. Only hosts
    with bad verdicts are joined. Where `lines` fails, lines that repeat are its matter, and repetition is looked for in the distinct ones.
    """
    ship(docs.sparkSession)
    n, text = fresh(docs, "failed"), fresh(docs, "text")
    own = docs[f"`{text_col}`"].cast("string")
    fails = flags(own)
    # Each rule's result is a bit.
    bits = sum((c.cast("int") * (1 << i) for i, c in enumerate(fails.values())), F.lit(0))
    held = written(docs.withColumn(n, bits))
    count = F.bit_count(F.col(n))
    found = held.select(held[f"`{host_col}`"].cast("string").alias("host"), count.alias("n_failed"), *[F.col(n).bitwiseAND(F.lit(1 << i)).cast("boolean").cast("int").alias(f"fail_{r}") for i, r in enumerate(fails)])
    bad = written(host_table(found).filter("host_bad").select("host"))
    at = len(docs.columns) + 1
    names = [*docs.columns, n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, k in slices(batch.column(at)):
                part = batch.slice(begin, k)
                yield pa.RecordBatch.from_arrays(part.columns[:at], names=names).filter(pa.array(~repetitive(part.column(at))))

    mine = held[f"`{text_col}`"].cast("string")
    lines = F.col(n).bitwiseAND(F.lit(1 << list(fails).index("lines"))) > 0
    once = F.when(lines, F.array_join(F.array_distinct(F.split(mine, "\n")), "\n")).otherwise(mine)
    rest = held.filter(mine.isNull() | (count < REJECT_AT))
    rest = rest.withColumn(text, once).mapInArrow(run, StructType([*docs.schema.fields, held.schema[n]]))
    name = fresh(docs, "host")
    bad = bad.withColumnRenamed("host", name)
    judged_by = rest[f"`{host_col}`"].cast("string").eqNullSafe(bad[name]) & (rest[n] > 0) & rest[f"`{text_col}`"].isNotNull()
    return rest.join(bad, judged_by, "left_anti").drop(n)


def sql(table: str = "documents") -> str:
    """DuckDB SQL of verdicts()."""
    bare = {"t": "coalesce(text, '')"}
    symbols = SYMBOLS.replace("'", "''")
    fails = ", ".join(f"sum(fail_{r}) fails_{r}" for r in RULES)
    total = " + ".join(f"fail_{r}" for r in RULES)
    return f"""
with base as (select doc_id, source host, {bare['t']} t from {table}),
 sized as (select *, length(t) n, length(t) - length(replace(t, ' ', '')) + 1 w, list_filter(string_split(t, chr(10)), lambda x: length(x) >= 20) lines from base),
 found as (select doc_id, host,
  ((n - length(translate(t, '{UPPER}', ''))) / greatest(n, 1) > {MAX_UPPER})::int fail_upper,
  ((n - length(translate(t, '{symbols}', ''))) / greatest(n, 1) > {MAX_SYMBOLS})::int fail_symbols,
  (len(regexp_extract_all(t, '[#$%&*!?~^+]{{2,}}')) / w > {MAX_RUNS})::int fail_runs,
  (len(regexp_extract_all(t, ' [|*#•] ')) / w > {MAX_BARS})::int fail_bars,
  (len(lines) >= 4 and len(list_distinct(lines)) / greatest(len(lines), 1) < {MIN_DISTINCT_LINES})::int fail_lines,
  ((n - w + 1) / w < {MIN_WORD} or (n - w + 1) / w > {MAX_WORD})::int fail_word_length from sized),
 counted as (select *, {total} n_failed from found),
 hosts as (select host, count(*) n_docs, {fails}, sum((n_failed > 0)::int) fails_any from counted group by host),
 stats as (select avg(fails_any / n_docs) m, coalesce(var_samp(fails_any / n_docs), 0) v, avg(1 / n_docs) per from hosts),
 prior as (select m, case when v - m * (1 - m) * per <= {LEAST_VARIANCE} then {STRONGEST} else greatest(0, least({STRONGEST}, m * (1 - m) / (v - m * (1 - m) * per) - 1)) end s from stats),
 judged as (select host, round((fails_any + m * s) / (n_docs + s), 6) host_rate, least({MAX_HOST_RATE}, round(m + {HOST_SIGMAS} * sqrt(m * (1 - m) / (s + 1)), 6)) host_bound from hosts, prior)
select doc_id, c.host, {', '.join(f'fail_{r}' for r in RULES)}, n_failed, host_rate, host_bound, host_rate > host_bound host_bad,
 n_failed >= {REJECT_AT} or (n_failed >= 1 and host_rate > host_bound) rejected
from counted c join judged j on c.host is not distinct from j.host
"""
