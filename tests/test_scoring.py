import itertools

import pytest
from pyspark.sql import functions as F

from feedloom.functions import scoring
from feedloom.functions.vocab import NEWS, contains_any
from feedloom.plans.items import DEMO

WORD = {"refugee": "refugee", "visa": "visumforlængelse", "ukraine": "ukraine", "denmark": "danske", "conflict": "putin", "tech": "robot", "ai": "llm", "medical": "medicin", "exclude": "vejr", "europe": "eu", "youth": "gaming", "parent": "barsel", "culture": "opera", "sports": "tennis", "politics": "minister", "economy": "bank", "environment": "klima", "education": "universitet"}


def expected(f):
    """The rules as plain conditions."""
    local = f["denmark"] or f["ukraine"] or f["europe"]
    if f["exclude"] or (f["conflict"] and not local):
        return "", 0
    if f["ukraine"] or f["refugee"] or f["visa"]:
        return "ukraine", 70 + 15 * f["denmark"] + 5 * f["europe"] - 15 * (f["conflict"] and not (f["refugee"] or f["visa"] or f["denmark"])) + 10 * f["tech"] + 10 * f["medical"]
    if f["tech"] or f["medical"]:
        return ("health" if f["medical"] else "tech", 80 + 10 * f["ai"] + 10 * f["denmark"] + 5 * f["europe"]) if local else ("", 0)
    for name, vocabulary, base, bonus in (("family", "parent", 55, 10), ("youth", "youth", 50, 8), ("culture", "culture", 35, 10), ("sports", "sports", 30, 8)):
        if f[vocabulary] and local:
            return name, base + bonus * f["denmark"]
    if f["denmark"]:
        return "denmark", 40 + 15 * f["politics"]
    if f["europe"]:
        return "europe", 25
    return next(((n, s) for n, s in (("economy", 20), ("environment", 25), ("education", 22)) if f[n]), ("", 0))


def test_every_branch(spark):
    combos = [c for n in range(4) for c in itertools.combinations(WORD, n)]
    rows = [(i, " ".join(WORD[k] for k in c), "") for i, c in enumerate(combos)] + [(-1, None, None)]
    got = {r.ord: (r.category, r.score) for r in scoring.scored(spark.createDataFrame(rows, "ord long, title string, description string")).collect()}
    assert got[-1] == ("", 0)
    seen = set()
    for i, c in enumerate(combos):
        text = rows[i][1]
        words = set(text.split())
        f = {k: any((t in words) if len(t.encode()) <= 3 else t in text for t in v) for k, v in NEWS.items()}
        assert got[i] == expected(f), c
        seen.add(got[i][0])
    assert seen == {"", "ukraine", "health", "tech", "family", "youth", "culture", "sports", "denmark", "europe", "economy", "environment", "education"}


def test_columns_named_like_vocabularies_stay(spark):
    df = spark.createDataFrame([(1, "robot i Danmark, danske", "", "mine", 7, "old")], "ord int, title string, description string, tech string, ai int, category string")
    got = scoring.scored(df)
    assert got.columns == ["ord", "title", "description", "tech", "ai", "category", "score"]
    row = got.first()
    assert (row.tech, row.ai, row.category, row.score) == ("mine", 7, "tech", 90)


@pytest.mark.parametrize("name", ["youth", "parent", "culture", "sports", "denmark"])
def test_vocabulary_sizes(name):
    assert len(NEWS[name]) == {"youth": 53, "parent": 58, "culture": 39, "sports": 38, "denmark": 19}[name]


def test_a_filter_by_score_has_no_flag_worked_out_twice(spark):
    """The texts in lower case and the vocabularies' searches stand as often in the plan with a filter as without."""
    rows = spark.createDataFrame([(0, "t", "d")], "ord long, title string, description string")

    def times(df, what: str) -> int:
        return df._jdf.queryExecution().optimizedPlan().toString().count(what)

    plain = scoring.scored(rows, DEMO).select("category", "score")
    chosen = scoring.scored(rows, DEMO).filter("score <> 0").select("category", "score")
    assert times(plain, "lower(") == times(chosen, "lower(") == 1
    assert times(plain, "exists(") == times(chosen, "exists(") > 0


def test_whole_words_between_any_signs(spark):
    words_ = ("it", "bø")
    texts = {"it": True, "x it y": True, "it.": True, "(it)\n": True, "æitø": True, " it ": True, "bit itx _it it_ 1it": False, "bits, it!": True, "bø": True, "abø bøa": False, "": False}
    df = spark.createDataFrame(list(texts.items()), "t string, want boolean")
    assert df.filter(contains_any(F.col("t"), words_) != F.col("want")).collect() == []
