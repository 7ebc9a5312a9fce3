import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from feedloom.llm import toxicity

BAD = ["vilefool", "grossclod", "dimtoad", "rottenham"]


def corpus(n=900, seed=2):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(400)]
    weight = [1 / (k + 1) for k in range(len(vocab))]
    docs, truth = [], []
    for i in range(n):
        w = r.choices(vocab, weight, k=r.randint(30, 120))
        bad = i % 5 == 0
        if bad:
            for _ in range(max(2, len(w) // 25)):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        docs.append((i, " ".join(w)))
        truth.append(bad)
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus()
    labels = [(i, int(truth[i])) for i in range(0, 900, 2)]
    got = {r.doc_id: r for r in toxicity.scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    unseen = [i for i in range(900) if i % 2]
    found = [got[i].toxic for i in unseen]
    hits = sum(f and truth[i] for f, i in zip(found, unseen))
    assert len(got) == 900
    assert hits >= 0.9 * sum(truth[i] for i in unseen) and hits >= 0.9 * sum(found)


def test_rare_insults_and_fixed_preceding_words(spark):
    r = random.Random(6)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(400)]
    weight = [1 / (k + 1) for k in range(len(vocab))]

    def text(insult, fixed=False):
        w = r.choices(vocab, weight, k=20)
        for _ in range(2):
            at = r.randrange(len(w))
            w[at:at] = [vocab[0], insult] if fixed else [insult]
        return " ".join(w)

    # Of 2,600 toxic documents, 13 have an insult that no other has; 130 have one that always follows the commonest word.
    toxic = [text("scumwort") for _ in range(13)] + [text("mudbrain", True) for _ in range(130)] + [text(r.choice(BAD)) for _ in range(2457)]
    plain = [" ".join(r.choices(vocab, weight, k=22)) for _ in range(2600)]
    probes = [text("scumwort") for _ in range(40)] + [text("mudbrain", True) for _ in range(40)] + [" ".join(r.choices(vocab, weight, k=22)) for _ in range(400)]
    docs = list(enumerate(toxic + plain + probes))
    labels = [(i, int(i < len(toxic))) for i in range(len(toxic) + len(plain))]
    got = {x.doc_id: x.toxic for x in toxicity.scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    found = [got[i] for i in range(len(labels), len(docs))]
    assert sum(found[:40]) >= 36 and sum(found[40:80]) >= 36 and sum(found[80:]) <= 8


def test_rare_forms_of_a_stem_in_a_second_language(spark):
    r = random.Random(9)
    tongues = [["".join(r.choices(letters, k=r.randint(2, 4))) for _ in range(60)] for letters in ("abcdefgh", "klmnopqr")]

    def text(k, bad):
        w = [r.choice(tongues[k]) + r.choice(tongues[k]) for _ in range(r.randint(40, 90))]
        for _ in range(3 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(BAD) if k == 0 else "zorq" + r.choice(tongues[1]) + r.choice(["", r.choice(tongues[1])]))
        return " ".join(w)

    rows = [(i, ("xx", "yy")[k := i % 4 == 0], text(k, i % 5 == 0), i % 5 == 0) for i in range(2000)]
    labels = [(i, int(t)) for i, _, _, t in rows if i < 1200]
    second = [x for x in rows if x[0] < 1200 and x[3] and x[1] == "yy"]
    forms = [set(w for w in t.split() if w.startswith("zorq")) for _, _, t, _ in second]
    assert max(sum(f in x for x in forms) for f in set().union(*forms)) < 0.05 * sum(x[3] for x in rows[:1200])
    got = {x.doc_id: x.toxic for x in toxicity.scores(spark.createDataFrame([x[:3] for x in rows], "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    for lang in ("xx", "yy"):
        unseen = [x for x in rows if x[0] >= 1200 and x[1] == lang]
        assert sum(got[x[0]] for x in unseen if x[3]) >= 0.9 * sum(x[3] for x in unseen)
        assert sum(got[x[0]] for x in unseen if not x[3]) <= 0.02 * len(unseen)


def brute(samples, everything):
    """The models by plain counting of strings. samples: (language, text, class); everything: (language, text)."""
    import math
    import re
    from collections import defaultdict

    def seq(lang, t):
        return [(lang, w) for w in re.findall(r"[^\W_]+", t.lower())]

    tri = {1: set(), 0: set()}
    for lang, t, c in samples:
        s = [(lang, "<"), (lang, "<"), *seq(lang, t)]
        tri[c] |= set(zip(s, s[1:], s[2:]))
    pair, before = {c: defaultdict(int) for c in tri}, {c: defaultdict(int) for c in tri}
    for c in tri:
        for _, u, w in tri[c]:
            pair[c][u, w] += 1
        for _, w in pair[c]:
            before[c][w] += 1
    discount = {}
    for c in tri:
        v = list(before[c].values())
        discount[c] = v.count(1) / (v.count(1) + 2 * v.count(2)) if v.count(1) else 0.75

    def path(word):
        lang, w = word
        return [(lang, w[:k]) for k in range(len(w) + 1)] + [(lang, w + "$")]

    n = {c: defaultdict(int) for c in tri}
    for c in tri:
        for w, k in before[c].items():
            for p in path(w):
                n[c][p] += k
    nodes = {p for p in {*n[0], *n[1]} if n[0][p] + n[1][p] >= toxicity.LEAST}
    up = lambda p: (p[0], p[1][:-1])
    kids = {c: defaultdict(int) for c in tri}
    for c in tri:
        for p in n[c]:
            if p[1] and n[c][p]:
                kids[c][up(p)] += 1
    shared = defaultdict(int)
    for lang, t in everything:
        for w in set(seq(lang, t)):
            for p in path(w):
                if p not in nodes:
                    break
                shared[p] += 1

    def apart(a, b, share):
        both = a + b
        return both >= toxicity.LEAST and 0 < share < 1 and abs(a - both * share) >= toxicity.SIGMAS * math.sqrt(both * share * (1 - share))

    own = {p for p in nodes if p[1] and apart(n[1][p], n[0][p], n[1][up(p)] / (n[1][up(p)] + n[0][up(p)]))}
    under, known = defaultdict(list), defaultdict(int)
    for p in nodes:
        if p[1]:
            known[up(p)] += shared[p]
            if p in own:
                under[up(p)].append(p)

    def back(p):
        return (shared[p] + 0.5 / toxicity.SIGNS) / (shared[up(p)] + 0.5)

    def own_p(c, p):
        total = n[c][up(p)]
        mass = min(discount[c] * kids[c][up(p)] / total, 1) if total else 1
        return max(n[c][p] - discount[c], 0) / max(total, 1) + mass * back(p)

    def left(c, p):
        return (1 - sum(own_p(c, q) for q in under[p])) / (1 - sum(back(q) for q in under[p])) if under[p] else 1

    def word_p(c, w):
        out, steps = 1.0, path(w)
        for k, p in enumerate(steps[1:], 1):
            if p not in nodes:
                q = steps[k - 1]
                unseen = (shared[q] - known[q] + 0.5) / (shared[q] + 0.5) / toxicity.SIGNS
                return out * unseen * left(c, q) * toxicity.SIGNS ** -(len(steps) - 1 - k)
            out *= own_p(c, p) if p in own else back(p) * left(c, up(p))
        return out

    total, follow = {c: defaultdict(int) for c in tri}, {c: defaultdict(int) for c in tri}
    for c in tri:
        for (u, _), k in pair[c].items():
            total[c][u] += k
            follow[c][u] += 1
    found = defaultdict(list)
    for u, w in {*pair[0], *pair[1]}:
        a, b, p, q = pair[1][u, w], pair[0][u, w], word_p(1, w), word_p(0, w)
        by_word, by_both = ([x[1](z) * p, x[0](z) * q] for x, z in (({c: n[c].__getitem__ for c in tri}, (w[0], "")), ({c: total[c].__getitem__ for c in tri}, u)))
        if apart(a, b, by_word[0] / sum(by_word)) and apart(a, b, by_both[0] / sum(by_both)):
            found[u].append(w)

    def pair_p(c, u, w):
        mass = min(discount[c] * follow[c][u] / total[c][u], 1) if total[c][u] else 1
        return max(pair[c][u, w] - discount[c], 0) / max(total[c][u], 1) + mass * word_p(c, w)

    def ll(lang, t, c):
        s, out = [(lang, "<"), *seq(lang, t)], 0.0
        for u, w in zip(s, s[1:]):
            if w in found[u]:
                out += math.log(pair_p(c, u, w))
            else:
                out += math.log(word_p(c, w))
                if found[u]:
                    out += math.log((1 - sum(pair_p(c, u, x) for x in found[u])) / (1 - sum(word_p(c, x) for x in found[u])))
        return out

    return ll, sum(map(len, found.values())), len(own)


def test_model_matches_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FOLDS", 1_000_000_007)
    docs, truth = corpus(500, 4)
    often = [w for w, _ in Counter(w for _, t in docs for w in t.split()).most_common(6)]
    docs = [(i, ("xx", "yy")[i % 3 == 0], " ".join([f"w{i}", *often[4:], f"w{i}", *often[4:], t] if truth[i] else [*often[4:0:-1], t])) for i, t in docs]
    labels = [(i, int(t)) for i, t in enumerate(truth)]
    d, l = spark.createDataFrame(docs, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = [(r.lang, r.text, r.part) for r in toxicity._samples(d, l, 100, 10).collect() if r.part < 2]
    assert len(rows) == 200
    ll, n_pairs, n_own = brute(rows, [x[1:] for x in docs])
    model = toxicity.fit(d, l, 100)
    assert len(model.pair) == n_pairs > 0 and n_own > 5
    probes = [x[1:] for x in docs[:12]] + [("xx", "never seen"), ("yy", "vilefool vilefoolish Grossclod"), ("xx", "")]
    size, a, b = model.log_likelihoods(pa.array([x[0] for x in probes]), pa.array([x[1] for x in probes]))
    assert a.tolist() == pytest.approx([ll(*x, 1) for x in probes]) and b.tolist() == pytest.approx([ll(*x, 0) for x in probes])
    assert size.tolist() == [len(x[1].split()) for x in probes]


def test_other_languages_and_ties(spark):
    docs, truth = corpus(400)
    rows = [(i, "xx", t) for i, t in docs[:300]] + [(i, (None, "zz", "xx")[i % 3], t) for i, t in docs[300:]]
    labels = [(i, int(truth[i])) for i in range(300)]
    d, l = spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(d, l).collect()}
    for k in range(3):
        unseen = [i for i in range(300, 400) if i % 3 == k]
        assert sum(got[i].toxic == truth[i] for i in unseen) >= 0.9 * len(unseen)
    threshold = toxicity.best_threshold(np.array([0.5, 0.5, 0.5, 0.1]), np.array([True, True, False, False]))
    assert 0.1 < threshold <= 0.5
    assert toxicity.best_threshold(np.array([0.5, 0.5]), np.array([True, False])) == 0.5
    # Without evidence, or with evidence against, nothing is toxic.
    assert toxicity.best_threshold(np.array([0.0, -1.0, -2.0]), np.array([True, True, False])) == np.inf
    assert toxicity.best_threshold(np.array([0.4, 0.0, 0.0]), np.array([True, True, False])) == 0.2
    assert toxicity.best_threshold(np.array([0.4]), np.array([False])) == np.inf


def test_few_labels_reject_nothing_by_default(spark):
    docs, truth = corpus(60)
    plain = [(i, t) for i, t in docs if not truth[i]]
    # The labels say nothing of the words.
    labels = [(i, k % 2) for k, (i, _) in enumerate(plain)]
    got = toxicity.scores(spark.createDataFrame(plain, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert sum(r.toxic for r in got) <= 0.1 * len(got)


def test_a_class_with_one_document(spark):
    docs, _ = corpus(30)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for toxic in ([0], list(range(30))):
        l = spark.createDataFrame([(i, int(i in toxic)) for i in range(30)], "doc_id long, toxic int")
        assert toxicity.scores(d, l).count() == 30


def test_awkward_rows(spark):
    docs, truth = corpus(500)
    rows = [(i, t, "x", 1.5, None) for i, t in docs] + [(None, "a b", None, None, None), (1000, None, "y", 0.0, None), (1001, "", "y", 0.0, None), (0, docs[0][1], "x", 1.5, None), (1002, "long word " * 100_000, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double, __text int")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)] + [(None, 1), (3, None), (0, 1), (5555, 1)], "doc_id long, toxic int")
    got = toxicity.scores(df, labels).collect()
    assert len(got) == len(rows)
    assert all(not r.toxic and r.score is None for r in got if r.doc_id in (1000, 1001))
    kept = toxicity.without_toxic(df, labels)
    assert kept.columns == df.columns and kept.schema == df.schema
    want = sorted((str(r.doc_id) for r in got if not r.toxic))
    assert sorted(str(r.doc_id) for r in kept.collect()) == want and len(want) < len(rows)


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert not toxicity.scores(df, none).first().toxic and toxicity.without_toxic(df, none).count() == 1
    assert toxicity.scores(df.limit(0), none).count() == 0
