import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import bpe, rollup, secretscan


def prose(r, n):
    words = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through".split()
    return " ".join(r.choices(words, k=n))


def make(seed=1):
    r = random.Random(seed)
    docs, truth = [], []
    kinds = [("0123456789abcdef", 40), (string.ascii_letters + string.digits, 32), (string.ascii_letters + string.digits + "+/", 44), (string.ascii_uppercase + "234567", 32)]
    for i in range(200):
        t = prose(r, 80)
        if i % 5 == 0:
            abc, n = kinds[(i // 5) % 4]
            s = "".join(r.choices(abc, k=n))
            k = t.index(" ", len(t) // 2)
            t = f'{t[:k]} key = "{s}" {t[k:]}'
            truth.append((i, s))
        docs.append((i, t))
    plain = ["a" * 40, "0123456789abcdef" * 3, "internationalisationally", "1234567890" * 3, "well-known-and-much-loved-things", "----------------------", "understandinginformation"]
    docs += [(1000 + k, prose(r, 20) + " " + p + " é " + prose(r, 5)) for k, p in enumerate(plain)]
    return docs, truth


def test_finds_keys_and_leaves_text(spark):
    docs, truth = make()
    rows = secretscan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    text = dict(docs)
    got = {(r.doc_id, text[r.doc_id][r.start : r.end]) for r in rows}
    assert len(got & set(truth)) >= 0.95 * len(truth)
    assert not got - set(truth)


ALPHABETS = [string.digits, string.digits + "abcdef", string.digits + "ABCDEF", string.ascii_lowercase, string.ascii_uppercase, string.ascii_uppercase + "234567", string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase, string.ascii_uppercase + string.ascii_lowercase, string.ascii_uppercase + string.ascii_lowercase + string.digits, string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/_-"]


def two_sided(z):
    return math.erfc(abs(z) / math.sqrt(2))


def plain_battery(s):
    """Chi-squared, runs and serial correlation by their textbook formulas, one character at a time, and Fisher's method; 0 without encoding."""
    abc = next((a for a in ALPHABETS if set(s) <= set(a)), None)
    if abc is None:
        return None, 0.0
    k, n = len(abc), len(s)
    x = [abc.index(c) for c in s]
    chi = sum((x.count(v) - n / k) ** 2 / (n / k) for v in range(k))
    # The statistic's exact moments under uniformity, as those of a gamma; its cube root is nearly normal.
    mean, variance = k - 1, 2 * (k - 1) * (n - 1) / n
    shape = 2 * mean**2 / variance
    p = [two_sided(((chi / mean) ** (1 / 3) - 1 + 2 / (9 * shape)) / math.sqrt(2 / (9 * shape)))]
    above = [v * 2 >= k for v in x]
    up, down = sum(above), n - sum(above)
    if up and down:
        runs = 1 + sum(a != b for a, b in zip(above, above[1:]))
        expected = 2 * up * down / n + 1
        v = (expected - 1) * (expected - 2) / (n - 1)
        p.append(two_sided((runs - expected) / math.sqrt(v)) if v > 0 else 1.0)
    else:
        p.append(2 * 0.5**n)
    m = sum(x) / n
    power = sum((v - m) ** 2 for v in x)
    p.append(two_sided(sum((a - m) * (b - m) for a, b in zip(x, x[-1:] + x[:-1])) / power * math.sqrt(n)) if power else 0.0)
    h = -sum(math.log(max(v, 1e-300)) for v in p)
    return abc, math.exp(-h) * sum(h**j / math.factorial(j) for j in range(3))


def brute(docs):
    """Secrets by regular expressions and the textbook procedure over unrounded p-values, for candidates without separators."""
    signs = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/=_-"
    n = Counter(c for _, t in docs for c in t if c in signs)
    rate = {c: (n[c] + 1) / (sum(n.values()) + len(signs)) for c in signs}

    def power(s):
        """log10 of the least Chernoff bound, over four tilts, on the chance that ordinary characters are as improbable."""
        rare = -sum(math.log(rate[c]) for c in s)
        return min(0.0, *(-t * rare + len(s) * math.log(sum(q * q**-t for q in rate.values())) for t in (0.25, 0.5, 0.75, 1.0))) / math.log(10)

    found = [(i, m.start(), m.group(), m.group().strip("=-_")) for i, t in docs for m in re.finditer(r"[A-Za-z0-9+/=_-]{16,}", t)]
    p = {c: power(c) for _, _, _, c in found if len(c) >= 16}
    secret = set()
    for low, high in ((16, 24), (24, 32), (32, 48), (48, 10**9)):
        own = sorted((v, c) for c, v in p.items() if low <= len(c) < high)
        last = max((j for j, (v, _) in enumerate(own) if v <= math.log10(0.01 * (j + 1) / len(own))), default=-1)
        secret |= {c for _, c in own[: last + 1]}
    out = set()
    for i, s, whole, c in found:
        if c in secret:
            abc, r = plain_battery(c)
            if r >= 1e-4 and abc not in (string.digits, string.ascii_lowercase, string.ascii_uppercase):
                out.add((i, s, s + len(whole)))
    return out


def test_battery_is_the_textbooks():
    r = random.Random(8)
    strings = ["".join(r.choices(a, k=r.randint(16, 70))) for a in ALPHABETS for _ in range(40)] + ["a" * 20, "ab" * 20, "0" * 30, "é" * 20, "zzzzzzzzzzzzzzzzZ"]
    for s in strings:
        name, p = secretscan.battery(s)
        abc, want = plain_battery(s)
        assert p == pytest.approx(want, rel=1e-9) and (name == "none") == (abc is None)
        assert abc is None or sorted(secretscan.ENCODINGS[name]) == sorted(abc)


def test_matches_brute_force(spark):
    docs, _ = make(7)
    got = {(r.doc_id, r.start, r.end) for r in secretscan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and len(got) > 30


def test_battery_is_calibrated():
    rng = np.random.default_rng(0)
    for name in ("hex", "base62", "base64"):
        abc = secretscan.ENCODINGS[name]
        p = [secretscan.battery("".join(rng.choice(list(abc), 64)))[1] for _ in range(1500)]
        assert np.mean(np.array(p) < 0.05) < 0.12
        assert np.mean(np.array(p) < secretscan.MIN_RANDOM) < 0.005
    assert secretscan.battery("ab" * 20)[1] < 1e-4 and secretscan.battery("0123456789abcdef" * 2)[1] < 1e-4


def test_masks(spark):
    docs, truth = make(3)
    rows = [(i, t, len(t), "x", 1) for i, t in docs] + [(None, None, None, None, None), (5000, "", 0, "x", 1), (0, docs[0][1], len(docs[0][1]), "x", 1), (5001, "long text " * 50_000, 500_000, "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, start string, __text int")
    out = secretscan.masked(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len(rows)
    found = {i for i, _ in truth}
    for r in got:
        assert r.text is None or r.n_chars == len(r.text)
        assert not any(s in (r.text or "") for i, s in truth if i == r.doc_id)
        if r.doc_id not in found and r.doc_id is not None and r.doc_id < 5000:
            assert r.text == dict(docs)[r.doc_id]
    assert secretscan.masked(df.limit(0)).count() == 0 and secretscan.scan(df.limit(0)).count() == 0


def test_keys_glued_to_names_paths_and_words(spark):
    r = random.Random(11)
    hexa, full = "0123456789abcdef", string.ascii_letters + string.digits
    glue = [("api_key=", hexa, 40, ""), ("https://h.org/v1/keys/", hexa, 40, ""), ("https://h.org/?a=1&token=", full, 32, "&b=2"), ("password==", full + "+/", 43, "="), ("internationalization-", hexa, 20, ""), ("h.org/articles/", full + "-_", 43, "/edit")]
    docs, keys = [], {}
    for i in range(240):
        t = prose(r, 60)
        if i % 2:
            before, abc, n, after = glue[i // 2 % len(glue)]
            keys[i] = "".join(r.choices(abc, k=n))
            t += f" {before}{keys[i]}{after} " + prose(r, 5)
        else:
            t += " " + ["https://h.org/some/ordinary/path/of/words", "name=internationalisation", "a=b=c=d=e=f=g=h=i=j=k=l", "================="][i // 2 % 4]
        docs.append((i, t))
    docs.append((9000, "=" * 3))
    docs.append((9001, "ordinary"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    text = dict(docs)
    got = {x.doc_id: text[x.doc_id][x.start : x.end] for x in secretscan.scan(df).collect()}
    assert set(got) <= set(keys)
    for k in range(len(glue)):
        own = [i for i in keys if i // 2 % len(glue) == k]
        assert sum(keys[i] in got.get(i, "") for i in own) >= 0.9 * len(own), glue[k]
    assert all(not x.startswith(("api_key", "token", "password")) for x in got.values())
    clean = {x.doc_id: x.text for x in secretscan.masked(df).collect()}
    assert all((keys[i] in clean[i]) == (i not in got) for i in keys)


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, source string, lang string, tokenizer_version string, n_tokens long, old_tokens long, n_docs int, batch string")


def test_rollup_is_idempotent_and_additive(spark):
    kept = rollup.Rollup(spark)
    assert kept.totals().count() == 0
    r = random.Random(4)
    live, want = {}, Counter()
    for b in range(5):
        rows = []
        for _ in range(60):
            key = (r.choice(["a", "b", None]), r.choice(["en", None]), r.choice(["v1", "v2"]))
            op = r.choice(["insert", "insert", "delete", "revise"])
            if op == "insert":
                n = r.randrange(100)
                live.setdefault(key, []).append(n)
                rows.append((op, *key, n, None, 9, "x"))
            elif live.get(key):
                old = live[key].pop()
                if op == "revise":
                    live[key].append(old + 5)
                rows.append((op, *key, old + 5, old, 9, "x"))
        rows += [(None, "a", "en", "v1", 7, 7, 9, "x"), ("?", "a", "en", "v1", 7, 7, 9, "x"), ("insert", "z", "en", "v1", None, None, 9, "x"), ("delete", "z", "en", "v1", None, None, 9, "x")]
        assert kept.commit(f"b{b}", changes(spark, rows))
        assert not kept.commit(f"b{b}", changes(spark, rows))
        if b in (1, 3):
            kept.compact()
            assert not kept.commit("b0", changes(spark, rows))
        want = {k: (len(v), sum(v)) for k, v in live.items() if v}
        assert {(t.source, t.lang, t.tokenizer_version): (t.n_docs, t.n_tokens) for t in kept.totals().collect()} == want
    with pytest.raises(ValueError):
        kept.commit("../x", changes(spark, []))


@pytest.mark.parametrize("compacts", [False, True])
def test_two_writers_of_one_batch(spark, monkeypatch, compacts):
    one = rollup.Rollup(spark)
    other, real = rollup.Rollup(spark, one.uri), rollup.signed
    rows = changes(spark, [("insert", "a", "en", "v1", 5, None, 0, "x")])

    def slow(c):
        monkeypatch.setattr(rollup, "signed", real)
        assert other.commit("b", c)
        assert not compacts or other.compact()
        return real(c)

    monkeypatch.setattr(rollup, "signed", slow)
    assert not one.commit("b", rows)
    assert [(t.n_docs, t.n_tokens) for t in one.totals().collect()] == [(1, 5)]
    assert not other.commit("b", rows)


def test_two_compactions_and_what_they_leave(spark, monkeypatch):
    one = rollup.Rollup(spark)
    other = rollup.Rollup(spark, one.uri)
    rows = changes(spark, [("insert", "a", "en", "v1", 5, None, 0, "x")])
    assert all(one.commit(f"b{k}", rows) for k in range(3))
    sums = one._sums

    def slow(*x):
        one._sums = sums
        assert other.compact()
        return sums(*x)

    one._sums = slow
    assert not one.compact()
    assert one.totals().first().n_docs == 3
    assert one._names("batch-") == [] and len(one._names("data-")) == 1
    assert one.commit("b3", rows) and one.compact() and one.totals().first().n_docs == 4
    assert not one.commit("b1", rows)
    assert one.commit("b4", rows) and one.compact()
    assert len(one._names("snapshot-")) == len(one._names("data-")) == 2 and one.totals().first().n_docs == 5


def test_maintained_against_a_recount(spark):
    r = random.Random(5)
    docs = [(i, prose(r, r.randrange(30)), r.choice(["s1", "s2", None]), r.choice(["en", "de"])) for i in range(100)] + [(200, None, "s1", "en"), (7, "twice", "s1", "en"), (7, "twice", "s1", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").selectExpr("*", "'x' tokenizer_version", "3 n_tokens")
    c = bpe.codec(bpe.RANKS)
    import pyarrow as pa

    want = Counter(), Counter()
    for i, t, s, l in docs:
        n = int(c.count(pa.array([t or ""]))[0])
        if i % 10 != 3:
            want[0][s, l] += 1
            want[1][s, l] += n + (i % 10 == 7)
    got = rollup.maintained(df).collect()
    assert {(g.source, g.lang): (g.n_docs, g.n_tokens) for g in got} == {k: (want[0][k], want[1][k]) for k in want[0]}
    assert rollup.maintained(df.limit(0)).count() == 0
