"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary labelled documents, give a word's probability after the word before it and, within the word,
each character's after the characters so far, by language. Counts are continuation counts: a word counts once for each distinct word before
it and a pair once for each distinct word before that, so that a passage copied many times counts once. Where the two classes' counts of a
word, a word's beginning or a pair are apart by more than chance (SIGMAS standard deviations, whatever the number of labels), each class
keeps its own discounted count and backs off with its discounted mass; everything else takes the distribution that both classes share. So a
rare form is known by its stem, and what is rare by accident says nothing. The shared backoff counts are of all documents: a word counts
once for each document that holds it.

A document's score is the difference of the two log-likelihoods by its words, PRIOR_WORDS of which say nothing; documents from the score on
that does best on held-out labels are toxic. The classes are fitted on a bounded, balanced sample of the labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chars, Runs, columns, fresh, mix, ranges, run_hashes, ship, slices, words, written

#: Labelled documents of a class that the classifier is fitted on, at most; and held-out ones that its threshold is fitted on.
MAX_CLASS = 20_000
MAX_HELD_OUT = 20_000
#: One labelled document in so many is held out.
FOLDS = 5
#: What is counted less often, in both classes together, takes the shared distribution; so does what is apart by fewer standard deviations.
LEAST, SIGMAS = 3, 4.0
#: Words without evidence that a text is taken to have besides its own, so that a short one needs more than a doubtful word.
PRIOR_WORDS = 50
#: Characters of a word that are steps of their own; a longer word's rest is one step.
MAX_DEPTH = 24
#: Characters that a text may go on with, for those never seen after what precedes them.
SIGNS = 100
BROADCAST_ROWS = 1_000_000
#: Prefixes that a worker holds before it passes on their sums.
HELD = 1 << 21
_END = np.uint64(0x5BD1E995)


class Tokens:
    """The words of some texts: hashes, those within their language, and the index of each one's document."""

    def __init__(self, lang: pa.Array, text: pa.Array):
        names = Chars(lang.cast(pa.string()).fill_null(""))
        self.roots = mix(run_hashes(names.cp, names.off[:-1], names.off[1:])) | np.uint64(1)
        chars = Chars(pc.utf8_lower(text))
        self.cp, self.text, self.n = chars.cp, chars.text, len(text)
        self.starts, self.ends, self.doc = words(chars)
        self.runs = Runs(self.cp)
        self.h = self.runs(self.starts, self.ends)

    def own(self) -> np.ndarray:
        return mix(self.h + self.roots[self.doc])

    def before(self, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What comes before each word; `first`, by document, before its first."""
        out = np.empty_like(w)
        out[1:] = w[:-1]
        new = np.ones(len(w), bool)
        new[1:] = self.doc[1:] != self.doc[:-1]
        out[new] = first[self.doc[new]]
        return out


def _steps(length: np.ndarray) -> np.ndarray:
    return np.minimum(length, MAX_DEPTH)


def _ended(h: np.ndarray) -> np.ndarray:
    return mix(h + _END)


def _expand(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All beginnings of the words, and the words as ended: word's index, hash, hash of the beginning one step shorter, and steps."""
    n, d = len(starts), _steps(ends - starts)
    row, k = np.repeat(np.arange(n), d), ranges(np.ones(n, np.int64), d)
    runs = Runs(cp)
    h = runs(starts[row], starts[row] + k)
    up = np.zeros(len(h), np.uint64)
    up[1:] = h[:-1]
    up[k == 1] = 0
    last = h[np.cumsum(d) - 1]
    whole = runs(starts, ends)
    at = np.arange(n)
    return np.concatenate([at, row, at]), np.concatenate([np.zeros(n, np.uint64), h, _ended(whole)]), np.concatenate([np.zeros(n, np.uint64), up, last]), np.concatenate([np.zeros(n, np.int64), k, d + 1])


def _member(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The index of each hash in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


class Keys:
    """The beginnings that are counted LEAST times or more, by language: sorted hashes, and the languages' roots."""

    def __init__(self, key: np.ndarray, roots: np.ndarray):
        self.key, self.roots = key, roots
        self.bits: np.ndarray | None = None

    def __getstate__(self):
        return self.key, self.roots

    def __setstate__(self, state):
        self.__init__(*state)

    def find(self, h: np.ndarray) -> np.ndarray:
        if self.bits is None:
            self.bits = np.zeros(1 << 24, bool)
            self.bits[self.key >> np.uint64(40)] = True
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.bits[h >> np.uint64(40)])
        out[maybe] = _member(self.key, h[maybe])
        return out

    def settle(self, t: Tokens) -> Tokens:
        """Give each document whose language has no labels, or is null, that language which has most of its words."""
        strange = np.flatnonzero(_member(self.roots, t.roots) < 0)
        if len(strange) and len(self.roots):
            row = np.full(t.n, -1, np.int64)
            row[strange] = np.arange(len(strange))
            mine = np.flatnonzero(row[t.doc] >= 0)
            h, doc = _ended(t.h[mine]), row[t.doc[mine]]
            has = np.stack([np.bincount(doc[self.find(mix(h + r)) >= 0], minlength=len(strange)) for r in self.roots])
            t.roots[strange] = self.roots[has.argmax(0)]
        return t

    def deepest(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the distinct words by language: the deepest node and the steps beyond it; then each word's hash and the index of its distinct one."""
        own = t.own()
        _, first, which = np.unique(own, return_index=True, return_inverse=True)
        s, e, root, h = t.starts[first], t.ends[first], t.roots[t.doc[first]], t.h[first]
        d = _steps(e - s)
        node = self.find(mix(_ended(h) + root))
        left = np.zeros(len(node), np.int64)
        rest = np.flatnonzero(node < 0)
        low, high = np.zeros(len(rest), np.int64), d[rest].copy()
        at = self.find(mix(root[rest]))
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_] + 1) // 2
            r = rest[open_]
            got = self.find(mix(t.runs(s[r], s[r] + mid) + root[r]))
            there = got >= 0
            low[open_[there]], at[open_[there]] = mid[there], got[there]
            high[open_[~there]] = mid[~there] - 1
        node[rest] = at
        left[rest] = (e - s)[rest] + 1 - low
        return node, left, own, which


@dataclass
class Trie:
    """The counts of the beginnings: each one's parent, steps, counts and numbers of continuations. Row 0 of a pair is toxic."""

    keys: Keys
    parent: np.ndarray
    depth: np.ndarray
    n: np.ndarray
    kids: np.ndarray


def trie_of(root: np.ndarray, bare: np.ndarray, up: np.ndarray, depth: np.ndarray, n: np.ndarray, kids: np.ndarray) -> Trie:
    key = mix(bare + root)
    order = np.argsort(key)
    parent = np.maximum(_member(key[order], mix(up + root)[order]), 0)
    return Trie(Keys(key[order], np.sort(root[depth == 0])), parent, depth[order], n[:, order], kids[:, order])


@dataclass
class Model:
    """Logarithms by node of the trie: the shared probability of the beginning and of going on as never seen, and what either class's are
    above these; then the pairs of words that classes differ in."""

    keys: Keys
    base: np.ndarray
    ratio: np.ndarray
    tail: np.ndarray
    rest: np.ndarray
    context: np.ndarray
    context_rest: np.ndarray
    pair: np.ndarray
    pair_n: np.ndarray
    pair_back: np.ndarray
    threshold: float = 0.0

    def word_lp(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Each word's log-probability in either class, and its hash within its language."""
        node, left, own, which = self.keys.deepest(t)
        on = left > 0
        lp = (self.base[node] + self.ratio[:, node]).astype(float)
        lp[:, on] += self.tail[node[on]] + self.rest[:, node[on]] - np.maximum(left[on] - 1, 0) * np.log(SIGNS)
        return lp[:, which], own

    def log_likelihoods(self, lang: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, and its log-likelihood in either class."""
        t = self.keys.settle(Tokens(lang, text))
        lp, own = self.word_lp(t)
        if len(self.context) and len(own):
            u = t.before(own, t.roots)
            c = _member(self.context, u)
            near = np.flatnonzero(c >= 0)
            p = _member(self.pair, _pair(u[near], own[near]))
            hit = near[p >= 0]
            lp[:, near[p < 0]] += self.context_rest[:, c[near[p < 0]]]
            lp[:, hit] = np.log(self.pair_n[:, p[p >= 0]] + self.pair_back[:, p[p >= 0]] * np.exp(lp[:, hit]))
        return np.bincount(t.doc, minlength=t.n)[: t.n], np.bincount(t.doc, lp[0], t.n)[: t.n], np.bincount(t.doc, lp[1], t.n)[: t.n]

    def score(self, lang: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size, toxic, ordinary = self.log_likelihoods(lang, text)
        return size, toxic, ordinary, (toxic - ordinary) / (size + PRIOR_WORDS)


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(u) + w)


def _apart(n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Whether the first of two counts is apart from its expected share of both by more than chance."""
    both = n.sum(0)
    return (both >= LEAST) & (share > 0) & (share < 1) & (np.abs(n[0] - both * share) >= SIGMAS * np.sqrt(both * share * (1 - share)))


def estimate(trie: Trie, seen: np.ndarray, discount: np.ndarray) -> Model:
    """The model without pairs. seen: documents' distinct words that end at each node, over all documents."""
    up, depth, step = trie.parent, trie.depth, trie.depth > 0
    shared, k = seen.astype(float), len(seen)
    for d in range(int(depth.max(initial=0)), 0, -1):
        np.add.at(shared, up[depth == d], shared[depth == d])
    shared_p = np.where(step, (shared + 0.5 / SIGNS) / (shared[up] + 0.5), 1.0)
    known = np.bincount(up[step], shared[step], k)
    tail = np.log((shared - known + 0.5) / (shared + 0.5) / SIGNS)
    total = trie.n[:, up]
    kept = step & _apart(trie.n, total[0] / np.maximum(total.sum(0), 1))
    back = np.where(trie.n > 0, np.minimum(discount[:, None] * trie.kids / np.maximum(trie.n, 1), 1), 1)
    p = np.maximum(trie.n - discount[:, None], 0) / np.maximum(total, 1) + back[:, up] * shared_p
    gone = np.bincount(up[kept], shared_p[kept], k)
    rest = np.stack([np.log(np.maximum(1 - np.bincount(up[kept], x[kept], k), 1e-9) / np.maximum(1 - gone, 1e-9)) for x in p])
    rest[:, gone == 0] = 0
    own = np.where(kept, np.log(p / shared_p), rest[:, up])
    base, ratio = np.zeros(k), np.zeros((2, k))
    for d in range(1, int(depth.max(initial=0)) + 1):
        at = np.flatnonzero(depth == d)
        base[at] = base[up[at]] + np.log(shared_p[at])
        ratio[:, at] = ratio[:, up[at]] + own[:, at]
    none = np.zeros(0, np.uint64)
    single = [x.astype(np.float32) for x in (base, ratio, tail, rest)]
    return Model(trie.keys, *single, none, np.zeros((2, 0)), none, np.zeros((2, 0)), np.zeros((2, 0)))


def _samples(docs: DataFrame, labels: DataFrame, max_class: int, max_held_out: int) -> DataFrame | None:
    """part (0 ordinary, 1 toxic: to fit on; 2 and 3: held out), lang and text of the sampled labelled documents; None if a class has none."""
    lab = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.filter("text is not null and doc_id is not null").select("doc_id").distinct()
    lab = written(lab.join(known, "doc_id").select("doc_id", (F.col("toxic") > 0).alias("toxic"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).alias("fold"), F.xxhash64("doc_id", F.lit(7)).alias("draw")))
    counts = {r.toxic: r.n for r in lab.filter("fold > 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = min(counts.get(True, 0), counts.get(False, 0), max_class)
    if not n:
        return None

    def drawn(rows: DataFrame, most: int, part) -> DataFrame:
        return rows.orderBy("draw", "doc_id").limit(most).select("doc_id", part.alias("part"))

    pick = drawn(lab.filter("fold > 0 and toxic"), n, F.lit(1)).union(drawn(lab.filter("fold > 0 and not toxic"), n, F.lit(0)))
    pick = pick.union(drawn(lab.filter("fold = 0"), max_held_out, F.when(F.col("toxic"), 3).otherwise(2)))
    # At most two classes and the held-out rows, whose numbers are bounded above.
    small = F.broadcast(pick) if 2 * max_class + max_held_out <= BROADCAST_ROWS else pick
    return written(docs.join(small, "doc_id").select("part", "lang", "text"))


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def fit(docs: DataFrame, labels: DataFrame, max_class: int = MAX_CLASS, max_held_out: int = MAX_HELD_OUT) -> Model | None:
    """The models and the threshold, from doc_id, lang and text of documents and doc_id and toxic of labels; None where a class has no
    documents with words."""
    sample = _samples(docs, labels, max_class, max_held_out)
    if sample is None:
        return None
    train = sample.filter("part < 2")
    vocabulary = _vocabulary(train)
    ones = vocabulary.agg(*[F.count_if(F.col(c) == k) for c in ("n1", "n0") for k in (1, 2)]).first()
    discount = np.array([a / (a + 2 * b) if a else 0.75 for a, b in ((ones[0], ones[1]), (ones[2], ones[3]))])
    nodes = _nodes(vocabulary).toArrow()
    count = lambda *names: np.stack([nodes.column(x).to_numpy().astype(float) for x in names])
    n = count("n1", "n0")
    if not n.size or not n.max(1).all():
        return None
    trie = trie_of(*[_unsigned(nodes.column(x)) for x in ("root", "bare", "up")], nodes.column("depth").to_numpy(), n, count("k1", "k0"))
    model = estimate(trie, shared_counts(docs, trie.keys), discount)
    roots = trie.n[:, trie.keys.find(mix(trie.keys.roots))]
    del trie, nodes
    _add_pairs(model, roots, train, vocabulary, discount)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, k in slices(batch.column(2)):
                part = batch.slice(at, k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(part.column(1), part.column(2))[3])], names=["part", "score"])

    got = sample.filter("part > 1").mapInArrow(scored, "part int, score double").toArrow()
    shared.destroy()
    model.threshold = best_threshold(got.column(1).to_numpy(), got.column(0).to_numpy() == 3)
    return model


def _vocabulary(train: DataFrame) -> DataFrame:
    """w, root, word, n1 and n0 (distinct words before it in either class), and its pairs (u, n1, n0) that are counted LEAST times or more."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, k in slices(batch.column(2)):
                part = batch.slice(at, k)
                t = Tokens(part.column(1), part.column(2))
                w = t.own()
                u = t.before(w, t.roots)
                x = (t.before(u, t.roots) & ~np.uint64(1)) | part.column(0).to_numpy().astype(np.uint64)[t.doc]
                _, one = np.unique(mix(_pair(x, u)) + w, return_index=True)
                yield pa.RecordBatch.from_arrays([_long(w[one]), _long(u[one]), _long(x[one])], names=["w", "u", "x"])

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, k in slices(batch.column(2)):
                part = batch.slice(at, k)
                t = Tokens(part.column(1), part.column(2))
                w, one = np.unique(t.own(), return_index=True)
                text = [t.text[a:b] for a, b in zip(t.starts[one].tolist(), t.ends[one].tolist())]
                yield pa.RecordBatch.from_arrays([_long(w), _long(t.roots[t.doc[one]]), pa.array(text, pa.string())], names=["w", "root", "word"])

    # All groupings below hold within the one partitioning by w.
    rows = train.mapInArrow(contexts, "w bigint, u bigint, x bigint").repartition("w").distinct()
    toxic = F.col("x").bitwiseAND(F.lit(1)) == 1
    pairs = rows.groupBy("w", "u").agg(F.count_if(toxic).alias("a"), F.count_if(~toxic).alias("b"))
    often = F.when(F.col("a") + F.col("b") >= LEAST, F.struct("u", F.col("a").alias("n1"), F.col("b").alias("n0")))
    counted = pairs.groupBy("w").agg(F.count_if(F.col("a") > 0).alias("n1"), F.count_if(F.col("b") > 0).alias("n0"), F.collect_list(often).alias("pairs"))
    spelling = train.mapInArrow(spelt, "w bigint, root bigint, word string").dropDuplicates(["w"])
    return written(counted.join(spelling, "w"))


def _nodes(vocabulary: DataFrame) -> DataFrame:
    """root, bare, up and depth of the beginnings counted LEAST times or more, their counts and their numbers of continuations by class."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            root, bare, up, depth, a, b = (np.concatenate(x) for x in zip(*held))
            _, first, group = np.unique(mix(bare + root), return_index=True, return_inverse=True)
            held.clear()
            n = [pa.array(np.bincount(group, x, len(first)).astype(np.int64)) for x in (a, b)]
            return pa.RecordBatch.from_arrays([_long(root[first]), _long(bare[first]), _long(up[first]), pa.array(depth[first].astype(np.int32)), *n], names=["root", "bare", "up", "depth", "n1", "n0"])

        for batch in batches:
            for at, k in slices(batch.column(1)):
                part = batch.slice(at, k)
                chars = Chars(part.column(1))
                row, bare, up, depth = _expand(chars.cp, chars.off[:-1], chars.off[1:])
                root, a, b = (part.column(c).to_numpy() for c in (0, 2, 3))
                held.append((root.view(np.uint64)[row], bare, up, depth, a[row], b[row]))
                if sum(len(x[0]) for x in held) > HELD:
                    yield out()
        if held:
            yield out()

    schema = "root bigint, bare bigint, up bigint, depth int, n1 bigint, n0 bigint"
    nodes = vocabulary.select("root", "word", "n1", "n0").mapInArrow(expand, schema).groupBy("root", "bare").agg(F.first("up").alias("up"), F.first("depth").alias("depth"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    zero = F.lit(0).cast("bigint")
    as_node = F.struct(F.col("bare").alias("at"), "up", "depth", "n1", "n0", zero.alias("k1"), zero.alias("k0"))
    of_parent = F.struct(F.col("up").alias("at"), F.lit(None).cast("bigint").alias("up"), F.lit(None).cast("int").alias("depth"), zero.alias("n1"), zero.alias("n0"), (F.col("n1") > 0).cast("bigint").alias("k1"), (F.col("n0") > 0).cast("bigint").alias("k0"))
    both = nodes.select("root", F.explode(F.when(F.col("depth") > 0, F.array(as_node, of_parent)).otherwise(F.array(as_node))).alias("s")).select("root", "s.*")
    total = both.groupBy("root", F.col("at").alias("bare")).agg(F.max("up").alias("up"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n1", "n0", "k1", "k0")])
    return total.filter(F.col("n1") + F.col("n0") >= LEAST)


def shared_counts(docs: DataFrame, keys: Keys) -> np.ndarray:
    """For every node, the words that end their way there, each once for every document that holds it, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own.key), np.int64)
        for batch in batches:
            for at, k in slices(batch.column(1)):
                t = own.settle(Tokens(batch.column(0).slice(at, k), batch.column(1).slice(at, k)))
                node, _, _, which = own.deepest(t)
                key = np.unique(t.doc * max(len(node), 1) + which)
                total += np.bincount(node[key % max(len(node), 1)], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["node", "n"])

    got = docs.filter("text is not null").select("lang", "text").mapInArrow(count, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(len(keys.key))
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def _add_pairs(model: Model, roots: np.ndarray, train: DataFrame, vocabulary: DataFrame, discount: np.ndarray) -> None:
    """Give the model the pairs whose counts the words' own probabilities don't explain. roots: the classes' counts of all words by language."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at, k in slices(batch.column(2)):
                part = batch.slice(at, k)
                chars = Chars(part.column(2))
                t = Tokens.__new__(Tokens)
                t.starts, t.ends, t.doc, t.n, t.runs = chars.off[:-1], chars.off[1:], np.arange(k), k, Runs(chars.cp)
                t.roots, t.h = part.column(1).to_numpy().view(np.uint64), t.runs(t.starts, t.ends)
                lp, w = m.word_lp(t)
                lists = part.column(3)
                row = np.repeat(np.arange(k), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                u, a, b = (x.to_numpy() for x in lists.flatten().flatten())
                n = np.stack([a, b]).astype(float)
                odds = roots[:, np.maximum(_member(m.keys.roots, t.roots[row]), 0)] * np.exp(lp[:, row])
                ok = _apart(n, odds[0] / np.maximum(odds.sum(0), 1e-300))
                yield pa.RecordBatch.from_arrays([pa.array(u[ok]), _long(w[row[ok]]), pa.array(n[0, ok]), pa.array(n[1, ok]), pa.array(lp[0, row[ok]]), pa.array(lp[1, row[ok]])], names=["u", "w", "n1", "n0", "p1", "p0"])

    got = vocabulary.filter(F.size("pairs") > 0).select("w", "root", "word", "pairs").mapInArrow(wanted, "u bigint, w bigint, n1 double, n0 double, p1 double, p0 double").toArrow()
    shared.destroy()
    if not len(got):
        return
    u, w = _unsigned(got.column("u")), _unsigned(got.column("w"))
    n, lp = (np.stack([got.column(f"{c}{k}").to_numpy() for k in (1, 0)]) for c in "np")
    context = np.unique(u)

    def following(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, k in slices(batch.column(2)):
                part = batch.slice(at, k)
                t = Tokens(part.column(1), part.column(2))
                own = t.own()
                u = t.before(own, t.roots)
                here = np.flatnonzero(_member(context, u) >= 0)
                x = (t.before(u, t.roots) & ~np.uint64(1)) | part.column(0).to_numpy().astype(np.uint64)[t.doc]
                yield pa.RecordBatch.from_arrays([_long(u[here]), _long(own[here]), _long(x[here])], names=["u", "w", "x"])

    toxic = F.col("x").bitwiseAND(F.lit(1))
    kinds = train.mapInArrow(following, "u bigint, w bigint, x bigint").distinct().groupBy("u", "w", toxic.alias("c")).agg(F.count("*").alias("n")).groupBy("u", "c").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
    at, c = _member(context, _unsigned(kinds.column("u"))), 1 - kinds.column("c").to_numpy()
    total, kind = np.zeros((2, len(context))), np.zeros((2, len(context)))
    total[c, at], kind[c, at] = kinds.column("n").to_numpy(), kinds.column("kinds").to_numpy()
    of = _member(context, u)
    odds = total[:, of] * np.exp(lp)
    ok = _apart(n, odds[0] / np.maximum(odds.sum(0), 1e-300))
    u, w, n, lp, of = u[ok], w[ok], n[:, ok], lp[:, ok], of[ok]
    back = np.where(total > 0, np.minimum(discount[:, None] * kind / np.maximum(total, 1), 1), 1)[:, of]
    first = np.maximum(n - discount[:, None], 0) / np.maximum(total[:, of], 1)
    k = len(context)
    rest = np.stack([np.maximum(1 - np.bincount(of, a + b * np.exp(p), k), 1e-9) / np.maximum(1 - np.bincount(of, np.exp(p), k), 1e-9) for a, b, p in zip(first, back, lp)])
    some = np.bincount(of, minlength=k) > 0
    model.context, model.context_rest = context[some], np.log(rest[:, some])
    pair = _pair(u, w)
    order = np.argsort(pair)
    model.pair, model.pair_n, model.pair_back = pair[order], first[:, order], back[:, order]


def best_threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    """The score from which on calling documents toxic has the best F1 over the labels, halfway to the next score below. It is above 0, as
    what isn't likelier to be toxic than ordinary never is; infinity where no score is, or no label is toxic."""
    order = np.argsort(-score, kind="stable")
    ranked = score[order]
    last = np.append(ranked[1:] != ranked[:-1], True) & (ranked > 0)
    if not toxic.any() or not last.any():
        return float("inf")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(score) + 1) + toxic.sum())
    at = np.flatnonzero(last)[f1[last].argmax()]
    return float((ranked[at] + max(ranked[at + 1], 0.0)) / 2) if at + 1 < len(ranked) else float(ranked[at])


def _labels(labels: DataFrame) -> DataFrame:
    return columns(labels, "doc_id", "toxic").selectExpr("cast(doc_id as bigint) doc_id", "cast(toxic as int) toxic")


def _base(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    lang = docs[f"`{lang_col}`"].cast("string") if lang_col.lower() in [c.lower() for c in docs.columns] else F.lit("")
    return docs.select(docs[f"`{id_col}`"].cast("bigint").alias("doc_id"), lang.alias("lang"), docs[f"`{text_col}`"].cast("string").alias("text"))


SCORED = "doc_id bigint, n_words bigint, toxic_ll double, ordinary_ll double, score double, toxic boolean"


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_class: int = MAX_CLASS, lang_col: str = "lang") -> DataFrame:
    """Every document's log-likelihood per word in either class, the score, and the verdict.

    A null text, or one without words, has null likelihoods and isn't toxic; nor is any document where a class has no labelled documents.
    A score at the threshold is toxic. A document in a language that has no labelled ones is
    read in that which has most of its words; without a column of languages all are in one. Rows that repeat are scored alike. Other columns are left out.
    """
    ship(docs.sparkSession)
    base = _base(docs, id_col, text_col, lang_col)
    model = fit(base, _labels(labels), max_class)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at, k in slices(batch.column(2)):
                size, a, b, score = m.score(batch.column(1).slice(at, k), batch.column(2).slice(at, k)) if m else (np.zeros(k, np.int64), np.zeros(k), np.zeros(k), np.zeros(k))
                none = size == 0
                one = np.maximum(size, 1)
                cols = [pa.array(x, mask=none) for x in (a / one, b / one, score)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, k), pa.array(size, pa.int64()), *cols, pa.array(~none & (score >= (m.threshold if m else 0)))], names=["doc_id", "n_words", "toxic_ll", "ordinary_ll", "score", "toxic"])

    return base.mapInArrow(run, SCORED)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_class: int = MAX_CLASS, lang_col: str = "lang") -> DataFrame:
    """docs but for the rows that scores() calls toxic; all columns stay as they are."""
    ship(docs.sparkSession)
    base = _base(docs, id_col, text_col, lang_col)
    model = fit(base, _labels(labels), max_class)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = fresh(docs, "text"), fresh(docs, "lang")
    at_text = len(docs.columns)
    names = list(docs.columns)
    language = docs[f"`{lang_col}`"].cast("string") if lang_col.lower() in [c.lower() for c in docs.columns] else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at, k in slices(batch.column(at_text)):
                part = batch.slice(at, k)
                size, _, _, score = m.score(part.column(at_text + 1), part.column(at_text))
                yield pa.RecordBatch.from_arrays(part.columns[:at_text], names=names).filter(pa.array((size == 0) | (score < m.threshold)))

    return docs.withColumns({text: docs[f"`{text_col}`"].cast("string"), lang: language}).mapInArrow(run, docs.schema)
