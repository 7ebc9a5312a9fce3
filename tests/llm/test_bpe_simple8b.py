import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feedloom.llm import bpe, simple8b

SCHEMA = "doc_id long, text string, ids string, starts int"
TEXTS = ["", "don't stop", " 's \n\n x  y", "日本é😀 ’", "a" * 300_000, "I'LL we'll 've''s", "<|endoftext|> x", "tab\t end ", "\n", " "]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(bpe.TOKENIZER)
    t.encode_special_tokens = True
    return t


def test_encode_matches_library(spark, whole):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "a b", None, None), (99, None, None, None), (0, "", "x", 1)]
    got = bpe.encode_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[99].ids is None and by[99].decoded is None and by[99].n_tokens is None
    for i, t in enumerate(TEXTS):
        e = whole.encode(t, add_special_tokens=False)
        assert by[i].ids == e.ids and by[i].decoded == t and by[i].n_tokens == len(e.ids)
        for (a, b), i_ in zip(zip(by[i].starts, by[i].ends), e.ids):
            assert 0 <= a < b <= len(t)
        if t.isascii():
            assert "".join(t[a:b] for a, b in zip(by[i].starts, by[i].ends)) == t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("'strevlmdS 1\n\té日😀! 　_")), max_size=5))
def test_codec_property(texts):
    whole = Tokenizer.from_file(bpe.TOKENIZER) if not hasattr(test_codec_property, "t") else test_codec_property.t
    test_codec_property.t = whole
    for path in (bpe.TOKENIZER, bpe.RANKS):
        c = bpe.codec(path)
        ids, off, chars = c.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        assert c.decode(ids, off).to_pylist() == texts
        assert c.count(pa.array(texts, pa.string())).tolist() == np.diff(off).tolist()


def test_every_code_point_is_cut_as_the_library_does(whole):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1 {chr(c)}{chr(c)}. " for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    c = bpe.codec(bpe.TOKENIZER)
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        ids, off, _ = c.encode(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [e.ids for e in whole.encode_batch(part, add_special_tokens=False)]


def test_decode_split_characters(spark):
    c = bpe.codec(bpe.TOKENIZER)
    ids, off, chars = c.encode(pa.array(["x😀y"]))
    starts, ends = c.offsets(ids, off, chars)
    assert len(ids) > 3 and all(starts[k] == 1 and ends[k] == 2 for k in range(1, len(ids) - 1))
    df = spark.createDataFrame([(1, ids.tolist()), (2, ids[:2].tolist()), (3, None), (4, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode_documents(df).collect()}
    assert got[1] == "x😀y" and got[3] is None and got[4] == "" and got[2].startswith("x") and "�" in got[2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 70000), st.integers(-(1 << 63), (1 << 63) - 1), st.just(0)), max_size=700), max_size=4))
def test_simple8b_round_trip(lists):
    ids = np.array([x for l in lists for x in l], np.int64)
    off = np.concatenate([[0], np.cumsum([len(l) for l in lists])]).astype(np.int64)
    words, word_off, block_word, block_off = simple8b.pack(ids, off)
    back, null = simple8b.unpack(words, np.diff(off), block_word, block_off, word_off)
    assert back.tolist() == ids.tolist() and not null.any()


def test_simple8b_queries(spark):
    rows = [(1, [1, 2, None, 70000]), (2, None), (3, []), (None, [5] * 1000), (1, [1, 2, None, 70000]), (4, [0] * 500 + [1 << 61, -1])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<long>").selectExpr("*", "'x' words", "1 n_ids")
    packed = simple8b.pack_ids(df)
    got = sorted(((r.doc_id, r.ids) for r in simple8b.unpack_ids(packed).collect()), key=str)
    assert got == sorted(rows, key=str)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(50, None)], "doc_id long, text string")
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(docs).collect()}
    assert {r.doc_id: r.ids for r in simple8b.unpack_ids(simple8b.pack_documents(docs)).collect()} == ids
    small = {r.doc_id: r for r in packed.collect() if r.doc_id == 4}[4]
    assert len(small.words) < 8 * 30 and len(small.block_at) == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(none).count() == 0 and simple8b.pack_documents(none).count() == 0
