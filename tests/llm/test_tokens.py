"""Problem 6: against the public library, exact round trip, and the scan against the pattern."""

import random

import numpy as np
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracegrove.llm import tokens as T

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=T.ranks(T.VOCABULARY), special_tokens={})
ENCODER = T.Encoder()


def ids_of(texts):
    ids, counts = ENCODER.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=5))
def test_any_text(texts):
    assert ids_of(texts) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_contractions_spaces_and_specials():
    rd = random.Random(3)
    parts = [" ", "'", "'s", "'ll", "'re", "\n", "\t", "a", "B", "7", "!", "é", "\u00a0", "\x85", "<|endoftext|>", "日本", "🙂", "²", "\x00"]
    texts = ["".join(rd.choice(parts) for _ in range(rd.randint(0, 25))) for _ in range(3000)]
    assert ids_of(texts) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_starts_are_those_of_the_pattern():
    text = "It's  a test,\n\n  isn't it?   They'll  x'y \u3000 end  "
    points = np.array([*map(ord, text), T.END_MARK], np.uint32)
    assert T.slice_starts(points).tolist() == [m.start() for m in regex.finditer(PATTERN, text)] + [len(text)]


def test_very_long_slice_and_round_trip():
    texts = ["x" * 50_000, "ab" * 9_000 + " ", "=" * 3000, ""]
    ids = ids_of(texts)
    assert ids == [REFERENCE.encode_ordinary(t) for t in texts]
    assert [T.decode(x) for x in ids] == texts


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=" \n\tab1'sl!é", max_size=80), st.integers(1, 9))
def test_parts_of_long_texts(text, block):
    ids, counts = ENCODER.encode([text, "a b"], block)
    assert "".join(T.cut_long(text, block)) == text
    assert ids.tolist() == REFERENCE.encode_ordinary(text) + REFERENCE.encode_ordinary("a b") and counts[1] == 2


def test_monoid_is_associative():
    table, _, leads_to, _ = T.monoid()
    rd = np.random.default_rng(0)
    a, b, c = rd.integers(0, len(table), (3, 2000))
    assert (table[table[a, b], c] == table[a, table[b, c]]).all()
    assert leads_to[0] == T.FRESH


def test_operator(spark):
    rows = [(1, "hi there"), (2, None), (3, ""), (4, "<|endoftext|>"), (4, "hi there"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as ids", "1 as n_tokens")
    got = sorted(((r.doc_id or 0, r.ids) for r in T.encode(df, ["doc_id"]).collect()), key=str)
    assert got == sorted([(1, [5303, 612]), (2, []), (3, []), (4, REFERENCE.encode_ordinary("<|endoftext|>")), (4, [5303, 612]), (0, [87])], key=str)
    assert T.encode(df.limit(0), ["doc_id"]).count() == 0
    assert sorted(r.n_tokens for r in T.token_counts(df, ["doc_id"]).collect()) == sorted(len(x) for _, x in got)


def test_whole_table_against_library(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = {r.doc_id: REFERENCE.encode_ordinary(r.text or "") for r in docs.collect()}
    assert {r.doc_id: r.ids for r in T.encode(docs, ["doc_id"]).collect()} == want


def test_equal_hashes_give_no_wrong_ids(monkeypatch):
    """With a hash that is the same for all slices, every id is still right."""
    monkeypatch.setattr(T.Encoder, "_keys", lambda self, points, starts, stops: (stops - starts).astype(np.uint64))
    encoder, texts = T.Encoder(), ["one two six ten", "red dog cat one", "\u00e9\u00e9 two  red", ""]
    for _ in range(2):
        ids, counts = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [REFERENCE.encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), st.integers(0, 60), st.integers(0, 60), st.integers(3, 50))
def test_offsets_decode_any_stretch(text, a, b, block):
    ids, starts, lengths = ENCODER.offsets(text, block)
    assert ids == REFERENCE.encode_ordinary(text) and sum(lengths) == len(ids)
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    assert T.decode_stretch(ids, starts, lengths, a, b) == text[a:b]


def test_offsets_operator(spark):
    df = spark.createDataFrame([(1, "hi there"), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "'c' as ids", "1 as starts")
    got = {r.doc_id: (r.ids, r.starts, r.lengths) for r in T.encode_with_offsets(df, ["doc_id"]).collect()}
    assert got == {1: ([5303, 612], [0, 2], [1, 1]), 2: ([], [], []), 3: ([], [], [])}
