"""Operator 13 against the sentencepiece library."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.llm import pieces

EDGE = [
    None, "", " ", "  ", "a", " a ", "a  b", "a\n\tb", "▁x", "x▁▁y", "<s>a</s>", "<0x41>", "\x00a\x01", "　a", "ﬁ½\xa0", "😀️", "漢字かな", "x" * 20_000, "ab" * 700, " " * 300,
    "the quick brown fox " * 2000, "éà́ " * 50, "1234567890" * 9, "=" * 70,
]


@pytest.fixture(scope="module")
def coder():
    return pieces.encoder()


def same(coder, texts):
    ids, bounds = coder.encode(texts)
    for k, t in enumerate(texts):
        mine, theirs = ids[bounds[k] : bounds[k + 1]], coder.library.encode(t or "")
        assert mine.tolist() == theirs, t
        assert coder.decode(mine) == coder.library.decode(theirs).encode(), t


def test_edges(coder):
    same(coder, EDGE)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aehinorst ▁.,\n01<>"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=5))
def test_any_text(texts):
    same(pieces.encoder(), texts)


def test_heap_and_lockstep_agree(coder):
    for t in ["international", "unbelievably" * 5, "aaaaaaaaaaab", "==== ==="]:
        chars = np.frombuffer(("▁" + t.replace(" ", "▁")).encode("utf-32-le"), "<u4")
        sym = coder.of_char[chars].astype(np.int64)
        assert coder.merge_one(sym.tolist()) == coder.merge_all(sym, np.array([len(sym)]))[0].tolist() == coder.library.encode(t)


def test_table_starts_afresh(coder, monkeypatch):
    monkeypatch.setattr(pieces, "MAX_SPANS", 3)
    same(coder, ["one two", "three four", "one two three four five"])


def test_a_wrong_merge_is_an_error(coder):
    chars = np.frombuffer("▁the".encode("utf-32-le"), "<u4")
    with pytest.raises(ValueError, match="differ"):
        coder.check(chars, np.array([4]), np.array([5, 6], np.int32), np.array([2]))


def test_query_and_round_trip(spark):
    rows = [(k // 2 if k % 5 else None, t) for k, t in enumerate(EDGE + EDGE[-3:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit(1), "piece_ids": F.lit("x")}).repartition(3)
    sp = pieces.encoder().library
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((str(i), len(e := sp.encode(t or "")), sha(",".join(map(str, e))), sha(sp.decode(e))) for i, t in rows)
    assert sorted((str(r[0]), *r[1:]) for r in pieces.digest(docs).collect()) == want
    back = pieces.decode(pieces.encode(docs)).collect()
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") and r["n_tokens"] == 1 for r in back)
    assert pieces.digest(docs.where("false")).count() == 0
