"""The pipeline's stages on their own inputs, and its whole against plain Python."""

from pathlib import Path

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from veilframe.llm import pii

from .test_operators import _jaccard, _windows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns[: len(columns)] == columns
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "near-duplicates":
            classes = _jaccard([(i, r["text"]) for i, r in before.items()])
            assert set(after) == {i for i, (root, _) in classes.items() if root == i}
        if name == "benchmark":
            items = [_windows(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            windows = {tuple(w[k : k + 13]) for w in items for k in range(max(1, len(w) - 12))}
            for i, r in before.items():
                w = _windows(r["text"])
                hit = {k + d for k in range(len(w)) for n in {len(x) for x in windows} if tuple(w[k : k + n]) in windows for d in range(n)}
                assert (i in after) == (not hit or 20 * len(hit) < len(w))
        if name == "pii":
            assert set(after) == set(before)
            assert all(r["text"] == pii.masked(before[i]["text"]) and r["n_chars"] == len(r["text"]) for i, r in after.items())
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in docs.limit(40).collect():
        assert r["token_ids"] == model.encode(r["text"], add_special_tokens=False).ids
    assert len(after) > 0.8 * len(seen)
    whole = {(r["doc_id"], tuple(r["token_ids"])) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {(r["doc_id"], tuple(r["token_ids"])) for r in docs.collect()}
