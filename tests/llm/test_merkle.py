"""Operator 11 against a plain tree."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from veilframe.llm import merkle

LOWER = {c: c + 32 for c in range(65, 91)}


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def path(tree, k):
    for nodes in tree[:-1]:
        run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
        yield run[: k % 16], run[k % 16 + 1 :]
        k //= 16


def expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names]
    top = levels([t[-1][0] for t in trees])
    for j, s in enumerate(names):
        for k, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            proof = [*path(trees[j], k), *path(top, j)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            h = leaf((*r[:4], r[4].translate(LOWER))) if bad else own
            for before, after in proof:
                h = H(*before, h, *after)
            yield r[0], own, trees[j][-1][0], top[-1][0], H(*(x for b, a in proof for x in b + a)), h, h == top[-1][0]


def same(spark, rows, parts, columns="doc_id long, source string, lang string, n_chars long, text string"):
    docs = spark.createDataFrame(rows, columns).withColumns({c: F.lit(c) for c in ("group", "id", "leaf", "claim", "tie", "part", "rank", "level", "idx")}).repartition(parts)
    got = merkle.digest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=order) == sorted(expected(rows), key=order)
    return got


@pytest.mark.parametrize("sizes", [[1], [17], [1, 1, 1], [5000, 16, 1, 256, 257]])
def test_tree_sizes(spark, sizes):
    rows = [(n * 10_000 + k, f"s{n}", "en", k, f"Text {k}") for n, size in enumerate(sizes) for k in range(size)]
    same(spark, rows, 4)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(k, None if k % 3 else "", None if k % 2 else "de", None, [None, "", "ÄB c 漢", "X" * 20_000][k % 4]) for k in range(60)]
    rows += [(None, "web", "en", 3, "a"), (None, "web", "en", 3, "A"), *[(7, "web", None, None, "Same")] * 40, (8, "wéb", "en", 1, "Z"), (9, "we", "en", 1, "z")]
    got = same(spark, rows, 3)
    assert {r["verified"] for r in got} == {True, False}


def test_many_groups(spark):
    same(spark, [(k, f"source {k}", "en", 1, "T") for k in range(300)], 3)


def test_long_run_over_many_parts(spark):
    """Ranks go on over parts, and batches end inside of subtrees."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        same(spark, [(k, "one", "en", 1, "t") for k in range(9000)], 5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.digest(docs).collect() == []
