"""N-gram Jaccard join by MinHash banding.

Texts are sets of five consecutive words (a text of fewer words, but not none, is one such
n-gram). Texts with the same set are copies: one stands for all. Band and row counts come from a
target recall at the threshold. The steps:

1. One pass over the texts gives each its set's digest and band hashes; copies are folded.
2. Band hashes are shuffled; a bucket of two or more makes a star of candidate edges, not all
   pairs. Components of these stars are clusters, found without gathering any.
3. Texts of clusters move once, to their cluster, which is cut into blocks if it is large. A task
   has two blocks and compares their texts on their full sets of n-grams. It returns the number
   of links of each text and edges that span what it linked, never all pairs.
4. Components of the spanning edges are the classes.

Texts without words (null, empty, blank) link to nothing. A set of n-grams has a number of its own, so
ids may be null or repeat, with equal texts or different ones; they are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .components import components
from .scratch import broadcast_small, stored

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9995
HASHES = 240  # at most
BLOCK = 256  # texts of a cluster in one block, at most on average
BLOCK_BYTES = 8 << 20  # bytes of them likewise


def plan(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows) with the most rows a band, hence the fewest false candidates, that find a pair
    at the threshold with the target recall within the number of hashes."""
    for rows in range(hashes, 0, -1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    return hashes, 1


def ngram_hashes(part: vec.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all rows, with repeats, and each row's first and the end."""
    words, first = vec.word_hashes(part.data, part.offsets)
    n = np.diff(first)
    count = np.where(n >= NGRAM, n - NGRAM + 1, np.minimum(n, 1))
    upto = np.concatenate([[0], np.cumsum(count)])
    grams = vec.window_hashes(np.concatenate([words, np.zeros(NGRAM, np.uint64)]), NGRAM)[vec.gather(first[:-1], count)]
    for r in np.flatnonzero((n > 0) & (n < NGRAM)):  # all its words are the one n-gram
        short = np.concatenate([words[first[r] : first[r + 1]], np.zeros(NGRAM - n[r], np.uint64)])
        grams[upto[r]] = vec.window_hashes(short, NGRAM)[0]
    return grams, upto


def _minhash(grams: np.ndarray, first: np.ndarray, hashes: int) -> np.ndarray:
    """(rows, hashes) least values; rows without n-grams have the largest value."""
    rng = np.random.default_rng(11)
    a = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)
    some = np.flatnonzero(np.diff(first))
    out = np.full((len(first) - 1, hashes), np.uint32(0xFFFFFFFF))
    if len(some):
        for k in range(hashes):
            out[some, k] = np.minimum.reduceat(((grams * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), first[some])
    return out


_KEY = ["id", "one", "two"]  # the id and two hashes of the text


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two"), F.col(text).alias("text"))


def _same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["one"] == b["one"]) & (a["two"] == b["two"])


def signatures(docs: DataFrame, id: str, text: str, bands: int, rows: int) -> DataFrame:
    """(id, one, two, digest, size, bands): hashes of the text, digest of the n-gram set, null where
    there is no word, and bytes of the text."""
    names = [*_KEY, "digest", "size", "bands"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = np.random.default_rng(13).integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for part in vec.slices(batch.column(3)):
                grams, first = ngram_hashes(part)
                least = _minhash(grams, first, bands * rows).astype(np.uint64).reshape(part.rows, bands, rows)
                keys = vec.mix((least * mult).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)
                digests = [np.unique(grams[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                digests = [_digest(d) if d else None for d in digests]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.rows * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                own = [c.slice(part.lo, part.rows) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(digests, pa.binary()), pa.array(np.diff(part.offsets), pa.int64()), lists], names=names)

    return _keyed(docs, id, text).mapInArrow(work, "id long, one long, two long, digest binary, size long, bands array<long>")


def _digest(data: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(data, digest_size=16).digest()


def _sets(signed: DataFrame) -> DataFrame:
    """(node, digest, rep, id, one, two, size, bands, times) of the distinct sets: a number of its own,
    the least id, the key of one of its rows; `times` counts copies."""
    found = signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.min(F.struct(*_KEY, "size", "bands")).alias("r"), F.count("*").alias("times"))
    return stored(found.select(F.monotonically_increasing_id().alias("node"), "digest", "rep", "r.*", "times"), "sets")


def _clusters(sets: DataFrame) -> DataFrame:
    """(node, root, id, one, two, times, size) of the sets that share a band with another."""
    keys = sets.select("node", F.explode("bands").alias("band"))
    stars = keys.groupBy("band").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1")
    edges = keys.join(stars, "band").where("node > center").select(F.col("node").alias("a"), F.col("center").alias("b"))
    return components(edges).join(sets.select("node", *_KEY, "times", "size"), "node")


def _compare(threshold: float):
    """Links among the texts of two blocks of a cluster (or of one with itself)."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        data, offsets, valid = vec.flat(pa.array(frame["text"], pa.string()))
        grams, first = ngram_hashes(vec.Slice(0, len(frame), data, offsets, valid))
        sets = [np.unique(grams[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        size = np.array([len(s) for s in sets])
        upto = np.concatenate([[0], np.cumsum(size)])
        _, gram = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(gram, kind="stable")
        posting = np.repeat(np.arange(len(sets)), size)[order]  # the texts of each n-gram
        begin = np.concatenate([[0], np.cumsum(np.bincount(gram))])
        block, node, times = frame["block"].to_numpy(), frame["node"].to_numpy(), frame["times"].to_numpy()
        within = frame["left"].iloc[0] == frame["right"].iloc[0]
        links, label, edges = np.zeros(len(frame), np.int64), np.arange(len(frame)), []
        for k in range(len(frame)):
            mine = gram[upto[k] : upto[k + 1]]
            shared = np.bincount(posting[vec.gather(begin[mine], begin[mine + 1] - begin[mine])], minlength=len(frame))
            ok = shared >= threshold * (size + size[k] - shared) - 1e-9
            ok[: k + 1] = False
            others = np.flatnonzero(ok if within else ok & (block != block[k]))
            if not len(others):
                continue
            links[k] += times[others].sum()
            links[others] += times[k]
            names, at = np.unique(label[others], return_index=True)
            edges += [(node[k], node[others[i]]) for name, i in zip(names, at, strict=True) if name != label[k]]
            label[np.isin(label, names)] = label[k]
        linked = np.flatnonzero(links)
        return pd.DataFrame(
            {
                "a": np.concatenate([node[linked], [e[0] for e in edges]]).astype(np.int64),
                "b": np.concatenate([node[linked], [e[1] for e in edges]]).astype(np.int64),
                "links": np.concatenate([links[linked], np.zeros(len(edges))]).astype(np.int64),
            }
        )

    return work


def _told(docs: DataFrame, id: str, text: str, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The signatures, and (digest, class_id, n_links) of the sets that have links."""
    bands, rows = plan(threshold, recall)
    signed = stored(signatures(docs, id, text, bands, rows), "signatures")
    sets = _sets(signed)
    clusters = stored(_clusters(sets), "clusters")
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    large = sizes.select("root", blocks.alias("blocks")).where("blocks > 1")  # few: the others are one block
    members = clusters.join(broadcast_small(large), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    narrow = broadcast_small(members.select("node", "root", "times", "block", "blocks", *_KEY))
    rows_ = _keyed(docs, id, text)
    texts = rows_.join(narrow, _same_key(rows_, narrow)).select("node", "root", "times", "block", "blocks", "text")
    if _repeated(signed).limit(1).count():  # several rows have a set's key, hence its text
        texts = texts.groupBy("node", "root", "times", "block", "blocks").agg(F.first("text").alias("text"))
    # each pair of blocks is a task: block i goes to (i, j) and (j, i)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = texts.select("*", other.alias("other")).withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    compared = pairs.select("root", "left", "right", "block", "node", "times", "text").groupBy("root", "left", "right")
    found = stored(compared.applyInPandas(_compare(threshold), "a long, b long, links long"), "links")
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(found.where("a <> b").select("a", "b"))
    told = sets.select("node", "digest", "rep", "times").join(links, "node", "left").join(classes, "node", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("times") - 1)
    told = stored(told.where("n_links > 0").select("digest", F.coalesce("root", "node").alias("root"), "rep", "n_links"), "told")
    least = told.groupBy("root").agg(F.min("rep").alias("class_id"))
    return signed, told.join(least, "root").select("digest", "root", "class_id", "n_links")


def _repeated(signed: DataFrame) -> DataFrame:
    """The keys of several rows with words, whose ids and texts are the same."""
    return signed.where("digest is not null").groupBy(*_KEY).count().where("count > 1").drop("count")


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, class_id, n_links) of each row: class_id is the least id that links lead to, n_links
    counts the rows whose n-gram sets have at least the threshold's Jaccard similarity."""
    signed, told = _told(docs, id, text, threshold, recall)
    out = signed.select("id", "digest").join(told.drop("root"), "digest", "left")
    return out.select(F.col("id").alias(id), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with its least id; of several such rows, one of the least text hash."""
    signed, told = _told(docs, id, text, THRESHOLD, RECALL)
    rows = signed.select(*_KEY, "digest").join(told, "digest")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), *_KEY)).alias("first")).select("root", *(F.col(f"first.{k}").alias(f"first_{k}") for k in _KEY))
    marked = rows.join(first, "root")
    stays = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("one") == F.col("first_one")) & (F.col("two") == F.col("first_two"))
    others = stored(marked.where(~stays).select(*_KEY).distinct(), "others")
    keyed = docs.withColumns({f"_{k}": c for k, c in zip(_KEY, (F.col(id).cast("long"), F.xxhash64(text), F.xxhash64(F.lit(1), text)), strict=True)})
    same = lambda t: keyed["_id"].eqNullSafe(t["id"]) & (keyed["_one"] == t["one"]) & (keyed["_two"] == t["two"])
    few = broadcast_small(others)
    kept = keyed.join(few, same(few), "left_anti")
    twice = stored(_repeated(signed), "repeated")
    if twice.limit(1).count():
        again = broadcast_small(twice)
        once = kept.join(again, same(again), "left_semi").dropDuplicates([f"_{k}" for k in _KEY])
        kept = kept.join(again, same(again), "left_anti").unionByName(once)
    return kept.select(docs.columns)
