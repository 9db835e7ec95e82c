"""Dictionaries of any size over texts: places, peoples, diseases, occupations, product names.

A dictionary is a table (term, kind, value, confidence): a term's words, what it is, what it stands for
(its words in lower case, if null) and how sure that is. Words are runs of letters, digits and _, and
every other sign but white space stands by itself; case doesn't count. A term matches where its words
stand one after another, whatever white space is between them.

A dictionary of at most MAX_TERMS terms and MAX_CHARS characters is broadcast and becomes a trie of
words in each Python worker, which Arrow batches of texts are walked along. A larger one is joined:
runs of words that may be terms, by a bitmap of fixed size, meet the terms by a shuffle. Both give the
same spans. Null and empty texts have none, null and blank terms match nothing, and repeated terms
count once; a term of two kinds gives a span of each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored

MAX_TERMS = 200_000
MAX_CHARS = 16 << 20
BITMAP_BITS = 22  # of the bitmap that tells which runs of words may be terms: 512 KB
AT_ONCE = 128  # texts whose spans a worker holds as objects
KNOWN = 1 << 18  # runs of words that a worker remembers the bitmap's answer for
SPAN = "struct<kind:string,value:string,start:int,end:int,text:string,confidence:double>"
_FIELDS = pa.struct([("kind", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("confidence", pa.float64())])
_WORD = re.compile(r"\w+|[^\w\s]")
_END = ""  # the key of a trie's node under which its entries stand; no word is empty


class Entry(NamedTuple):
    kind: str
    value: str
    confidence: float


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def trie(rows: list[tuple[str, str, str | None, float]]) -> dict:
    """Nested dictionaries by word, the entries of a term under _END."""
    root: dict = {}
    for term, kind, value, confidence in rows:
        node, own = root, words(term)
        for w in own:
            node = node.setdefault(w, {})
        if own:
            node.setdefault(_END, []).append(Entry(kind, value if value is not None else " ".join(own), confidence))
    return root


def walk(root: dict, text: str) -> list[tuple]:
    """All spans of the trie's terms in the text, by start, end, kind and value."""
    own = words(text)
    starts = [k for k, w in enumerate(own) if w in root]
    if not starts:
        return []
    met: list[tuple[int, int, Entry]] = []
    for k in starts:
        node, at = root, k
        while at < len(own) and (node := node.get(own[at])) is not None:
            at += 1
            met += [(k, at, e) for e in node.get(_END, ())]
    if not met:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    out = [(e.kind, e.value, places[a][0], places[b - 1][1], text[places[a][0] : places[b - 1][1]], e.confidence) for a, b, e in met]
    return sorted(out, key=lambda s: (s[2], s[3], s[0], s[1]))


_last: list = []  # the worker's dictionary and its trie


def _trie_of(told: Broadcast) -> dict:
    """The worker's trie of a broadcast dictionary; one at a time is kept."""
    if not _last or _last[0] is not told.value:
        _last[:] = [told.value, trie(told.value)]
    return _last[1]


def dictionary(terms: DataFrame) -> DataFrame:
    """The dictionary's distinct rows, with defaults for columns that it hasn't."""
    have = set(terms.columns)
    get = lambda c, kind, other: (F.coalesce(F.col(c).cast(kind), F.lit(other)) if other is not None else F.col(c).cast(kind)) if c in have else F.lit(other).cast(kind)
    return terms.where("term is not null").select("term", get("kind", "string", "term").alias("kind"), get("value", "string", None).alias("value"), get("confidence", "double", 0.9).alias("confidence")).distinct()


def fits(terms: DataFrame, max_terms: int = MAX_TERMS, max_chars: int = MAX_CHARS) -> bool:
    """Whether the dictionary may be broadcast."""
    n, chars = terms.agg(F.count("*"), F.coalesce(F.sum(F.length("term") + F.coalesce(F.length("value"), F.lit(0))), F.lit(0))).first()
    return n <= max_terms and chars <= max_chars


def spans(text: Column, terms: DataFrame) -> Column:
    """The array of spans of a dictionary that may be broadcast, as an expression."""
    told = dictionary(terms)
    if not fits(told):
        raise ValueError("the dictionary is too large to be broadcast: use find or annotate")
    rows = sorted((tuple(r) for r in told.collect()), key=str)
    shared = terms.sparkSession.sparkContext.broadcast(rows)

    @F.arrow_udf(f"array<{SPAN}>")
    def found(texts: pa.Array) -> pa.Array:
        root = _trie_of(shared)
        return pa.concat_arrays([_found(root, texts.slice(k, AT_ONCE)) for k in range(0, max(len(texts), 1), AT_ONCE)])

    return found(text)


def _found(root: dict, texts: pa.Array) -> pa.Array:
    """The spans of some texts; only theirs stand as Python objects, a batch's are in Arrow's columns."""
    per = [walk(root, t) if t else [] for t in texts.to_pylist()]
    offsets = pa.array(np.cumsum([0, *map(len, per)]), pa.int32())
    flat = [s for one in per for s in one]
    columns = [pa.array([s[k] for s in flat], f.type) for k, f in enumerate(_FIELDS)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(_FIELDS)), pa.list_(_FIELDS))


def _bucket(phrase: Column) -> Column:
    return F.pmod(F.xxhash64(phrase), F.lit(1 << BITMAP_BITS))


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """Bits of all phrases' buckets, put together from words of 64 of them: rows of a fixed number."""
    b = F.col("b")
    told = phrases.select(_bucket(F.col("phrase")).alias("b")).groupBy(F.floor(b / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))).alias("bits"))
    out = np.zeros(1 << BITMAP_BITS >> 6, np.uint64)
    for w, bits in told.collect():
        out[w] = np.int64(bits).view(np.uint64)
    return out


def _phrases(told: DataFrame) -> DataFrame:
    """(phrase, n, kind, value, confidence): each term's words a blank apart, and how many."""

    @F.arrow_udf("struct<phrase:string,n:int>")
    def phrase(terms: pa.Array) -> pa.Array:
        own = [words(t) if t else [] for t in terms.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([" ".join(w) if w else None for w in own], pa.string()), pa.array([len(w) for w in own], pa.int32())], ["phrase", "n"])

    split = told.withColumn("_p", phrase("term")).select("_p.*", "kind", "value", "confidence").where("phrase is not null")
    return split.withColumn("value", F.coalesce("value", "phrase")).distinct()


def _joined(df: DataFrame, told: DataFrame, id: str, text: str) -> DataFrame:
    """The spans of a dictionary that isn't broadcast."""
    phrases = stored(_phrases(told), "phrases")
    lengths = sorted(r[0] for r in phrases.select("n").distinct().collect())
    bits = df.sparkSession.sparkContext.broadcast(_bitmap(phrases))
    schema = T.StructType([df.schema[id], *T.StructType.fromDDL("phrase string, start int, end int, text string").fields])
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, mask = bits.value.tobytes(), (1 << BITMAP_BITS) - 1
        known: dict[str, bool] = {}

        def may_be(phrase: str) -> bool:
            if len(known) >= KNOWN:
                known.clear()
            h = xxhash.xxh64_intdigest(phrase.encode(), 42) & mask  # as Spark hashes
            known[phrase] = told = bool(bitmap[h >> 3] >> (h & 7) & 1)
            return told

        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1), strict=True):
                body = body.as_py()
                own, out = words(body) if body else [], []
                places = None
                for n in lengths:
                    for k, phrase in enumerate(own if n == 1 else map(" ".join, zip(*(own[i:] for i in range(n))))):  # noqa: B905  the shortest ends it
                        if (told := known.get(phrase)) or (told is None and may_be(phrase)):
                            places = places or [m.span() for m in _WORD.finditer(body)]
                            a, b = places[k][0], places[k + n - 1][1]
                            out.append((phrase, a, b, body[a:b]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(out), batch.column(0).type), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True))], names=names)

    runs = df.select(id, text).mapInArrow(work, schema)
    return runs.join(phrases, "phrase").select(id, "kind", "value", "start", "end", "text", "confidence")


def find(df: DataFrame, terms: DataFrame, id: str, text: str = "text", max_terms: int = MAX_TERMS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(id, kind, value, start, end, text, confidence) of every term in every text."""
    told = dictionary(terms)
    if not fits(told, max_terms, max_chars):
        return _joined(df.withColumnRenamed(text, "_text"), told, id, "_text")
    return df.select(id, spans(F.col(text), terms).alias("_s")).select(id, F.inline("_s"))


def annotate(df: DataFrame, terms: DataFrame, id: str, text: str = "text", out: str = "found", max_terms: int = MAX_TERMS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Adds the array of each row's spans, by start, end, kind and value; ids are unique."""
    told = dictionary(terms)
    if fits(told, max_terms, max_chars):
        return df.withColumn(out, spans(F.col(text), terms))
    order = lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"], s["text"], s["confidence"])
    back = lambda s: F.struct(s["kind"], s["value"], s["start"], s["end"], s["text"], s["confidence"])
    found = find(df, terms, id, text, max_terms, max_chars).groupBy(id).agg(F.collect_list(F.struct("start", "end", "kind", "value", "text", "confidence")).alias("_s"))
    joined = df.join(found, id, "left")
    return joined.withColumn(out, F.coalesce(F.transform(F.array_sort(F.transform("_s", order)), back), F.array().cast(f"array<{SPAN}>"))).drop("_s")


def longest(found: Column) -> Column:
    """Of spans that overlap the first and longest."""
    keyed = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["kind"].alias("c"), s["value"].alias("d"), s.alias("s"))))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{SPAN}>").alias("kept"))
    step = lambda a, k: F.when(k["s"]["start"] >= a["end"], F.struct(k["s"]["end"].alias("end"), F.concat(a["kept"], F.array(k["s"])).alias("kept"))).otherwise(a)
    return F.aggregate(keyed, start, step, lambda a: a["kept"])
