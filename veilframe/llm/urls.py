"""URL filters: rules first, then the ratio of two character language models.

Host and path rules accept or block a URL; the most specific one wins. URLs under no rule are
judged by two variable-order Markov models with Witten-Bell smoothing, one of accepted and one of
blocked URLs, as the difference of log-likelihoods per character against a calibrated threshold.
No n-gram is cut: counts, context totals and numbers of followers are those of all training URLs.
Where the models would be too large to broadcast they stay in tables; the log-ratios of the most
frequent n-grams are broadcast, and those of all others join the URLs that have them.

A null URL, or one without ://, has an empty host and path, so no rule fits it, and the models
judge its text (null: empty). An empty text scores 0. If one of the classes has no URL to learn
from, the models say nothing and the verdict is allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tail, vec
from .scratch import by_rows, frequent, stored

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER = 6
MAX_NGRAMS = 1 << 19  # of the full order that are broadcast; the others are joined
BINS = 1000  # of the histograms of log-ratios, for each unit
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first :// in lower case, and the path up to ?, # or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _keys(part: vec.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte the n-gram of the full order that it ends: the number of bytes before it (at
    most ORDER, none beyond the row's start), then their values and its own, lowest. Each row's first."""
    data, offsets = vec.LOWER[part.data].astype(np.uint64), part.offsets
    depth = np.minimum(np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets)), ORDER)
    key = data | depth.astype(np.uint64) << np.uint64(56)
    for k in range(1, ORDER + 1):
        key[k:] |= np.where(depth[k:] >= k, data[:-k] << np.uint64(8 * k), np.uint64(0))
    return key, offsets, np.zeros(part.rows, np.int64)


def _suffix(key: np.ndarray, order: int) -> np.ndarray:
    """The n-grams of a lower order with the same end."""
    depth = np.minimum(key >> np.uint64(56), np.uint64(order))
    return depth << np.uint64(56) | key & ((np.uint64(1) << np.uint64(8) * (depth + np.uint64(1))) - np.uint64(1))


def _context(gram: np.ndarray) -> np.ndarray:
    """What stands before the last byte."""
    return gram >> np.uint64(56) << np.uint64(56) | (gram & np.uint64((1 << 56) - 1)) >> np.uint64(8)


def _suffix_of(key: str, order: int) -> Column:
    """As _suffix(), of a column."""
    depth = f"least(shiftrightunsigned({key}, 56), {order}L)"
    return F.expr(f"shiftleft({depth}, 56) | ({key} & (shiftleft(1L, cast(8 * ({depth} + 1) as int)) - 1))")


def _context_of(gram: str) -> Column:
    return F.expr(f"shiftleft(shiftrightunsigned({gram}, 56), 56) | shiftright({gram} & {(1 << 56) - 1}L, 8)")


def count_ngrams(urls: DataFrame, url: str, label: str) -> DataFrame:
    """(label, gram, n) over all rows, for the full order: the lower ones' counts follow from it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for part in vec.slices(batch.column(0)):
                key, offsets, _ = _keys(part)
                which = np.repeat(names[part.lo : part.hi], np.diff(offsets))
                for name in sorted(set(names[part.lo : part.hi])):
                    gram, n = np.unique(key[which == name], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["label", "gram", "n"])

    parts = urls.select(url, label).mapInArrow(work, "label string, gram long, n long")
    return parts.groupBy("label", "gram").agg(F.sum("n").alias("n"))


class Markov:
    """One class: n-gram counts, and the total and number of followers of each context, by order,
    in arrays sorted by key."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.grams, self.contexts = [], []
        for order in range(ORDER + 1):
            g, inverse = np.unique(_suffix(gram, order), return_inverse=True)
            m = np.bincount(inverse, n, len(g))
            self.grams.append((g, m))
            names, inverse = np.unique(_context(g), return_inverse=True)
            self.contexts.append((names, np.bincount(inverse, m, len(names)), np.bincount(inverse, minlength=len(names)).astype(np.float64)))

    @staticmethod
    def _get(keys: np.ndarray, key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        if not len(keys):
            return [np.zeros(len(key)) for _ in values]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        return [np.where(hit, v[at], 0.0) for v in values]

    def logp(self, key: np.ndarray) -> np.ndarray:
        """Witten-Bell: each order's share, and for the rest the order below; 1/256 at the bottom."""
        p = np.full(len(key), 1 / 256)
        for k in range(ORDER + 1):
            gram = _suffix(key, k)
            names, total, kinds = self.contexts[k]
            total, kinds = self._get(names, _context(gram), total, kinds)
            (n,) = self._get(self.grams[k][0], gram, self.grams[k][1])
            p = np.where(total > 0, (n + kinds * p) / np.maximum(total + kinds, 1), p)
        return np.log(p)


class Tables:
    """Both classes' counts as tables by order, for any size: (gram, allow, block), and (context)
    with the totals and numbers of followers. The log-ratios of the most frequent n-grams in `hot`."""

    def __init__(self, counts: DataFrame):
        self.grams, self.contexts = [], []
        of = lambda name: F.sum(F.when(F.col("label") == name, F.col("n")).otherwise(0)).alias(name)
        for order in range(ORDER + 1):
            grams = stored(counts.groupBy(_suffix_of("gram", order).alias("gram")).agg(of("allow"), of("block")), f"url-grams-{order}")
            sums = [x for c in ("allow", "block") for x in (F.sum(c).alias(f"{c}_total"), F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds"))]
            self.grams.append(by_rows(grams))
            self.contexts.append(by_rows(stored(grams.groupBy(_context_of("gram").alias("context")).agg(*sums), f"url-contexts-{order}")))
        often = frequent(grams.select("gram", (F.col("allow") + F.col("block")).alias("n")), MAX_NGRAMS)
        self.hot = tail.hot(self.resolve(often.select(F.col("gram").alias("key"))), 1)

    def resolve(self, keys: DataFrame) -> DataFrame:
        """(key, v) of any n-grams: v has log P under `allow` less that under `block`, as logp() has them."""
        rows = keys.withColumns({"p_allow": F.lit(1 / 256), "p_block": F.lit(1 / 256)})
        for order in range(ORDER + 1):
            rows = rows.withColumn("gram", _suffix_of("key", order)).join(self.grams[order], "gram", "left")
            rows = rows.withColumn("context", _context_of("gram")).join(self.contexts[order], "context", "left")
            p = {c: F.when(F.col(f"{c}_total") > 0, (F.coalesce(c, F.lit(0)) + F.col(f"{c}_kinds") * F.col(f"p_{c}")) / (F.col(f"{c}_total") + F.col(f"{c}_kinds"))).otherwise(F.col(f"p_{c}")) for c in ("allow", "block")}
            rows = rows.select("key", *(p[c].alias(f"p_{c}") for c in p))
        return rows.select("key", F.array(F.log("p_allow") - F.log("p_block")).alias("v"))


class Ratio:
    """log-likelihood of `allow` less that of `block`, per character."""

    def __init__(self, allow: Markov | None, block: Markov | None, tables: Tables | None = None):
        self.allow, self.block, self.tables, self.threshold = allow, block, tables, 0.0

    def scores(self, part: vec.Slice) -> np.ndarray:
        key, offsets, _ = _keys(part)
        gap = self.allow.logp(key) - self.block.logp(key)
        return vec.row_sums(gap, offsets) / np.maximum(np.diff(offsets), 1)


def _scored(urls: DataFrame, model: Ratio, keep: list[str], url: str = "url") -> DataFrame:
    if model.tables:
        sums = tail.summed(urls, keep, url, _keys, model.tables.hot, model.tables.resolve)
        return sums.select(*keep, (F.col("sums")[0] / F.greatest("size", F.lit(1))).alias("llr"))
    shared = urls.sparkSession.sparkContext.broadcast(model)  # at most MAX_NGRAMS rows an order
    fields = ", ".join(f"`{c}` {urls.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch.column(len(keep))):
                rows = batch.slice(part.lo, part.rows)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], pa.array(shared.value.scores(part))], names=[*keep, "llr"])

    return urls.select(*keep, F.col(url).alias("_url")).mapInArrow(work, f"{fields}, llr double")


def train(labelled: DataFrame, url: str = "url", label: str = "label", id: str = "page_id") -> Ratio | None:
    """Fits on 4 of 5 labelled URLs, the threshold on the rest: the one that errs least on either
    class alike. Where the rest lacks a class, on all labelled URLs. None if a class is missing."""
    labelled = labelled.withColumn("_fold", vec.crc_mod(id, 5))
    counts = stored(count_ngrams(labelled.where("_fold > 0"), url, label), "url-ngrams")
    if counts.select("label").distinct().count() < 2:
        return None
    if counts.count() > MAX_NGRAMS:
        model = Ratio(None, None, Tables(counts))
    else:
        got = counts.toArrow()
        names, gram, n = np.array(got.column("label").to_pylist(), object), got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
        model = Ratio(*(Markov(gram[names == name], n[names == name]) for name in ("allow", "block")))
    for some in (labelled.where("_fold = 0"), labelled):
        got = _scored(some, model, [label], url).groupBy(F.floor(F.col("llr") * BINS).alias("bin")).agg(F.sum((F.col(label) == "allow").cast("long")).alias("good"), F.count("*").alias("n")).orderBy("bin").collect()
        good, every = np.array([r["good"] for r in got]), np.array([r["n"] for r in got])
        if 0 < good.sum() < every.sum():
            model.threshold = cut([r["bin"] for r in got], good, every - good)
            break
    return model


def cut(bins: list[int], good: np.ndarray, bad: np.ndarray) -> float:
    """The log-ratio between two bins that errs least, in the middle of the gap there."""
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()  # accepted URLs below the cut
    let = 1 - np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    k = int(np.argmin(lost + let))
    return (bins[0] / BINS - 1e-9) if k == 0 else (bins[-1] + 1) / BINS if k == len(bins) else (bins[k - 1] + 1 + bins[k]) / 2 / BINS


def judge(pages: DataFrame, id: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, llr); llr is null where a rule decides."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(id, F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "label": said})
    model = train(rows.where("label is not null"), "url", "label", id)
    keep = [id, "host", "path", "rule", "label"]
    scored = _scored(rows, model, keep) if model else rows.select(*keep, F.lit(0.0).alias("llr"))
    verdict = F.coalesce("label", F.when(F.col("llr") >= (model.threshold if model else 0.0), "allow").otherwise("block"))
    return scored.select(id, "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("label").isNull(), F.col("llr")).alias("llr"))
