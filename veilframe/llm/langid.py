"""Language ID: interpolated Kneser-Ney character models, one per language.

Texts are lower-cased, every run of non-letters becomes one blank, and the model predicts each
character from the three before it. Counts of 4-grams come from all training texts; lower orders
use continuation counts derived from them, all of them: none is cut. Probabilities stand in arrays
sorted by the n-gram's key, one row per n-gram with a column per language. Where these would be too
large to broadcast, the tables of all orders stay in Spark: the probabilities of the most frequent
4-grams are broadcast, and those of all others join the texts that have them. The language with the lowest cross-entropy
per character is chosen. A part of the training texts is held back from the counts to calibrate
two things: the sharpness of `score`, and the cross-entropy beyond which a text is rejected. Both
come from sums and histograms over all held-back texts.

A text that is null or has no letter gets `und`, score 0 and is rejected. Ties go to the language
that sorts first. With no training rows at all every text gets `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tail, vec
from .scratch import frequent, stored

ORDER = 4
MAX_CELLS = 1 << 22  # probabilities (4-grams times languages) that are broadcast; the others are joined
DISCOUNT = 0.75
KEEP = 0.999  # share of a language's held-back texts that its limit lets through
ENOUGH = 1000  # held-back texts for a limit of its own
SHARPNESS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0)
BINS = 1000  # of the histograms of cross-entropies, for each nat
MIN_LETTERS = 40  # shorter texts are never rejected for their cross-entropy
SLICE_BYTES = 1 << 20  # a slice takes some 60 times its bytes as arrays
_BLANK = 0x20
_MASK = np.uint64(0xFFFF)

_tables: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point to lower-case letter, or to a blank; letters beyond 16 bits are hashed into them."""
    if not _tables:
        low = np.full(0x110000, _BLANK, np.uint32)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            ch = chr(c)
            if ch.isalpha():
                small = ord(ch.lower()[0])
                low[c] = small if small < 0x10000 else 0xE000 + small % 0x1900
        _tables.append(low)
    return _tables[0]


def letters(part: vec.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all rows with a blank at either end of each, the index of each row's
    first and the end, and the number of letters of each row."""
    points = np.frombuffer(part.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
    at = heads[part.offsets]
    if at[-1] != len(points):  # bytes that aren't UTF-8: row by row
        rows = [np.frombuffer(part.text(a, b).encode("utf-32-le"), np.uint32) for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True)]
        points = np.concatenate(rows)
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    folded = _fold()[points]
    n = len(at) - 1
    out = np.full(len(folded) + 2 * n, _BLANK, np.uint16)
    out[np.arange(len(folded)) + np.repeat(2 * np.arange(n) + 1, np.diff(at))] = folded
    bounds = at + 2 * np.arange(n + 1)
    blank = out == _BLANK
    keep = np.ones(len(out), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[bounds[:-1]] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    count = np.concatenate([[0], np.cumsum(~blank)])
    return out[keep].astype(np.uint64), upto[bounds], count[bounds[1:]] - count[bounds[:-1]]


def grams(chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of all rows as 64-bit keys (the last character lowest) and each row's first."""
    key = chars.copy()
    for k in range(1, ORDER):
        key[k:] |= chars[:-k] << np.uint64(16 * k)
    keep = np.ones(len(chars), bool)
    for k in range(ORDER - 1):
        at = first[:-1] + k
        keep[at[at < first[1:]]] = False
    upto = np.concatenate([[0], np.cumsum(keep)])
    return key[keep], upto[first]


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all rows, summed in the task before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for part in vec.slices(batch.column(0), SLICE_BYTES):
                chars, first, _ = letters(part)
                key, at = grams(chars, first)
                which = np.repeat(names[part.lo : part.hi], np.diff(at))
                for name in sorted(set(names[part.lo : part.hi])):
                    got, n = np.unique(key[which == name], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(got), pa.string()), pa.array(got.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    parts = docs.select(text, lang).mapInArrow(work, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted arrays of n-grams of each order with one column of log-probabilities per language,
    and for each context the log-weight with which it backs off."""

    langs: list[str]
    keys: list[np.ndarray] = field(default_factory=list)  # by order 1..4
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)  # of order 2..4: their n-1 characters
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: float = 0.0
    sharpness: float = 20.0
    limit: list[float] = field(default_factory=list)
    tables: Tables | None = None  # where the model is too large for the arrays above

    def __post_init__(self) -> None:
        self._index: vec.Directory | None = None

    def find(self, order: int, key: np.ndarray) -> np.ndarray:
        """Rows of the keys, -1 where there are none."""
        keys = self.keys[order - 1]
        if not len(keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, at, -1)

    def lookup(self, order: int, key: np.ndarray) -> np.ndarray:
        """log p of the last character given the others, (keys, languages); unseen n-grams back off."""
        if not order:
            return np.full((len(key), len(self.langs)), self.floor, np.float32)
        at = self.find(order, key)
        out = np.empty((len(key), len(self.langs)), np.float32)
        out[at >= 0] = self.logp[order - 1][at[at >= 0]]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            rest = key[miss]
            low = self.lookup(order - 1, rest & np.uint64((1 << 16 * (order - 1)) - 1))
            if order > 1:
                contexts = self.contexts[order - 2]
                c = rest >> np.uint64(16)
                if len(contexts):
                    at = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
                    low = low + np.where((contexts[at] == c)[:, None], self.backoff[order - 2][at], 0)
            out[miss] = low
        return out

    def entropies(self, part: vec.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each row under each language, and each row's letters."""
        chars, first, count = letters(part)
        key, at = grams(chars, first)
        rows = self._rows(key)
        table = self.logp[ORDER - 1]
        known = rows >= 0
        sums = np.zeros((part.rows, len(self.langs)))
        miss = np.flatnonzero(~known)
        other = self.lookup(ORDER, key[miss]) if len(miss) else None
        safe = np.where(known, rows, 0)
        for k in range(len(self.langs)):
            p = table[:, k][safe] if len(table) else np.zeros(len(key), np.float32)
            if other is not None:
                p[miss] = other[:, k]
            sums[:, k] = vec.row_sums(p.astype(np.float64), at)
        return -sums / np.maximum(np.diff(at), 1)[:, None], count

    def judge(self, part: vec.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy or NaN, rejected) of each row."""
        if not self.langs:
            n = part.rows
            return np.full(n, "und", object), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        return self.decide(*self.entropies(part))

    def decide(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As judge(), from the entropies and letters."""
        best = x.argmin(1)
        low = x[np.arange(len(x)), best]
        score = 1 / np.exp(-self.sharpness * (x - low[:, None])).sum(1)
        none = count == 0
        rejected = none | ((count >= MIN_LETTERS) & (low > np.array(self.limit)[best]))
        return np.where(none, "und", np.array(self.langs, object)[best]), np.where(none, 0.0, score), np.where(none, np.nan, low), rejected

    def _rows(self, key: np.ndarray) -> np.ndarray:
        """As find() for the full order, by a directory."""
        if self._index is None:
            self._index = vec.Directory(vec.mix(self.keys[ORDER - 1]))
        return self._index.find(vec.mix(key))


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney from the 4-gram counts (keys, n) of each language."""
    langs = sorted(counts)
    if not langs:
        return Model([])
    per = {name: _one(*counts[name]) for name in langs}
    model = Model(langs)
    letters_seen = len(np.unique(np.concatenate([per[x][0][0] for x in langs])))
    model.floor = float(-np.log(letters_seen + 1))
    for order in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([per[x][order - 1][0] for x in langs]))
        contexts = np.unique(keys >> np.uint64(16))
        low = model.lookup(order - 1, keys & np.uint64((1 << 16 * (order - 1)) - 1))
        logp, weight = np.empty((len(keys), len(langs)), np.float32), np.zeros((len(contexts), len(langs)), np.float32)
        c_of = np.searchsorted(contexts, keys >> np.uint64(16))
        for k, name in enumerate(langs):
            mine, n = per[name][order - 1]
            own = np.zeros(len(keys))
            own[np.searchsorted(keys, mine)] = n
            total = np.bincount(c_of, own, len(contexts))
            kinds = np.bincount(c_of, own > 0, len(contexts))
            lam = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            p = np.maximum(own - DISCOUNT, 0) / np.maximum(total, 1)[c_of] + lam[c_of] * np.exp(low[:, k])
            logp[:, k] = np.log(p)
            weight[:, k] = np.log(lam)
        model.keys.append(keys)
        model.logp.append(logp)
        if order > 1:
            model.contexts.append(contexts)
            model.backoff.append(weight)
    return model


def _one(keys: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of orders 1 to 4 of one language: counts at the top, below it the number of
    different characters that stand before the n-gram."""
    out = [(keys, n.astype(np.float64))]
    for order in range(ORDER - 1, 0, -1):
        got, n = np.unique(out[0][0] & np.uint64((1 << 16 * order) - 1), return_counts=True)
        out.insert(0, (got, n.astype(np.float64)))
    return out


@dataclass
class Tables:
    """The same probabilities as build() gives, of counts of any size, as tables: log p of the
    n-grams of each order, the log-weights of the contexts of orders 2 to 4, and the n-grams of
    order 4 whose probabilities are broadcast."""

    logp: list[DataFrame]  # (gram, p), p an array with a place per language
    backoff: list[DataFrame]  # (context, w)
    floor: float
    langs: list[str]
    hot: tail.Hot | None = None

    def resolve(self, keys: DataFrame) -> DataFrame:
        """(key, v) of any 4-grams: log p under each language; unseen n-grams back off."""
        rows = keys.withColumn("v", F.array(*[F.lit(self.floor)] * len(self.langs)))
        for order in range(1, ORDER + 1):
            gram = _suffix(F.col("key"), order)
            rows = rows.withColumn("gram", gram).join(self.logp[order - 1], "gram", "left")
            if order > 1:
                rows = rows.withColumn("context", F.shiftrightunsigned("gram", 16)).join(self.backoff[order - 2], "context", "left")
                rows = rows.withColumn("v", F.when(F.col("w").isNull(), F.col("v")).otherwise(F.zip_with("v", "w", lambda a, b: a + b)))
            rows = rows.select("key", F.coalesce("p", "v").alias("v"))
        return rows


def _suffix(gram: Column, order: int) -> Column:
    return gram if order == ORDER else gram.bitwiseAND(F.lit((1 << 16 * order) - 1))


def tabled(counted: DataFrame, langs: list[str]) -> Tables:
    """Interpolated Kneser-Ney of the 4-gram counts (lang, gram, n) in Spark, as build() has it."""
    orders = [counted]
    for order in range(ORDER - 1, 0, -1):
        low = orders[0].groupBy("lang", _suffix(F.col("gram"), order).alias("gram")).agg(F.count("*").alias("n"))
        orders.insert(0, stored(low, f"grams-{order}"))
    floor = -float(np.log(orders[0].select("gram").distinct().count() + 1))
    by_lang = lambda value: F.array(*(F.coalesce(F.sum(F.when(F.col("lang") == x, value)), F.lit(0)) for x in langs))
    logp, backoff = [], []
    for order, table in enumerate(orders, 1):
        own = table.groupBy("gram").agg(by_lang(F.col("n")).alias("own")).withColumn("context", F.shiftrightunsigned("gram", 16))
        seen = table.groupBy(F.shiftrightunsigned("gram", 16).alias("context")).agg(by_lang(F.col("n")).alias("total"), by_lang(F.lit(1)).alias("kinds"))
        lam = F.zip_with("total", "kinds", lambda t, k: F.when(t > 0, DISCOUNT * k / t).otherwise(1.0))
        seen = seen.select("context", "total", lam.alias("lam"))
        rows = own.join(seen, "context")
        if order == 1:
            rows = rows.withColumn("low", F.array(*[F.lit(floor)] * len(langs)))
        else:
            rows = rows.withColumn("rest", _suffix(F.col("gram"), order - 1)).join(logp[-1].select(F.col("gram").alias("rest"), F.col("p").alias("low")), "rest")
            backoff.append(stored(seen.select("context", F.transform("lam", lambda x: F.log(x)).alias("w")), f"backoff-{order}"))
        p = F.transform(F.arrays_zip("own", "total", "lam", "low"), lambda x: F.log(F.greatest(x["own"] - DISCOUNT, F.lit(0.0)) / F.greatest(x["total"], F.lit(1)) + x["lam"] * F.exp(x["low"])))
        logp.append(stored(rows.select("gram", p.alias("p")), f"logp-{order}"))
    tables = Tables(logp, backoff, floor, langs)
    often = frequent(counted.groupBy("gram").agg(F.sum("n").alias("n")), MAX_CELLS // len(langs)).select("gram")
    tables.hot = tail.hot(often.join(logp[-1], "gram").select(F.col("gram").alias("key"), F.col("p").alias("v")), len(langs))
    return tables


def _keys(part: vec.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    chars, first, count = letters(part)
    return *grams(chars, first), count


def measured(docs: DataFrame, model: Model, keep: list[str], text: str) -> DataFrame:
    """(keep, letters, x): each row's letters and its cross-entropy under each language."""
    if model.tables:
        rows = tail.summed(docs, keep, text, _keys, model.tables.hot, model.tables.resolve, SLICE_BYTES)
        return rows.select(*keep, "letters", F.transform("sums", lambda s: -s / F.greatest("size", F.lit(1))).alias("x"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch.column(len(keep)), SLICE_BYTES):
                x, count = shared.value.entropies(part)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(part.lo, part.rows) for c in batch.columns[: len(keep)]), pa.array(count.astype(np.int64)), lists], names=[*keep, "letters", "x"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(work, f"{fields}letters long, x array<double>")


def _judged(docs: DataFrame, model: Model, keep: list[str], text: str) -> DataFrame:
    """(keep, lang_pred, score, entropy, rejected) of each row, for a model in tables."""
    plain = Model(model.langs, sharpness=model.sharpness, limit=model.limit)
    names = [*keep, "lang_pred", "score", "entropy", "rejected"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, x = batch.column(len(keep)).to_numpy(), batch.column(len(keep) + 1).flatten().to_numpy().reshape(-1, len(plain.langs))
            lang, score, low, rejected = plain.decide(x, count)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score), pa.array(low, mask=np.isnan(low)), pa.array(rejected)], names=names)

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return measured(docs, model, keep, text).mapInArrow(work, f"{fields}lang_pred string, score double, entropy double, rejected boolean")


def train(docs: DataFrame, text: str = "text", lang: str = "lang", fold: Column | None = None) -> Model:
    """Fits and calibrates the model on rows with text and language. Where `fold` is 0 modulo 16
    the row is held back from the counts for calibration."""
    docs = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    fold = F.pmod(F.xxhash64(text), F.lit(1 << 20)) if fold is None else fold
    docs = docs.withColumn("_fold", fold)
    counted = stored(count_grams(docs.where(F.col("_fold") % 16 != 0), text, lang), "grams")
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())
    if counted.count() * len(langs) > MAX_CELLS:
        model = Model(langs, tables=tabled(counted, langs))
        _calibrate(model, docs.where(F.col("_fold") % 16 == 0), text, lang)
        return model
    got = counted.toArrow()
    names = np.array(got.column("lang").to_pylist(), object)
    gram, n = got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
    counts = {}
    for name in sorted(set(names)):
        mine = names == name
        order = np.argsort(gram[mine])
        counts[name] = (gram[mine][order], n[mine][order])
    model = build(counts)
    if model.langs:
        _calibrate(model, docs.where(F.col("_fold") % 16 == 0), text, lang)
    return model


def _noise_entropy(docs: DataFrame, model: Model) -> float:
    """The least cross-entropy of random letters of the model's alphabet."""
    alphabet = model.keys[0] if not model.tables else np.sort(model.tables.logp[0].select("gram").toArrow().column("gram").to_numpy())
    alphabet = alphabet[alphabet != _BLANK].astype(np.uint32)
    if not len(alphabet):  # all training texts are too short for an n-gram
        return 0.0
    noise = np.random.default_rng(5).choice(alphabet, 4000).astype("<u4").tobytes().decode("utf-32-le", "replace")
    if model.tables:
        return min(measured(docs.sparkSession.createDataFrame([(noise,)], "noise string"), model, [], "noise").first()["x"])
    noise = noise.encode()
    return float(model.entropies(vec.Slice(0, 1, np.frombuffer(noise, np.uint8), np.array([0, len(noise)]), np.ones(1, bool)))[0].min())


def _calibrate(model: Model, held: DataFrame, text: str, lang: str) -> None:
    langs = F.array(*(F.lit(x) for x in model.langs))
    rows = measured(held, model, [lang], text).where(f"letters >= {MIN_LETTERS}")
    rows = rows.select(F.array_position(langs, F.col(lang)).cast("int").alias("k"), "x", F.array_min("x").alias("low")).where("k > 0")
    rows = rows.withColumn("own", F.get("x", F.col("k") - 1))
    loss = [F.sum(sharp * (F.col("own") - F.col("low")) + F.log(F.aggregate(F.transform("x", lambda v, s=sharp: F.exp(-s * (v - F.col("low")))), F.lit(0.0), lambda a, v: a + v))) for sharp in SHARPNESS]
    bins = rows.groupBy("k", F.floor(F.col("own") * BINS).alias("bin")).agg(F.count("*").alias("n"), *(x.alias(f"loss{i}") for i, x in enumerate(loss))).collect()
    per = [sorted((r["bin"], r["n"]) for r in bins if r["k"] == k) for k in range(1, len(model.langs) + 1)]
    model.limit = limits(per, _noise_entropy(held, model))
    if sum(r["n"] for r in bins) >= 30 and len(model.langs) > 1:
        model.sharpness = SHARPNESS[int(np.argmin([sum(r[f"loss{i}"] for r in bins) for i in range(len(SHARPNESS))]))]


def _quantile(bins: list[tuple[int, int]], share: float) -> float:
    """The upper edge of the bin with it."""
    upto = np.cumsum([n for _, n in bins])
    return (bins[int(np.searchsorted(upto, share * upto[-1]))][0] + 1) / BINS


def limits(per: list[list[tuple[int, int]]], noise: float) -> list[float]:
    """Each language's limit from its histogram (bin, n): the quantile KEEP of its own texts if it
    has ENOUGH of them, else that of all languages' texts, or its own largest. Where all together
    aren't enough, a text that lies nearer to its language than to random letters stays too."""
    count: dict[int, int] = {}
    for b, n in (x for own in per for x in own):
        count[b] = count.get(b, 0) + n
    every = sorted(count.items())
    pooled = _quantile(every, KEEP) if every else noise
    if every and sum(count.values()) < ENOUGH:
        pooled = max(pooled, (_quantile(every, 0.5) + noise) / 2)
    return [_quantile(own, KEEP) if sum(n for _, n in own) >= ENOUGH else max(pooled, _quantile(own, 1.0) if own else 0.0) for own in per]


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, entropy, rejected) of each row."""
    if model.tables:
        return _judged(docs, model, [id], text)
    names = [id, "lang_pred", "score", "entropy", "rejected"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_CELLS probabilities an order
    kind = docs.schema[id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in vec.slices(batch.column(1), SLICE_BYTES):
                lang, score, low, rejected = model.judge(part)
                cols = [pa.array(lang, pa.string()), pa.array(score), pa.array(low, mask=np.isnan(low)), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, part.rows), *cols], names=names)

    return docs.select(id, text).mapInArrow(work, f"`{id}` {kind}, lang_pred string, score double, entropy double, rejected boolean")


def _crc(id: str = "doc_id") -> Column:
    return F.crc32(F.col(id).cast("string").cast("binary"))


def held_out(id: str = "doc_id") -> Column:
    return _crc(id) % 3 == 1


def digest(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~held_out()), fold=F.floor(_crc() / 3))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `docs` whose text the model doesn't reject, told by the text itself: no join
    unless the model is too large to broadcast."""
    model = train(docs.where(~held_out(id)), text, lang, fold=F.floor(_crc(id) / 3))
    if model.tables:
        one, two = F.xxhash64(text), F.xxhash64(F.lit(1), text)
        bad = _judged(docs.select(one.alias("_one"), two.alias("_two"), text), model, ["_one", "_two"], text).where("rejected").select("_one", "_two").distinct()
        bad = stored(bad, "rejected")
        return docs.join(bad, (one == bad["_one"]) & (two == bad["_two"]), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_CELLS probabilities an order
    where = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch.column(where), SLICE_BYTES):
                yield batch.slice(part.lo, part.rows).filter(pa.array(~shared.value.judge(part)[3]))

    return docs.mapInArrow(work, docs.schema)
