"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history).

* Frequent words fall into classes by clustering what stands before them; each other word's class
  follows from its last two bytes.
* P(class | history) is a softmax whose features are the previous word, the word before it (a
  skip), and both together (a trigram), hashed to rows of a weight table. Training texts are dealt
  into cells of some 16 MB by a hash of id and text and sorted by it, so the model doesn't depend on
  how the table is laid out. A task follows the gradient over each of its cells; their updates are
  averaged by row, weighted by use, round after round, and the rounds together pass over all
  training texts once.
* P(word | class, history) is a softmax over the class's frequent words with the classes of the
  two words before as features, fitted by iterative scaling to counts over all training texts. In
  the classes of other words it is add-one smoothed counts, with one share for words never seen.

So the probabilities of all words and of one unknown word in each class of rare words sum to 1.

Counts are exact over all training texts. The weights, the frequent words and their counts are
of fixed size and broadcast; counts of all other words meet their places by a shuffle, summed by
document beforehand. A null or empty text is the end token alone. With no training texts all
counts are 0 and `score` equals `base_score`. Ids are only carried along and hashed: rows with a
repeated or null id are scored each by itself, and repeated rows get the same score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .scratch import frequent, stored

KNOWN = 1 << 18  # words whose counts are broadcast
MODELLED = 4096  # of them in classes of their own
CLASSES = 36  # of modelled words
RARE = 12  # classes of other words
ALL = CLASSES + RARE
CONTEXTS = 64  # frequent words that stand before, for the clustering
ROWS = 1 << 14  # of the weight table
ROUNDS = 2
CELL_BYTES = 16 << 20  # of training texts in a cell
FAN = 64  # cells, or sums of cells, that are added in one task
LEVELS = 3  # such additions one after another: cells of 4 TB meet by FAN, more in the last
BATCH = 4096
RATE = 0.15
SCALING = 12  # rounds of iterative scaling
END = np.uint64(0x5EED0FE4D0000001)
START = np.uint64(0x5EED0FB0D0000003)
_LOG10 = np.log(10)


@dataclass
class Tokens:
    """Tokens of a slice, each row closed by END: hashes, class if rare, and each row's first."""

    hash: np.ndarray
    rare: np.ndarray
    first: np.ndarray

    def before(self, values: np.ndarray, by: int, start) -> np.ndarray:
        """The values `by` tokens earlier in the same row, `start` beyond its beginning."""
        out = np.full(len(values), start, values.dtype)
        out[by:] = values[:-by]
        at = np.concatenate([self.first[:-1] + k for k in range(by)])
        out[at[at < np.tile(self.first[1:], by)]] = start
        return out


def tokens(part: vec.Slice) -> Tokens:
    data = vec.LOWER[part.data]
    starts, ends, first = vec.runs(~vec.SPACE[data], part.offsets)
    words = vec.span_hash(data, starts, ends)
    rows = np.repeat(np.arange(part.rows), np.diff(first))
    at = np.arange(len(words)) + rows
    out = np.full(len(words) + part.rows, END)
    out[at] = words
    rare = np.zeros(len(out), np.int16)
    if len(words):
        two = data[ends - 1].astype(np.uint64) | np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64) << np.uint64(8)
        rare[at] = (vec.mix(two + np.uint64(1)) % np.uint64(RARE)).astype(np.int16)
    return Tokens(out, rare, first + np.arange(part.rows + 1))


def _parts(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, vec.Slice, Tokens]]:
    for batch in batches:
        for part in vec.slices(batch.column(column)):
            yield batch, part, tokens(part)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, rare, n): exact counts of all tokens, summed in the task first."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, at, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        return word, np.concatenate([p[1] for p in parts])[at], np.bincount(inverse, np.concatenate([p[2] for p in parts]), len(word)).astype(np.int64)

    def emit(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        word, rare, n = merged(parts)
        for k in range(0, len(word), 100_000):
            s = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(word[s].view(np.int64)), pa.array(rare[s].astype(np.int32)), pa.array(n[s])], names=["word", "rare", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, t in _parts(batches):
            word, at, n = np.unique(t.hash, return_index=True, return_counts=True)
            held.append((word, t.rare[at], n))
            size += len(word)
            if size > 1_500_000:
                held = [merged(held)]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    parts = docs.select("text").mapInArrow(work, "word long, rare int, n long")
    return parts.groupBy("word").agg(F.first("rare").alias("rare"), F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent words by descending count, and the classes' totals of all other words."""

    def __init__(self, word: np.ndarray, rare: np.ndarray, n: np.ndarray, totals: dict[int, tuple[int, int]], tokens: int, kinds: int):
        self.word, self.rare, self.n, self.tokens, self.kinds = word, rare, n, tokens, kinds
        self.directory = vec.Directory(word)
        self.modelled = min(MODELLED, len(word))
        tail = np.array([totals.get(k, (0, 0)) for k in range(RARE)], np.float64).reshape(RARE, 2)
        #: log of what add-one counts of a class of rare words are divided by, and its share of tokens
        self.rare_total, self.rare_tokens = tail[:, 0] + tail[:, 1] + 1, tail[:, 0]
        self.of = np.zeros(0, np.int16)  # class of each modelled word

    def find(self, t: Tokens) -> np.ndarray:
        return self.directory.find(t.hash)

    def classes(self, t: Tokens, at: np.ndarray) -> np.ndarray:
        mine = (at >= 0) & (at < self.modelled)
        return np.where(mine, self.of[np.where(mine, at, 0)] if len(self.of) else 0, CLASSES + t.rare).astype(np.int16)


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = frequent(counts, KNOWN).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    word, rare, n = (top.column(c).to_numpy() for c in ("word", "rare", "n"))
    last = min(MODELLED, len(word)) - 1
    edge = (int(n[last]), int(word[last])) if last >= 0 else (1 << 62, 0)
    other = counts.where((F.col("n") < edge[0]) | (F.col("n") == edge[0]) & (F.col("word") > edge[1]))
    totals = {r[0]: (r[1], r[2]) for r in other.groupBy("rare").agg(F.sum("n"), F.count("*")).collect()}
    return Vocabulary(word.view(np.uint64), rare, n, totals, int(total[0]), int(total[1]))


def _cells(docs: DataFrame, shared, count, size: int) -> np.ndarray:
    """Sums over all tasks of what `count` adds to an array of fixed size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, _, t in _parts(batches):
            count(shared.value, t, total)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    got = docs.select("text").mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out


def _count_neighbours(words: Vocabulary, t: Tokens, total: np.ndarray) -> None:
    at = words.find(t)
    left = t.before(at, 1, -1)
    left = np.where((left >= 0) & (left < CONTEXTS - 1), left, CONTEXTS - 1)
    mine = (at >= 0) & (at < words.modelled)
    total += np.bincount(at[mine] * CONTEXTS + left[mine], minlength=len(total))


def cluster(table: np.ndarray, n: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """k-means of the words by the square roots of the shares of what stands before them."""
    if len(table) <= classes:
        return np.arange(len(table), dtype=np.int16)
    x = np.sqrt(table / np.maximum(table.sum(1, keepdims=True), 1))
    centers = x[:classes].copy()  # the most frequent words
    weight = np.sqrt(n.astype(np.float64))
    of = np.zeros(len(x), np.int64)
    for _ in range(15):
        of = (x @ centers.T).argmax(1)
        sums = np.stack([np.bincount(of, x[:, k] * weight, classes) for k in range(x.shape[1])], 1)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centers)
    return of.astype(np.int16)


def _features(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the weight table: previous word, skip, both."""
    one, two = t.before(t.hash, 1, START), t.before(t.hash, 2, START)
    shift = np.uint64(64 - ROWS.bit_length() + 1)
    row = lambda h, salt: (vec.mix(h + np.uint64(salt)) >> shift).astype(np.uint16)
    return row(one, 1), row(two, 2), row(one * np.uint64(0x9E3779B97F4A7C15) + two, 3)


def _class_logits(weights: np.ndarray, bias: np.ndarray, rows: tuple[np.ndarray, ...], s: slice) -> np.ndarray:
    z = weights[rows[0][s]]
    for r in rows[1:]:
        z += weights[r[s]]
    z += bias
    return z


def _descend(weights: np.ndarray, bias: np.ndarray, squares: np.ndarray, used: np.ndarray, rows: tuple[np.ndarray, ...], target: np.ndarray) -> None:
    """Gradient steps over the tokens in small batches, each row's step scaled by its past ones."""
    for k in range(0, len(target), BATCH):
        s = slice(k, k + BATCH)
        z = _class_logits(weights, bias, rows, s)
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(z)), target[s]] -= 1
        for r in rows:
            own = r[s]
            order = np.argsort(own, kind="stable")
            own = own[order]
            lead = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            g = np.add.reduceat(z[order], lead, 0)
            own = own[lead]
            squares[own] += (g * g).mean(1)
            used[own] += np.diff(np.append(lead, len(order)))
            weights[own] -= (RATE / np.sqrt(squares[own] + 1e-6))[:, None] * g


def _dealt(docs: DataFrame, k: int, cells: int) -> DataFrame:
    """(text, cell) of the texts of round k, sorted by cell; a partition may have several cells."""
    h = F.xxhash64("id", "text")
    mine = docs.select("text", h.alias("_h")).where(F.pmod("_h", F.lit(ROUNDS)) == k)
    cell = F.pmod(F.shiftright("_h", 8), F.lit(cells)).cast("int")
    return mine.withColumn("cell", cell).repartition(cells, "cell").sortWithinPartitions("cell", "_h").select("text", "cell")


def _round(docs: DataFrame, model: Model) -> np.ndarray:
    """The weights after each task has descended over its texts: the tasks' updates of each row,
    averaged by how often they used it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    blocks = 64

    def update(cell: int, weights: np.ndarray, used: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = (weights - shared.value.weights).astype(np.float16)  # an average of many
        for block in range(blocks):
            rows = np.flatnonzero(used[block::blocks]) * blocks + block
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([cell], pa.int32()), pa.array([rows.astype(np.int32).tobytes()]), pa.array([used[rows].astype(np.int32).tobytes()]), pa.array([step[rows].tobytes()])], names=["block", "cell", "rows", "used", "step"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cell = shared.value, None
        for batch in batches:
            of = batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if cell != of[a]:  # each cell descends from the model by itself
                    if cell is not None:
                        yield from update(cell, weights, used)
                    cell = int(of[a])
                    weights, squares, used = model.weights.copy(), np.full(ROWS, 0.1, np.float32), np.zeros(ROWS, np.int64)
                for _, _, t in _parts(iter([batch.slice(a, b - a)])):
                    at = model.words.find(t)
                    _descend(weights, model.bias, squares, used, _features(t), model.words.classes(t, at))
        if cell is not None:
            yield from update(cell, weights, used)

    def total(frame: pd.DataFrame, sparse: bool) -> pd.DataFrame:
        """Sums of the steps, each times its uses, and of the uses, over some cells of a block."""
        sums, uses = np.zeros((ROWS // blocks, ALL)), np.zeros(ROWS // blocks, np.int64)
        first, frame = frame[["block", "cell"]].iloc[0], frame.sort_values("cell")  # sums in one order
        for rows, used, step in zip(frame["rows"], frame["used"], frame["step"], strict=True):
            if sparse:
                at, n = np.frombuffer(rows, np.int32) // blocks, np.frombuffer(used, np.int32).astype(np.int64)
                sums[at] += np.frombuffer(step, np.float16).reshape(-1, ALL).astype(np.float64) * n[:, None]
                uses[at] += n
            else:
                sums += np.frombuffer(step, np.float64).reshape(-1, ALL)
                uses += np.frombuffer(used, np.int64)
        return pd.DataFrame({"block": [first["block"]], "cell": [first["cell"] // FAN], "rows": [b""], "used": [uses.tobytes()], "step": [sums.tobytes()]})

    def add_cells(frame: pd.DataFrame) -> pd.DataFrame:
        return total(frame, True)

    def add_sums(frame: pd.DataFrame) -> pd.DataFrame:
        return total(frame, False)

    schema = "block int, cell int, rows binary, used binary, step binary"
    steps = docs.mapInArrow(work, schema)
    # at most FAN cells meet in a task, then FAN of their sums, and so on
    for level in range(LEVELS):
        whole = [] if level == LEVELS - 1 else [F.floor(F.col("cell") / FAN)]
        steps = steps.groupBy("block", *whole).applyInPandas(add_cells if level == 0 else add_sums, schema)
    out = model.weights.copy()
    for r in steps.collect():  # `blocks` rows
        uses = np.frombuffer(r["used"], np.int64)
        out[r["block"] :: blocks] += (np.frombuffer(r["step"], np.float64).reshape(-1, ALL) / np.maximum(uses, 1)[:, None]).astype(np.float32)
    return out


def _count_contexts(words: Vocabulary, t: Tokens, total: np.ndarray) -> None:
    """(word, class before), (word, class two before) and (class, both classes)."""
    at = words.find(t)
    of = words.classes(t, at)
    one, two = t.before(of, 1, ALL).astype(np.int64), t.before(of, 2, ALL).astype(np.int64)
    mine = (at >= 0) & (at < words.modelled)
    n, wide = MODELLED * (ALL + 1), ALL + 1
    total[:n] += np.bincount(at[mine] * wide + one[mine], minlength=n)
    total[n : 2 * n] += np.bincount(at[mine] * wide + two[mine], minlength=n)
    total[2 * n :] += np.bincount((of[mine].astype(np.int64) * wide + one[mine]) * wide + two[mine], minlength=len(total) - 2 * n)


def fit_words(one: np.ndarray, two: np.ndarray, contexts: np.ndarray, rounds: int = SCALING) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Iterative scaling in one class: one, two (words, contexts) and contexts (contexts, contexts)
    are counts. Returns the weights of both features and the log of the normaliser."""
    start = np.log(one.sum(1) + 0.5) / 2
    a, b = np.tile(start[:, None], (1, one.shape[1])), np.tile(start[:, None], (1, two.shape[1]))
    for k in range(rounds + 1):
        ea, eb = np.exp(a - a.max()), np.exp(b - b.max())
        z = ea.T @ eb
        if k == rounds:
            return a, b, np.log(z) + a.max() + b.max()
        share = contexts / z
        # expected counts of each feature under the model
        na, nb = ea * (eb @ share.T), eb * (ea @ share)
        a += 0.5 * np.log((one + 0.5) / (na + 0.5))
        b += 0.5 * np.log((two + 0.5) / (nb + 0.5))
    raise AssertionError


@dataclass
class Model:
    words: Vocabulary
    bias: np.ndarray
    weights: np.ndarray
    one: np.ndarray | None = None  # (modelled words, contexts)
    two: np.ndarray | None = None
    norm: np.ndarray | None = None  # (classes, contexts, contexts)

    def logp(self, t: Tokens, at: np.ndarray) -> np.ndarray:
        """log P of each token; for words beyond the vocabulary without the count's part, log(c + 1)."""
        of = self.words.classes(t, at)
        rows = _features(t)
        out = np.empty(len(of))
        for k in range(0, len(of), BATCH):
            s = slice(k, k + BATCH)
            z = _class_logits(self.weights, self.bias, rows, s)
            z -= z.max(1, keepdims=True)
            own = z[np.arange(len(z)), of[s]]
            out[s] = own - np.log(np.exp(z).sum(1))
        mine = (at >= 0) & (at < self.words.modelled)
        other = ~mine
        out[other] -= np.log(self.words.rare_total)[t.rare[other]]
        seen = other & (at >= 0)
        out[seen] += np.log1p(self.words.n[at[seen]])
        one, two = t.before(of, 1, ALL)[mine], t.before(of, 2, ALL)[mine]
        out[mine] += self.one[at[mine], one] + self.two[at[mine], two] - self.norm[of[mine], one, two]
        return out


def train(docs: DataFrame) -> tuple[Model | None, DataFrame]:
    """The model and the table of all counts, from the texts of (id, text). None without texts."""
    counts = stored(count_words(docs), "word-counts")
    words = vocabulary(counts)
    if not words.tokens:
        return None, counts
    share = docs.sparkSession.sparkContext.broadcast
    table = _cells(docs, share(words), _count_neighbours, words.modelled * CONTEXTS)
    words.of = cluster(table.reshape(-1, CONTEXTS), words.n[: words.modelled])
    size = np.concatenate([np.bincount(words.of, words.n[: words.modelled], CLASSES), words.rare_tokens])
    model = Model(words, np.log(size + 1).astype(np.float32) - np.float32(np.log(size.sum())), np.zeros((ROWS, ALL), np.float32))
    n, wide = MODELLED * (ALL + 1), ALL + 1
    cells = _cells(docs, share(words), _count_contexts, 2 * n + CLASSES * wide * wide)
    one, two, contexts = cells[:n].reshape(MODELLED, wide), cells[n : 2 * n].reshape(MODELLED, wide), cells[2 * n :].reshape(CLASSES, wide, wide)
    model.one, model.two, model.norm = np.zeros((MODELLED, wide)), np.zeros((MODELLED, wide)), np.zeros((CLASSES, wide, wide))
    for c in range(CLASSES):
        mine = np.flatnonzero(words.of == c)
        if len(mine):
            model.one[mine], model.two[mine], model.norm[c] = fit_words(one[mine], two[mine], contexts[c])
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    cells = max(1, -(-size // (CELL_BYTES * ROUNDS)))
    for k in range(ROUNDS):
        model.weights = _round(_dealt(docs, k, cells), model)
    return model, counts


def score(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score) of each row, both scores
    log10 probabilities; rows where `learn` is true train the model."""
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), learn.alias("learned"))
    model, counts = train(docs.where("learned").select("id", "text"))
    base = np.log(model.words.tokens + model.words.kinds + 1) if model else 0.0
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    names = ["row", "id", "learned", "n_tokens", "n_known", "base", "model", "word", "times"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, part, t in _parts(batches, 2):
            n = np.diff(t.first)
            key, ids, learned = (batch.column(c).slice(part.lo, part.rows) for c in (0, 1, 3))
            if model is None:
                zero = np.zeros(len(n))
                yield pa.RecordBatch.from_arrays([key, ids, learned, pa.array(n), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], names=names)
                continue
            at = model.words.find(t)
            known = at >= 0
            plain = np.where(known, np.log1p(model.words.n[np.maximum(at, 0)]), 0.0) - base
            p = model.logp(t, at)
            # words beyond the vocabulary, once for each document
            beyond = np.flatnonzero(~known)
            row = np.searchsorted(t.first, beyond, "right") - 1
            order = np.lexsort((t.hash[beyond], row))
            row, word = row[order], t.hash[beyond[order]]
            lead = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (word[1:] != word[:-1])])) if len(row) else np.zeros(0, np.int64)
            m = len(lead)
            times = np.diff(np.append(lead, len(row)))
            none = lambda kind: pa.nulls(m, kind)
            pad = lambda values, kind: pa.concat_arrays([pa.array(values, kind), none(kind)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([key, key.take(pa.array(row[lead]))]),
                    pa.concat_arrays([ids, none(ids.type)]),
                    pa.concat_arrays([learned, none(pa.bool_())]),
                    pad(n, pa.int64()),
                    pad(vec.row_sums(known.astype(np.int64), t.first), pa.int64()),
                    pad(vec.row_sums(plain, t.first), pa.float64()),
                    pad(vec.row_sums(p, t.first), pa.float64()),
                    pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(word[lead].view(np.int64))]),
                    pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(times)]),
                ],
                names=names,
            )

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", docs.schema["id"].dataType), *T.StructType.fromDDL("learned boolean, n_tokens long, n_known long, base double, model double, word long, times long").fields])
    told = stored(docs.select(F.monotonically_increasing_id().alias("row"), "id", "text", "learned").mapInArrow(work, schema), "scored")
    beyond = told.where("word is not null").join(counts.select("word", "n"), "word")
    beyond = beyond.groupBy("row").agg(F.sum(F.col("times") * F.log1p(F.col("n").cast("double"))).alias("extra"), F.sum("times").alias("more"))
    rows = told.where("word is null").join(beyond, "row", "left")
    extra = F.coalesce("extra", F.lit(0.0))
    return rows.select(
        F.col("id").alias(id),
        "learned",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.words.tokens if model else 0).cast("long").alias("train_tokens"),
        ((F.col("base") + extra) / _LOG10).alias("base_score"),
        ((F.col("model") + extra) / _LOG10).alias("score"),
    )


def held_out(id: str = "doc_id") -> Column:
    """Whether a row is held out; one with a null id is not."""
    return F.coalesce(vec.crc_mod(id, 7) == 2, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    scored = score(docs, ~held_out())
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
