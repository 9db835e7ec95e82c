"""Substring dedup with suffix automata: a word goes if a 20-word window over it stood earlier.

Documents are ordered by id, and of equal windows the first one stays. The automata of all the
corpus's text would grow with the corpus, so they can't all be broadcast; and most windows stand
once. So the work is split by what the windows are:

1. Seeds: each window picks one 10-word run inside it, the one of least hash. Equal windows pick
   equal seeds, so a window whose seed stands once in the corpus stands once. Seeds are counted
   over all documents, and a bitmap keeps those that stand twice or more: 32 bits for each of them,
   up to 64 MB. Beyond that more windows pass it, and step 3 finds that they stand once.
2. Reference shards: the passages that most often surround the most frequent seeds, up to a fixed
   number, are dealt into shards. A task builds the suffix automaton of each shard; all are
   broadcast. Documents stream past them for matching statistics: wherever the longest match
   reaches 20 words, the window is one of the reference's, and the least place of each such window
   is a small table. These windows, that hot groups are made of, are never shuffled one by one.
3. Of all other windows with a repeated seed the least place is a minimum by the window's hash of
   128 bits, combined before the shuffle. It is what stays: the least places go to their documents,
   and the windows themselves are never brought together. This path is exact for whatever the bounds
   of 1 and 2 leave out.
4. Documents meet the places that stay, and maximal spans of covered words are cut out.

Null texts have no words and keep none. Rows are ordered by id, a null id first; rows with equal ids
(null or not) stand one after the other in the order of their texts' hashes, and of rows that are
equal throughout all but one lose what they share. Where ids are unique and lie in a range that
leaves room for word places in 62 bits, an id is its row's place in the order; else rows are
numbered by a sort, which writes the texts once more.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .scratch import frequent, stored

WINDOW = 20
SEED = 10
SEED_BITS = 32  # of the bitmap for each repeated seed
MAX_BITS = 29  # 2 ** 29 bits, 64 MB, at most
HOT_SEEDS = 16_384
HOT_PASSAGES = 8_192
SHARD_WORDS = 131_072
LEAST_HOT = 16  # occurrences of a hot seed at least


class Automaton:
    """Suffix automaton of a sequence of words. Most states have one way on: its letter and target
    stand in flat arrays, and only branching states have a dictionary."""

    def __init__(self, words: list[int]):
        out: list[dict[int, int]] = [{}]
        link, length, end = [-1], [0], [-1]
        last = 0
        for at, c in enumerate(words):
            cur = len(out)
            out.append({})
            link.append(0)
            length.append(length[last] + 1)
            end.append(at)
            p = last
            while p >= 0 and c not in out[p]:
                out[p][c] = cur
                p = link[p]
            if p >= 0:
                q = out[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(out)
                    out.append(dict(out[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    end.append(end[q])
                    while p >= 0 and out[p].get(c) == q:
                        out[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.link, self.length, self.end = array("i", link), array("i", length), array("i", end)
        self.letter = array("i", [next(iter(t)) if len(t) == 1 else -1 for t in out])
        self.target = array("i", [next(iter(t.values())) if len(t) == 1 else 0 for t in out])
        self.more = {k: t for k, t in enumerate(out) if len(t) > 1}

    def windows(self, words: list[int], size: int) -> Iterator[tuple[int, int]]:
        """(start, reference end) of each run of `size` words of `words` that the reference has:
        matching statistics, cut to the size so that the state's first end is the run's own. Words
        that the reference doesn't have are negative."""
        letter, target, more, link, length = self.letter, self.target, self.more, self.link, self.length
        state = long = 0
        for at, c in enumerate(words):
            if c < 0:
                state = long = 0
                continue
            while True:
                to = target[state] if letter[state] == c else more[state].get(c, 0) if state in more else 0
                if to or not state:
                    break
                state = link[state]
                long = length[state]
            state = to
            long = long + 1 if to else 0
            if long >= size:
                while length[link[state]] >= size:
                    state = link[state]
                    long = length[state]
                yield at - size + 1, self.end[state]


class Windows:
    """The windows of a slice: their places, hashes and seeds."""

    def __init__(self, part: vec.Slice):
        self.words, self.first = vec.word_hashes(part.data, part.offsets)
        self.part = part
        count = np.maximum(np.diff(self.first) - WINDOW + 1, 0)
        self.begin = np.concatenate([[0], np.cumsum(count)])  # each row's first window
        self.at = vec.gather(self.first[:-1], count)  # index of each window's first word
        self.row = np.repeat(np.arange(part.rows), count)
        self.start = self.at - self.first[:-1][self.row]
        seeds = vec.window_hashes(self.words, SEED)
        best, self.seed_at = seeds[self.at], self.at.copy()
        for k in range(1, WINDOW - SEED + 1):
            other = seeds[self.at + k]
            less = other < best
            best = np.where(less, other, best)
            self.seed_at[less] = self.at[less] + k
        self.seed = best

    def keys(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows `some`."""
        other, _ = vec.word_hashes(self.part.data, self.part.offsets, other=True)
        pick = lambda words: vec.window_hashes(words, WINDOW)[self.at[some]].view(np.int64) if len(some) else np.zeros(0, np.int64)
        return pick(self.words), pick(other)

    def new_seed(self) -> np.ndarray:
        """Which windows are the first of a run with the same seed at the same place."""
        new = np.ones(len(self.at), bool)
        new[1:] = self.seed_at[1:] != self.seed_at[:-1]
        return new


def _seed_counts(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch.column(0)):
                w = Windows(part)
                seed, n = np.unique(w.seed[w.new_seed()], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(n.astype(np.int32))], names=["seed", "n"])

    parts = docs.select("text").mapInArrow(work, "seed long, n int")
    return parts.groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The bitmap of the seeds' top bits, as bytes. Spark makes it in blocks of 4 KB."""
    bits = min(MAX_BITS, max(16, (SEED_BITS * seeds.count()).bit_length()))
    bit = F.shiftrightunsigned("seed", 64 - bits) + 1  # Spark's bitmaps count from 1
    blocks = seeds.select(F.bitmap_bucket_number(bit).alias("block"), F.bitmap_bit_position(bit).alias("at")).groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros(max(1 << bits - 3, 4096), np.uint8)
    got = blocks.toArrow()
    for block, some in zip(got.column("block").to_pylist(), got.column("bits").to_pylist(), strict=True):
        at = (block - 1) * 4096
        out[at : at + 4096] = np.frombuffer(some, np.uint8)[: len(out) - at]
    return out


def _in_bitmap(bitmap: np.ndarray, seed: np.ndarray) -> np.ndarray:
    bit = seed >> np.uint64(64 - (8 * len(bitmap)).bit_length() + 1)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _among(sorted_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(keys), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)] == keys


def _passages(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(passage, words): the most frequent passages around hot seeds, as arrays of word hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch.column(0)):
                w = Windows(part)
                new = w.new_seed()
                begin = np.flatnonzero(new)
                stop = np.append(begin[1:], len(new)) - 1  # last window of the run
                some = _among(hot, w.seed[begin])
                lo, hi = w.at[begin[some]], w.at[stop[some]] + WINDOW
                texts = [w.words[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                seen: dict[bytes, int] = {}
                for t in texts:
                    seen[t] = seen.get(t, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["words", "n"])

    parts = docs.select("text").mapInArrow(work, "words binary, n long")
    counted = stored(parts.groupBy("words").agg(F.sum("n").alias("n")).where("n > 1"), "passages")
    return frequent(counted, HOT_PASSAGES, fill="words")


def build_automata(passages: DataFrame, shard_words: int = SHARD_WORDS) -> list[tuple[np.ndarray, Automaton]]:
    """One automaton for each shard of the passages (binary arrays of word hashes), with the sorted
    word hashes that its letters number. The passages must be bounded in number."""
    count = passages.agg(F.sum(F.octet_length("words") / 8 + 1)).first()[0] or 0
    shards = max(1, -(-int(count) // shard_words))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        import pickle

        parts = [np.frombuffer(x, np.uint64) for x in sorted(frame["words"])]
        names = np.unique(np.concatenate(parts))
        letters: list[int] = []
        for k, x in enumerate(parts):
            letters += np.searchsorted(names, x).tolist()
            letters.append(-2 - k)  # no match runs over the end of a passage
        return pd.DataFrame({"built": [pickle.dumps((names, Automaton(letters)), protocol=5)]})

    import pickle

    dealt = passages.select("words", F.pmod(F.xxhash64("words"), F.lit(shards)).alias("shard"))
    built = dealt.groupBy("shard").applyInPandas(work, "built binary").collect()
    return [pickle.loads(r["built"]) for r in built]


def _hot_windows(w: Windows, hot: np.ndarray, automata: list[tuple[np.ndarray, Automaton]]) -> tuple[np.ndarray, np.ndarray]:
    """(window, reference window) of the slice's windows that the reference has."""
    if not automata or not len(w.at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = w.new_seed()
    some = _among(hot, w.seed[new])[np.cumsum(new) - 1]
    found: list[tuple[int, int]] = []
    starts = np.flatnonzero(some & ~(np.concatenate([[False], some[:-1]]) & np.concatenate([[False], w.at[1:] == w.at[:-1] + 1])))
    ends = np.append(starts[1:], 0)[: len(starts)]
    after = np.flatnonzero(~some)
    for s, nxt in zip(starts.tolist(), ends.tolist(), strict=True):
        stop = after[np.searchsorted(after, s)] if len(after) and after[-1] > s else len(some)
        stop = min(int(stop), nxt) if nxt else int(stop)
        words = w.words[w.at[s] : w.at[stop - 1] + WINDOW]
        got: dict[int, int] = {}
        for k, (names, automaton) in enumerate(automata):
            at = np.minimum(np.searchsorted(names, words), len(names) - 1)
            letters = np.where(names[at] == words, at, -1).tolist()
            for start, end in automaton.windows(letters, WINDOW):
                got.setdefault(start, end * len(automata) + k)
        found += [(s + start, ref) for start, ref in got.items()]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = np.array(found, np.int64)
    return out[:, 0], out[:, 1]


def _places(docs: DataFrame, shared, shift: int, base: int) -> DataFrame:
    """(ref, h1, h2, place): of windows in the reference each slice's least place, with `ref`; of
    other windows with a repeated seed every place, with both hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, bitmap, automata = shared.value
        for batch in batches:
            number = batch.column(0).to_numpy()
            for part in vec.slices(batch.column(1)):
                w = Windows(part)
                place = ((number[part.lo : part.hi] - base) << shift)[w.row] + w.start
                at, ref = _hot_windows(w, hot, automata)
                order = np.lexsort((place[at], ref))
                at, ref = at[order], ref[order]
                lead = np.ones(len(ref), bool)
                lead[1:] = ref[1:] != ref[:-1]
                cold = _in_bitmap(bitmap, w.seed)
                cold[at] = False
                cold = np.flatnonzero(cold)
                one, two = w.keys(cold)
                n, m = int(lead.sum()), len(cold)
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.array(ref[lead]), pa.nulls(m, pa.int64())]), pa.concat_arrays([none, pa.array(one)]), pa.concat_arrays([none, pa.array(two)]), pa.array(np.concatenate([place[at[lead]], place[cold]]))],
                    names=["ref", "h1", "h2", "place"],
                )

    return docs.select("number", "text").mapInArrow(work, "ref long, h1 long, h2 long, place long")


def _numbered(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows (id, text, number), the least number and the bits of a word's place: numbers are unique
    and in order, and number and place have 62 bits together."""
    bounds = docs.agg(F.count("*"), F.count("id"), F.min("id"), F.max("id"), F.max(F.length("text"))).first()
    shift = max(1, ((bounds[4] or 0) // 2 + 1).bit_length())
    if not bounds[0]:
        return docs.withColumn("number", F.lit(0).cast("long")), 0, shift
    wide = bounds[2] is None or (bounds[3] - bounds[2]).bit_length() + shift > 62
    if bounds[0] == bounds[1] and not wide and not docs.groupBy("id").count().where("count > 1").limit(1).count():
        return docs.withColumn("number", F.col("id")), bounds[2], shift
    order = ["id", F.xxhash64("text"), F.monotonically_increasing_id()]
    ranged = docs.repartitionByRange(*order).withColumn("_h", F.xxhash64("text")).sortWithinPartitions("id", "_h").drop("_h")
    at = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33).cast("int")
    before, sizes = 0, {}
    for r in at.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a partition
        sizes[r["part"]] = before
        before += r["count"]
    begin = F.lit([sizes.get(k, 0) for k in range(max(sizes) + 1)])
    number = F.get(begin, part) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.withColumn("number", number.cast("long")).drop("_at"), 0, shift


def removed(docs: DataFrame, id: str = "doc_id", text: str = "text", out: str = "kept") -> DataFrame:
    """(id, n_words, n_removed, n_hot, kept) of each row: the words that stay, joined by one blank;
    `n_hot` counts the removed words that a window of the automata covers."""
    docs, base, shift = _numbered(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")))
    seeds = stored(_seed_counts(docs), "seeds")
    bitmap = _bitmap(seeds)
    hot = np.sort(frequent(seeds.where(F.col("n") >= LEAST_HOT), HOT_SEEDS, fill="seed").toArrow().column("seed").to_numpy().view(np.uint64))
    automata = build_automata(_passages(docs, hot)) if len(hot) else []
    shared = docs.sparkSession.sparkContext.broadcast((hot, bitmap, automata))  # of fixed size
    least = _places(docs, shared, shift, base).groupBy("ref", "h1", "h2").agg(F.min("place").alias("place"))
    firsts = stored(least.select("ref", "place"), "firsts")
    first = firsts.where("ref is not null").toArrow()  # windows of the reference
    order = np.argsort(first.column("ref").to_numpy())
    refs, places = first.column("ref").to_numpy()[order], first.column("place").to_numpy()[order]
    stay = firsts.where("ref is null").select((F.shiftright("place", shift) + base).alias("number"), F.col("place").bitwiseAND(F.lit((1 << shift) - 1)).cast("int").alias("s"))
    starts = stay.groupBy("number").agg(F.collect_list("s").alias("starts"))
    return _cut(docs.join(starts, "number", "left"), id, out, shared, refs, places, shift, base)


def _cut(rows: DataFrame, id: str, out: str, shared, refs: np.ndarray, least: np.ndarray, shift: int, base: int) -> DataFrame:
    table = rows.sparkSession.sparkContext.broadcast((refs, least))  # of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, bitmap, automata = shared.value
        refs, least = table.value
        for batch in batches:
            number, starts = batch.column(1).to_numpy(), batch.column(3)
            for part in vec.slices(batch.column(2)):
                w = Windows(part)
                begin, end, first = vec.runs(~vec.SPACE[part.data], part.offsets)
                at, ref = _hot_windows(w, hot, automata)
                place = ((number[part.lo : part.hi] - base) << shift)[w.row[at]] + w.start[at]
                warm = at[least[np.searchsorted(refs, ref)] != place] if len(at) else at
                cold = _in_bitmap(bitmap, w.seed)
                cold[at] = False
                some = starts.slice(part.lo, part.rows)
                flat = some.flatten().to_numpy(zero_copy_only=False)
                count = np.array([0 if x is None else x for x in some.value_lengths().to_pylist()], np.int64)
                cold[(np.repeat(w.begin[:-1], count) + flat).astype(np.int64)] = False  # these stay
                by_automata = _covered(w.at[warm], len(begin))
                gone = by_automata | _covered(w.at[cold], len(begin))
                keep = np.flatnonzero(~gone)
                # kept words with one blank after each, and each row's without the last blank
                size = end[keep] - begin[keep] + 1
                text = np.append(part.data, np.uint8(0x20))[_with_blank(begin[keep], size, len(part.data))]
                stop = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(keep, first)]
                texts = [text[a : max(a, b - 1)].tobytes().decode("utf-8", "replace") for a, b in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]
                sums = lambda flags: pa.array(vec.row_sums(flags.astype(np.int64), first))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, part.rows), pa.array(np.diff(first)), sums(gone), sums(by_automata), pa.array(texts, pa.string())], names=[id, "n_words", "n_removed", "n_hot", out])

    return rows.select("id", "number", "text", "starts").mapInArrow(work, f"`{id}` long, n_words long, n_removed long, n_hot long, `{out}` string")


def _covered(starts: np.ndarray, words: int) -> np.ndarray:
    """Which words a window that starts at one of `starts` covers."""
    edge = np.zeros(words + WINDOW + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge)[:words] > 0


def _with_blank(begin: np.ndarray, size: np.ndarray, blank: int) -> np.ndarray:
    at = vec.gather(begin, size)
    at[np.cumsum(size) - 1] = blank
    return at


def digest(docs: DataFrame) -> DataFrame:
    return removed(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_hot")
