"""BPE encoding by content-defined chunk reuse.

A rolling hash over the last bytes of a text cuts it into chunks that depend on content alone, so
passages which documents share fall into the same chunks. A worker encodes each distinct chunk once
and remembers it as long as it keeps coming up: chunks that weren't met since the last generation are
forgotten first, those of the texts at hand never. Documents stay where they are: moving every chunk
to one place would shuffle the corpus twice over, so "once" is once for each worker.

A cut may fall inside a word, and a chunk's outer words are then not what the whole text has. The
join is repaired by encoding the text around it anew, from the word before to the word after, and
counts as repaired when the tokens of these two agree exactly with those of their chunks. Where they
don't agree, the text is widened to the whole row, which is then encoded as it stands.

Chunks and joins are remembered by their bytes. Encoding a chunk looks up the parts of its words in a
table of those that the worker has met, bounded in size, by a 64-bit hash.

Null and empty texts have no tokens and decode to the empty string. Rows are encoded one by one, so
repeated rows and ids give repeated results.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import vec

WINDOW = 8  # bytes of the rolling hash
CUT_BITS = 8  # a cut after every 256th byte on average
MAX_PARTS = 400_000  # parts of words and chunks that a worker remembers before it starts afresh
MAX_CHUNKS = 10_000  # chunks of a generation; a worker remembers two
MAX_JOINS = 20_000  # joins likewise
_ROLL = np.random.default_rng(7).integers(0, 1 << 62, 256, dtype=np.uint64)

_BLANK, _LETTER, _DIGIT, _PUNCT, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F] = _PUNCT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[vec.SPACE] = _BLANK
_KIND[[0x27, 0x3C]] = _OTHER  # ' may begin a contraction, < a special token


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of the chunks; each row begins one, and no cut is inside a character."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > WINDOW:
        rolled = np.zeros(n - WINDOW, np.uint64)
        table = _ROLL[data]
        for k in range(WINDOW):
            rolled += table[k : k + n - WINDOW] << np.uint64(2 * k)
        cut[WINDOW:] = (vec.mix(rolled) >> np.uint64(64 - CUT_BITS)) == 0
    cut &= (data & 0xC0) != 0x80
    cut[offsets[offsets < n]] = True
    return np.flatnonzero(cut)


def units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Splits words into the parts that the pre-tokeniser always splits: (lower-cased data, starts,
    ends, whole). A word of ASCII and Latin-1 letters, digits and punctuation falls into runs of
    letters, single digits and runs of punctuation; any other word is one part, with `whole` set."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] & 0xC0 == 0x80) & (data[lead + 1] & 0x1F != 0x17)]  # but for the signs \u00d7 and \u00f7
    kind[lead] = kind[lead + 1] = _LETTER
    odd = np.concatenate([[0], np.cumsum(kind == _OTHER)])
    odd = odd[ends] > odd[starts]
    low = vec.LOWER[data]
    low[lead + 1] |= np.where(data[lead + 1] <= 0x9E, 0x20, 0).astype(np.uint8)
    at = vec.gather(starts[odd], (ends - starts)[odd])
    low[at] = data[at]
    kind[at] = _OTHER
    begin = (kind == _DIGIT)
    begin[1:] |= kind[1:] != kind[:-1]
    begin &= kind != _BLANK
    begin[starts] = True
    first = np.flatnonzero(begin)
    word = np.searchsorted(starts, first, "right") - 1
    return low, first, np.minimum(np.append(first[1:], len(data)), ends[word]), odd[word]


def _distinct(keys: list) -> tuple[list, np.ndarray, np.ndarray]:
    """The distinct keys, where each stands first, and which of them each key is."""
    place: dict = {}
    inverse = np.fromiter((place.setdefault(k, len(place)) for k in keys), np.int64, len(keys))
    first = np.zeros(len(place), np.int64)
    first[inverse[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return list(place), first, inverse


class Memory:
    """What was met in this generation and the last; a full generation becomes the last one."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.new[key] = found  # it keeps coming up
        return found

    def put(self, key, value) -> None:
        self.new[key] = value

    def age(self) -> None:
        """To be called between slices, so what a slice has met stays while it is at hand."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}


class Encoder:
    """Tokens of whole texts. Parts of words live in sorted arrays, chunks in a dictionary."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary)
        self.model.no_truncation()
        self.model.no_padding()
        size = self.model.get_vocab_size()
        names = [self.model.id_to_token(i) or "" for i in range(size)]
        self.closes = np.fromiter((x.endswith("</w>") for x in names), bool, size)
        shown = [x.encode() + b" " for x in names]
        self.shown_len = np.fromiter(map(len, shown), np.int64, size)
        self.shown_at = np.concatenate([[0], np.cumsum(self.shown_len)[:-1]])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.chunks, self.joins = Memory(MAX_CHUNKS), Memory(MAX_JOINS)
        self.met = self.encoded = self.widened = 0  # chunks, those encoded anew, rows encoded whole
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    def _encode_new(self, texts: list[str], whole: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        plain = np.flatnonzero(~whole).tolist()
        for k in range(0, len(plain), 2000):
            some = plain[k : k + 2000]
            ids = np.array(self.model.encode(" ".join([texts[i] for i in some]), add_special_tokens=False).ids, self.kind)
            parts = np.split(ids, np.flatnonzero(self.closes[ids])[:-1] + 1)
            if len(parts) == len(some):
                for i, part in zip(some, parts, strict=True):
                    out[i] = part
        for i, done in enumerate(out):
            if done is None:
                out[i] = np.array(self.model.encode(texts[i], add_special_tokens=False).ids, self.kind)
        return out

    def part_ids(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given parts of words end to end and the bounds of each; each is encoded once."""
        names = vec.span_hash(low, starts, ends) ^ whole.astype(np.uint64)
        distinct, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > MAX_PARTS:
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] == distinct
        new = np.flatnonzero(~known)
        if len(new):
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            blob = low.tobytes()
            ids = self._encode_new([blob[a:b].decode("utf-8", "replace") for a, b in spans], whole[first[new]])
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            where = len(self.pool) + np.cumsum(size) - size
            self.pool = np.concatenate([self.pool, *ids])
            self.keys = np.insert(self.keys, at[new], distinct[new])
            self.at = np.insert(self.at, at[new], where)
            self.size = np.insert(self.size, at[new], size)
            at = np.searchsorted(self.keys, distinct)
        length = self.size[at][inverse]
        return self.pool[vec.gather(self.at[at][inverse], length)], np.concatenate([[0], np.cumsum(length)])

    def encode(self, part: vec.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and the index of each row's first id and the end."""
        starts, ends, first_word = vec.runs(~vec.SPACE[part.data], part.offsets)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(part.rows + 1, np.int64)
        self.chunks.age()
        self.joins.age()
        low, ustart, uend, uwhole = units(part.data, starts, ends)
        blob = low.tobytes()
        of_word = np.append(np.searchsorted(ustart, starts), len(ustart))
        cuts = chunk_starts(part.data, part.offsets)
        stops = np.append(cuts[1:], len(part.data))
        uncut = ends <= stops[np.searchsorted(cuts, starts, "right") - 1]
        # a chunk's inner words: those that begin in it, but for a last one that the next cut splits
        lo, hi = np.searchsorted(starts, cuts), np.searchsorted(starts, stops)
        hi = hi - ((hi > lo) & ~uncut[np.maximum(hi - 1, 0)])
        lo, hi = lo[hi > lo], hi[hi > lo]
        distinct, first, inverse = _distinct([blob[a:b] for a, b in zip(starts[lo].tolist(), ends[hi - 1].tolist(), strict=True)])
        inner = [self.chunks.get(key) for key in distinct]
        new = [k for k, found in enumerate(inner) if found is None]
        self.met += len(lo)
        self.encoded += len(new)
        # joins with the words around them, in their rows
        joins = np.flatnonzero(~uncut)
        row = np.searchsorted(first_word, joins, "right") - 1
        left, right = np.maximum(joins - 1, first_word[row]), np.minimum(joins + 1, first_word[row + 1] - 1)
        jnames, jfirst, jinverse = _distinct([(blob[a:b], k) for a, b, k in zip(starts[left].tolist(), ends[right].tolist(), (joins - left).tolist(), strict=True)])
        repaired = [self.joins.get(key) for key in jnames]
        jnew = [k for k, found in enumerate(repaired) if found is None]
        at = jfirst[jnew]
        begin = np.concatenate([of_word[lo[first[new]]], of_word[left[at]], of_word[joins[at]], of_word[joins[at] + 1]])
        end = np.concatenate([of_word[hi[first[new]]], of_word[joins[at]], of_word[joins[at] + 1], of_word[right[at] + 1]])
        todo = vec.gather(begin, end - begin)
        ids, upto = self.part_ids(low, ustart[todo], uend[todo], uwhole[todo])
        edge = upto[np.concatenate([[0], np.cumsum(end - begin)])].tolist()
        fresh = [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        for k, got in zip(new, fresh, strict=False):
            inner[k] = got.copy()
            self.chunks.put(distinct[k], inner[k])
        n, m = len(new), len(jnew)
        texts = [part.text(a, b) for a, b in zip(starts[left[at]].tolist(), ends[right[at]].tolist(), strict=True)]
        for k, anew, before, own, after in zip(jnew, self.model.encode_batch(texts, add_special_tokens=False) if m else [], fresh[n : n + m], fresh[n + m : n + 2 * m], fresh[n + 2 * m :], strict=True):
            repaired[k] = self._agreed(anew.ids, before, own, after)
            self.joins.put(jnames[k], repaired[k])
        # the text's tokens: inner words of its chunks and the repaired joins, in order
        pieces = [inner[k] for k in inverse.tolist()] + [repaired[k] for k in jinverse.tolist()]
        where = np.concatenate([starts[lo], starts[joins]])
        order = np.argsort(where)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))[order]
        total = np.concatenate([[0], np.cumsum(length)])
        out, bounds = np.concatenate([pieces[k] for k in order.tolist()]), total[np.searchsorted(where[order], part.offsets)]
        odd = {int(r) for r, k in zip(row.tolist(), jinverse.tolist(), strict=True) if not len(repaired[k])}
        return self._widen(part, out, bounds, odd) if odd else (out, bounds)

    def _agreed(self, anew: list[int], before: np.ndarray, own: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The tokens of the word across the cut, if those of the words around it agree; else none."""
        last = len(anew) - len(after)
        if last > len(before) and anew[: len(before)] == before.tolist() and anew[last:] == after.tolist():
            return np.array(anew[len(before) : last], self.kind)
        return own[:0]

    def _widen(self, part: vec.Slice, ids: np.ndarray, bounds: np.ndarray, rows: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes the given rows as they stand."""
        self.widened += len(rows)
        every = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for r in rows:
            every[r] = np.array(self.model.encode(part.text(*part.offsets[r : r + 2].tolist()), add_special_tokens=False).ids, self.kind)
        return np.concatenate(every), np.concatenate([[0], np.cumsum([len(x) for x in every])])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded ids: this vocabulary has no decoder, so tokens are joined by blanks."""
        return self.shown[vec.gather(self.shown_at[ids], self.shown_len[ids])].tobytes()[:-1]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str | None) -> Encoder:
    """The worker's encoder, kept from task to task."""
    path = _vocabulary(path)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _vocabulary(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Adds the column `out` (array of int) with the ids of each text, in place of a column of that
    name; other columns stay."""
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(vocabulary)
        for batch in batches:
            for part in vec.slices(batch.column(batch.schema.get_field_index(text))):
                ids, bounds = coder.encode(part)
                array = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                rows = batch.slice(part.lo, part.rows)
                yield pa.RecordBatch.from_arrays([*rows.columns, array], names=[*rows.schema.names, out])

    return docs.mapInArrow(work, schema)


def digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Token count and digests of ids and decoded text, without moving the ids."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(vocabulary)
        for batch in batches:
            for part in vec.slices(batch.column(1)):
                ids, bounds = coder.encode(part)
                little = ids.astype("<u4")
                rows = [(hashlib.sha256(little[a:b]).hexdigest(), hashlib.sha256(coder.decode(ids[a:b])).hexdigest()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, part.rows), pa.array(np.diff(bounds), pa.int64()), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=names)

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
