"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's symbols are its characters, a blank before the first one and every blank as ▁. An agenda
holds the adjacent pairs whose joint text is a piece, by score, the leftmost of equal ones first; the
best pair merges, and its neighbours enter the agenda anew. What is no piece in the end falls back to
its bytes.

No merge crosses two characters that stand together in no piece of the vocabulary, so a text falls
into spans at such places, and each distinct span is encoded once by a worker and kept in a bounded
table, whose characters are compared before a span is taken from it. Short spans take the best pair
of each span's agenda in lockstep, as array operations; longer ones have a heap each.

Every span that enters the table is checked against the sentencepiece library in the same Arrow
batch: a difference is an error, so no result depends on an unchecked merge.

Null and empty texts have no ids and decode to the empty string. Rows are encoded one by one, in
slices of about 1 MB, so repeated rows and ids give repeated results, and columns of any name stay.
Vocabularies with unused pieces, without byte pieces, or with a normalisation of their own raise an
error, the last by the check.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import vec

BLANK = "▁"
LOCKSTEP = 64  # symbols up to which spans are encoded in lockstep
MAX_SPANS = 400_000  # spans that a worker remembers before it starts afresh
CHECKED = 2000  # spans in one text that the library encodes
_NONE = np.int32(2**31 - 1)


class Pairs:
    """Two adjacent symbols to the piece that they make, by a sorted array."""

    def __init__(self, found: dict[tuple[int, int], int], rank: np.ndarray):
        keys = np.array([a << 32 | b for a, b in found], np.uint64)
        self.directory = vec.Directory(vec.mix(keys))
        self.piece = np.append(np.fromiter(found.values(), np.int64, len(found)), -1)
        self.rank = np.append(rank[self.piece[:-1]], _NONE).astype(np.int32)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The index of each pair in `piece` and `rank`, whose last entry stands for none."""
        return self.directory.find(vec.mix(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)))


class Encoder:
    """Ids of whole texts by a sentencepiece model."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        ids = range(size)
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in ids]
        if any(map(sp.is_unused, ids)) or sum(map(sp.is_byte, ids)) != 256:
            raise ValueError("the vocabulary must have all byte pieces and no unused ones")
        pieces = {sp.id_to_piece(i): i for i in ids if plain[i]}
        symbols = pieces | {c: size + k for k, c in enumerate(sorted({c for p in pieces for c in p} - pieces.keys()))}
        self.symbols, self.size = symbols, size
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        _, rank = np.unique([-sp.get_score(i) for i in ids], return_inverse=True)  # a higher score merges first
        self.merges = {(symbols[p[:k]], symbols[p[k:]]): i for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        self.rank = rank.astype(np.int32)
        self.pairs = Pairs(self.merges, self.rank)
        # characters that stand together in some piece
        together = {(p[k], p[k + 1]) for p in pieces for k in range(len(p) - 1)}
        chars = sorted({c for pair in together for c in pair})
        self.inner = np.full(0x110000, len(chars), np.int32)
        self.inner[[ord(c) for c in chars]] = np.arange(len(chars))
        self.width = len(chars) + 1
        bits = np.zeros(self.width * self.width + 7, bool)
        bits[[int(self.inner[ord(a)]) * self.width + int(self.inner[ord(b)]) for a, b in together]] = True
        self.together = np.packbits(bits)
        # what an id is in a decoded text
        byte = {sp.piece_to_id(f"<0x{b:02X}>"): b for b in range(256)}
        self.byte_ids = np.array(sorted(byte, key=byte.get), np.int32)
        shown = [bytes([byte[i]]) if i in byte else sp.id_to_piece(i).replace(BLANK, " ").encode() if plain[i] else b" \xe2\x81\x87 " if sp.is_unknown(i) else b"" for i in ids]
        self.shown, self.shown_at, self.shown_len = _pool(shown)
        self.decimal, self.decimal_at, self.decimal_len = _pool([b"%d," % i for i in ids])
        self.mark = next(c for c in map(chr, range(1, 32)) if self.of_char[ord(c)] < 0)  # between spans of a check
        self.met = self.encoded = 0
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of the spans, sorted
        self.text_at = self.ids_at = self.ids_len = np.zeros(0, np.int64)
        self.chars, self.ids = np.zeros(0, np.uint32), np.zeros(0, np.int32)

    # the agenda

    def merge_one(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, by a heap of pairs (rank, left)."""
        n = len(symbols)
        sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def enter(left: int) -> None:
            right = after[left]
            if right < n and (piece := self.merges.get((sym[left], sym[right]))) is not None:
                heapq.heappush(agenda, (int(self.rank[piece]), left, right, piece))

        made = [0] * n  # merges that a symbol has seen: an entry of before is stale
        for k in range(n - 1):
            enter(k)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            if made[left] < 0 or after[left] != right or self.merges.get((sym[left], sym[right])) != piece:
                continue
            sym[left], made[right] = piece, -1
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                enter(left)
            if before[left] >= 0:
                enter(before[left])
        return [s for s, gone in zip(sym, made, strict=True) if gone >= 0]

    def merge_all(self, sym: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of many short spans after all merges, and how many each has. Each round merges
        the best pair of every span that has one."""
        span = np.repeat(np.arange(len(length)), length)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def ranked(left: np.ndarray) -> np.ndarray:
            """Of the pairs that begin at these places; none where a span ends."""
            out = np.full(len(left), -1)
            some = np.flatnonzero(left + 1 < len(sym))
            some = some[span[left[some]] == span[left[some] + 1]]
            out[some] = self.pairs.find(sym[left[some]], sym[left[some] + 1])
            return out

        pair = ranked(np.arange(len(sym)))
        while len(sym):
            rank = self.pairs.rank[pair]
            first = np.flatnonzero(np.diff(span, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(span)))
            open_ = np.repeat(best < _NONE, size)
            if not open_.all():
                done.append((span[~open_], sym[~open_]))
                sym, span, pair, rank, best, size = sym[open_], span[open_], pair[open_], rank[open_], best[best < _NONE], size[best < _NONE]
            if not len(sym):
                break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            hit = hit[np.diff(span[hit], prepend=-1) != 0]  # the leftmost of each span
            sym = sym.copy()
            sym[hit] = self.pairs.piece[pair[hit]]
            stays = np.ones(len(sym), bool)
            stays[hit + 1] = False
            hit = hit - np.arange(len(hit))  # where it stands after the removals
            sym, span, pair = sym[stays], span[stays], pair[stays]
            again = np.concatenate([hit, hit[hit > 0] - 1])
            pair[again] = ranked(again)
        if not done:
            return sym, np.zeros(len(length), np.int64)
        span, sym = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        return sym[np.argsort(span, kind="stable")], np.bincount(span, minlength=len(length))

    def merged(self, chars: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spans given by their characters end to end, and how many each has."""
        sym = self.of_char[chars].astype(np.int64)
        strange = sym < 0
        sym[strange] = self.size + len(self.symbols) + chars[strange]  # stand alone, for they're in no piece
        begin = np.cumsum(length) - length
        short = length <= LOCKSTEP
        out, count = self.merge_all(sym[vec.gather(begin[short], length[short])], length[short])
        parts, sizes = [out], np.zeros(len(length), np.int64)
        sizes[short] = count
        for k in np.flatnonzero(~short):
            parts.append(np.array(self.merge_one(sym[begin[k] : begin[k] + length[k]].tolist()), np.int64))
            sizes[k] = len(parts[-1])
        order = np.concatenate([np.flatnonzero(short), np.flatnonzero(~short)])
        out = np.concatenate(parts)
        at = np.empty(len(length), np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        return self._to_bytes(out[vec.gather(at, sizes)], sizes)

    def _to_bytes(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become their bytes."""
        odd = np.flatnonzero(sym >= self.size)
        if not len(odd):
            return sym.astype(np.int32), sizes
        names = {i: s for s, i in self.symbols.items() if i >= self.size}
        known = self.size + len(self.symbols)
        raw = [(chr(s - known) if s >= known else names[s]).encode() for s in sym[odd].tolist()]
        long = np.ones(len(sym), np.int64)
        long[odd] = [len(r) for r in raw]
        out = np.repeat(sym, long)
        at = np.cumsum(long) - long
        out[vec.gather(at[odd], long[odd])] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        total = np.concatenate([[0], np.cumsum(long)])
        return out.astype(np.int32), np.diff(total[upto])

    def check(self, chars: np.ndarray, length: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Raises where the library encodes a span in another way. Spans stand in one text between
        marks, which are in no piece; a mark itself has its byte's id."""
        mark = ord(self.mark)
        alone = int(self.byte_ids[mark])
        begin, at = np.cumsum(length) - length, np.concatenate([[0], np.cumsum(sizes)])
        some = np.flatnonzero(~((length == 1) & (chars[begin] == mark)))
        for k in range(0, len(some), CHECKED):
            part = some[k : k + CHECKED]
            text = np.full(len(part) + int(length[part].sum()), mark, "<u4")
            after = np.cumsum(length[part] + 1)
            text[vec.gather(after - length[part], length[part])] = chars[vec.gather(begin[part], length[part])]
            theirs = np.array(self.library.encode(text.tobytes().decode("utf-32-le")), np.int32)
            begun = np.flatnonzero(theirs == alone)
            mine = ids[vec.gather(at[part], sizes[part])]
            if not np.array_equal(np.diff(np.append(begun, len(theirs))) - 1, sizes[part]) or not np.array_equal(np.delete(theirs, begun)[begun[0] :], mine):
                raise ValueError(f"the agenda and the library differ among the spans {text[:200].tobytes().decode('utf-32-le')!r}...")

    # whole texts

    def span_starts(self, chars: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sorted starts of the spans; each row begins one."""
        k = self.inner[chars].astype(np.int64)
        k = k[:-1] * self.width + k[1:]
        cut = np.ones(len(chars), bool)
        cut[1:] = (self.together[k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1) == 0
        cut[rows[rows < len(chars)]] = True
        return np.flatnonzero(cut)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the index of each text's first id and the end."""
        texts = [BLANK + t if t else "" for t in texts]
        rows = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        if not len(chars):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        chars = np.where(chars == 0x20, np.uint32(ord(BLANK)), chars)
        starts = self.span_starts(chars, rows)
        ends = np.append(starts[1:], len(chars))
        at, size = self._spans(chars, starts, ends)
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.ids[vec.gather(at, size)], upto[np.searchsorted(starts, rows)]

    def _spans(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each span stand in the table, and how many it has."""
        names = vec.span_hash(chars.view(np.uint8), starts * 4, ends * 4)
        distinct, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > MAX_SPANS:
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~known)
        self.met += len(starts)
        self.encoded += len(new)
        if len(new):
            length = (ends - starts)[first[new]]
            text = chars[vec.gather(starts[first[new]], length)]
            ids, sizes = self.merged(text, length)
            self.check(text, length, ids, sizes)
            self.text_at = np.insert(self.text_at, at[new], len(self.chars) + np.cumsum(length) - length)
            self.ids_at = np.insert(self.ids_at, at[new], len(self.ids) + np.cumsum(sizes) - sizes)
            self.ids_len = np.insert(self.ids_len, at[new], sizes)
            self.keys = np.insert(self.keys, at[new], distinct[new])
            self.chars, self.ids = np.concatenate([self.chars, text]), np.concatenate([self.ids, ids])
            at = np.searchsorted(self.keys, distinct)
        where = at[inverse]
        if not np.array_equal(self.chars[vec.gather(self.text_at[where], ends - starts)], chars):
            raise ValueError("two spans of text have the same hash")
        return self.ids_at[where], self.ids_len[where]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the ids of one text, without the blank that encoding puts before it."""
        raw = self.shown[vec.gather(self.shown_at[ids], self.shown_len[ids])].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


def _pool(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values end to end, where each begins and its length."""
    length = np.fromiter(map(len, values), np.int64, len(values))
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(length) - length, length


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, model: str | None = None, text: str = "text", out: str = "piece_ids") -> DataFrame:
    """Adds the column `out` (array of int) with the ids of each text, in place of a column of that
    name; other columns stay."""
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for batch in batches:
            for part in vec.slices(batch.column(place)):
                rows = batch.slice(part.lo, part.rows)
                ids, bounds = coder.encode(rows.column(place).to_pylist())
                array = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*rows.columns, array], names=[*rows.schema.names, out])

    return docs.mapInArrow(work, schema)


def decode(docs: DataFrame, model: str | None = None, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """Adds the column `out` (string) with the text of the ids, in place of a column of that name; a
    null array stays null."""
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())])
    place = docs.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return docs.mapInArrow(work, schema)


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Token count and digests of ids and decoded text, without moving the ids."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for batch in batches:
            for part in vec.slices(batch.column(1)):
                ids, bounds = coder.encode(batch.column(1).slice(part.lo, part.rows).to_pylist())
                decimals = coder.decimal[vec.gather(coder.decimal_at[ids], coder.decimal_len[ids])].tobytes()
                upto = np.concatenate([[0], np.cumsum(coder.decimal_len[ids])])[bounds].tolist()
                first = bounds.tolist()
                shown = [hashlib.sha256(decimals[a : max(a, b - 1)]).hexdigest() for a, b in zip(upto[:-1], upto[1:], strict=True)]
                texts = [hashlib.sha256(coder.decode(ids[a:b])).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, part.rows), pa.array(np.diff(bounds), pa.int64()), pa.array(shown), pa.array(texts)], names=names)

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
