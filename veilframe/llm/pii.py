"""Personal data: regular expressions propose spans, checksums confirm them, context scores them.

One narrow pass over the texts: no shuffle, a batch at a time. Kinds email, ip, card and phone
are always kept once their own check (part range, Luhn, digit count) passes; iban is kept if its
mod-97 remainder is 1; ssn has no checksum, so only a nearby context word makes it count, and so
for a secret: a run of 20 or more characters of letters and digits that isn't a word or a number.

Null and empty texts have no spans; repeated rows have the same ones. Spans are in code points, end exclusive, sorted by start and
then by kind as in KINDS. Work is linear in the length of a text: patterns are possessive or
anchored so that no long run is scanned again from each of its characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9_+/=-])")

#: Score of a span that its check confirms, and what a context word nearby adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.85, "ssn": 0.4, "secret": 0.4}
BOOST = 0.2
NEAR = 48
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social-security"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access key", "access_key", "credential"),
}
_CONTEXT = {k: re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, v)) + ")", re.IGNORECASE) for k, v in CONTEXT.items()}
KEEP = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    rest = 0
    for c in compact[4:] + compact[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: its local part is the run of local characters
    before it, as far back as the previous match."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", at + 1 if m is None else m.end())


def _part_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    for m in _IP.finditer(text):
        if all(map(_part_ok, m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        # a word after the number may look like more of it: the longest confirmed prefix counts
        got = m[0]
        while got and not mod97(got):
            got = got[:-1].rstrip()
            if len(got) < 15:
                got = ""
        if got:
            yield "iban", m.start(), m.start() + len(got)
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end()
    for m in _SECRET.finditer(text):
        digits = len(_digits(m[0]))
        if 3 <= digits <= len(m[0]) - 3:
            yield "secret", m.start(), m.end()


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of one text's personal data."""
    found = []
    for kind, a, b in _proposals(text or ""):
        near = f"{text[max(0, a - NEAR) : a]}\n{text[b : b + NEAR]}"
        score = min(1.0, PRIOR[kind] + BOOST * bool(_CONTEXT[kind].search(near)))
        if kind in BASE or score >= KEEP:
            found.append((kind, a, b, round(score, 4)))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def detect(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds the array column `out` of (kind, start, end, score) to the rows of `docs`."""

    @F.pandas_udf(SPAN_TYPE)
    def spans(texts):
        return texts.map(lambda t: [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find_spans(t)])

    return docs.withColumn(out, spans(F.col(text)))


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind; overlapping spans are masked as one, named
    after the first."""
    if text is None:
        return None
    out, end = [], 0
    kind = None
    for k, a, b, _ in find_spans(text):
        if kind is not None and a < end:
            end = max(end, b)
            continue
        out.append(text[end:a])
        out.append(f"[{k.upper()}]")
        kind, end = k, b
    out.append(text[end:])
    return "".join(out)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` with the personal data of `text` masked; null stays null."""

    @F.pandas_udf(T.StringType())
    def hide(texts):
        return texts.map(masked)

    return docs.withColumn(text, hide(F.col(text)))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds and of all spans, digests of the spans, and
    the spans with the scores that context gave them."""
    import hashlib

    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans", "scores"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, spans, every, scores = [[] for _ in BASE], [], [], [], []
            for text in batch.column(1):
                found = find_spans(text.as_py())
                base = [s for s in found if s[0] in BASE]
                for k, kind in enumerate(BASE):
                    counts[k].append(sum(s[0] == kind for s in base))
                sha.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in base).encode()).hexdigest())
                spans.append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in found))
                every.append(len(found))
                scores.append(",".join(f"{k}:{a}:{b}:{s}" for k, a, b, s in found))
            text = lambda values: pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), text(sha), text(spans), pa.array(every, pa.int64()), text(scores)], names=names)

    kinds = ", ".join(f"n_{k} long" for k in BASE)
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id long, {kinds}, base_sha256 string, spans string, n_spans long, scores string")
