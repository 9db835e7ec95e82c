"""Spans of entities in texts, as arrays of (entity_type, start, end, text, confidence) columns.

Everything stays in array columns, so a document's spans never leave its row. Offsets count code
points and the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import folds

SPAN = "array<struct<entity_type:string,start:int,end:int,text:string,confidence:double>>"


_MATCH, _END = "\ufdd2", "\ufdd3"  # code points that no text may hold


def matches(text: Column, pattern: str, kind: str, confidence: float) -> Column:
    """Spans of all matches of a pattern that never matches nothing. The pattern runs over the text
    once: marks go round each match, and the lengths of the pieces between marks give the places."""
    marked = F.regexp_replace(folds.without(text, _MATCH + _END), F.lit(pattern), F.lit(f"{_MATCH}$0{_END}"))
    # the first part has no match, the others one and what follows
    parts = f"transform(split(m, '{_MATCH}'), p -> split(p, '{_END}'))"
    end = "a.at + length(get(p, 0))"
    one = f"named_struct('entity_type', {folds.literal(kind)}, 'start', a.at, 'end', {end}, 'text', get(p, 0), 'confidence', {float(confidence)!r}D)"
    found = f"CASE WHEN size(p) > 1 THEN concat(a.found, array({one})) ELSE a.found END"
    step = f"(a, p) -> named_struct('at', {end} + coalesce(length(get(p, 1)), 0), 'found', {found})"
    all_ = f"aggregate({parts}, named_struct('at', 0, 'found', CAST(array() AS {SPAN})), {step}, a -> a.found)"
    # most texts hold no match: they are told by the marks, without a fold
    return F.get(folds.each(F.array(marked), f"m -> CASE WHEN m IS NULL OR contains(m, '{_MATCH}') THEN {all_} ELSE CAST(array() AS {SPAN}) END"), F.lit(0))


def recognize(text: Column, recognizers: dict[str, tuple[str, float, str, bool]], threshold: float = 0.3) -> Column:
    """Spans of all recognizers whose confidence reaches the threshold, sorted by start. A cheap
    substring test spares most texts the pattern."""
    none = F.array().cast(SPAN)
    parts = []
    for kind, (pattern, confidence, needs, luhn) in recognizers.items():
        if confidence < threshold:
            continue
        spans = matches(text, pattern, kind, confidence)
        if luhn:
            spans = F.filter(spans, lambda s: F.call_function("luhn_check", s["text"]))
        parts.append(F.when(F.contains(text, F.lit(needs)), spans).otherwise(none) if needs else spans)
    return F.coalesce(by_start(F.concat(*parts)), none) if parts else none


def by_start(spans: Column) -> Column:
    """Sorted by start; spans that start together keep the order (end, type)."""
    keyed = folds.each(spans, "s -> named_struct('a', s.start, 'b', s.end, 'c', s.entity_type, 's', s)")
    return folds.each(folds.ordered(keyed), "k -> k.s")


def context(text: Column, span: Column, width: int = 50) -> Column:
    """The span with `width` characters on either side, and ... where the text goes on."""
    left, right = F.greatest(span["start"] - width, F.lit(0)), F.least(span["end"] + width, F.length(text))
    body = F.substring(text, left + 1, right - left)
    return F.concat(F.when(left > 0, "...").otherwise(""), body, F.when(right < F.length(text), "...").otherwise(""))


def splice(text: Column, spans: Column, token: str | None = None) -> Column:
    """Replaces spans from the last to the first, each by its original offsets in the text as it
    stands then: overlapping spans cut into their neighbours' tokens. Spans that start together go
    in the order of the array."""
    keyed = folds.each(spans, "(s, i) -> named_struct('a', -s.start, 'i', i, 's', s)")
    mark = "concat('[', k.s.entity_type, ']')" if token is None else folds.literal(token)
    step = f"(a, k) -> concat(substring(a, 1, k.s.start), {mark}, substring(a, k.s.end + 1, length(a)))"
    return folds.fold(folds.ordered(keyed), text, step, "a -> a")


def disjoint(spans: Column) -> Column:
    """Spans that begin after the end of all kept before them, the first of each overlap kept."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast(SPAN).alias("kept"))
    step = lambda a, s: F.when(s["start"] >= a["end"], F.struct(s["end"].alias("end"), F.concat(a["kept"], F.array(s)).alias("kept"))).otherwise(a)
    return F.aggregate(by_start(spans), start, step, lambda a: a["kept"])


def masked(text: Column, spans: Column, mode: str = "exact") -> Column:
    """`exact` splices all spans as they are; `merged` drops overlapping ones first."""
    if mode not in ("exact", "merged"):
        raise ValueError(f"unknown mode {mode!r}")
    return splice(text, spans if mode == "exact" else disjoint(spans))
