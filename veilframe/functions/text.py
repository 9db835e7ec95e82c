"""Scalar features of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import folds
from .constants import RISKY_SETS

MASK = "\\[[A-Z_]+\\]"


def word_count(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.regexp_count(text, F.lit("[^\\s\\p{Z}\\x1c-\\x1f\\x85]+"))


def sentence_count(text: Column) -> Column:
    return F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1))


def mask_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(MASK))


def coverage(original: Column, masked: Column) -> Column:
    """Share of the original's characters that no longer stand in the masked text."""
    left = F.length(F.regexp_replace(masked, MASK, ""))
    share = F.greatest(F.length(original) - left, F.lit(0)) / F.greatest(F.length(original), F.lit(1))
    return F.when(F.length(original) > 0, share).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b with b at least 1."""
    return a.cast("double") / F.greatest(b, F.lit(1))


def risky_sets(types: Column) -> Column:
    """How many of the risky sets the types hold."""
    sets = "array(" + ", ".join(folds.literal(list(one)) for one in RISKY_SETS) + ")"
    return F.size(F.filter(F.expr(sets), lambda one: F.size(F.array_except(one, types)) == 0))


def sample_hash(name: Column, text: Column, critical: Column) -> Column:
    """First 12 hex digits of the MD5 of name|text|True or False."""
    return F.substring(F.md5(F.concat_ws("|", name, text, F.initcap(critical.cast("string")))), 1, 12)


def median(values: Column) -> Column:
    """Exact median of an array, the mean of the middle two; 0 if empty."""
    middle = "get(v, CAST(floor((size(v) - 1) / 2) AS INT)).x + get(v, CAST(floor(size(v) / 2) AS INT)).x"
    keyed = folds.each(values, "x -> named_struct('last', x IS NULL, 'x', x)")  # nulls go last
    return F.get(folds.each(F.array(folds.ordered(keyed)), f"v -> CASE WHEN size(v) > 0 THEN ({middle}) / 2 ELSE 0.0D END"), F.lit(0))


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, folds.fold(values, "0.0D", "(a, x) -> a + x", "a -> a") / F.size(values)).otherwise(0.0)
