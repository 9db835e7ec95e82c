"""Higher-order functions whose lambdas are SQL text. They give the plans that lambdas over columns
give, but the driver makes one call to the JVM for a lambda in place of one for each operator in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(value) -> str:
    """A constant as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(literal, value))})"
    return str(value)


def constants(values) -> Column:
    """The values as an array."""
    return F.expr(literal(list(values)))


def each(values: Column | str, change: str) -> Column:
    return F.call_function("transform", values, F.expr(change))


def keep(values: Column | str, test: str) -> Column:
    return F.call_function("filter", values, F.expr(test))


def fold(values: Column | str, start: Column | str, step: str, finish: str) -> Column:
    """`start` is SQL text or a column."""
    return F.call_function("aggregate", values, F.expr(start) if isinstance(start, str) else start, F.expr(step), F.expr(finish))


def ordered(values: Column | str) -> Column:
    """Sorted; no member may be null. The order of `array_sort`, whose comparison is a lambda that Spark works
    out anew for each pair."""
    return F.sort_array(values)


def without(text: Column, marks: str) -> Column:
    """The text with U+FFFD in place of the marks, which hardly any text holds."""
    held = [F.contains(text, F.lit(m)) for m in marks]
    return F.when(held[0] | held[1], F.translate(text, marks, "\ufffd" * len(marks))).otherwise(text)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is worked out once, also within a lambda, where Spark works out
    anew what stands in an expression twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
