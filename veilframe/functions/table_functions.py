"""Table functions for SQL: `entity_spans(text, kinds)` gives a row for each entity of a text.

    register(spark)
    spark.sql("SELECT doc_id, s.* FROM documents, LATERAL entity_spans(text, 'URL,EMAIL_ADDRESS') s")
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .constants import RECOGNIZERS

_SCHEMA = T.StructType([T.StructField("entity_type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())])


def _luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


class EntitySpans:
    """The spans of plain recognizers, by start, end and type; a null or empty text has none. `kinds` is
    a constant list of types, comma-joined, or null for all."""

    @staticmethod
    def analyze(text: AnalyzeArgument, kinds: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, (T.StringType, T.NullType)):
            raise ValueError("the first argument of entity_spans must be a text")
        if not kinds.isConstantExpression:
            raise ValueError("the second argument of entity_spans must be a constant")
        if odd := [k for k in (kinds.value or "").split(",") if k.strip() and k.strip() not in RECOGNIZERS]:
            raise ValueError(f"entity_spans knows no {', '.join(odd)}")
        return AnalyzeResult(_SCHEMA)

    def __init__(self):
        self.patterns = {k: (re.compile(p), c, needs, luhn) for k, (p, c, needs, luhn) in RECOGNIZERS.items()}

    def eval(self, text: str, kinds: str):
        some = [k.strip() for k in kinds.split(",") if k.strip()] if kinds else list(self.patterns)
        found = []
        for kind in some if text else ():
            pattern, confidence, needs, luhn = self.patterns[kind]
            if needs and needs not in text:
                continue
            found += [(kind, *m.span(), m.group(), confidence) for m in pattern.finditer(text) if not luhn or _luhn(m.group())]
        yield from sorted(found, key=lambda s: (s[1], s[2], s[0]))


def register(spark: SparkSession, name: str = "entity_spans") -> None:
    spark.udtf.register(name, udtf(EntitySpans, useArrow=True))
