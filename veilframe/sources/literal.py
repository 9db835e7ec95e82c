"""Small constant tables as SQL values: they stay local relations, which the optimizer folds and
broadcasts without a job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import folds


def table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """The rows, not none, with the names and types of the schema."""
    fields = T.StructType.fromDDL(schema).fields
    values = ", ".join(f"({', '.join(map(folds.literal, r))})" for r in rows)
    names = ", ".join(f"`{f.name}`" for f in fields)
    typed = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in fields)
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS t({names})")
