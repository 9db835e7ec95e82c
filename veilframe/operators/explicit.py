"""Explicit identifiers: entities, their weights, a score and a masked text for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X
from ..functions.constants import DEFAULT_WEIGHT, ENTITY_WEIGHTS
from ..functions.recognizers import STRUCTURED, recognize


def weight(kind: Column, weights: dict[str, float] = ENTITY_WEIGHTS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(DEFAULT_WEIGHT))


def entities(df: DataFrame, text: str = "text", recognizers=STRUCTURED, threshold: float = 0.3, out: str = "entities") -> DataFrame:
    """Adds the array of entities: (entity_type, start, end, text, confidence, weight, weighted_score).
    `recognizers` is a tuple of Recognizer, or plain patterns as `spans.recognize` takes them."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = S.recognize(body, recognizers, threshold) if isinstance(recognizers, dict) else recognize(body, tuple(recognizers), threshold)

    def weighed(s: Column) -> Column:
        w = weight(s["entity_type"])
        return F.struct(s["entity_type"], s["start"], s["end"], s["text"], F.round(s["confidence"], 4).alias("confidence"), w.alias("weight"), F.round(s["confidence"] * w, 4).alias("weighted_score"))

    return df.withColumn("_found", found).withColumn(out, F.transform("_found", weighed)).drop("_found")


def score(found: Column) -> Column:
    """0.6 of the largest weighted score and 0.4 of their mean, at most 1; 0 without entities."""
    scores = F.transform(found, lambda e: e["weighted_score"])
    return F.when(F.size(found) > 0, F.least(0.6 * F.array_max(scores) + 0.4 * X.mean(scores), F.lit(1.0))).otherwise(0.0)


def summary(df: DataFrame, found: str = "entities") -> DataFrame:
    """Adds e_score, e_count, e_types (sorted), e_max_weight, e_mean_confidence, e_median_confidence."""
    of = lambda field: F.transform(found, lambda e: e[field])
    return df.withColumns(
        {
            "e_score": score(F.col(found)),
            "e_count": F.size(found).cast("long"),
            "e_types": F.array_sort(F.array_distinct(of("entity_type"))),
            "e_max_weight": F.coalesce(F.array_max(of("weight")), F.lit(0.0)),
            "e_mean_confidence": X.mean(of("confidence")),
            "e_median_confidence": X.median(of("confidence")),
        }
    )


def mask(df: DataFrame, text: str = "text", found: str = "entities", out: str = "e_masked", mode: str = "exact") -> DataFrame:
    plain = F.transform(found, lambda e: F.struct(e["entity_type"], e["start"], e["end"], e["text"], e["confidence"]))
    return df.withColumn("_plain", plain).withColumn(out, S.masked(F.col(text), F.col("_plain"), mode)).drop("_plain")


def score_explicit(df: DataFrame, text: str = "text", threshold: float = 0.3, mode: str = "exact", recognizers=STRUCTURED) -> DataFrame:
    """Entities, scores and masked text of each row, in one narrow pass."""
    return mask(summary(entities(df, text, recognizers, threshold)), text, mode=mode)


def exploded(df: DataFrame, id: str, text: str = "text", found: str = "entities", width: int = 50) -> DataFrame:
    """One row for each entity, with its context."""
    rows = df.select(id, F.col(text).alias("_text"), F.explode(found).alias("e"))
    return rows.select(id, "e.*", S.context(F.col("_text"), F.col("e"), width).alias("context"))


def report(df: DataFrame, text: str = "text", found: str = "entities") -> DataFrame:
    """One JSON report a row: length, rounded score, count and entities."""
    body = F.struct(F.length(text).alias("text_length"), F.round("e_score", 4).alias("e_score"), F.size(found).alias("entity_count"), F.col(found).alias("entities"), F.col("e_masked").alias("masked_text"))
    return df.withColumn("report", F.to_json(body))
