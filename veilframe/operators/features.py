"""The wide feature row of each text, from its explicit entities, quasi-identifiers and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import text as X
from ..functions.constants import DIRECT_TYPES, NARRATIVE_TYPES

#: Features whose correlation with the label is reported, in the order that breaks ties.
CORRELATED = """
e_mean_confidence e_median_confidence q_mean_confidence q_median_confidence combined_mean_confidence combined_median_confidence
e_score q_score e_q_score_sum e_q_score_product e_q_score_max score_disparity total_entity_count e_score_entity_count
q_score_qi_count unique_entity_type_count entity_density narrative_entity_count direct_identifier_count mask_ratio
mask_token_count chars_masked_ratio e_score_coverage q_score_coverage text_length word_count sentence_count has_person
has_location has_datetime has_organization has_direct_identifier has_high_risk_combo high_risk_combo_count
""".split()


def text_features(df: DataFrame, text: str = "text", masked: str = "q_masked") -> DataFrame:
    words, tokens = F.col("word_count"), F.col("mask_token_count")
    df = df.withColumns({"text_length": F.length(text), "word_count": X.word_count(F.col(text)), "sentence_count": X.sentence_count(F.col(text)), "masked_text_length": F.length(masked), "mask_token_count": X.mask_tokens(F.col(masked)), "remaining_word_count": X.word_count(F.col(masked))})
    return df.withColumns({"mask_ratio": X.ratio(tokens, words), "chars_masked_ratio": 1 - X.ratio(F.col("masked_text_length"), F.col("text_length"))})


def entity_features(df: DataFrame, entities: str = "entities", qis: str = "qis") -> DataFrame:
    """Counts, memberships and combinations of the types of entities (arrays of structs)."""
    e_types = F.transform(entities, lambda e: e["entity_type"])
    q_types = F.transform(qis, lambda q: q["qi_type"])
    df = df.withColumns({"_e": e_types, "_kinds": F.array_distinct(e_types), "_all": folds.ordered(F.array_union(F.array_distinct(e_types), q_types))})
    among = lambda names: F.size(F.filter("_e", lambda t: t.isin(*names)))
    has = lambda name: F.array_contains("_kinds", name)
    total = F.size(entities) + F.size(qis)
    return df.withColumns(
        {
            "e_score_entity_count": F.size(entities), "q_score_qi_count": F.size(qis), "total_entity_count": total, "unique_entity_type_count": F.size("_all"),
            "entity_density": 100 * X.ratio(total, F.col("word_count")),
            "has_person": has("PERSON"), "has_location": has("LOCATION"), "has_datetime": has("DATE_TIME"), "has_organization": has("ORGANIZATION"),
            "has_direct_identifier": F.arrays_overlap("_kinds", F.array(*map(F.lit, DIRECT_TYPES))),
            "narrative_entity_count": among(NARRATIVE_TYPES), "direct_identifier_count": among(DIRECT_TYPES),
            "high_risk_combo_count": X.risky_sets(F.col("_kinds")),
            "entity_type_combo_signature": F.array_join("_all", "|"),
        }
    ).withColumn("has_high_risk_combo", F.col("high_risk_combo_count") > 0).drop("_e", "_kinds", "_all")


def score_features(df: DataFrame, e: str = "e_score", q: str = "q_score") -> DataFrame:
    q4 = F.round(q, 4)
    return df.withColumns({"e_q_score_sum": F.col(e) + q4, "e_q_score_product": F.col(e) * q4, "e_q_score_max": F.greatest(F.col(e), q4), "score_disparity": F.abs(F.col(e) - q4)})


def confidence_features(df: DataFrame, entities: str = "entities", qis: str = "qis") -> DataFrame:
    es, qs = F.transform(entities, lambda e: e["confidence"]), F.transform(qis, lambda q: q["confidence"])
    named: dict[str, Column] = {}
    for name, values in (("e", es), ("q", qs), ("combined", F.concat(es, qs))):
        named |= {f"{name}_mean_confidence": X.mean(values), f"{name}_median_confidence": X.median(values)}
    return df.withColumns(named)


#: Features drawn against the contextual score, and those of the correlation matrix.
SCATTERED = ("total_entity_count", "entity_density", "mask_ratio", "unique_entity_type_count", "narrative_entity_count", "e_q_score_sum")
MATRIX = (*SCATTERED, "e_score", "q_score", "combined_mean_confidence", "c_score")


def coverage_features(df: DataFrame, text: str = "text", e_masked: str = "e_masked", q_masked: str = "q_masked") -> DataFrame:
    return df.withColumns({"e_score_coverage": X.coverage(F.col(text), F.col(e_masked)), "q_score_coverage": X.coverage(F.col(e_masked), F.col(q_masked))})


def weighted(e: Column, q: Column, c: Column) -> Column:
    return 0.3 * e + 0.3 * q + 0.4 * c


def all_features(df: DataFrame, text: str = "text", entities: str = "entities", qis: str = "qis") -> DataFrame:
    """Every feature of a row that has entities, qis, e_score, q_score, e_masked and q_masked."""
    df = entity_features(text_features(df, text), entities, qis)
    return coverage_features(confidence_features(score_features(df), entities, qis), text)
