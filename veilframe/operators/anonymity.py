"""Expected k: how many people share a row's quasi-identifiers, and the score and mask from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import spans as S
from ..functions.constants import K_DEFAULT, POPULATION, RARE_BELOW
from ..sources.shared import shuffled
from .population import look_up, looked_up, mapped


def with_frequencies(df: DataFrame, population: DataFrame, id: str, qis: str = "qis", out: str = "qis", today: Column | None = None, in_place: bool = False) -> DataFrame:
    """Adds to each QI of the array its frequency. QIs leave their rows narrow, without the text,
    meet the population table and come back as arrays. `id` must tell the rows apart. With `in_place`, for a
    population that `population.fits`, the table goes to the rows instead, in which nothing moves."""
    if in_place:
        kept = ("qi_type", "raw_value", "normalized_value", "confidence", "start_pos", "end_pos", "method")
        own = lambda q, i: F.struct(i.alias("_pos"), *(q[c].alias(c) for c in kept))
        met = df.withColumn(out, F.coalesce(qis, F.array().cast(df.schema[qis].dataType))).crossJoin(F.broadcast(mapped(population)))
        return met.withColumn(out, F.transform(out, lambda q, i: looked_up(own(q, i), F.col("_known"), today))).drop("_known")
    # outer: a plain explode would have the optimizer test the array's size at the scan, extracting anew
    narrow = df.select(id, F.posexplode_outer(qis).alias("_pos", "_q")).where("_pos is not null").select(id, "_pos", "_q.*")
    found = look_up(narrow, population, today)
    one = F.struct("_pos", "qi_type", "raw_value", "normalized_value", "confidence", "start_pos", "end_pos", "method", "probability", "population_count", "source")
    arrays = found.groupBy(id).agg(folds.ordered(F.collect_list(one)).alias("_qis"))
    kind = arrays.schema["_qis"].dataType.simpleString()
    return df.drop(out).join(shuffled(arrays), id, "left").withColumn(out, F.coalesce("_qis", F.array().cast(kind))).drop("_qis")


def joint(qis: Column) -> Column:
    """The product of the known probabilities."""
    return F.aggregate(F.filter(qis, lambda q: q["probability"].isNotNull()), F.lit(1.0), lambda a, q: a * q["probability"])


def _spans(qis: Column) -> Column:
    return F.transform(qis, lambda q: F.struct(F.upper(q["qi_type"]).alias("entity_type"), q["start_pos"].alias("start"), q["end_pos"].alias("end"), q["raw_value"].alias("text"), q["confidence"].alias("confidence")))


def score(df: DataFrame, text: str = "text", qis: str = "qis", k: int = K_DEFAULT, people: float = POPULATION) -> DataFrame:
    """Adds expected_k, q_score and q_masked. Rows without a known frequency have the population as
    expected k and score 0; text is masked only where the expected k falls short of k."""
    known = F.exists(qis, lambda q: q["probability"].isNotNull())
    expected = F.when(known, people * joint(F.col(qis))).otherwise(float(people))
    df = df.withColumn("expected_k", expected)
    short = F.col("expected_k") < k
    df = df.withColumn("q_score", F.when(short, F.least(F.lit(1.0), 1 - F.col("expected_k") / k)).otherwise(0.0))
    return df.withColumn("_spans", _spans(F.col(qis))).withColumn("q_masked", F.when(short, S.splice(F.col(text), F.col("_spans"))).otherwise(F.col(text))).drop("_spans")


def level(q: Column) -> Column:
    return F.when(q >= 0.7, "HIGH").when(q >= 0.3, "MEDIUM").otherwise("LOW")


def explain(df: DataFrame, qis: str = "qis", k: int = K_DEFAULT) -> DataFrame:
    """Adds the explanation: a line for each QI and one on the expected k."""
    tell = lambda q: F.when(q["probability"].isNull(), "(frequency unknown)").otherwise(F.format_string("(P ≈ %.2e, ~%,d people) [%s]", q["probability"], q["population_count"], q["source"]))
    line = lambda q: F.concat(F.lit("  - "), q["qi_type"], F.lit(": '"), q["normalized_value"], F.lit("' ["), q["method"], F.lit("] "), tell(q))
    e, n = F.col("expected_k"), F.size(qis)
    verdict = F.when(e < 1, "🚨 E[k] < 1: Likely UNIQUELY IDENTIFYING").when(e < k, f"⚠️ E[k] < {k}: HIGH re-identification risk").otherwise(f"✓ E[k] ≥ {k}: Acceptable k-anonymity")
    head = F.format_string("Detected %d quasi-identifier(s):", n)
    size = F.concat(F.lit("\nExpected equivalence class size E[k]: "), F.replace(F.format_number(e, 4), F.lit(","), F.lit("")))
    full = F.array_join(F.concat(F.array(head), F.transform(qis, line), F.array(size, verdict)), "\n")
    none = F.format_string("Detected %d QI(s) but could not lookup frequencies.", n)
    known = F.exists(qis, lambda q: q["probability"].isNotNull())
    return df.withColumn("explanation", F.when(n == 0, "No quasi-identifiers detected.").when(~known, none).otherwise(full))


def report(df: DataFrame, qis: str = "qis", k: int = K_DEFAULT) -> DataFrame:
    """A struct column `report`: the scores rounded to 4 digits, level, QIs with places and
    frequencies, explanation and masked text."""
    item = lambda q: F.struct(
        q["qi_type"].alias("type"), q["raw_value"].alias("raw_value"), q["normalized_value"].alias("normalized_value"), q["confidence"].alias("confidence"), q["method"].alias("detection_method"),
        F.struct(q["start_pos"].alias("start"), q["end_pos"].alias("end")).alias("position"),
        F.when(q["probability"].isNotNull(), F.struct(q["probability"].alias("probability"), q["population_count"].alias("population_count"), q["source"].alias("source"))).alias("frequency"),
    )
    df = explain(df, qis, k)
    body = F.struct(
        F.round("q_score", 4).alias("q_score"), F.round("expected_k", 4).alias("expected_k"), level(F.col("q_score")).alias("risk_level"), F.lit(k).alias("k_threshold"),
        F.transform(qis, item).alias("detected_quasi_identifiers"), F.col("explanation"), F.col("q_masked").alias("masked_text"),
    )
    return df.withColumn("report", body)


def rare(qis: Column, kind: str) -> Column:
    """Whether a QI of the type is rarer than one in a thousand; unknown frequencies aren't."""
    return F.exists(qis, lambda q: (q["qi_type"] == kind) & (F.coalesce(q["probability"], F.lit(1.0)) < RARE_BELOW))


def empirical(df: DataFrame, *columns: str) -> DataFrame:
    """Adds k, the number of rows that share the columns' values, and expected_k under independence
    of the columns. The distinct values of the columns are what moves, not the rows."""
    total = df.agg(F.count("*").alias("_n"))
    groups = df.groupBy(*columns).agg(F.count("*").alias("k"))
    for c in columns:
        share = df.groupBy(c).agg(F.count("*").alias(f"_n_{c}"))
        groups = groups.join(share, c)
    product = F.col("_n").cast("double")
    for c in columns:
        product = product * F.col(f"_n_{c}") / F.col("_n")
    return groups.crossJoin(F.broadcast(total)).select(*columns, "k", product.alias("expected_k"))
