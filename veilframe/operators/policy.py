"""Policy: an ordered cascade of rules gives each row a tier, a transformation and a routing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import literal


@dataclass(frozen=True)
class Policy:
    """Thresholds and switches of the cascade."""

    combined_restricted: float = 1.2
    c_restricted: float = 0.3
    e_confidential: float = 0.5
    q_confidential: float = 0.5
    combo_combined: float = 0.6
    c_confidential: float = 0.12
    e_with_q: float = 0.3
    direct_restricts: bool = True
    combo_confidential: bool = True


#: Column expected of the input and what a missing one stands for.
INPUT = {"e_score": 0.0, "q_score": 0.0, "c_score": 0.0, "has_direct": False, "has_combo": False, "rare_disease": False, "rare_occupation": False, "e_masked": "", "q_masked": ""}
TIERS = ("restricted", "confidential", "unrestricted")
ACTIONS = {"restricted": ("block", "local"), "confidential": ("reversible", "tee"), "unrestricted": ("none", "cloud")}


# The texts of the reasons.
REASONS = {
    "direct": "Direct identifier detected (SSN, passport, etc.)",
    "combined": "Combined score %s >= %s",
    "context": "High contextual sensitivity: C-Score %s",
    "factors": "Factors: %s",
    "explicit": "High explicit PII: E-Score %s",
    "rare": "Rare quasi-identifier detected (disease or occupation)",
    "quasi": "High re-identification risk: Q-Score %s",
    "combo": "High-risk entity combination (PERSON+LOCATION+DATETIME)",
    "combo_score": "Combined score %s with risk factors",
    "some_context": "Moderate contextual sensitivity: C-Score %s",
    "some_explicit": "Moderate PII with quasi-identifiers present",
    "none": "No significant sensitivity indicators detected",
    "scores": "Scores: E=%s, Q=%s, C=%s",
}


def with_defaults(df: DataFrame) -> DataFrame:
    """Adds missing input columns and fills their nulls."""
    values = {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in INPUT.items()}
    factors = F.coalesce(F.col("factors"), F.array().cast("array<string>")) if "factors" in df.columns else F.array().cast("array<string>")
    return df.withColumns(values | {"factors": factors})


def _rules(p: Policy) -> list[tuple[str, str, Column, list]]:
    """(rule, tier, condition, reasons), first match wins; a null reason is left out."""
    e, q, c = F.col("e_score"), F.col("q_score"), F.col("c_score")
    combined = e + q + c
    two = lambda x: F.format_number(x, 2)
    return [
        ("R1", "restricted", F.lit(p.direct_restricts) & F.col("has_direct"), [REASONS["direct"]]),
        ("R2", "restricted", combined >= p.combined_restricted, [F.format_string(REASONS["combined"], two(combined), F.lit(str(p.combined_restricted)))]),
        ("R3", "restricted", c >= p.c_restricted, [F.format_string(REASONS["context"], two(c)), F.when(F.size("factors") > 0, F.format_string(REASONS["factors"], F.array_join("factors", ", ")))]),
        ("R4a", "confidential", e >= p.e_confidential, [F.format_string(REASONS["explicit"], two(e))]),
        ("R4b", "confidential", F.col("rare_disease") | F.col("rare_occupation"), [REASONS["rare"]]),
        ("R4c", "confidential", q >= p.q_confidential, [F.format_string(REASONS["quasi"], two(q))]),
        ("R5", "confidential", F.lit(p.combo_confidential) & F.col("has_combo") & (combined >= p.combo_combined), [REASONS["combo"], F.format_string(REASONS["combo_score"], two(combined))]),
        ("R6", "confidential", c >= p.c_confidential, [F.format_string(REASONS["some_context"], two(c))]),
        ("R7", "confidential", (e >= p.e_with_q) & (q > 0), [REASONS["some_explicit"]]),
        ("default", "unrestricted", F.lit(True), [REASONS["none"], F.format_string(REASONS["scores"], two(e), two(q), two(c))]),
    ]


def decide(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds combined, rule, tier, transformation, routing, needs_reconstruction, needs_attestation,
    masked_text (null but for confidential rows) and reasons."""
    df = with_defaults(df)
    rules = _rules(policy)
    texts = lambda reasons: F.array_compact(F.array(*(r if isinstance(r, Column) else F.lit(r) for r in reasons)))
    pick = lambda of: _chain([(r[2], of(r)) for r in rules[:-1]], of(rules[-1]))
    df = df.withColumns({"combined": F.col("e_score") + F.col("q_score") + F.col("c_score"), "rule": pick(lambda r: F.lit(r[0])), "tier": pick(lambda r: F.lit(r[1])), "reasons": pick(lambda r: texts(r[3]))})
    guarded = F.col("tier") == "confidential"
    return df.withColumns(
        {
            "transformation": _chain([(F.col("tier") == t, F.lit(a[0])) for t, a in ACTIONS.items()], F.lit(None).cast("string")),
            "routing": _chain([(F.col("tier") == t, F.lit(a[1])) for t, a in ACTIONS.items()], F.lit(None).cast("string")),
            "needs_reconstruction": guarded,
            "needs_attestation": guarded,
            "masked_text": F.when(guarded, F.coalesce(F.nullif("q_masked", F.lit("")), F.col("e_masked"))),
        }
    )


def evaluate(e_score: Column, q_score: Column, c_score: Column, has_direct: Column | None = None, has_combo: Column | None = None, factors: Column | None = None, masked: Column | None = None) -> dict[str, Column]:
    """Columns for `decide` from plain scores, with no rare quasi-identifier: use df.withColumns."""
    none = F.array().cast("array<string>")
    flag = lambda c: F.lit(False) if c is None else c
    text = F.lit("") if masked is None else masked
    return {"e_score": e_score, "q_score": q_score, "c_score": c_score, "has_direct": flag(has_direct), "has_combo": flag(has_combo), "rare_disease": F.lit(False), "rare_occupation": F.lit(False), "factors": none if factors is None else factors, "e_masked": text, "q_masked": text}


def projection(decided: DataFrame, *keep: str) -> DataFrame:
    """The decisions as they are written out: scores nested, reasons as an array."""
    scores = F.struct("e_score", "q_score", "c_score", F.col("combined").alias("combined"))
    return decided.select(*keep, "tier", "transformation", "routing", "reasons", scores.alias("scores"), F.col("needs_reconstruction").alias("requires_reconstruction"), F.col("needs_attestation").alias("requires_attestation"))


def _chain(pairs: list[tuple[Column, object]], last: Column) -> Column:
    out = F.when(pairs[0][0], pairs[0][1])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out.otherwise(last)


def tiers(decided: DataFrame) -> DataFrame:
    """Count and percentage of each tier, those without rows too."""
    spark = decided.sparkSession
    counts = decided.groupBy("tier").count()
    every = literal.table(spark, enumerate(TIERS), "ord int, tier string")
    n = F.coalesce("count", F.lit(0))
    total = decided.agg(F.count("*").alias("total"))
    return every.join(counts, "tier", "left").crossJoin(F.broadcast(total)).select("ord", "tier", n.cast("long").alias("n"), F.coalesce(F.try_divide(100.0 * n, "total"), F.lit(0.0)).alias("pct"))


def routings(decided: DataFrame) -> DataFrame:
    """Count and percentage of each routing that occurs."""
    total = decided.agg(F.count("*").alias("total"))
    return decided.groupBy("routing").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("routing", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def crosstab(decided: DataFrame, expected: str = "expected_critical") -> DataFrame:
    """Rows of each expectation by tier, zero-filled."""
    both = literal.table(decided.sparkSession, [(True,), (False,)], f"{expected} boolean")
    counts = decided.groupBy(expected).pivot("tier", list(TIERS)).count()
    return both.join(counts, expected, "left").na.fill(0)


def rates(decided: DataFrame, expected: str = "expected_critical") -> DataFrame:
    """Critical rows that are protected or leak, and other rows that stay unrestricted, as shares."""
    open_ = F.col("tier") == "unrestricted"
    critical, plain = F.count_if(F.col(expected)), F.count_if(~F.col(expected))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return decided.agg(
        share(F.count_if(F.col(expected) & ~open_), critical).alias("protected_rate"),
        share(F.count_if(F.col(expected) & open_), critical).alias("leak_rate"),
        share(F.count_if(~F.col(expected) & open_), plain).alias("efficiency"),
    )


def summary_text(decided: DataFrame, expected: str = "expected_critical") -> DataFrame:
    """One row with the decisions in words: rows of each tier and its routing with their shares,
    expected against decided, and the rates. All of it comes from one aggregate of six counts."""
    n = lambda critical, tier: F.count_if((F.col(expected) if critical else ~F.col(expected)) & (F.col("tier") == tier))
    name = lambda critical, tier: f"{tier}_{'critical' if critical else 'plain'}"
    counts = decided.agg(*(n(c, t).alias(name(c, t)) for c in (True, False) for t in TIERS))
    of = lambda t: F.col(name(True, t)) + F.col(name(False, t))
    row = lambda c: [F.col(name(c, t)) for t in TIERS]
    total = lambda c: sum(row(c)[1:], row(c)[0])
    everything = total(True) + total(False)
    percent = lambda a, b: F.round(100.0 * F.coalesce(F.try_divide(a, b), F.lit(0.0)), 1)
    safe = total(True) - F.col(name(True, "unrestricted"))
    line = lambda form, *values: F.format_string(form, *values)
    lines = [
        *(line("  %-15s %-6s %6d (%5.1f%%)", F.lit(t), F.lit(ACTIONS[t][1]), of(t), percent(of(t), everything)) for t in TIERS),
        line("  %-15s" + " %13s" * len(TIERS), F.lit("Expected"), *(F.lit(t) for t in TIERS)),
        line("  %-15s" + " %13d" * len(TIERS), F.lit("critical"), *row(True)), line("  %-15s" + " %13d" * len(TIERS), F.lit("not critical"), *row(False)),
        line("Critical rows protected: %d/%d (%.1f%%)", safe, total(True), percent(safe, total(True))),
        line("Critical rows leaked: %d/%d (%.1f%%)", F.col(name(True, "unrestricted")), total(True), percent(F.col(name(True, "unrestricted")), total(True))),
        line("Other rows unrestricted: %d/%d (%.1f%%)", F.col(name(False, "unrestricted")), total(False), percent(F.col(name(False, "unrestricted")), total(False))),
    ]
    return counts.select(F.concat_ws("\n", *lines).alias("summary"))
