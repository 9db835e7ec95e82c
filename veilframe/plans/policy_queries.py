"""Queries on policy, evaluation, the k sweep, resumed runs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import DIRECT_TYPES, K_GRID
from ..operators import evaluate, explicit, policy, sweep
from ..sources import results
from ..sources.shared import new_path
from ..streaming import resume
from .explicit_queries import DOC_RECOGNIZERS, SCORE_CTE, read

FEATURES = ("e_score", "e_count", "q_score", "c_score", "words")
FLAGS = ("has_direct", "has_combo", "long_text")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels: e_score from their entities; q_score and c_score are rendered from the
    id, as no model is at hand; a document is critical if it is toxic."""
    docs = explicit.summary(explicit.entities(read(spark, sf_dir, "documents"), recognizers=DOC_RECOGNIZERS))
    docs = docs.select(
        "doc_id", "e_score", F.col("e_count").cast("double").alias("e_count"), F.arrays_overlap("e_types", F.array(*map(F.lit, DIRECT_TYPES))).alias("has_direct"),
        F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") * 37 % 100) / 100).otherwise(0.0).alias("q_score"), ((F.col("doc_id") * 53 % 100) / 200).alias("c_score"),
        (F.col("doc_id") % 5 == 0).alias("has_combo"), (F.col("doc_id") % 13 == 0).alias("rare_disease"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("A"), F.lit("B"))).alias("factors"), (F.length("text") > 2000).alias("long_text"), F.length("text").cast("double").alias("words"),
    )
    labels = read(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("expected_critical"))
    return docs.join(labels, "doc_id")


SCORED = SCORE_CTE + """, sc AS (SELECT doc_id, least(coalesce(e_score, 0), 1.0) AS e_score, CAST(coalesce(e_count, 0) AS DOUBLE) AS e_count, coalesce(len(list_intersect(kinds, ['CREDIT_CARD', 'EMAIL_ADDRESS', 'PHONE_NUMBER'])) > 0, false) AS has_direct,
CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id * 37 % 100 AS DOUBLE) / 100 ELSE 0 END AS q_score, CAST(doc_id * 53 % 100 AS DOUBLE) / 200 AS c_score, doc_id % 5 = 0 AS has_combo, doc_id % 13 = 0 AS rare, doc_id % 2 = 0 AS told, length(text) > 2000 AS long_text, CAST(length(text) AS DOUBLE) AS words, toxic = 1 AS y
FROM documents JOIN labels USING (doc_id) LEFT JOIN es USING (doc_id)),
pol AS (SELECT *, e_score + q_score + c_score AS combined FROM sc),
dec AS (SELECT *, CASE WHEN has_direct THEN 'R1' WHEN combined >= 1.2 THEN 'R2' WHEN c_score >= 0.3 THEN 'R3' WHEN e_score >= 0.5 THEN 'R4a' WHEN rare THEN 'R4b' WHEN q_score >= 0.5 THEN 'R4c' WHEN has_combo AND combined >= 0.6 THEN 'R5' WHEN c_score >= 0.12 THEN 'R6' WHEN e_score >= 0.3 AND q_score > 0 THEN 'R7' ELSE 'default' END AS rule FROM pol),
tier AS (SELECT *, CASE WHEN rule IN ('R1', 'R2', 'R3') THEN 'restricted' WHEN rule = 'default' THEN 'unrestricted' ELSE 'confidential' END AS tier FROM dec)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.decide(scored(spark, sf_dir))


def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decided(spark, sf_dir)
    return d.select("doc_id", F.round("combined", 6).alias("combined"), "rule", "tier", "transformation", "routing", "needs_attestation")


def policy_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.projection(_decided(spark, sf_dir), "doc_id").select("doc_id", F.array_join("reasons", "; ").alias("reasons"), F.round("scores.combined", 6).alias("combined"), "requires_reconstruction")


def policy_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.tiers(_decided(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


def policy_routings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.routings(_decided(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


def policy_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the three scores alone, with the rules on direct identifiers and combinations off."""
    s = scored(spark, sf_dir)
    given = s.select("doc_id", *(c.alias(n) for n, c in policy.evaluate(F.col("e_score"), F.col("q_score"), F.col("c_score"), has_direct=F.col("has_direct")).items()))
    return policy.decide(given, policy.Policy(direct_restricts=False, combo_confidential=False)).select("doc_id", "tier")


def policy_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.crosstab(_decided(spark, sf_dir))


def policy_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.rates(_decided(spark, sf_dir)).select(*(F.round(c, 6).alias(c) for c in ("protected_rate", "leak_rate", "efficiency")))


def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions in words."""
    return policy.summary_text(_decided(spark, sf_dir))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_counts(scored(spark, sf_dir), "expected_critical")


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.correlations(scored(spark, sf_dir), FEATURES, "expected_critical"), "corr")


def importance_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.importance(correlations(spark, sf_dir)).select("feature", F.round("importance", 6).alias("importance"), "strength")


def best_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_predictors(correlations(spark, sf_dir), 0.02).select("feature", "corr")


def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.corr_matrix(scored(spark, sf_dir), FEATURES), "corr")


def find_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.threshold_search(scored(spark, sf_dir), "c_score", "expected_critical"), "t")


def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.threshold_metrics(scored(spark, sf_dir), "c_score", "expected_critical"), "t", "recall", "precision", "fpr", "f1", "utility")


def f1_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_f1(threshold_metrics(spark, sf_dir)).select("i", "f1")


def nearest_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.nearest(threshold_metrics(spark, sf_dir), 0.12).select("i", "recall", "precision")


def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.pr_curve(scored(spark, sf_dir), "c_score", "expected_critical"), "threshold", "precision", "recall")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("deemed", F.col("c_score") >= 0.3)
    return _rounded(evaluate.confusion(s, "expected_critical", "deemed"), "share")


def bool_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.rates_by_class(scored(spark, sf_dir), FLAGS, "expected_critical"), "rate_sensitive", "rate_not")


def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.box_stats(scored(spark, sf_dir), ("c_score", "words"), "expected_critical"), "q1", "median", "q3", "low", "high")


def histogram20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.histogram(scored(spark, sf_dir), "words", "expected_critical"), "density")


def scatter_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.scatter(scored(spark, sf_dir), "doc_id", ("e_score", "q_score"), "c_score", "expected_critical"), "value", "score")


def combined_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.features import weighted

    return scored(spark, sf_dir).select("doc_id", F.round(weighted(F.col("e_score"), F.col("q_score"), F.col("c_score")), 6).alias("weighted"))


def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.features import score_features

    s = score_features(scored(spark, sf_dir))
    return s.select("doc_id", *(F.round(c, 6).alias(c) for c in ("e_q_score_sum", "e_q_score_product", "e_q_score_max", "score_disparity")))


def cumulative_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "ts", "value")
    out = evaluate.running_count(events, F.col("value") > 50, ["ts", "event_id"])
    return out.select("event_id", "n", "n_flagged")


# ---- k sweep over rendered quasi-identifiers

_TEXT = "concat('Age ', CAST(18 + c_custkey % 60 AS STRING), ' in ward ', CAST(100 + c_custkey % 9 AS STRING), ' now')"


def _qis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' short texts with two QIs each: one shared by few people, one by an unknown number."""
    qi = lambda kind, a, b, n: F.struct(F.lit(kind).alias("qi_type"), F.lit(a).alias("start_pos"), F.lit(b).alias("end_pos"), n.cast("long").alias("population_count"))
    people = F.col("c_custkey") * 7 % 1500
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_TEXT} AS text")
    return rows.withColumn("qis", F.array(qi("age", 4, 6, people), qi("ward", 15, 18, F.when(F.col("c_custkey") % 2 == 0, people * 2)), qi("ward", 2, 6, people)))


def k_sweep_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.sweep(_qis(spark, sf_dir)).select("c_custkey", "k", "k_text", F.col("k_masked").cast("long").alias("k_masked"))


def _swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered score falls with each masked QI and with k."""
    s = sweep.sweep(_qis(spark, sf_dir))
    base = 0.2 + (F.col("c_custkey") % 7) / 20
    return s.withColumns({"c_original": base, "c_score": base * (1 - 0.2 * F.col("k_masked") * F.log10(F.col("k").cast("double")) / 3)})


def k_sweep_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sweep.by_k(_swept(spark, sf_dir)), "c_mean", "c_std", "masked_mean", "masked_std", "reduction", "baseline")


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.by_k(_swept(spark, sf_dir))


def optimal_k_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sweep.knee(_table(spark, sf_dir)), "curvature")


def optimal_k_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.optimal(_table(spark, sf_dir))


def optimal_k_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sweep.pareto(_table(spark, sf_dir)).select("k", "gain", "masked_mean"), "gain", "masked_mean")


def k_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sweep.as_maps(_swept(spark, sf_dir), "c_custkey")
    return m.select("c_custkey", F.size("c_scores_by_k").cast("long").alias("n_k"), F.try_element_at("masked_counts_by_k", F.lit("1000")).cast("long").alias("masked_1000"))


_N = "(c_custkey * 7 % 1500)"
_M = f"CASE WHEN {_N} < k THEN 1 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 AND {_N} * 2 < k THEN 1 ELSE 0 END"
_SWEEP = f"sw AS (SELECT c_custkey, k, {_TEXT} AS text, {_N} < k AS a, c_custkey % 2 = 0 AND {_N} * 2 < k AS w, {_M} AS m, 0.2 + CAST(c_custkey % 7 AS DOUBLE) / 20 AS base FROM customer, (SELECT unnest([{', '.join(map(str, K_GRID))}]) AS k))"
_BYK = f"""{_SWEEP}, s2 AS (SELECT *, base * (1 - 0.2 * m * log10(k) / 3) AS c FROM sw),
bk AS (SELECT k, avg(c) AS c_mean, stddev_pop(c) AS c_std, avg(m) AS masked_mean, stddev_pop(m) AS masked_std, avg(base - c) AS reduction, avg(base) AS baseline FROM s2 GROUP BY k),
g AS (SELECT *, baseline - c_mean AS gain FROM bk), gn AS (SELECT *, gain / (max(gain) OVER () + 1e-9) AS y0, row_number() OVER (ORDER BY k) AS i, count(*) OVER () AS n, (log10(k) - min(log10(k)) OVER ()) / (max(log10(k)) OVER () - min(log10(k)) OVER ()) AS x FROM g)"""
_KNEE = f"""{_BYK}, w AS (SELECT d, exp(-d * d / 0.5) / (SELECT sum(exp(-d * d / 0.5)) FROM range(-2, 3) t(d)) AS w FROM range(-2, 3) t(d)),
sm AS (SELECT a.i, a.k, a.x, a.n, sum(w.w * b.y0) AS y FROM gn a, w JOIN gn b ON b.i = CASE WHEN a.i + w.d < 1 THEN 1 - (a.i + w.d) WHEN a.i + w.d > a.n THEN 2 * a.n + 1 - (a.i + w.d) ELSE a.i + w.d END GROUP BY a.i, a.k, a.x, a.n),
d1 AS (SELECT *, CASE WHEN i = 1 THEN (lead(y) OVER o - y) / (lead(x) OVER o - x) WHEN i = n THEN (y - lag(y) OVER o) / (x - lag(x) OVER o) ELSE ((x - lag(x) OVER o) ** 2 * lead(y) OVER o + ((lead(x) OVER o - x) ** 2 - (x - lag(x) OVER o) ** 2) * y - (lead(x) OVER o - x) ** 2 * lag(y) OVER o) / ((x - lag(x) OVER o) * (lead(x) OVER o - x) * (lead(x) OVER o - lag(x) OVER o)) END AS d FROM sm WINDOW o AS (ORDER BY i)),
d2 AS (SELECT *, CASE WHEN i = 1 THEN (lead(d) OVER o - d) / (lead(x) OVER o - x) WHEN i = n THEN (d - lag(d) OVER o) / (x - lag(x) OVER o) ELSE ((x - lag(x) OVER o) ** 2 * lead(d) OVER o + ((lead(x) OVER o - x) ** 2 - (x - lag(x) OVER o) ** 2) * d - (lead(x) OVER o - x) ** 2 * lag(d) OVER o) / ((x - lag(x) OVER o) * (lead(x) OVER o - x) * (lead(x) OVER o - lag(x) OVER o)) END AS dd FROM d1 WINDOW o AS (ORDER BY i)),
kn AS (SELECT k, CASE WHEN i > 1 AND i < n THEN abs(dd) / (1 + d * d) ** 1.5 END AS curvature FROM d2)"""
_PARETO = "par AS (SELECT * FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.gain >= a.gain AND b.masked_mean <= a.masked_mean AND (b.gain > a.gain OR b.masked_mean < a.masked_mean)))"


# ---- runs that resume

NOW = "2024-01-20 00:00:00"


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.md5("text").alias("sample_hash"), "doc_id")
    return results.todo(docs, docs.where("doc_id % 4 = 0")).select("doc_id")


def resume_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.md5("text").alias("sample_hash"), "doc_id")
    return results.reused(docs.where("doc_id % 4 = 0"), docs).select("doc_id")


def resume_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("sample_hash"), F.col("event_id").alias("processed_at"), "value")
    return results.upsert(events.where("event_id % 3 = 0"), events.where("event_id % 3 <> 0"))


def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("cache_key"), "ts", F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("payload"))
    now = events.agg(F.max("ts").alias("now"))
    live = results.alive(events.crossJoin(F.broadcast(now)), F.col("now"), 86_400)
    return live.groupBy("cache_key").agg(F.count("*").alias("n"), F.count("payload").alias("n_known"))


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows with some columns missing or null become the policy's input."""
    docs = explicit.summary(explicit.entities(read(spark, sf_dir, "documents"), recognizers=DOC_RECOGNIZERS))
    rows = docs.select(F.md5("text").alias("sample_hash"), "e_score", F.col("e_types").alias("e_score_entity_types"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") / 1000).alias("c_score_risk_score"), (F.col("doc_id") % 10 == 0).alias("has_direct_identifier"))
    return results.classification(rows).groupBy("has_direct", "has_combo").agg(F.count("*").alias("n"), F.round(F.sum("e_score"), 6).alias("e_score"), F.round(F.sum("c_score"), 6).alias("c_score"))


def _streamed(spark: SparkSession, sf_dir: str, work, key: str | None) -> DataFrame:
    """Runs the events through a stream to a table in the shared folder, twice: the second run finds
    nothing new."""
    base = new_path(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    for _ in range(2):  # a stream reads a folder, or a pattern that may match one file
        resume.run_available(resume.read_files(spark, f"{sf_dir}/event[s].parquet", schema), work, f"{base}/out", f"{base}/state", key)
    return spark.read.parquet(f"{base}/out")


def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda df: df.where("value > 50").select("event_id", "user_id"), None)


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda df: df.select("user_id"), "user_id")


def stream_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts by day, kept by a stream in complete mode over two runs and read from its table."""
    base = new_path(spark, "windows")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for _ in range(2):
        source = resume.read_files(spark, f"{sf_dir}/event[s].parquet", events.schema)
        resume.run_complete(resume.windowed(source, "ts", F.col("value") > 50), f"{base}/out", f"{base}/state")
    return resume.latest(spark, f"{base}/out")


NAN = "'NaN'::DOUBLE"


def corr_sql(a: str, b: str, none: str = "0") -> str:
    return f"coalesce(CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 1e-15 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END, {none})"


_Y = "CAST(y AS DOUBLE)"
_CORR = "co AS (" + " UNION ALL ".join(f"SELECT {k} AS ord, '{f}' AS feature, round({corr_sql(f, _Y)}, 6) AS corr FROM sc" for k, f in enumerate(FEATURES)) + ")"
_CELLS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({corr_sql(a, b, NAN)}, 6) AS corr FROM sc" for a in FEATURES for b in FEATURES)
_TS = "tm AS (SELECT i, CAST(i AS DOUBLE) / 49 AS t, count(*) FILTER (y AND c_score >= CAST(i AS DOUBLE) / 49) AS tp, count(*) FILTER (NOT y AND c_score >= CAST(i AS DOUBLE) / 49) AS fp, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM sc, range(50) r(i) GROUP BY i), mt AS (SELECT i, t, CASE WHEN p > 0 THEN tp / CAST(p AS DOUBLE) ELSE 0 END AS recall, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 1 END AS precision, CASE WHEN n > 0 THEN fp / CAST(n AS DOUBLE) ELSE 0 END AS fpr FROM tm), mf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM mt)"
_COUNTS = ", ".join(f"count(*) FILTER ({'y' if c else 'NOT y'} AND tier = '{t}') AS {'c' if c else 'p'}{t[0]}" for c in (True, False) for t in policy.TIERS)
_PERCENT = "round(coalesce(100.0::DOUBLE * ({a}) / nullif({b}, 0), 0), 1)"
_SHARES = ", ".join(f"printf('  %-15s %-6s %6d (%5.1f%%)', '{t}', '{policy.ACTIONS[t][1]}', c{t[0]} + p{t[0]}, {_PERCENT.format(a=f'c{t[0]} + p{t[0]}', b='nc + np')})" for t in policy.TIERS)
_RATES = ", ".join(f"printf('{head}: %d/%d (%.1f%%)', {a}, {b}, {_PERCENT.format(a=a, b=b)})" for head, a, b in (("Critical rows protected", "cr + cc", "nc"), ("Critical rows leaked", "cu", "nc"), ("Other rows unrestricted", "pu", "np")))
_SUMMARY = f"""ct AS (SELECT {_COUNTS}, count(*) FILTER (y) AS nc, count(*) FILTER (NOT y) AS np FROM tier)
SELECT concat_ws(chr(10), {_SHARES}, printf('  %-15s %13s %13s %13s', 'Expected', 'restricted', 'confidential', 'unrestricted'), printf('  %-15s %13d %13d %13d', 'critical', cr, cc, cu), printf('  %-15s %13d %13d %13d', 'not critical', pr, pc, pu), {_RATES}) AS summary FROM ct"""

REGISTRY = {
    "policy_decisions": (policy_decisions, f"WITH {SCORED} SELECT doc_id, round(combined, 6) AS combined, rule, tier, CASE tier WHEN 'restricted' THEN 'block' WHEN 'confidential' THEN 'reversible' ELSE 'none' END AS transformation, CASE tier WHEN 'restricted' THEN 'local' WHEN 'confidential' THEN 'tee' ELSE 'cloud' END AS routing, tier = 'confidential' AS needs_attestation FROM tier"),
    "policy_reasons": (
        policy_reasons,
        f"""WITH {SCORED} SELECT doc_id, CASE rule WHEN 'R1' THEN 'Direct identifier detected (SSN, passport, etc.)' WHEN 'R2' THEN printf('Combined score %.2f >= 1.2', combined)
WHEN 'R3' THEN printf('High contextual sensitivity: C-Score %.2f', c_score) || CASE WHEN told THEN '; Factors: A, B' ELSE '' END WHEN 'R4a' THEN printf('High explicit PII: E-Score %.2f', e_score) WHEN 'R4b' THEN 'Rare quasi-identifier detected (disease or occupation)'
WHEN 'R4c' THEN printf('High re-identification risk: Q-Score %.2f', q_score) WHEN 'R5' THEN 'High-risk entity combination (PERSON+LOCATION+DATETIME); ' || printf('Combined score %.2f with risk factors', combined) WHEN 'R6' THEN printf('Moderate contextual sensitivity: C-Score %.2f', c_score)
WHEN 'R7' THEN 'Moderate PII with quasi-identifiers present' ELSE 'No significant sensitivity indicators detected; ' || printf('Scores: E=%.2f, Q=%.2f, C=%.2f', e_score, q_score, c_score) END AS reasons, round(combined, 6) AS combined, tier = 'confidential' AS requires_reconstruction FROM tier""",
    ),
    "policy_routings": (policy_routings, f"WITH {SCORED} SELECT CASE tier WHEN 'restricted' THEN 'local' WHEN 'confidential' THEN 'tee' ELSE 'cloud' END AS routing, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM tier), 6) AS pct FROM tier GROUP BY 1"),
    "policy_plain": (policy_plain, f"WITH {SCORED}, r AS (SELECT doc_id, e_score AS e, q_score AS q, c_score AS c, has_direct AND doc_id % 2 = 0 AS d FROM sc) SELECT doc_id, CASE WHEN e + q + c >= 1.2 OR c >= 0.3 THEN 'restricted' WHEN e >= 0.5 OR q >= 0.5 OR c >= 0.12 OR (e >= 0.3 AND q > 0) THEN 'confidential' ELSE 'unrestricted' END AS tier FROM r"),
    "policy_tiers": (policy_tiers, f"WITH {SCORED}, o AS (SELECT * FROM (VALUES (0, 'restricted'), (1, 'confidential'), (2, 'unrestricted')) t(ord, tier)) SELECT ord, o.tier, count(x.doc_id) AS n, round(100.0 * count(x.doc_id) / (SELECT count(*) FROM tier), 6) AS pct FROM o LEFT JOIN tier x ON x.tier = o.tier GROUP BY ord, o.tier"),
    "policy_crosstab": (policy_crosstab, f"WITH {SCORED} SELECT y AS expected_critical, count(*) FILTER (tier = 'restricted') AS restricted, count(*) FILTER (tier = 'confidential') AS confidential, count(*) FILTER (tier = 'unrestricted') AS unrestricted FROM tier GROUP BY y"),
    "policy_rates": (policy_rates, f"WITH {SCORED} SELECT round(count(*) FILTER (y AND tier <> 'unrestricted') / CAST(count(*) FILTER (y) AS DOUBLE), 6) AS protected_rate, round(count(*) FILTER (y AND tier = 'unrestricted') / CAST(count(*) FILTER (y) AS DOUBLE), 6) AS leak_rate, round(count(*) FILTER (NOT y AND tier = 'unrestricted') / CAST(count(*) FILTER (NOT y) AS DOUBLE), 6) AS efficiency FROM tier"),
    "policy_summary": (policy_summary, f"WITH {SCORED}, {_SUMMARY}"),
    "class_counts": (class_counts, f"WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (y) AS n_sensitive, count(*) FILTER (NOT y) AS n_not_sensitive FROM sc"),
    "correlations": (correlations, f"WITH {SCORED}, {_CORR} SELECT * FROM co"),
    "importance_top15": (importance_top15, f"WITH {SCORED}, {_CORR} SELECT feature, abs(corr) AS importance, CASE WHEN abs(corr) > 0.5 THEN 'STRONG' WHEN abs(corr) > 0.3 THEN 'MODERATE' ELSE 'WEAK' END AS strength FROM co ORDER BY abs(corr) DESC, ord LIMIT 15"),
    "best_predictors": (best_predictors, f"WITH {SCORED}, {_CORR} SELECT feature, corr FROM co WHERE abs(corr) > 0.02"),
    "corr_matrix": (corr_matrix, f"WITH {SCORED} {_CELLS}"),
    "find_threshold": (find_threshold, f"WITH {SCORED}, e AS (SELECT min(c_score) AS lo, max(c_score) AS hi FROM sc), t AS (SELECT i, lo + (hi - lo) * i / 19 AS t FROM e, range(20) r(i)), m AS (SELECT i, t, sum(CASE WHEN c_score < t THEN CASE WHEN y THEN -2 ELSE 1 END ELSE 0 END) AS separation FROM sc, t GROUP BY i, t) SELECT round(t, 6) AS t, CAST(separation AS BIGINT) AS separation FROM m ORDER BY separation DESC, i LIMIT 1"),
    "threshold_metrics": (threshold_metrics, f"WITH {SCORED}, {_TS} SELECT i, round(t, 6) AS t, round(recall, 6) AS recall, round(precision, 6) AS precision, round(fpr, 6) AS fpr, round(f1, 6) AS f1, round(1 - fpr, 6) AS utility FROM mf"),
    "f1_best": (f1_best, f"WITH {SCORED}, {_TS} SELECT i, round(f1, 6) AS f1 FROM mf ORDER BY round(f1, 6) DESC, i LIMIT 1"),
    "nearest_threshold": (nearest_threshold, f"WITH {SCORED}, {_TS} SELECT i, round(recall, 6) AS recall, round(precision, 6) AS precision FROM mf ORDER BY abs(round(t, 6) - 0.12), t LIMIT 1"),
    "pr_curve": (pr_curve, f"WITH {SCORED}, s AS (SELECT c_score AS s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM sc GROUP BY 1), r AS (SELECT s, sum(p) OVER o AS tp, sum(n) OVER o AS fp, sum(p) OVER () AS ap FROM s WINDOW o AS (ORDER BY s DESC)) SELECT round(s, 6) AS threshold, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(ap AS DOUBLE), 6) AS recall FROM r UNION ALL SELECT NULL, 1, 0"),
    "confusion": (confusion, f"WITH {SCORED}, c AS (SELECT y, c_score >= 0.3 AS pred, count(*) AS n FROM sc GROUP BY 1, 2), g AS (SELECT a.y, b.pred FROM (VALUES (true), (false)) a(y), (VALUES (true), (false)) b(pred)), f AS (SELECT g.y, g.pred, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.y = g.y AND c.pred = g.pred) SELECT y, pred, n, round(n / CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE), 6) AS share FROM f"),
    "bool_rates": (bool_rates, f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(coalesce(avg(CAST({f} AS INT)) FILTER (y), 0), 6) AS rate_sensitive, round(coalesce(avg(CAST({f} AS INT)) FILTER (NOT y), 0), 6) AS rate_not FROM sc" for f in FLAGS)),
    "box_stats": (box_stats, f"WITH {SCORED}, l AS (SELECT y, 'c_score' AS feature, c_score AS v FROM sc UNION ALL SELECT y, 'words', words FROM sc), q AS (SELECT y, feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY 1, 2) SELECT y, feature, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 6) AS low, round(max(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 6) AS high FROM l JOIN q USING (y, feature) GROUP BY y, feature, q1, median, q3"),
    "histogram20": (histogram20, f"WITH {SCORED}, e AS (SELECT y, min(words) AS lo, max(words) AS hi, count(*) AS total FROM sc GROUP BY y) SELECT y, CAST(least(floor((words - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n, round(count(*) / (total * (hi - lo) / 20), 6) AS density FROM sc JOIN e USING (y) GROUP BY 1, 2, lo, hi, total"),
    "scatter_long": (scatter_long, f"WITH {SCORED} SELECT doc_id, round(c_score, 6) AS score, y, 'e_score' AS feature, round(e_score, 6) AS value FROM sc UNION ALL SELECT doc_id, round(c_score, 6), y, 'q_score', round(q_score, 6) FROM sc"),
    "combined_score": (combined_score, f"WITH {SCORED} SELECT doc_id, round(0.3 * e_score + 0.3 * q_score + 0.4 * c_score, 6) AS weighted FROM sc"),
    "score_pairs": (score_pairs, f"WITH {SCORED} SELECT doc_id, round(e_score + q_score, 6) AS e_q_score_sum, round(e_score * q_score, 6) AS e_q_score_product, round(greatest(e_score, q_score), 6) AS e_q_score_max, round(abs(e_score - q_score), 6) AS score_disparity FROM sc"),
    "cumulative_sensitive": (cumulative_sensitive, "SELECT event_id, count(*) OVER o AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER o AS BIGINT) AS n_flagged FROM events WINDOW o AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"),
    "k_sweep_mask": (k_sweep_mask, f"WITH {_SWEEP} SELECT c_custkey, CAST(k AS INT) AS k, CASE WHEN a AND w THEN 'Age [REDACTED] in ward [REDACTED] now' WHEN a THEN 'Age [REDACTED]' || substr(text, 7) WHEN w THEN substr(text, 1, 15) || '[REDACTED] now' ELSE text END AS k_text, CAST(m AS BIGINT) AS k_masked FROM sw"),
    "k_sweep_agg": (k_sweep_agg, f"WITH {_BYK} SELECT CAST(k AS INT) AS k, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("c_mean", "c_std", "masked_mean", "masked_std", "reduction", "baseline")) + " FROM bk"),
    "optimal_k_knee": (optimal_k_knee, f"WITH {_KNEE} SELECT CAST(k AS INT) AS k, round(curvature, 6) AS curvature FROM kn"),
    "optimal_k_summary": (optimal_k_summary, f"WITH {_KNEE}, {_PARETO} SELECT 'knee' AS method, CAST(k AS BIGINT) AS k, true AS recommended FROM (SELECT k FROM kn WHERE curvature IS NOT NULL ORDER BY curvature DESC, k LIMIT 1) UNION ALL SELECT 'efficiency', k, false FROM (SELECT k FROM g ORDER BY gain / (masked_mean + 1) DESC, k LIMIT 1) UNION ALL SELECT 'target', min(k), false FROM g WHERE gain >= 0.5 * (SELECT max(gain) FROM g) UNION ALL SELECT 'pareto', (list_sort(list(k)))[CAST(floor(count(*) / 2) AS BIGINT) + 1], false FROM par"),
    "optimal_k_pareto": (optimal_k_pareto, f"WITH {_BYK}, {_PARETO} SELECT CAST(k AS INT) AS k, round(gain, 6) AS gain, round(masked_mean, 6) AS masked_mean FROM par"),
    "k_maps": (k_maps, f"WITH {_SWEEP} SELECT c_custkey, count(*) AS n_k, CAST(max(m) FILTER (k = 1000) AS BIGINT) AS masked_1000 FROM sw GROUP BY c_custkey"),
    "resume_anti": (resume_anti, "SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 4 = 0)"),
    "resume_reuse": (resume_reuse, "SELECT doc_id FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 4 = 0)"),
    "resume_upsert": (resume_upsert, "SELECT user_id AS sample_hash, event_id AS processed_at, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END DESC, event_id DESC) AS r FROM events) WHERE r = 1"),
    "ttl_cache": (ttl_cache, "SELECT user_id AS cache_key, count(*) AS n, count(CASE WHEN event_id % 5 > 0 THEN event_type END) AS n_known FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1"),
    "classification": (classification, f"WITH {SCORE_CTE} SELECT coalesce(len(list_intersect(kinds, ['CREDIT_CARD', 'EMAIL_ADDRESS', 'PHONE_NUMBER'])) > 0, false) OR doc_id % 10 = 0 AS has_direct, false AS has_combo, count(*) AS n, round(sum(coalesce(e_score, 0)), 6) AS e_score, round(sum(CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id AS DOUBLE) / 1000 ELSE 0 END), 6) AS c_score FROM documents LEFT JOIN es USING (doc_id) GROUP BY 1, 2"),
    "stream_resume": (stream_resume, "SELECT event_id, user_id FROM events WHERE value > 50"),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT user_id FROM events"),
    "stream_windowed": (stream_windowed, "SELECT date_trunc('day', ts) AS window_start, count(*) AS n, count(*) FILTER (value > 50) AS n_flagged FROM events GROUP BY 1"),
}
