"""Queries on quasi-identifiers, populations, expected k and contextual factors."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import anonymity, contextual, population, quasi
from ..sources import literal, replies
from . import rendered as R

DISEASES = ["asthma", "diabetes", "marfan syndrome", "influenza"]
PEOPLES, PLACES = ["irish", "french"], ["paris", "london"]
TODAY = "2026-01-01"

# Snapshots for the queries: (lo, hi, people) a band and sex, people by state, and so on, all made up.
BANDS = [(lo, hi, 1_000_000 + 10_000 * k + 1000 * sex) for k, (lo, hi) in enumerate(K.AGE_BANDS) for sex in (0, 1)]
TOTAL = sum(b[2] for b in BANDS)
STATE_PEOPLE = [(fips, 500_000 + 7_000 * k) for k, (_, _, fips) in enumerate(K.STATE_ROWS)]
ZIP_PEOPLE = [(str(10_000 + k), 900 + 13 * k) for k in range(0, 40, 2)]
TOPICS = [("Asthma among adults", "Crude Prevalence", "US", 2019, 8.9), ("Asthma among adults", "crude prevalence", "US", 2021, None), ("asthma mortality", "crude rate", "US", 2022, 1.0), ("Diabetes prevalence", "Adjusted Crude Prevalence (%)", "US", 2020, 10.4), ("Diabetes prevalence", "crude prevalence", "TX", 2022, 12.0)]
CODES = [("marfan syndrome", 558), ("asthma", 559), ("influenza", 560)]
EPIDEMIOLOGY = [(558, [("Cases", "Unknown"), ("Point prevalence", "1-9 / 100 000"), ("Point prevalence", "1-5 / 10 000")]), (559, [("Incidence", "1-9 / 1 000 000")]), (560, [("Incidence", "not given")])]
SOC = [("nurse", "29-1141"), ("teacher", "25-2031"), ("police officer", "33-3051"), ("pilot", "53-2011")]
EMPLOYMENT = [("29-1141", 2_900_000), ("25-2031", 1_010_000), ("53-2011", 91_000)]
GENDER_PEOPLE = [("male", 164_000_000), ("female", 168_000_000)]


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return literal.table(spark, rows, schema)


def _epidemiology(spark: SparkSession) -> DataFrame:
    flat = _frame(spark, [(code, *item) for code, items in EPIDEMIOLOGY for item in [(k, *i) for k, i in enumerate(items)]], "code int, k int, type string, class string")
    items = F.array_sort(F.collect_list(F.struct("k", "type", "class")))
    return flat.groupBy("code").agg(F.transform(items, lambda i: F.struct(i["type"].alias("type"), i["class"].alias("class"))).alias("items"))


def ages_table(spark: SparkSession) -> DataFrame:
    return population.ages(_frame(spark, BANDS, "lo int, hi int, people long"), TOTAL)


def _pages() -> list[tuple[str, str, str]]:
    """Raw pages of all services, in the shapes that they come in, with some that are of no use."""
    told = json.dumps
    indicator = [{"topic": t, "datavaluetype": k, "locationabbr": p, "yearend": str(y), "datavalue": "" if f is None else str(f)} for t, k, p, y, f in TOPICS]
    shapes = [
        lambda code: {"data": {"results": [{"ORPHAcode": code}]}},
        lambda code: {"data": {"results": {"orphacode": str(code)}}},
        lambda code: [{"ORPHAcode": "", "DisorderDisorderAssociation": [{"TargetDisorder": {"ORPHAcode": code}}]}],
    ]
    figures = [
        lambda items: {"data": {"results": {"Prevalence": [{"PrevalenceType": a, "PrevalenceClass": b} for a, b in items]}}},
        lambda items: {"results": [{"prevalences": [{"prevalenceType": a, "prevalenceClass": b} for a, b in items]}]},
        lambda items: {"Prevalences": dict(zip(("PrevalenceType", "PrevalenceClass"), items[0], strict=True))},
    ]
    series = [{"seriesID": f"OEUN0000000000000{soc.replace('-', '')}01", "data": [{"value": f"{n:,}"}, {"value": "1"}]} for soc, n in EMPLOYMENT]
    return (
        [("survey", "a", told(indicator[:2])), ("survey", "b", told(indicator[2:])), ("survey", "c", "<html>busy</html>"), ("survey", "d", "{}")]
        + [("rare-names", name, told(shapes[k % 3](code))) for k, (name, code) in enumerate(CODES)] + [("rare-names", "diabetes", told({"data": {"results": []}})), ("rare-names", "x", "[")]
        + [("rare-figures", str(code), told(figures[k % 3](items))) for k, (code, items) in enumerate(EPIDEMIOLOGY)] + [("rare-figures", "1", "[1]")]
        + [("occupations", name.upper() + " ", told({"Occupation": [{"Code": soc}, {"Code": "99-9999"}]})) for name, soc in SOC] + [("occupations", "clerk", told({"Occupation": []}))]
        + [("employment", "all", told({"status": "REQUEST_SUCCEEDED", "Results": {"series": series}})), ("employment", "late", told({"status": "REQUEST_FAILED", "Results": {"series": series}}))]
    )


def _from_pages(spark: SparkSession) -> DataFrame:
    """Diseases and occupations from raw pages."""
    pages = _frame(spark, _pages(), "source string, key string, page string")
    survey = population.surveyed(_frame(spark, [(d,) for d in DISEASES], "value string"), replies.survey(pages))
    sick = population.diseases(survey, population.rare(replies.rare_codes(pages), replies.epidemiology(pages)))
    return sick.unionByName(population.occupations(replies.occupation_codes(pages), replies.employment(pages)))


def freq_disease_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As freq_disease_fallback, from raw pages."""
    return _frequency(_disease(spark, sf_dir), _from_pages(spark), "disease")


def freq_occ_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As freq_occ_two_hop, from raw pages."""
    jobs = F.array(*(F.lit(j) for j in ("nurse", "Teacher", "pilot", "police officer", "clerk")))
    return _frequency(_people(spark, sf_dir, F.get(jobs, (F.col("c_custkey") % 5).cast("int"))), _from_pages(spark), "occupation")


def full_population(spark: SparkSession) -> DataFrame:
    survey = population.surveyed(_frame(spark, [(d,) for d in DISEASES], "value string"), _frame(spark, TOPICS, "topic string, kind string, place string, year int, figure double"))
    rare = population.rare(_frame(spark, CODES, "value string, code int"), _epidemiology(spark))
    parts = [
        population.locations(_frame(spark, STATE_PEOPLE, "fips string, people long"), spark, TOTAL),
        population.simple(_frame(spark, ZIP_PEOPLE, "value string, people long"), "zip_code", TOTAL, "ZIP areas"),
        population.simple(_frame(spark, GENDER_PEOPLE, "value string, people long"), "gender", 332_000_000, "sexes"),
        population.diseases(survey, rare),
        population.occupations(_frame(spark, SOC, "value string, soc string"), _frame(spark, EMPLOYMENT, "soc string, people long")),
    ]
    out = ages_table(spark)
    for p in parts:
        out = out.unionByName(p)
    return out


# ---- pattern extractors

_FIELDS = ("qi_type", "raw_value", "normalized_value", "confidence", "start_pos", "end_pos", "method")


def _rows_of(df: DataFrame, qis: Column) -> DataFrame:
    # outer: a plain explode would have the optimizer repeat the extraction in a filter on its size
    return df.select("id", F.explode_outer(qis).alias("q")).where("q is not null").select("id", *(f"q.{c}" for c in _FIELDS))


def _pattern(name: str, kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows_of(R.narrative(spark, sf_dir), quasi.dedup(getattr(quasi, name)(F.col("text")), "ner"))

    query.__name__ = f"qi_{kind}"
    return query


def _found(order: int, pattern: str, kind: str, confidence: float, method: str = "pattern", norm: str = "v", raw: str = "w", group: bool = False, where: str = "TRUE") -> str:
    """Rows of a pattern with their places: what stands between matches tells where they are."""
    p = pattern.replace("'", "''")
    size = "lambda x: length(x)"
    before = f"CAST(list_sum(list_transform(s[1:i], {size})) + coalesce(list_sum(list_transform(m[1:i-1], {size})), 0) AS INT)"
    start = "a0 + strpos(w, v) - 1" if group else "a0"
    return f"""SELECT id, {order} AS ord, '{kind}' AS qi_type, {raw} AS raw_value, {norm} AS normalized_value, CAST({confidence} AS DOUBLE) AS confidence, CAST({start} AS INT) AS start_pos, CAST({start} + length({'v' if group else 'w'}) AS INT) AS end_pos, '{method}' AS method
FROM (SELECT id, m[i] AS w, g[i] AS v, {before} AS a0 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT id, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', 1) AS g, string_split_regex(text, '{p}') AS s FROM narr))) WHERE {where}"""


def _distinct(rows: str) -> str:
    """The first row of each value; rows of one order stand as in the text."""
    return f"SELECT id, {', '.join(_FIELDS)} FROM (SELECT *, row_number() OVER (PARTITION BY id, qi_type, normalized_value ORDER BY ord, start_pos, end_pos, qi_type) AS r FROM ({rows})) WHERE r = 1"


_STOPS = "|".join(K.STOP_WORDS)
_TRIM = f"lower(regexp_replace(trim(regexp_replace(trim(regexp_replace(v, '\\s+', ' ', 'g')), '(?i)(^|\\s+)((?:{_STOPS})[.,;:]*\\s*)+$', '')), '[.,;:]+$', ''))"
_YEARS = "CAST(CAST(regexp_extract(v, '[0-9]+') AS INT) AS VARCHAR)"
_LIVED = "CAST(regexp_extract(v, '[0-9]+') AS INT) BETWEEN 0 AND 120"
_OCC = "|".join(K.OCCUPATIONS)
_STATE_CASE = "CASE lower(v) " + " ".join(f"WHEN '{a}' THEN '{n}'" for a, n, _ in K.STATE_ROWS) + " ELSE lower(v) END"
_NAMES = "|".join(sorted((n for _, n, _ in K.STATE_ROWS), key=len, reverse=True))
_CODES = "|".join(a.upper() for a, _, _ in K.STATE_ROWS)
_GENDER = "CASE lower(v) WHEN 'man' THEN 'male' WHEN 'boy' THEN 'male' WHEN 'woman' THEN 'female' WHEN 'girl' THEN 'female' ELSE lower(v) END"
#: What each extractor finds; order 0 is the recognizer's, sorted by place.
PARTS = {
    "state": [_found(0, f"(?i)\\b({_NAMES})\\b", "location", 0.85, "ner", "lower(v)"), _found(0, f"\\b({_CODES})\\b", "location", 0.85, "ner", _STATE_CASE)],
    "place": [_found(0, "(?i)\\b(" + "|".join(PLACES) + ")\\b", "location", 0.7, "ner", "lower(v)")],
    "people": [_found(0, "(?i)\\b(" + "|".join(PEOPLES) + ")\\b", "ethnicity", 0.7, "ner", "lower(v)")],
    "gender": [_found(0, r"(?i)\b(male|female|man|woman|boy|girl)\b", "gender", 0.95, "ner", _GENDER)],
    "age_rules": [_found(0, K.AGE_RULES, "age", 0.9, "ner", _YEARS, where=_LIVED)],
    "disease": [_found(1, "(?i)\\b(" + "|".join(DISEASES) + ")\\b", "disease", 0.9, "dictionary", "lower(v)")],
    "occupation": [_found(2, f"(?i)\\b({_OCC})\\b", "occupation", 0.85, "phrase", "lower(v)")] + [_found(3 + k, f"(?i){p}", "occupation", 0.8, "pattern", _TRIM, "trim(w)", where=f"length({_TRIM}) >= 3") for k, p in enumerate(K.OCCUPATION_CONTEXT)],
    "age": [_found(10 + k, f"(?i){p}", "age", 0.9, "pattern", _YEARS, where=_LIVED) for k, p in enumerate(K.AGE_PATTERNS)],
    "dob": [_found(20 + k, f"(?i){p}", "date_of_birth", 0.95) for k, p in enumerate(K.DOB_PATTERNS)],
    "zip": [_found(30, f"(?i){K.ZIP_CONTEXT}", "zip_code", 0.95, raw="v", group=True), _found(31, K.ZIP_STATE, "zip_code", 0.9, group=True)],
}
_ALL = " UNION ALL ".join(q for part in PARTS.values() for q in part)
_UNION = _distinct(_ALL)
_NAMED = {"age": "ages", "age_rules": "told_ages", "dob": "births", "zip": "zips", "gender": "genders", "occupation": "occupations", "state": "states"}


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quasi.extract(R.narrative(spark, sf_dir), diseases=DISEASES, peoples=PEOPLES, places=PLACES)


def qi_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows_of(_extracted(spark, sf_dir), F.col("qis"))


def qi_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As qi_union_dedup, through the JSON in which QIs are cached."""
    return _rows_of(_extracted(spark, sf_dir).withColumn("qis", quasi.to_json(F.col("qis"))), quasi.from_json(F.col("qis")))


def qi_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns stand before what a recognizer found, which is preferred all the same."""
    t = F.col("text")
    return _rows_of(R.narrative(spark, sf_dir), quasi.dedup(F.concat(quasi.ages(t), quasi.told_ages(t)), "ner"))


# ---- model replies


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.replies(spark, sf_dir)
    keyed = rows.select(F.sha2("text", 256).alias("text_hash"), "reply")
    return quasi.from_replies(rows.drop("reply"), keyed)


def qi_llm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = R.replies(spark, sf_dir).select("id", F.explode_outer(quasi.parse_reply(F.col("reply"))).alias("i")).where("i is not null")
    return items.select("id", quasi.field(F.col("i"), "type").alias("type"), quasi.field(F.col("i"), "raw_value").alias("raw_value"))


def qi_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows_of(_validated(spark, sf_dir), F.col("qis")).select("id", "qi_type", "normalized_value", "confidence", "start_pos", "end_pos")


def qi_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests to send: one for each distinct text that has no recorded reply."""
    rows = R.narrative(spark, sf_dir).withColumn("text_hash", F.sha2("text", 256))
    told = rows.where("id % 4 = 0").select("text_hash")
    asked = rows.select("text_hash", "text").dropDuplicates(["text_hash"]).join(told, "text_hash", "left_anti")
    return asked.select("text_hash", F.md5(quasi.prompt(F.col("text"))).alias("request_md5"))


def qi_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.narrative(spark, sf_dir)
    spans = lambda raw: F.struct(F.lit(raw).alias("raw"), *(c.cast("int").alias(n) for c, n in zip(quasi.find_span(F.col("text"), F.lit(raw)), ("start", "end"), strict=True)))
    return rows.select("id", F.inline(F.array(spans("year"), spans("TEXAS"), spans("absent"))))


# ---- frequencies


def _people(spark: SparkSession, sf_dir: str, value: Column) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), value.alias("value"))


def _frequency(rows: DataFrame, table: DataFrame, kind: str) -> DataFrame:
    found = population.look_up(rows.select("*", F.lit(kind).alias("qi_type"), F.lower("value").alias("normalized_value"), F.col("value").alias("raw_value")), table)
    return found.select("id", F.round("probability", 9).alias("probability"), "population_count")


def freq_age_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequency(_people(spark, sf_dir, (F.col("c_custkey") % 130).cast("string")), ages_table(spark), "age")


def freq_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n in ("TX", "california", "Paris", "new york", "dc")))
    return _frequency(_people(spark, sf_dir, F.get(names, (F.col("c_custkey") % 5).cast("int"))), full_population(spark), "location")


def freq_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequency(_people(spark, sf_dir, (10_000 + F.col("c_custkey") % 40).cast("string")), full_population(spark), "zip_code")


def freq_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequency(_people(spark, sf_dir, F.get(F.array(F.lit("male"), F.lit("Female"), F.lit("x")), (F.col("c_custkey") % 3).cast("int"))), full_population(spark), "gender")


def freq_dob(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = F.array(*(F.lit(d) for d in ("3/7/1985", "1979-11-02", "3/7/85", "12-25-1960", "2/30/1990", "1-1-04", "7/4/69", "7-4-68", "2/29/1980")))
    rows = _people(spark, sf_dir, F.get(dates, (F.col("c_custkey") % 9).cast("int")))
    found = population.births(rows, "value", ages_table(spark), F.lit(TODAY).cast("date"))
    return found.select("id", F.round("probability", 9).alias("probability"), "population_count")


def _disease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir, F.get(F.array(*map(F.lit, DISEASES)), (F.col("c_custkey") % 4).cast("int")))


def freq_disease_like_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, topics = _disease(spark, sf_dir).select("value"), _frame(spark, TOPICS, "topic string, kind string, place string, year int, figure double")
    return _frequency(_disease(spark, sf_dir), population.surveyed(names, topics), "disease")


def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' numbers inside orders' numbers: an inverted index of characters instead of a nested loop."""
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("value"))
    texts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("no. a"), F.col("o_orderkey").cast("string"), F.lit("-a"), F.col("o_custkey").cast("string")).alias("topic"))
    found = population.containing(names, texts, "value", "topic")
    return found.groupBy("value").agg(F.count("*").alias("n"), F.max("topic").alias("last"))


def freq_disease_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequency(_disease(spark, sf_dir), full_population(spark), "disease")


def freq_occ_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = F.array(*(F.lit(j) for j in ("nurse", "Teacher", "pilot", "police officer", "clerk")))
    return _frequency(_people(spark, sf_dir, F.get(jobs, (F.col("c_custkey") % 5).cast("int"))), full_population(spark), "occupation")


def freq_fallback_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalized value is unknown; the raw value may be known."""
    rows = _people(spark, sf_dir, F.get(F.array(F.lit("TX"), F.lit("Narnia")), (F.col("c_custkey") % 2).cast("int")))
    found = population.look_up(rows.select("id", F.lit("location").alias("qi_type"), F.lit("lone star state").alias("normalized_value"), F.col("value").alias("raw_value")), full_population(spark))
    return found.select("id", F.round("probability", 9).alias("probability"), "population_count")


def k_anonymity_empirical(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anonymity.empirical(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_nationkey", "c_mktsegment")
    return out.withColumn("expected_k", F.round("expected_k", 6))


_AGE_SQL = f"ages AS (SELECT age, sum(people) / greatest(CAST(floor(sum(hi - lo + 1) / 2) AS BIGINT), 1) AS people FROM (SELECT *, unnest(range(lo, hi + 1)) AS age FROM {_values(BANDS, 'lo, hi, people')}) GROUP BY age)"
_STATES = _values([(a, n, f) for a, n, f in K.STATE_ROWS], "abbrev, name, fips")
_LOC = f"loc AS (SELECT unnest([abbrev, name]) AS value, CAST(people AS DOUBLE) / {TOTAL} AS p, people AS n FROM {_STATES} JOIN (SELECT * FROM {_values(STATE_PEOPLE, 'fips, people')}) USING (fips))"
_SURVEY = f"""survey AS (SELECT value, CAST(figure AS DOUBLE) / 100 AS p, CAST(floor(CAST(figure AS DOUBLE) / 100 * {K.NATION}) AS BIGINT) AS n FROM (
SELECT *, row_number() OVER (PARTITION BY value ORDER BY year DESC) AS r FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY year DESC) AS q FROM {_values([(d,) for d in DISEASES], 'value')} JOIN (SELECT * FROM {_values(TOPICS, 'topic, kind, place, year, figure')}) ON contains(lower(topic), value)
WHERE lower(kind) LIKE '%crude prevalence%' AND place = 'US') WHERE q <= 5 AND figure IS NOT NULL) WHERE r = 1)"""
_RARE = f"rare AS (SELECT * FROM {_values([('marfan syndrome', 5e-5, int(5e-5 * K.NATION)), ('asthma', 5e-6, int(5e-6 * K.NATION))], 'value, p, n')})"
_DISEASE = f"{_SURVEY}, {_RARE}, dis AS (SELECT value, p, n FROM survey UNION ALL SELECT value, CAST(p AS DOUBLE), n FROM rare WHERE value NOT IN (SELECT value FROM survey))"
_OCCS = f"occ AS (SELECT value, CAST(people AS DOUBLE) / {K.EMPLOYED} AS p, people AS n FROM {_values(SOC, 'value, soc')} JOIN (SELECT * FROM {_values(EMPLOYMENT, 'soc, people')}) USING (soc))"


def _freq_sql(ctes: str, value: str, table: str, p: str = "p", n: str = "n") -> str:
    return f"WITH {ctes} SELECT c_custkey AS id, round(CAST({p} AS DOUBLE), 9) AS probability, CAST({n} AS BIGINT) AS population_count FROM customer LEFT JOIN {table} f ON f.value = lower({value})"


def _pick(values: list[str]) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[c_custkey % {len(values)} + 1]"


# ---- expected k


def frequencies(spark: SparkSession, df: DataFrame) -> DataFrame:
    people = full_population(spark).cache()  # some 200 rows, joined twice
    return anonymity.with_frequencies(df, people, "id", today=F.lit(TODAY).cast("date"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymity.score(frequencies(spark, _extracted(spark, sf_dir)))


def q_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", F.round("expected_k", 6).alias("expected_k"), F.round("q_score", 6).alias("q_score"), F.size("qis").cast("long").alias("n_qis"))


def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports' scores and items, one row an item."""
    r = anonymity.report(_scored(spark, sf_dir)).select("id", "report.risk_level", F.round("report.q_score", 4).alias("q_score"), F.explode_outer("report.detected_quasi_identifiers").alias("i"))
    f = "i.frequency"
    return r.select(
        "id", "risk_level", "q_score", F.col("i.type").alias("qi_type"), F.col("i.raw_value").alias("raw_value"), F.col("i.normalized_value").alias("normalized_value"), F.col("i.detection_method").alias("method"),
        F.col("i.position.start").alias("start_pos"), F.col("i.position.end").alias("end_pos"), F.round(f"{f}.probability", 12).alias("probability"), F.col(f"{f}.population_count").alias("population_count"), F.col(f"{f}.source").alias("source"),
    )


def q_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", "q_masked")


def q_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each explanation, sorted: QIs of equal rank may stand in any order."""
    s = anonymity.explain(_scored(spark, sf_dir))
    return s.select("id", F.array_join(F.array_sort(F.split("explanation", "\n")), "\n").alias("explanation"))


def q_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return s.select("id", anonymity.rare(F.col("qis"), "disease").alias("rare_disease"), anonymity.rare(F.col("qis"), "occupation").alias("rare_occupation"))


_BORN = "CASE WHEN regexp_matches(normalized_value, '^\\d{4}-') THEN try_strptime(normalized_value, '%Y-%m-%d') WHEN regexp_matches(normalized_value, '/\\d{4}$') THEN try_strptime(normalized_value, '%m/%d/%Y') WHEN regexp_matches(normalized_value, '-\\d{4}$') THEN try_strptime(normalized_value, '%m-%d-%Y') ELSE try_strptime(normalized_value, '%m/%d/%y') END"
_POP = f"""{_AGE_SQL}, {_LOC}, {_DISEASE}, {_OCCS},
pop AS (SELECT 'age' AS t, CAST(age AS VARCHAR) AS value, CAST(people AS DOUBLE) / {TOTAL} AS p, CAST(floor(people) AS BIGINT) AS n, 'age bands' AS source FROM ages UNION ALL SELECT 'location', value, p, n, 'states' FROM loc
 UNION ALL SELECT 'zip_code', value, CAST(people AS DOUBLE) / {TOTAL}, people, 'ZIP areas' FROM {_values(ZIP_PEOPLE, 'value, people')} UNION ALL SELECT 'gender', value, CAST(people AS DOUBLE) / 332000000, people, 'sexes' FROM {_values(GENDER_PEOPLE, 'value, people')}
 UNION ALL SELECT 'disease', value, p, n, 'survey' FROM survey UNION ALL SELECT 'disease', value, p, n, 'rare diseases' FROM dis WHERE value NOT IN (SELECT value FROM survey) UNION ALL SELECT 'occupation', value, p, n, 'employment' FROM occ)"""


def prob_cte(union: str) -> str:
    """From (id, QI fields) rows: q with frequencies, k with expected k, s with scores."""
    return f"""{_POP}, qi AS ({union}),
y AS (SELECT *, qi_type = 'date_of_birth' AS born, CASE WHEN qi_type = 'date_of_birth' THEN CAST(date_sub('year', {_BORN}, DATE '{TODAY}') AS VARCHAR) ELSE normalized_value END AS look FROM qi),
q AS (SELECT y.*, CASE WHEN born THEN coalesce(a.p, b.p) / 365.25 ELSE coalesce(a.p, b.p) END AS p, CASE WHEN born THEN CAST(floor(coalesce(a.n, b.n) / 365.25) AS BIGINT) ELSE coalesce(a.n, b.n) END AS n, coalesce(a.source, b.source) || CASE WHEN born THEN ', by day of birth' ELSE '' END AS source
 FROM y LEFT JOIN pop a ON a.value = look AND a.t = CASE WHEN born THEN 'age' ELSE qi_type END LEFT JOIN pop b ON b.value = lower(raw_value) AND b.t = qi_type),
j AS (SELECT id, count(*) AS n_qis, {K.POPULATION} * product(p) AS ek, count(p) AS known FROM q GROUP BY id),
k AS (SELECT narr.id, text, coalesce(n_qis, 0) AS n_qis, coalesce(known, 0) AS known, CASE WHEN coalesce(known, 0) > 0 THEN ek ELSE {K.POPULATION} END AS ek FROM narr LEFT JOIN j USING (id)),
s AS (SELECT *, CASE WHEN ek < 5 THEN least(1, 1 - ek / 5) ELSE 0 END AS q FROM k)"""


_PROB = f"{R.NARR_CTE}, {prob_cte(_UNION)}"
#: Masks are cut in one after the other, from the last to the first.
MASK_CTE = """st AS (SELECT id, start_pos, end_pos, qi_type, row_number() OVER (PARTITION BY id ORDER BY start_pos DESC, ord_all) AS i FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE method WHEN 'ner' THEN 0 WHEN 'dictionary' THEN 1 WHEN 'phrase' THEN 2 ELSE 3 END, CASE qi_type WHEN 'occupation' THEN 0 WHEN 'age' THEN 1 WHEN 'date_of_birth' THEN 2 ELSE 3 END, start_pos, end_pos) AS ord_all FROM q)),
mk AS (SELECT id, text, 0 AS i FROM s UNION ALL SELECT mk.id, substr(text, 1, start_pos) || '[' || upper(qi_type) || ']' || substr(text, end_pos + 1), st.i FROM mk JOIN st ON st.id = mk.id AND st.i = mk.i + 1),
masked AS (SELECT s.id, CASE WHEN ek < 5 THEN arg_max(mk.text, mk.i) ELSE any_value(s.text) END AS q_masked FROM s JOIN mk ON mk.id = s.id GROUP BY s.id, ek)"""


# ---- contextual factors


def c_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = contextual.judge(R.factor_replies(spark, sf_dir))
    return j.select("id", F.round("c_score", 6).alias("c_score"), "c_level", F.size("detected").cast("long").alias("n_detected"), "deemed_sensitive")


def c_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests about all documents: one for each distinct text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.trim("text").alias("text")).where("text is not null").distinct()
    return docs.select(F.md5("text").alias("text_md5"), F.md5(contextual.prompt(F.col("text"))).alias("request_md5"))


def c_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judgement says, by its lines."""
    j = contextual.judge(R.factor_replies(spark, sf_dir))
    lines = F.split(contextual.summary_text(F.col("c_level"), F.col("c_score"), F.col("factors"), contextual.summary_of(F.col("reply"))), "\n")
    yes = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("    Status: ✓ YES"))))
    return j.select("id", F.get(lines, 3).alias("risk"), F.size(lines).cast("long").alias("n_lines"), yes.cast("long").alias("n_yes"), F.get(lines, F.size(lines) - 2).alias("summary"))


def c_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    # outer: a plain explode would have the optimizer test the array's size first, judging anew
    j = contextual.judge(R.factor_replies(spark, sf_dir)).select(F.explode_outer("factors").alias("f"))
    return j.groupBy("f.name").agg(F.count("*").alias("n"), F.count_if("f.detected").alias("n_detected"), F.round(F.sum("f.confidence"), 6).alias("confidence"))


def c_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(*(F.lit(v) for v, _ in COERCIONS))
    rows = _people(spark, sf_dir, F.get(values, (F.col("c_custkey") % len(COERCIONS)).cast("int")))
    return rows.select("id", contextual.confidence(F.try_parse_json("value")).alias("confidence"))


COERCIONS = [("0.7", 0.7), ("true", 1.0), ('"0.4"', 0.4), ('" High "', 0.75), ('"unknown"', 0.0), ('{"score":"med"}', 0.5), ('{"high":0.9,"low":0.1}', 0.9), ('{"a":0.2,"b":0.6}', 0.6), ('[0.1,"high"]', 0.75), ("[]", 0.0), ("null", 0.0)]
_INF = "CASE WHEN c_custkey % 9 <> 0 AND c_custkey % 2 = 0 THEN (c_custkey % 10) / 10.0 ELSE 0 END"
_SOC_CONF = "CASE c_custkey % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.4 WHEN 2 THEN 0 ELSE 0.5 END"
_C = f"""c AS (SELECT c_custkey AS id, c_custkey % 9 <> 0 AS ok, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE 0.2 * {_INF} + CASE WHEN c_custkey % 5 <> 0 THEN 0.14 * {_SOC_CONF} ELSE 0 END + 0.1 * 0.25 END AS c,
CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE 1 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 5 <> 0 THEN 1 ELSE 0 END END AS n FROM customer)"""


REGISTRY = {f"qi_{k}": (_pattern(name, k), f"WITH {R.NARR_CTE} {_distinct(' UNION ALL '.join(PARTS[k]))}") for k, name in _NAMED.items()}
REGISTRY |= {
    "qi_union_dedup": (qi_union_dedup, f"WITH {R.NARR_CTE} {_UNION}"),
    "qi_round_trip": (qi_round_trip, f"WITH {R.NARR_CTE} {_UNION}"),
    "qi_priority": (qi_priority, f"WITH {R.NARR_CTE} {_distinct(' UNION ALL '.join(PARTS['age_rules'] + PARTS['age']))}"),
    "qi_requests": (qi_requests, f"WITH {R.NARR_CTE} SELECT DISTINCT sha256(text) AS text_hash, md5('List the quasi-identifiers of the text as JSON: {{\"quasi_identifiers\":[{{\"type\",\"raw_value\",\"normalized_value\",\"confidence\"}}]}}. Types: {', '.join(K.QI_TYPES)}.' || chr(10) || 'Text:' || chr(10) || text) AS request_md5 FROM narr WHERE text NOT IN (SELECT text FROM narr WHERE id % 4 = 0)"),
    "qi_llm_parse": (qi_llm_parse, f"""WITH {R.REPLY_CTE}, j AS (SELECT id, unnest(json_extract(regexp_extract(reply, '(?s)\\{{.*\\}}'), '$.quasi_identifiers[*]')) AS i FROM rep WHERE reply LIKE '%{{%') SELECT id, i->>'type' AS type, i->>'raw_value' AS raw_value FROM j"""),
    "qi_validate": (
        qi_validate,
        f"""WITH {R.REPLY_CTE}, j AS (SELECT id, text, unnest(json_extract(regexp_extract(reply, '(?s)\\{{.*\\}}'), '$.quasi_identifiers[*]')) AS i FROM rep WHERE reply LIKE '%{{%'),
v AS (SELECT id, text, i->>'type' AS qi_type, i->>'raw_value' AS raw, trim(lower(coalesce(i->>'normalized_value', i->>'raw_value'))) AS nv, CASE WHEN (i->'confidence') IS NULL THEN 0.5 ELSE TRY_CAST(i->>'confidence' AS DOUBLE) END AS c, json_type(i) AS kind FROM j),
w AS (SELECT * FROM v WHERE id NOT IN (SELECT id FROM v WHERE c IS NULL OR kind <> 'OBJECT') AND qi_type <> 'planet' AND contains(lower(text), lower(raw))),
p AS (SELECT *, CASE WHEN strpos(text, raw) > 0 THEN strpos(text, raw) ELSE strpos(lower(text), lower(raw)) END AS pos FROM w)
SELECT id, qi_type, nv AS normalized_value, max(least(greatest(c, 0), 1)) AS confidence, CAST(min(pos - 1) AS INT) AS start_pos, CAST(min(pos - 1 + length(raw)) AS INT) AS end_pos FROM p GROUP BY id, qi_type, nv""",
    ),
    "qi_span": (qi_span, f"WITH {R.NARR_CTE}, r AS (SELECT id, unnest(['year', 'TEXAS', 'absent']) AS raw, text FROM narr), p AS (SELECT id, raw, CASE WHEN strpos(text, raw) > 0 THEN strpos(text, raw) ELSE strpos(lower(text), lower(raw)) END AS pos FROM r) SELECT id, raw, CAST(greatest(pos - 1, 0) AS INT) AS start, CAST(CASE WHEN pos > 0 THEN pos - 1 + length(raw) ELSE 0 END AS INT) AS \"end\" FROM p"),
    "freq_age_band": (freq_age_band, f"WITH {_AGE_SQL} SELECT c_custkey AS id, round(people / {TOTAL}, 9) AS probability, CAST(floor(people) AS BIGINT) AS population_count FROM customer LEFT JOIN ages ON age = c_custkey % 130"),
    "freq_state": (freq_state, _freq_sql(_LOC, _pick(["TX", "california", "Paris", "new york", "dc"]), "loc")),
    "freq_zip": (freq_zip, _freq_sql(f"z AS (SELECT value, CAST(people AS DOUBLE) / {TOTAL} AS p, people AS n FROM {_values(ZIP_PEOPLE, 'value, people')})", "CAST(10000 + c_custkey % 40 AS VARCHAR)", "z")),
    "freq_gender": (freq_gender, _freq_sql(f"g AS (SELECT value, CAST(people AS DOUBLE) / 332000000 AS p, people AS n FROM {_values(GENDER_PEOPLE, 'value, people')})", _pick(["male", "Female", "x"]), "g")),
    "freq_dob": (
        freq_dob,
        f"""WITH {_AGE_SQL}, d AS (SELECT c_custkey AS id, ([DATE '1985-03-07', DATE '1979-11-02', DATE '1985-03-07', DATE '1960-12-25', NULL, DATE '2004-01-01', DATE '1969-07-04', DATE '2068-07-04', DATE '1980-02-29'])[c_custkey % 9 + 1] AS born FROM customer)
SELECT id, round(people / {TOTAL} / 365.25, 9) AS probability, CAST(floor(CAST(floor(people) AS BIGINT) / 365.25) AS BIGINT) AS population_count FROM d LEFT JOIN ages ON age = date_sub('year', born, DATE '{TODAY}')""",
    ),
    "freq_disease_like_top1": (freq_disease_like_top1, _freq_sql(_SURVEY, _pick(DISEASES), "survey")),
    "containment_join": (
        containment_join,
        "SELECT 'A' || c_custkey AS value, count(*) AS n, max(topic) AS last FROM customer JOIN (SELECT 'no. a' || o_orderkey || '-a' || o_custkey AS topic FROM orders) ON contains(topic, 'a' || c_custkey) GROUP BY 1",
    ),
    "freq_disease_pages": (freq_disease_pages, _freq_sql(_DISEASE, _pick(DISEASES), "dis")),
    "freq_occ_pages": (freq_occ_pages, _freq_sql(_OCCS, _pick(["nurse", "Teacher", "pilot", "police officer", "clerk"]), "occ")),
    "freq_disease_fallback": (freq_disease_fallback, _freq_sql(_DISEASE, _pick(DISEASES), "dis")),
    "freq_occ_two_hop": (freq_occ_two_hop, _freq_sql(_OCCS, _pick(["nurse", "Teacher", "pilot", "police officer", "clerk"]), "occ")),
    "freq_fallback_raw": (freq_fallback_raw, _freq_sql(_LOC, _pick(["TX", "Narnia"]), "loc")),
    "k_anonymity_empirical": (k_anonymity_empirical, "WITH a AS (SELECT c_nationkey, count(*) AS x FROM customer GROUP BY 1), b AS (SELECT c_mktsegment, count(*) AS y FROM customer GROUP BY 1), g AS (SELECT c_nationkey, c_mktsegment, count(*) AS k FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment, k, round(CAST(x AS DOUBLE) * y / (SELECT count(*) FROM customer), 6) AS expected_k FROM g JOIN a USING (c_nationkey) JOIN b USING (c_mktsegment)"),
    "q_score": (q_score, f"WITH {_PROB} SELECT id, round(ek, 6) AS expected_k, round(CAST(q AS DOUBLE), 6) AS q_score, n_qis FROM s"),
    "q_report": (
        q_report,
        f"""WITH {_PROB} SELECT s.id, CASE WHEN s.q >= 0.7 THEN 'HIGH' WHEN s.q >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, round(CAST(s.q AS DOUBLE), 4) AS q_score, qi_type, raw_value, normalized_value, method, start_pos, end_pos, round(p, 12) AS probability, n AS population_count, source FROM s LEFT JOIN q ON q.id = s.id""",
    ),
    "q_mask": (q_mask, f"WITH RECURSIVE {_PROB}, {MASK_CTE} SELECT id, q_masked FROM masked"),
    "q_explain": (
        q_explain,
        f"""WITH {_PROB}, ln AS (SELECT id, list(printf('  - %s: ''%s'' [%s] ', qi_type, normalized_value, method) || CASE WHEN p IS NULL THEN '(frequency unknown)' ELSE printf('(P ≈ %.2e, ~', p) || format('{{:,}}', n) || ' people) [' || source || ']' END) AS l FROM q GROUP BY id)
SELECT s.id, CASE WHEN n_qis = 0 THEN 'No quasi-identifiers detected.' WHEN known = 0 THEN printf('Detected %d QI(s) but could not lookup frequencies.', n_qis) ELSE array_to_string(list_sort(list_concat(l, [printf('Detected %d quasi-identifier(s):', n_qis), '', printf('Expected equivalence class size E[k]: %.4f', ek), CASE WHEN ek < 1 THEN '🚨 E[k] < 1: Likely UNIQUELY IDENTIFYING' WHEN ek < 5 THEN '⚠️ E[k] < 5: HIGH re-identification risk' ELSE '✓ E[k] ≥ 5: Acceptable k-anonymity' END])), chr(10)) END AS explanation FROM s LEFT JOIN ln USING (id)""",
    ),
    "q_rare": (q_rare, f"WITH {_PROB} SELECT s.id, coalesce(bool_or(qi_type = 'disease' AND p < 0.001), false) AS rare_disease, coalesce(bool_or(qi_type = 'occupation' AND p < 0.001), false) AS rare_occupation FROM s LEFT JOIN q ON q.id = s.id GROUP BY s.id"),
    "c_score": (c_score, f"WITH {_C} SELECT id, round(CAST(c AS DOUBLE), 6) AS c_score, CASE WHEN c >= 0.6 THEN 'CRITICAL' WHEN c >= 0.4 THEN 'HIGH' WHEN c >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS c_level, CAST(n AS BIGINT) AS n_detected, c >= 0.3 AS deemed_sensitive FROM c"),
    "c_requests": (
        c_requests,
        f"SELECT md5(t) AS text_md5, md5('Rate each factor as JSON {{\"factors\":[{{\"name\",\"detected\",\"confidence\",\"explanation\"}}],\"summary\"}}; ignore [TOKENS]. Factors: {', '.join(K.FACTOR_WEIGHTS)}.' || chr(10) || 'Text:' || chr(10) || t) AS request_md5 FROM (SELECT DISTINCT trim(text, ' ') AS t FROM documents WHERE text IS NOT NULL)",
    ),
    "c_summary": (
        c_summary,
        f"""WITH {_C} SELECT id, 'Overall Risk: ' || CASE WHEN c >= 0.6 THEN 'CRITICAL' WHEN c >= 0.4 THEN 'HIGH' WHEN c >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS risk, CAST(13 + 2 * CASE WHEN id % 9 = 0 THEN 7 ELSE 8 END + n AS BIGINT) AS n_lines, CAST(n AS BIGINT) AS n_yes, CASE WHEN id % 9 = 0 THEN '' ELSE 's' END AS summary FROM c""",
    ),
    "c_fill": (
        c_fill,
        f"""SELECT 'INFERENTIAL_DISCLOSURE' AS name, count(*) AS n, count(*) FILTER (c_custkey % 9 <> 0 AND c_custkey % 2 = 0) AS n_detected, round(CAST(sum(CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey % 10) / 10.0 ELSE 0 END) AS DOUBLE), 6) AS confidence FROM customer
UNION ALL SELECT 'SOCIAL_STIGMA_RISK', count(*), count(*) FILTER (c_custkey % 9 <> 0 AND c_custkey % 5 <> 0), round(CAST(sum(CASE WHEN c_custkey % 9 <> 0 THEN {_SOC_CONF} ELSE 0 END) AS DOUBLE), 6) FROM customer
UNION ALL SELECT 'NEW_FACTOR', count(*), count(*), 0.25 * count(*) FROM customer WHERE c_custkey % 9 <> 0
UNION ALL SELECT unnest(['NARRATIVE_UNIQUENESS', 'SMALL_COMMUNITY_RISK', 'EMPLOYMENT_SENSITIVITY', 'MENTAL_HEALTH_INDICATORS', 'TEMPORAL_CORRELATION_RISK']), count(*), 0, 0 FROM customer""",
    ),
    "c_coerce": (c_coerce, f"SELECT c_custkey AS id, CAST(([{', '.join(str(c) for _, c in COERCIONS)}])[c_custkey % {len(COERCIONS)} + 1] AS DOUBLE) AS confidence FROM customer"),
}
