"""Plans whose cost must grow no faster than the data."""

import random
import re

from pyspark.sql import functions as F

from veilframe.functions import constants
from veilframe.functions import text as X
from veilframe.operators import anonymity, assess, contextual, evaluate, features, policy, population, quasi
from veilframe.plans import case_queries, quasi_queries, rendered
from veilframe.sources.shared import new_path, stored

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_containing_joins_names_as_a_whole(spark):
    rng = random.Random(7)
    names = spark.createDataFrame([(k, f"Aa{k}") for k in range(300)] + [(300, "ü😀"), (301, "x")], "i int, name string")
    texts = [f"{'-' * rng.randrange(600)}aa{rng.randrange(400)}aa{rng.randrange(400)}" for _ in range(60)] + ["-" * 255 + "aa7", "ÜÜ😀", "X" * 700]
    bodies = spark.createDataFrame(list(enumerate(texts)), "j int, body string")
    pairs = population.containing(names, bodies, "name", "body")
    want = sorted((i, j) for i, n in names.collect() for j, t in enumerate(texts) if n.lower() in t.lower())
    assert sorted((r["i"], r["j"]) for r in pairs.collect()) == want
    plan = _plan(pairs)
    assert "SortMergeJoin [_low" in plan and "BroadcastHashJoin [_low" not in plan and "Contains(" not in plan


def test_replies_are_parsed_once(spark):
    plan = quasi_queries.c_fill(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "Filter" not in plan  # a filter on the factors would judge each reply again


def test_rows_of_the_data_are_not_broadcast(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a "), (3, None)], "id int, text string")
    told = contextual.memoised(df, "text", lambda d: d.withColumn("n", F.length("text")), "n")
    assert sorted((r["id"], r["n"]) for r in told.collect()) == [(1, 1), (2, 1), (3, None)]
    qis = df.withColumn("qis", F.array(quasi._qi("zip_code", F.lit("10000"), F.lit("10000"), 0.9, F.lit(0), F.lit(5), "pattern")))
    people = spark.createDataFrame([("zip_code", "10000", 0.5, 7, "here")], population.SCHEMA)
    met = anonymity.with_frequencies(qis, people, "id")
    assert [r["qis"][0]["population_count"] for r in met.collect()] == [7, 7, 7]
    assert "SortMergeJoin [_key" in _plan(told) and "SortMergeJoin [id" in _plan(met)


def test_what_an_assessment_works_out_once_a_row(spark):
    """No comparison by lambda, no fold over a text without a match, one parse of a reply."""
    df = spark.createDataFrame([(1, "Aged 30, a nurse in Texas ﷐ CA", '{"factors":[]}'), (2, "﷑", "{"), (3, None, None)], "id int, text string, reply string")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    found = quasi.extract(df, "text", ["asthma"], ["irish"], ["paris"])
    assert [[(q["qi_type"], q["start_pos"]) for q in r["qis"]] for r in found.orderBy("id").collect()] == [[("location", 20), ("location", 28), ("occupation", 11), ("age", 0)], [], []]
    told = plan(found)
    assert not re.search(r"\barray_sort\(", told) and re.search(r"CASE WHEN [Cc]ontains\(lambda m", told)
    judged = contextual.judge(df)
    assert [r["c_status"] for r in judged.orderBy("id").collect()] == ["ok", "unparsed", "no reply"]
    assert plan(judged).lower().count("parsejson") == 1


def test_grouped_alternatives_find_what_plain_ones_do():
    rng = random.Random(5)
    words = ["new york", "new", "nurse", "o", "ohio", "Oh", "west virginia", "virginia"]
    for any_case, flags in ((True, re.I), (False, 0)):
        grouped, plain = re.compile(quasi._one_of(words, any_case)), re.compile(r"\b(" + "|".join(words) + r")\b", flags)
        for _ in range(500):
            text = "".join(rng.choice([*words, "NEW", " ", ", ", "x", "é"]) for _ in range(8))
            assert [m.span() for m in grouped.finditer(text)] == [m.span() for m in plain.finditer(text)]
    assert quasi._one_of(["a.b", "é"]) == r"(?i)\b(a.b|é)\b"


def test_dates_are_tried_only_where_their_year_may_stand(spark):
    days = ["3/7/1985", "1979-11-02", "12-25-1960", "1985/3/7", "3/7/85", "3-7-68", "DOB: 3/7/1985", "3/7/1985 ", "13/1/2000", "19790-1-1", "", None]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    out = df.select(population.birth_age(F.col("d"), F.lit("2026-01-01").cast("date")).alias("a"))
    assert [r["a"] for r in out.collect()] == [40, 46, 65, 40, 40, -43, None, None, None, None, None, None]
    assert "CASE WHEN RLIKE(" in _plan(out)


def test_a_run_reads_more_files_of_more_cases(spark, monkeypatch):
    made = []
    monkeypatch.setattr(case_queries, "CASES_A_FILE", 10)
    monkeypatch.setattr(case_queries, "new_path", lambda s, what: made.append(new_path(s, what)) or made[-1])
    rows = case_queries.case_run(spark, SF).count()
    files = spark.read.format("binaryFile").load(made[0])
    assert rows == spark.read.parquet(f"{SF}/customer.parquet").count() and files.count() >= rows / 10


def test_scores_that_no_one_reads_are_not_made(spark):
    """Without the comparison no text but the last mask is judged, and what the row still has is as it was."""
    whole, part = (case_queries._assessed(spark, SF, compared=c) for c in (True, False))
    assert set(whole.columns) - set(part.columns) == {"c_original", "original_sensitive", "c_scores_by_k", "masked_counts_by_k"}
    assert part.count() == whole.count() and whole.select(part.columns).exceptAll(part).isEmpty()
    assert "Generate" not in _plan(part) and "Generate" in _plan(whole)


def test_patterns_behind_a_look_at_the_first_letter_find_what_they_find_alone(spark):
    rng = random.Random(11)
    parts = ["Aged 30", "AGE: 7", "45 years old", "9yo", "12 M", "DOB: 3/7/1985", "born 1979-11-02", "D.O.B. 1/2/85", "zip 10007", "lives at zip", "OH 10007-1234", "Works as a Nurse", "is a painter", "role: pilot", "woman", "Male", "é", "-", ", ", "ß", "\n"]
    df = spark.createDataFrame([("".join(rng.choice([*parts, " ", "x", "1"]) for _ in range(9)),) for _ in range(400)], "t string")
    seen = quasi.extract(df, "t")._jdf.queryExecution().analyzed().toString()
    ahead = {p: look for look, p in re.findall(r"(\(\?i\)\(\?=\[[^]]+\]\))(.*?), \ufdd0\$0", seen)}
    patterns = [*constants.AGE_PATTERNS, *constants.DOB_PATTERNS, *constants.OCCUPATION_CONTEXT, constants.ZIP_CONTEXT]
    assert set(patterns) <= set(ahead)
    same = [F.regexp_extract_all("t", F.lit(ahead[p] + p), F.lit(0)) == F.regexp_extract_all("t", F.lit("(?i)" + p), F.lit(0)) for p in patterns]
    out = df.select(*(s.alias(f"{k}") for k, s in enumerate(same)))
    assert all(all(r) for r in out.collect())


def test_a_date_is_read_once(spark):
    plan = spark.createDataFrame([("3/7/1985",)], "d string").select(population.birth_age(F.col("d"), F.current_date()))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("gettimestamp(") == 4  # a try for each format


def test_medians_sort_natively(spark):
    df = spark.createDataFrame([([3.0, 1.0],), ([2.0, None, 1.0],), ([1.0, None],), ([],), (None,), ([5.0, 1.0, 2.0],)], "v array<double>")
    out = df.select(X.median(F.col("v")).alias("m"))
    assert [r["m"] for r in out.collect()] == [2.0, 2.0, None, 0.0, 0.0, 2.0]
    assert not re.search(r"\barray_sort\(", out._jdf.queryExecution().optimizedPlan().toString())


def test_correlations_are_one_short_aggregate(spark):
    rows = [(k, float(k % 7), None if k % 5 else 1.0 * k, k % 3 == 0, 2.0) for k in range(200)]
    df = spark.createDataFrame(rows, "a int, b double, c double, y boolean, same double")
    names = ("a", "b", "c", "same")
    flat = df.agg(*(F.corr(F.col(n).cast("double"), F.col("y").cast("double")).alias(n) for n in ("a", "b"))).first()
    told = evaluate.correlations(df, names, "y")
    got = {r["feature"]: r["corr"] for r in told.collect()}
    assert list(got) == list(names) and got["same"] == 0.0 and all(abs(got[n] - flat[n]) < 1e-12 for n in ("a", "b"))
    assert told._jdf.queryExecution().optimizedPlan().toString().count("covar_pop(") == 1
    cells = {(r["a"], r["b"]): r["corr"] for r in evaluate.corr_matrix(df, names).collect()}
    assert len(cells) == 16 and cells["a", "b"] == cells["b", "a"] and abs(cells["a", "a"] - 1) < 1e-12 and cells["same", "a"] != cells["same", "a"]
    assert [(r["feature"], r["corr"]) for r in evaluate.correlations(df.where("a < 0"), names, "y").collect()] == [(n, 0.0) for n in names]
    assert all(r["corr"] != r["corr"] for r in evaluate.corr_matrix(df.where("a < 0"), names).collect())


def test_columns_that_no_one_reads_are_not_made(spark, monkeypatch):
    """What is written holds what the query reads; the rows are those of the whole assessment."""
    kept = []
    monkeypatch.setattr(assess, "stored", lambda df, what: kept.append(df) or stored(df, what))
    whole = case_queries._assessed(spark, SF)
    scattered = case_queries.case_scatter(spark, SF)
    want = evaluate.scatter(whole, "id", features.SCATTERED, "c_score", "deemed_sensitive").withColumns({c: F.round(c, 6) for c in ("value", "score")})
    assert scattered.count() == want.count() and scattered.exceptAll(want.select(scattered.columns)).isEmpty()
    assert set(kept[1].columns) == {"id", "q_masked", *features.SCATTERED}
    assert "qis" in kept[0].columns


def test_a_small_population_meets_the_rows_where_they_are(spark):
    """As the join tells it: by normalized or raw value, without a figure, by age of a birth, without any."""
    people = spark.createDataFrame([("age", "40", 0.25, 3653, "bands"), ("disease", "flu", None, 5, "none"), ("disease", "grippe", 0.5, 7, "here"), ("zip_code", "10000", 0.1, None, None), (None, "x", 0.1, 1, "n"), ("disease", None, 0.1, 1, "n")], population.SCHEMA)
    qis = [("disease", "Grippe", "flu"), ("disease", "FLU", "flu"), ("disease", "Grippe", None), ("date_of_birth", "3/7/1985", "born"), ("date_of_birth", "odd", "odd"), ("zip_code", "10000", "10000"), ("planet", "Mars", "mars"), (None, "x", "x")]
    rows = [(1, [(k, r, n, 0.5, 0, 1, "m") for k, r, n in qis] + [None]), (2, []), (3, None), (4, [("zip_code", "10000", "y", 0.5, 0, 1, "m")])]
    df = spark.createDataFrame(rows, f"id int, qis {quasi.NONE}")
    day = F.lit("2026-01-01").cast("date")
    joined, placed = (anonymity.with_frequencies(df, people, "id", today=day, in_place=p) for p in (False, True))
    assert [r.asDict(True) for r in placed.orderBy("id").collect()] == [r.asDict(True) for r in joined.orderBy("id").collect()]
    assert placed.schema["qis"].dataType.simpleString() == joined.schema["qis"].dataType.simpleString()
    assert [q["population_count"] for q in placed.where("id = 1").first()["qis"]] == [7, 5, 7, 10, None, None, None, None, None]
    assert "Exchange hash" not in _plan(placed.drop("_x")).split("BroadcastNestedLoopJoin")[0] and "SortMergeJoin" not in _plan(placed)
    assert population.fits(people) and not population.fits(people.union(people))
    assert not population.fits(spark.range(population.MAPPED + 1).selectExpr("'a' AS qi_type", "CAST(id AS STRING) AS value"))
    none = anonymity.with_frequencies(df, people.where("false"), "id", in_place=True)
    assert none.where("exists(qis, q -> q.probability IS NOT NULL)").isEmpty() and none.count() == 4


def test_cases_are_dealt_to_several_tasks_a_core(spark):
    """A row group is read by one task, whatever the splits of its file."""
    assert rendered.customers(spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_a_decision_makes_no_column_that_it_does_not_read(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(assess, "stored", lambda df, what: kept.append(df) or stored(df, what))
    whole, decided = case_queries._assessed(spark, SF), case_queries.case_policy(spark, SF)
    full = policy.decide(whole).select("id", "rule", "tier", "routing", F.array_join("reasons", "; ").alias("reasons"), F.md5("masked_text").alias("masked_md5"))
    assert decided.count() == full.count() and decided.exceptAll(full).isEmpty()
    assert "qis" in kept[0].columns and set(kept[1].columns) == {"id", *policy.INPUT} - {"c_score"}
