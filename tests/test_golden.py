"""Recorded and derived golden values of scores, masks, coercions and policy."""

import hashlib

import pytest
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.functions import text as X
from veilframe.operators import anonymity, assess, contextual, evaluate, explicit, features, policy, population, quasi, sweep
from veilframe.sources import blocks, literal, results, shared
from veilframe.streaming import resume


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_overlapping_spans_cut_their_neighbours(spark):
    text = "Email: jane.doe@email.com and more text"
    rows = [("EMAIL_ADDRESS", 7, 25, "", 1.0), ("URL", 16, 25, "", 0.5), ("URL", 7, 12, "", 0.5)]
    df = spark.createDataFrame([(text, rows)], f"text string, spans {S.SPAN}")
    exact, merged = df.select(S.masked(F.col("text"), F.col("spans")), S.masked(F.col("text"), F.col("spans"), "merged")).first()
    assert exact == "Email: [URL]L_ADDRESS] more text"
    assert merged == "Email: [URL]doe@[URL] and more text"


def test_spans_are_code_points(spark):
    df = spark.createDataFrame([("é😀 a@b.co, x@y.org",), (None,), ("",)], "text string")
    found = explicit.entities(df).select(F.transform("entities", lambda e: F.struct(e["start"], e["end"], e["text"]))).collect()
    assert [tuple(e) for e in found[0][0]] == [(3, 9, "a@b.co"), (11, 18, "x@y.org")]
    assert found[1][0] == [] and found[2][0] == []


def test_e_score_of_recorded_row(spark):
    kinds = ["PERSON"] * 2 + ["LOCATION"] * 3 + ["DATE_TIME"] * 3 + ["ORGANIZATION"] * 2
    weights = {"PERSON": 0.9, "LOCATION": 0.6, "DATE_TIME": 0.5, "ORGANIZATION": 0.5}
    df = spark.createDataFrame([([(round(0.85 * weights[k], 4),) for k in kinds],)], "e array<struct<weighted_score:double>>")
    assert df.select(explicit.score(F.col("e"))).first()[0] == pytest.approx(0.6664)


def test_weights_have_a_default(spark):
    assert one(spark, explicit.weight(F.lit("US_SSN"))) == 1.0
    assert one(spark, explicit.weight(F.lit("OTHER"))) == 0.5


@pytest.mark.parametrize(
    ("value", "want"),
    [("0.7", 0.7), ("true", 1.0), ('"0.4"', 0.4), ('" High "', 0.75), ('"unknown"', 0.0), ('{"score":"med"}', 0.5), ('{"high":0.9,"low":0.1}', 0.9), ('{"a":0.2,"b":0.6}', 0.6), ('[0.1,"high"]', 0.75), ("[]", 0.0), ("null", 0.0)],
)
def test_confidence_coercion(spark, value, want):
    assert one(spark, contextual.confidence(F.try_parse_json(F.lit(value)))) == pytest.approx(want)


def test_single_factor_reply(spark):
    reply = 'x {"factors":[{"name":"NARRATIVE_UNIQUENESS","detected":true,"confidence":0.8}],"summary":""} y'
    row = contextual.judge(spark.createDataFrame([(reply,), (None,), ("oops",)], "reply string")).collect()
    assert row[0]["c_score"] == pytest.approx(0.144) and row[0]["c_level"] == "LOW" and len(row[0]["factors"]) == 7
    assert [f["name"] for f in row[0]["factors"]] == sorted(f["name"] for f in row[0]["factors"])
    assert row[1]["c_level"] == "ERROR" and row[1]["c_score"] == 0
    assert row[2]["c_status"] == "unparsed" and row[2]["detected"] == []


SCENARIOS = [
    ((0.1, 0.0, 0.05, False, False), ("default", "unrestricted", "cloud", "none")),
    ((0.45, 0.15, 0.08, False, False), ("R7", "confidential", "tee", "reversible")),
    ((0.75, 0.3, 0.1, True, False), ("R1", "restricted", "local", "block")),
    ((0.2, 0.1, 0.45, False, False), ("R3", "restricted", "local", "block")),
    ((0.35, 0.25, 0.12, False, True), ("R5", "confidential", "tee", "reversible")),
    ((0.15, 0.05, 0.13, False, False), ("R6", "confidential", "tee", "reversible")),
]


def test_policy_scenarios(spark):
    df = spark.createDataFrame([(k, *s[0]) for k, s in enumerate(SCENARIOS)], "k int, e_score double, q_score double, c_score double, has_direct boolean, has_combo boolean")
    got = policy.decide(df).orderBy("k").collect()
    assert [(r["rule"], r["tier"], r["routing"], r["transformation"]) for r in got] == [s[1] for s in SCENARIOS]
    assert len(got[4]["reasons"]) == 2 and got[0]["masked_text"] is None


def test_policy_switches_and_masks(spark):
    df = spark.createDataFrame([(0.75, True, "E", "")], "e_score double, has_direct boolean, e_masked string, q_masked string")
    row = policy.decide(df, policy.Policy(direct_restricts=False)).first()
    assert row["rule"] == "R4a" and row["masked_text"] == "E"


def test_expected_k_goldens(spark):
    qi = "array<struct<qi_type:string,raw_value:string,normalized_value:string,confidence:double,start_pos:int,end_pos:int,probability:double>>"
    rows = [("ab rare", [("disease", "rare", "rare", 0.9, 3, 7, 5e-6)]), ("ab", []), ("rare", [("disease", "rare", "rare", 0.9, 0, 4, 1e-9)])]
    got = anonymity.score(spark.createDataFrame(rows, f"text string, qis {qi}")).collect()
    assert got[0]["expected_k"] == pytest.approx(1661.9377, abs=1e-4) and got[0]["q_masked"] == "ab rare"
    assert got[1]["expected_k"] == 332387540 and got[1]["q_score"] == 0
    assert got[2]["q_masked"] == "[DISEASE]" and got[2]["q_score"] == pytest.approx(1 - 0.33238754 / 5)


def test_prevalence_classes(spark):
    assert one(spark, population.prevalence_class(F.lit("<1 / 1 000 000"))) == 5e-7
    assert one(spark, population.prevalence_class(F.lit("unknown"))) is None


def test_two_digit_years(spark):
    at = F.lit("2026-01-01").cast("date")
    assert one(spark, population.birth_age(F.lit("3/7/85"), at)) == 40
    assert one(spark, population.birth_age(F.lit("1-1-04"), at)) == 22
    assert one(spark, population.birth_age(F.lit("2/30/1990"), at)) is None
    born = lambda d, today: one(spark, population.birth_age(F.lit(d), F.lit(today).cast("date")))
    assert born("3/7/69", "2025-02-28") == 55 and born("3/7/70", "2025-02-28") == 54 and born("3/7/68", "2025-02-28") == -44
    assert born("2/29/1980", "2025-02-28") == 44 and born("2/29/1980", "2025-03-01") == 45 and born("2/28/1980", "2025-02-28") == 45


def test_trailing_stop_words(spark):
    assert one(spark, quasi.trim_capture(F.lit("glass blower and who."))) == "glass blower"
    assert one(spark, quasi.trim_capture(F.lit("and the"))) == ""


def test_sweep_masks_more_as_k_grows(spark):
    qi = "array<struct<qi_type:string,start_pos:int,end_pos:int,population_count:long>>"
    df = spark.createDataFrame([("abcdef", [("a", 0, 2, 165), ("b", 3, 5, None), ("c", 1, 4, 600)])], f"text string, qis {qi}")
    got = {r["k"]: (r["k_text"], r["k_masked"]) for r in sweep.sweep(df).collect()}
    assert got[100] == ("abcdef", 0) and got[500] == ("[REDACTED]cdef", 1) and got[1000] == ("a[REDACTED]ef", 1)
    counts = [got[k][1] for k in sorted(got)]
    assert counts == sorted(counts)


def test_scalar_features(spark):
    assert one(spark, X.word_count(F.lit(" a b c\n"))) == 3
    assert one(spark, X.sentence_count(F.lit("no end"))) == 1
    assert one(spark, X.coverage(F.lit("abcd"), F.lit("[X]d"))) == 0.75
    assert one(spark, X.risky_sets(F.array(*map(F.lit, ["DATE_TIME", "LOCATION", "ORGANIZATION", "PERSON"])))) == 5
    assert one(spark, X.median(F.array(F.lit(1.0), F.lit(4.0)))) == 2.5


def test_thresholds_at_the_edges(spark):
    df = spark.createDataFrame([(0.4, True), (0.4, False)], "s double, y boolean")
    assert evaluate.threshold_search(df, "s", "y").first()["t"] == pytest.approx(0.4)
    last = evaluate.threshold_metrics(df, "s", "y").orderBy(F.desc("i")).first()
    assert last["precision"] == 1.0 and last["recall"] == 0.0
    assert evaluate.correlations(df, ["s"], "y").first()["corr"] == 0


BLOCK = "# name: one\n# expected_critical: yes\nbody --- more\n# note\n---\n# foo: bar\ntext two\n---\n\n"


def test_block_parsers_differ(spark):
    df = spark.createDataFrame([("f", BLOCK)], "file string, value string")
    strict = blocks.parse_strict(df, "value", "file").orderBy("block").collect()
    assert [(r["name"], r["expected_critical"], r["text"]) for r in strict] == [("one", True, "body --- more\n# note"), ("text two", False, "text two")]
    loose = blocks.parse_loose(df).orderBy("block").collect()
    assert [(r["name"], r["expected_critical"], r["text"]) for r in loose] == [("one", False, "body"), ("Sample_2", False, "more"), ("Sample_3", False, "text two")]
    assert blocks.parse_loose(df, max_samples=1).count() == 1


def test_json_round_trip_and_fingerprint(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a\n---\nb", encoding="utf-8")
    assert blocks.parse_strict(blocks.read(spark, str(tmp_path / "in.txt")), "value", "file").count() == 2
    assert blocks.fingerprint(spark, str(tmp_path / "in.txt")).first()["md5"] == hashlib.md5(b"a\n---\nb").hexdigest()
    results.write_json(spark.createDataFrame([(1, "x")], "id long, name string"), str(tmp_path / "out"))
    assert results.read_json(spark, str(tmp_path / "out"), "id long, name string").first()["name"] == "x"


def test_upsert_and_cache(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old")], "sample_hash string, processed_at int, v string")
    new = spark.createDataFrame([("b", 2, "new"), ("c", 1, "new")], old.schema)
    got = {r["sample_hash"]: r["v"] for r in results.upsert(old, new).collect()}
    assert got == {"a": "old", "b": "new", "c": "new"}
    cache = spark.sql("SELECT * FROM VALUES ('k', timestamp'2024-01-01', 'p'), ('n', timestamp'2024-01-02', NULL), ('x', timestamp'2020-01-01', 'p') AS t(cache_key, ts, payload)")
    keys = spark.createDataFrame([("k",), ("n",), ("x",)], "cache_key string")
    hits = {r["cache_key"]: (r["payload"], r["hit"]) for r in results.cached(keys, cache, F.lit("2024-01-02").cast("timestamp"), "cache_key").collect()}
    assert hits == {"k": (None, False), "n": (None, True), "x": (None, False)}


def test_stream_resumes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        resume.run_available(resume.read_files(spark, str(tmp_path / "in"), df.schema), lambda x: x, str(tmp_path / "out"), str(tmp_path / "cp"), "id")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    df.where("id = 1").selectExpr("3L AS id", "v").write.mode("append").parquet(str(tmp_path / "in"))
    resume.run_available(resume.read_files(spark, str(tmp_path / "in"), df.schema), lambda x: x, str(tmp_path / "out"), str(tmp_path / "cp"), "id")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_pattern_spans_are_of_the_whole_match(spark):
    text = "He is 034 years old, works as a glass blower, DOB: 3/7/1985, zip 10003, OH 10007"
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    got = quasi.extract(df).select(F.explode("qis").alias("q")).select("q.*").collect()
    found = {(q["qi_type"], q["normalized_value"]): q for q in got}
    age = found[("age", "34")]
    assert (age["raw_value"], age["start_pos"], age["end_pos"], age["method"]) == ("034 years old", 6, 19, "ner")
    job = found[("occupation", "glass blower")]
    assert (job["raw_value"], job["start_pos"], job["end_pos"]) == ("works as a glass blower", 21, 44)
    born = found[("date_of_birth", "3/7/1985")]
    assert (born["raw_value"], text[born["start_pos"] : born["end_pos"]]) == ("DOB: 3/7/1985", "DOB: 3/7/1985")
    near, after = found[("zip_code", "10003")], found[("zip_code", "10007")]
    assert near["raw_value"] == "10003" and text[near["start_pos"] : near["end_pos"]] == "10003"
    assert after["raw_value"] == "OH 10007" and text[after["start_pos"] : after["end_pos"]] == "10007"
    assert len(got) == len(found)


def test_births_count_in_the_expected_k(spark):
    """40 years at the day: one in 365.25 of the age's people, by hand."""
    table = literal.table(spark, [("age", "40", 0.02, 4_000_000, "bands"), ("gender", "male", 0.5, 160_000_000, "sexes")], population.SCHEMA)
    qi = "array<struct<qi_type:string,raw_value:string,normalized_value:string,confidence:double,start_pos:int,end_pos:int,method:string>>"
    rows = [(1, "DOB 3/7/1985 male", [("date_of_birth", "DOB 3/7/1985", "3/7/1985", 0.95, 0, 12, "pattern"), ("gender", "male", "male", 0.95, 13, 17, "ner")]), (2, "male", [("gender", "male", "male", 0.95, 0, 4, "ner")]), (3, "", [])]
    df = spark.createDataFrame(rows, f"id long, text string, qis {qi}")
    got = {r["id"]: r for r in anonymity.score(anonymity.with_frequencies(df, table, "id", today=F.lit("2026-01-01").cast("date")), people=1_000_000.0).collect()}
    assert got[1]["expected_k"] == pytest.approx(1_000_000 * 0.02 / 365.25 * 0.5)
    assert got[1]["qis"][0]["population_count"] == 10951 and got[1]["qis"][0]["source"] == "bands, by day of birth"
    assert got[2]["expected_k"] == 500_000 and got[3]["expected_k"] == 1_000_000


def test_replies_that_break_a_row(spark):
    text = "a nurse in Texas"
    good = '{"type":"occupation","raw_value":"NURSE","confidence":"0.7"}'
    replies = {"good": f"[{good}]", "not an object": f'[{good},"x"]', "odd confidence": f'[{good},{{"type":"location","raw_value":"Texas","confidence":null}}]', "odd value": f'[{good},{{"type":"location","raw_value":"Texas","normalized_value":7}}]', "unknown type": f'[{good},{{"type":"planet","raw_value":7,"confidence":[]}}]', "absent value": f'[{good},{{"type":"location","raw_value":"Mars","normalized_value":7}}]'}
    df = spark.createDataFrame([(k, text, f'{{"quasi_identifiers":{v}}}') for k, v in replies.items()], "k string, text string, reply string")
    got = {r["k"]: r["q"] for r in df.select("k", quasi.validate(F.col("text"), quasi.parse_reply(F.col("reply"))).alias("q")).collect()}
    assert {k for k, v in got.items() if v} == {"good", "unknown type", "absent value"}
    q = got["good"][0]
    assert (q["raw_value"], q["normalized_value"], q["confidence"], q["start_pos"], q["end_pos"]) == ("NURSE", "nurse", 0.7, 2, 7)


@pytest.mark.parametrize(("value", "want"), [('{"score":{"value":["low",{"x":{"prob":0.8}}]}}', 0.8), ("-0.5", -0.5), ("[-0.5]", 0.0), ('{"a":{"b":{"c":0.3}}}', 0.3), ('{"confidence":[[],{}]}', 0.0)])
def test_nested_confidence(spark, value, want):
    assert one(spark, contextual.confidence(F.try_parse_json(F.lit(value)))) == pytest.approx(want)


def test_reasons(spark):
    df = spark.createDataFrame([(0.015, 0.0, 0.0, []), (0.0, 0.0, 0.45, ["A", "B"])], "e_score double, q_score double, c_score double, factors array<string>")
    got = [r["reasons"] for r in policy.decide(df).orderBy("c_score").collect()]
    assert got[0] == ["No significant sensitivity indicators detected", "Scores: E=0.01, Q=0.00, C=0.00"]  # rounded as the binary number
    assert got[1] == ["High contextual sensitivity: C-Score 0.45", "Factors: A, B"]


def test_runs_are_kept_apart(spark, tmp_path):
    path, df = str(tmp_path / "runs"), spark.createDataFrame([("a", 0.5)], "sample_hash string, e_score double")
    results.save_run(df, path, "0123", 0.3)
    results.save_run(df, path, "0124", 0.3)
    assert results.load_run(spark, path, "0123", 0.3).count() == 1
    assert results.load_run(spark, path, "0123", 0.4).count() == 0
    assert results.load_run(spark, path, "0123", 0.3, "1.0").count() == 0
    results.clear_run(spark, path, "0123", 0.3, "20260101_000000")
    assert results.load_run(spark, path, "0123", 0.3).count() == 0 and results.load_run(spark, path, "0124", 0.3).count() == 1
    assert results.load_run(spark, f"{path}.20260101_000000.backup", "0123", 0.3).count() == 1


def test_suite_sink(spark, tmp_path):
    reply = '{"factors":[{"name":"NARRATIVE_UNIQUENESS","detected":true,"confidence":0.8}]}'
    df = contextual.judge(spark.createDataFrame([("one", "t", reply), ("two", "u", None)], "name string, text string, reply string"))
    results.write_suite(df, str(tmp_path / "out"))
    got = {r["name"]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got["one"]["overall_risk"] == "LOW" and len(got["one"]["detections"]) == 7 and got["one"]["error"] is None
    assert got["two"]["error"] == "no reply" and got["two"]["detections"] == [] and got["two"]["risk_score"] is None


def test_pluggable_recognizer(spark):
    """A pandas UDF in place of the dictionaries."""
    import pandas as pd

    @F.pandas_udf(quasi.NONE)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"qi_type": "location", "raw_value": t[:2], "normalized_value": "here", "confidence": 0.7, "start_pos": 0, "end_pos": 2, "method": "ner"}] if t else [])

    df = spark.createDataFrame([("xy nurse",), ("",)], "text string")
    got = quasi.extract(df, recognizer=found).select(F.transform("qis", lambda q: q["normalized_value"])).collect()
    assert [sorted(r[0]) for r in got] == [["here", "nurse"], []]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, text string")
    table = literal.table(spark, [("age", "40", 0.02, 4_000_000, "bands")], population.SCHEMA)
    reply = lambda t: F.lit('{"factors":[]}')
    rows = assess.assess(df, table, reply, "id")
    assert policy.decide(rows).count() == 0
    assert evaluate.correlations(rows, features.CORRELATED, "deemed_sensitive").count() == 34


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(shared, "_own", {})

    class Cluster:
        applicationId, master = "x", "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()

        class conf:
            get = staticmethod(lambda key, other: other)

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_containing_equals_nested_loops(spark):
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abAB é%_") for _ in range(n))
    names = [word(rng.randrange(1, 6)) for _ in range(300)] + ["", None, "zzz", "É"]
    texts = [word(rng.randrange(0, 25)) for _ in range(400)] + [None, "", "É"]
    a = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "i int, name string")
    b = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "j int, body string")
    got = sorted((r["i"], r["j"]) for r in population.containing(a, b, "name", "body").collect())
    assert got == sorted((i, j) for i, n in enumerate(names) for j, t in enumerate(texts) if n and t is not None and n.lower() in t.lower())
    assert population.containing(a.where("false"), b, "name", "body").count() == 0


def test_summary_text(spark):
    reply = '{"factors":[{"name":"SOCIAL_STIGMA_RISK","detected":true,"confidence":0.8,"explanation":"told"}],"summary":"Short."}'
    j = contextual.judge(spark.createDataFrame([(reply,), (None,)], "reply string"))
    texts = j.select(contextual.summary_text(F.col("c_level"), F.col("c_score"), F.col("factors"), contextual.summary_of(F.col("reply"))).alias("t")).collect()
    lines = texts[0]["t"].split("\n")
    assert lines[:8] == ["=" * 70, "NARRATIVE SENSITIVITY ANALYSIS", "=" * 70, "Overall Risk: LOW", "Risk Score: 0.11", "", "Factors Detected:", "-" * 40]
    at = lines.index("  SOCIAL_STIGMA_RISK:")
    assert lines[at + 1 : at + 3] == ["    Status: ✓ YES (confidence: 0.80)", "    Reason: told"]
    assert lines[-5:] == ["", "-" * 40, "Summary:", "Short.", "=" * 70] and len(lines) == 13 + 14 + 1
    assert "Overall Risk: ERROR" in texts[1]["t"]
