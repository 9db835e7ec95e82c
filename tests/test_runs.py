"""Runs over block files: limits, resuming, other thresholds and inputs; hooks for features and population."""

from pyspark.sql import functions as F

from veilframe.functions import folds
from veilframe.operators import assess, population
from veilframe.sources import blocks, results

KNOWN = {"MAIL": (r"[a-z]+@[a-z]+\.org", 1.0, "@", False)}
BLOCKS = "# name: one\n# expected_critical: true\nWrite to ann@mail.org, a 44 year old nurse.\n---\nA plain text.\n---\n \n---\n# name: one\n# expected_critical: true\nWrite to ann@mail.org, a 44 year old nurse."


def reply(text):
    told = F.contains(text, F.lit("nurse")).cast("string")
    return F.concat(F.lit('{"factors":[{"name":"SOCIAL_STIGMA_RISK","confidence":0.5,"detected":'), told, F.lit("}]}"))


def people(spark):
    return spark.createDataFrame([("age", "44", 0.01, 3_319_000, "t"), ("occupation", "nurse", 0.001, 331_900, "t")], population.SCHEMA)


def test_a_run_goes_on(spark, tmp_path):
    inputs, path, out = (str(tmp_path / x) for x in ("inputs", "runs", "json"))
    (tmp_path / "inputs").mkdir()
    (tmp_path / "inputs" / "a.txt").write_text(BLOCKS)
    run = lambda **how: assess.run(spark, inputs, path, people(spark), reply, recognizers=KNOWN, **how)
    first = run(max_samples=1).collect()
    assert [(r["sample_name"], r["expected_critical"], r["e_score_entity_types"], r["e_score_masked_text"]) for r in first] == [("one", True, ["MAIL"], "Write to [MAIL], a 44 year old nurse.")]
    assert set(first[0]["q_score_qi_types"]) == {"age", "occupation"} and first[0]["c_score_original_risk_score"] > 0
    assert first[0].asDict().keys() == set(c.split(" ")[0] for c in results.RESULT_SCHEMA.split(", "))
    rows = run()
    whole = {r["sample_name"]: r for r in rows.collect()}
    assert sorted(whole) == ["Sample_2", "one"]  # the third block is a copy of the first
    assert whole["one"]["processed_at"] == first[0]["processed_at"]  # not assessed again
    assert {r["sample_name"]: r["processed_at"] for r in run().collect()} == {k: r["processed_at"] for k, r in whole.items()}
    results.write_json(rows, out)
    again = results.read_json(spark, out, results.RESULT_SCHEMA, lines=True)
    assert {r["sample_name"]: r.asDict(True) for r in again.collect()} == {k: r.asDict(True) for k, r in whole.items()}
    # another threshold is another run, and so is another input
    other = {r["sample_name"]: r["processed_at"] for r in run(sensitive_at=0.9).collect()}
    assert sorted(other) == sorted(whole) and other["one"] != whole["one"]["processed_at"]
    before = blocks.input_hash(spark, inputs)
    (tmp_path / "inputs" / "a.txt").write_text("---\n---\n")
    assert blocks.input_hash(spark, inputs) != before
    assert run().collect() == []


def test_features_of_ones_own(spark):
    df = spark.createDataFrame([(1, "Write to ann@mail.org!")], "id int, text string")
    rows = assess.assess(df, people(spark), reply, "id", recognizers=KNOWN, more=lambda d: d.withColumn("loud", F.contains("e_masked", F.lit("!"))))
    assert [(r["loud"], r["has_direct_identifier"]) for r in rows.collect()] == [(True, False)]


def test_sources_of_population(spark):
    frame = lambda *rows: spark.createDataFrame(rows, population.SCHEMA)
    ours = frame(("age", "44", 0.5, 7, "ours"), ("age", "45", None, None, "ours"), ("age", "46", 0.1, 1, "ours"), ("age", "46", 0.2, 2, "ours"))
    theirs = frame(("age", "44", 0.9, 9, "theirs"), ("age", "45", 0.3, 3, "theirs"), ("zip_code", "44", 0.4, 4, "theirs"))
    got = sorted(tuple(r) for r in population.first_known(ours, theirs).collect())
    assert got == [("age", "44", 0.5, 7, "ours"), ("age", "45", 0.3, 3, "theirs"), ("age", "46", 0.2, 2, "ours"), ("zip_code", "44", 0.4, 4, "theirs")]
    assert population.first_known(ours.where("false")).count() == 0


def test_folds_take_any_text(spark):
    odd = ["it's", "a\\b", 'say "x"', "{0}", None]
    assert spark.range(1).select(folds.constants(odd)).first()[0] == odd
    total = folds.fold(folds.constants([1, 2, 3]), "0", "(a, x) -> a + x", "a -> a * 2")
    kept = folds.keep(folds.each(folds.constants([1, 2]), "x -> x + 1"), "x -> x > 2")
    assert tuple(spark.range(1).select(total, kept).first()) == (12, [3])
