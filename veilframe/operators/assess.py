"""The whole assessment of texts: explicit identifiers, quasi-identifiers, contextual factors, the
feature row and the sweep over k, with the columns that policy and evaluation read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.constants import K_DEFAULT, K_GRID, SENSITIVE_AT
from ..functions.recognizers import STRUCTURED
from ..sources import blocks, commits, results
from ..sources.shared import shuffled, stored
from . import anonymity, contextual, explicit, features, quasi, sweep
from .population import fits

#: Columns of the judged texts.
JUDGED = ("c_score", "c_level", "detected", "c_status")


def judged(texts: DataFrame, reply: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """Adds the contextual score of `text`; each distinct text is asked about once."""

    def work(distinct: DataFrame) -> DataFrame:
        return contextual.judge(distinct.withColumn("_reply", reply(F.col(text))), "_reply")

    return contextual.memoised(texts, text, work, *JUDGED)


def assess(
    samples: DataFrame,
    population: DataFrame,
    reply: Callable[[Column], Column],
    id: str = "sample_hash",
    text: str = "text",
    recognizers=STRUCTURED,
    extract: Callable[[DataFrame, str], DataFrame] | None = None,
    today: Column | None = None,
    k: int = K_DEFAULT,
    grid: tuple[int, ...] = K_GRID,
    sensitive_at: float = SENSITIVE_AT,
    more: Callable[[DataFrame], DataFrame] | None = None,
    compared: bool = True,
    wanted: Sequence[str] | None = None,
) -> DataFrame:
    """The wide row of each sample, told apart by `id`.

    Quasi-identifiers are looked for in the text whose explicit entities are masked, and the
    contextual score is of the text with both masked; that of the first mask alone and those of the
    masks for each k of the grid stand beside it. `reply` gives a model's reply to a text, as an
    expression or a pandas UDF, and sees each distinct text once; `extract` (df, text column) adds
    the array `qis` (patterns, if not given); `more` adds features of one's own, columns of a row that
    has all but the contextual ones. The rows before the contextual score are written to the
    shared folder, as they are read for the distinct texts and for the result.

    A caller that reads no score of the other masks (c_original, original_sensitive, c_scores_by_k,
    masked_counts_by_k) sets `compared` to false: the row is then without these columns, as no optimizer
    sees that the texts behind them need no reply. Likewise one that reads some columns only names them
    (`wanted`): the row has `id` and these, and no others are made and written.

    A population that `population.fits` goes to every task whole, and rows stay where they are; a larger one is
    joined."""
    find = extract or (lambda df, of: quasi.extract(df, of))
    rows = explicit.score_explicit(samples, text, recognizers=recognizers)
    rows = anonymity.score(anonymity.with_frequencies(find(rows, "e_masked"), population, id, today=today, in_place=fits(population)), "e_masked", k=k)
    rows = rows.withColumns({"q_score": F.round("q_score", 4), "expected_k": F.round("expected_k", 4)})  # as reported
    if compared:
        rows = rows.withColumn("_swept", F.transform(folds.constants(grid), lambda at: F.struct(at.alias("k"), sweep.mask_for_k(F.col("e_masked"), F.col("qis"), at).alias("m"))))
    rows = features.all_features(rows, text)
    rows = more(rows) if more else rows
    rows = rows.withColumns({"rare_disease": anonymity.rare(F.col("qis"), "disease"), "rare_occupation": anonymity.rare(F.col("qis"), "occupation"), "has_direct": F.col("has_direct_identifier"), "has_combo": F.col("has_high_risk_combo")})
    if wanted is not None:
        read = {id, "q_masked", *wanted, *(("e_masked", "_swept") if compared else ())}
        rows = rows.select(*(c for c in rows.columns if c in read))
    rows = stored(rows, "assessed")
    whole = _compared(rows, reply, id, sensitive_at) if compared else judged(rows, reply, "q_masked")
    whole = whole.withColumns({"factors": F.col("detected"), "deemed_sensitive": F.col("c_score") >= sensitive_at})
    return whole if wanted is None else whole.select(id, *(c for c in dict.fromkeys(wanted) if c != id))


def _compared(rows: DataFrame, reply: Callable[[Column], Column], id: str, sensitive_at: float) -> DataFrame:
    """The rows with the contextual scores of all their masked texts."""
    roles = [F.struct(F.lit("q").alias("role"), F.col("q_masked").alias("text")), F.struct(F.lit("e").alias("role"), F.col("e_masked").alias("text"))]
    by_k = F.transform("_swept", lambda s: F.struct(s["k"].cast("string").alias("role"), s["m"]["text"].alias("text")))
    # most masks of a row are alike: each of its texts leaves it once, with the roles that it plays
    played = F.concat(F.array(*roles), by_k)
    apart = F.transform(F.array_distinct(F.transform(played, lambda t: t["text"])), lambda x: F.struct(x.alias("text"), F.transform(F.filter(played, lambda t: t["text"].eqNullSafe(x)), lambda t: t["role"]).alias("roles")))
    scored = judged(rows.select(id, F.explode_outer(apart).alias("_t")).select(id, "_t.*"), reply)
    scored = scored.withColumn("_by_k", F.transform(F.filter("roles", lambda r: ~r.isin("q", "e")), lambda r: F.struct(r.alias("role"), F.col("c_score").alias("c_score"))))
    of = lambda role, c: F.max(F.when(F.array_contains("roles", role), F.col(c)))
    scores = scored.groupBy(id).agg(*(of("q", c).alias(c) for c in JUDGED), of("e", "c_score").alias("c_original"), F.map_from_entries(F.array_sort(F.flatten(F.collect_list("_by_k")))).alias("c_scores_by_k"))
    counts = F.map_from_entries(F.transform("_swept", lambda s: F.struct(s["k"].cast("string"), s["m"]["n"])))
    return rows.join(shuffled(scores), id).withColumns({"original_sensitive": F.col("c_original") >= sensitive_at, "masked_counts_by_k": counts}).drop("_swept")


def run(spark: SparkSession, inputs: str, path: str, population: DataFrame, reply: Callable[[Column], Column], max_samples: int | None = None, sensitive_at: float = SENSITIVE_AT, **how) -> DataFrame:
    """Assesses the samples of block files that this run hasn't assessed yet, and gives the result rows
    of all its samples, one for each hash.

    A run is told by the bytes of its inputs, the threshold and the version: each has a table of commits
    below `path`, so a run that was cut off or limited (`max_samples` of each file) goes on, and one with
    other inputs or another threshold begins anew. `how` goes to `assess`."""
    table = f"{path}/version={results.VERSION}/inputs={blocks.input_hash(spark, inputs)}/at={float(sensitive_at)}"
    read = lambda: commits.read(spark, table, "sample_hash", "processed_at")
    told = blocks.hashed(blocks.parse_loose(blocks.read(spark, inputs), max_samples=max_samples))
    first = F.min_by(F.struct("name", "text", "expected_critical"), F.struct("file", "block"))
    samples = told.groupBy("sample_hash").agg(first.alias("s")).select("sample_hash", "s.*")
    done = read()
    new = samples if done is None else results.todo(samples, done)
    if done is None or not new.isEmpty():
        rows = results.result_rows(assess(new, population, reply, "sample_hash", sensitive_at=sensitive_at, **how))
        commits.commit(rows, table, commits.manifest(spark, table).last.get("", -1) + 1)
    return results.reused(samples, read())
