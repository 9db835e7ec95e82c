"""Quality by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Each rule votes 1 (good), 0 (bad) or null (abstains) on a document. Votes are summed to counts of
vote patterns, at most 3 ** rules of them, and expectation-maximisation over these counts finds
the share of good documents and each rule's accuracy. The posterior of a pattern is then the
quality probability of its documents. All of it is Spark expressions and one small aggregation.

A text without words (null, empty, white space) has zero counts and fails the base rule. Repeated
rows count again in the fit and get the same verdict.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import literal
from .scratch import stored

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
SYMBOL_WORD = "[#*$%&|<>][^\\x20\\x09-\\x0D]*+"
ENDED = "[.!?:;\u2026][\"')\u00bb\u201d]?[\\x20\\x09\\x0B-\\x0D]*+(?:\n|\\z)"
ROUNDS = 50
KEEP = 0.5


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_symbol_words (words
    with a symbol) and n_ended_lines (lines with punctuation at the end).

    n_repeat_words counts words in 3-word windows that stand twice or more: where some window does,
    windows are sorted by hash with their places, neighbours of equal hash are repeats, and the
    places that these cover are counted."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, BLANKS), "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    counted = docs.withColumns({"_words": words, "_lines": lines})
    n = F.size("_words")
    counted = counted.withColumn(
        "_hashes",
        F.when(n >= 4, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))),
    )
    ordered = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    counted = counted.withColumn("_ordered", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), ordered))
    at = lambda i: F.get("_ordered", i)["h"]
    twice = F.filter("_ordered", lambda s, i: s["h"].eqNullSafe(at(i + 1)) | s["h"].eqNullSafe(at(i - 1)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))))
    return counted.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(covered.isNull(), 0).otherwise(F.size(covered)).cast("long"),
            "n_symbol_words": F.regexp_count(body, F.lit(SYMBOL_WORD)).cast("long"),
            "n_ended_lines": F.regexp_count(body, F.lit(ENDED)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
        }
    ).drop("_words", "_lines", "_hashes", "_ordered")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """The rules: 1 good, 0 bad, null abstains."""
    words, mean = F.col("n_words"), F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    symbols = F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1))
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    repeats = F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1))
    marked = F.col("n_symbol_words") / F.greatest(F.col("n_words"), F.lit(1))
    chars = F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))
    ended = F.col("n_ended_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    vote = lambda good, bad: F.when(bad, 0).when(good, 1)
    return {
        "v_length": vote(words >= 50, words < 20),
        "v_mean_word": vote(mean.between(3, 8), ~mean.between(2, 12)),
        "v_symbols": vote(symbols < 0.02, symbols > 0.1),
        "v_dup_lines": vote(lines < 0.1, lines > 0.3),
        "v_repeats": vote(repeats < 0.1, repeats > 0.3),
        "v_symbol_words": vote(marked < 0.02, marked > 0.2),
        "v_symbol_chars": vote(chars < 0.005, chars > 0.03),
        "v_ended_lines": vote(ended >= 0.5, ended < 0.1),
    }


def fit(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int | None, ...], float]:
    """Posterior of `good` for each vote pattern, by EM over the counts of patterns.

    Each rule has one accuracy for good and one for bad documents, given that it votes. It starts
    at 0.8 and keeps within [0.55, 0.99], which holds the meaning of the classes fixed. Sums are
    smoothed by one document, so a rule that never votes stays at its start.
    """
    rules = len(patterns[0][0]) if patterns else 0
    share, right = 0.8, [[0.8, 0.8] for _ in range(rules)]

    def posterior(pattern: tuple[int | None, ...]) -> float:
        odds = math.log(share / (1 - share))
        for k, v in enumerate(pattern):
            if v is not None:
                bad, good = right[k]
                odds += math.log(good / (1 - bad)) if v else math.log((1 - good) / bad)
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        post = [posterior(p) for p, _ in patterns]
        total = sum(n for _, n in patterns)
        share = min(0.99, max(0.01, (sum(q * n for q, (_, n) in zip(post, patterns, strict=True)) + 0.8) / (total + 1)))
        for k in range(rules):
            for side in (0, 1):
                weight = [(q if side else 1 - q) * n * (p[k] is not None) for q, (p, n) in zip(post, patterns, strict=True)]
                hits = sum(w for w, (p, _) in zip(weight, patterns, strict=True) if p[k] == side)
                right[k][side] = min(0.99, max(0.55, (hits + 0.8) / (sum(weight) + 1)))
    return {p: posterior(p) for p, _ in patterns}


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` without the text, with the features, the votes, `quality` (posterior) and
    `kept`."""
    rules = votes()
    scored = stored(features(docs, text).drop(text).withColumns(rules).withColumn("base_failed", base_failed()), "quality")
    code = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    scored = scored.withColumn("_pattern", F.concat(*map(code, rules)))
    counts = scored.groupBy("_pattern").count().orderBy("_pattern").collect()
    post = fit([(tuple(None if v == "-" else int(v) for v in r["_pattern"]), r["count"]) for r in counts])
    told = [("".join("-" if v is None else str(v) for v in p), q) for p, q in post.items()] or [("", 0.0)]
    table = F.broadcast(literal.table(docs.sparkSession, told, "_pattern string, quality double"))  # at most 3 ** rules
    return scored.join(table, "_pattern", "left").withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP)).drop("_pattern")


def digest(docs: DataFrame) -> DataFrame:
    judged = judge(docs.select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
