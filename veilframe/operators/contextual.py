"""Contextual sensitivity: factors from recorded model replies, weighted to a score and a level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.constants import CONFIDENCE_KEYS, CONFIDENCE_WORDS, FACTOR_WEIGHTS, OTHER_FACTOR
from ..sources.shared import shuffled
from .quasi import braces

FACTOR = "struct<name:string,detected:boolean,confidence:double,explanation:string>"


def prompt(text: Column) -> Column:
    head = "Rate each factor as JSON {\"factors\":[{\"name\",\"detected\",\"confidence\",\"explanation\"}],\"summary\"}; ignore [TOKENS]. Factors: "
    return F.concat(F.lit(head + ", ".join(FACTOR_WEIGHTS) + ".\nText:\n"), text)


def _word(value: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CONFIDENCE_WORDS.items() for x in pair])
    # the word first, as what is no number costs an exception; no word is a number
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(value))), value.try_cast("double"), F.lit(0.0))


def _scalar(v: Column, kind: Column) -> Column:
    """A variant that is a number, a boolean or a string."""
    return F.when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), 1.0).otherwise(0.0)).otherwise(_word(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("0"))))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _compound(kind: Column) -> Column:
    return F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))


def _inner(v: Column) -> Column:
    """An object with known keys is what its first known key holds."""
    held = (F.try_variant_get(v, f"$.{key}", "variant") for key in CONFIDENCE_KEYS)
    return F.when(F.startswith(_kind(v), F.lit("OBJECT")), F.coalesce(*held, v)).otherwise(v)


def _members(v: Column) -> Column:
    """What stands for a value at the next level: members of a list or of an object without known
    keys, what a known key holds, or the value itself."""

    def of(x: Column, kind: Column) -> Column:
        return (
            F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(x, "$", "array<variant>"))
            .when(F.startswith(kind, F.lit("OBJECT")), F.map_values(F.try_variant_get(x, "$", "map<string,variant>")))
            .otherwise(F.array(x))
        )

    return folds.bound(_inner(v), lambda x: folds.bound(_kind(x), lambda kind: of(x, kind)))


def confidence(v: Column, levels: int = 12) -> Column:
    """A number from a variant: numbers, booleans, numeric strings and words as they are; an object
    by the first of its known keys, or else by the largest positive value of its members; a list by
    its largest positive member; 0 otherwise. Nesting is followed for `levels` levels; deeper
    members count 0. What isn't nested is taken as it stands, with no level followed."""
    rest = F.sequence(F.lit(2), F.lit(levels)) if levels > 1 else F.array().cast("array<int>")  # after the first level
    number = lambda x, kind: F.when(kind.isin("VOID", "NULL"), 0.0).otherwise(_scalar(x, kind))
    deeper = lambda a, _: F.when(F.exists(a, lambda x: _compound(_kind(x))), F.flatten(F.transform(a, _members))).otherwise(a)

    def largest(x: Column) -> Column:
        more = lambda a: F.when(F.exists(a, lambda y: _compound(_kind(y))), F.aggregate(rest, a, deeper)).otherwise(a)
        flat = folds.bound(_members(x), more)
        whole = F.transform(flat, lambda y: folds.bound(_kind(y), lambda kind: F.when(_compound(kind), 0.0).otherwise(_scalar(y, kind))))
        return F.coalesce(F.array_max(F.filter(whole, lambda y: y > 0)), F.lit(0.0))

    def nested(x: Column) -> Column:
        again = lambda y: F.when(F.startswith(_kind(y), F.lit("OBJECT")), F.aggregate(rest, y, lambda a, _: _inner(a))).otherwise(y)
        alone = folds.bound(_inner(x), again)
        return folds.bound(alone, lambda y: folds.bound(_kind(y), lambda kind: F.when(_compound(kind), largest(y)).otherwise(number(y, kind))))

    return folds.bound(v, lambda x: folds.bound(_kind(x), lambda kind: F.when(_compound(kind), nested(x)).otherwise(number(x, kind))))


def truthy(v: Column) -> Column:
    """As a dynamic language takes it: any non-empty string is true, even "false"."""

    def of(v: Column, kind: Column) -> Column:
        return (
            F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
            .when(kind.isin("VOID", "NULL"), False)
            .when(kind.startswith("OBJECT"), F.size(F.try_variant_get(v, "$", "map<string,variant>")) > 0)
            .when(kind.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
            .otherwise(F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(False)))
        )

    return folds.bound(v, lambda x: folds.bound(_kind(x), lambda kind: of(x, kind)))


def factors(reply: Column) -> Column:
    """The reply's factors, completed to the known ones and sorted by name. Items that aren't objects
    are skipped; a reply that can't be parsed has none detected."""
    return _factors(F.try_parse_json(braces(reply)))


def _factors(parsed: Column) -> Column:
    items = F.coalesce(F.try_variant_get(parsed, "$.factors", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(items, lambda v: F.try_variant_get(v, "$", "struct<>").isNotNull())

    def made(v: Column) -> Column:
        return F.struct(
            F.coalesce(F.try_variant_get(v, "$.name", "string"), F.lit("UNKNOWN")).alias("name"),
            truthy(F.try_variant_get(v, "$.detected", "variant")).alias("detected"),
            confidence(F.try_variant_get(v, "$.confidence", "variant")).alias("confidence"),
            F.coalesce(F.try_variant_get(v, "$.explanation", "string"), F.lit("")).alias("explanation"),
        )

    known = F.array(*map(F.lit, FACTOR_WEIGHTS))
    none = lambda n: F.struct(n.alias("name"), F.lit(False).alias("detected"), F.lit(0.0).alias("confidence"), F.lit("").alias("explanation"))
    whole = folds.bound(F.transform(objects, made), lambda got: F.concat(got, F.transform(F.array_except(known, F.transform(got, lambda f: f["name"])), none)))
    keyed = F.transform(whole, lambda f, i: F.struct(f["name"].alias("n"), i.alias("i"), f.alias("f")))
    return F.transform(folds.ordered(keyed), lambda x: x["f"])


def score(found: Column) -> Column:
    """Sum of weight times confidence of the detected factors, at most 1; repeats count again."""
    table = F.create_map(*[F.lit(x) for pair in FACTOR_WEIGHTS.items() for x in pair])
    weight = lambda f: F.coalesce(F.try_element_at(table, f["name"]), F.lit(OTHER_FACTOR))
    return F.least(F.aggregate(found, F.lit(0.0), lambda a, f: a + F.when(f["detected"], weight(f) * f["confidence"]).otherwise(0.0)), F.lit(1.0))


def level(c: Column) -> Column:
    return F.when(c >= 0.6, "CRITICAL").when(c >= 0.4, "HIGH").when(c >= 0.2, "MEDIUM").otherwise("LOW")


def judge(df: DataFrame, reply: str = "reply", at: float = 0.3) -> DataFrame:
    """Adds factors, c_score, c_level, detected (names), deemed_sensitive and c_status. A row without
    a reply has level ERROR and score 0."""
    missing = F.col(reply).isNull()
    df = df.withColumn("_parsed", F.try_parse_json(braces(F.coalesce(F.col(reply), F.lit(""))))).withColumn("factors", _factors(F.col("_parsed")))
    df = df.withColumn("c_score", score(F.col("factors")))
    return df.withColumns(
        {
            "c_level": F.when(missing, "ERROR").otherwise(level(F.col("c_score"))),
            "detected": F.transform(F.filter("factors", lambda f: f["detected"]), lambda f: f["name"]),
            "deemed_sensitive": F.col("c_score") >= at,
            "c_status": F.when(missing, "no reply").when(F.col("_parsed").isNull(), "unparsed").otherwise("ok"),
        }
    ).drop("_parsed")


def summary_text(level: Column, score: Column, found: Column, summary: Column) -> Column:
    """A judgement as text: level, score, each factor's status, with a reason if it was detected, and
    the summary. Numbers have two digits, halves go up."""
    two = lambda c: F.format_string("%.2f", c)
    wide, thin = F.lit("=" * 70), F.lit("-" * 40)

    def lines(f: Column) -> Column:
        status = F.when(f["detected"], "✓ YES").otherwise("✗ NO")
        told = F.concat(F.lit("  "), f["name"], F.lit(":\n    Status: "), status, F.lit(" (confidence: "), two(f["confidence"]), F.lit(")"))
        return F.when(f["detected"], F.concat(told, F.lit("\n    Reason: "), f["explanation"])).otherwise(told)

    head = [wide, F.lit("NARRATIVE SENSITIVITY ANALYSIS"), wide, F.concat(F.lit("Overall Risk: "), level), F.concat(F.lit("Risk Score: "), two(score)), F.lit(""), F.lit("Factors Detected:"), thin]
    return F.concat_ws("\n", *head, F.transform(found, lines), F.lit(""), thin, F.lit("Summary:"), F.coalesce(summary, F.lit("")), wide)


def summary_of(reply: Column) -> Column:
    """The reply's own summary; empty without one."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(braces(reply)), "$.summary", "string"), F.lit(""))


def memoised(df: DataFrame, text: str, work, *results: str) -> DataFrame:
    """Runs `work` (a DataFrame of the distinct trimmed texts in, the same with more columns out)
    once for each distinct text and joins its results back. Texts move as 128-bit keys."""
    keyed = df.withColumn("_key", F.md5(F.trim(text)))
    distinct = keyed.groupBy("_key").agg(F.min(F.trim(text)).alias(text))
    done = work(distinct).select("_key", *results)
    return keyed.join(shuffled(done), "_key", "left").drop("_key")
