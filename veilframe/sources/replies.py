"""Recorded pages of public services, as they came, read through VARIANT.

A page is a row (source, key, page): the service, what was asked, and its reply in JSON. Replies come in
several shapes; what has none of them, or isn't JSON, gives no rows. All of it is narrow: no page moves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Pages that were stored a file each; the key is the file's name, decoded,
    without what follows the last dot. (Spark gives file names encoded once more.)"""
    files = spark.read.format("text").option("wholetext", True).load(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return files.select(F.lit(source).alias("source"), F.url_decode(F.url_decode(name)).alias("key"), F.col("value").alias("page"))


def of(pages: DataFrame, source: str) -> DataFrame:
    """(key, v) of a service's pages that are JSON."""
    return pages.where(F.col("source") == source).select("key", F.try_parse_json("page").alias("v")).where("v is not null")


def get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", kind)


def shape(v: Column) -> Column:
    """The outer type, such as OBJECT or ARRAY, of a variant."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit(""))


def first_of(v: Column, *paths: str) -> Column:
    """The first of the fields that is there."""
    return F.coalesce(*(get(v, p) for p in paths))


def items(v: Column) -> Column:
    return F.coalesce(get(v, "", "array<variant>"), F.array().cast("array<variant>"))


def let(v: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(v), then), F.lit(0))


def results(v: Column) -> Column:
    """What stands under data and results, or under either, or the reply itself."""
    under = lambda name: lambda x: F.when(shape(x) == "OBJECT", F.coalesce(get(x, name), x)).otherwise(x)
    return let(let(v, under("data")), under("results"))


def entry(v: Column) -> Column:
    """The first of the results, or the one result."""
    return let(results(v), lambda x: F.when(shape(x) == "ARRAY", F.get(items(x), F.lit(0))).when(shape(x) == "OBJECT", x))


def census(pages: DataFrame, source: str = "census") -> DataFrame:
    """(key, row) of tables whose first row has the names: each other row as a map of its strings."""
    rows = of(pages, source).select("key", get(F.col("v"), "", "array<array<string>>").alias("rows")).where("size(rows) > 1")
    body = F.explode(F.slice("rows", 2, F.size("rows") - 1))
    return rows.select("key", F.element_at("rows", 1).alias("names"), body.alias("cells")).where("size(names) = size(cells)").select("key", F.map_from_arrays("names", "cells").alias("row"))


def survey(pages: DataFrame, source: str = "survey") -> DataFrame:
    """(topic, kind, place, year, figure) of lists of indicators; an empty figure is none."""
    rows = of(pages, source).select(F.explode(items(F.col("v"))).alias("i"))
    text = lambda name: get(F.col("i"), name, "string")
    return rows.select(text("topic").alias("topic"), text("datavaluetype").alias("kind"), text("locationabbr").alias("place"), text("yearend").try_cast("int").alias("year"), text("datavalue").try_cast("double").alias("figure"))


def occupation_codes(pages: DataFrame, source: str = "occupations") -> DataFrame:
    """(value, soc): the code of the first occupation that the service gives for a name."""
    code = get(F.col("v"), "Occupation[0].Code", "string")
    return of(pages, source).select(F.lower(F.trim("key")).alias("value"), code.alias("soc")).where("soc <> ''")


def employment(pages: DataFrame, source: str = "employment") -> DataFrame:
    """(soc, people) by series: six digits of the code stand at a fixed place of its name."""
    rows = of(pages, source).where(get(F.col("v"), "status", "string") == "REQUEST_SUCCEEDED")
    series = rows.select(F.explode(items(get(F.col("v"), "Results.series"))).alias("s"))
    digits = F.substring(get(F.col("s"), "seriesID", "string"), 18, 6)
    people = F.replace(get(F.col("s"), "data[0].value", "string"), F.lit(","), F.lit(""))
    told = series.select(F.concat(F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 4)).alias("soc"), people.try_cast("long").alias("people"))
    return told.where("people is not null")


def rare_codes(pages: DataFrame, source: str = "rare-names") -> DataFrame:
    """(value, code) of disease names: the code of the first result, or of the disorder that it is
    associated with."""
    known = lambda c: let(c, lambda x: F.when(~x.isin("", "0", "false"), x))  # noqa: E731  of what Python takes for true
    code = lambda x: known(first_of(x, "ORPHAcode", "orphacode").try_cast("string"))
    found = let(entry(F.col("v")), lambda e: F.coalesce(code(e), let(get(e, "DisorderDisorderAssociation[0].TargetDisorder"), code)))
    return of(pages, source).select(F.col("key").alias("value"), found.alias("code")).where("code is not null")


def epidemiology(pages: DataFrame, source: str = "rare-figures") -> DataFrame:
    """(code, items) with the (type, class) of each prevalence, in order; nulls for what is no object."""
    found = let(entry(F.col("v")), lambda e: first_of(e, "Prevalence", "Prevalences", "prevalence", "prevalences"))
    listed = let(F.col("p"), lambda p: F.when(shape(p) == "ARRAY", items(p)).otherwise(F.array(p)))
    text = lambda i, *names: F.coalesce(*(get(i, n, "string") for n in names))
    told = of(pages, source).select(F.col("key").alias("code"), found.alias("p")).where("p is not null")
    both = lambda i: F.struct(F.coalesce(text(i, "PrevalenceType", "prevalenceType"), F.lit("")).alias("type"), text(i, "PrevalenceClass", "prevalenceClass").alias("class"))
    return told.select("code", F.transform(listed, both).alias("items"))
