"""How frequent a quasi-identifier is: lookups in snapshots of public statistics.

Each source is a small table with a size bound of its own (states, ages, ZIP areas, diseases,
occupations), so joins to it are broadcast by the planner where it fits and shuffled where not.
All give (qi_type, value, probability, population_count, source).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.constants import AGE_BANDS, DOB_FORMATS, EMPLOYED, NATION, PREVALENCE, STATE_ROWS
from ..sources import literal
from ..sources.shared import shuffled, stored

MAPPED = 1000  # rows of a table that stands in a row as a map; its values are looked through one by one

SCHEMA = "qi_type string, value string, probability double, population_count long, source string"


def ages(bands: DataFrame, total: float) -> DataFrame:
    """Single years of age from bands (lo, hi, people), one row a band and sex, each year an equal
    share of its band: the bands are expanded to years, so that looking up an age is an equi-join."""
    years = bands.select(F.explode(F.sequence("lo", "hi")).alias("age"), "lo", "hi", "people")
    single = F.sum("people") / F.greatest(F.floor(F.sum(F.col("hi") - F.col("lo") + 1) / 2), F.lit(1))
    out = years.groupBy("age").agg(single.alias("people"))
    return _rows(out, "age", F.col("age").cast("string"), F.col("people") / total, F.floor("people").cast("long"), "age bands")


def _rows(df: DataFrame, kind: str, value: Column, p: Column, n: Column, source: str) -> DataFrame:
    return df.select(F.lit(kind).alias("qi_type"), value.alias("value"), p.cast("double").alias("probability"), n.cast("long").alias("population_count"), F.lit(source).alias("source"))


def band_of(age: Column) -> tuple[Column, Column]:
    """(lo, hi) of the age's band, null outside them."""
    pick = lambda k: reduce(lambda c, b: c.when(age.between(*b), b[k]), AGE_BANDS, F.when(F.lit(False), 0))
    return pick(0), pick(1)


def birth_age(value: Column, today: Column) -> Column:
    """Whole years since a date in one of six formats, the first that parses. Two-digit years from
    69 on are of the last century."""
    short = F.regexp_replace(F.regexp_replace(value, r"^(\d{1,2}[/-]\d{1,2}[/-])([0-5]\d|6[0-8])$", "$120$2"), r"^(\d{1,2}[/-]\d{1,2}[/-])(\d\d)$", "$119$2")
    # a format is tried only where its year may stand, as a try that fails costs an exception
    like = lambda f: f"(?s)^[0-9].*{f[1]}[+]?[0-9]{{4,}}$" if f[0] == "M" else f"^[+]?[0-9]{{4,}}{f[4]}"
    parsed = lambda v: F.coalesce(*(F.when(F.rlike(v, F.lit(like(f))), F.try_to_timestamp(v, F.lit(f))) for f in DOB_FORMATS[:4])).cast("date")
    place = lambda d: F.month(d) * 100 + F.dayofmonth(d)
    years = lambda day: (F.year(today) - F.year(day) - (place(today) < place(day)).cast("int")).cast("int")
    return folds.bound(folds.bound(short, parsed), years)  # a date is read once, not for each part of it


def births(df: DataFrame, value: str, ages_table: DataFrame, today: Column) -> DataFrame:
    """Adds probability and population_count of a date of birth: a day's share of its age's."""
    keyed = df.select("*", F.lit("date_of_birth").alias("_kind"), F.col(value).alias("_value"))
    return look_up(keyed, ages_table, today, "_kind", "_value", "_value").drop("_kind", "_value", "source")


def states(spark: SparkSession) -> DataFrame:
    return literal.table(spark, STATE_ROWS, "abbrev string, name string, fips string")


def locations(people: DataFrame, spark: SparkSession, total: float) -> DataFrame:
    """State people (fips, people) by name and by abbreviation."""
    known = states(spark).join(people, "fips")
    long = known.select(F.explode(F.array("abbrev", "name")).alias("value"), "people")
    return _rows(long, "location", F.col("value"), F.col("people") / total, F.col("people"), "states")


def simple(people: DataFrame, kind: str, total: float, source: str) -> DataFrame:
    """(value, people) of a type whose values are looked up as they are: ZIP areas, genders."""
    return _rows(people, kind, F.col("value"), F.col("people") / total, F.col("people"), source)


BLOCK = 256  # characters of a text that its places are looked for in at a time


def _places(texts: DataFrame, body: str, sizes: list[int]) -> DataFrame:
    """A row for each run of `sizes` characters of each text: adds _at, its place from 1, and _start, the run. Long
    texts go to overlapping blocks first, as a substring is looked for from the begin of what it is cut from."""
    blocks = texts.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.length(body) - 1) / BLOCK).cast("int"))))
    parts = blocks.withColumn("_part", F.substring(body, F.col("_b") * BLOCK + 1, F.lit(BLOCK + max(sizes) - 1)))
    each = parts.withColumn("_i", F.explode(F.sequence(F.lit(1), F.least(F.lit(BLOCK), F.length("_part"))))).withColumn("_k", F.explode(F.array(*map(F.lit, sizes))))
    runs = each.withColumn("_start", F.substring("_part", F.col("_i"), F.col("_k"))).where(F.length("_start") == F.col("_k"))
    return runs.withColumn("_at", F.col("_b") * BLOCK + F.col("_i")).drop("_b", "_part", "_i", "_k")


def containing(names: DataFrame, texts: DataFrame, name: str, text: str, n: int = 3) -> DataFrame:
    """The pairs of rows where the text holds the name, in any case. Empty names and nulls have no pairs.

    What a name begins with (n characters, or all of a shorter one) and how long it may be then is a table of
    beginnings, which places of texts meet; each such place gives a candidate of each of these lengths, which is
    joined with the names as a whole. So the work grows with places and pairs, however alike names are: by parts
    of names alone, names times texts would be compared."""
    keyed = names.where(F.length(name) > 0).withColumn("_low", F.lower(name))
    begins = keyed.select(F.substring("_low", 1, n).alias("_start"), F.length("_low").alias("_len")).distinct()
    starts = stored(begins.groupBy("_start").agg(F.collect_set("_len").alias("_lens")), "beginnings")  # a row for each run of n characters at most
    sizes = sorted(r[0] for r in starts.select(F.length("_start")).distinct().collect())  # n at most
    if not sizes:
        return keyed.drop("_low").join(texts, F.lit(False))
    body = texts.where(F.length(text) > 0).withColumn("_body", F.lower(text))
    met = _places(body, "_body", sizes).join(starts, "_start").withColumn("_len", F.explode("_lens")).withColumn("_low", F.substring("_body", F.col("_at"), F.col("_len")))
    first = met.where((F.length("_low") == F.col("_len")) & (F.instr(F.col("_body"), F.col("_low")) == F.col("_at")))  # a name counts once in a text
    found = first.drop("_start", "_lens", "_at", "_len", "_body")
    return shuffled(keyed).join(found, "_low").drop("_low")


def surveyed(names: DataFrame, topics: DataFrame) -> DataFrame:
    """(value, probability, population_count) of diseases by survey: topics whose name holds the
    disease, of a kind of crude prevalence, in the US, latest five, the first with a figure."""
    fits = topics.where(F.contains(F.lower("kind"), F.lit("crude prevalence")) & (F.col("place") == "US"))
    pairs = containing(names.select("value").distinct(), fits, "value", "topic")
    latest = W.partitionBy("value").orderBy(F.desc("year"), F.desc("topic"), F.desc("figure"))
    five = pairs.withColumn("_at", F.row_number().over(latest)).where("_at <= 5 and figure is not null")
    best = five.groupBy("value").agg(F.min_by("figure", "_at").alias("figure"))
    p = F.col("figure") / 100
    return _rows(best, "disease", F.col("value"), p, F.floor(p * NATION), "survey")


def prevalence_class(label: Column) -> Column:
    """The probability of the first class whose name the label holds."""
    return reduce(lambda c, x: c.when(F.contains(F.lower(label), F.lit(x[0].lower())), x[1]), PREVALENCE, F.when(F.lit(False), 0.0))


def rare(codes: DataFrame, epidemiology: DataFrame) -> DataFrame:
    """Diseases by name (value, code) and code (code, items: array of (type, class)): the first item
    of point prevalence, or of any prevalence, with a known class, or else the class of the first
    item."""
    fits = F.filter("items", lambda i: (F.contains(F.lower(i["type"]), F.lit("point")) | F.contains(F.lower(i["type"]), F.lit("prevalence"))) & prevalence_class(i["class"]).isNotNull())
    label = F.coalesce(F.get(fits, 0)["class"], F.get("items", 0)["class"])
    rows = codes.join(epidemiology, "code").select("value", prevalence_class(label).alias("p")).where("p is not null")
    return _rows(rows, "disease", F.col("value"), F.col("p"), F.floor(F.col("p") * NATION), "rare diseases")


def diseases(survey: DataFrame, rare_: DataFrame) -> DataFrame:
    """The survey's figures, and those of rare diseases where it has none."""
    return survey.unionByName(rare_.join(survey.select("value"), "value", "left_anti").select(survey.columns))


def first_known(*sources: DataFrame) -> DataFrame:
    """Sources of one's own (qi_type, value, probability, population_count, source) as one: of those that
    know a value the first counts, and of several rows in it the most probable. Values without a
    probability aren't known."""
    every = reduce(DataFrame.unionByName, (s.select("qi_type", "value", "probability", "population_count", "source", F.lit(-k).alias("_turn")) for k, s in enumerate(sources)))
    best = F.max_by(F.struct("probability", "population_count", "source"), F.struct("_turn", "probability", "population_count", "source"))
    return every.where("probability is not null").groupBy("qi_type", "value").agg(best.alias("b")).select("qi_type", "value", "b.*")


def occupations(codes: DataFrame, employment: DataFrame, total: float = EMPLOYED) -> DataFrame:
    """Occupations by name (value, soc) and code (soc, people)."""
    return _rows(codes.join(employment, "soc"), "occupation", F.col("value"), F.col("people") / total, F.col("people"), "employment")


def fits(population: DataFrame) -> bool:
    """Whether the table is small enough to stand in a row as a map, and tells one figure for a value."""
    n, different = population.where("qi_type is not null and value is not null").agg(F.count("*"), F.count_distinct("qi_type", "value")).first()
    return n == different and n <= MAPPED


def mapped(population: DataFrame) -> DataFrame:
    """One row, _known: (probability, population_count, source) by value by type."""
    by_value = F.map_from_entries(F.collect_list(F.struct("value", F.struct("probability", "population_count", "source"))))
    types = population.where("qi_type is not null and value is not null").groupBy("qi_type").agg(by_value.alias("m"))
    return types.agg(F.map_from_entries(F.collect_list(F.struct("qi_type", "m"))).alias("_known"))


def looked_up(qi: Column, known: Column, today: Column | None = None) -> Column:
    """The QI with what `look_up` adds, from the map of `mapped`."""
    age = lambda c: birth_age(c, F.current_date() if today is None else today).cast("string")

    def of(q: Column) -> Column:
        born = q["qi_type"] == "date_of_birth"
        norm, raw = F.when(born, age(q["normalized_value"])).otherwise(q["normalized_value"]), F.when(born, age(q["raw_value"])).otherwise(F.lower(q["raw_value"]))
        first = lambda table: folds.bound(F.try_element_at(table, norm), lambda x: F.coalesce(F.when(x["probability"].isNotNull(), x), F.try_element_at(table, raw)))
        hit = folds.bound(F.try_element_at(known, F.when(born, "age").otherwise(q["qi_type"])), first)
        p, n, s = (lambda x: x["probability"]), (lambda x: x["population_count"]), (lambda x: x["source"])
        return folds.bound(hit, lambda x: _told(q, born, p(x), n(x), s(x)))

    return folds.bound(qi, of)


def _told(q: Column, born: Column, p: Column, n: Column, s: Column) -> Column:
    q = q.withField("probability", F.when(born, p / 365.25).otherwise(p)).withField("population_count", F.when(born, F.floor(n / 365.25).cast("long")).otherwise(n))
    return q.withField("source", F.when(born, F.concat(s, F.lit(", by day of birth"))).otherwise(s))


def look_up(df: DataFrame, population: DataFrame, today: Column | None = None, kind: str = "qi_type", norm: str = "normalized_value", raw: str = "raw_value") -> DataFrame:
    """Adds probability, population_count and source by (type, normalized value), or else by (type,
    raw value in lower case); null where neither is known. A date of birth is looked up as the age
    that it gives at `today` (now, if not given), of whose people a day has one in 365.25."""
    born = F.col(kind) == "date_of_birth"
    age = lambda c: birth_age(c, F.current_date() if today is None else today).cast("string")
    keyed = df.withColumns({"_t": F.when(born, "age").otherwise(F.col(kind)), "_v1": F.when(born, age(F.col(norm))).otherwise(F.col(norm)), "_v2": F.when(born, age(F.col(raw))).otherwise(F.lower(raw))})
    table = lambda n: population.select(F.col("qi_type").alias("_t"), F.col("value").alias(f"_v{n}"), F.col("probability").alias(f"_p{n}"), F.col("population_count").alias(f"_n{n}"), F.col("source").alias(f"_s{n}"))
    out = keyed.join(table(1), ["_t", "_v1"], "left").join(table(2), ["_t", "_v2"], "left")
    hit = F.col("_p1").isNotNull()
    p, n, s = (F.when(hit, F.col(f"_{k}1")).otherwise(F.col(f"_{k}2")) for k in "pns")
    return out.withColumns(
        {
            "probability": F.when(born, p / 365.25).otherwise(p),
            "population_count": F.when(born, F.floor(n / 365.25).cast("long")).otherwise(n),
            "source": F.when(born, F.concat(s, F.lit(", by day of birth"))).otherwise(s),
        }
    ).drop("_t", "_v1", "_v2", "_p1", "_p2", "_n1", "_n2", "_s1", "_s2")
