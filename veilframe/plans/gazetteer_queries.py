"""Queries on dictionaries that are tables of the data: their terms in all documents, pages and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import OCCUPATIONS
from ..operators import gazetteer, quasi
from ..sources import literal
from . import quasi_queries as Q
from . import rendered as R
from .explicit_queries import read

_PAIRS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: Names of parts and nations, and all pairs of neighbouring words of the benchmark, in SQL of both engines.
_NAMES = "SELECT DISTINCT p_name AS term, 'part' AS kind FROM part UNION ALL SELECT n_name, 'nation' FROM nation"


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("part", "nation"):
        read(spark, sf_dir, t).createOrReplaceTempView(f"gazetteer_{t}")
    names = spark.sql(_NAMES.replace("FROM part", "FROM gazetteer_part").replace("FROM nation", "FROM gazetteer_nation"))
    own = read(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit(_PAIRS), F.lit(0)).alias("w"))
    pairs = own.select(F.explode(F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1)))).alias("term"), F.lit("pair").alias("kind"))
    return names.unionByName(pairs.distinct())


def gazetteer_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term's place in each document, by a trie of words."""
    found = gazetteer.find(read(spark, sf_dir, "documents"), terms(spark, sf_dir), "doc_id")
    return found.select("doc_id", "kind", "value", "start", "end")


def gazetteer_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with no dictionary broadcast."""
    found = gazetteer.find(read(spark, sf_dir, "documents"), terms(spark, sf_dir), "doc_id", max_terms=0)
    return found.select("doc_id", "kind", "value", "start", "end")


def qi_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quasi-identifiers with diseases, places, peoples and occupations from one dictionary."""
    rows = [(t, "disease", 0.9) for t in Q.DISEASES] + [(t, "location", 0.7) for t in Q.PLACES] + [(t, "ethnicity", 0.7) for t in Q.PEOPLES] + [(t, "occupation", 0.85) for t in OCCUPATIONS]
    told = quasi.extract(R.narrative(spark, sf_dir), dictionary=literal.table(spark, rows, "term string, kind string, confidence double"))
    return Q._rows_of(told, F.col("qis"))


_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '{_PAIRS}') AS m, string_split_regex(text, '{_PAIRS}') AS s FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, unnest(m) AS w, unnest(s[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM d),
p AS (SELECT doc_id, i, lower(w) AS w, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, length(w) AS n FROM t),
b AS (SELECT regexp_extract_all(lower(text), '{_PAIRS}') AS w FROM benchmark),
terms AS ({_NAMES} UNION ALL SELECT DISTINCT w[i] || ' ' || w[i + 1], 'pair' FROM (SELECT w, unnest(range(1, len(w))) AS i FROM b)),
k AS (SELECT DISTINCT kind, regexp_extract_all(lower(term), '{_PAIRS}') AS w FROM terms),
runs AS (SELECT a.doc_id, a.w AS phrase, a.stop - a.n AS start, a.stop AS "end" FROM p a
 UNION ALL SELECT a.doc_id, a.w || ' ' || b.w, a.stop - a.n, b.stop FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i = a.i + 1)
SELECT doc_id, kind, phrase AS value, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end" FROM runs JOIN (SELECT kind, array_to_string(w, ' ') AS phrase FROM k) USING (phrase)"""

REGISTRY = {
    "gazetteer_terms": (gazetteer_terms, _SQL),
    "gazetteer_joined": (gazetteer_joined, _SQL),
    "qi_gazetteer": (qi_gazetteer, f"WITH {R.NARR_CTE} {Q._UNION}"),
}
