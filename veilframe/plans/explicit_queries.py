"""Queries on explicit entities, blocks and text features, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import table_functions
from ..functions import text as X
from ..functions.constants import RECOGNIZERS
from ..operators import contextual, explicit, features, quasi
from ..sources import blocks
from . import rendered as R

DOC_KINDS = ("EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS", "CREDIT_CARD")
TURN_RECOGNIZERS = {"PERSON": (r" [A-Z][a-z]+", 0.85, "", False), "DATE_TIME": (r"[0-9]+", 0.6, "", False)}
DOC_RECOGNIZERS = {k: RECOGNIZERS[k] for k in DOC_KINDS}
_WEIGHTS = {"EMAIL_ADDRESS": 0.85, "PHONE_NUMBER": 0.8, "IP_ADDRESS": 0.75, "CREDIT_CARD": 0.95, "URL": 0.4, "US_SSN": 1.0, "PERSON": 0.9, "ORGANIZATION": 0.5, "DATE_TIME": 0.5, "LOCATION": 0.6}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _luhn_sql(x: str) -> str:
    return f"list_sum(list_transform(range(1, length({x}) + 1), lambda k: CASE WHEN k % 2 = length({x}) % 2 THEN CAST(substr({x}, k, 1) AS INT) ELSE CASE WHEN 2 * CAST(substr({x}, k, 1) AS INT) > 9 THEN 2 * CAST(substr({x}, k, 1) AS INT) - 9 ELSE 2 * CAST(substr({x}, k, 1) AS INT) END END)) % 10 = 0"


def entity_cte(table: str, id: str, text: str, kinds: tuple[str, ...], recognizers: dict = RECOGNIZERS) -> str:
    """ent: (id, entity_type, start, end, text, confidence, weight, weighted_score)."""
    parts = []
    for kind in kinds:
        pattern, confidence, _, luhn = recognizers[kind]
        p = pattern.replace("'", "''").replace('\\"', '"')
        parts.append(
            f"SELECT {id}, '{kind}' AS entity_type, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a, m[i] AS x, CAST({confidence} AS DOUBLE) AS c, CAST({_WEIGHTS[kind]} AS DOUBLE) AS w "
            f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {id}, regexp_extract_all({text}, '{p}') AS m, string_split_regex({text}, '{p}') AS s FROM {table}))" + (f" WHERE {_luhn_sql('m[i]')}" if luhn else "")
        )
    return f"ent AS (SELECT {id}, entity_type, CAST(a AS INT) AS start, CAST(a + length(x) AS INT) AS \"end\", x AS text, c AS confidence, w AS weight, round(c * w, 4) AS weighted_score FROM ({' UNION ALL '.join(parts)}))"


DOC_CTE = entity_cte("documents", "doc_id", "text", DOC_KINDS)
SCORE_CTE = DOC_CTE + """, es AS (SELECT doc_id, least(0.6 * max(weighted_score) + 0.4 * avg(weighted_score), 1) AS e_score, count(*) AS e_count, max(weight) AS e_max_weight, avg(confidence) AS e_mean, median(confidence) AS e_median, list(entity_type) AS kinds FROM ent GROUP BY doc_id)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explicit.entities(read(spark, sf_dir, "documents"), recognizers=DOC_RECOGNIZERS)


def e_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explicit.exploded(_docs(spark, sf_dir), "doc_id").drop("context")


def e_spans_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spans by the table function, from SQL."""
    table_functions.register(spark)
    read(spark, sf_dir, "documents").createOrReplaceTempView("documents_for_spans")
    return spark.sql(f"SELECT doc_id, s.* FROM documents_for_spans, LATERAL entity_spans(text, '{','.join(DOC_KINDS)}') s")


def e_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explicit.exploded(_docs(spark, sf_dir), "doc_id").select("doc_id", "start", "context")


def e_score_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = explicit.summary(_docs(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    return s.select("doc_id", r("e_score"), "e_count", r("e_max_weight"), r("e_mean_confidence"), r("e_median_confidence"))


def e_score_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explicit.summary(_docs(spark, sf_dir)).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("e_score"), 6).alias("mean_e_score"), F.round(F.max("e_score"), 6).alias("max_e_score"))


def e_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {k: RECOGNIZERS[k] for k in ("EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS")}
    docs = explicit.entities(read(spark, sf_dir, "documents"), recognizers=kinds)
    return explicit.mask(docs).where("size(entities) > 0").select("doc_id", F.md5("e_masked").alias("masked_md5"), F.length("e_masked").cast("long").alias("masked_length"))


def _by_kind(df: DataFrame, id: str, text: str, kinds: tuple[str, ...]) -> DataFrame:
    found = explicit.entities(df, text, {k: RECOGNIZERS[k] for k in kinds})
    return found.select(F.explode("entities").alias("e")).groupBy("e.entity_type").agg(F.count("*").alias("n"), F.sum(F.length("e.text")).alias("chars"))


def e_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_kind(read(spark, sf_dir, "pages"), "page_id", "html", ("URL", "EMAIL_ADDRESS", "IP_ADDRESS"))


def e_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns hold no entities of the known kinds, so conversations get a recognizer of their own:
    words that begin with a capital, inside a sentence."""
    found = explicit.entities(read(spark, sf_dir, "conversations"), "text", TURN_RECOGNIZERS)
    scored = explicit.summary(found).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("e_count").alias("n"), F.round(F.max("e_score"), 6).alias("max_e_score"))
    return scored


def e_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognizers under the threshold of 0.7 drop out."""
    docs = explicit.entities(read(spark, sf_dir, "documents"), recognizers=DOC_RECOGNIZERS, threshold=0.7)
    return docs.select(F.explode_outer("entities").alias("e")).where("e is not null").groupBy("e.entity_type").agg(F.count("*").alias("n"), F.min("e.confidence").alias("least"))


def e_score_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything of the public function on raw pages, in merged mode."""
    pages = explicit.score_explicit(read(spark, sf_dir, "pages"), "html", mode="merged", recognizers=RECOGNIZERS)
    return pages.select("page_id", "e_count", F.round("e_score", 6).alias("e_score"), F.array_join("e_types", "|").alias("types"), (F.length("e_masked") - F.length("html")).cast("long").alias("grown"))


def luhn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{16}"), F.lit(0))).alias("digits"))
    return found.select("doc_id", "digits", F.call_function("luhn_check", F.col("digits")).alias("valid"))


def e_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON reports read again: length, score, count, the entities' digest and the masked text's."""
    kinds = {k: RECOGNIZERS[k] for k in ("EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS")}
    docs = explicit.report(explicit.mask(explicit.summary(explicit.entities(read(spark, sf_dir, "documents"), recognizers=kinds))))
    body = F.from_json("report", "text_length long, e_score double, entity_count long, entities array<struct<entity_type:string,start:int,end:int,text:string,confidence:double,weight:double,weighted_score:double>>, masked_text string")
    told = docs.where("e_count > 0").select("doc_id", body.alias("r"))
    parts = F.array_sort(F.transform("r.entities", lambda e: F.concat_ws(":", e["start"].cast("string"), e["end"].cast("string"), e["entity_type"], e["text"])))
    return told.select("doc_id", "r.text_length", "r.e_score", "r.entity_count", F.md5(F.array_join(parts, ",")).alias("entities_md5"), F.md5("r.masked_text").alias("masked_md5"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{R.BLOCKS} AS value")


def block_parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.parse_strict(_blocks(spark, sf_dir), "value", "o_orderkey")


def block_parse_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.parse_loose(_blocks(spark, sf_dir), "value", "o_orderkey")


def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.hashed(block_parse_strict(spark, sf_dir)).select("o_orderkey", "block", "sample_hash")


def features_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    long = lambda c, name: c.cast("long").alias(name)
    return read(spark, sf_dir, "documents").select("doc_id", long(F.length(t), "text_length"), long(X.word_count(t), "word_count"), long(X.sentence_count(t), "sentence_count"))


def features_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's entity features on documents, whose quasi-identifiers aren't looked for."""
    docs = _docs(spark, sf_dir).withColumns({"word_count": X.word_count(F.col("text")), "qis": F.array().cast(quasi.NONE)})
    s = features.entity_features(docs)
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return s.select("doc_id", F.col("entity_type_combo_signature").alias("signature"), long("unique_entity_type_count", "n_types"), F.round("entity_density", 6).alias("density"), F.col("has_direct_identifier").alias("has_direct"), long("direct_identifier_count", "n_direct"), long("high_risk_combo_count", "combos"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {k: RECOGNIZERS[k] for k in ("EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS")}
    d = explicit.mask(explicit.entities(read(spark, sf_dir, "documents"), recognizers=kinds))
    t, m = F.col("text"), F.col("e_masked")
    ratio = 1 - X.ratio(F.length(m), F.length(t))
    return d.select("doc_id", F.round(X.coverage(t, m), 6).alias("e_coverage"), X.mask_tokens(m).cast("long").alias("mask_token_count"), F.round(ratio, 6).alias("chars_masked_ratio"), F.round(X.ratio(X.mask_tokens(m), X.word_count(t)), 6).alias("mask_ratio"))


def llm_memo_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct text is worked on once; here the work is to count its words."""
    docs = read(spark, sf_dir, "documents")
    return contextual.memoised(docs, "text", lambda d: d.withColumn("words", X.word_count(F.trim("text")).cast("long")), "words").select("doc_id", "words")


_MASK_SQL = "regexp_replace(regexp_replace(regexp_replace(text, '{e}', '[EMAIL_ADDRESS]', 'g'), '{p}', '[PHONE_NUMBER]', 'g'), '{i}', '[IP_ADDRESS]', 'g')".format(e=RECOGNIZERS["EMAIL_ADDRESS"][0], p=RECOGNIZERS["PHONE_NUMBER"][0], i=RECOGNIZERS["IP_ADDRESS"][0])
_WORDS_SQL = "len(list_filter(string_split_regex({t}, '[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+'), lambda x: x <> ''))"
_META = r"^#\s*[^:]+:\s*.+$"


def _strict_sql(tail: str) -> str:
    return rf"""WITH v AS (SELECT o_orderkey, {R.BLOCKS} AS value FROM orders),
b AS (SELECT o_orderkey, unnest(string_split_regex(value, '(?m)^---$')) AS body, generate_subscripts(string_split_regex(value, '(?m)^---$'), 1) - 1 AS block FROM v),
l AS (SELECT *, string_split(body, chr(10)) AS lines FROM b),
t AS (SELECT o_orderkey, CAST(block AS INT) AS block, regexp_replace(array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, '{_META}')), chr(10)), '^\s+|\s+$', '', 'g') AS text,
 trim(regexp_extract(coalesce(list_filter(lines, lambda x: lower(trim(regexp_extract(x, '^#\s*([^:]+):\s*(.+)$', 1))) = 'name')[-1], ''), '^#\s*([^:]+):\s*(.+)$', 2)) AS name,
 lower(trim(regexp_extract(coalesce(list_filter(lines, lambda x: lower(trim(regexp_extract(x, '^#\s*([^:]+):\s*(.+)$', 1))) = 'expected_critical')[-1], ''), '^#\s*([^:]+):\s*(.+)$', 2))) AS crit FROM l),
s AS (SELECT o_orderkey, block, CASE WHEN name <> '' THEN name WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS name, crit IN ('1', 'true', 'yes') AS expected_critical, text FROM t WHERE text <> '')
{tail}"""


REGISTRY = {
    "e_spans_lateral": (e_spans_lateral, f'WITH {DOC_CTE} SELECT doc_id, entity_type, start, "end", text, confidence FROM ent'),
    "e_entities": (e_entities, f"WITH {DOC_CTE} SELECT * FROM ent"),
    "e_context": (e_context, f"WITH {DOC_CTE} SELECT e.doc_id, e.start, CASE WHEN e.start > 50 THEN '...' ELSE '' END || substr(d.text, greatest(e.start - 50, 0) + 1, least(e.\"end\" + 50, length(d.text)) - greatest(e.start - 50, 0)) || CASE WHEN e.\"end\" + 50 < length(d.text) THEN '...' ELSE '' END AS context FROM ent e JOIN documents d USING (doc_id)"),
    "e_score_docs": (e_score_docs, f"WITH {SCORE_CTE} SELECT doc_id, round(coalesce(e_score, 0), 6) AS e_score, coalesce(e_count, 0) AS e_count, round(coalesce(e_max_weight, 0), 6) AS e_max_weight, round(coalesce(e_mean, 0), 6) AS e_mean_confidence, round(coalesce(e_median, 0), 6) AS e_median_confidence FROM documents LEFT JOIN es USING (doc_id)"),
    "e_score_by_lang": (e_score_by_lang, f"WITH {SCORE_CTE} SELECT lang, count(*) AS n, round(avg(coalesce(e_score, 0)), 6) AS mean_e_score, round(max(coalesce(e_score, 0)), 6) AS max_e_score FROM documents LEFT JOIN es USING (doc_id) GROUP BY lang"),
    "e_mask": (e_mask, f"SELECT doc_id, md5(m) AS masked_md5, CAST(length(m) AS BIGINT) AS masked_length FROM (SELECT doc_id, text, {_MASK_SQL} AS m FROM documents) WHERE m <> text"),
    "e_html": (e_html, f"WITH {entity_cte('pages', 'page_id', 'html', ('URL', 'EMAIL_ADDRESS', 'IP_ADDRESS'))} SELECT entity_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM ent GROUP BY entity_type"),
    "e_conversations": (
        e_conversations,
        f"""WITH {entity_cte('conv', 'k', 'text', ('PERSON', 'DATE_TIME'), TURN_RECOGNIZERS).replace('ent AS (', 'conv AS (SELECT *, row_number() OVER () AS k FROM conversations), ent AS (', 1)},
s AS (SELECT k, count(*) AS n, least(0.6 * max(weighted_score) + 0.4 * avg(weighted_score), 1) AS e FROM ent GROUP BY k) SELECT conv_id, count(*) AS turns, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, round(max(coalesce(e, 0)), 6) AS max_e_score FROM conv LEFT JOIN s USING (k) GROUP BY conv_id""",
    ),
    "e_threshold": (e_threshold, f"WITH {DOC_CTE} SELECT entity_type, count(*) AS n, min(confidence) AS least FROM ent WHERE confidence >= 0.7 GROUP BY entity_type"),
    "e_score_explicit": (
        e_score_explicit,
        f"""WITH RECURSIVE {entity_cte('pages', 'page_id', 'html', tuple(RECOGNIZERS))}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY start, "end", entity_type) AS i FROM ent),
kept AS (SELECT page_id, 0 AS i, 0 AS upto, CAST(0 AS BIGINT) AS grown FROM pages UNION ALL SELECT k.page_id, o.i, CASE WHEN o.start >= k.upto THEN o."end" ELSE k.upto END, k.grown + CASE WHEN o.start >= k.upto THEN length(o.entity_type) + 2 - (o."end" - o.start) ELSE 0 END FROM kept k JOIN o ON o.page_id = k.page_id AND o.i = k.i + 1),
s AS (SELECT page_id, count(*) AS n, least(0.6 * max(weighted_score) + 0.4 * avg(weighted_score), 1) AS e, array_to_string(list_sort(list(DISTINCT entity_type)), '|') AS types FROM ent GROUP BY page_id)
SELECT p.page_id, CAST(coalesce(n, 0) AS BIGINT) AS e_count, round(coalesce(e, 0), 6) AS e_score, coalesce(types, '') AS types, grown FROM pages p LEFT JOIN s USING (page_id) JOIN (SELECT page_id, arg_max(grown, i) AS grown FROM kept GROUP BY page_id) USING (page_id)""",
    ),
    "luhn_cards": (luhn_cards, f"SELECT doc_id, x AS digits, {_luhn_sql('x')} AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{{16}}')) AS x FROM documents)"),
    "e_report": (
        e_report,
        f"""WITH {entity_cte('documents', 'doc_id', 'text', ('EMAIL_ADDRESS', 'PHONE_NUMBER', 'IP_ADDRESS'))}, es AS (SELECT doc_id, count(*) AS n, least(0.6 * max(weighted_score) + 0.4 * avg(weighted_score), 1) AS e, md5(array_to_string(list_sort(list(concat_ws(':', start, "end", entity_type, text))), ',')) AS entities_md5 FROM ent GROUP BY doc_id)
SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length, round(e, 4) AS e_score, n AS entity_count, entities_md5, md5({_MASK_SQL}) AS masked_md5 FROM documents JOIN es USING (doc_id)""",
    ),
    "block_parse_strict": (block_parse_strict, _strict_sql("SELECT * FROM s")),
    "block_parse_loose": (
        block_parse_loose,
        rf"""WITH v AS (SELECT o_orderkey, {R.BLOCKS} AS value FROM orders),
b AS (SELECT o_orderkey, unnest(string_split(value, '---')) AS body, generate_subscripts(string_split(value, '---'), 1) - 1 AS block FROM v),
t AS (SELECT o_orderkey, CAST(block AS INT) AS block, regexp_replace(array_to_string(list_filter(string_split(body, chr(10)), lambda x: NOT regexp_matches(x, '^\s*#')), chr(10)), '^\s+|\s+$', '', 'g') AS text,
 trim(regexp_extract(body, '(?i)#\s*name:[ \t]*([^\n]*)', 1)) AS name, lower(regexp_extract(body, '(?i)expected_critical:\s*(true|false)', 1)) = 'true' AS expected_critical FROM b)
SELECT o_orderkey, block, CASE WHEN name <> '' THEN name ELSE 'Sample_' || row_number() OVER (PARTITION BY o_orderkey ORDER BY block) END AS name, expected_critical, text FROM t WHERE text <> ''""",
    ),
    "sample_hash": (sample_hash, _strict_sql("SELECT o_orderkey, block, substr(md5(name || '|' || text || '|' || CASE WHEN expected_critical THEN 'True' ELSE 'False' END), 1, 12) AS sample_hash FROM s")),
    "features_text": (features_text, f"SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length, CAST({_WORDS_SQL.format(t='text')} AS BIGINT) AS word_count, CAST(greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS BIGINT) AS sentence_count FROM documents"),
    "features_entity": (
        features_entity,
        f"""WITH {SCORE_CTE} SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(kinds)), '|'), '') AS signature, CAST(coalesce(len(list_distinct(kinds)), 0) AS BIGINT) AS n_types,
round(100 * CAST(coalesce(e_count, 0) AS DOUBLE) / greatest({_WORDS_SQL.format(t='text')}, 1), 6) AS density, coalesce(len(list_intersect(kinds, ['CREDIT_CARD', 'EMAIL_ADDRESS', 'PHONE_NUMBER'])) > 0, false) AS has_direct, CAST(coalesce(len(list_filter(kinds, lambda x: x IN ('CREDIT_CARD', 'EMAIL_ADDRESS', 'PHONE_NUMBER'))), 0) AS BIGINT) AS n_direct, CAST(0 AS BIGINT) AS combos FROM documents LEFT JOIN es USING (doc_id)""",
    ),
    "coverage": (
        coverage,
        f"""WITH m AS (SELECT doc_id, text, {_MASK_SQL} AS m, {_WORDS_SQL.format(t='text')} AS w FROM documents), t AS (SELECT *, length(regexp_replace(m, '\\[[A-Z_]+\\]', '', 'g')) AS l, len(regexp_extract_all(m, '\\[[A-Z_]+\\]')) AS k FROM m)
SELECT doc_id, round(CASE WHEN length(text) > 0 THEN greatest(length(text) - l, 0) / CAST(length(text) AS DOUBLE) ELSE 0 END, 6) AS e_coverage, CAST(k AS BIGINT) AS mask_token_count,
round(1 - length(m) / CAST(greatest(length(text), 1) AS DOUBLE), 6) AS chars_masked_ratio, round(k / CAST(greatest(w, 1) AS DOUBLE), 6) AS mask_ratio FROM t""",
    ),
    "llm_memo_distinct": (llm_memo_distinct, f"SELECT doc_id, CAST({_WORDS_SQL.format(t='trim(text)')} AS BIGINT) AS words FROM documents"),
}
