"""Inputs rendered from the relational tables, as SQL that Spark and DuckDB both take.

The tables hold no ages, ZIPs or model replies, so queries on quasi-identifiers read texts and
replies composed from customer rows: synthetic by construction, but over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TASKS_A_CORE = 3
AGE = "(18 + c_custkey % 60)"
#: One case in eight tells nothing, one a state, one a disease and an age.
NARRATIVE = f"""CASE WHEN c_custkey % 8 = 0 THEN 'Nothing is known of this case.' WHEN c_custkey % 8 = 1 THEN 'A person from Texas.'
 WHEN c_custkey % 8 = 2 THEN concat('Has Marfan syndrome, is ', CAST({AGE} AS STRING), ' years old.') ELSE
 concat('Case ', CAST(c_custkey AS STRING), CASE c_custkey % 4 WHEN 0 THEN ': the patient is a ' WHEN 1 THEN ', aged: ' ELSE ', a ' END, CASE WHEN c_custkey % 11 = 0 THEN '0' ELSE '' END,
 CAST({AGE} AS STRING), ' year old ', CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'Woman' ELSE 'person' END, CASE WHEN c_custkey % 7 = 0 THEN ' of Irish descent' ELSE '' END, ', works as a ',
 CASE c_custkey % 6 WHEN 0 THEN 'nurse' WHEN 1 THEN 'police officer' WHEN 2 THEN 'glass blower and' WHEN 3 THEN 'teacher' WHEN 4 THEN 'tax consultant who' ELSE 'pilot' END, ' in ',
 CASE c_custkey % 5 WHEN 0 THEN 'Texas' WHEN 1 THEN 'CA' WHEN 2 THEN 'new york' WHEN 3 THEN 'Paris' ELSE 'OH 10007' END, '. DOB: ',
 CASE c_custkey % 4 WHEN 0 THEN '3/7/1985' WHEN 1 THEN '1979-11-02' WHEN 2 THEN '3/7/85' ELSE '12-25-1960' END, '. Lives at zip ',
 CAST(10000 + c_custkey % 40 AS STRING), '. Diagnosed with ', CASE c_custkey % 4 WHEN 0 THEN 'asthma' WHEN 1 THEN 'diabetes' WHEN 2 THEN 'Marfan syndrome' ELSE 'influenza' END, '.') END"""

#: A function of the text, as a recorded reply is found by it.
QI_REPLY = f"""CASE WHEN c_custkey % 8 = 0 THEN '{{"quasi_identifiers":[]}}' WHEN c_custkey % 8 = 1 THEN '{{"quasi_identifiers":[{{"type":"location","raw_value":"Texas"}}]}}' WHEN c_custkey % 8 = 2 THEN '{{"quasi_identifiers":["disease"]}}' WHEN c_custkey % 7 = 0 THEN 'no json here' WHEN c_custkey % 7 = 1 THEN '{{"quasi_identifiers":[{{"type":"age","raw_value":"year","confidence":"odd"}}]}}' ELSE
 concat('Sure: {{"quasi_identifiers":[{{"type":"age","raw_value":"', CAST({AGE} AS STRING), '","normalized_value":" ', CAST({AGE} AS STRING), ' ","confidence":0.9}},',
 '{{"type":"planet","raw_value":"Mars","confidence":0.5}},{{"type":"location","raw_value":"TEXAS","normalized_value":"Texas","confidence":1.4}},',
 '{{"type":"occupation","raw_value":"works","normalized_value":"WORKS","confidence":0.25}},{{"type":"occupation","raw_value":"works","normalized_value":"works","confidence":0.5}}]}} bye') END"""

FACTOR_REPLY = """CASE WHEN c_custkey % 9 = 0 THEN 'none' ELSE
 concat('{"factors":[{"name":"INFERENTIAL_DISCLOSURE","detected":', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"confidence":0.', CAST(c_custkey % 10 AS STRING), '},',
 '{"name":"SOCIAL_STIGMA_RISK","detected":"', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'false' END, '","confidence":"', CASE c_custkey % 4 WHEN 0 THEN 'High' WHEN 1 THEN '0.4' WHEN 2 THEN 'odd' ELSE ' med ' END, '"},',
 '{"name":"NEW_FACTOR","detected":true,"confidence":{"score":"low","value":1}}],"summary":"s"}') END"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table may lie in fewer row groups than cores, whatever its splits, as one without the begin of a group has
    no rows: its keys are dealt out, as the work on each is large, to several tasks a core, so that none waits long
    for a slower one."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return rows.repartition(max(rows.rdd.getNumPartitions(), TASKS_A_CORE * spark.sparkContext.defaultParallelism))


def narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).selectExpr("c_custkey AS id", f"{NARRATIVE} AS text")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, reply) with the reply of the quasi-identifier model."""
    return customers(spark, sf_dir).selectExpr("c_custkey AS id", f"{NARRATIVE} AS text", f"{QI_REPLY} AS reply")


def factor_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).selectExpr("c_custkey AS id", f"{FACTOR_REPLY} AS reply")


NARR_CTE = f"narr AS (SELECT c_custkey AS id, {NARRATIVE} AS text FROM customer)"
REPLY_CTE = f"rep AS (SELECT c_custkey AS id, {NARRATIVE} AS text, {QI_REPLY} AS reply FROM customer)"
FACTOR_CTE = f"rep AS (SELECT c_custkey AS id, {FACTOR_REPLY} AS reply FROM customer)"

#: Two blocks a row, one without name and one without text, with --- inside a line.
BLOCKS = """concat('# name: order ', CAST(o_orderkey AS STRING), chr(10), '# expected_critical: ', CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'Yes' ELSE 'false' END, chr(10),
 'Priority ', o_orderpriority, ' --- as told', chr(10), '# note', chr(10), '---', chr(10), '# foo: bar', chr(10), 'A second block, without a name, of customer number ', CAST(o_custkey AS STRING), '.', chr(10), '---', chr(10), ' ')"""
