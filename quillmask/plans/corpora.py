"""Test corpora derived from the star-schema tables by SQL that Spark and DuckDB read alike. {table} stands for an input table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_DNI = "'TRWAGMYFPDXBNJZSQVHLCKE'"
#: Identity numbers with right and wrong control characters.
IDENTS = f"""
SELECT c_custkey * 3 AS doc_id, 'DNI' AS kind,
  lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 8, '0') || substr({_DNI}, CAST((c_custkey * 7919 % 100000000 + c_custkey % 3 % 2) % 23 + 1 AS INT), 1) AS ident FROM {{customer}}
UNION ALL
SELECT c_custkey * 3 + 1, 'NIE',
  substr('XYZ', CAST(c_custkey % 3 + 1 AS INT), 1) || '-' || lpad(CAST(c_custkey * 613 % 10000000 AS STRING), 7, '0') || substr({_DNI}, CAST((c_custkey % 3 * 10000000 + c_custkey * 613 % 10000000 + c_custkey % 5 % 2) % 23 + 1 AS INT), 1) FROM {{customer}}
UNION ALL
SELECT c_custkey * 3 + 2, 'CIF',
  substr('ABHNPQRSW', CAST(c_custkey % 9 + 1 AS INT), 1) || lpad(CAST(c_custkey * 104729 % 10000000 AS STRING), 7, '0') || substr('0123456789ABCDEFGHIJ', CAST(c_custkey * 31 % 20 + 1 AS INT), 1) FROM {{customer}}
"""
#: Letters with several identifiers each.
LETTERS = f"""
SELECT c_custkey AS doc_id, 'Client ' || c_name || ' holds ' || lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 8, '0') || substr({_DNI}, CAST((c_custkey * 7919 + c_custkey % 3 % 2) % 23 + 1 AS INT), 1)
  || ', mail ' || lower(replace(c_name, '#', '.')) || '@example.com, from 10.' || CAST(c_custkey % 256 AS STRING) || '.' || CAST(c_custkey % 199 AS STRING) || '.7' AS text FROM {{customer}}
"""
#: Letters with telephone numbers, bank accounts and addresses of either kind, some of them broken.
CONTACTS = """
SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'Tel. +34 ' || CAST(600 + c_custkey % 300 AS STRING) || '-' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(c_custkey * 7 % 1000 AS STRING), 3, '0')
    WHEN 1 THEN 'Tel. ' || CAST(600 + c_custkey % 300 AS STRING) || ' ' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || ' 23 ' || lpad(CAST(c_custkey * 3 % 100 AS STRING), 2, '0')
    WHEN 2 THEN 'Tel. 0034 ' || CAST(600 + c_custkey % 300 AS STRING) || ' 111 2' || CAST(c_custkey % 10 AS STRING) ELSE 'Tel. ' || CAST(900 + c_custkey % 90 AS STRING) || '.555.' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') END
  || ', account ES' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END || '2100' || CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END || '0418' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' 4502 ' END || lpad(CAST(c_custkey * 37 % 10000 AS STRING), 4, '0')
  || ', host 2001:db8:0:' || CAST(c_custkey % 10 AS STRING) || '::' || CAST(c_custkey % 97 AS STRING) || ' via 192.168.' || CAST(c_custkey % 300 AS STRING) || '.1' AS text
FROM {customer}
"""
#: Spans of two detectors that overlap in many ways.
SPANS = """
SELECT o_orderkey AS doc_id, CASE WHEN i % 2 = 0 THEN '01-REGEX' ELSE '02-SPACY' END AS component, CAST(i % 2 + 1 AS INT) AS comp_idx, CAST(i AS INT) AS det_idx,
  CAST(i * 7 + o_orderkey % 5 AS INT) AS start, CAST(i * 7 + o_orderkey % 5 + 3 + (o_orderkey * 3 + i * 5) % 11 AS INT) AS stop,
  CASE (o_orderkey + i) % 3 WHEN 0 THEN 'NAME' WHEN 1 THEN 'PERSON' ELSE 'COMPANY' END AS entity_type,
  CAST((o_orderkey + i) % 4 AS STRING) AS id, CAST((o_orderkey * 7 + i * 3) % 10 / 10.0 AS DOUBLE) AS confidence,
  CAST((o_orderkey + i) % 2 AS INT) AS prio, CAST(i % 2 AS INT) AS hier
FROM {orders} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS t(i)
"""
#: Gold spans and predictions with moved bounds, other types and other ids.
GOLDS = """
SELECT o_orderkey AS doc_id, CAST(i AS INT) AS ord, CAST(i * 20 AS INT) AS start, CAST(i * 20 + 6 + o_orderkey % 7 AS INT) AS stop,
  CASE i % 2 WHEN 0 THEN 'NAME' ELSE 'COMPANY' END AS entity_type, CAST((o_orderkey + i) % 2 AS STRING) AS id
FROM {orders} CROSS JOIN (VALUES (0), (1), (2), (3)) AS t(i)
"""
PREDS = """
SELECT o_orderkey AS doc_id, CAST(i AS INT) AS ord, CAST(i * 20 + (o_orderkey + i) % 3 AS INT) AS start, CAST(i * 20 + 6 + o_orderkey % 7 + (o_orderkey * 5 + i) % 4 AS INT) AS stop,
  CASE WHEN (o_orderkey + i) % 11 = 0 THEN 'ADDRESS' WHEN i % 2 = 0 THEN 'NAME' ELSE 'COMPANY' END AS entity_type, CAST((o_orderkey + i + 1) % 2 AS STRING) AS id,
  CASE WHEN i % 3 = 0 THEN '01-REGEX' ELSE '02-SPACY' END AS component
FROM {orders} CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS t(i) WHERE (o_orderkey + i) % 5 <> 0
"""
#: Mentions of names in groups, with spelling variants.
MENTIONS = """
SELECT c_nationkey AS doc_id, CASE c_custkey % 2 WHEN 0 THEN 'NAME' ELSE 'COMPANY' END AS entity_type, CAST(c_custkey AS INT) AS ord, CAST(c_custkey * 10 AS INT) AS start,
  CASE c_custkey % 3 WHEN 0 THEN 'Acme ' || CAST(c_custkey % 7 * 1111111 AS STRING) WHEN 1 THEN 'ACME  ' || CAST(c_custkey % 7 * 1111111 AS STRING) ELSE n_name || ' ' || CAST(c_custkey % 4 * 222222 AS STRING) END AS mention
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""
#: Texts with inline gold blocks.
INLINE = """
SELECT c_custkey AS doc_id, 'To ##name;' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey % 5 AS STRING) END || ';' || c_name || '@@ of ##Person; ;' || c_mktsegment || '@@, ##COMPANY;7;a;b@@.' AS gold FROM {customer}
"""
#: Rates of some runs.
RUNS = """
SELECT 'run-' || CAST(l_linenumber AS STRING) AS run_id, substr('ADHLPSV', CAST(l_suppkey % 7 + 1 AS INT), 1) AS entity_type, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS f1
FROM {lineitem} WHERE NOT (l_linenumber = 7 AND l_suppkey % 7 = 0) GROUP BY l_linenumber, l_suppkey % 7, substr('ADHLPSV', CAST(l_suppkey % 7 + 1 AS INT), 1)
"""
#: Detections of a model in token chunks.
CHUNKS = """
SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INT) AS chunk, CAST(l_linenumber AS INT) AS ord, CAST(l_partkey % 60 AS INT) AS start, CAST(l_partkey % 60 + 4 + l_suppkey % 13 AS INT) AS stop,
  CASE l_linenumber % 2 WHEN 0 THEN 'NAME' ELSE 'COMPANY' END AS entity_type, CAST(l_linenumber AS STRING) AS id, CAST(l_partkey % 10 / 10.0 AS DOUBLE) AS confidence
FROM {lineitem}
"""
#: Answers of a masking service.
ANSWERS = """
SELECT o_orderkey AS doc_id, o_orderpriority || ' for ' || 'Clerk ' || CAST(o_custkey AS STRING) || ' placed on a Monday.' AS text,
  CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority || ' for [NAME1] placed on a Monday.' WHEN 2 THEN o_orderpriority || ' for [NA' ELSE o_orderpriority || ' for [PERSON02] placed on [DAY].' END AS masked,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Length' ELSE 'stop' END AS reason, CAST(60 + o_orderkey % 3 AS STRING) AS announced, CAST(60 AS BIGINT) AS received
FROM {orders}
"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A corpus in Spark."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def duck(sql: str) -> str:
    """A corpus in DuckDB."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", sql) + ")"

