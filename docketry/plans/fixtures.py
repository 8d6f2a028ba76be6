"""Fixture relations for the registered queries: one SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with its oracle where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture relation over the tables that the text names."""
    for t in TABLES:
        if t in sql:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


#: Provision and outcome sentences, one for each order.
LEGAL = """SELECT o_orderkey AS doc, o_orderstatus AS st,
  concat('Section ', o_orderkey % 511 + 1, CASE o_orderstatus WHEN 'F' THEN ' IPC' WHEN 'O' THEN ' of the Code of Criminal Procedure, 1973' ELSE '' END,
         '. Result of the case: Appeal ', CASE o_orderstatus WHEN 'F' THEN 'dismissed' WHEN 'O' THEN 'allowed' ELSE 'partly allowed' END) AS text FROM orders"""
#: Citations with treatments, one for each line item.
CITES = """SELECT l_orderkey AS doc, l_linenumber AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, l_suppkey % 50 AS auth,
  concat('Supplier ', l_suppkey, ' v. Part ', l_partkey, ' & Ors.') AS name,
  concat('[2024] ', l_linenumber, ' SCR ', l_orderkey % 999 + 1) AS cite,
  CASE l_returnflag WHEN 'A' THEN 'relied on' WHEN 'R' THEN 'distinguished' ELSE 'referred to' END AS treatment,
  CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'neutral' END AS polarity FROM lineitem"""
#: Provision mentions by zone, one for each line item.
PROVISIONS = """SELECT l_orderkey AS doc, CASE WHEN l_returnflag = 'N' THEN '?' ELSE concat('act', l_suppkey % 7) END AS act_id,
  concat('s', l_partkey % 90 + 1) AS ref, CASE l_linestatus WHEN 'O' THEN 'headnotes' ELSE 'judgment' END AS zone,
  CAST(l_quantity AS INT) % 4 + 1 AS n FROM lineitem"""
#: Graded labels and runs of three systems over orders as queries and parts as documents.
LABELS = "SELECT l_orderkey AS qid, l_partkey AS doc, max(CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 1 ELSE 0 END) AS grade FROM lineitem WHERE l_linenumber <= 4 GROUP BY l_orderkey, l_partkey"
RUN = """SELECT sys AS system, qid, doc, CAST(row_number() OVER (PARTITION BY sys, qid ORDER BY k, doc) AS INT) AS rank FROM (
  SELECT 'a' AS sys, l_orderkey AS qid, l_partkey AS doc, min(l_linenumber) AS k FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'b', l_orderkey, l_partkey, min(l_suppkey) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'c', l_orderkey, l_partkey + l_linenumber % 2, min(l_quantity) FROM lineitem GROUP BY l_orderkey, l_partkey + l_linenumber % 2) x"""
#: Raw signals: queries are suppliers modulo 20, documents are parts.
SIGNALS = """SELECT qid, CASE qid % 5 WHEN 0 THEN 'FACTUAL_SIMILARITY' WHEN 1 THEN 'LEGAL_ISSUE' WHEN 2 THEN 'STATUTE_BASED' WHEN 3 THEN 'SUPPORTING_PRECEDENT' ELSE 'CONTRASTING_PRECEDENT' END AS intent,
  doc, signal, CAST(max(raw) AS DOUBLE) AS raw FROM (
  SELECT l_suppkey % 20 AS qid, l_partkey AS doc, 'bm25' AS signal, l_extendedprice AS raw FROM lineitem
  UNION ALL SELECT l_suppkey % 20, l_partkey, 'semantic', l_quantity FROM lineitem
  UNION ALL SELECT l_suppkey % 20, l_partkey, 'legal', l_discount FROM lineitem
  UNION ALL SELECT l_suppkey % 20, l_partkey, 'citation', l_tax FROM lineitem WHERE l_suppkey % 3 > 0
  UNION ALL SELECT l_suppkey % 20, l_partkey, 'outcome', CASE l_returnflag WHEN 'A' THEN 0.95 WHEN 'R' THEN 0.05 ELSE 0.5 END FROM lineitem WHERE l_suppkey % 2 = 0) x
  GROUP BY qid, doc, signal"""
TOK = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z0-9]+'))"


def tok(x: str) -> str:
    """The tokenizer in DuckDB SQL."""
    return TOK.format(x)
