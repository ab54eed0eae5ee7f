"""Lineage inputs derived from the driver's tables, as SQL text that Spark and DuckDB both run.

``{name}`` stands for a table; ``frame`` runs a text in Spark, ``duck`` gives it to DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"\{(\w+)\}")


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in set(_NAME.findall(text))}
    return spark.sql(text, **tables)


def duck(text: str) -> str:
    return _NAME.sub(r"\1", text)


def text_of(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR(40))"


_T = text_of("o_custkey")
_SQL_T = text_of("o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END")
_M, _N = text_of("o_orderkey % 80"), text_of("o_orderkey % 20")

#: Jobs of orders: two in seven are statements of six kinds, some are disabled, some have a filter.
JOBS = f"""
SELECT o_orderkey AS job_num, '|ALL| ' || o_orderpriority || ' || ' || o_orderstatus || ' ' AS job_names,
  ' t_' || {_T} AS target_object,
  CASE WHEN o_orderkey % 7 = 0 THEN ' sql : step' ELSE 'V_' || {_M} || '_V' END AS source_object,
  CASE WHEN o_orderkey % 3 = 1 THEN 'Append' WHEN o_orderkey % 3 = 2 THEN 'X' END AS unique_col,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 9 = 0 THEN 'k in (select k from f_' || {_N} || ' where z > 1) and d < sysdate' END AS filter_clause,
  CASE o_orderkey % 42
    WHEN 0 THEN 'INSERT INTO t_' || {_SQL_T} || ' (c1, c2, c3) SELECT a.x, sum(b.y) s, case when a.q = 1 then b.w else 0 end FROM v_' || {_M} || '_v a JOIN w_' || {_N} || ' b ON b.k = a.k WHERE a.k IN (SELECT k FROM f_' || {_N} || ' z WHERE z.p = a.p) GROUP BY a.x;'
    WHEN 7 THEN 'UPDATE t_' || {_SQL_T} || ' u SET c1 = (SELECT max(z) FROM q_' || {_N} || '), c2 = u.c3 * 2 WHERE EXISTS (SELECT 1 FROM f_' || {_N} || ')'
    WHEN 14 THEN '  DELETE FROM t_' || {_SQL_T} || ' WHERE k IN (SELECT k FROM f_' || {_N} || ') ; '
    WHEN 21 THEN 'BEGIN pkg.p_' || {_N} || '(1, ''a;b''); END;'
    WHEN 28 THEN 'MERGE INTO t_' || {_SQL_T} || ' t USING v_' || {_M} || '_v s ON (t.k = s.k) WHEN MATCHED THEN UPDATE SET t.c1 = s.x WHEN NOT MATCHED THEN INSERT (k, c1) VALUES (s.k, s.x)'
    WHEN 35 THEN 'SELECT x FROM v_' || {_M} || '_v' END AS sql_stmt,
  CASE o_orderkey % 11 WHEN 0 THEN ' y ' WHEN 1 THEN 'Deleted' WHEN 2 THEN 'no' END AS disabled_flag
FROM {{orders}}
"""

#: Jobs of which each writes its own table, and reads a view.
JOBS_OF_VIEWS = f"""
SELECT o_orderkey AS job_num, 'ALL|' || o_orderstatus || '|' || o_orderpriority AS job_names, 'T_' || {text_of("o_orderkey")} AS target_object,
  'V_' || {_M} || '_V' AS source_object, CAST(NULL AS VARCHAR(10)) AS unique_col, CAST(NULL AS VARCHAR(10)) AS filter_clause, CAST(NULL AS VARCHAR(10)) AS sql_stmt, CAST(NULL AS VARCHAR(10)) AS disabled_flag
FROM {{orders}}
"""

_I = "(r_regionkey * 25 + n_nationkey)"
_I80 = f"{_I} % 80"
#: 80 views (regions times nations, less what repeats): each reads a table and, seven times in eight, the next view.
VIEWS = f"""
SELECT DISTINCT 'ME' AS owner, 'V_' || {text_of(_I80)} || '_V' AS view_name,
  CASE WHEN {_I80} % 8 = 7 THEN 'select x, y from t_' || {text_of(_I80)}
    ELSE 'select a.x, b.y * 2 as y2 from v_' || {text_of(_I80 + " + 1")} || '_v a join t_' || {text_of(_I80)} || ' b on b.k = a.k' END AS text
FROM {{region}} CROSS JOIN {{nation}}
"""
VIEW_NUMBERS = f"SELECT DISTINCT {_I80} AS i FROM {{region}} CROSS JOIN {{nation}}"

_EDGE = "CAST(NULL AS BIGINT) AS job_num, CAST(NULL AS VARCHAR(10)) AS job_names, 'VIEW' AS action_type, 'VIEW_DEF' AS edge_origin, 'DATA' AS ref_context"
#: Supplier to part to customer to nation, without cycles.
DAG = f"""
SELECT source_node, target_node, {_EDGE}, 'N' AS is_self_loop FROM (
  SELECT 'S' || {text_of("l_suppkey")} AS source_node, 'P' || {text_of("l_partkey")} AS target_node FROM {{lineitem}}
  UNION SELECT 'P' || {text_of("l_partkey")}, 'C' || {text_of("o_custkey")} FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey
  UNION SELECT 'C' || {text_of("c_custkey")}, 'N' || {text_of("c_nationkey")} FROM {{customer}}) e
"""
#: One edge out of every part, with cycles and self loops.
CYCLIC = f"""
SELECT source_node, target_node, {_EDGE}, CASE WHEN source_node = target_node THEN 'Y' ELSE 'N' END AS is_self_loop FROM (
  SELECT 'P' || {text_of("p_partkey")} AS source_node, 'P' || {text_of("(p_partkey * (p_size + 1) + 7) % n")} AS target_node
  FROM {{part}} CROSS JOIN (SELECT count(*) AS n FROM {{part}}) c) e
"""
#: Jobs of customers and suppliers between nations: few nodes, all in cycles.
NATIONS = f"""
SELECT DISTINCT 'N' || {text_of("s_nationkey")} AS source_node, 'N' || {text_of("c_nationkey")} AS target_node, CAST(s_nationkey AS BIGINT) AS job_num,
  'ALL|G' || {text_of("s_nationkey % 4")} AS job_names, 'LOAD_REPLACE' AS action_type, 'JOB_STANDARD' AS edge_origin, 'DATA' AS ref_context,
  CASE WHEN s_nationkey = c_nationkey THEN 'Y' ELSE 'N' END AS is_self_loop
FROM {{supplier}} CROSS JOIN (SELECT DISTINCT c_nationkey FROM {{customer}}) c
"""
#: What jobs read and write: orders write their customer's table and read their items' parts.
OBJECTS = f"""
SELECT DISTINCT o_orderkey AS job_num, 'C' || {text_of("o_custkey")} AS object_name, 'TARGET' AS object_role, 'DATA' AS ref_context, 'METADATA' AS derived_from FROM {{orders}}
UNION SELECT l_orderkey, 'P' || {text_of("l_partkey")}, 'SOURCE', CASE WHEN l_linenumber % 3 = 0 THEN 'FILTER' ELSE 'DATA' END, 'METADATA' FROM {{lineitem}}
UNION SELECT l_orderkey, 'PKG.P' || {text_of("l_suppkey")}, 'CALL', 'DATA', 'SQL_PARSE' FROM {{lineitem}} WHERE l_linenumber = 1
"""
#: Column lineage: items are calculated from parts and suppliers.
LINEAGE = f"""
SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'JOB_SQL' ELSE 'VIEW_DEF' END AS lineage_origin, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey END AS job_num,
  'P' || {text_of("l_partkey")} AS target_object, CASE l_linenumber WHEN 1 THEN 'QTY' WHEN 2 THEN 'PRICE' ELSE '*' END AS target_column, l_linenumber AS column_pos,
  'e' || {text_of("l_suppkey % 10")} AS expression,
  CASE l_suppkey % 8 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'RENAME' WHEN 2 THEN 'CALCULATED' WHEN 3 THEN 'CASE' WHEN 4 THEN 'AGGREGATE' WHEN 5 THEN 'WINDOW' WHEN 6 THEN 'CONSTANT' ELSE 'STAR' END AS transform_type,
  CASE WHEN l_suppkey % 8 <> 6 THEN 'S' || {text_of("l_suppkey")} END AS source_object,
  CASE WHEN l_suppkey % 8 = 6 THEN NULL WHEN l_linenumber > 2 THEN '*' ELSE 'C' || {text_of("l_linenumber")} END AS source_column,
  CASE l_linenumber % 5 WHEN 0 THEN 'CONDITION' WHEN 1 THEN 'WINDOW' WHEN 2 THEN 'KEY' ELSE 'VALUE' END AS ref_role,
  CASE l_suppkey % 9 WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS resolution
FROM {{lineitem}}
"""
#: Dictionary columns of the tables that jobs read and write: those of a view are a part of those of a table.
COLUMNS = f"""
SELECT 'ME' AS owner, 'T_' || {text_of("c_custkey")} AS table_name, column_name, column_id FROM {{customer}} CROSS JOIN (VALUES ('K', 1), ('X', 2), ('Y', 3)) AS c(column_name, column_id)
UNION ALL SELECT 'ME', 'V_' || {text_of("i")} || '_V', column_name, column_id FROM ({VIEW_NUMBERS}) v CROSS JOIN (VALUES ('X', 1), ('Y', 2), ('Y2', 3)) AS c(column_name, column_id) WHERE i % 4 <> 3
"""
