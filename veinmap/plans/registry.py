"""Lineage queries over the driver's tables, each with the SQL that gives the same rows.

A query goes through the library's operators; its SQL computes the same from the keys of the tables, without them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.reading import read_statements
from ..functions.stable import stable
from ..operators import columns as C
from ..operators import deps, graph, jobs, reports, trace, views
from ..sources import sinks
from . import derived as D
from . import shapes
from .round_trips import ROUND_TRIPS
from .run import build
from .shapes import SHAPES

FLAGSHIP = "g8_levels"
_QUERIES: dict[str, tuple[Callable, str | None]] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable]:
    return {n: f for n, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: D.duck(s) for n, (_, s) in _QUERIES.items() if s}


# -- shared frames
def _run(spark, sf_dir: str, text: str = D.JOBS, with_views: bool = False, **options):
    more = {"views": D.frame(spark, sf_dir, D.VIEWS)} if with_views else {}
    return build(D.frame(spark, sf_dir, text), owner="ME", **more, **options)


def _edges(spark, sf_dir: str, text: str):
    """Edges or column lineage as a run has them: a written table."""
    return stable(D.frame(spark, sf_dir, text))


# -- shared SQL
_ACTIVE = "o_orderkey % 11 NOT IN (0, 1)"
_KEYS = f"SELECT o_orderkey AS k, o_custkey AS c, {_ACTIVE} AS active, o_orderkey % 42 AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS shift, 'ALL|' || o_orderpriority || '|' || o_orderstatus AS path, o_orderpriority, o_orderstatus FROM {{orders}}"
_CTE = f"WITH j AS ({_KEYS}), b AS (SELECT *, 'T_' || c AS tgt, 'T_' || (c + shift) AS sql_tgt, 'V_' || (k % 80) || '_V' AS v, k % 20 AS n FROM j WHERE active)"
_ACTION = "CASE WHEN k % 7 <> 0 THEN CASE k % 3 WHEN 1 THEN 'LOAD_APPEND' WHEN 2 THEN 'LOAD_KEYED' ELSE 'LOAD_REPLACE' END ELSE CASE kind WHEN 0 THEN 'INSERT_SELECT' WHEN 7 THEN 'UPDATE' WHEN 14 THEN 'DELETE' WHEN 21 THEN 'PLSQL_CALL' WHEN 28 THEN 'MERGE' ELSE 'SELECT' END END"
_EDGES = f"""
SELECT DISTINCT src AS source_node, dst AS target_node, k AS job_num, {_ACTION} AS action_type, origin AS edge_origin, context AS ref_context FROM (
  SELECT *, v AS src, tgt AS dst, 'JOB_STANDARD' AS origin, 'DATA' AS context FROM b WHERE k % 7 <> 0
  UNION ALL SELECT *, 'F_' || n, tgt, 'JOB_STANDARD', 'FILTER' FROM b WHERE k % 7 <> 0 AND k % 9 = 0
  UNION ALL SELECT *, v, sql_tgt, 'JOB_SQL', 'DATA' FROM b WHERE kind IN (0, 28)
  UNION ALL SELECT *, 'W_' || n, sql_tgt, 'JOB_SQL', 'DATA' FROM b WHERE kind = 0
  UNION ALL SELECT *, 'Q_' || n, sql_tgt, 'JOB_SQL', 'DATA' FROM b WHERE kind = 7
  UNION ALL SELECT *, 'F_' || n, sql_tgt, 'JOB_SQL', 'FILTER' FROM b WHERE kind IN (0, 7, 14)
  UNION ALL SELECT *, 'PKG.P_' || n, tgt, 'JOB_PLSQL', 'DATA' FROM b WHERE kind = 21) e
"""
_OBJECTS = """
SELECT DISTINCT k AS job_num, obj AS object_name, role AS object_role, context AS ref_context, derived AS derived_from FROM (
  SELECT k, tgt AS obj, 'TARGET' AS role, 'DATA' AS context, CASE WHEN k % 7 = 0 AND kind = 35 THEN 'FALLBACK' ELSE 'METADATA' END AS derived FROM b WHERE k % 7 <> 0 OR kind IN (21, 35)
  UNION ALL SELECT k, v, 'SOURCE', 'DATA', 'METADATA' FROM b WHERE k % 7 <> 0
  UNION ALL SELECT k, 'F_' || n, 'SOURCE', 'FILTER', 'METADATA' FROM b WHERE k % 7 <> 0 AND k % 9 = 0
  UNION ALL SELECT k, sql_tgt, 'TARGET', 'DATA', 'SQL_PARSE' FROM b WHERE kind IN (0, 7, 14, 28)
  UNION ALL SELECT k, v, 'SOURCE', 'DATA', 'SQL_PARSE' FROM b WHERE kind IN (0, 28)
  UNION ALL SELECT k, 'W_' || n, 'SOURCE', 'DATA', 'SQL_PARSE' FROM b WHERE kind = 0
  UNION ALL SELECT k, 'Q_' || n, 'SOURCE', 'DATA', 'SQL_PARSE' FROM b WHERE kind = 7
  UNION ALL SELECT k, 'F_' || n, 'SOURCE', 'FILTER', 'SQL_PARSE' FROM b WHERE kind IN (0, 7, 14)
  UNION ALL SELECT k, 'PKG.P_' || n, 'CALL', 'DATA', 'SQL_PARSE' FROM b WHERE kind = 21) o
"""


def _with(name: str, text: str) -> str:
    return f"WITH RECURSIVE {name} AS ({text})"


# -- rules and jobs
@_query(f"SELECT o_orderkey AS job_num, CASE WHEN {_ACTIVE} THEN 'Y' ELSE 'N' END AS is_active FROM {{orders}}")
def br1_is_disabled(spark, sf_dir):
    j = D.frame(spark, sf_dir, D.JOBS)
    return j.select("job_num", F.when(R.is_disabled(F.col("disabled_flag")) == "Y", "N").otherwise("Y").alias("is_active"))


_MESSY = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' "me".' WHEN 1 THEN 'Me.' WHEN 2 THEN 'other.' ELSE '' END || c_name || CASE WHEN c_custkey % 3 = 0 THEN '   x ' ELSE '  ' END AS name FROM {customer}"""


@_query(f"SELECT c_custkey, CASE WHEN n LIKE 'ME.%' THEN substr(n, 4) ELSE n END AS norm_name FROM (SELECT c_custkey, regexp_replace(upper(trim(replace(name, '\"', ''))), '\\s+', ' ', 'g') AS n FROM ({_MESSY}) m) x")
def br2_norm(spark, sf_dir):
    return D.frame(spark, sf_dir, _MESSY).select("c_custkey", R.norm(F.col("name"), "ME").alias("norm_name"))


@_query("SELECT o_orderkey AS job_num, CASE WHEN o_orderkey % 7 = 0 THEN 'Y' ELSE 'N' END AS label, CASE WHEN o_orderkey % 7 <> 0 THEN 'V_' || (o_orderkey % 80) || '_V' END AS source FROM {orders}")
def br3_labels(spark, sf_dir):
    j = D.frame(spark, sf_dir, D.JOBS)
    label = R.is_label(F.col("source_object"))
    return j.select("job_num", F.when(label, "Y").otherwise("N").alias("label"), F.when(~label, R.norm(F.col("source_object"))).alias("source"))


_DUAL = "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'DUAL' WHEN 1 THEN 'SYS.DUAL' WHEN 2 THEN 'O.' || p_brand ELSE 'PUBLIC.DUAL' END AS name FROM {part}"


@_query(f"SELECT p_partkey, name, CASE WHEN position('.' IN name) > 0 THEN split_part(name, '.', 1) ELSE 'ME' END AS owner, CASE WHEN position('.' IN name) > 0 THEN substr(name, position('.' IN name) + 1) ELSE name END AS object_name FROM ({_DUAL}) d WHERE name NOT IN ('DUAL', 'SYS.DUAL', 'PUBLIC.DUAL')")
def br4_br5_names(spark, sf_dir):
    d = D.frame(spark, sf_dir, _DUAL).filter(~R.is_one_row(F.col("name")))
    return d.select("p_partkey", "name", R.owner_of(F.col("name"), "ME").alias("owner"), R.name_of(F.col("name")).alias("object_name"))


_TEXTS = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' begin x; end; ' WHEN 2 THEN 'delete from t_' || o_custkey || '; ' WHEN 3 THEN '_x000D_ select 1 _x000D_' ELSE NULL END AS s FROM {orders}"


@_query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'begin x; end;' WHEN 2 THEN 'delete from t_' || o_custkey WHEN 3 THEN 'select 1' END AS sql_text FROM {orders}")
def br6_clean_sql(spark, sf_dir):
    return D.frame(spark, sf_dir, _TEXTS.replace("|| o_custkey ||", f"|| {D.text_of('o_custkey')} ||")).select("o_orderkey", R.clean_sql(F.col("s")).alias("sql_text"))


@_query(f"{_CTE} SELECT k AS job_num, CASE WHEN k % 7 <> 0 THEN 'A_STANDARD' ELSE 'B_SQL' END AS case_type, {_ACTION} AS action_type, CASE WHEN k % 7 <> 0 AND k % 3 = 2 THEN 'X' END AS load_key, CASE WHEN k % 7 <> 0 THEN 'N_A' WHEN kind = 35 THEN 'FALLBACK' ELSE 'OK' END AS parse_status, CASE WHEN k % 7 = 0 AND kind NOT IN (21, 35) AND shift = 1 THEN 'TARGET_OBJECT ' || tgt || ' differs from SQL target ' || sql_tgt END AS parse_message FROM b")
def br7_br11_classified_jobs(spark, sf_dir):
    return _run(spark, sf_dir).jobs.filter("is_active = 'Y'").select("job_num", "case_type", "action_type", "load_key", "parse_status", "parse_message")


@_query(f"{_CTE} SELECT * FROM ({_EDGES}) e")
def br12_br16_edges(spark, sf_dir):
    return _run(spark, sf_dir).edges.select("source_node", "target_node", "job_num", "action_type", "edge_origin", "ref_context")


@_query(f"{_CTE} {_OBJECTS}")
def br15_job_objects(spark, sf_dir):
    return _run(spark, sf_dir).job_objects


_LOOPS = f"SELECT o_orderkey AS job_num, 'ALL' AS job_names, 'T_' || {D.text_of('o_custkey')} AS target_object, 'SQL: x' AS source_object, CAST(NULL AS VARCHAR(10)) AS unique_col, CAST(NULL AS VARCHAR(10)) AS filter_clause, 'insert into t_' || {D.text_of('o_custkey')} || ' select * from me.t_' || {D.text_of('o_custkey + o_orderkey % 3')} AS sql_stmt, CAST(NULL AS VARCHAR(10)) AS disabled_flag FROM {{orders}}"


@_query("SELECT 'T_' || o_custkey AS node, count(*) AS loops FROM {orders} WHERE o_orderkey % 3 = 0 GROUP BY 1")
def br16_self_loops(spark, sf_dir):
    return _run(spark, sf_dir, _LOOPS, save_ast=False).edges.filter("is_self_loop = 'Y'").groupBy(F.col("source_node").alias("node")).agg(F.count(F.lit(1)).alias("loops"))


@_query(f"""{_CTE}, s AS (SELECT * FROM b WHERE k % 7 <> 0), d AS (SELECT i FROM ({D.VIEW_NUMBERS}) n WHERE i % 4 <> 3)
SELECT k AS job_num, tgt AS target_object, col AS target_column, CAST(pos AS INT) AS column_pos, v || '.' || col AS expression, 'DIRECT' AS transform_type, v AS source_object, col AS source_column, CASE WHEN k % 3 = 2 AND col = 'X' THEN 'KEY' ELSE 'VALUE' END AS ref_role, 'DICTIONARY' AS resolution
  FROM s CROSS JOIN (VALUES ('X', 2), ('Y', 3)) c(col, pos) WHERE k % 80 IN (SELECT i FROM d) AND c IN (SELECT c_custkey FROM {{customer}})
UNION ALL SELECT k, tgt, '*', NULL, v || '.*', 'STAR', v, '*', 'VALUE', 'UNEXPANDED' FROM s WHERE NOT (k % 80 IN (SELECT i FROM d) AND c IN (SELECT c_custkey FROM {{customer}}))""")
def br17_br18_standard_columns(spark, sf_dir):
    r = _run(spark, sf_dir)
    out = C.standard_lineage(r.jobs, r.job_objects, D.frame(spark, sf_dir, D.COLUMNS), "ME")
    return out.drop("lineage_origin")


_PARTS = f"WITH j AS ({_KEYS}), g AS (SELECT k, 1 AS p, 'ALL' AS name, 'ALL' AS path FROM j UNION ALL SELECT k, 2, o_orderpriority, 'ALL|' || o_orderpriority FROM j UNION ALL SELECT k, 3, o_orderstatus, path FROM j)"


@_query(f"{_PARTS} SELECT k AS job_num, name AS group_name, p AS group_pos, path AS group_path FROM g")
def h1_job_groups(spark, sf_dir):
    return jobs.job_groups(D.frame(spark, sf_dir, D.JOBS))


_GROUPED = f"{_PARTS}, b AS (SELECT *, 'T_' || c AS tgt, 'T_' || (c + shift) AS sql_tgt, 'V_' || (k % 80) || '_V' AS v, k % 20 AS n FROM j WHERE active), e AS ({_EDGES}), ge AS (SELECT g.name AS group_name, e.* FROM e JOIN g ON g.k = e.job_num)"


@_query(f"{_GROUPED} SELECT group_name, source_node, target_node, job_num, edge_origin, ref_context FROM ge")
def h3_group_edges(spark, sf_dir):
    return _run(spark, sf_dir).group_edges.select("group_name", "source_node", "target_node", "job_num", "edge_origin", "ref_context")


@_query(f"{_GROUPED}, x AS (SELECT group_name, source_node AS node_name, 1 AS s, 0 AS t FROM ge WHERE source_node <> target_node UNION ALL SELECT group_name, target_node, 0, 1 FROM ge WHERE source_node <> target_node) SELECT group_name, node_name, CASE WHEN max(t) = 0 THEN 'ROOT' WHEN max(s) = 0 THEN 'TERMINAL' ELSE 'INTERMEDIATE' END AS group_node_class FROM x GROUP BY group_name, node_name")
def h4_a4_group_node_class(spark, sf_dir):
    return jobs.group_node_class(_run(spark, sf_dir).group_edges)


@_query("SELECT o_orderkey AS job_num, row_number() OVER (ORDER BY o_orderkey) AS exec_seq FROM {orders}")
def w1_exec_seq(spark, sf_dir):
    return jobs.exec_sequence(D.frame(spark, sf_dir, "SELECT o_orderkey AS job_num FROM {orders}")).select("job_num", "exec_seq")


_RAW = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' a_x000D_ ' WHEN 1 THEN '12.0' WHEN 2 THEN '  ' ELSE 'b.0' END AS cell FROM {orders}"


@_query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN '12' WHEN 3 THEN 'b.0' END AS cell FROM {orders}")
def src3_clean_cells(spark, sf_dir):
    return D.frame(spark, sf_dir, _RAW).select("o_orderkey", R.clean_cell(F.col("cell")).alias("cell"))


@_query(f"SELECT o_orderkey AS job_num, 'T_' || o_custkey AS target_object, CASE WHEN {_ACTIVE} THEN 'Y' ELSE 'N' END AS is_active, row_number() OVER (ORDER BY o_orderkey) AS exec_seq FROM {{orders}}")
def src7_load_jobs(spark, sf_dir):
    return jobs.load_jobs(D.frame(spark, sf_dir, D.JOBS)).select("job_num", F.upper("target_object").alias("target_object"), "is_active", "exec_seq")


@_query(f"SELECT table_name AS name, string_agg(column_name, ',' ORDER BY column_id) AS cols FROM ({D.COLUMNS}) c GROUP BY table_name UNION ALL SELECT 'SYN_' || c_custkey, 'K,X,Y' FROM {{customer}} WHERE c_custkey % 2 = 0")
def src10_dictionary(spark, sf_dir):
    from ..functions.reading import columns_of

    columns = D.frame(spark, sf_dir, D.COLUMNS)
    key = D.text_of("c_custkey")
    synonyms = D.frame(spark, sf_dir, f"SELECT CASE WHEN c_custkey % 4 = 0 THEN 'ME' ELSE 'PUBLIC' END AS owner, 'SYN_' || {key} AS synonym_name, 'ME' AS table_owner, 'T_' || {key} AS table_name, CASE WHEN c_custkey % 2 = 1 THEN 'link' END AS db_link FROM {{customer}}")
    names = columns.select("owner", F.col("table_name").alias("name")).union(synonyms.select(F.lit("ME"), "synonym_name"))
    return columns_of(names, columns, synonyms).select("name", F.array_join("cols", ",").alias("cols"))


# -- reading SQL
def _read(spark, sf_dir):
    j = jobs.load_jobs(D.frame(spark, sf_dir, D.JOBS))
    s = jobs.job_statements(j, "ME").filter("id like 'J%'").withColumn("columns", F.lit(None).cast("map<string,array<string>>"))
    return read_statements(s).withColumn("job_num", F.substring("id", 2, 20).cast("long"))


@_query(f"{_CTE} SELECT k AS job_num, CASE kind WHEN 0 THEN 'INSERT' WHEN 7 THEN 'UPDATE' WHEN 14 THEN 'DELETE' WHEN 21 THEN 'PLSQL' WHEN 28 THEN 'MERGE' ELSE 'SELECT' END AS statement, CASE WHEN kind NOT IN (21, 35) THEN sql_tgt END AS target, 'OK' AS status, CAST(CASE kind WHEN 0 THEN 76 WHEN 7 THEN 31 WHEN 14 THEN 12 WHEN 21 THEN 12 WHEN 28 THEN 49 ELSE 4 END AS INT) AS tokens FROM b WHERE k % 7 = 0")
def t1_q1_statements(spark, sf_dir):
    return _read(spark, sf_dir).select("job_num", "statement", "target", "status", "tokens")


@_query(f"""{_CTE} SELECT k AS job_num, obj AS object_name, role AS object_role, ctx AS ref_context FROM (
  SELECT k, sql_tgt AS obj, 'TARGET' AS role, 'DATA' AS ctx FROM b WHERE kind IN (0, 7, 14, 28) UNION ALL SELECT k, v, 'SOURCE', 'DATA' FROM b WHERE kind IN (0, 28, 35)
  UNION ALL SELECT k, 'W_' || n, 'SOURCE', 'DATA' FROM b WHERE kind = 0 UNION ALL SELECT k, 'Q_' || n, 'SOURCE', 'DATA' FROM b WHERE kind = 7
  UNION ALL SELECT k, 'F_' || n, 'SOURCE', 'FILTER' FROM b WHERE kind IN (0, 7, 14) UNION ALL SELECT k, 'PKG.P_' || n, 'CALL', 'DATA' FROM b WHERE kind = 21) r""")
def q22_object_refs(spark, sf_dir):
    return _read(spark, sf_dir).select("job_num", F.explode("refs").alias("r")).select("job_num", "r.*")


@_query(f"""{_CTE} SELECT k AS job_num, col AS target_column, CAST(pos AS INT) AS column_pos, tr AS transform_type, obj AS source_object, scol AS source_column, role AS ref_role, 'RESOLVED' AS resolution FROM (
  SELECT k, 'C1' AS col, 1 AS pos, 'DIRECT' AS tr, v AS obj, 'X' AS scol, 'VALUE' AS role FROM b WHERE kind = 0
  UNION ALL SELECT k, 'C2', 2, 'AGGREGATE', 'W_' || n, 'Y', 'VALUE' FROM b WHERE kind = 0
  UNION ALL SELECT k, 'C3', 3, 'CASE', v, 'Q', 'CONDITION' FROM b WHERE kind = 0 UNION ALL SELECT k, 'C3', 3, 'CASE', 'W_' || n, 'W', 'VALUE' FROM b WHERE kind = 0
  UNION ALL SELECT k, 'C1', 1, 'AGGREGATE', 'Q_' || n, 'Z', 'VALUE' FROM b WHERE kind = 7 UNION ALL SELECT k, 'C2', 2, 'CALCULATED', sql_tgt, 'C3', 'VALUE' FROM b WHERE kind = 7
  UNION ALL SELECT k, 'C1', 1, 'RENAME', v, 'X', 'VALUE' FROM b WHERE kind = 28 UNION ALL SELECT k, 'K', 2, 'DIRECT', v, 'K', 'VALUE' FROM b WHERE kind = 28 UNION ALL SELECT k, 'C1', 3, 'RENAME', v, 'X', 'VALUE' FROM b WHERE kind = 28) l""")
def c11_column_lineage(spark, sf_dir):
    l = _read(spark, sf_dir).select("job_num", F.explode("lineage").alias("l")).select("job_num", "l.*")
    return l.drop("expression")


@_query(f"{_CTE} SELECT k AS job_num, col AS column_ref, clause AS where_clause FROM (SELECT k, 'A.K' AS col, 'WHERE a.k IN (SELECT k FROM f_' || n || ' z WHERE z.p = a.p)' AS clause FROM b WHERE kind = 0 UNION ALL SELECT k, x.c, 'WHERE a.k IN (SELECT k FROM f_' || n || ' z WHERE z.p = a.p)' FROM b CROSS JOIN (VALUES ('K'), ('Z.P'), ('A.P')) x(c) WHERE kind = 0 UNION ALL SELECT k, x.c, 'WHERE z.p = a.p' FROM b CROSS JOIN (VALUES ('Z.P'), ('A.P')) x(c) WHERE kind = 0 UNION ALL SELECT k, 'K', 'WHERE k IN (SELECT k FROM f_' || n || ')' FROM b CROSS JOIN (VALUES (1), (2)) x(c) WHERE kind = 14) w")
def j6_rp8_where_columns(spark, sf_dir):
    tree = _read(spark, sf_dir).select("job_num", F.explode("tree").alias("n")).select("job_num", "n.*")
    return reports.where_columns(tree, "job_num").select("job_num", "column_ref", "where_clause")


@_query(f"{_CTE} SELECT k AS job_num, CAST(node_id AS INT) AS node_id, tree, CAST(s AS INT) AS start_pos FROM b CROSS JOIN (VALUES (1, 'STATEMENT', 1), (2, '  QUERY', 1), (3, '    SELECT', 1), (4, '      SELECT_LIST', 8), (5, '        SELECT_ITEM [X]', 8), (6, '          EXPR', 8), (7, '            COLUMN_REF [X]', 8), (8, '      FROM', 10), (9, NULL, 15)) t(node_id, tree0, s), LATERAL (SELECT coalesce(tree0, '        TABLE_REF [' || v || ']') AS tree) z WHERE kind = 35")
def r2_tree_print(spark, sf_dir):
    r = _read(spark, sf_dir).filter("statement = 'SELECT'")
    tree = r.select("job_num", F.explode("tree").alias("n")).select("job_num", "n.*")
    return reports.tree_print(tree, "job_num").select("job_num", "node_id", "tree", "start_pos")


@_query("SELECT o_orderkey AS job_num, t.token_no, t.token_type, t.token_text FROM {orders}, (VALUES (1, 'ID', 'select'), (2, 'STR', 'q''[it''s]'''), (3, 'OP', '||'), (4, 'QID', 'a\"b'), (5, ',', ','), (6, 'NUM', '1.5e3'), (7, 'ID', 'from'), (8, 'ID', NULL)) t0(token_no, token_type, txt), LATERAL (SELECT token_no, token_type, coalesce(txt, 't_' || o_custkey) AS token_text) t")
def t2_token_function(spark, sf_dir):
    from ..functions.reading import register_functions

    register_functions(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("job_num"), F.concat(F.lit("select q'[it's]'||\"a\"\"b\",1.5e3 /* c */ from t_"), F.col("o_custkey").cast("string"), F.lit(" -- end")).alias("s"))
    return spark.sql("SELECT job_num, t.token_no, t.token_type, t.token_text FROM {o}, LATERAL sql_tokens(s) t", o=orders)


# -- views
_VN = f"v AS (SELECT i, 'V_' || i || '_V' AS name FROM ({D.VIEW_NUMBERS}) n)"


@_query(f"WITH RECURSIVE {_VN}, w AS (SELECT DISTINCT i, 0 AS lvl FROM v JOIN {{orders}} ON o_orderkey % 80 = i UNION SELECT v.i, w.lvl + 1 FROM w JOIN v ON v.i = w.i + 1 WHERE w.i % 8 <> 7) SELECT 'V_' || i || '_V' AS view_name, CAST(min(lvl) AS INT) AS capture_level FROM w GROUP BY i")
def g1_view_capture(spark, sf_dir):
    v = D.frame(spark, sf_dir, D.VIEWS)
    s = views.view_statements(v, "ME")
    read = read_statements(s.withColumn("columns", F.lit(None).cast("map<string,array<string>>")), False)
    starts = D.frame(spark, sf_dir, f"SELECT DISTINCT 'V_' || {D.text_of('o_orderkey % 80')} || '_V' AS name FROM {{orders}}")
    return views.capture(starts, v, views.view_refs(read, s, "ME"), None, "ME").select("view_name", "capture_level")


@_query(f"WITH {_VN} SELECT 'T_' || i AS source_node, name AS target_node, 'VIEW_DEF' AS edge_origin FROM v UNION ALL SELECT 'V_' || (i + 1) || '_V', name, 'VIEW_DEF' FROM v WHERE i % 8 <> 7 UNION ALL SELECT 'EXTRA_' || i, name, 'DB_DEPENDENCY' FROM v WHERE i % 2 = 0")
def g2_g3_view_edges(spark, sf_dir):
    v = D.frame(spark, sf_dir, D.VIEWS)
    s = views.view_statements(v, "ME")
    read = read_statements(s.withColumn("columns", F.lit(None).cast("map<string,array<string>>")), False)
    i = D.text_of("i")
    found = D.frame(spark, sf_dir, f"SELECT 'ME' AS owner, 'V_' || {i} || '_V' AS name, 'VIEW' AS type, 'ME' AS referenced_owner, CASE WHEN i % 2 = 0 THEN 'EXTRA_' || {i} ELSE 'T_' || {i} END AS referenced_name, 'TABLE' AS referenced_type, CAST(NULL AS VARCHAR(10)) AS referenced_link_name FROM ({D.VIEW_NUMBERS}) n")
    depends = views.dependency_sources(found, "ME")
    every = s.select("id", F.lit(0).alias("capture_level"))
    return views.view_edges(every, views.view_refs(read, s, "ME"), depends, s).select("source_node", "target_node", "edge_origin")


@_query(f"WITH RECURSIVE {_VN}, d AS (SELECT name AS n, 'V_' || (i + 1) || '_V' AS r, 'VIEW' AS t FROM v WHERE i % 8 <> 7 UNION ALL SELECT name, 'T_' || i, 'TABLE' FROM v), w AS (SELECT n AS root, n AS parent, r, t, 1 AS lvl FROM d UNION ALL SELECT w.root, d.n, d.r, d.t, w.lvl + 1 FROM w JOIN d ON d.n = w.r WHERE w.t = 'VIEW') SELECT root, repeat('  ', lvl - 1) || r || ' (' || t || ')' AS dependency_tree, CAST(lvl AS INT) AS depth, parent AS parent_view FROM w")
def r3_rp10_dependency_tree(spark, sf_dir):
    i = D.text_of("i")
    nxt = D.text_of("i + 1")
    found = D.frame(spark, sf_dir, f"SELECT 'ME' AS owner, 'V_' || {i} || '_V' AS name, 'VIEW' AS type, 'ME' AS referenced_owner, 'T_' || {i} AS referenced_name, 'TABLE' AS referenced_type FROM ({D.VIEW_NUMBERS}) n UNION ALL SELECT 'ME', 'V_' || {i} || '_V', 'VIEW', 'ME', 'V_' || {nxt} || '_V', 'VIEW' FROM ({D.VIEW_NUMBERS}) n WHERE i % 8 <> 7")
    roots = found.select("name").distinct()
    return views.dependency_tree(found, roots).select("root", "dependency_tree", "depth", "parent_view")


# -- graph
@_query(f"WITH e AS ({D.DAG}) SELECT source_node AS node_name FROM e UNION SELECT target_node FROM e UNION SELECT object_name FROM ({D.OBJECTS}) o")
def g4_s1_node_names(spark, sf_dir):
    return graph.node_names(D.frame(spark, sf_dir, D.DAG), D.frame(spark, sf_dir, D.OBJECTS))


_TYPED = "SELECT 'P' || {c} AS name FROM {{part}} UNION SELECT 'O.V' || {c} || '_V' FROM {{part}} UNION SELECT 'odd ' || {c} FROM {{part}} UNION SELECT 'PKG.P' || {c} FROM {{part}} WHERE p_partkey % 5 = 0"
_DICT = "SELECT 'ME' AS owner, 'P' || {c} AS object_name, CASE WHEN p_partkey % 3 = 0 THEN 'TABLE' ELSE 'SYNONYM' END AS object_type FROM {{part}} WHERE p_partkey % 2 = 0 UNION ALL SELECT 'ME', 'P' || {c}, 'MATERIALIZED VIEW' FROM {{part}} WHERE p_partkey % 4 = 0"
_PK = D.text_of("p_partkey")


@_query(f"WITH n AS ({_TYPED.format(c=_PK)}), d AS ({_DICT.format(c=_PK)}), t AS (SELECT owner, object_name, arg_min(object_type, CASE object_type WHEN 'MATERIALIZED VIEW' THEN 1 WHEN 'TABLE' THEN 2 ELSE 4 END) AS ty FROM d GROUP BY owner, object_name) SELECT name AS node_name, CASE WHEN name LIKE 'PKG.%' THEN 'PROCEDURE' WHEN name LIKE 'odd%' THEN 'PSEUDO' WHEN ty IS NOT NULL THEN ty WHEN name LIKE '%\\_V' ESCAPE '\\' THEN 'VIEW' ELSE 'TABLE' END AS node_type, CASE WHEN ty IS NOT NULL THEN 'DICTIONARY' ELSE 'HEURISTIC' END AS type_source FROM n LEFT JOIN t ON object_name = name")
def g5_src11_node_types(spark, sf_dir):
    names = D.frame(spark, sf_dir, _TYPED.format(c=_PK)).withColumnRenamed("name", "node_name")
    called = names.filter("node_name like 'PKG.%'").select(F.col("node_name").alias("object_name"), F.lit("CALL").alias("object_role"))
    return graph.node_types(names, called, D.frame(spark, sf_dir, _DICT.format(c=_PK)), "ME")


_DEGREES = "SELECT coalesce(i.n, o.n) AS node_name, coalesce(ind, 0) AS in_degree, coalesce(outd, 0) AS out_degree, coalesce(jin, 0) AS job_in_degree, coalesce(jout, 0) AS job_out_degree FROM (SELECT target_node AS n, count(DISTINCT source_node) AS ind, count(DISTINCT CASE WHEN job_num IS NOT NULL THEN source_node END) AS jin FROM e WHERE is_self_loop = 'N' GROUP BY 1) i FULL JOIN (SELECT source_node AS n, count(DISTINCT target_node) AS outd, count(DISTINCT CASE WHEN job_num IS NOT NULL THEN target_node END) AS jout FROM e WHERE is_self_loop = 'N' GROUP BY 1) o ON o.n = i.n"
_BOTH = f"{D.DAG} UNION ALL {D.NATIONS}"


@_query(f"WITH e AS ({_BOTH}) {_DEGREES}")
def a1_degrees(spark, sf_dir):
    return graph.degrees(D.frame(spark, sf_dir, _BOTH))


@_query(f"SELECT object_name AS node_name, count(DISTINCT CASE WHEN object_role = 'TARGET' THEN job_num END) AS writer_jobs, count(DISTINCT CASE WHEN object_role = 'SOURCE' THEN job_num END) AS reader_jobs, min(CASE WHEN object_role = 'TARGET' THEN job_num END) AS first_writer_job, max(CASE WHEN object_role = 'TARGET' THEN job_num END) AS last_writer_job FROM ({D.OBJECTS}) o GROUP BY object_name")
def a2_job_use(spark, sf_dir):
    return graph.job_use(D.frame(spark, sf_dir, D.OBJECTS))


_CLASS = "CASE WHEN in_degree = 0 AND out_degree = 0 THEN 'ISOLATED' WHEN in_degree = 0 THEN 'ROOT' WHEN out_degree = 0 THEN 'TERMINAL' ELSE 'INTERMEDIATE' END"
_JOBCLASS = "CASE WHEN job_in_degree = 0 AND job_out_degree = 0 THEN 'ISOLATED' WHEN job_in_degree = 0 THEN 'ROOT' WHEN job_out_degree = 0 THEN 'TERMINAL' ELSE 'INTERMEDIATE' END"


@_query(f"WITH e AS ({_BOTH}), d AS ({_DEGREES}) SELECT node_name, {_CLASS} AS node_class, {_JOBCLASS} AS job_node_class FROM d")
def g6_node_class(spark, sf_dir):
    d = graph.degrees(D.frame(spark, sf_dir, _BOTH))
    return d.select("node_name", R.node_class(F.col("in_degree"), F.col("out_degree")).alias("node_class"), R.node_class(F.col("job_in_degree"), F.col("job_out_degree")).alias("job_node_class"))


_SCC = f"{_with('e0', D.CYCLIC)}, e AS (SELECT source_node AS a, target_node AS b FROM e0 WHERE is_self_loop = 'N'), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), n AS (SELECT a AS node FROM e UNION SELECT b FROM e), c AS (SELECT x.a AS node, min(least(x.a, x.b)) AS root FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a)"


@_query(f"{_SCC} SELECT n.node, coalesce(c.root, n.node) AS root FROM n LEFT JOIN c ON c.node = n.node")
def g7_g9_strong_components(spark, sf_dir):
    return graph.strong_components(graph.graph_edges(D.frame(spark, sf_dir, D.CYCLIC)))


@_query(f"{_SCC} SELECT n.node, coalesce(c.root, n.node) AS root FROM n LEFT JOIN c ON c.node = n.node")
def g7_strong_components_by_joins(spark, sf_dir):
    return graph.strong_components(graph.graph_edges(D.frame(spark, sf_dir, D.CYCLIC)), 0)


@_query(f"{_with('e', D.DAG)}, w AS (SELECT source_node AS node, 0 AS l FROM e UNION SELECT target_node, l + 1 FROM w JOIN e ON e.source_node = w.node), m AS (SELECT node, max(l) AS dag_level FROM w GROUP BY node), d AS (SELECT node_name, {_CLASS} AS node_class FROM ({_DEGREES}) x) SELECT node_name, node_class, CAST(coalesce(dag_level, 0) AS INT) AS dag_level, 'N' AS in_cycle FROM d LEFT JOIN m ON m.node = d.node_name")
def g8_levels(spark, sf_dir):
    e = D.frame(spark, sf_dir, D.DAG)
    g = graph.graph_edges(e)
    place = graph.places(g).select(F.col("node").alias("node_name"), "dag_level", "in_cycle")
    d = graph.degrees(e).select("node_name", R.node_class(F.col("in_degree"), F.col("out_degree")).alias("node_class"))
    return d.join(place, "node_name").select("node_name", "node_class", "dag_level", "in_cycle")


@_query(f"{_with('e', D.DAG)}, r AS (SELECT target_node AS node, 1 AS hops FROM e WHERE source_node = 'S1' UNION SELECT e.target_node, r.hops + 1 FROM r JOIN e ON e.source_node = r.node) SELECT node, CAST(min(hops) AS INT) AS hops FROM r GROUP BY node")
def r1_reachable(spark, sf_dir):
    t = trace.trace_object(_edges(spark, sf_dir, D.DAG), "S1", "DOWN")
    return t.groupBy(F.col("target_node").alias("node")).agg(F.min("lvl").alias("hops"))


@_query(f"{_with('e', D.DAG)}, r AS (SELECT 'C1' AS node, 0 AS d UNION SELECT e.source_node, r.d + 1 FROM r JOIN e ON e.target_node = r.node), m AS (SELECT node, min(d) AS d FROM r GROUP BY node) SELECT CAST(m.d + 1 AS INT) AS lvl, e.source_node, e.target_node, e.edge_origin, e.ref_context, 'C1 <- ' || CASE WHEN m.d = 0 THEN '' ELSE m.node || ' <- ' END || e.source_node AS path FROM e JOIN m ON m.node = e.target_node")
def g12_trace_object(spark, sf_dir):
    return trace.trace_object(_edges(spark, sf_dir, D.DAG), " c1 ").select("lvl", "source_node", "target_node", "edge_origin", "ref_context", "path")


_FLOW = f"SELECT 'VIEW_DEF' AS lineage_origin, CAST(NULL AS BIGINT) AS job_num, target_node AS target_object, CASE WHEN substr(target_node, 1, 1) = 'C' THEN '*' ELSE 'A' END AS target_column, 1 AS column_pos, source_node || '.a' AS expression, 'DIRECT' AS transform_type, source_node AS source_object, CASE WHEN substr(target_node, 1, 1) = 'C' THEN '*' ELSE 'A' END AS source_column, 'VALUE' AS ref_role, 'RESOLVED' AS resolution FROM ({D.DAG}) e"


@_query(f"{_with('e', D.DAG)}, r AS (SELECT 'C2' AS node, 0 AS d UNION SELECT e.source_node, r.d + 1 FROM r JOIN e ON e.target_node = r.node), m AS (SELECT node, min(d) AS d FROM r GROUP BY node) SELECT CAST(m.d + 1 AS INT) AS lvl, e.target_node AS target_object, 'A' AS target_column, e.source_node AS source_object, 'A' AS source_column, 'C2.A <- ' || CASE WHEN m.d = 0 THEN '' ELSE m.node || '.A <- ' END || e.source_node || '.A' AS path FROM e JOIN m ON m.node = e.target_node")
def g13_trace_column(spark, sf_dir):
    return trace.trace_column(_edges(spark, sf_dir, _FLOW), "c2", "a").select("lvl", "target_object", "target_column", "source_object", "source_column", "path")


@_query(f"{_with('e', D.DAG)}, r AS (SELECT 'C2' AS node, 'C2.A' AS path, CAST(NULL AS VARCHAR) AS parent UNION ALL SELECT e.source_node, r.path || ' <- ' || e.source_node || '.A', r.path FROM r JOIN e ON e.target_node = r.node WHERE r.parent IS NULL), o AS (SELECT * FROM r UNION ALL SELECT s, path || ' <- ' || s || '.A', path FROM (SELECT e.source_node AS s, r.path, row_number() OVER (PARTITION BY e.source_node, r.node ORDER BY r.path) AS rn FROM r JOIN e ON e.target_node = r.node WHERE r.parent IS NOT NULL) x WHERE rn = 1) SELECT path AS id, parent AS parent_id, CASE WHEN parent IS NULL THEN node || '.A' ELSE node || '.A  [DIRECT]' END AS label FROM o")
def rp12_lineage_tree(spark, sf_dir):
    t = trace.trace_column(_edges(spark, sf_dir, _FLOW), "C2", "A")
    return trace.lineage_tree(t, "C2", "A").select("id", "parent_id", "label")


_DEPS = f"""WITH RECURSIVE {_VN}, j AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM {{orders}}), walk AS (SELECT i AS r, i, 0 AS hops FROM v UNION SELECT walk.r, v.i, walk.hops + 1 FROM walk JOIN v ON v.i = walk.i + 1 WHERE walk.i % 8 <> 7),
d AS (SELECT j.k AS job_num, w.k AS depends_on_job, 'T_' || w.k AS via_object, 'V_' || walk.r || '_V' AS read_object, walk.hops + 1 AS hops, CASE WHEN w.k < j.k THEN 'PRIOR_STEP' ELSE 'PRIOR_CYCLE' END AS dep_type FROM j JOIN walk ON walk.r = j.k % 80 JOIN j w ON w.k = walk.i WHERE w.k <> j.k)
SELECT job_num, depends_on_job, via_object, read_object, CAST(hops AS INT) AS hops, dep_type, CASE WHEN dep_type = 'PRIOR_STEP' THEN 'Y' ELSE 'N' END AS is_latest_writer, 'Y' AS same_group FROM d"""


@_query(_DEPS)
def g10_g11_job_deps(spark, sf_dir):
    return _run(spark, sf_dir, D.JOBS_OF_VIEWS, True).job_deps


_NATION_OBJECTS = f"SELECT s_suppkey AS job_num, 'N' || {D.text_of('s_nationkey')} AS object_name, CASE WHEN s_suppkey % 2 = 0 THEN 'TARGET' ELSE 'SOURCE' END AS object_role, 'DATA' AS ref_context, 'METADATA' AS derived_from FROM {{supplier}}"


@_query(f"WITH o AS ({_NATION_OBJECTS}), s AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) AS q, s_suppkey % 3 AS g FROM {{supplier}}), d AS (SELECT c.job_num, p.job_num AS depends_on_job, c.object_name AS via_object, a.q AS cq, b.q AS pq, a.g AS cg, b.g AS pg FROM o c JOIN o p ON p.object_name = c.object_name AND c.object_role = 'SOURCE' AND p.object_role = 'TARGET' JOIN s a ON a.k = c.job_num JOIN s b ON b.k = p.job_num) SELECT job_num, depends_on_job, via_object, CASE WHEN pq < cq THEN 'PRIOR_STEP' ELSE 'PRIOR_CYCLE' END AS dep_type, CASE WHEN pq = max(CASE WHEN pq < cq THEN pq END) OVER (PARTITION BY job_num, via_object) THEN 'Y' ELSE 'N' END AS is_latest_writer, CASE WHEN cg = pg THEN 'Y' ELSE 'N' END AS same_group FROM d")
def w2_j7_latest_writer(spark, sf_dir):
    objects = D.frame(spark, sf_dir, _NATION_OBJECTS)
    seq = jobs.exec_sequence(D.frame(spark, sf_dir, "SELECT s_suppkey AS job_num FROM {supplier}"))
    groups = D.frame(spark, sf_dir, f"SELECT s_suppkey AS job_num, 'G' || {D.text_of('s_suppkey % 3')} AS group_name FROM {{supplier}}")
    return deps.job_dependencies(objects, seq, D.frame(spark, sf_dir, D.NATIONS), groups).select("job_num", "depends_on_job", "via_object", "dep_type", "is_latest_writer", "same_group")


# -- aggregates and reports
@_query(f"{_PARTS} SELECT name AS group_name, count(DISTINCT k) AS jobs, count(DISTINCT CASE WHEN k % 11 NOT IN (0, 1) THEN k END) AS active_jobs, min(k) AS first_job, max(k) AS last_job FROM g GROUP BY name")
def a5_rp4_group_overview(spark, sf_dir):
    j = jobs.load_jobs(D.frame(spark, sf_dir, D.JOBS))
    return reports.group_overview(jobs.job_groups(j), j)


@_query(f"{_CTE} SELECT case_type, action_type, parse_status, count(*) AS jobs FROM (SELECT CASE WHEN k % 7 <> 0 THEN 'A_STANDARD' ELSE 'B_SQL' END AS case_type, {_ACTION} AS action_type, CASE WHEN k % 7 <> 0 THEN 'N_A' WHEN kind = 35 THEN 'FALLBACK' ELSE 'OK' END AS parse_status FROM b) x GROUP BY 1, 2, 3")
def a6_rp3_job_counts(spark, sf_dir):
    return reports.job_counts(_run(spark, sf_dir, save_ast=False).jobs)


@_query(f"{_CTE} SELECT k AS job_num, path AS job_path, 'FALLBACK' AS parse_status, 'SELECT x FROM v_' || (k % 80) || '_v' AS sql_start FROM b WHERE kind = 35")
def rp3_doubtful_jobs(spark, sf_dir):
    r = reports.doubtful_jobs(_run(spark, sf_dir, save_ast=False).jobs)
    return r.select("job_num", F.array_join(jobs.group_parts(F.col("job_names")), "|").alias("job_path"), "parse_status", "sql_start")


@_query("SELECT o_orderkey AS job_num, 't_' || o_custkey AS target_object, CASE o_orderkey % 11 WHEN 0 THEN ' y ' ELSE 'Deleted' END AS disabled_flag FROM {orders} WHERE o_orderkey % 11 IN (0, 1)")
def rp3_inactive_jobs(spark, sf_dir):
    return reports.inactive_jobs(jobs.load_jobs(D.frame(spark, sf_dir, D.JOBS))).select("job_num", "target_object", "disabled_flag")


def _dag_nodes(spark, sf_dir):
    return graph.nodes(D.frame(spark, sf_dir, D.DAG), D.frame(spark, sf_dir, D.OBJECTS))


_NODES = f"{_with('e', D.DAG)}, o AS ({D.OBJECTS}), d AS ({_DEGREES}), u AS (SELECT object_name AS n, count(DISTINCT CASE WHEN object_role = 'TARGET' THEN job_num END) AS w, count(DISTINCT CASE WHEN object_role = 'SOURCE' THEN job_num END) AS r, max(CASE WHEN object_role = 'TARGET' THEN job_num END) AS last_w, max(CASE WHEN object_role = 'CALL' THEN 1 ELSE 0 END) AS called FROM o GROUP BY 1), x AS (SELECT source_node AS n FROM e UNION SELECT target_node FROM e UNION SELECT n FROM u), lv AS (SELECT source_node AS node, 0 AS l FROM e UNION SELECT target_node, l + 1 FROM lv JOIN e ON e.source_node = lv.node), m AS (SELECT node, max(l) AS l FROM lv GROUP BY node), nodes AS (SELECT x.n AS node_name, CASE WHEN called = 1 THEN 'PROCEDURE' ELSE 'TABLE' END AS node_type, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(w, 0) AS writer_jobs, coalesce(r, 0) AS reader_jobs, last_w AS last_writer_job, CAST(coalesce(m.l, 0) AS INT) AS dag_level, CASE WHEN coalesce(in_degree, 0) = 0 AND coalesce(out_degree, 0) = 0 THEN 'ISOLATED' WHEN coalesce(in_degree, 0) = 0 THEN 'ROOT' WHEN coalesce(out_degree, 0) = 0 THEN 'TERMINAL' ELSE 'INTERMEDIATE' END AS node_class FROM x LEFT JOIN d ON d.node_name = x.n LEFT JOIN u ON u.n = x.n LEFT JOIN m ON m.node = x.n)"


@_query(f"{_NODES} SELECT node_class, node_type, count(*) AS nodes FROM nodes GROUP BY 1, 2")
def rp2_class_counts(spark, sf_dir):
    return reports.class_counts(_dag_nodes(spark, sf_dir))


@_query(f"{_NODES} SELECT node_name, node_type, 'HEURISTIC' AS type_source, out_degree, reader_jobs FROM nodes WHERE node_class = 'ROOT'")
def rp2_roots(spark, sf_dir):
    return reports.roots(_dag_nodes(spark, sf_dir))


@_query(f"{_NODES} SELECT node_name, node_type, in_degree, writer_jobs, last_writer_job, dag_level FROM nodes WHERE node_class = 'TERMINAL'")
def rp2_terminals(spark, sf_dir):
    return reports.terminals(_dag_nodes(spark, sf_dir))


@_query(f"{_NODES} SELECT node_name, node_type, in_degree, out_degree, writer_jobs, reader_jobs, dag_level, 'N' AS in_cycle FROM nodes WHERE node_class = 'INTERMEDIATE'")
def rp2_intermediates(spark, sf_dir):
    return reports.intermediates(_dag_nodes(spark, sf_dir))


@_query(f"{_SCC} SELECT node AS node_name FROM c GROUP BY node, root")
def rp2_cycle_nodes(spark, sf_dir):
    e = D.frame(spark, sf_dir, D.CYCLIC)
    g = graph.graph_edges(e)
    return graph.cycles(g).select(F.col("node").alias("node_name"))


_VIEWED = _DEPS.replace("SELECT job_num, depends_on_job, via_object, read_object, CAST(hops", "SELECT job_num, 'T_' || job_num AS consumer_target, depends_on_job, 'T_' || depends_on_job AS producer_target, via_object, read_object, CAST(hops")


@_query(f"SELECT * FROM ({_VIEWED}) z WHERE is_latest_writer = 'Y'")
def rp5_latest_writer_deps(spark, sf_dir):
    r = _run(spark, sf_dir, D.JOBS_OF_VIEWS, True, save_ast=False)
    return reports.latest_writer_deps(r.job_deps, r.loaded)


@_query("WITH o AS (SELECT s_suppkey AS k, s_nationkey AS n FROM {supplier}) SELECT DISTINCT c.k AS job_num, p.k AS depends_on_job, 'N' || c.n AS via_object FROM o c JOIN o p ON p.n = c.n WHERE c.k % 2 = 1 AND p.k % 2 = 0 AND p.k < c.k AND c.k % 3 <> p.k % 3")
def rp5_cross_group_deps(spark, sf_dir):
    d = w2_j7_latest_writer(spark, sf_dir)
    return reports.cross_group_deps(d)


@_query(f"SELECT DISTINCT target_object, target_column, transform_type, expression FROM ({D.LINEAGE}) l WHERE transform_type IN ('CALCULATED', 'CASE', 'AGGREGATE', 'WINDOW')")
def a11_rp7_calculated_columns(spark, sf_dir):
    return reports.calculated_columns(D.frame(spark, sf_dir, D.LINEAGE))


@_query(f"SELECT target_object, target_column, expression, source_column, resolution FROM ({D.LINEAGE}) l WHERE resolution IN ('AMBIGUOUS', 'UNRESOLVED')")
def rp7_unresolved_columns(spark, sf_dir):
    return reports.unresolved_columns(D.frame(spark, sf_dir, D.LINEAGE))


@_query(f"SELECT target_column, column_pos, transform_type, expression, source_object, source_column, ref_role, resolution, lineage_origin, job_num FROM ({D.LINEAGE}) l WHERE target_object = 'P7'")
def rp7_columns_of_object(spark, sf_dir):
    return reports.columns_of_object(D.frame(spark, sf_dir, D.LINEAGE), "p7")


@_query("WITH o AS (SELECT source_node, target_node, job_num FROM (SELECT 'C' || o_custkey AS source_node, o_orderpriority AS target_node, o_orderkey % 50 AS job_num, o_orderkey FROM {orders}) x WHERE o_orderkey % 3 <> 0), p AS (SELECT 'C' || o_custkey AS source_node, o_orderpriority AS target_node, o_orderkey % 50 AS job_num FROM {orders} WHERE o_orderkey % 3 <> 1) SELECT 'ADDED' AS change, * FROM (SELECT * FROM o EXCEPT SELECT * FROM p) a UNION ALL SELECT 'REMOVED', * FROM (SELECT * FROM p EXCEPT SELECT * FROM o) b")
def s3_rp9_run_diff(spark, sf_dir):
    e = D.frame(spark, sf_dir, f"SELECT 'C' || {D.text_of('o_custkey')} AS source_node, o_orderpriority AS target_node, o_orderkey % 50 AS job_num, o_orderkey FROM {{orders}}")
    return reports.run_diff(e.filter("o_orderkey % 3 <> 0"), e.filter("o_orderkey % 3 <> 1"))


@_query(f"WITH v AS ({D.VIEWS}), n AS (SELECT DISTINCT 'V_' || (o_orderkey % 100) || '_V' AS node_name FROM {{orders}}) SELECT node_name, 'ROOT' AS node_class, CAST(0 AS INT) AS dag_level, CASE WHEN text IS NULL THEN 'N' ELSE 'Y' END AS exists_in_db, CAST(length(text) AS BIGINT) AS text_length FROM n LEFT JOIN v ON v.view_name = n.node_name")
def j2_rp10_views_in_run(spark, sf_dir):
    n = D.frame(spark, sf_dir, f"SELECT DISTINCT 'V_' || {D.text_of('o_orderkey % 100')} || '_V' AS node_name, 'VIEW' AS node_type, 'ROOT' AS node_class, 0 AS dag_level FROM {{orders}}")
    return reports.views_in_run(n, D.frame(spark, sf_dir, D.VIEWS), "ME")


@_query(f"SELECT owner, view_name, 'CREATE OR REPLACE VIEW ' || owner || '.' || view_name || ' AS' || chr(10) || text AS ddl FROM ({D.VIEWS}) v WHERE view_name = 'V_5_V'")
def src13_view_ddl(spark, sf_dir):
    return reports.view_text(D.frame(spark, sf_dir, D.VIEWS), "v_5_v", "ME")


@_query(f"SELECT table_name AS view_name, column_id, column_name FROM ({D.COLUMNS}) c WHERE table_name LIKE 'V%'")
def rp10_view_columns(spark, sf_dir):
    n = D.frame(spark, sf_dir, D.VIEWS).select(F.col("view_name").alias("node_name"), F.lit("VIEW").alias("node_type"))
    return reports.view_columns(n, D.frame(spark, sf_dir, D.COLUMNS), "ME")


@_query(f"WITH l AS ({D.LINEAGE}), o AS (SELECT target_object AS n FROM l UNION SELECT source_object FROM l WHERE source_object IS NOT NULL) SELECT n AS display_value, n AS return_value, CASE WHEN p_partkey IS NULL THEN 'UNKNOWN' ELSE 'TABLE' END AS node_type, CASE WHEN p_partkey IS NULL THEN '-' ELSE 'ROOT' END AS node_class FROM o LEFT JOIN {{part}} ON n = 'P' || p_partkey AND p_size > 10")
def rp11_object_choices(spark, sf_dir):
    n = D.frame(spark, sf_dir, f"SELECT 'P' || {_PK} AS node_name, 'TABLE' AS node_type, 'ROOT' AS node_class FROM {{part}} WHERE p_size > 10")
    return reports.object_choices(D.frame(spark, sf_dir, D.LINEAGE), n)


@_query(f"WITH l AS ({D.LINEAGE}) SELECT object_name, column_name, CAST(min(p) AS INT) AS column_pos FROM (SELECT target_object AS object_name, target_column AS column_name, column_pos AS p FROM l WHERE target_column <> '*' UNION ALL SELECT source_object, source_column, NULL FROM l WHERE source_object IS NOT NULL AND source_column IS NOT NULL AND source_column <> '*') x GROUP BY 1, 2")
def s2_rp11_column_choices(spark, sf_dir):
    return reports.column_choices(D.frame(spark, sf_dir, D.LINEAGE))


@_query(f"""WITH l AS (SELECT *, CASE transform_type WHEN 'WINDOW' THEN 6 WHEN 'AGGREGATE' THEN 5 WHEN 'CASE' THEN 4 WHEN 'CALCULATED' THEN 3 WHEN 'RENAME' THEN 2 WHEN 'DIRECT' THEN 1 ELSE 0 END AS rk FROM ({D.LINEAGE}) l0)
SELECT target_object, target_column, CAST(min(column_pos) AS INT) AS column_pos, max(expression) AS expression, max(CASE WHEN rk = top THEN transform_type END) AS transform_type,
  string_agg(CASE WHEN ref_role = 'VALUE' AND source_object IS NOT NULL THEN source_object || '.' || source_column END, ', ' ORDER BY source_object, source_column) AS value_sources,
  string_agg(CASE WHEN ref_role IN ('CONDITION', 'WINDOW', 'KEY') AND source_object IS NOT NULL THEN source_object || '.' || source_column || ' (' || lower(ref_role) || ')' END, ', ' ORDER BY source_object, source_column, ref_role) AS condition_sources,
  max(lineage_origin) AS lineage_origin, string_agg(DISTINCT CAST(job_num AS VARCHAR), ', ' ORDER BY CAST(job_num AS VARCHAR)) AS job_nums, max(CASE WHEN resolution IN ('AMBIGUOUS', 'UNRESOLVED') THEN 'Y' ELSE 'N' END) AS has_unresolved
FROM (SELECT *, max(rk) OVER (PARTITION BY target_object, target_column) AS top FROM l) t GROUP BY target_object, target_column""")
def a7_a10_column_calculation(spark, sf_dir):
    return reports.column_calculation(D.frame(spark, sf_dir, D.LINEAGE))


# -- sinks
@_query("SELECT o_orderkey AS job_num, 'insert into book_jobs (job_num, job_names, target_object, source_object, unique_col, filter_clause, sql_stmt, disabled_flag) values (' || chr(10) || '  ' || o_orderkey || ', q''[ALL]'', q''[T]'', null, null, null, ' || CASE WHEN o_orderkey % 2 = 0 THEN 'to_clob(''a]''''b'')' ELSE 'null' END || ', null);' AS statement FROM {orders}")
def snk4_load_script(spark, sf_dir):
    none = "CAST(NULL AS VARCHAR(10))"
    j = D.frame(spark, sf_dir, f"SELECT o_orderkey AS job_num, 'ALL' AS job_names, 'T' AS target_object, {none} AS source_object, {none} AS unique_col, {none} AS filter_clause, CASE WHEN o_orderkey % 2 = 0 THEN 'a]#b' END AS sql_stmt, {none} AS disabled_flag FROM {{orders}}")
    return sinks.load_script(j.withColumn("sql_stmt", F.replace("sql_stmt", F.lit("#"), F.lit("'"))))


@_query(f"""WITH e0 AS ({D.NATIONS}), e AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY job_num, source_node, target_node) AS n FROM (SELECT *, 'G' || (job_num % 4) AS g FROM e0 WHERE is_self_loop = 'N') z),
ends AS (SELECT g, node, min((n - 1) * 2 + side) AS f FROM (SELECT g, n, 0 AS side, source_node AS node FROM e UNION ALL SELECT g, n, 1, target_node FROM e) x GROUP BY g, node),
firsts AS (SELECT node, g, f, row_number() OVER (PARTITION BY node ORDER BY g, f) AS r FROM ends), ids AS (SELECT node, 'n' || (row_number() OVER (ORDER BY g, f) - 1) AS id FROM firsts WHERE r = 1),
lines AS (SELECT DISTINCT g, CAST(-1.0 AS DOUBLE) AS o, '' AS o2, 'flowchart LR' AS line FROM e UNION ALL SELECT g, f / 2 + (f % 2) * 0.1, '', '  ' || id || '["' || ends.node || '"]' FROM ends JOIN ids ON ids.node = ends.node
  UNION ALL SELECT g, (n - 1) + 0.9, '', '  ' || a.id || ' -->|' || job_num || ' LOAD_REPLACE| ' || b.id FROM e JOIN ids a ON a.node = source_node JOIN ids b ON b.node = target_node
  UNION ALL SELECT g, 1e9, ends.node, '  style ' || id || ' fill:#fff8e1,stroke:#f9a825' FROM ends JOIN ids ON ids.node = ends.node)
SELECT g AS group_name, row_number() OVER (PARTITION BY g ORDER BY o, o2) AS line_no, line FROM lines""")
def snk3_flowcharts(spark, sf_dir):
    e = D.frame(spark, sf_dir, D.NATIONS)
    groups = e.select("job_num", F.concat(F.lit("G"), (F.col("job_num") % 4).cast("string")).alias("group_name")).distinct()
    nodes = graph.node_names(e).withColumn("job_node_class", F.lit("INTERMEDIATE"))
    return sinks.flowcharts(e, groups, nodes)


@_query(f"{_NODES} SELECT 'jobs' AS item, count(*) AS n FROM {{orders}} UNION ALL SELECT 'active jobs', count(*) FROM {{orders}} WHERE {_ACTIVE} UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'nodes in cycles', 0 UNION ALL SELECT 'class ' || node_class, count(*) FROM nodes GROUP BY node_class")
def snk6_a12_summary(spark, sf_dir):
    j = jobs.load_jobs(D.frame(spark, sf_dir, D.JOBS))
    return sinks.summary(j, _dag_nodes(spark, sf_dir), D.frame(spark, sf_dir, D.DAG))


@_query(f"{_CTE}, e AS ({_EDGES}), o AS ({_OBJECTS}), n AS (SELECT source_node AS x FROM e UNION SELECT target_node FROM e UNION SELECT object_name FROM o) SELECT 'COMPLETED' AS status, (SELECT count(*) FROM j) AS rows_read, (SELECT count(*) FROM b) AS rows_active, (SELECT count(*) FROM j WHERE NOT active) AS rows_disabled, (SELECT count(*) FROM b WHERE k % 7 = 0 AND kind <> 35) AS sql_parsed, (SELECT count(*) FROM b WHERE kind = 35) AS sql_fallback, CAST(0 AS BIGINT) AS views_captured, (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM e) AS edge_count")
def rp1_a12_run_counters(spark, sf_dir):
    return _run(spark, sf_dir, save_ast=False).run_row().drop("run_id", "run_label", "message", "started_at", "finished_at")


# -- statements of many shapes; round trips through files, tables, saved runs and streams
for _name in SHAPES:
    _QUERIES[_name] = (partial(lambda spark, sf_dir, name: shapes.said(spark, sf_dir, name), name=_name), shapes.said_sql(_name))
for _name, (_query_of, _sql) in ROUND_TRIPS.items():
    _QUERIES[_name] = (_query_of, _sql.replace("{cte}", _CTE).replace("{edges}", _EDGES))


@_query("SELECT o_orderkey AS job_num, node_id, node_type, node_name FROM {orders}, (VALUES (1, 'STATEMENT', NULL), (2, 'QUERY', NULL), (3, 'SELECT', NULL), (4, 'SELECT_LIST', NULL), (5, 'SELECT_ITEM', 'X'), (6, 'EXPR', NULL), (7, 'COLUMN_REF', 'X'), (8, 'FROM', NULL), (9, 'TABLE_REF', 'T')) v(node_id, node_type, n0), LATERAL (SELECT CASE n0 WHEN 'T' THEN 'T_' || o_custkey ELSE n0 END AS node_name) z")
def q21_parse_tree_function(spark, sf_dir):
    from ..functions.reading import register_functions

    register_functions(spark)
    o = D.frame(spark, sf_dir, f"SELECT o_orderkey AS job_num, 'select x from t_' || {D.text_of('o_custkey')} AS s FROM {{orders}}")
    return spark.sql("SELECT job_num, t.node_id, t.node_type, t.node_name FROM {o}, LATERAL sql_parse_tree(s) t", o=o)
