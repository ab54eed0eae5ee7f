"""Queries that write the driver's tables by a sink and read them back by a source, or save runs and open them again.

Files go below the folder that driver and executors share (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stable import shared_folder, stable
from ..operators.jobs import JOB_COLUMNS
from ..operators import trace
from ..sources import sinks, tables
from ..streaming.jobs import follow
from . import derived as D
from .run import build
from .saved import latest_run, open_run, run_and_save


def fresh(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(data)
    out.close()


def workbook(rows: list[tuple]) -> bytes:
    """A workbook of one sheet of text cells (None: no cell)."""
    name = lambda i: chr(65 + i)
    line = lambda r, row: "".join(f'<c r="{name(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for i, v in enumerate(row) if v is not None)
    sheet = "".join(f'<row r="{r}">{line(r, row)}</row>' for r, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


# -- job tables. One order in ten has no number; a cell has debris of a loader.
_KEY = D.text_of("o_orderkey")
SHEET = f"""
SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN {_KEY} || '.0' ELSE ' ' || {_KEY} END AS job_num, 'ALL|' || o_orderpriority AS job_names,
  'T "q", ' || {_KEY} || '_x000D_' AS target_object, CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE 'S' END AS source_object, CAST(NULL AS VARCHAR(10)) AS unique_col,
  CAST(NULL AS VARCHAR(10)) AS filter_clause, 'select 1' || chr(10) || 'from t' AS sql_stmt, o_orderstatus AS disabled_flag
FROM {{orders}}
"""
_READ = "SELECT o_orderkey AS job_num, 'ALL|' || o_orderpriority AS job_names, 'T \"q\", ' || o_orderkey AS target_object, CASE WHEN o_orderkey % 3 <> 0 THEN 'S' END AS source_object, 'select 1' || chr(10) || 'from t' AS sql_stmt, o_orderstatus AS disabled_flag FROM {orders} WHERE o_orderkey % 10 <> 0"
_SHOWN = ["job_num", "job_names", "target_object", "source_object", "sql_stmt", "disabled_flag"]

_NATION_SHEET = f"SELECT CASE WHEN n_nationkey % 5 <> 4 THEN {D.text_of('n_nationkey')} || '.0' END AS job_num, ' ALL|' || n_name AS job_names, 'T&<' || n_name AS target_object, 'S' AS source_object, CAST(NULL AS VARCHAR(10)) AS unique_col, CAST(NULL AS VARCHAR(10)) AS filter_clause, CAST(NULL AS VARCHAR(10)) AS sql_stmt, 'y' AS disabled_flag FROM {{nation}}"


def src1_workbook(spark, sf_dir):
    rows = [tuple(r) for r in D.frame(spark, sf_dir, _NATION_SHEET).collect()]  # the 25 nations
    at = fresh(spark, "book.xlsx")
    put_bytes(spark, at, workbook([tuple(c.upper() for c in JOB_COLUMNS), *rows]))
    return tables.read_jobs_workbook(spark, at).select("job_num", "job_names", "target_object", "source_object", "disabled_flag")


def src2_jobs_csv(spark, sf_dir):
    at = fresh(spark, "csv")
    d = D.frame(spark, sf_dir, SHEET)
    d.select(*[F.col(c).alias(c.upper()) for c in d.columns]).write.csv(at, header=True, quote='"', escape='"')
    return tables.read_jobs_csv(spark, at).select(*_SHOWN)


def src4_jobs_parquet(spark, sf_dir):
    at = fresh(spark, "parquet")
    D.frame(spark, sf_dir, SHEET).write.parquet(at)
    return tables.read_jobs_parquet(spark, at).select(*_SHOWN)


def src5_load_into_table(spark, sf_dir):
    name = f"veinmap_jobs_{uuid.uuid4().hex}"
    d = D.frame(spark, sf_dir, SHEET)
    for truncate in (False, False, True):  # the last load replaces the two before
        tables.load_into_table(d, name, truncate)
    out = stable(tables._jobs(tables.read_jobs_table(spark, name)).select(*_SHOWN))
    spark.sql(f"DROP TABLE {name}")
    return out


_SCRIPTED = f"SELECT o_orderkey AS job_num, 'ALL|' || o_orderpriority AS job_names, 'T_' || {_KEY} AS target_object, CASE WHEN o_orderkey % 3 <> 0 THEN 'it''s [' || o_orderstatus || ']' END AS source_object, CAST(NULL AS VARCHAR(10)) AS unique_col, CAST(NULL AS VARCHAR(10)) AS filter_clause, CASE o_orderkey % 3 WHEN 0 THEN 'a]''b, (c);' || chr(10) || 'null' WHEN 1 THEN 'select ''x''' END AS sql_stmt, o_orderstatus AS disabled_flag FROM {{orders}}"


def src6_load_script(spark, sf_dir):
    return tables.jobs_of_script(sinks.load_script(D.frame(spark, sf_dir, _SCRIPTED)).select("statement"))


def src9_views_csv(spark, sf_dir):
    at = fresh(spark, "views")
    v = D.frame(spark, sf_dir, D.VIEWS)
    v.select(F.lower("owner").alias("OWNER"), F.lower("view_name").alias("VIEW_NAME"), F.concat(F.col("text"), F.lit('\n-- "quoted", long '), F.repeat(F.lit("x"), 5000)).alias("VIEW_TEXT")).write.csv(at, header=True, quote='"', escape='"')
    return tables.read_views_csv(spark, at).select("owner", "view_name", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


# -- saved runs
def _saved(spark, sf_dir, **options):
    at = fresh(spark, "runs")
    run_and_save(build(D.frame(spark, sf_dir, D.JOBS), owner="ME", run_id=2, label="second", **options), at)
    return open_run(spark, at), at


def snk1_saved_parses(spark, sf_dir):
    run, _ = _saved(spark, sf_dir)
    parses, tree, lineage = run.frame("parses"), run.frame("ast"), run.frame("column_lineage")
    nodes = tree.groupBy("id").agg(F.count(F.lit(1)).alias("nodes"))
    rows = lineage.filter("lineage_origin = 'JOB_SQL'").groupBy("job_num").agg(F.count(F.lit(1)).alias("lineage_rows"))
    out = parses.join(nodes, "id", "left").join(rows, "job_num", "left")
    return out.select("job_num", "statement", "status", (F.col("nodes") == F.col("ast_nodes")).alias("whole_tree"), F.coalesce("lineage_rows", F.lit(0)).cast("long").alias("lineage_rows"))


def snk2_csv_frames(spark, sf_dir):
    run = build(D.frame(spark, sf_dir, D.JOBS), owner="ME", save_ast=False)
    at = fresh(spark, "frames")
    sinks.save_csv({"edges": run.edges}, at)
    kinds = "source_node string, target_node string, job_num long, action_type string, edge_origin string, ref_context string"
    read = spark.read.csv(f"{at}/edges", header=True, quote='"', escape='"')
    return read.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in kinds.split(", ")])


def snk5_view_script(spark, sf_dir):
    names = D.frame(spark, sf_dir, f"SELECT DISTINCT 'V_' || {D.text_of('o_orderkey % 1200')} AS node_name FROM {{orders}}")
    return sinks.view_script_lines(names, "me")


def snk7_run_rows(spark, sf_dir):
    _, at = _saved(spark, sf_dir, save_ast=False)
    broken = build(D.frame(spark, sf_dir, D.JOBS).withColumn("job_names", F.raise_error(F.lit("broken source")).cast("string")), owner="ME", run_id=3)
    try:
        run_and_save(broken, at)
    except Exception:  # noqa: BLE001 - the failure is what the row must tell
        pass
    rows = spark.read.parquet(f"{at}/runs")
    return rows.select(F.col("run_id").cast("long").alias("run_id"), "run_label", "status", F.contains("message", F.lit("broken source")).alias("told"), "rows_read", F.col("finished_at").isNotNull().alias("finished"))


def o2_latest_run(spark, sf_dir):
    _, at = _saved(spark, sf_dir, save_ast=False)
    run_and_save(build(D.frame(spark, sf_dir, D.JOBS).limit(0), owner="ME", run_id=5), at)
    last = latest_run(spark.read.parquet(f"{at}/runs")).select(F.col("run_id").cast("long").alias("run_id"))
    return last.withColumn("edges", F.lit(open_run(spark, at).frame("edges").count()))


def o3_depth_limits(spark, sf_dir):
    e = stable(D.frame(spark, sf_dir, D.DAG))
    parts = [trace.trace_object(e, "S1", "DOWN", depth).groupBy(F.lit(depth).alias("depth")).agg(F.count(F.lit(1)).alias("n"), F.max("lvl").alias("deepest")) for depth in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def traces_from_sql(spark, sf_dir):
    run, _ = _saved(spark, sf_dir, save_ast=False)
    return run.sql("SELECT t.source_node, t.target_node, t.job_num, t.ref_context, n.job_node_class FROM trace_object('F_3', 'DOWN', 1) t JOIN {nodes} n ON n.node_name = t.source_node")


def st1_followed_jobs(spark, sf_dir):
    """Changes of jobs as a stream: each order's job is made, some get another target later, some are deleted."""
    key = D.text_of("o_custkey")
    none = ", ".join(f"CAST(NULL AS VARCHAR(10)) AS {c}" for c in ("unique_col", "filter_clause", "sql_stmt", "disabled_flag"))
    first = f"SELECT o_orderkey AS job_num, 'ALL' AS job_names, 'T_' || {key} AS target_object, 'S_' || {key} AS source_object, {none}, o_orderdate AS changed_at, false AS deleted FROM {{orders}}"
    later = f"SELECT o_orderkey, 'ALL', 'U_' || {key}, 'S_' || {key}, NULL, NULL, NULL, NULL, o_orderdate + INTERVAL 1 DAY, o_orderkey % 3 = 0 FROM {{orders}} WHERE o_orderkey % 2 = 0"
    log = fresh(spark, "changes")
    d = D.frame(spark, sf_dir, f"{first} UNION ALL {later}")
    d.write.parquet(log)
    at = fresh(spark, "followed")
    q = follow(spark.readStream.schema(d.schema).parquet(log), fresh(spark, "log"), at, fresh(spark, "progress"), owner="ME", save_ast=False)
    q.awaitTermination()
    return open_run(spark, at).frame("edges").select("source_node", "target_node", "job_num")


_MISSING = "(SELECT string_agg('''' || v || '''', ', ' ORDER BY v) FROM (SELECT v FROM v ORDER BY v LIMIT {n}) x)"
_CHUNKS = "SELECT (r - 1) // 500 AS c, string_agg('''' || v || '''', ', ' ORDER BY v) AS l FROM (SELECT v, row_number() OVER (ORDER BY v) AS r FROM v) x GROUP BY 1"
_WHERE = "' where owner = ''ME'' and view_name in (' || l || ') order by view_name;'"

#: name: (query, SQL); ``{edges}`` and ``{cte}`` are filled in by the registry.
ROUND_TRIPS = {
    "src1_workbook": (src1_workbook, "SELECT CAST(n_nationkey AS BIGINT) AS job_num, 'ALL|' || n_name AS job_names, 'T&<' || n_name AS target_object, 'S' AS source_object, 'y' AS disabled_flag FROM {nation} WHERE n_nationkey % 5 <> 4"),
    "src2_jobs_csv": (src2_jobs_csv, _READ),
    "src4_jobs_parquet": (src4_jobs_parquet, _READ),
    "src5_load_into_table": (src5_load_into_table, _READ),
    "src6_load_script": (src6_load_script, _SCRIPTED.format(orders="{orders}")),
    "src9_views_csv": (src9_views_csv, f"SELECT owner, view_name, CAST(length(t) AS BIGINT) AS chars, md5(t) AS digest FROM (SELECT *, text || chr(10) || '-- \"quoted\", long ' || repeat('x', 5000) AS t FROM ({D.VIEWS}) v0) v"),
    "snk1_saved_parses": (snk1_saved_parses, "{cte} SELECT k AS job_num, CASE kind WHEN 0 THEN 'INSERT' WHEN 7 THEN 'UPDATE' WHEN 14 THEN 'DELETE' WHEN 21 THEN 'PLSQL' WHEN 28 THEN 'MERGE' ELSE 'SELECT' END AS statement, 'OK' AS status, true AS whole_tree, CAST(CASE kind WHEN 0 THEN 4 WHEN 7 THEN 2 WHEN 28 THEN 3 ELSE 0 END AS BIGINT) AS lineage_rows FROM b WHERE k % 7 = 0"),
    "snk2_csv_frames": (snk2_csv_frames, "{cte} SELECT * FROM ({edges}) e"),
    "snk5_view_script": (snk5_view_script, "WITH v AS (SELECT DISTINCT 'V_' || (o_orderkey % 1200) AS v FROM {orders}), ch AS (" + _CHUNKS + ") SELECT '-- ' || (SELECT count(*) FROM v) || ' views' AS line UNION ALL SELECT s FROM (VALUES ('set define off'), ('set long 2000000'), ('set longchunksize 32767'), ('set pagesize 0'), ('set linesize 32767'), ('set trimspool on'), ('exec dbms_metadata.set_transform_param(dbms_metadata.session_transform, ''SQLTERMINATOR'', true);'), ('exec dbms_metadata.set_transform_param(dbms_metadata.session_transform, ''PRETTY'', true);')) z(s)"
        " UNION ALL SELECT 'select owner, view_name, text_length, text_vc from all_views' || " + _WHERE + " FROM ch UNION ALL SELECT 'select dbms_metadata.get_ddl(''VIEW'', view_name, owner) as ddl from all_views' || " + _WHERE + " FROM ch"
        " UNION ALL SELECT 'select v.column_value as missing_view from table(sys.odcivarchar2list(' || " + _MISSING.format(n=999) + " || ')) v where not exists (select 1 from all_views a where a.owner = ''ME'' and a.view_name = v.column_value);'"
        " UNION ALL SELECT '-- select table_schema, table_name, view_definition from information_schema.views where table_name in (' || " + _MISSING.format(n=50) + " || CASE WHEN (SELECT count(*) FROM v) > 50 THEN ', ...' ELSE '' END || ');'"),
    "snk7_run_rows": (snk7_run_rows, "SELECT CAST(2 AS BIGINT) AS run_id, 'second' AS run_label, 'COMPLETED' AS status, CAST(NULL AS BOOLEAN) AS told, (SELECT count(*) FROM {orders}) AS rows_read, true AS finished UNION ALL SELECT 3, NULL, 'FAILED', true, NULL, true"),
    "o2_latest_run": (o2_latest_run, "SELECT CAST(5 AS BIGINT) AS run_id, CAST(0 AS BIGINT) AS edges"),
    "o3_depth_limits": (o3_depth_limits, "WITH RECURSIVE e AS (" + D.DAG + "), r AS (SELECT 'S1' AS node, 0 AS d UNION SELECT e.target_node, r.d + 1 FROM r JOIN e ON e.source_node = r.node), m AS (SELECT node, min(d) AS d FROM r GROUP BY node), x AS (SELECT m.d + 1 AS lvl FROM e JOIN m ON m.node = e.source_node) SELECT CAST(t.depth AS INT) AS depth, count(*) AS n, CAST(max(lvl) AS INT) AS deepest FROM (VALUES (1), (2), (3)) t(depth) JOIN x ON x.lvl <= t.depth GROUP BY 1"),
    "traces_from_sql": (traces_from_sql, "{cte}, e AS ({edges}), r AS (SELECT * FROM e WHERE source_node = 'F_3' AND source_node <> target_node), ins AS (SELECT 1 FROM e WHERE target_node = 'F_3' AND source_node <> target_node) SELECT source_node, target_node, job_num, ref_context, CASE WHEN EXISTS (SELECT 1 FROM ins) THEN 'INTERMEDIATE' ELSE 'ROOT' END AS job_node_class FROM r"),
    "st1_followed_jobs": (st1_followed_jobs, "SELECT 'S_' || o_custkey AS source_node, CASE WHEN o_orderkey % 2 = 0 THEN 'U_' ELSE 'T_' END || o_custkey AS target_node, o_orderkey AS job_num FROM {orders} WHERE NOT (o_orderkey % 2 = 0 AND o_orderkey % 3 = 0)"),
}
