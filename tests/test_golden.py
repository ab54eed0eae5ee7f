"""A whole run over the fixture sheet, without and with the small warehouse behind it."""

import pytest
from pyspark.sql import functions as F

from veinmap.plans.run import build
from veinmap.sources.tables import read_jobs_csv, read_views_csv


def _csv(spark, path):
    return spark.read.csv(str(path), header=True)


@pytest.fixture(scope="module")
def sheet(spark, fixtures):
    return build(read_jobs_csv(spark, str(fixtures / "jobs.csv")), owner="ME")


@pytest.fixture(scope="module")
def full(spark, fixtures):
    columns = _csv(spark, fixtures / "columns.csv").selectExpr("owner", "table_name", "column_name", "cast(column_id as int) column_id")
    views = read_views_csv(spark, str(fixtures / "views.csv"))
    objects = columns.select("owner", F.col("table_name").alias("object_name")).distinct().join(views.select("owner", F.col("view_name").alias("object_name"), F.lit("VIEW").alias("object_type")), ["owner", "object_name"], "left").na.fill("TABLE", ["object_type"])
    return build(read_jobs_csv(spark, str(fixtures / "jobs.csv")), owner="ME", views=views, columns=columns, objects=objects)


def _counts(df, *by):
    return {tuple(r[:-1]) if len(by) > 1 else r[0]: r[-1] for r in df.groupBy(*by).count().collect()}


def test_jobs(sheet):
    j = sheet.jobs
    assert _counts(j, "is_active") == {"Y": 375, "N": 31}
    got = _counts(j.filter("is_active = 'Y'"), "case_type", "action_type")
    assert got == {("A_STANDARD", "LOAD_REPLACE"): 203, ("A_STANDARD", "LOAD_KEYED"): 53, ("A_STANDARD", "LOAD_APPEND"): 24, ("B_SQL", "DELETE"): 41, ("B_SQL", "INSERT_SELECT"): 37, ("B_SQL", "UPDATE"): 11, ("B_SQL", "PLSQL_CALL"): 6}
    assert j.filter("parse_status = 'FALLBACK'").count() == 0
    assert sorted(r[0] for r in j.select("exec_seq").collect()) == list(range(1, 407))


def test_groups(spark, sheet, fixtures):
    want = {(int(r.JOB_NUM), r.GROUP_NAME, int(r.GROUP_POS), r.GROUP_PATH) for r in _csv(spark, fixtures / "job_groups.csv").collect()}
    got = {tuple(r) for r in sheet.groups.collect()}
    assert got == want and len(got) == 734


def test_edges(spark, sheet, fixtures):
    want = {(int(r[0]), *r[1:]) for r in _csv(spark, fixtures / "edges.csv").collect()}
    got = sheet.edges.filter("is_self_loop = 'N'").select("job_num", "source_node", "target_node", "action_type", "ref_context")
    assert {tuple(r) for r in got.collect()} == want
    assert sheet.edges.count() == 354


def test_nodes(spark, sheet, fixtures):
    assert _counts(sheet.nodes, "job_node_class") == {"ROOT": 305, "TERMINAL": 281, "INTERMEDIATE": 14, "ISOLATED": 6}
    want = {r[0]: r[1] for r in _csv(spark, fixtures / "node_class.csv").collect()}
    got = {r[0]: r[1] for r in sheet.nodes.select("node_name", "job_node_class").collect()}
    assert {k: got[k] for k in want} == want


def test_deps(spark, sheet, fixtures):
    want = {(int(r[0]), int(r[1]), r[2], r[3], int(r[4]), r[5], r[6], r[7]) for r in _csv(spark, fixtures / "job_deps.csv").collect()}
    assert {tuple(r) for r in sheet.job_deps.collect()} == want


def test_views(full):
    v = {r.view_name: r.capture_level for r in full.captured.collect()}
    assert len(v) == 7 and v["BKG_BASE_V"] == 1
    assert full.parses.filter("source_kind = 'VIEW' and status <> 'OK'").count() == 0


def test_edges_of_jobs(full):
    e = full.edges
    one = lambda cond, col: [r[0] for r in e.filter(cond).select(col).collect()]
    assert one("job_num = 125 and source_node = 'APP_SNAP_BKG_V' and target_node = 'SNAP_BKG'", "edge_origin") == ["JOB_SQL"]
    assert one("job_num = 124 and source_node = 'LKP_A_PULL_VAR' and target_node = 'SNAP_BKG'", "ref_context") == ["FILTER"]
    assert len(one("job_num = 39 and source_node = 'STG_SCD_CON_S5' and target_node = 'SCD_CON_DTL'", "ref_context")) == 2
    assert one("job_num = 230 and source_node = 'CON_DL.SEND_CON_UPDATES'", "edge_origin") == ["JOB_PLSQL"]


def test_node_types(full):
    n = {r.node_name: r for r in full.nodes.collect()}
    assert n["CON_DL.SEND_CON_UPDATES"].node_type == "PROCEDURE"
    assert n["STATUS EMAIL"].node_type == "PSEUDO"
    assert n["SRC_FX_RATE"].node_class == "ROOT" and n["RPT_DAILY_LIST_1C"].node_class == "TERMINAL"
    assert sum(r.in_cycle == "Y" for r in n.values()) == 4


def test_dependency_through_views(full):
    got = [tuple(r) for r in full.job_deps.filter("job_num = 125 and depends_on_job = 54").select("hops", "dep_type", "is_latest_writer").collect()]
    assert got == [(2, "PRIOR_STEP", "Y")]


def test_columns(full):
    c = full.column_lineage
    one = lambda cond: [f"{r.transform_type}:{r.source_object}.{r.source_column}" for r in c.filter(cond).collect()]
    assert one("target_object = 'APP_SNAP_BKG_V' and target_column = 'TCV_USD'") == ["AGGREGATE:BKG_BASE_V.AMT_USD"]
    assert len(one("target_object = 'STG_SCD_CON_S5_V' and target_column = 'AMT_USD'")) == 2
    assert len(one("target_object = 'STG_SCD_CON_S5_V' and target_column = 'CHANGE_TYPE' and ref_role = 'CONDITION'")) == 4
    assert one("job_num = 39 and target_column = 'DTL_SNAP_END_DATE'") == ["AGGREGATE:STG_SCD_CON_S5.DTL_SNAP_DATE"]
    assert len(one("job_num = 125 and resolution = 'DICTIONARY'")) == 8
    assert len(one("job_num = 35 and lineage_origin = 'JOB_STANDARD'")) == 8


def test_traces(full):
    up = full.trace_column("RPT_DAILY_LIST_1C", "TCV_USD").filter("source_object = 'SRC_FX_RATE'").collect()
    assert len(up) == 1 and up[0].path.startswith("RPT_DAILY_LIST_1C.TCV_USD <- RPT_DAILY_LIST_1C_V.TCV_USD <- SNAP_BKG.TCV_USD")
    down = full.trace_column("SRC_FX_RATE", "RATE", "DOWNSTREAM").filter("target_object = 'RPT_DAILY_LIST_1C' and target_column = 'TCV_USD'")
    assert down.count() == 2
    o = full.trace_object("SNAP_BKG").collect()
    assert {r.source_node for r in o} >= {"SRC_FX_RATE", "SCD_CON_DTL", "SRC_CONTRACT_HDR"} and min(r.lvl for r in o) == 1


def test_tree(full):
    assert full.ast.filter("object_name = 'APP_SNAP_BKG_V' and node_type = 'WINDOW'").count() == 1
