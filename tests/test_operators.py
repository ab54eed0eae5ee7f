"""Operators on small frames: rules, graph, dependencies, traces, sources, sinks, runs, streaming."""

import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veinmap.functions import reading
from veinmap.functions import rules as R
from veinmap.functions.reading import register_functions
from veinmap.operators import graph, jobs, reports, trace, views
from veinmap.plans.registry import queries
from veinmap.plans.run import build
from veinmap.plans.saved import latest_run, open_run, run_and_save
from veinmap.sources import sinks, tables
from veinmap.streaming.jobs import follow

JOB = "job_num long, job_names string, target_object string, source_object string, unique_col string, filter_clause string, sql_stmt string, disabled_flag string"


def jobs_frame(spark, rows):
    return spark.createDataFrame([tuple([*r, *[None] * (8 - len(r))]) for r in rows], JOB)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(("flag", "want"), [("Y", "Y"), (" yes ", "Y"), ("deleted", "Y"), ("1", "Y"), ("N", "N"), (None, "N"), ("", "N"), ("0", "N")])
def test_is_disabled(spark, flag, want):
    assert one(spark, R.is_disabled, flag) == want


@pytest.mark.parametrize(("name", "want"), [(' "a"  b ', "A B"), ("me.x", "X"), ("you.x", "YOU.X"), ("", None), (None, None), ("x" * 300, "X" * 261)])
def test_norm(spark, name, want):
    assert one(spark, lambda c: R.norm(c, "me"), name) == want


def test_groups_skip_empty_segments(spark):
    df = jobs_frame(spark, [(1, "|A || B |C|"), (2, None), (3, " | ")])
    assert sorted(tuple(r) for r in jobs.job_groups(df).collect()) == [(1, "A", 1, "A"), (1, "B", 2, "A|B"), (1, "C", 3, "A|B|C")]


def test_views_between_jobs(spark):
    rows = [(1, "ALL|A", "TABLE_1", "SRC_V"), (2, "ALL|A", "TABLE_2", "OTHER_V"), (5, "ALL|B", "TABLE_5", "VIEW_E"), (6, "ALL|B", "TABLE_6", "VIEW_E", None, None, None, "Y")]
    v = spark.createDataFrame([("ME", "VIEW_E", "select * from view_d d join table_2 t on t.k = d.k"), ("ME", "VIEW_D", "select * from table_1"), ("ME", "UNUSED", "select 1 from dual")], "owner string, view_name string, text string")
    r = build(jobs_frame(spark, rows), owner="ME", views=v)
    deps = {(d.job_num, d.depends_on_job): (d.hops, d.via_object, d.same_group) for d in r.job_deps.collect()}
    assert deps == {(5, 1): (2, "TABLE_1", "Y"), (5, 2): (1, "TABLE_2", "Y")}
    n = {x.node_name: x for x in r.nodes.collect()}
    assert n["SRC_V"].node_class == "ROOT" and n["TABLE_5"].node_class == "TERMINAL" and n["TABLE_5"].dag_level == 4
    assert n["TABLE_1"].node_class == "INTERMEDIATE" and "TABLE_6" not in n and n["VIEW_D"].job_node_class == "VIEW_ONLY" and n["VIEW_D"].view_captured == "Y"
    assert {x.view_name: x.capture_level for x in r.captured.collect()} == {"VIEW_E": 0, "VIEW_D": 1}
    assert build(jobs_frame(spark, rows), owner="ME", views=v, view_depth=0).captured.count() == 1
    assert build(jobs_frame(spark, rows), owner="ME", views=v, capture_views=False).captured is None


def test_walk_stops_at_written_objects(spark):
    rows = [(1, "G", "A", "S"), (2, "G", "V1", "X"), (3, "G", "OUT", "V1")]
    v = spark.createDataFrame([("ME", "V1", "select * from a")], "owner string, view_name string, text string")
    got = {(d.job_num, d.depends_on_job) for d in build(jobs_frame(spark, rows), owner="ME", views=v).job_deps.collect()}
    assert got == {(3, 2)}


def test_block_and_fallback_jobs(spark):
    rows = [
        (1, "G", None, "SQL: x", None, None, "begin insert into t select * from s; p.q; end;"),
        (2, "G", "T", "SRC", None, None, "select 1 from x"),
        (3, "G", "T", "SRC", None, None, "garbage"),
        (4, "G", "T", "DUAL"),
        (5, "G", "T", "SRC", "append", "k in (select k from me.f) and x = (select y from src)"),
        (6, "G", "T2", "SQL: x", None, None, "insert into t values (1);"),
        (7, "G", "T", "SQL: y", None, None, "create table u as select * from s"),
    ]
    r = build(jobs_frame(spark, rows), owner="ME")
    j = {x.job_num: (x.action_type, x.parse_status) for x in r.jobs.collect()}
    assert j == {1: ("PLSQL_CALL", "OK"), 2: ("SELECT", "FALLBACK"), 3: ("UNKNOWN", "FALLBACK"), 4: ("LOAD_REPLACE", "N_A"), 5: ("LOAD_APPEND", "N_A"), 6: ("INSERT_VALUES", "OK"), 7: ("CREATE_TABLE_AS", "OK")}
    e = {(x.job_num, x.source_node, x.target_node, x.edge_origin, x.ref_context, x.is_self_loop) for x in r.edges.collect()}
    assert e == {(1, "S", "S", "JOB_SQL", "DATA", "Y"), (2, "SRC", "T", "JOB_FALLBACK", "DATA", "N"), (3, "SRC", "T", "JOB_FALLBACK", "DATA", "N"), (5, "SRC", "T", "JOB_STANDARD", "DATA", "N"), (5, "F", "T", "JOB_STANDARD", "FILTER", "N"), (7, "S", "U", "JOB_SQL", "DATA", "N")}
    assert r.jobs.filter("job_num = 6").first().parse_message == "TARGET_OBJECT T2 differs from SQL target T"


def test_foreign_views(spark):
    rows = [(1, "G", "T", "OTHER.V")]
    v = spark.createDataFrame([("OTHER", "V", "select * from x join me.y on 1 = 1")], "owner string, view_name string, text string")
    d = spark.createDataFrame([("OTHER", "V", "VIEW", "ME", "Z", "TABLE", None), ("OTHER", "V", "VIEW", "OTHER", "X", "TABLE", None), ("OTHER", "V", "VIEW", "SYS", "Q", "TABLE", None)], "owner string, name string, type string, referenced_owner string, referenced_name string, referenced_type string, referenced_link_name string")
    e = {(x.source_node, x.edge_origin) for x in build(jobs_frame(spark, rows), owner="ME", views=v, dependencies=d).edges.filter("target_node = 'OTHER.V'").collect()}
    assert e == {("OTHER.X", "VIEW_DEF"), ("Y", "VIEW_DEF"), ("Z", "DB_DEPENDENCY")}


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, None, None, "VIEW", "VIEW_DEF", "DATA", "Y" if a == b else "N") for a, b in pairs], "source_node string, target_node string, job_num long, job_names string, action_type string, edge_origin string, ref_context string, is_self_loop string")


@pytest.mark.parametrize("seed", range(3))
def test_components_both_ways(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}") for _ in range(rng.choice([15, 35, 60]))}
    g = graph.graph_edges(edges_of(spark, pairs))
    a = {tuple(r) for r in graph.strong_components(g).collect()}
    assert a == {tuple(r) for r in graph.strong_components(g, 0).collect()}
    reach = {x: {x} for p in pairs for x in p}
    for _ in range(30):
        for x, y in pairs:
            reach[x] |= reach[y]
        for x in reach:
            reach[x] = set().union(*(reach[y] for y in reach[x]))
    want = {(x, min(y for y in reach[x] if x in reach[y])) for p in pairs if p[0] != p[1] for x in p}
    assert a == want


def test_levels_in_cycles(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "d"), ("e", "e"), ("x", "a")])
    g = graph.graph_edges(e)
    got = {r.node: (r.dag_level, r.in_cycle) for r in graph.levels(g, graph.strong_components(g)).collect()}
    assert got == {"x": (0, "N"), "a": (1, "N"), "b": (2, "Y"), "c": (2, "Y"), "d": (3, "N")}


def test_object_trace_paths(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "c")]).selectExpr("upper(source_node) source_node", "upper(target_node) target_node", "job_num", "job_names", "action_type", "edge_origin", "ref_context", "is_self_loop")
    rows = sorted(((r.lvl, r.rn, r.path) for r in trace.trace_object(e, "c").collect()))
    assert [p for _, _, p in rows] == ["C <- A", "C <- B", "C <- A <- C", "C <- B <- A"]
    down = trace.trace_object(e, "a", "downstream").collect()
    assert {r.path for r in down} == {"A -> B", "A -> C", "A -> B -> C", "A -> C -> A"}
    assert trace.trace_object(e, "nothing").count() == 0 and trace.trace_object(e, "c", depth=1).count() == 2


def test_column_trace_constants_and_depth(spark):
    rows = [("VIEW_DEF", None, "V", "X", 1, "1", "CONSTANT", None, None, "VALUE", "CONSTANT"), ("VIEW_DEF", None, "T", "*", 1, "*", "STAR", "V", "*", "VALUE", "UNEXPANDED")]
    df = spark.createDataFrame(rows, "lineage_origin string, job_num long, target_object string, target_column string, column_pos int, expression string, transform_type string, source_object string, source_column string, ref_role string, resolution string")
    got = [(r.lvl, r.path) for r in trace.trace_column(df, "t", "x").orderBy("lvl").collect()]
    assert got == [(1, "T.X <- V.X"), (2, "T.X <- V.X <- (constant)")]
    assert trace.trace_column(df, "t", "x", depth=1).count() == 1 and trace.trace_column(df, "q", "x").count() == 0
    tree = {r.id: r.parent_id for r in trace.lineage_tree(trace.trace_column(df, "t", "x"), "t", "x").collect()}
    assert tree == {"T.X": None, "T.X <- V.X": "T.X", "T.X <- V.X <- (constant)": "T.X <- V.X"}


def test_dependency_tree_never_goes_round(spark):
    d = spark.createDataFrame([("ME", "A", "VIEW", "ME", "B", "VIEW"), ("ME", "B", "VIEW", "ME", "A", "VIEW"), ("ME", "B", "VIEW", "ME", "T", "TABLE")], "owner string, name string, type string, referenced_owner string, referenced_name string, referenced_type string")
    got = {(r.path, r.depth) for r in views.dependency_tree(d, spark.createDataFrame([("A",)], "name string")).collect()}
    assert got == {("A/B", 1), ("A/B/T", 2)}


def test_run_diff_treats_null_jobs_alike(spark):
    a = spark.createDataFrame([("x", "y", None), ("x", "z", 1)], "source_node string, target_node string, job_num long")
    b = spark.createDataFrame([("x", "y", None), ("q", "z", 2)], "source_node string, target_node string, job_num long")
    assert sorted(tuple(r) for r in reports.run_diff(a, b).collect()) == [("ADDED", "x", "z", 1), ("REMOVED", "q", "z", 2)]


def workbook(path):
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    head = "".join(cell(f"{c}1", n) for c, n in zip("ABCDEFGH", jobs.JOB_COLUMNS, strict=True))
    body = f'<row r="2"><c r="A2"><v>7.0</v></c>{cell("B2", " ALL|A ")}<c r="C2" t="s"><v>0</v></c>{cell("H2", "y")}</row><row r="3">{cell("B3", "no number")}</row>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>T_x000D_</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1">{head}</row>{body}</sheetData></worksheet>')


def test_sources(spark, tmp_path):
    workbook(tmp_path / "b.xlsx")
    assert [tuple(r) for r in tables.read_jobs_workbook(spark, str(tmp_path / "b.xlsx")).collect()] == [(7, "ALL|A", "T", None, None, None, None, "y")]
    (tmp_path / "j.csv").write_text('﻿JOB_NUM,JOB_NAMES,TARGET_OBJECT,SOURCE_OBJECT,UNIQUE_COL,FILTER_CLAUSE,SQL_STMT,DISABLED_FLAG\n2,A,T,S,,,"select ""x""\nfrom t",\n1.0,A,T,S,,,,\n,A,T,S,,,,\n')
    got = tables.read_jobs_csv(spark, str(tmp_path / "j.csv")).collect()
    assert [r.job_num for r in got] == [1, 2] and got[1].sql_stmt == 'select "x"\nfrom t'
    (tmp_path / "bad.csv").write_text("JOB_NUM\n1\n")
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_jobs_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "v.csv").write_text('OWNER,VIEW_NAME,VIEW_TEXT\nme,v1,"select 1\nfrom t"\n')
    assert [tuple(r) for r in tables.read_views_csv(spark, str(tmp_path / "v.csv")).collect()] == [("ME", "V1", "select 1\nfrom t")]
    spark.range(1).createOrReplaceTempView("some_jobs")
    assert tables.read_jobs_table(spark, "some_jobs").count() == 1
    with pytest.raises(ValueError, match="not a table name"):
        tables.read_jobs_table(spark, "a; drop table b")


def test_sinks(spark, tmp_path):
    r = build(jobs_frame(spark, [(1, "ALL|G 1", "B", "A"), (2, "ALL|G 1", "C", "B", None, None, "insert into c select * from b where k in (select k from f)"), (3, None, "D", "A")]), owner="ME")
    lines = {}
    for x in sinks.flowcharts(r.edges, r.groups, r.nodes).orderBy("group_name", "line_no").collect():
        lines.setdefault(x.group_name, []).append(x.line)
    assert set(lines) == {"ALL", "G 1", "(no group)"} and all(v[0] == "flowchart LR" for v in lines.values())
    assert '  n0["A"]' in lines["(no group)"] and any("-.->|2 INSERT_SELECT|" in x for x in lines["ALL"])
    assert sinks.load_script(r.loaded).filter("job_num = 2").first().statement.endswith("to_clob(q'[insert into c select * from b where k in (select k from f)]'), null);")
    text = sinks.view_script([f"V{i}" for i in range(1200)], "me")
    assert text.count("view_name in (") == 6 and "'V998'" in text.split("missing_view")[1] and "'V999'" not in text.split("missing_view")[1].split("where")[0]
    assert {x.item: x.n for x in sinks.summary(r.jobs, r.nodes, r.edges).collect()}["jobs"] == 3
    sinks.save_csv({"edges": r.edges}, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv/edges"), header=True).count() == r.edges.count()


def test_saved_runs(spark, tmp_path):
    r = build(jobs_frame(spark, [(1, "A", "B", "A")]), owner="ME", label="first", run_id=3)
    row = run_and_save(r, str(tmp_path / "runs")).first()
    assert (row.status, row.rows_read, row.node_count, row.edge_count) == ("COMPLETED", 1, 2, 1)
    bad = build(spark.createDataFrame([(1,)], "job_num long").select(F.raise_error(F.lit("broken")).alias("job_num")), run_id=4)
    with pytest.raises(Exception):  # noqa: B017
        run_and_save(bad, str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs/runs"))
    assert {x.run_id: x.status for x in runs.collect()} == {3: "COMPLETED", 4: "FAILED"} and latest_run(runs).first().run_id == 3
    edges = spark.read.parquet(str(tmp_path / "runs/edges"))
    assert edges.filter("run_id = 3").count() == 1 and edges.filter("run_id = 4").count() == 0
    assert {x.run_id: x.status for x in runs.collect()}[4] == "FAILED" and runs.filter("run_id = 4").first().finished_at is not None
    run_and_save(build(jobs_frame(spark, [(1, "A", "B", "A"), (2, "A", "C", "B")]), owner="ME", run_id=3), str(tmp_path / "runs"))
    old = open_run(spark, str(tmp_path / "runs"))
    assert old.run_id == 3 and old.frame("edges").count() == 2 and old.row.first().rows_read == 2
    assert {r.path for r in old.trace_object("c").collect()} == {"C <- B", "C <- B <- A"}
    got = old.sql("SELECT t.path, n.node_class FROM trace_object('it''s') x RIGHT JOIN trace_object('C', 'UP', 1) t ON x.path = t.path JOIN {nodes} n ON n.node_name = t.source_node").collect()
    assert [tuple(r) for r in got] == [("C <- B", "INTERMEDIATE")]
    assert {r.path for r in old.sql("SELECT * FROM trace_column('C', 'X')").collect()} == {"C.X <- B.X", "C.X <- B.X <- A.X"}
    with pytest.raises(ValueError, match="literals"):
        old.sql("SELECT * FROM trace_object(name)")
    with pytest.raises(ValueError, match="no such"):
        open_run(spark, str(tmp_path / "runs"), 4)


def test_failed_run_leaves_no_frames(spark, tmp_path, monkeypatch):
    r = build(jobs_frame(spark, [(1, "A", "B", "A")]), owner="ME", run_id=7)
    broken = r.edges.withColumn("source_node", F.raise_error(F.lit("late")).cast("string"))
    monkeypatch.setattr(type(r), "frames", lambda self: {"jobs": self.jobs, "edges": broken})
    with pytest.raises(Exception, match="late"):
        run_and_save(r, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs/runs")).first().status == "FAILED" and not (tmp_path / "runs/jobs/run_id=7").exists()


def test_command_line(spark, tmp_path, capsys):
    from veinmap.__main__ import main

    (tmp_path / "j.csv").write_text("JOB_NUM,JOB_NAMES,TARGET_OBJECT,SOURCE_OBJECT,UNIQUE_COL,FILTER_CLAUSE,SQL_STMT,DISABLED_FLAG\n1,ALL|A,T,S_V,,,,\n2,ALL|B,U,T,,,,\n")
    main([str(tmp_path / "j.csv"), "--out", str(tmp_path / "out"), "--owner", "me"])
    assert "edges: 2" in capsys.readouterr().out
    assert spark.read.csv(str(tmp_path / "out/csv/edges"), header=True).count() == 2
    chart = [r.value for r in spark.read.text(str(tmp_path / "out/flowcharts/chart=A")).collect()]
    assert chart[0] == "flowchart LR" and any("|1 LOAD_REPLACE|" in x for x in chart)
    assert any("'S_V'" in r.value for r in spark.read.text(str(tmp_path / "out/view_script")).collect())
    assert spark.read.text(str(tmp_path / "out/load_script")).count() == 4


def test_long_chains_on_the_driver_and_by_joins(spark):
    chain = [(f"n{i:06}", f"n{i + 1:06}") for i in range(30_000)]
    assert len(set(graph._tarjan(chain).values())) == 30_001
    assert max(graph._levels_here(chain, graph._tarjan(chain)).values()) == 30_000
    e = edges_of(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(12)] + [("n12", "n10"), ("a", "b"), ("b", "a"), ("b", "c")])
    g = graph.graph_edges(e)
    both = [sorted(tuple(r) for r in graph.places(g, n).select("node", "root", "dag_level", "in_cycle").collect()) for n in (1000, 0)]
    assert both[0] == both[1] and ("c", "c", 1, "N") in both[0] and ("n11", "n10", 10, "Y") in both[0]
    dag = graph.graph_edges(edges_of(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "c")]))
    assert {(r.node, r.dag_level) for r in graph.places(dag, 0).collect()} == {("a", 0), ("x", 0), ("b", 1), ("c", 2)}


def counted(monkeypatch):
    written = []
    monkeypatch.setattr(graph, "stable", lambda df, write=graph.stable: written.append(1) or write(df))
    return written


@pytest.mark.parametrize("driver_edges", [0, 100])
def test_rounds_of_components_grow_slowly(spark, monkeypatch, driver_edges):
    # a path of 200 nodes into a ring of 50: peeling took a round for each node of the path
    e = edges_of(spark, [(f"t{i:03}", f"t{i + 1:03}") for i in range(200)] + [("t200", "r00")] + [(f"r{i:02}", f"r{(i + 1) % 50:02}") for i in range(50)])
    written = counted(monkeypatch)
    got = {tuple(r) for r in graph.strong_components(graph.graph_edges(e), driver_edges).collect()}
    assert got == {(f"t{i:03}", f"t{i:03}") for i in range(201)} | {(f"r{i:02}", "r00") for i in range(50)}
    assert len(written) < 60


@pytest.mark.parametrize("here", [False, True])
def test_cycle_nodes_need_no_levels(spark, tmp_path, monkeypatch, here):
    # each part leads 7 on, but 1 leads 40 such steps back: a ring of 41 and a path of 259 into it, which has as many levels
    spark.range(300).selectExpr("id AS p_partkey", "IF(id = 1, 13, 0) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    written = counted(monkeypatch)
    if not here:
        monkeypatch.setattr(graph, "_pairs", lambda e, at_most: None)
    got = [r.node_name for r in queries()["rp2_cycle_nodes"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(f"P{(1 - 7 * t) % 300}" for t in range(41))
    assert len(written) < 60


@pytest.mark.parametrize("turned", [False, True])
def test_components_of_paths_between_forks(spark, turned):
    rng = random.Random(20)
    pairs = {(f"n{rng.randrange(12):02}", f"n{rng.randrange(12):02}") for _ in range(8)}
    for c in range(6):  # paths of nodes with one way out, some with a name before those of the forks
        path = [f"n{rng.randrange(12):02}", *[f"{'cx'[c % 2]}{c}{i}" for i in range(c)], f"n{rng.randrange(12):02}"]
        pairs |= set(zip(path, path[1:], strict=False))
    pairs = sorted({(b, a) if turned else (a, b) for a, b in pairs if a != b})
    got = {tuple(r) for r in graph.strong_components(graph.graph_edges(edges_of(spark, pairs)), 0).collect()}
    want = graph._tarjan(pairs)
    assert got == set(want.items()) and sorted(n for n in Counter(want.values()).values() if n > 1) == [5, 6]


def test_paths_end_at_their_bytes(spark):
    from veinmap.operators.trace import PATH_LIMIT, _cut

    rows = ["a" * 3999 + "é", "a" * 3998 + "é", "é" * 3000, "short", None]
    got = [r.p for r in spark.createDataFrame([(x,) for x in rows], "s string").select(_cut(F.col("s")).alias("p")).collect()]
    assert got == ["a" * 3999, rows[1], "é" * 2000, "short", None] and PATH_LIMIT == 4000


def test_loading_into_a_table(spark):
    j = jobs_frame(spark, [(1, "A", "B", "A")])
    for truncate, n in ((True, 1), (False, 2), (True, 1)):
        tables.load_into_table(j, "loaded_jobs", truncate)
        assert tables.read_jobs_table(spark, "loaded_jobs").count() == n
    spark.sql("DROP TABLE loaded_jobs")


def test_names_in_a_text():
    assert reading.names_in('select a.b, "Q q".c from me . t x /* z.z */ where x.y = \'s.t\' and f(1)') >= {"A.B", "Q q", "Q q.C", "ME.T", "T", "X", "X.Y", "F"}


def test_deep_inline_views_are_read_in_one_pass():
    import time

    sql = "select x from " + "(select x from " * 2000 + "t" + ")" * 2000
    began = time.perf_counter()
    assert reading.analyze(sql, "V", None, None, False).refs[0][0] == "T" and time.perf_counter() - began < 10


def test_sql_functions(spark):
    register_functions(spark)
    assert spark.sql("SELECT count(*) n FROM sql_tokens('select a from t')").first().n == 4
    assert spark.sql("SELECT node_type FROM sql_parse_tree('select a from t') WHERE node_id = 3").first().node_type == "SELECT"
    assert spark.sql("SELECT source_column FROM sql_column_lineage('select a b from t', 'v')").first().source_column == "A"
    assert spark.sql("SELECT is_disabled(' off ') x").first().x == "Y"


def test_following_changes(spark, tmp_path):
    rows = [(1, "A", "B", "A", None, None, None, None, "2024-01-01 00:00:00", False), (1, "A", "B2", "A", None, None, None, None, "2024-01-02 00:00:00", False), (2, "A", "C", "A", None, None, None, None, "2024-01-01 00:00:00", True)]
    df = spark.createDataFrame(rows, JOB + ", changed_at string, deleted boolean").withColumn("changed_at", F.to_timestamp("changed_at"))
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    q = follow(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda r: seen.append([tuple(x) for x in r.edges.select("source_node", "target_node").collect()]), owner="ME")
    q.awaitTermination()
    assert q.exception() is None and seen == [[("A", "B2")]]


def test_execution_order_with_other_columns(spark):
    rng = random.Random(8)
    rows = [(k, "G", f"T{k}", "S" * rng.randrange(50)) for k in rng.sample(range(100_000), 3000)]
    got = {r.job_num: r.exec_seq for r in jobs.load_jobs(jobs_frame(spark, rows)).select("exec_seq", "job_num", "is_active").collect()}
    assert got == {k: n for n, k in enumerate(sorted(r[0] for r in rows), 1)}


def test_long_lists_are_cut(spark):
    rows = [("T", "C", 1, "e", "DIRECT", "S" * 40, f"C{i:05}", "VALUE", "VIEW_DEF", i, "RESOLVED") for i in range(500)] + [(None, None, 1, "e", "DIRECT", "A", "B", "KEY", "VIEW_DEF", None, "AMBIGUOUS")]
    df = spark.createDataFrame(rows, "target_object string, target_column string, column_pos int, expression string, transform_type string, source_object string, source_column string, ref_role string, lineage_origin string, job_num long, resolution string")
    got = {r.target_object: r for r in reports.column_calculation(df).collect()}
    one, size = "S" * 40 + ".C00000", 49
    shown = got["T"].value_sources.split(", ")
    assert shown[0] == one and len(got["T"].value_sources) <= 4000 < len(got["T"].value_sources) + 2 * size
    assert shown[-1] == f"...({500 - len(shown) + 1})" and got["T"].job_nums.startswith("0, 1, 10, 100, 101")
    assert got[None].condition_sources == "A.B (key)" and got[None].value_sources is None and got[None].has_unresolved == "Y"
