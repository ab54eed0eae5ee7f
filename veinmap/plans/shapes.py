"""Statements of many shapes over the driver's orders, and what reading them must give, written down by hand.

``#`` in a text stands for a number of 0 to 19 that follows from the order's key. T_# has the columns A and B, S_# A and C, D_# X, Y
and Z; no dictionary knows U_#. What is said about a statement are lines: ``STATUS|status|statement``, ``REF|object|role|context`` and
``LIN|column|position|transform|object|source column|role|resolution``, with ``-`` for null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reading import read_statements, texts_of, with_dictionary
from ..functions.stable import stable
from . import derived as D

_N = D.text_of("o_orderkey % 20")
COLUMNS = """
SELECT 'ME' AS owner, k || '_' || CAST(i AS VARCHAR(10)) AS table_name, c AS column_name, p AS column_id
FROM (SELECT DISTINCT o_orderkey % 20 AS i FROM {orders}) n
CROSS JOIN (VALUES ('T', 'A', 1), ('T', 'B', 2), ('S', 'A', 1), ('S', 'C', 2), ('D', 'X', 1), ('D', 'Y', 2), ('D', 'Z', 3)) AS v(k, c, p)
"""
_T, _S, _U, _D = (f"REF|{x}_#|SOURCE|DATA" for x in "TSUD")
_READ = "STATUS|OK|SELECT"

SHAPES: dict[str, list[tuple[str, list[str]]]] = {
    "q3_with": [
        ("with w as (select a, b from t_#), x as (select w.a p from w) select x.p q, w.b from x join w on w.a = x.p", [_READ, _T, "LIN|Q|1|RENAME|T_#|A|VALUE|RESOLVED", "LIN|B|2|DIRECT|T_#|B|VALUE|RESOLVED"]),
        ("with recursive r (n, m) as (select a, b from t_# union all select r.n + 1, r.m from r where r.n < 9) search depth first by n set o select n, m from r", [_READ, _T, "LIN|N|1|DIRECT|T_#|A|VALUE|RESOLVED", "LIN|M|2|DIRECT|T_#|B|VALUE|RESOLVED"]),
        ("with function f(p number) return number is begin return p; end; select f(c) k from s_#", [_READ, _S, "LIN|K|1|CALCULATED|S_#|C|VALUE|RESOLVED"]),
    ],
    "q7_from_items": [
        ("select i.a, j.c from ((select a from t_#)) i join (s_# j join u_# k on k.z = j.c) on j.a = i.a", [_READ, _T, _S, _U, "LIN|A|1|DIRECT|T_#|A|VALUE|RESOLVED", "LIN|C|2|DIRECT|S_#|C|VALUE|RESOLVED"]),
        ("select l.q, t.b from t_# t, lateral (select t.a q from s_#) l", [_READ, _T, _S, "LIN|Q|1|RENAME|T_#|A|VALUE|RESOLVED", "LIN|B|2|DIRECT|T_#|B|VALUE|RESOLVED"]),
        ("select v.column_value e, t.a from t_# t, table(t.lst) v", [_READ, _T, "LIN|E|1|CALCULATED|T_#|LST|VALUE|RESOLVED", "LIN|A|2|DIRECT|T_#|A|VALUE|RESOLVED"]),
        ("select p.a from t_# partition (p1) sample (5) p, s_#@far", [_READ, _T, "REF|S_#@FAR|SOURCE|DATA", "LIN|A|1|DIRECT|T_#|A|VALUE|RESOLVED"]),
    ],
    "q8_paren_queries": [
        ("select a from ((select a from t_#) union all (select c from s_#))", [_READ, _T, _S, "LIN|A|1|DIRECT|T_#|A|VALUE|RESOLVED", "LIN|A|1|DIRECT|S_#|C|VALUE|RESOLVED"]),
        ("select z.a from ((t_#) z cross join s_#)", [_READ, _T, _S, "LIN|A|1|DIRECT|T_#|A|VALUE|RESOLVED"]),
        ("((select a from t_#)) order by 1", [_READ, _T, "LIN|A|1|DIRECT|T_#|A|VALUE|RESOLVED"]),
    ],
    "q11_windows": [
        ("select sum(a) over (partition by b order by a) w, a + rank() over (order by b) r from t_#",
         [_READ, _T, "LIN|W|1|WINDOW|T_#|A|VALUE|RESOLVED", "LIN|W|1|WINDOW|T_#|B|WINDOW|RESOLVED", "LIN|W|1|WINDOW|T_#|A|WINDOW|RESOLVED", "LIN|R|2|WINDOW|T_#|A|VALUE|RESOLVED", "LIN|R|2|WINDOW|T_#|B|WINDOW|RESOLVED"]),
        ("select max(a) keep (dense_rank first order by b) k from t_#", [_READ, _T, "LIN|K|1|AGGREGATE|T_#|A|VALUE|RESOLVED", "LIN|K|1|AGGREGATE|T_#|B|WINDOW|RESOLVED"]),
    ],
    "q13_multi_insert": [
        ("insert all into a_# (x) values (p) into b_# (y, z) values (q, 1) select c p, a q from s_#", ["STATUS|OK|INSERT", "REF|A_#|TARGET|DATA", "REF|B_#|TARGET|DATA", _S]),
        ("insert first when a > 1 then into a_# (x) values (c) else into me.b_# values (a) select a, c from s_#", ["STATUS|OK|INSERT", "REF|A_#|TARGET|DATA", "REF|B_#|TARGET|DATA", _S]),
        ("insert into t_# (a, b) values (1, (select max(c) from s_#))", ["STATUS|OK|INSERT", "REF|T_#|TARGET|DATA", _S, "LIN|A|1|CONSTANT|-|-|VALUE|CONSTANT", "LIN|B|2|AGGREGATE|S_#|C|VALUE|RESOLVED"]),
    ],
    "q18_create": [
        ("create or replace force view v_# (p, q) as select a, b from t_#", ["STATUS|OK|CREATE_VIEW", "REF|V_#|TARGET|DATA", _T, "LIN|P|1|DIRECT|T_#|A|VALUE|RESOLVED", "LIN|Q|2|DIRECT|T_#|B|VALUE|RESOLVED"]),
        ("create table n_# as select c from s_#", ["STATUS|OK|CREATE_TABLE", "REF|N_#|TARGET|DATA", _S, "LIN|C|1|DIRECT|S_#|C|VALUE|RESOLVED"]),
        ("create materialized view m_# refresh fast on demand as select a from t_#", ["STATUS|OK|CREATE_VIEW", "REF|M_#|TARGET|DATA", _T, "LIN|A|1|DIRECT|T_#|A|VALUE|RESOLVED"]),
    ],
    "q23_faults": [
        ("select a from t_# ???", ["STATUS|PARTIAL|SELECT", _T, "LIN|A|1|DIRECT|T_#|A|VALUE|RESOLVED"]),
        ("foo bar_#", ["STATUS|FAILED|UNKNOWN"]),
        ("select case a from t_#", ["STATUS|PARTIAL|SELECT", "LIN|CASEAFROMT_#|1|CASE|-|A|CONDITION|UNRESOLVED"]),
        ("", ["STATUS|FAILED|-"]),
        ("select a from t_#; select c from s_#", ["STATUS|PARTIAL|SELECT", _T, "LIN|A|1|DIRECT|T_#|A|VALUE|RESOLVED"]),
        ("insert into t_# (a) values (1", ["STATUS|PARTIAL|INSERT", "REF|T_#|TARGET|DATA", "LIN|A|1|CONSTANT|-|-|VALUE|CONSTANT"]),
    ],
    "c2_strongest": [
        ("select b2 c from (select upper(b) b2 from t_#)", [_READ, _T, "LIN|C|1|CALCULATED|T_#|B|VALUE|RESOLVED"]),
        ("select s2 * 2 s3 from (select sum(a) s2 from t_#)", [_READ, _T, "LIN|S3|1|AGGREGATE|T_#|A|VALUE|RESOLVED"]),
        ("select case when r > 1 then r end x from (select rank() over (order by a) r from t_#)", [_READ, _T, "LIN|X|1|WINDOW|T_#|A|CONDITION|RESOLVED", "LIN|X|1|WINDOW|T_#|A|WINDOW|RESOLVED"]),
    ],
    "c3_roles": [
        ("select case when k = 1 then b end x from (select nvl(a, 0) k, b from t_#)", [_READ, _T, "LIN|X|1|CASE|T_#|A|CONDITION|RESOLVED", "LIN|X|1|CASE|T_#|B|VALUE|RESOLVED"]),
        ("select sum(z) over (partition by y) x from (select case when a = 1 then b end z, a y from t_#)", [_READ, _T, "LIN|X|1|WINDOW|T_#|A|CONDITION|RESOLVED", "LIN|X|1|WINDOW|T_#|B|VALUE|RESOLVED", "LIN|X|1|WINDOW|T_#|A|WINDOW|RESOLVED"]),
    ],
    "c5_resolution": [
        ("select a from t_#, s_#", [_READ, _T, _S, "LIN|A|1|DIRECT|-|A|VALUE|AMBIGUOUS"]),
        ("select c from t_#, s_#", [_READ, _T, _S, "LIN|C|1|DIRECT|S_#|C|VALUE|RESOLVED"]),
        ("select q from t_#, u_#", [_READ, _T, _U, "LIN|Q|1|DIRECT|U_#|Q|VALUE|INFERRED"]),
        ("select q from u_#, w_#", [_READ, _U, "REF|W_#|SOURCE|DATA", "LIN|Q|1|DIRECT|-|Q|VALUE|AMBIGUOUS"]),
        ("select q from t_#", [_READ, _T, "LIN|Q|1|DIRECT|T_#|Q|VALUE|INFERRED"]),
        ("select z.q from t_#", [_READ, _T, "LIN|Q|1|DIRECT|Z|Q|VALUE|UNRESOLVED"]),
        ("select (select c from s_# where b = 1) x, q y from u_#", [_READ, _S, _U, "LIN|X|1|CALCULATED|S_#|C|VALUE|RESOLVED", "LIN|Y|2|RENAME|U_#|Q|VALUE|RESOLVED"]),
    ],
    "c6_via_star": [
        ("select x from (select * from u_#) d", [_READ, _U, "LIN|X|1|DIRECT|U_#|X|VALUE|VIA_STAR"]),
        ("select d.x, e.a from (select * from u_#) d join (select * from t_#) e on 1 = 1", [_READ, _U, _T, "LIN|X|1|DIRECT|U_#|X|VALUE|VIA_STAR", "LIN|A|2|DIRECT|T_#|A|VALUE|DICTIONARY"]),
    ],
    "c7_recursion": [
        ("with r as (select a from t_# union all select r.a from r) select a from r", [_READ, _T, "LIN|A|1|DIRECT|T_#|A|VALUE|RESOLVED"]),
        ("with r as (select c from s_# union all select upper(c) from r) select c k from r", [_READ, _S, "LIN|K|1|RENAME|S_#|C|VALUE|RESOLVED"]),
    ],
    "c8_stars": [
        ("select * from d_#", [_READ, _D, *(f"LIN|{c}|{i}|DIRECT|D_#|{c}|VALUE|DICTIONARY" for i, c in enumerate("XYZ", 1))]),
        ("select u.*, t.* from u_# u, t_# t", [_READ, _U, _T, "LIN|*|1|STAR|U_#|*|VALUE|UNEXPANDED", "LIN|A|2|DIRECT|T_#|A|VALUE|DICTIONARY", "LIN|B|3|DIRECT|T_#|B|VALUE|DICTIONARY"]),
        ("select i.* from (select x, y * 2 y2 from d_#) i", [_READ, _D, "LIN|X|1|DIRECT|D_#|X|VALUE|RESOLVED", "LIN|Y2|2|CALCULATED|D_#|Y|VALUE|RESOLVED"]),
        ("insert into s_# select * from t_#", ["STATUS|OK|INSERT", "REF|S_#|TARGET|DATA", _T, "LIN|A|1|DIRECT|T_#|A|VALUE|DICTIONARY", "LIN|C|2|DIRECT|T_#|B|VALUE|DICTIONARY"]),
    ],
    "c9_outputs": [
        ("select a, 1 k from t_# union all select upper(c), a from s_# minus select x, y from d_#",
         [_READ, _T, _S, _D, "LIN|A|1|DIRECT|T_#|A|VALUE|RESOLVED", "LIN|A|1|CALCULATED|S_#|C|VALUE|RESOLVED", "LIN|A|1|DIRECT|D_#|X|VALUE|RESOLVED", "LIN|K|2|DIRECT|S_#|A|VALUE|RESOLVED", "LIN|K|2|DIRECT|D_#|Y|VALUE|RESOLVED"]),
        ("select count(*) n from t_#, u_#", [_READ, _T, _U, "LIN|N|1|AGGREGATE|T_#|*|VALUE|RESOLVED", "LIN|N|1|AGGREGATE|U_#|*|VALUE|RESOLVED"]),
        ("select (select max(c) from s_#) m, a from t_#", [_READ, _S, _T, "LIN|M|1|AGGREGATE|S_#|C|VALUE|RESOLVED", "LIN|A|2|DIRECT|T_#|A|VALUE|RESOLVED"]),
    ],
    "c10_renames": [
        ("with w (p, q) as (select a, b from t_#) select q, p from w", [_READ, _T, "LIN|Q|1|DIRECT|T_#|B|VALUE|RESOLVED", "LIN|P|2|DIRECT|T_#|A|VALUE|RESOLVED"]),
        ("select p from (select a p from t_#) union select x from d_#", [_READ, _T, _D, "LIN|P|1|RENAME|T_#|A|VALUE|RESOLVED", "LIN|P|1|DIRECT|D_#|X|VALUE|RESOLVED"]),
    ],
}


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def texts(name: str) -> str:
    """SQL of (job_num, sql): each order with one of the shapes."""
    shapes = SHAPES[name]
    cases = " ".join(f"WHEN {i} THEN {_literal(t)}" for i, (t, _) in enumerate(shapes))
    return f"SELECT o_orderkey AS job_num, replace(CASE o_orderkey % {len(shapes)} {cases} END, '#', {_N}) AS sql_text FROM {{orders}}"


def said_sql(name: str) -> str:
    """SQL of (job_num, said): what must be said about each order's statement."""
    shapes = SHAPES[name]
    rows = ", ".join(f"({i}, {_literal(line)})" for i, (_, lines) in enumerate(shapes) for line in lines)
    return f"SELECT o_orderkey AS job_num, replace(line, '#', {_N}) AS said FROM {{orders}} JOIN (VALUES {rows}) AS v(shape, line) ON o_orderkey % {len(shapes)} = shape"


def said(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(job_num, said): what reading each order's statement, with its tables' columns, gives. Equal statements are read once."""
    s = D.frame(spark, sf_dir, texts(name)).select(F.col("job_num").alias("id"), F.col("sql_text").alias("sql"), F.lit("OUT").alias("target"), F.lit("ME").alias("owner"))
    of, different = texts_of(s)
    read = read_statements(with_dictionary(stable(different), D.frame(spark, sf_dir, COLUMNS)), False)

    def line(kind: str, fields: list[Column]) -> Column:
        return F.concat_ws("|", F.lit(kind), *[F.coalesce(f.cast("string"), F.lit("-")) for f in fields])

    refs = F.transform("refs", lambda r: line("REF", [r[f] for f in ("object_name", "object_role", "ref_context")]))
    lineage = F.transform("lineage", lambda x: line("LIN", [x[f] for f in ("target_column", "column_pos", "transform_type", "source_object", "source_column", "ref_role", "resolution")]))
    # a written table has its size: a small one is broadcast, a large one joined with hot texts split
    lines = stable(read.select(F.col("id").alias("text"), F.concat(F.array(line("STATUS", [F.col("status"), F.col("statement")])), refs, lineage).alias("lines")))
    return of.join(lines, "text").select(F.col("id").cast("long").alias("job_num"), F.explode("lines").alias("said"))
