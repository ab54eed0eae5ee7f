"""The SQL reader: tokens, references, transforms, quirks that must stay."""

import pytest

from veinmap.functions.sqltext import analyze, tokenize

TABLES = {"T": ["A", "B"], "S": ["A", "C"], "DICT": ["X", "Y", "Z"]}


def read(sql, target="V", owner="ME"):
    return analyze(sql, target, owner, lambda t: TABLES.get(t, []))


def lineage(sql, **kw):
    return [(r[0], r[3], r[4], r[5], r[6], r[7]) for r in read(sql, **kw).lineage]


def refs(sql):
    return read(sql).refs


def test_tokens():
    sql = "select q'[it''s]' \"a\"\"b\", N'x''y', .5e3d, 1..2, :b1 &&sub. x#$ <= -- c\n/* open"
    got = [(t.kind, t.text) for t in tokenize(sql)]
    assert got == [
        ("ID", "select"), ("STR", "q'[it''s]'"), ("QID", 'a"b'), (",", ","), ("STR", "N'x''y'"), (",", ","), ("NUM", ".5e3d"), (",", ","),
        ("NUM", "1"), (".", "."), ("NUM", ".2"), (",", ","), ("BIND", ":b1"), ("BIND", "&&sub."), ("ID", "x#$"), ("OP", "<="),
    ]
    assert [(t.start, t.end) for t in tokenize("a  bc")] == [(1, 1), (4, 5)]
    assert [t.text for t in tokenize("'open")] == ["'open"] and tokenize(" \xa0\t") == []


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("update t set a = (select max(x) from s) where b in (select c from f)", [("T", "TARGET", "DATA"), ("S", "SOURCE", "DATA"), ("F", "SOURCE", "FILTER")]),
        ("delete from me.t", [("T", "TARGET", "DATA")]),
        ("insert into t select * from t where 1 = 1", [("T", "TARGET", "DATA"), ("T", "SOURCE", "DATA")]),
        ("begin other.load(1); end;", [("OTHER.LOAD", "CALL", "DATA")]),
        ("begin if x then delete from t; end if; insert into u select a from s; end;", [("T", "TARGET", "DATA"), ("U", "TARGET", "DATA"), ("S", "SOURCE", "DATA")]),
        ("insert all into a (x) values (1) into b values (2) select * from c", [("A", "TARGET", "DATA"), ("B", "TARGET", "DATA"), ("C", "SOURCE", "DATA")]),
        ("with w as (select * from s) select * from w, t@link.db", [("S", "SOURCE", "DATA"), ("T@LINK.DB", "SOURCE", "DATA")]),
        ("select extract(year from d), trim(both ' ' from x) from t", [("T", "SOURCE", "DATA")]),
        ("truncate table t", [("T", "TARGET", "DATA")]),
        ("create or replace view v as select 1 from t", [("V", "TARGET", "DATA"), ("T", "SOURCE", "DATA")]),
        ("select * from t group by a having count(*) > (select n from f)", [("T", "SOURCE", "DATA"), ("F", "SOURCE", "FILTER")]),
        ("select * from t start with a = 1 connect by prior a = (select b from h)", [("T", "SOURCE", "DATA"), ("H", "SOURCE", "FILTER")]),
        ("select * from t pivot (sum(a) for b in (1, 2)) p join s sample (5) z on z.a = p.a", [("T", "SOURCE", "DATA"), ("S", "SOURCE", "DATA")]),
    ],
)
def test_references(sql, want):
    assert refs(sql) == want


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("a", "DIRECT"), ("a x", "RENAME"), ("(a)", "CALCULATED"), ("cast(a as number)", "CALCULATED"), ("nvl(a, 1)", "CALCULATED"), ("trunc(sysdate)", "CONSTANT"),
        ("case when a = 1 then 2 end", "CASE"), ("decode(a, 1, 2)", "CASE"), ("sum(a)", "AGGREGATE"), ("sum(case when a = 1 then 1 end)", "AGGREGATE"), ("pkg.sum(a)", "CALCULATED"),
        ("sum(a) over (partition by b)", "WINDOW"), ("date '2020-01-01'", "CONSTANT"), ("interval '1' day + a", "CALCULATED"), ("seq.nextval", "CONSTANT"), ("(select max(c) from s)", "AGGREGATE"),
    ],
)
def test_transforms(expression, want):
    assert read(f"select {expression} from t").lineage[0][3] == want


def test_roles_and_resolution():
    assert lineage("select case a when 1 then b else 0 end x from t") == [("X", "CASE", "T", "A", "CONDITION", "RESOLVED"), ("X", "CASE", "T", "B", "VALUE", "RESOLVED")]
    assert lineage("select a from t, s") == [("A", "DIRECT", None, "A", "VALUE", "AMBIGUOUS")]
    assert lineage("select c from t, s") == [("C", "DIRECT", "S", "C", "VALUE", "RESOLVED")]
    assert lineage("select q from t, unknown") == [("Q", "DIRECT", "UNKNOWN", "Q", "VALUE", "INFERRED")]
    assert lineage("select q from u1, u2") == [("Q", "DIRECT", None, "Q", "VALUE", "AMBIGUOUS")]
    assert lineage("select q from t") == [("Q", "DIRECT", "T", "Q", "VALUE", "INFERRED")]
    assert lineage("select z.q from t") == [("Q", "DIRECT", "Z", "Q", "VALUE", "UNRESOLVED")]
    assert lineage("select x from (select * from u) d") == [("X", "DIRECT", "U", "X", "VALUE", "VIA_STAR")]
    assert lineage("select * from dict d") == [(c, "DIRECT", "DICT", c, "VALUE", "DICTIONARY") for c in "XYZ"]
    assert lineage("select u.* from u, t") == [("*", "STAR", "U", "*", "VALUE", "UNEXPANDED")]
    assert lineage("select count(*) n from t, s") == [("N", "AGGREGATE", "T", "*", "VALUE", "RESOLVED"), ("N", "AGGREGATE", "S", "*", "VALUE", "RESOLVED")]
    assert lineage("select 1 one from t") == [("ONE", "CONSTANT", None, None, "VALUE", "CONSTANT")]


def test_names_of_targets():
    assert [r[0] for r in lineage("insert into dict select a, b, a from t", target=None)] == ["X", "Y", "Z"]
    assert [r[0] for r in lineage("insert into dict (p, q) select a, b from t", target=None)] == ["P", "Q"]
    assert [r[0] for r in lineage("select a + b, a total from t")] == ["A+B", "A+B", "TOTAL"]
    assert [r[0] for r in lineage("create view v (p, q) as select a, b from t")] == ["P", "Q"]


def test_set_operations_merge_by_position():
    got = lineage("select a, 1 k from t union all select upper(c), a from s minus select x, y from dict")
    assert got == [("A", "DIRECT", "T", "A", "VALUE", "RESOLVED"), ("A", "CALCULATED", "S", "C", "VALUE", "RESOLVED"), ("A", "DIRECT", "DICT", "X", "VALUE", "RESOLVED"), ("K", "DIRECT", "S", "A", "VALUE", "RESOLVED"), ("K", "DIRECT", "DICT", "Y", "VALUE", "RESOLVED")]


def test_recursion_ends():
    assert lineage("with r as (select a from t union all select r.a from r) select a from r") == [("A", "DIRECT", "T", "A", "VALUE", "RESOLVED")]


def test_correlated_and_lateral():
    assert lineage("select (select max(s.c) from s where s.a = t.a) m from t") == [("M", "AGGREGATE", "S", "C", "VALUE", "RESOLVED")]
    assert lineage("select l.q from t, lateral (select t.b q from s) l") == [("Q", "RENAME", "T", "B", "VALUE", "RESOLVED")]


@pytest.mark.parametrize(("sql", "status"), [("", "FAILED"), (None, "FAILED"), ("foo bar", "FAILED"), ("select", "OK"), ("select case a from t", "PARTIAL"), ("select a from t ???", "PARTIAL"), ("update (select * from t) set a = 1", "PARTIAL"), ("create index i on t (a)", "FAILED"), ("select a from t; extra", "PARTIAL")])
def test_never_fails(sql, status):
    assert analyze(sql, "V").status == status


def test_deep_nesting():
    deep = "select " + "(" * 400 + "a" + ")" * 400 + " from t"
    assert read(deep).status == "OK" and lineage(deep)[0][1] == "CALCULATED"
    assert read("select * from " + "(select * from " * 200 + "t" + ")" * 200).refs == [("T", "SOURCE", "DATA")]


def test_quirk_cte_names_leak():
    assert refs("select * from (with w as (select 1 from t) select * from w) x, w") == [("T", "SOURCE", "DATA")]


def test_quirk_alias_after_link_is_part_of_it():
    assert refs("select * from t@link x") == [("T@LINKX", "SOURCE", "DATA")]


def test_quirk_qualify_reads_as_alias():
    a = read("select a from t qualify rn = 1")
    assert a.refs == [("T", "SOURCE", "DATA")] and a.status == "PARTIAL"


def test_quirk_apply_does_not_see_siblings():
    assert lineage("select l.q from t cross apply (select t.b q from s) l") == [("Q", "RENAME", "T", "B", "VALUE", "UNRESOLVED")]


def test_tree_positions():
    sql = "select a,\n  b from t"
    for r in read(sql).tree:
        if r[4] is not None:
            assert " ".join(sql[r[5] - 1 : r[6]].split()) == r[4]
    kinds = [r[2] for r in read(sql).tree]
    assert kinds[:5] == ["STATEMENT", "QUERY", "SELECT", "SELECT_LIST", "SELECT_ITEM"]
    assert read("select '" + "x" * 5000 + "' from t").tree[0][4] is None
