"""Queries over statements of many shapes: equal statements are read once, and each order has its lines."""

import math

import pytest

from veinmap.functions.reading import texts_of
from veinmap.plans import shapes


def test_different_texts(spark):
    rows = [("1", "a", "T", "ME"), ("2", "a", "T", "ME"), ("3", "", "T", "ME"), ("4", None, "T", "ME"), ("5", "a", None, "ME"), ("6", "a", "ME", "T"), ("7", None, "T", "ME")]
    of, texts = texts_of(spark.createDataFrame(rows, "id string, sql string, target string, owner string"))
    t = {r.id: (r.sql, r.target, r.owner) for r in texts.collect()}
    assert len(t) == texts.count() == 5
    assert {(r.id, *t[r.text]) for r in of.collect()} == set(rows)


@pytest.mark.parametrize("name", ["q13_multi_insert", "q8_paren_queries", "c9_outputs", "q3_with", "c3_roles", "c7_recursion", "q7_from_items"])
def test_equal_statements_are_read_once(spark, tmp_path, monkeypatch, name):
    spark.range(600).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    taken = []

    def counted(statements, tree, read=shapes.read_statements):
        taken.append(statements.count())
        return read(statements, tree)

    monkeypatch.setattr(shapes, "read_statements", counted)
    got = sorted((r.job_num, r.said) for r in shapes.said(spark, str(tmp_path), name).collect())
    of = shapes.SHAPES[name]
    assert got == sorted((k, line.replace("#", str(k % 20))) for k in range(600) for line in of[k % len(of)][1])
    assert taken == [math.lcm(20, len(of))]
