"""Upstream and downstream traces over object edges and column lineage.

Breadth first, a level at a time: the frontier joins the edges; rows come in the order
(rank of the node that is expanded, job, names), and the first row that reaches a node gives it its path
and its rank on the next level. A level is numbered by range partitions (``numbered``), which is also
the one table that it writes: what was reached before is read from the levels' own rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stable import numbered

OBJECT_DEPTH, COLUMN_DEPTH, PATH_LIMIT = 50, 30, 4000


def is_downstream(direction: str | None) -> bool:
    return (direction or "UP").upper().startswith("DOWN")


def _cut(path: Column) -> Column:
    """A path within the limit of PATH_LIMIT bytes, cut before a character that doesn't fit whole."""
    whole = F.make_valid_utf8(F.substring(path.cast("binary"), 1, PATH_LIMIT).cast("string"))
    return F.when(F.octet_length(path) <= PATH_LIMIT, path).otherwise(F.regexp_replace(whole, "\ufffd+$", ""))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def trace_object(edges: DataFrame, name: str, direction: str = "UPSTREAM", depth: int = OBJECT_DEPTH) -> DataFrame:
    """(lvl, source_node, target_node, job_num, job_names, action_type, edge_origin, ref_context, path, rn)."""
    down = is_downstream(direction)
    here, there, arrow = ("source_node", "target_node", " -> ") if down else ("target_node", "source_node", " <- ")
    spark = edges.sparkSession
    name = name.strip().upper()
    e = edges.filter("is_self_loop = 'N'")
    front = spark.createDataFrame([(name, name, 1)], "node string, at string, rank int")
    seen, out, lvl = [front.select("node")], [], 0
    shown = ["lvl", "source_node", "target_node", "job_num", "job_names", "action_type", "edge_origin", "ref_context", "path", "rn"]
    while lvl < depth:
        lvl += 1
        rows = e.join(front.withColumnRenamed("node", here), here)
        rows = rows.withColumn("path", _cut(F.concat("at", F.lit(arrow), F.col(there)))).withColumn("lvl", F.lit(lvl))
        rows, n = numbered(rows, "rank", F.asc_nulls_first("job_num"), "source_node", "target_node", "edge_origin", "ref_context")
        if not n:
            break
        out.append(rows.select(*shown))
        front = rows.groupBy(F.col(there).alias("node")).agg(F.min_by("path", "rn").alias("at"), F.min("rn").alias("rank")).join(_union(seen), "node", "left_anti")
        seen.append(rows.select(F.col(there).alias("node")).distinct())
    if not out:
        return e.limit(0).select(F.lit(0).alias("lvl"), *shown[1:-2], F.lit("").alias("path"), F.lit(0).cast("long").alias("rn"))
    return _union(out)


_TRACE = ["lvl", "target_object", "target_column", "transform_type", "expression", "source_object", "source_column", "ref_role", "lineage_origin", "job_num", "path", "rn"]


def trace_column(lineage: DataFrame, name: str, column: str, direction: str = "UPSTREAM", depth: int = COLUMN_DEPTH) -> DataFrame:
    """The rows of column lineage that lead to (or from) one column; a star passes the current column on.

    The condition "this column or a star" is a union of two equi-joins.
    """
    down = is_downstream(direction)
    obj, col, to_obj, to_col, arrow = ("source_object", "source_column", "target_object", "target_column", " -> ") if down else ("target_object", "target_column", "source_object", "source_column", " <- ")
    spark = lineage.sparkSession
    name, column = name.strip().upper(), column.strip().upper()
    front = spark.createDataFrame([(name, column, f"{name}.{column}", 1)], "o string, c string, at string, rank int")
    seen, out, emitted, lvl = [front.select("o", "c")], [], [], 0
    key = ["target_object", "target_column", "source_object", "source_column", "job_num", "lineage_origin", "ref_role"]
    shown = [x for x in _TRACE if x not in ("lvl", "path", "rn")]
    ids = [f"_{k}" for k in key]
    lin = lineage.select(*shown)
    while lvl < depth:
        lvl += 1
        f = front.select(F.col("o").alias(obj), "c", "at", "rank")
        exact = lin.join(f.withColumn(col, F.col("c")), [obj, col])
        star = lin.filter(F.col(col) == "*").drop(col).join(f.filter("c <> '*'"), obj).withColumn(col, F.col("c"))
        rows = exact.unionByName(star.select(*exact.columns)).withColumn("_said", F.col(to_col)).withColumn(to_col, F.when(F.col(to_col) == "*", F.col("c")).otherwise(F.col(to_col))).withColumn("lvl", F.lit(lvl))
        label = F.when(F.col(to_obj).isNull(), "(constant)").otherwise(F.concat_ws(".", to_obj, F.coalesce(to_col, F.lit(""))))
        rows = rows.withColumn("path", _cut(F.concat("at", F.lit(arrow), label)))
        order = ["rank", F.asc_nulls_first("job_num"), F.asc_nulls_last("source_object"), F.asc_nulls_last("source_column"), "target_object", "target_column", "_said", "ref_role", "transform_type", "expression"]
        rows = rows.select("*", *[F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(i) for k, i in zip(key, ids, strict=True)])
        rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*ids).orderBy(*order))).filter("_nth = 1")
        if emitted:
            rows = rows.join(_union(emitted), ids, "left_anti")
        rows, n = numbered(rows, *order)
        if not n:
            break
        emitted.append(rows.select(*ids))
        out.append(rows.select(*_TRACE))
        ends = rows.filter(F.col(to_obj).isNotNull() & F.col(to_col).isNotNull() & (F.col(to_col) != "*")).select(F.col(to_obj).alias("o"), F.col(to_col).alias("c"), "path", "rn")
        front = ends.groupBy("o", "c").agg(F.min_by("path", "rn").alias("at"), F.min("rn").alias("rank")).join(_union(seen), ["o", "c"], "left_anti")
        seen.append(ends.select("o", "c").distinct())
    if not out:
        return lin.limit(0).select(F.lit(0).alias("lvl"), *shown, F.lit("").alias("path"), F.lit(0).cast("long").alias("rn"))
    return _union(out)


def lineage_tree(trace: DataFrame, name: str, column: str, direction: str = "UPSTREAM") -> DataFrame:
    """(id, parent_id, label, tooltip, icon): the trace as a tree of paths, below the column asked for."""
    down = is_downstream(direction)
    arrow = " -> " if down else " <- "
    root = f"{name.strip().upper()}.{column.strip().upper()}"
    first = Window.partitionBy("path").orderBy(F.asc_nulls_first("job_num"), "lvl", F.asc_nulls_first("expression"))
    t = trace.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    end = F.concat_ws(".", "target_object", "target_column") if down else F.when(F.col("source_object").isNull(), "(constant)").otherwise(F.concat_ws(".", "source_object", "source_column"))
    label = F.concat(end, F.lit("  ["), "transform_type", F.when(F.col("job_num").isNotNull(), F.concat(F.lit(", job "), F.col("job_num").cast("string"))).otherwise(F.lit("")), F.lit("]"))
    icon = F.when(F.col("transform_type").isin("AGGREGATE", "WINDOW"), "fa fa-sigma").when(F.col("transform_type").isin("CALCULATED", "CASE"), "fa fa-calculator").otherwise("fa fa-arrow-left")
    parent = F.array_join(F.slice(F.split("path", arrow), F.lit(1), F.size(F.split("path", arrow)) - 1), arrow)
    rows = t.select(F.col("path").alias("id"), parent.alias("parent_id"), label.alias("label"), F.col("expression").alias("tooltip"), icon.alias("icon"))
    top = trace.sparkSession.createDataFrame([(root, None, root, "Selected column", "fa fa-columns")], "id string, parent_id string, label string, tooltip string, icon string")
    return top.unionByName(rows)
