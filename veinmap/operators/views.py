"""View definitions: recursive capture and the edges that they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.stable import stable
from .jobs import EDGE_COLUMNS


def view_statements(views: DataFrame, owner: str | None) -> DataFrame:
    """Statements of all view definitions: id V plus owner and name, read once before the capture loop."""
    name = F.when(F.col("owner").eqNullSafe(F.lit(owner)), F.col("view_name")).otherwise(F.concat_ws(".", "owner", "view_name"))
    v = views.select("owner", "view_name", F.coalesce(F.col("text"), F.lit("")).alias("sql"))
    return v.select(F.concat(F.lit("V"), F.coalesce("owner", F.lit("")), F.lit("."), "view_name").alias("id"), "sql", R.norm(name, owner).alias("target"), "owner", F.lit(True).alias("dictionary"))


def view_refs(read: DataFrame, statements: DataFrame, owner: str | None) -> DataFrame:
    """(id, view, source_node, ref_context) of what each view reads; names in a foreign view get its owner."""
    v = statements.filter("id like 'V%'").select("id", F.col("target").alias("view"), F.col("owner").alias("view_owner"))
    r = read.select("id", F.explode("refs").alias("r")).filter("r.object_role = 'SOURCE'").join(v, "id")
    foreign = ~F.col("view_owner").eqNullSafe(F.lit(owner)) & ~F.contains("r.object_name", F.lit("."))
    full = F.when(foreign, F.concat_ws(".", "view_owner", "r.object_name")).otherwise(F.col("r.object_name"))
    return r.select("id", "view", R.norm(full, owner).alias("source_node"), F.col("r.ref_context").alias("ref_context"))


def capture(starts: DataFrame, views: DataFrame, refs: DataFrame, depends: DataFrame | None, owner: str | None, depth: int = 25) -> DataFrame:
    """(id, owner, view_name, text, capture_level) of the views that the nodes ``starts`` reach.

    One join a level over edges that are known from the start; each level is written, so plans stay short.
    ``depends`` (id, source_node) are further sources of a view.
    """
    v = views.withColumn("id", F.concat(F.lit("V"), F.coalesce("owner", F.lit("")), F.lit("."), "view_name"))
    by_name = v.select("id", R.norm(F.when(F.col("owner").eqNullSafe(F.lit(owner)), F.col("view_name")).otherwise(F.concat_ws(".", "owner", "view_name")), owner).alias("name"))
    hops = refs.select("id", "source_node")
    hops = stable((hops.unionByName(depends) if depends is not None else hops).distinct().join(by_name.withColumnRenamed("id", "next"), F.col("source_node") == F.col("name")).select("id", "next").distinct())
    fresh = stable(starts.select(F.col("name")).distinct().join(by_name, "name").select("id").distinct())
    levels = fresh.withColumn("capture_level", F.lit(0))
    level = 0
    while level < depth and not fresh.isEmpty():
        level += 1
        fresh = stable(hops.join(fresh, "id", "left_semi").select(F.col("next").alias("id")).distinct().join(levels, "id", "left_anti"))
        levels = levels.unionByName(fresh.withColumn("capture_level", F.lit(level)))
    return v.join(levels, "id").select("id", "owner", "view_name", "text", "capture_level")


def dependency_sources(dependencies: DataFrame, owner: str | None) -> DataFrame:
    """(id, source_node) of views by the dictionary: tables, views and synonyms of ordinary owners, no links."""
    d = dependencies.filter("type = 'VIEW' and referenced_type in ('TABLE', 'VIEW', 'MATERIALIZED VIEW', 'SYNONYM') and referenced_owner not in ('SYS', 'PUBLIC') and referenced_link_name is null")
    name = F.when(F.col("referenced_owner").eqNullSafe(F.lit(owner)), F.col("referenced_name")).otherwise(F.concat_ws(".", "referenced_owner", "referenced_name"))
    return d.select(F.concat(F.lit("V"), F.coalesce("owner", F.lit("")), F.lit("."), "name").alias("id"), R.norm(name, owner).alias("source_node")).distinct()


def view_edges(captured: DataFrame, refs: DataFrame, depends: DataFrame | None, statements: DataFrame) -> DataFrame:
    """VIEW_DEF edges of the captured views, and DB_DEPENDENCY edges for sources that reading didn't give."""
    none = F.lit(None)
    r = refs.join(captured.select("id"), "id", "left_semi").filter("source_node is not null").filter(~R.is_one_row(F.col("source_node")))
    e = r.select("source_node", F.col("view").alias("target_node"), none.cast("long").alias("job_num"), none.cast("string").alias("job_names"), F.lit("VIEW").alias("action_type"), F.lit("VIEW_DEF").alias("edge_origin"), "ref_context")
    if depends is not None:
        d = depends.join(captured.select("id"), "id", "left_semi").join(statements.select("id", F.col("target").alias("target_node")), "id")
        d = d.filter("source_node <> target_node").filter(~R.is_one_row(F.col("source_node"))).join(e.select("source_node", "target_node"), ["source_node", "target_node"], "left_anti")
        e = e.unionByName(d.select("source_node", "target_node", none.cast("long").alias("job_num"), none.cast("string").alias("job_names"), F.lit("VIEW").alias("action_type"), F.lit("DB_DEPENDENCY").alias("edge_origin"), F.lit("DATA").alias("ref_context")))
    e = e.withColumn("is_self_loop", F.when(F.col("source_node") == F.col("target_node"), "Y").otherwise("N"))
    return e.dropDuplicates(["source_node", "target_node", "edge_origin", "ref_context"]).select(*EDGE_COLUMNS)


def dependency_tree(dependencies: DataFrame, roots: DataFrame, depth: int = 50) -> DataFrame:
    """(root, path, tree, level, parent) of views by the dictionary; a path never visits an object twice.

    ``roots``: (name). The path array keeps the walk from going round and orders the rows as a tree.
    """
    d = dependencies.filter("referenced_owner not in ('SYS', 'PUBLIC')").select("owner", "name", "type", "referenced_owner", "referenced_name", "referenced_type")
    step = lambda frame, level: frame.select(F.col("path"), F.lit(level).alias("level"), F.col("name").alias("parent"), "referenced_name", "referenced_type", "referenced_owner")
    first = d.filter("type = 'VIEW'").join(roots.select("name").distinct(), "name", "left_semi")
    fresh = stable(step(first.withColumn("path", F.array("name", "referenced_name")), 1))
    out, level = fresh, 1
    while level < depth and not fresh.isEmpty():
        level += 1
        onward = fresh.filter("referenced_type = 'VIEW'").select("path", F.col("referenced_name").alias("name"), F.col("referenced_owner").alias("owner"))
        nxt = onward.join(d, ["name", "owner"]).filter(~F.array_contains("path", F.col("referenced_name"))).withColumn("path", F.array_append("path", F.col("referenced_name")))
        fresh = stable(step(nxt, level))
        out = out.unionByName(fresh)
    text = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), "referenced_name", F.lit(" ("), "referenced_type", F.lit(")"))
    return out.select(F.col("path")[0].alias("root"), F.array_join("path", "/").alias("path"), text.alias("dependency_tree"), F.col("level").alias("depth"), F.col("parent").alias("parent_view"))


def latest_parse(parses: DataFrame) -> DataFrame:
    """Of several parses of one object the last."""
    last = Window.partitionBy("object_name").orderBy(F.col("parse_id").desc())
    return parses.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
