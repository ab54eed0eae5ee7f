"""Catalogue reports over the frames of a run."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R


def class_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_class", "node_type").agg(F.count(F.lit(1)).alias("nodes"))


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter("node_class = 'ROOT'").select("node_name", "node_type", "type_source", "out_degree", "reader_jobs")


def terminals(nodes: DataFrame) -> DataFrame:
    return nodes.filter("node_class = 'TERMINAL'").select("node_name", "node_type", "in_degree", "writer_jobs", "last_writer_job", "dag_level")


def intermediates(nodes: DataFrame) -> DataFrame:
    return nodes.filter("node_class = 'INTERMEDIATE'").select("node_name", "node_type", "in_degree", "out_degree", "writer_jobs", "reader_jobs", "dag_level", "in_cycle")


def cycle_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("in_cycle = 'Y'").select("node_name", "node_type", "dag_level")


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.filter("is_active = 'Y'").groupBy("case_type", "action_type", "parse_status").agg(F.count(F.lit(1)).alias("jobs"))


def doubtful_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter("parse_status in ('FALLBACK', 'PARTIAL')").select("job_num", "job_names", "target_object", "parse_status", "parse_message", F.substring("sql_stmt", 1, 200).alias("sql_start"))


def inactive_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter("is_active = 'N'").select("job_num", "job_names", "target_object", "source_object", "disabled_flag")


def group_overview(groups: DataFrame, jobs: DataFrame) -> DataFrame:
    g = groups.join(jobs.select("job_num", "is_active"), "job_num")
    return g.groupBy("group_name").agg(F.countDistinct("job_num").alias("jobs"), F.countDistinct(F.when(F.col("is_active") == "Y", F.col("job_num"))).alias("active_jobs"), F.min("job_num").alias("first_job"), F.max("job_num").alias("last_job"))


def latest_writer_deps(deps: DataFrame, jobs: DataFrame) -> DataFrame:
    target = jobs.select("job_num", "target_object")
    d = deps.filter("is_latest_writer = 'Y'").join(target.withColumnRenamed("target_object", "consumer_target"), "job_num")
    d = d.join(target.select(F.col("job_num").alias("depends_on_job"), F.col("target_object").alias("producer_target")), "depends_on_job")
    return d.select("job_num", "consumer_target", "depends_on_job", "producer_target", "via_object", "read_object", "hops", "dep_type", "is_latest_writer", "same_group")


def cross_group_deps(deps: DataFrame) -> DataFrame:
    return deps.filter("same_group = 'N' and dep_type = 'PRIOR_STEP'").select("job_num", "depends_on_job", "via_object").distinct()


def columns_of_object(lineage: DataFrame, name: str) -> DataFrame:
    return lineage.filter(F.col("target_object") == name.upper()).select("target_column", "column_pos", "transform_type", "expression", "source_object", "source_column", "ref_role", "resolution", "lineage_origin", "job_num")


def calculated_columns(lineage: DataFrame) -> DataFrame:
    return lineage.filter(F.col("transform_type").isin("CALCULATED", "CASE", "AGGREGATE", "WINDOW")).select("target_object", "target_column", "transform_type", "expression").distinct()


def unresolved_columns(lineage: DataFrame) -> DataFrame:
    return lineage.filter(F.col("resolution").isin("AMBIGUOUS", "UNRESOLVED")).select("target_object", "target_column", "expression", "source_column", "resolution")


def tree_print(tree: DataFrame, key: str = "id") -> DataFrame:
    """Indented syntax trees: nodes are numbered in the order of a walk, so the number orders the rows."""
    name = F.when(F.col("node_name").isNotNull(), F.concat(F.lit(" ["), F.substring("node_name", 1, 40), F.lit("]"))).otherwise(F.lit(""))
    return tree.select(key, "node_id", F.concat(F.repeat(F.lit("  "), F.col("depth")), "node_type", name).alias("tree"), "start_pos", "end_pos", F.substring("node_text", 1, 80).alias("node_text"))


def where_columns(tree: DataFrame, key: str = "id") -> DataFrame:
    """Column references inside WHERE clauses: an equi-join on the statement, then containment of positions."""
    w = tree.filter("node_type = 'WHERE'").select(key, F.col("node_text").alias("where_clause"), F.col("start_pos").alias("a"), F.col("end_pos").alias("b"))
    n = tree.filter("node_type = 'COLUMN_REF'").select(key, F.col("node_name").alias("column_ref"), "start_pos")
    return n.join(w, key).filter("start_pos between a and b").select(key, "column_ref", "where_clause", "start_pos")


def run_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """Edges ADDED and REMOVED between two runs, as distinct (source, target, job)."""
    key = ["source_node", "target_node", "job_num"]
    a, b = now.select(*key), before.select(*key)
    return a.subtract(b).withColumn("change", F.lit("ADDED")).unionByName(b.subtract(a).withColumn("change", F.lit("REMOVED"))).select("change", *key)


def views_in_run(nodes: DataFrame, views: DataFrame, owner: str | None) -> DataFrame:
    n = nodes.filter("node_type = 'VIEW'").select("node_name", "node_class", "dag_level").withColumn("owner", R.owner_of(F.col("node_name"), owner)).withColumn("view_name", R.name_of(F.col("node_name")))
    v = views.select("owner", "view_name", F.length("text").cast("long").alias("text_length"), F.lit("Y").alias("exists_in_db"))
    return n.join(v, ["owner", "view_name"], "left").select("node_name", "node_class", "dag_level", F.coalesce("exists_in_db", F.lit("N")).alias("exists_in_db"), "text_length")


def view_text(views: DataFrame, name: str, owner: str | None = None) -> DataFrame:
    """Definition of one view, as a statement that creates it."""
    v = views.filter((F.col("view_name") == name.upper()) & F.col("owner").eqNullSafe(F.lit(owner)))
    return v.select("owner", "view_name", F.concat(F.lit("CREATE OR REPLACE VIEW "), F.concat_ws(".", "owner", "view_name"), F.lit(" AS\n"), "text").alias("ddl"))


def view_columns(nodes: DataFrame, columns: DataFrame, owner: str | None) -> DataFrame:
    n = nodes.filter("node_type = 'VIEW'").select(R.owner_of(F.col("node_name"), owner).alias("owner"), R.name_of(F.col("node_name")).alias("table_name"))
    return columns.join(n, ["owner", "table_name"], "left_semi").select(F.col("table_name").alias("view_name"), "column_id", "column_name")


# -- explorer
def object_choices(lineage: DataFrame, nodes: DataFrame) -> DataFrame:
    o = lineage.select(F.col("target_object").alias("name")).union(lineage.select("source_object").filter("source_object is not null")).distinct()
    n = nodes.select(F.col("node_name").alias("name"), "node_type", "node_class")
    return o.join(n, "name", "left").select(F.col("name").alias("display_value"), F.col("name").alias("return_value"), F.coalesce("node_type", F.lit("UNKNOWN")).alias("node_type"), F.coalesce("node_class", F.lit("-")).alias("node_class"))


def column_choices(lineage: DataFrame) -> DataFrame:
    t = lineage.filter("target_column <> '*'").select(F.col("target_object").alias("object_name"), F.col("target_column").alias("column_name"), "column_pos")
    s = lineage.filter("source_object is not null and source_column is not null and source_column <> '*'").select(F.col("source_object").alias("object_name"), F.col("source_column").alias("column_name"), F.lit(None).cast("int").alias("column_pos"))
    return t.unionByName(s).groupBy("object_name", "column_name").agg(F.min("column_pos").alias("column_pos"))


LIST_BYTES = 4000


def _lists(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, list, listed): the texts of each list in the order of ``o`` and ``text``, joined by commas, repeats kept.

    A list over LIST_BYTES ends with the last text that fits whole and the number of those left out. Bytes are
    summed up in the order of a window, so that of a list of any length only what is shown is gathered in one value.
    """
    by = [*key, "list"]
    order = Window.partitionBy(*by).orderBy("o", "text")
    sized = rows.withColumn("size", F.octet_length("text") + 2)
    upto = sized.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("upto") <= LIST_BYTES + 2)
    texts = upto.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("upto", "text"))).alias("texts"))
    total = sized.groupBy(*by).agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"))
    same = reduce(and_, [total[c].eqNullSafe(texts[c]) for c in by])
    out = total.join(texts, same, "left").select(*[total[c] for c in by], "total", "n", "texts")
    whole = F.array_join(F.transform("texts", lambda x: x["text"]), ", ")
    fit = F.filter("texts", lambda x: x["upto"] <= LIST_BYTES - 24)
    cut = F.concat(F.array_join(F.transform(fit, lambda x: F.concat(x["text"], F.lit(", "))), ""), F.lit("...("), (F.col("n") - F.size(fit)).cast("string"), F.lit(")"))
    return out.select(*by, F.when(F.col("texts").isNull(), F.concat(F.lit("...("), F.col("n").cast("string"), F.lit(")"))).when(F.col("total") <= LIST_BYTES + 2, whole).otherwise(cut).alias("listed"))


def column_calculation(lineage: DataFrame) -> DataFrame:
    """One row per target column: how it is calculated, and from what."""
    key = ["target_object", "target_column"]
    name, role = F.concat("source_object", F.lit("."), "source_column"), F.col("ref_role")
    strongest = F.max(F.struct(R.transform_rank(F.col("transform_type")).alias("r"), "transform_type"))["transform_type"]
    calculated = lineage.groupBy(*key).agg(
        F.min("column_pos").alias("column_pos"),
        F.max("expression").alias("expression"),
        strongest.alias("transform_type"),
        F.max("lineage_origin").alias("lineage_origin"),
        F.max(F.when(F.col("resolution").isin("AMBIGUOUS", "UNRESOLVED"), "Y").otherwise("N")).alias("has_unresolved"),
    )
    known = lineage.filter("source_object is not null and source_column is not null")
    place = F.struct("source_object", "source_column").alias("o")
    none = F.lit(None).cast("string")
    values = known.filter(role == "VALUE").select(*key, F.lit("value").alias("list"), place, name.alias("text"))
    conditions = known.filter(role.isin("CONDITION", "WINDOW", "KEY")).select(*key, F.lit("condition"), place, F.concat(name, F.lit(" ("), F.lower(role), F.lit(")")))
    job_nums = lineage.filter("job_num is not null").select(*key, F.lit("job"), F.struct(none.alias("source_object"), none.alias("source_column")), F.col("job_num").cast("string")).distinct()
    lists = _lists(values.union(conditions).union(job_nums), key)
    shown = lists.groupBy(*key).agg(*[F.max(F.when(F.col("list") == x, F.col("listed"))).alias(c) for x, c in (("value", "value_sources"), ("condition", "condition_sources"), ("job", "job_nums"))])
    same = reduce(and_, [calculated[c].eqNullSafe(shown[c]) for c in key])
    return calculated.join(shown, same, "left").select(*[calculated[c] for c in key], "column_pos", "expression", "transform_type", "value_sources", "condition_sources", "lineage_origin", "job_nums", "has_unresolved")
