"""Jobs, their groups, and the objects and edges that they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.stable import numbered

JOB_COLUMNS = ("job_num", "job_names", "target_object", "source_object", "unique_col", "filter_clause", "sql_stmt", "disabled_flag")


def exec_sequence(jobs: DataFrame, by: str = "job_num", name: str = "exec_seq") -> DataFrame:
    """Adds the place of each row in the order of ``by``, without bringing all rows to one task."""
    return numbered(jobs, by, name=name)[0]


def load_jobs(source: DataFrame) -> DataFrame:
    """Snapshot of a job table: trimmed names, activity, execution order."""
    names = {c.lower(): c for c in source.columns}
    jobs = source.select(*[F.col(names[c]).alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in JOB_COLUMNS]).filter("job_num is not null")
    jobs = jobs.withColumn("job_num", F.col("job_num").cast("long"))
    for c in JOB_COLUMNS[1:5]:
        jobs = jobs.withColumn(c, R.filled(F.trim(c)))
    for c in JOB_COLUMNS[5:]:
        jobs = jobs.withColumn(c, R.filled(F.col(c)))
    jobs = jobs.withColumn("is_active", F.when(R.is_disabled(F.col("disabled_flag")) == "Y", "N").otherwise("Y"))
    return exec_sequence(jobs)


def group_parts(names: Column) -> Column:
    """Segments of ``A|B|C`` without blanks and empty ones."""
    return F.filter(F.transform(F.split(names, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def job_groups(jobs: DataFrame) -> DataFrame:
    """(job_num, group_name, group_pos, group_path): a row for each segment of the path."""
    parts = jobs.select("job_num", group_parts(F.col("job_names")).alias("parts"))
    return parts.select("job_num", "parts", F.posexplode("parts").alias("i", "group_name")).select("job_num", "group_name", (F.col("i") + 1).alias("group_pos"), F.array_join(F.slice("parts", F.lit(1), F.col("i") + 1), "|").alias("group_path"))


def job_statements(jobs: DataFrame, owner: str | None) -> DataFrame:
    """Statements (id, sql, target, owner) that the active jobs need read: own SQL, or a filter of a standard load."""
    j = named_jobs(jobs, owner)
    own = j.filter("sql is not null").select(F.concat(F.lit("J"), F.col("job_num")).alias("id"), F.col("sql"), F.lit(None).cast("string").alias("target"), F.lit(owner).cast("string").alias("owner"), F.lit(True).alias("dictionary"))
    filters = j.filter("sql is null and filter_clause is not null and src is not null")
    asked = filters.select(F.concat(F.lit("F"), F.col("job_num")), F.concat(F.lit("select * from "), "src", F.lit(" where "), "filter_clause"), F.lit(None).cast("string"), F.lit(owner).cast("string"), F.lit(False))
    return own.union(asked)


def named_jobs(jobs: DataFrame, owner: str | None) -> DataFrame:
    """Active jobs with canonical target (tgt), source (src) and statement (sql)."""
    src = F.when(~R.is_label(F.col("source_object")), R.norm(F.col("source_object"), owner))
    return jobs.filter("is_active = 'Y'").withColumn("tgt", R.norm(F.col("target_object"), owner)).withColumn("src", src).withColumn("sql", R.clean_sql(F.col("sql_stmt")))


def classified_jobs(jobs: DataFrame, read: DataFrame, owner: str | None) -> DataFrame:
    """Jobs with case, action, load key and the outcome of reading; ``refs`` holds canonical names in the order of reading."""
    j = named_jobs(jobs, owner)
    own = read.filter("id like 'J%'").select(F.substring("id", 2, 20).cast("long").alias("job_num"), "status", "message", "statement", "refs")
    asked = read.filter("id like 'F%'").select(F.substring("id", 2, 20).cast("long").alias("job_num"), F.col("refs").alias("filter_refs"))
    j = j.join(own, "job_num", "left").join(asked, "job_num", "left")
    named = lambda c: F.transform(F.col(c), lambda x: F.struct(R.norm(x["object_name"], owner).alias("name"), x["object_role"].alias("role"), x["ref_context"].alias("context")))
    j = j.withColumn("refs", named("refs")).withColumn("filter_refs", named("filter_refs"))
    standard = F.col("sql").isNull()
    reads = F.exists("refs", lambda x: (x["role"] == "SOURCE") & ~R.is_one_row(x["name"]))
    targets = F.transform(F.filter("refs", lambda x: x["role"] == "TARGET"), lambda x: x["name"])
    j = j.withColumn("targets", targets).withColumn("case_type", F.when(standard, "A_STANDARD").otherwise("B_SQL"))
    j = j.withColumn("action_type", F.when(standard, R.load_action(F.col("unique_col"))).otherwise(R.sql_action(F.col("statement"), reads)))
    fallback = ~standard & ((F.col("status") == "FAILED") | ((F.size("targets") == 0) & (F.coalesce("statement", F.lit("")) != "PLSQL")))
    j = j.withColumn("parse_status", F.when(standard, "N_A").when(fallback, "FALLBACK").otherwise(F.col("status")))
    differs = (F.col("case_type") == "B_SQL") & (F.col("parse_status") != "FALLBACK") & (F.col("statement") != "PLSQL") & (F.get("targets", F.lit(0)) != F.col("tgt"))
    said = F.concat(F.lit("TARGET_OBJECT "), "tgt", F.lit(" differs from SQL target "), F.get("targets", F.lit(0)))
    j = j.withColumn("parse_message", F.when(standard, F.lit(None)).when(differs, F.concat_ws(" | ", said, "message")).otherwise(F.col("message")))
    return j.withColumn("load_key", F.when(standard, R.load_key(F.col("unique_col"))))


_OBJECT = "array<struct<name:string,role:string,context:string,derived:string>>"
_EDGE = "array<struct<src:string,tgt:string,origin:string,context:string>>"


def _effects(j: DataFrame) -> DataFrame:
    """Adds arrays ``objects`` and ``links`` of each classified job, in the order in which they come up."""
    obj = lambda name, role, context, derived: F.struct(name.alias("name"), F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"), F.lit(context).alias("context") if isinstance(context, str) else context.alias("context"), F.lit(derived).alias("derived"))
    link = lambda src, tgt, origin, context: F.struct(src.alias("src"), tgt.alias("tgt"), F.lit(origin).alias("origin"), F.lit(context).alias("context") if isinstance(context, str) else context.alias("context"))
    tgt, src = F.col("tgt"), F.col("src")
    real = lambda c: F.filter(c, lambda x: (x["role"] == "SOURCE") & ~R.is_one_row(x["name"]))
    meta = lambda derived: F.array(obj(tgt, "TARGET", "DATA", derived), obj(src, "SOURCE", "DATA", derived))
    others = F.filter(F.coalesce("filter_refs", F.array().cast("array<struct<name:string,role:string,context:string>>")), lambda x: (x["role"] == "SOURCE") & (x["name"] != src))
    objects = (
        F.when(F.col("case_type") == "A_STANDARD", F.concat(meta("METADATA"), F.transform(others, lambda x: obj(x["name"], "SOURCE", "FILTER", "METADATA"))))
        .when(F.col("parse_status") == "FALLBACK", meta("FALLBACK"))
        .when(F.col("statement") == "PLSQL", F.concat(F.array(obj(tgt, "TARGET", "DATA", "METADATA")), F.transform("refs", lambda x: obj(x["name"], x["role"], F.when(x["role"] == "SOURCE", x["context"]).otherwise("DATA"), "SQL_PARSE")), F.array(obj(src, "SOURCE", "DATA", "METADATA"))))
        .otherwise(F.concat(F.transform("targets", lambda t: obj(t, "TARGET", "DATA", "SQL_PARSE")), F.transform(real(F.col("refs")), lambda x: obj(x["name"], "SOURCE", x["context"], "SQL_PARSE"))))
    )
    direct = lambda origin: F.array(link(src, tgt, origin, "DATA"))
    called = F.transform(F.filter("refs", lambda x: x["role"] == "CALL"), lambda x: link(x["name"], tgt, "JOB_PLSQL", "DATA"))
    read = F.transform(real(F.col("refs")), lambda x: link(x["name"], F.coalesce(tgt, x["name"]), "JOB_SQL", x["context"]))
    links = (
        F.when(F.col("case_type") == "A_STANDARD", F.concat(direct("JOB_STANDARD"), F.transform(others, lambda x: link(x["name"], tgt, "JOB_STANDARD", "FILTER"))))
        .when(F.col("parse_status") == "FALLBACK", direct("JOB_FALLBACK"))
        .when(F.col("statement") == "PLSQL", F.concat(called, read, direct("JOB_PLSQL")))
        .otherwise(F.flatten(F.transform("targets", lambda t: F.transform(real(F.col("refs")), lambda x: link(x["name"], t, "JOB_SQL", x["context"])))))
    )
    return j.withColumn("objects", objects.cast(_OBJECT)).withColumn("links", links.cast(_EDGE))


def job_objects(j: DataFrame) -> DataFrame:
    """(job_num, object_name, object_role, ref_context, derived_from): of repeated objects of a job the first stays."""
    e = _effects(j).select("job_num", F.posexplode("objects").alias("i", "o")).filter("o.name is not null")
    e = e.filter(~R.is_one_row(F.col("o.name")))
    return e.groupBy("job_num", F.col("o.name").alias("object_name"), F.col("o.role").alias("object_role"), F.col("o.context").alias("ref_context")).agg(F.min_by("o.derived", "i").alias("derived_from"))


EDGE_COLUMNS = ("source_node", "target_node", "job_num", "job_names", "action_type", "edge_origin", "ref_context", "is_self_loop")


def job_edges(j: DataFrame) -> DataFrame:
    """Edges of the jobs, each once."""
    e = _effects(j).select("job_num", "job_names", "action_type", F.explode("links").alias("l"))
    e = e.filter("l.src is not null and l.tgt is not null").filter(~R.is_one_row(F.col("l.src")))
    e = e.select(F.col("l.src").alias("source_node"), F.col("l.tgt").alias("target_node"), "job_num", "job_names", "action_type", F.col("l.origin").alias("edge_origin"), F.col("l.context").alias("ref_context"))
    return e.withColumn("is_self_loop", F.when(F.col("source_node") == F.col("target_node"), "Y").otherwise("N")).dropDuplicates(["source_node", "target_node", "job_num", "edge_origin", "ref_context"]).select(*EDGE_COLUMNS)


def group_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges of each group's jobs."""
    return groups.select("job_num", "group_name").join(edges.filter("job_num is not null"), "job_num")


def group_node_class(grouped: DataFrame) -> DataFrame:
    """(group_name, node_name, group_node_class) within a group's own graph, self loops left out."""
    e = grouped.filter("is_self_loop = 'N'")
    ends = e.select("group_name", F.col("source_node").alias("node_name"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(e.select("group_name", F.col("target_node").alias("node_name"), F.lit(0).alias("s"), F.lit(1).alias("t")))
    by = ends.groupBy("group_name", "node_name").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    return by.select("group_name", "node_name", F.when(F.col("t") == 0, "ROOT").when(F.col("s") == 0, "TERMINAL").otherwise("INTERMEDIATE").alias("group_node_class"))
