"""Column lineage: what reading statements gave, and standard loads by column name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R

LINEAGE_COLUMNS = ("lineage_origin", "job_num", "target_object", "target_column", "column_pos", "expression", "transform_type", "source_object", "source_column", "ref_role", "resolution")


def read_lineage(read: DataFrame, objects: DataFrame) -> DataFrame:
    """Rows of the statements' own lineage; ``objects`` (id, job_num, object_name, lineage_origin) says whose they are."""
    r = read.select("id", "target", F.explode("lineage").alias("l")).join(objects, "id")
    return r.select("lineage_origin", "job_num", F.coalesce("target", "object_name").alias("target_object"), *[F.col(f"l.{c}").alias(c) for c in LINEAGE_COLUMNS[3:]])


def _standard(jobs: DataFrame, objects: DataFrame) -> DataFrame:
    o = objects.filter("derived_from = 'METADATA' and (object_role = 'TARGET' or ref_context = 'DATA')")
    t = o.filter("object_role = 'TARGET'").select("job_num", F.col("object_name").alias("tgt"))
    s = o.filter("object_role = 'SOURCE'").select("job_num", F.col("object_name").alias("src"))
    return jobs.filter("case_type = 'A_STANDARD'").select("job_num", "unique_col").join(t, "job_num").join(s, "job_num")


def standard_lineage(jobs: DataFrame, objects: DataFrame, columns: DataFrame | None, owner: str | None) -> DataFrame:
    """Column by column where the dictionary knows both tables, else one row for all columns."""
    j = _standard(jobs, objects)
    known = None
    if columns is not None:
        full = j.withColumn("to", R.owner_of(F.col("tgt"), owner)).withColumn("tn", R.name_of(F.col("tgt"))).withColumn("so", R.owner_of(F.col("src"), owner)).withColumn("sn", R.name_of(F.col("src")))
        tc = columns.select(F.col("owner").alias("to"), F.col("table_name").alias("tn"), "column_name", "column_id")
        sc = columns.select(F.col("owner").alias("so"), F.col("table_name").alias("sn"), "column_name")
        m = full.join(tc, ["to", "tn"]).join(sc, ["so", "sn", "column_name"])
        role = F.when(F.upper("unique_col") == F.col("column_name"), "KEY").otherwise("VALUE")
        known = m.select(F.lit("JOB_STANDARD").alias("lineage_origin"), "job_num", F.col("tgt").alias("target_object"), F.col("column_name").alias("target_column"), F.col("column_id").cast("int").alias("column_pos"), F.concat_ws(".", "src", "column_name").alias("expression"), F.lit("DIRECT").alias("transform_type"), F.col("src").alias("source_object"), F.col("column_name").alias("source_column"), role.alias("ref_role"), F.lit("DICTIONARY").alias("resolution"))
        j = j.join(known.select("job_num").distinct(), "job_num", "left_anti")
    star = j.select(F.lit("JOB_STANDARD").alias("lineage_origin"), "job_num", F.col("tgt").alias("target_object"), F.lit("*").alias("target_column"), F.lit(None).cast("int").alias("column_pos"), F.concat("src", F.lit(".*")).alias("expression"), F.lit("STAR").alias("transform_type"), F.col("src").alias("source_object"), F.lit("*").alias("source_column"), F.lit("VALUE").alias("ref_role"), F.lit("UNEXPANDED").alias("resolution"))
    return star if known is None else known.unionByName(star)
