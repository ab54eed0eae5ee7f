"""Which job depends on which, through any number of views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stable import stable

HOPS = 30


def job_dependencies(objects: DataFrame, jobs: DataFrame, edges: DataFrame, groups: DataFrame, hops: int = HOPS) -> DataFrame:
    """(job_num, depends_on_job, via_object, read_object, hops, dep_type, is_latest_writer, same_group).

    From each object read the walk goes up view edges, not beyond an object that some job writes. The walk is per object,
    not per job, so it costs one row for each pair of objects at each level.
    """
    seq = jobs.select("job_num", "exec_seq")
    writers = stable(objects.filter("object_role = 'TARGET'").select("job_num", F.col("object_name").alias("via_object")).distinct())
    reads = objects.filter("object_role = 'SOURCE'").select("job_num", F.col("object_name").alias("read_object")).distinct()
    steps = stable(edges.filter("job_num is null and is_self_loop = 'N'").select(F.col("target_node").alias("via_object"), F.col("source_node").alias("up")).distinct())
    written = writers.select("via_object").distinct()
    fresh = stable(reads.select("read_object").distinct().withColumn("via_object", F.col("read_object")))
    seen = fresh.withColumn("hops", F.lit(0))
    for n in range(1, hops + 1):
        onward = fresh.join(written, "via_object", "left_anti").join(steps, "via_object").select("read_object", F.col("up").alias("via_object")).distinct()
        fresh = stable(onward.join(seen, ["read_object", "via_object"], "left_anti"))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh.withColumn("hops", F.lit(n)))
    d = reads.join(seen, "read_object").join(writers.withColumnRenamed("job_num", "depends_on_job"), "via_object").filter("job_num <> depends_on_job")
    d = d.join(seq.withColumnRenamed("exec_seq", "c"), "job_num").join(seq.select(F.col("job_num").alias("depends_on_job"), F.col("exec_seq").alias("p")), "depends_on_job")
    prior = F.col("p") < F.col("c")
    last = F.max(F.when(prior, F.col("p"))).over(Window.partitionBy("job_num", "via_object"))
    d = d.withColumn("dep_type", F.when(prior, "PRIOR_STEP").otherwise("PRIOR_CYCLE")).withColumn("is_latest_writer", F.when(F.col("p") == last, "Y").otherwise("N"))
    names = groups.groupBy("job_num").agg(F.collect_set("group_name").alias("g"))
    d = d.join(names.withColumnRenamed("g", "g1"), "job_num", "left").join(names.select(F.col("job_num").alias("depends_on_job"), F.col("g").alias("g2")), "depends_on_job", "left")
    same = F.when(F.coalesce(F.arrays_overlap("g1", "g2"), F.lit(False)), "Y").otherwise("N")
    return d.select("job_num", "depends_on_job", "via_object", "read_object", "hops", "dep_type", "is_latest_writer", same.alias("same_group"))
