"""From a job sheet to its lineage: ``python -m veinmap jobs.csv --out lineage [--owner ME] [--views views.csv]``."""

from __future__ import annotations

import argparse
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph
from .plans.run import Lineage, build
from .sources import sinks, tables


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """A job table by the ending of its file."""
    kind = path.rsplit(".", 1)[-1].lower()
    readers = {"xlsx": tables.read_jobs_workbook, "parquet": tables.read_jobs_parquet}
    return readers.get(kind, tables.read_jobs_csv)(spark, path)


def write_all(run: Lineage, out: str) -> DataFrame:
    """CSV of every flat frame, a flowchart for each group, load and extraction scripts; returns the summary."""
    flat = {n: df for n, df in run.frames().items() if n not in ("ast", "view_ddl")}
    sinks.save_csv(flat, f"{out}/csv")
    charts = sinks.flowcharts(run.edges, run.groups, run.nodes)
    name = F.regexp_replace(F.regexp_replace("group_name", "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    lines = charts.select(F.when(name == "", "group").otherwise(name).alias("chart"), "group_name", "line_no", "line")
    lines.repartitionByRange("chart", "group_name", "line_no").sortWithinPartitions("chart", "group_name", "line_no").select("chart", "line").write.mode("overwrite").partitionBy("chart").text(f"{out}/flowcharts")
    sinks.load_script(run.loaded).orderBy("job_num").select("statement").write.mode("overwrite").text(f"{out}/load_script")
    views = run.nodes.filter("node_type = 'VIEW' and not contains(node_name, '.')").select("node_name")
    sinks.view_script_lines(views, run.owner).write.mode("overwrite").text(f"{out}/view_script")
    return sinks.summary(run.jobs, run.nodes, run.edges)


def main(argv: list[str] | None = None) -> None:
    ask = argparse.ArgumentParser(prog="veinmap", description=__doc__)
    ask.add_argument("jobs", help="job table: CSV, Parquet or workbook")
    ask.add_argument("--out", default="lineage", help="folder of the results")
    ask.add_argument("--owner", help="schema whose prefix object names don't need")
    ask.add_argument("--views", help="CSV of view definitions: OWNER, VIEW_NAME, TEXT")
    ask.add_argument("--driver-edges", type=int, default=graph.DRIVER_EDGES, help="edges up to which components are found on the driver")
    a = ask.parse_args(argv)
    spark = SparkSession.builder.appName("veinmap").getOrCreate()
    views = tables.read_views_csv(spark, a.views) if a.views else None
    run = build(read_jobs(spark, a.jobs), owner=a.owner, views=views, driver_edges=a.driver_edges)
    for row in write_all(run, re.sub("/+$", "", a.out)).collect():
        print(f"{row.item}: {row.n}")


if __name__ == "__main__":
    main()
