"""Saved runs: the life cycle of a run on disk, and opening it again for reports and traces, also from SQL.

Below a folder each frame is a table partitioned by run, and ``runs`` holds a row for each run: RUNNING while it is
computed, then COMPLETED with its counts, or FAILED with the message and no frames.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import tokenize
from ..operators import trace
from ..sources.sinks import save_run
from .run import Lineage


def _drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _put_row(row: DataFrame, path: str, run_id: int) -> None:
    """A run has one row, which each state of it overwrites."""
    row.drop("run_id").coalesce(1).write.mode("overwrite").parquet(f"{path}/runs/run_id={run_id}")


def run_and_save(lineage: Lineage, path: str) -> DataFrame:
    """Write every frame of a run and its row; a run that fails leaves a row FAILED and no frames.

    A run of a number that is there already replaces it, so a repeated run gives no row twice.
    """
    spark, run_id, written = lineage.source.sparkSession, lineage.run_id, []
    _put_row(lineage.run_row("RUNNING"), path, run_id)
    try:
        for name, df in lineage.frames().items():
            written.append(name)
            save_run({name: df}, path, run_id)
        row = lineage.run_row()
    except Exception as problem:
        for name in written:
            _drop(spark, f"{path}/{name}/run_id={run_id}")
        _put_row(lineage.run_row("FAILED", str(problem)[:4000]), path, run_id)
        raise
    _put_row(row, path, run_id)
    return row


def latest_run(runs: DataFrame) -> DataFrame:
    """The id of the last completed run (one row, null if there is none)."""
    return runs.filter("status = 'COMPLETED'").agg(F.max("run_id").alias("run_id"))


#: A call of a trace in a FROM clause: its name and literal arguments.
_CALL = re.compile(r"\b(trace_object|trace_column)\s*\(", re.IGNORECASE)


@dataclass
class SavedRun:
    """A run's frames as they were written, and its traces."""

    spark: SparkSession
    path: str
    run_id: int

    def frame(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/run_id={self.run_id}")

    @cached_property
    def row(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/runs").filter(F.col("run_id") == self.run_id)

    def trace_object(self, name: str, direction: str = "UPSTREAM", max_depth: int = trace.OBJECT_DEPTH) -> DataFrame:
        return trace.trace_object(self.frame("edges"), name, direction, max_depth)

    def trace_column(self, name: str, column: str, direction: str = "UPSTREAM", max_depth: int = trace.COLUMN_DEPTH) -> DataFrame:
        return trace.trace_column(self.frame("column_lineage"), name, column, direction, max_depth)

    def sql(self, text: str) -> DataFrame:
        """A query over the run: ``{edges}`` and the like are its frames; ``trace_object('NAME', 'UP', depth)`` and
        ``trace_column('NAME', 'COLUMN', 'UP', depth)`` in a FROM clause are traces (the last arguments may be left out)."""
        frames: dict[str, DataFrame] = {}
        out, at = [], 0
        while m := _CALL.search(text, at):
            end = m.end()
            args: list = []
            for t in tokenize(text[m.end() :]):
                end = m.end() + t.end
                if t.kind == ")":
                    break
                if t.kind == "STR":
                    args.append(t.text[1:-1].replace("''", "'"))
                elif t.kind == "NUM":
                    args.append(int(t.text))
                elif t.kind != ",":
                    raise ValueError(f"{m.group(1)}: arguments must be literals, not {t.text}")
            name = f"trace_{len(frames)}"
            frames[name] = getattr(self, m.group(1).lower())(*args)
            out += [text[at : m.start()], f"{{{name}}}"]
            at = end
        text = "".join([*out, text[at:]])
        for name in set(re.findall(r"\{(\w+)\}", text)) - set(frames):
            frames[name] = self.frame(name)
        return self.spark.sql(text, **frames)


def open_run(spark: SparkSession, path: str, run_id: int | None = None) -> SavedRun:
    """A saved run, the last completed one unless a number is given."""
    runs = spark.read.parquet(f"{path}/runs")
    if run_id is None:
        run_id = latest_run(runs).first().run_id
    elif runs.filter((F.col("run_id") == run_id) & (F.col("status") == "COMPLETED")).isEmpty():
        run_id = None
    if run_id is None:
        raise ValueError(f"no such completed run below {path}")
    return SavedRun(spark, path, run_id)
