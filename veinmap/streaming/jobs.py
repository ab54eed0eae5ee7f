"""Keeping a lineage model up to date while its job table changes: a micro-batch of changed jobs at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.run import Lineage, build
from ..plans.saved import run_and_save


def current_jobs(changes: DataFrame) -> DataFrame:
    """The last state of every job in a log of changes (job columns, ``changed_at``, ``deleted``)."""
    last = Window.partitionBy("job_num").orderBy(F.col("changed_at").desc())
    return changes.withColumn("_n", F.row_number().over(last)).filter("_n = 1 and not coalesce(deleted, false)").drop("_n", "changed_at", "deleted")


def follow(changes: DataFrame, log: str, path: str, checkpoint: str, each: Callable[[Lineage], None] | None = None, **options) -> StreamingQuery:
    """Append each micro-batch of changes to ``log`` and rebuild the run from its current jobs below ``path``.

    A batch's run has the batch's number, so a batch that is repeated after a failure overwrites its part of the log
    and its run.
    """

    def rebuild(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
        run = build(current_jobs(spark.read.parquet(log).drop("batch")), run_id=number, **options)
        run_and_save(run, path)
        if each is not None:
            each(run)

    return changes.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
