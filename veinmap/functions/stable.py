"""Results that later steps read several times: written once, with no lineage."""

from __future__ import annotations

import tempfile
import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none a temporary folder is made, on one machine only: elsewhere executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="veinmap-"))
    return context._jsc.sc().getCheckpointDir().get()


def stable(df: DataFrame) -> DataFrame:
    """``df`` as a table written in the shared folder, which survives lost executors.

    Unlike a checkpoint it also has the size that it has: a checkpoint keeps its plan's estimate, which in
    loops of joins is multiplied round by round.
    """
    spark = df.sparkSession
    df = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.typeName() == "void" else F.col(f"`{f.name}`") for f in df.schema.fields])
    at = f"{shared_folder(spark)}/veinmap-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def numbered(df: DataFrame, *order: str | Column, name: str = "rn", start: int = 1) -> tuple[DataFrame, int]:
    """``df`` with the place of each row in the given order, and the number of rows.

    Rows are dealt by range and sorted; a row's place is its place in its partition and the rows of the partitions
    before, of which the driver sees one number each. The dealt rows are written once, since a second
    evaluation could deal them otherwise.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stable(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = dict(dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    last = max(sizes, default=0)
    before = [start, *accumulate((sizes.get(i, 0) for i in range(last + 1)), initial=start)][1:]
    moved = F.get(F.array(*[F.lit(b).cast("long") for b in before]), part.cast("int"))
    return dealt.withColumn(name, moved + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place"), sum(sizes.values())
