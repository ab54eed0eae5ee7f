"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: ASCII white space as the word contracts name it (space, TAB to CR).
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it any number of times in ``body``, JVM-side.

    A plain Column that is referenced inside a lambda is evaluated for every element;
    a lambda variable of a one-element array is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none a temporary folder is made and set, on one machine only: elsewhere executors would each
    write to a disk of their own, so that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = kept.get() if kept.isDefined() else None
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="veinmap-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/veinmap-{what}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = fresh_path(spark, what)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.kept_at = at
    return out


def drop_kept(df: DataFrame) -> None:
    """Remove a table that ``kept_table`` wrote and nothing reads any more."""
    drop_path(df.sparkSession, df.kept_at)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that are done: they go when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table that is no longer needed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; VEINMAP_TOKENIZERS names another folder."""
    folder = os.environ.get("VEINMAP_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
