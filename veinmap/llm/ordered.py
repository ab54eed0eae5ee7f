"""Documents dealt to partitions by ascending id, for outputs whose order matters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts


def by_id(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) range-partitioned and sorted by id, nulls first, equal ids by a hash of the text.

    The hash lets repeated ids with different texts spread over partitions; the number of partitions
    is fixed, so partition numbers follow the order.
    """
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    return d.repartitionByRange(shuffle_parts(docs.sparkSession), F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
