"""Connected components of a graph of any size, and streaming over sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, kept_table


def _least(pairs: DataFrame) -> DataFrame:
    """Each node with the least of its neighbours (partial aggregation: a hub's edges meet as one row per task)."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, root): every node of an edge with the least node that it is connected with.

    Large-star and small-star steps in turn until the edges no longer change. A hub costs as many rows as it has
    edges, never pairs of neighbours. Least neighbours are written to the shared folder before they are joined back:
    that cuts lineage, and the join of a hub's edges is one that adaptive execution can split (it can't where a side is
    an aggregate of the same key) or turn into a broadcast of what it finds small. Tables of a round are removed
    after it. Edges with a null end are left out; loops give a node of its own.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    nodes = kept_table(e, "edges")
    e, before, used = nodes.filter("u <> v"), None, []
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hub = kept_table(_least(both), "least")
        large = kept_table(both.join(hub, "u").withColumn("m", F.least("m", "u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges")
        least = kept_table(_least(large), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = kept_table(small, "edges")
        for done in (*used, hub, large, least):
            drop_kept(done)
        used = [e]
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: no fixpoint")
    every = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return every.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches sorted by the keys; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            c = batch.column(k)
            change |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for i in range(len(starts) - 1):
            part = batch.slice(starts[i], starts[i + 1] - starts[i])
            if i == len(starts) - 2:
                held.append(part)
            elif held:
                yield pa.Table.from_batches([*held, part])
                held = []
            else:
                yield pa.Table.from_batches([part])
    if held:
        yield pa.Table.from_batches(held)
