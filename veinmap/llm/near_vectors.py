"""Near duplicates among embeddings by rotated binary codes with correction factors.

Equal vectors are one node with a count. A node's unit vector o is turned by random orthogonal matrices (fixed
seed). Its code holds, for the first rotation, each coordinate in ``LEVELS`` even steps around zero (whose first bit
is its sign) as bit planes, the step, and the factor f = <s, o>, where s are the signs over sqrt(D); for further
rotations, as many as the tables need, signs alone. Codes, some 50 bytes for 64 dimensions, are what travels:

* Slices of ``k`` signs are the keys of ``L`` tables. Two vectors at the threshold agree in a sign with
  probability 1 - angle / pi, so L is chosen for them to meet in some table but with probability ``miss``; closer
  pairs meet more surely. k grows with the logarithm of the number of nodes, so buckets stay small.
* In a bucket, <s, q> / f is an unbiased estimate of <o, q>, with q from its steps. Its deviation for a pair at the
  threshold t has a variance of (1 - t^2) (1 - f^2) / (f^2 (D - 1)), and q's steps add step^2 / (12 f^2). Both
  vectors give an estimate; a pair whose mean estimate stays more than ``Z`` mean deviations below t is left out.
  One single-precision product over unpacked codes gives estimates and deviations of all pairs of a block.
* A pair counts in the first table where it meets, which both codes tell. Vectors are joined only to the
  members of such pairs, once per block that has any (never to pairs), and these pairs are computed in double precision.

Degrees add up without any list of pairs; links within a bucket leave it as a spanning forest. Buckets over
``BLOCK`` rows are cut into blocks, whose pairs go to different tasks. ``miss=0`` is the exact mode: one table, one
bucket, and no estimate, so that all pairs are computed, in blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components get no link and are
their own component; vectors of different lengths never link; copies (also under one id) link with each
other; rows with a null id get a null component unless linked to an id; empty input gives empty output.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import drop_kept, free_shuffles, kept_table
from .components import components, sorted_groups

THRESHOLD = 0.95
MISS = 1e-3
PER_BUCKET = 1024
BLOCK = 4096
PLANES = 4
LEVELS = 1 << PLANES
Z = 5.0
SEED = 20_240_517


@lru_cache(16)
def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random orthogonal matrices, one below the other."""
    rng = np.random.default_rng([SEED, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(k, L): bits of a key and number of tables for n nodes; (0, 1), all in one bucket, if all pairs are to be computed."""
    k = min(24, max(0, round(math.log2(max(n, 1) / PER_BUCKET))))
    if k == 0 or miss <= 0:
        return 0, 1
    agree = (1 - math.acos(threshold) / math.pi) ** k
    return k, math.ceil(math.log(miss) / math.log(1 - agree))


def digests(vectors: pa.Array) -> list[tuple[bytes, bytes] | None]:
    """(digest, components as bytes) of each vector, None for one that can't link."""
    lists = vectors.cast(pa.large_list(vectors.type.value_type))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    wide = np.float32 if pa.types.is_float32(flat.type) else np.float64
    x = pc.fill_null(flat, math.nan).to_numpy(zero_copy_only=False).astype(wide) + wide(0)  # no negative zeros
    ends = np.cumsum(sizes)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[ends], prepend=0)
    good = (sums(~np.isfinite(x)) == 0) & (sums(x != 0) > 0)
    raw, width = x.tobytes(), x.itemsize
    parts = [raw[(b - n) * width : b * width] if ok else None for b, n, ok in zip(ends.tolist(), sizes.tolist(), good.tolist(), strict=True)]
    return [None if p is None else (hashlib.blake2b(p, digest_size=16).digest(), p) for p in parts]


def _rows(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    exact = F.col(embedding)
    kind = vectors.schema[embedding].dataType
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)):
        exact = exact.cast("array<double>")
    return vectors.select(F.col(key).cast("long").alias("vec_id"), exact.alias("x"))


def _members(rows: DataFrame) -> DataFrame:
    """(vec_id, node): node is a digest of the components, null if the vector can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([d and d[0] for d in digests(b.column("x"))], pa.binary())], ["vec_id", "node"])

    return rows.mapInArrow(run, "vec_id long, node binary")


def _vectors(rows: DataFrame) -> DataFrame:
    """(node, n, x): each different vector once, with the number of its copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [d for d in digests(b.column("x")) if d]
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in good], pa.binary()), pa.array([d[1] for d in good], pa.binary())], ["node", "x"])

    return rows.select("x").mapInArrow(run, "node binary, x binary").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("x").alias("x"))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(u: np.ndarray, bits: int) -> np.ndarray:
    """Codes of unit vectors, a row of bytes each: step and factor (single precision), bit planes, signs of further rotations up to ``bits`` signs."""
    dim = u.shape[1]
    turned = u @ rotations(dim, max(1, -(-bits // dim))).T
    first = turned[:, :dim]
    step = np.abs(first).max(axis=1) / (LEVELS / 2 - 0.5)
    level = np.clip(np.floor(first / step[:, None]) + LEVELS // 2, 0, LEVELS - 1).astype(np.uint8)
    factor = np.abs(first).sum(axis=1) / math.sqrt(dim)
    planes = [np.packbits(level >> p & 1, axis=1) for p in range(PLANES - 1, -1, -1)]
    more = [np.packbits(turned[:, dim:bits] >= 0, axis=1)] if bits > dim else []
    return np.concatenate([np.stack([step, factor], axis=1).astype("<f4").view(np.uint8), *planes, *more], axis=1)


class Codes:
    """Codes of a block of rows, taken apart."""

    def __init__(self, codes: list[bytes], dim: int) -> None:
        raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        self.dim = dim
        self.step, self.factor = (c[:, None] for c in raw[:, :8].copy().view("<f4").T)
        wide = -(-dim // 8)
        planes = [np.unpackbits(raw[:, 8 + p * wide : 8 + (p + 1) * wide], axis=1, count=dim) for p in range(PLANES)]
        level = sum(x.astype(np.float32) * (1 << (PLANES - 1 - p)) for p, x in enumerate(planes))
        self.steps = (level - np.float32(LEVELS / 2 - 0.5)) * self.step
        self.signs = (planes[0].astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
        self.bits = np.concatenate([planes[0], np.unpackbits(raw[:, 8 + PLANES * wide :], axis=1)], axis=1)

    def keys(self, k: int, tables: int) -> np.ndarray:
        """The key of each row in each table."""
        return (self.bits[:, : k * tables].reshape(len(self.bits), tables, k).astype(np.int32) << np.arange(k, dtype=np.int32)).sum(axis=2, dtype=np.int32)

    def deviation(self, threshold: float) -> np.ndarray:
        """Deviation of the estimate by each row's signs, for a pair at the threshold and the widest step of the block."""
        f2 = np.maximum(self.factor.astype(np.float64) ** 2, 1e-12)
        return np.sqrt(((1 - threshold**2) * np.maximum(1 - f2, 0) / max(self.dim - 1, 1) + float(self.step.max()) ** 2 / 12) / f2)

    def near(self, left: np.ndarray, right: np.ndarray | None, threshold: float, z: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (positions) of left x right, or of left with itself, that the estimate doesn't rule out, strip by strip."""
        slack, one = (z * self.deviation(threshold)).astype(np.float32) if math.isfinite(z) else 0 * self.step, np.ones_like(self.step)
        by = self.signs / np.maximum(self.factor, np.float32(1e-6))
        rows, columns = np.concatenate([by, self.steps, slack, one], axis=1), np.concatenate([self.steps, by, one, slack], axis=1)
        least = np.float32(2 * threshold - 1e-5) if math.isfinite(z) else np.float32(-np.inf)
        for s in range(0, len(left), 512):
            i, j = left[s : s + 512], left[s:] if right is None else right
            a, b = np.nonzero(rows[i] @ columns[j].T >= least)
            if right is None:
                later = b > a
                a, b = a[later], b[later]
            yield i[a], j[b]


def linked(u: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs of rows of u have a cosine of the threshold or more, in double precision."""
    return np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", u[a[s : s + 32768]], u[b[s : s + 32768]]) >= threshold for s in range(0, len(a), 32768))])


def _coded(vectors: DataFrame, wide: str, bits: int) -> DataFrame:
    """The vectors with their dimension and code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("x").to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join([raw[i] for i in at]), wide).reshape(len(at), -1)
                codes = encode(unit(x), bits)
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x.shape[1], np.int32)), *part.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["dim", *part.schema.names, "code"])

    return vectors.mapInArrow(run, "dim int, node binary, n long, x binary, code binary")


BLOCK_KEYS = ["dim", "tab", "key", "bi", "bj"]
_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])


def _keyed(coded: DataFrame, k: int, tables: int, with_codes: bool = True) -> DataFrame:
    """(dim, tab, key) of each node in each table, with the node and its code."""
    names = ["node", "code"] if with_codes else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                for s in range(0, part.num_rows, 1000):
                    some = part.slice(s, 1000)
                    n = some.num_rows
                    keys = Codes(some.column("code").to_pylist(), dim).keys(k, tables)
                    rows = some.select(names).take(pa.array(np.repeat(np.arange(n), tables)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n * tables, dim, np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(keys.ravel()), *rows.columns], ["dim", "tab", "key", *names])

    return coded.select("dim", "node", "code").mapInArrow(run, "dim int, tab int, key int" + ", node binary, code binary" * with_codes)


def _blocks(coded: DataFrame, k: int, tables: int) -> DataFrame:
    """Adds (bi, bj, side): rows of a bucket over BLOCK rows are dealt to pairs of blocks.

    The large buckets' numbers of blocks are a written table, so that the join with it is a plain one: a broadcast if
    Spark finds it small, else one whose hot keys adaptive execution splits.
    """
    bucket = ["dim", "tab", "key"]
    sizes = _keyed(coded, k, tables, False).groupBy(*bucket).agg(F.count(F.lit(1)).alias("rows"))
    large = kept_table(sizes.filter(F.col("rows") > BLOCK).select(*bucket, F.ceil(F.col("rows") / BLOCK).cast("int").alias("nb")), "large")
    d = _keyed(coded, k, tables).join(large, bucket, "left").withColumn("side", F.when(F.col("nb").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("nb") - 1, F.lit(0)))))
    return d.withColumn("bi", F.least("side", "other")).withColumn("bj", F.greatest("side", "other")).drop("nb", "other")


def _first_met(g: pa.Table, k: int, tables: int, threshold: float, z: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions) of a block's rows that the estimate leaves, in the first table where they meet."""
    codes = Codes(g.column("code").to_pylist(), g.column("dim")[0].as_py())
    place, side = np.arange(g.num_rows), g.column("side").to_numpy()
    bi, bj, tab = (g.column(c)[0].as_py() for c in ("bi", "bj", "tab"))
    left, right = (place, None) if bi == bj else (place[side == bi], place[side == bj])
    keys = codes.keys(k, tables)
    for a, b in codes.near(left, right, threshold, z):
        for s in range(0, len(a), 1 << 16):
            x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            first = (keys[x] == keys[y]).argmax(axis=1) == tab
            yield x[first], y[first]


def _survivors(blocks: DataFrame, k: int, tables: int, threshold: float, z: float) -> DataFrame:
    """(block, side, node) of the members of pairs that the estimate leaves."""
    names = [*BLOCK_KEYS, "side", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, BLOCK_KEYS):
            if g.num_rows < 2:
                continue
            stays = np.zeros(g.num_rows, bool)
            for a, b in _first_met(g, k, tables, threshold, z):
                stays[a] = stays[b] = True
            if stays.any():
                yield from g.select(names).filter(pa.array(stays)).combine_chunks().to_batches()

    if math.isinf(z):
        return blocks.select(*names)
    return blocks.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS).mapInArrow(run, "dim int, tab int, key int, bi int, bj int, side int, node binary")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least connected position of each of n positions, by label propagation with pointer jumps."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def _links(survivors: DataFrame, coded: DataFrame, wide: str, k: int, tables: int, threshold: float, z: float) -> DataFrame:
    """(a, b, n): b null: n more links of node a; else a link of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.Table] = []
        held = 0
        for g in sorted_groups(batches, BLOCK_KEYS):
            if g.num_rows < 2:
                continue
            u = unit(np.frombuffer(b"".join(g.column("x").to_pylist()), wide).reshape(g.num_rows, -1))
            n, root, degree = g.column("n").to_numpy(), np.arange(g.num_rows), np.zeros(g.num_rows)
            for a, b in _first_met(g, k, tables, threshold, z):
                hit = linked(u, a, b, threshold)
                a, b = a[hit], b[hit]
                degree += np.bincount(a, n[b], g.num_rows) + np.bincount(b, n[a], g.num_rows)
                apart = root[a] != root[b]
                if apart.any():
                    every = np.arange(g.num_rows)
                    root = forest(g.num_rows, np.concatenate([every, a[apart]]), np.concatenate([root, b[apart]]))
            node = g.column("node")
            tied, some = np.flatnonzero(root != np.arange(g.num_rows)), np.flatnonzero(degree)
            if not len(some):
                continue
            ends = pa.concat_arrays([*node.take(pa.array(root[tied])).chunks, pa.nulls(len(some), pa.binary())])
            starts = pa.concat_arrays([*node.take(pa.array(tied)).chunks, *node.take(pa.array(some)).chunks])
            out.append(pa.table([starts, ends, pa.concat_arrays([pa.nulls(len(tied), pa.int64()), pa.array(degree[some].astype(np.int64))])], schema=_LINKS))
            held += out[-1].num_rows
            if held > 50_000:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out, held = [], 0
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    d = survivors.join(coded.select("node", "n", "x", "code"), "node").select(*BLOCK_KEYS, "side", "node", "n", "x", "code")
    return d.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS).mapInArrow(run, "a binary, b binary, n long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", embedding: str = "embedding", miss: float = MISS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. ``miss`` is the greatest chance to miss a pair at the threshold, 0 computes all pairs."""
    spark, rows = vectors.sparkSession, _rows(vectors, key, embedding)
    wide, z = "<f4" if isinstance(rows.schema["x"].dataType.elementType, FloatType) else "<f8", Z if miss > 0 else math.inf
    members = kept_table(_members(rows), "vectors")
    sizes = kept_table(members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")), "nodes")
    k, tables = plan(sizes.count(), threshold, miss)
    coded = kept_table(_coded(_vectors(rows), wide, k * tables), "codes")
    free_shuffles(spark)
    survivors = kept_table(_survivors(_blocks(coded, k, tables), k, tables, threshold, z), "survivors")
    free_shuffles(spark)
    links = kept_table(_links(survivors, coded, wide, k, tables, threshold, z), "links")
    for done in (coded, survivors):
        drop_kept(done)
    root = components(links.filter("b is not null"))
    degree = links.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    of = sizes.filter("node is not null").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = kept_table(of.groupBy("root").agg(F.min("least").alias("component_id")), "least")  # written: a plain join, whose hot keys are split
    of = of.join(least, "root").join(degree, "node", "left").select("node", "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = members.join(of, "node", "left")
    lone = F.col("node").isNull()
    component = F.when(lone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op1_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
