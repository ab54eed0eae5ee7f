"""N-gram Jaccard join: documents whose shingle sets have a similarity of ``PERCENT`` or more.

Exact, by universe partition and pigeonhole:

* Equal sets are one node. Sets are put in size bands, each 1.25 times as wide as the last, so partners lie in
  the same or the next band; a set belongs to its own band and probes the one below.
* In band b two partners differ in at most H elements. The universe of hashes is cut into m = H + 1 + E segments:
  partners agree in at least E + 1 of them. A set indexes its segment subsets (a hash of the elements in a segment)
  but for the E that cost most: empty ones, then those whose index lists are longest, then those with fewest elements,
  equal ones by hash. List lengths come from a count of the segment subsets of all documents, in a table of ``SLOTS`` counters;
  only counters of twice the mean and more say anything about a subset. This order depends on the subsets alone, so of E + 1 common
  ones the cheapest is indexed by both, whatever the counts.
* A set with more than E empty segments can't leave them all out in this way. Two such partners may agree in empty
  segments only; then another segment differs by one element at most, so these sets also index each subset
  with one element deleted (and, if even that doesn't reach H + 1, their single elements).
* Buckets name candidates. Each bucket's members are compared with a pivot, the member with most bucket mates,
  which joins most of a group of copies with as many checks as members. What is left are pairs of members in
  different components: a task per bucket (large ones are dealt out in pairs of blocks) goes through them. Either way
  pairs first meet a test by sketches, whose distance is a lower bound of the sets' difference; only pairs
  within the bound go on. No bucket is cut and no candidate is dropped.
* Verification intersects the sets of 64-bit hashes.

Nothing grows with a group of equal texts but its rows. What is aggregated by bucket or root is written before it is joined
back, so that these joins are plain ones, whose hot keys adaptive execution splits. Signatures travel as arrays per task and partition, about 10 bytes each.

Defined results: null, empty and blank texts have the empty set and link with nothing; repeated rows and ids
are rows of their own; a null id is never a component's smallest one; empty tables give empty results; the
columns of the input don't matter but for the key and the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, free_shuffles, kept_table, shuffle_parts
from .components import components, sorted_groups
from .shingles import mix, shingle_sets
from .word_ids import slices

PERCENT = 80
SLACK = 0.2
ROUNDS = 1
KEY_BITS = 48
BLOCK = 2048
SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
KEYS_AT_ONCE = 20_000_000


@lru_cache(8)
def bands(percent: int, most: int = 1 << 40) -> list[tuple[int, int, int, int]]:
    """(least size, largest size, H, E) of each band."""
    out, low = [], 1
    while low <= most:
        high = low * 100 // percent
        diff = (100 - percent) * (high + high * 100 // percent) // (100 + percent)
        out.append((low, high, diff, max(1, -(-int(100 * SLACK) * (diff + 1) // 100))))
        low = high + 1
    return out


def band_of(n: int, percent: int = PERCENT) -> int:
    bs = bands(percent)
    lo, hi = 0, len(bs) - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if bs[mid][0] <= n else (lo, mid - 1)
    return lo


@lru_cache(4096)
def _edges(m: int) -> np.ndarray:
    """Lower ends of m equal parts of the 64-bit universe."""
    return np.array([(i << 64) // m for i in range(m)], np.uint64)


def _salted(values: np.ndarray, band: int, kind: int) -> np.ndarray:
    return mix(values ^ mix(np.array([(band << 8 | kind) + 1], np.uint64)))


def _segments(s: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, ...]:
    """(sizes, sums, hashes, scrambled elements) of the segment subsets of a sorted set in a band's namespace."""
    _, _, h, e = bands(percent)[band]
    m = h + 1 + e
    at = np.append(np.searchsorted(s, _edges(m)), len(s))
    scrambled = mix(s ^ np.uint64(0xA24BAED4963EE407))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scrambled)])
    subset = sums[at[1:]] - sums[at[:-1]]
    return np.diff(at), subset, mix(subset + np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), scrambled


def signatures(s: np.ndarray, band: int, percent: int = PERCENT, cost: np.ndarray | None = None) -> np.ndarray:
    """Keys of a sorted set in a band's namespace; ``cost`` has a class of list length for each slot."""
    _, _, h, e = bands(percent)[band]
    if h == 0:
        return np.zeros(0, np.uint64)  # only equal sets, which are one node
    size, subset, keys, scrambled = _segments(s, band, percent)
    m = len(size)
    salted = _salted(keys, band, 0)
    long = np.zeros(m, np.int8) if cost is None else cost[salted >> np.uint64(64 - SLOT_BITS)]
    order = np.lexsort((keys, size, -long, size > 0))
    empty = int((size == 0).sum())
    out = salted[order[max(e, empty) :]]
    if empty <= e:
        return out
    segment = np.repeat(np.arange(m, dtype=np.uint64), size)
    wide = np.repeat(size, size) >= 2
    less = mix((np.repeat(subset, size) - scrambled + segment * np.uint64(0x9E3779B97F4A7C15))[wide])
    more = [out, _salted(np.concatenate([keys[size > 0], less]), band, 1)]
    if int((size == 1).sum()) + 2 * int((size >= 2).sum()) < h + 1:
        more.append(_salted(s, band, 2))
    return np.concatenate(more)


def counted(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """How many segment subsets of the sets, in their own band and the one below, fall in each slot."""
    out = np.zeros(SLOTS, np.int64)
    for s in sets:
        own = band_of(len(s), percent) if len(s) else 0
        for b in range(max(own - 1, 0), own + 1) if len(s) else ():
            if bands(percent)[b][2]:
                size, _, keys, _ = _segments(s, b, percent)
                out += np.bincount((_salted(keys[size > 0], b, 0) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=SLOTS)
    return out


def classes(counts: np.ndarray) -> np.ndarray:
    """Class of list length of each slot: how often its count doubles the mean, 0 for those that don't stand out."""
    mean = max(counts.mean(), 1.0)
    return np.floor(np.log2(np.maximum(counts / mean, 1.0))).astype(np.int8)


def all_signatures(s: np.ndarray, percent: int = PERCENT, cost: np.ndarray | None = None) -> np.ndarray:
    """Keys of a set in its own band (lowest bit 0) and the band below (lowest bit 1)."""
    b = band_of(len(s), percent)
    own = signatures(s, b, percent, cost) & ~np.uint64(1)
    if b == 0:
        return own
    return np.concatenate([own, signatures(s, b - 1, percent, cost) | np.uint64(1)])


def _sets(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """(doc_id, tie, n, node, counts): size and digest of each document's set (null if empty); tie tells rows of one id apart.

    The last row of each task has none of these but the task's counts of segment subsets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = ["doc_id", "tie", "n", "node", "counts"], np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"))
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                counts += counted(list(dict(zip(nodes, sets, strict=True)).values()), percent)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.nulls(len(sets), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names)

    return _rows(docs, key, text).mapInArrow(run, "doc_id long, tie long, n long, node binary, counts binary")


def _total(counts: DataFrame) -> np.ndarray:
    """Sum of the tasks' counts, in two steps: SLOTS numbers, however much there is to count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(SLOTS, np.int64)
        for b in batches:
            for raw in b.column("counts").to_pylist():
                out += np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["counts"])

    some = counts.select("counts").repartition(max(1, int(counts.count() ** 0.5))).mapInArrow(run, "counts binary")
    row = some.repartition(1).mapInArrow(run, "counts binary").first()
    return np.frombuffer(row[0], np.int64) if row else np.zeros(SLOTS, np.int64)


def tie_of(text: Column) -> Column:
    return F.xxhash64(text)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), tie_of(F.col(text)).alias("tie"), F.col(text).alias("text"))


def _short(node: bytes) -> int:
    return int.from_bytes(node[:8], "little", signed=True)


_PACKED = "part int, keys binary, whose binary, ids binary"


def _signed(docs: DataFrame, text: str, parts: int, percent: int, cost: np.ndarray) -> DataFrame:
    """Signatures of each slice of documents, one row per partition: KEY_BITS of the key, position in ids, short ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, keys, sizes = [], [], []
                seen = set()
                for s in shingle_sets(part.column("text")):
                    if not len(s):
                        continue
                    node = _short(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    if node in seen:
                        continue
                    seen.add(node)
                    k = all_signatures(s, percent, cost)
                    if len(k):
                        ids.append(node)
                        keys.append(k)
                        sizes.append(len(k))
                if not keys:
                    continue
                key = np.concatenate(keys)
                whose = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
                dealt = ((key >> np.uint64(KEY_BITS)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(dealt, kind="stable")
                key, whose, dealt = key[order], whose[order], dealt[order]
                node_ids = np.array(ids, np.int64)
                at = np.searchsorted(dealt, np.arange(parts + 1))
                rows = []
                for p in np.flatnonzero(np.diff(at)).tolist():
                    a, b = at[p], at[p + 1]
                    who, place = np.unique(whose[a:b], return_inverse=True)
                    wide = "<u2" if len(who) <= 1 << 16 else "<u4"
                    rows.append((p, np.ascontiguousarray(key[a:b].view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]).tobytes(), place.astype(wide).tobytes(), node_ids[who].tobytes()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "keys", "whose", "ids"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, _PACKED)


def _unpacked(group: pa.Table, turn: int = 0, turns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(key, short id) of the signatures of one partition; of ``turns`` parts by bucket the one."""
    keys, who = [], []
    for k, w, i in zip(group.column("keys").to_pylist(), group.column("whose").to_pylist(), group.column("ids").to_pylist(), strict=True):
        n = len(k) // (KEY_BITS // 8)
        raw = np.zeros((n, 8), np.uint8)
        raw[:, : KEY_BITS // 8] = np.frombuffer(k, np.uint8).reshape(n, -1)
        key, short = raw.view("<u8").ravel(), np.frombuffer(i, "<i8")[np.frombuffer(w, "<u2" if len(w) == 2 * n else "<u4")]
        if turns > 1:
            mine = (key >> np.uint64(1)) % np.uint64(turns) == turn
            key, short = key[mine], short[mine]
        keys.append(key)
        who.append(short)
    return np.concatenate(keys), np.concatenate(who)


def buckets_of(key: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, short id, own) of buckets with two members or more, one of them in its own band.

    A bucket's number is a hash of its members, so that those with the same members become one, here and wherever else they
    come up. Here one is left out only if its members are those of another (compared, not only their hashes); elsewhere
    buckets of equal numbers come together, which only adds candidates.
    """
    bucket = key >> np.uint64(1)
    order = np.argsort(bucket)
    b = bucket[order]
    same = np.zeros(len(b), bool)
    same[1:] = b[1:] == b[:-1]
    same[:-1] |= same[1:]
    order = order[same]
    order = order[np.lexsort((key[order], who[order], bucket[order]))]
    b, w, probe = bucket[order], who[order], (key[order] & np.uint64(1)).astype(bool)
    if not len(b):
        return b, w, ~probe
    once = np.ones(len(b), bool)
    once[1:] = (b[1:] != b[:-1]) | (w[1:] != w[:-1])
    b, w, own = b[once], w[once], ~probe[once]
    starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    members = np.diff(np.append(starts, len(b)))
    content = np.add.reduceat(mix(w.view(np.uint64) * np.uint64(2) + own), starts)
    _, first, of = np.unique(content, return_index=True, return_inverse=True)
    # each member against that at the same place of the first bucket of that hash
    model = first[of]
    alike = members == members[model]
    offset = np.arange(len(b)) - np.repeat(starts, members)
    other = np.repeat(starts[model], members) + np.minimum(offset, np.repeat(members[model], members) - 1)
    alike &= np.logical_and.reduceat((w == w[other]) & (own == own[other]), starts)
    alike[first] = False
    keep = np.repeat((members >= 2) & np.logical_or.reduceat(own, starts) & ~alike, members)
    return np.repeat(mix(content), members)[keep], w[keep], own[keep]


def _buckets(signed: DataFrame) -> DataFrame:
    """(bucket, short, own) rows; a partition of very many signatures is unpacked and sorted in several turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["part"]):
            turns = 1 + pc.sum(pc.binary_length(g.column("keys"))).as_py() // (KEY_BITS // 8) // KEYS_AT_ONCE
            for turn in range(turns):
                b, w, own = buckets_of(*_unpacked(g, turn, turns))
                b = b.view(np.int64)
                for a in range(0, len(b), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(b[a : a + 50_000]), pa.array(w[a : a + 50_000]), pa.array(own[a : a + 50_000])], ["bucket", "short", "own"])

    return signed.repartition("part").sortWithinPartitions("part").mapInArrow(run, "bucket long, short long, own boolean").distinct()


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the numbers of hashes in 2^k bins (their lower bits), one to two bins a hash.

    Each bin in which two sketches differ holds at least one hash that only one of the sets has, so the number of
    these bins never exceeds the sets' difference, and comes close to it.
    """
    bits = min(15, max(6, len(s).bit_length()))
    return np.packbits((np.bincount((s & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1).astype(np.uint8), bitorder="little")


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of different widths as rows of 64-bit words of the least width: bins that fall together add up."""
    words = min(len(x) for x in sketches) // 8
    return np.array([np.bitwise_xor.reduce(np.frombuffer(x, "<u8").reshape(-1, words), axis=0) for x in sketches])


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lower bound of the differences of the sets in the rows of x and y."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _with_sets(rows: DataFrame) -> DataFrame:
    """(node, set, sketch) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], ["node", "set", "sketch"])

    return rows.mapInArrow(run, "node binary, set binary, sketch binary")


def crossing(root: np.ndarray, n: np.ndarray, own: np.ndarray, side: np.ndarray, sketches: list[bytes], one_block: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs in different components (``root``: small numbers) that may be similar, by size and sketch."""
    h = folded(sketches)
    most = np.bincount(root).argmax()
    rest = np.flatnonzero(root != most)
    out_a, out_b = [], []
    step = max(1, (1 << 20) // len(root))
    for k in range(0, len(rest), step):
        i = rest[k : k + step]
        ok = (root[i][:, None] != root[None]) & (own[i][:, None] | own[None]) & (100 * np.minimum(n[i][:, None], n[None]) >= percent * np.maximum(n[i][:, None], n[None]))
        # a pair of two of the rest comes up from either end; one is enough
        ok &= (root[None] == most) | (i[:, None] < np.arange(len(root))[None])
        if not one_block:
            ok &= side[i][:, None] != side[None]
        a, b = np.nonzero(ok)
        for t in range(0, len(a), 1 << 15):
            x, y = i[a[t : t + (1 << 15)]], b[t : t + (1 << 15)]
            near = apart(h[x], h[y]) * (100 + percent) <= (100 - percent) * (n[x] + n[y])
            out_a.append(x[near])
            out_b.append(y[near])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a) if out_a else none), (np.concatenate(out_b) if out_b else none)


def _plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, na, b, nb) that size and sketch don't rule out: small rows, before sets are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = [int(apart(*(r[None] for r in folded([x, y])))[0]) for x, y in zip(batch.column("ka").to_pylist(), batch.column("kb").to_pylist(), strict=True)]
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(np.array(far) * (100 + percent) <= (100 - percent) * n))

    left, right = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("ka")), sketches.select(F.col("node").alias("b"), F.col("sketch").alias("kb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a binary, b binary")


def _crossing_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) candidates of rows (bucket, node, n, own, root, sketch) in live buckets."""
    large = kept_table(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > BLOCK).select("bucket", F.ceil(F.col("rows") / BLOCK).cast("int").alias("nb")), "large")
    d = members.join(large, "bucket", "left").withColumn("side", F.when(F.col("nb").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("nb") - 1, F.lit(0))))).withColumn("bi", F.least("side", "other")).withColumn("bj", F.greatest("side", "other"))
    keys = ["bucket", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set[tuple[bytes, bytes]] = set()
        for g in sorted_groups(batches, keys):
            if g.num_rows < 2:
                continue
            node = g.column("node").to_pylist()
            one = g.column("bi")[0].as_py() == g.column("bj")[0].as_py()
            names: dict[bytes, int] = {}
            root = np.array([names.setdefault(x, len(names)) for x in g.column("root").to_pylist()])
            a, b = crossing(root, g.column("n").to_numpy(), g.column("own").to_numpy(zero_copy_only=False), g.column("side").to_numpy(), g.column("sketch").to_pylist(), one, percent)
            new = {(min(node[x], node[y]), max(node[x], node[y])) for x, y in zip(a.tolist(), b.tolist(), strict=True)} - said
            if not new:
                continue
            if len(said) > 200_000:
                said.clear()
            said |= new
            x, y = zip(*new, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["a", "b"])

    d = d.select(*keys, "side", "node", "n", "own", "root", "sketch")
    return d.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def near_texts(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, tie, n_shingles, node (its class of equal sets), component_id and root.

    ``component_id`` is the smallest id, which is null or shared where ids are; ``root`` is a node of the component and names it alone.
    """
    spark = docs.sparkSession
    read = kept_table(_sets(docs, key, text, percent), "sets")
    cost = classes(_total(read.filter("counts is not null")))
    every = read.filter("counts is null").drop("counts")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("rep")
    nodes = every.filter("node is not null").groupBy("node").agg(rep, F.first("n").alias("n"))
    members = kept_table(_member_rows(_buckets(_signed(docs, text, _parts(spark), percent, cost)), nodes), "buckets")
    wanted = members.groupBy("node").agg(F.first("rep").alias("rep")).select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.tie").alias("tie"))
    free_shuffles(spark)
    texts = _rows(docs, key, text).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(wanted.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))), ["doc_id", "tie"])
    candidates = kept_table(_with_sets(texts.select("node", "text")), "candidates")
    sets = candidates.dropDuplicates(["node"])
    mates = members.groupBy("node").agg(F.count(F.lit(1)).alias("mates"))
    free_shuffles(spark)
    full = kept_table(members.select("bucket", "node", "n", "own").join(mates, "node"), "members")
    drop_kept(members)
    members, used = full, [candidates, full]
    tested = links = root = None
    for r in range(rounds + 1):
        m = members.withColumn("root", F.col("node")) if root is None else members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # the first pivots have most bucket mates; later ones are others
        order = F.struct((-F.col("mates") if r == 0 else F.xxhash64("node", F.lit(r))).alias("o"), "node", "n", "root")
        live = kept_table(m.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.when(F.col("own"), order)).alias("pivot")).filter("lo <> hi"), "pivots")
        used.append(live)
        if r < rounds:
            m = m.join(live.select("bucket", "pivot"), "bucket").select("node", "n", "root", F.col("pivot.node").alias("pnode"), F.col("pivot.n").alias("pn"), F.col("pivot.root").alias("proot"))
            near = (F.col("root") != F.col("proot")) & (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn"))
            first = F.col("node") < F.col("pnode")
            ends = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("node", "pnode", "a"), ("n", "pn", "na"), ("pnode", "node", "b"), ("pn", "n", "nb"))]
            pairs = _plausible(m.filter(near).select(*ends).distinct(), sets, percent)
        else:
            m = kept_table(m.join(live.select("bucket"), "bucket", "left_semi").select("bucket", "node", "n", "own", "root"), "live")
            used.append(m)
            pairs = _crossing_pairs(m.join(sets.select("node", "sketch"), "node"), percent).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = kept_table(pairs, "pairs")
        found = kept_table(_linked(pairs, sets, percent), "links")
        used += [pairs, found]
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        root = components(links)
    for done in used:  # the result reads the sets' digests and the components alone
        drop_kept(done)
    of = nodes.select("node", F.col("rep.doc_id").alias("least")).join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = kept_table(of.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of = of.join(least, "root").select("node", "component_id", "root")
    out = every.join(of, "node", "left")
    return out.select("doc_id", "tie", F.col("n").alias("n_shingles"), "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root")


def _parts(spark) -> int:
    return min(1 << 16, 4 * shuffle_parts(spark))  # as many as the upper bits of a key can tell apart


def _member_rows(buckets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bucket rows with the nodes that their short ids name (two nodes of one short id are both members)."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_short(x) for x in b.column("node").to_pylist()], pa.int64()), *b.columns], ["short", *b.schema.names])

    named = nodes.mapInArrow(short, "short long, node binary, rep struct<none:boolean,doc_id:bigint,tie:bigint>, n long")
    return buckets.join(named, "short").select("bucket", "node", "n", "own", "rep")


def op2_near_texts(spark, sf_dir: str) -> DataFrame:
    return near_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
