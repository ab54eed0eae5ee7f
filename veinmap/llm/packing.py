"""Packing documents, in their order, into sequences of a fixed length.

The ids of all documents (by ascending id, see ``ordered``) are cut into windows of at most ``limit``
ids. Dynamic programming over the places where a cut is allowed (document ends, sentence ends, and a
place every `HARD_STEP`` ids, or an eighth of the limit, in stretches without either) minimises padding plus a penalty per cut
inside a document: f(j) = penalty(j) + limit - pos(j) + min(f(i) + pos(i)) over the i within
``limit`` of j, a sliding minimum that a monotone queue gives in constant time each. Long
partitions run in blocks of ``BLOCK_IDS``: a block is cut at its best place near the end and the rest moves to
the next, so memory doesn't grow with the partition. The last window of a partition is split at
powers of two, which need no padding, if that is cheaper than padding it.

Defined results: a null or empty text is its end id alone; a text of any length is cut into as many
pieces as it takes; repeated rows are packed as often as they occur; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import tokenizer_path
from .ordered import by_id
from .word_ids import ENCODE_CHARS, encoder, slices

LIMIT = 4096
END_ID = 2
SENTENCE_PENALTY = 4
HARD_PENALTY = 48
HARD_STEP = 512
BLOCK_IDS = 1 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, step: int = HARD_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut may lie (ascending, the last is ``total``) and their penalties."""
    price = np.full(total + 1, -1, np.int8)
    price[[0, total]] = HARD_PENALTY
    price[sentence_ends] = SENTENCE_PENALTY
    price[doc_ends] = 0
    pos = np.flatnonzero(price >= 0)
    for k in np.flatnonzero(np.diff(pos) > step).tolist():
        price[pos[k] + step : pos[k + 1] : step] = HARD_PENALTY
    pos = np.flatnonzero(price >= 0)
    cost = price[pos].astype(np.int64)
    return pos[1:], cost[1:]


def cuts(pos: np.ndarray, cost: np.ndarray, limit: int, last: bool) -> list[int]:
    """Ascending window ends of least total cost; ends at the last place only if ``last``."""
    places, costs = [0, *pos.tolist()], [0, *cost.tolist()]
    best, back = [0] * len(places), [0] * len(places)
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, len(places)):
        p = places[j]
        while places[queue[0][1]] < p - limit:
            queue.popleft()
        low, i = queue[0]
        f = low + costs[j] + limit - p
        best[j], back[j] = f, i
        v = f + p
        while queue and queue[-1][0] >= v:
            queue.pop()
        queue.append((v, j))
    end = len(places) - 1
    if last:
        total = places[-1]
        near = [i for i in range(len(places) - 1) if places[i] >= total - limit]
        back[end] = min(near, key=lambda i: (best[i] + tail_cost(total - places[i], limit), -i))
    else:
        while end > 1 and places[end - 1] > places[-1] - limit:
            end -= 1
        end = min(range(end, len(places)), key=lambda j: best[j])
    out = []
    while end:
        out.append(places[end])
        end = back[end]
    return out[::-1]


def tail_cost(n: int, limit: int = LIMIT) -> int:
    return min(limit - n, HARD_PENALTY * (n.bit_count() - 1))


def tail_cuts(start: int, n: int, limit: int = LIMIT) -> list[int]:
    """Ends of the windows for a last stretch: itself, or powers of two from the largest on."""
    if limit - n <= HARD_PENALTY * (n.bit_count() - 1):
        return [start + n]
    sizes = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    return (start + np.cumsum(sizes)).tolist()


class _Buffer:
    """Ids that aren't packed yet, with the documents that they belong to."""

    def __init__(self) -> None:
        self.ids, self.ends, self.docs, self.size = [], [], [], 0

    def add(self, keys: list, ids: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> None:
        self.ids.append(ids)
        self.ends.append(ends)
        self.docs += [[k, 0, n, n] for k, n in zip(keys, counts.tolist(), strict=True)]  # key, ids before, ids left, all ids
        self.size += len(ids)

    def pack(self, limit: int, first: int, last: bool) -> tuple[pa.RecordBatch, int]:
        """Pieces of the windows so far, and the next free sequence number; what isn't packed stays."""
        ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
        lefts = np.array([d[2] for d in self.docs], np.int64)
        doc_ends = np.cumsum(lefts)
        pos, cost = candidates(doc_ends, np.flatnonzero(ends) + 1, len(ids), max(1, min(HARD_STEP, limit // 8)))
        windows = cuts(pos, cost, limit, last)
        if last:
            start = windows[-2] if len(windows) > 1 else 0
            windows = windows[:-1] + tail_cuts(start, len(ids) - start, limit)
        windows = np.array(windows, np.int64)
        done = int(windows[-1])
        bounds = np.union1d(windows, doc_ends[doc_ends < done])
        a = np.concatenate([[0], bounds[:-1]]).astype(np.int64)
        doc = np.searchsorted(doc_ends, a, "right")
        window = np.searchsorted(windows, a, "right")
        opens = np.concatenate([[0], windows])[window]
        before = np.array([d[1] for d in self.docs], np.int64)
        wide = ids.astype("<u4")
        crc = [zlib.crc32(wide[x:y]) for x, y in zip(a.tolist(), bounds.tolist(), strict=True)]
        columns = [
            pa.array([self.docs[k][0] for k in doc.tolist()], pa.int64()),
            pa.array(before[doc] + a - (doc_ends - lefts)[doc], pa.int64()),
            pa.array(bounds - a, pa.int64()),
            pa.array(crc, pa.int64()),
            pa.array(np.array([d[3] for d in self.docs], np.int64)[doc]),
            pa.array(first + window, pa.int64()),
            pa.array(a - opens, pa.int64()),
        ]
        rest = int(np.searchsorted(doc_ends, done, "right"))
        self.docs = self.docs[rest:]
        if self.docs and (cut := done - int((doc_ends - lefts)[rest])) > 0:
            self.docs[0][1] += cut
            self.docs[0][2] -= cut
        self.ids, self.ends, self.size = [ids[done:].copy()], [ends[done:].copy()], len(ids) - done
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")]), first + len(windows)


def pack(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = END_ID, key: str = "doc_id", text: str = "text", block: int = BLOCK_IDS) -> DataFrame:
    """One row per piece; sequence numbers are unique and ascend in document order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, buffer = encoder(vocabulary), _Buffer()
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, size=ENCODE_CHARS):
                got = enc.encode(part.column("text"), end_id)
                buffer.add(part.column("doc_id").to_pylist(), got.ids, got.ends, got.counts)
                if buffer.size >= block:
                    out, number = buffer.pack(limit, number, False)
                    yield out
        if buffer.size:
            out, number = buffer.pack(limit, number, True)
            yield out

    return by_id(docs, key, text).mapInArrow(run, PIECES)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
