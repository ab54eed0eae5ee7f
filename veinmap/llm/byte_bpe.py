"""Byte-level BPE: encoding by numpy matrices, and decoding.

A text is split by the vocabulary's pattern. Pieces that are a token themselves take its
rank; all other new pieces of a batch are sorted by length into padded matrices, in which every row merges its
leftmost pair of least rank per round. Pair ranks come from an open-addressing hash table of all pairs
of tokens whose join is a token; after each round the merged place is closed up and finished
rows leave the matrix. Pieces over ``LONG_PIECE`` bytes (one run of letters may be a whole text) would
need as many rounds as they have bytes; they take the same merges, in the same order, from a heap over a
linked list in n log n.

Pieces and their ids stay in a bounded cache of the worker. Defined results: a null or empty text has no ids;
ids decode to the exact bytes of the text; rows are independent, so ties, repeated rows and
empty tables need no rule.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import tokenizer_path
from .word_ids import slices

LONG_PIECE = 256
CACHE_PIECES = 300_000
NO_RANK = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)

_CODECS: dict[str, "ByteBPE"] = {}


class PairTable:
    """Rank of a pair of ids, by open addressing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(left) + 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NO_RANK, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[at[todo]] == -1]
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays; the others probe on
            self.ranks[at[free]] = rank[free]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        out = np.full(keys.shape, NO_RANK, np.int32)
        todo = np.arange(keys.size)
        flat, slot, res = keys.ravel(), at.ravel(), out.ravel()
        for _ in range(self.probes):
            held = self.keys[slot[todo]]
            hit = held == flat[todo]
            res[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        return res.reshape(keys.shape)


class ByteBPE:
    """Codec for one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # white space as the Unicode property names it, which is what the library's pattern engine takes
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*pairs, strict=True)))
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            tokens[r] = t
        self.token_sizes = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of like length."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        width = int(sizes.max())
        ids = np.full((len(pieces), width + 1), -1, np.int64)
        inside = np.arange(width + 1) < sizes[:, None]
        ids[inside] = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        rows = np.arange(len(pieces))
        ranks = np.full((len(pieces), width), NO_RANK, np.int32)
        both = inside[:, 1:]
        ranks[both] = self.pairs.find(ids[:, :-1][both], ids[:, 1:][both])
        while len(rows):
            k = ranks.argmin(axis=1)  # the first of equal ranks
            r = np.arange(len(rows))
            least = ranks[r, k]
            done = least == NO_RANK
            if done.any():
                for x in np.flatnonzero(done):
                    out[rows[x]] = ids[x, : sizes[x]].copy()
                keep = ~done
                rows, ids, ranks, sizes, k, least = rows[keep], ids[keep], ranks[keep], sizes[keep], k[keep], least[keep]
                if not len(rows):
                    break
                r = np.arange(len(rows))
            ids[r, k] = least
            # close up: what stands after k + 1 moves one to the left
            width = int(sizes.max())
            cols = np.arange(width)
            src = cols + (cols > k[:, None])
            ids = np.take_along_axis(ids, src, 1)
            ids = np.concatenate([ids, np.full((len(rows), 1), -1)], 1)
            ranks = np.take_along_axis(ranks, np.minimum(src, ranks.shape[1] - 1), 1)
            sizes = sizes - 1
            for side in (k - 1, k):
                ok = (side >= 0) & (side + 1 < sizes)
                ranks[r[ok], side[ok]] = self.pairs.find(ids[r[ok], side[ok]], ids[r[ok], side[ok] + 1])
                end = (side >= 0) & (side + 1 >= sizes)
                ranks[r[end], side[end]] = NO_RANK
            ranks[cols[None, :] + 1 >= sizes[:, None]] = NO_RANK
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: the same merges from a heap of (rank, place)."""
        ids = self.byte_rank[np.frombuffer(piece, np.uint8)].astype(np.int64)
        n = len(ids)
        first = self.pairs.find(ids[:-1], ids[1:])
        heap = [(int(r), k) for k, r in enumerate(first.tolist()) if r != NO_RANK]
        heapq.heapify(heap)
        val, nxt, prv, now = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), first.tolist() + [int(NO_RANK)]
        none = int(NO_RANK)

        def rank(k: int) -> None:
            j = nxt[k]
            now[k] = int(self.pairs.find(np.array([val[k]]), np.array([val[j]]))[0]) if j < n else none
            if now[k] != none:
                heapq.heappush(heap, (now[k], k))

        while heap:
            r, k = heapq.heappop(heap)
            if now[k] != r or val[k] < 0:
                continue
            j = nxt[k]
            val[k], val[j], now[j] = r, -1, none
            nxt[k] = nxt[j]
            if nxt[k] < n:
                prv[nxt[k]] = k
            rank(k)
            if prv[k] >= 0:
                rank(prv[k])
        return np.array([v for v in val if v >= 0], np.int64)

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece."""
        raw = [p.encode() for p in pieces]
        out: list[np.ndarray | None] = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(raw):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int64)
            elif len(p) > LONG_PIECE:
                out[i] = self._long(p)
            else:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(i)
        for group in buckets.values():
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                for i, ids in zip(part, self._matrix([raw[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def learn(self, pieces: set[str]) -> None:
        """Add what is new of a batch's pieces to the cache: ids as bytes, and their decimals."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known.clear()
            new = list(pieces)
        for p, ids in zip(new, self.encode_pieces(new), strict=True):
            self.known[p] = (ids.astype("<u4").tobytes(), ",".join(map(str, ids.tolist())).encode())

    def encode_texts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids of each text and their decimals joined by commas; new pieces of all texts are encoded together."""
        split = [self.pattern.findall(t or "") for t in texts]
        self.learn(set().union(*split))
        for pieces in split:
            known = [self.known[p] for p in pieces]
            yield np.frombuffer(b"".join([k[0] for k in known]), "<u4"), b",".join([k[1] for k in known])

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_texts([text]))[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, gathered from one buffer of all tokens."""
        sizes = self.token_sizes[ids]
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(after) else 0
        return self.token_bytes[np.repeat(self.token_starts[ids] - (after - sizes), sizes) + np.arange(total)].tobytes()


def codec(path: str, pattern: str) -> ByteBPE:
    if path not in _CODECS:
        _CODECS[path] = ByteBPE(path, pattern)
    return _CODECS[path]


def encode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each text; a projection, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = [x.astype(np.int32) for x, _ in bpe.encode_texts(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and text of each array of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary, pattern)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encode, decode and digest each text in one pass, so that ids needn't be stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for ids, decimals in bpe.encode_texts(part.column("text").to_pylist()):
                    rows.append((len(ids), hashlib.sha256(decimals).hexdigest(), hashlib.sha256(bpe.decode(ids.astype(np.int64))).hexdigest()))
                n, enc, dec = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(enc), pa.array(dec)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
