"""Token ids as flat unsigned files with 64-bit document offsets.

One shard per range partition of the ids: ``shard-N.bin`` holds the ids as little-endian unsigned
integers (16 bits if the vocabulary allows, else 32), ``shard-N.idx`` the documents: magic, width, count, document
ids, a byte each that marks a null id, and count + 1 offsets, all 64-bit. ``bases`` come from a
prefix sum over the shards' counts (one number a shard, the only thing that reaches the driver), so a
document's place in the whole is base + offset. Readers map the files into memory where they are
local, else they read the index and then the ids by range through the same file system.

A task writes under its attempt's name and renames at the end, so a retried or speculative
task leaves the same files. Defined results: a null text is an empty one (the end id only), a null document
id sorts first and is kept as null, repeated ids stay separate documents, an empty table gives no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import fresh_path, tokenizer_path
from .ordered import by_id
from .word_ids import ENCODE_CHARS, encoder, slices

MAGIC = b"VMTOKS01"
END_ID = 2


@dataclass(frozen=True)
class TokenFiles:
    """A written set: folder, and for each shard its number, documents, ids and base."""

    folder: str
    shards: list[tuple[int, int, int, int]]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> TokenFiles:
    """Write the ids of all documents in ascending order of ``key``."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        enc = encoder(vocabulary)
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        final = f"{root}/shard-{shard:06d}"
        keys, nulls, counts = [], [], []
        out = None
        for batch in batches:
            for part in slices(batch, size=ENCODE_CHARS):
                if out is None:
                    out = store.open_output_stream(f"{final}.bin.{attempt}")
                got = enc.encode(part.column("text"), end_id)
                out.write(got.ids.tobytes())
                ids = part.column("doc_id")
                keys.append(ids.fill_null(0).to_numpy(zero_copy_only=False))
                nulls.append(ids.is_null().to_numpy(zero_copy_only=False))
                counts.append(got.counts)
        if out is None:
            return
        out.close()
        n = np.concatenate(counts)
        offsets = np.concatenate([[0], np.cumsum(n)])
        with store.open_output_stream(f"{final}.idx.{attempt}") as idx:
            idx.write(MAGIC + np.array([enc.dtype.itemsize, len(n)], "<u8").tobytes())
            idx.write(np.concatenate(keys).astype("<i8").tobytes() + np.concatenate(nulls).astype("u1").tobytes())
            idx.write(offsets.astype("<u8").tobytes())
        for kind in ("bin", "idx"):
            store.move(f"{final}.{kind}.{attempt}", f"{final}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(n)], "ids": [int(offsets[-1])]})

    rows = sorted(by_id(docs, key, text).mapInArrow(write, "shard long, docs long, ids long").collect())
    base, shards = 0, []
    for shard, n, ids in rows:
        shards.append((shard, n, ids, base))
        base += ids
    return TokenFiles(folder, shards)


class Shard:
    """One shard: its documents' ids, null marks and offsets, and ranges of its ids; mapped into memory or, where it isn't local, read by range."""

    def __init__(self, folder: str, shard: int) -> None:
        self.store, root = _open(folder)
        self.name = f"{root}/shard-{shard:06d}"
        self.local = isinstance(self.store, fs.LocalFileSystem)
        idx = self._bytes("idx", 0, None)
        if idx[:8].tobytes() != MAGIC:
            raise ValueError(f"shard {shard}: not a token index")
        self.width, n = (int(x) for x in idx[8:24].view("<u8"))
        self.keys = np.frombuffer(idx, "<i8", n, 24)
        self.nulls = np.frombuffer(idx, "u1", n, 24 + 8 * n).astype(bool)
        self.offsets = np.frombuffer(idx, "<u8", n + 1, 24 + 9 * n).astype(np.int64)

    def _bytes(self, kind: str, start: int, stop: int | None) -> np.ndarray:
        if stop is not None and start >= stop:
            return np.zeros(0, np.uint8)
        if self.local:
            return np.memmap(f"{self.name}.{kind}", np.uint8, "r")[start:stop]
        with self.store.open_input_file(f"{self.name}.{kind}") as f:
            f.seek(start)
            return np.frombuffer(f.read(None if stop is None else stop - start), np.uint8)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of the documents at places first to last (exclusive)."""
        a, b = int(self.offsets[first]), int(self.offsets[last])
        return self._bytes("bin", a * self.width, b * self.width).view(f"<u{self.width}")


def read_token_files(spark: SparkSession, files: TokenFiles, rows: int = 20_000) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files.shards:
        return spark.createDataFrame([], schema)
    folder, shards = files.folder, files.shards

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for b in batches for i in b.column("id").to_pylist()):
            shard, _, _, base = shards[i]
            part = Shard(folder, shard)
            at = part.offsets
            for a in range(0, len(part.keys), rows):
                b = min(a + rows, len(part.keys))
                ids = part.ids(a, b)
                crc = [zlib.crc32(ids[at[k] - at[a] : at[k + 1] - at[a]].astype("<u4").tobytes()) for k in range(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.keys[a:b], pa.int64(), mask=part.nulls[a:b]), pa.array(at[a:b] + base), pa.array(np.diff(at[a : b + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(read, schema)


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
    return read_token_files(spark, files)
