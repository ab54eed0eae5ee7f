"""Byte-level BPE, token files and packing against the libraries."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as T
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from veinmap.llm import byte_bpe as B
from veinmap.llm import packing as K
from veinmap.llm import token_files as TF
from veinmap.llm.word_ids import ChunkEncoder

RANKS = T.path("byte_bpe_multi_50k.tiktoken")
WORDS = T.path("word_bpe_49k.json")


def texts(seed=0):
    rng = random.Random(seed)
    alphabet = [32, 9, 10, 13, 0x1C, 0x85, 0xA0, 0x200B, 0x3000, 65, 66, 97, 98, 0xE9, 0x4E2D, 0x1F600, 0x301, 48, 57, 0x661, 39, 46, 44, 33, 0x130, 0x3A3, 0x1E9E]
    marks = [*range(0x300, 0x370), 72, 74, 84, 87, 89, 0xC9, 0xE9, 0xD7, 0xF7, 0xDF, 0xFF, 60, 61, 62, 0x212A, 0x37E]
    out = ["", "a" * 3000, "abcdefgh" * 100, "é" * 300, "it's I'LL we'Ve 12345 ...,,, x.y,z", "ends. 'quote'? \"yes!\" (no.)", "x" * 70_000]
    out += ["<|endoftext|> and <|startoftext|>", "A<|endoftext|>B H\u0331", "<|EndOfText|> <|endoftext|>x<|ENDOFTEXT|>.", "<|<|startoftext|>|>.\u0338 \u0338a<|endoftext|>\u0331", "H\u0331 T\u0308 J\u030c W\u030a Y\u030a é, É. ñ! ×, ÷. ß?"]
    bits = ["<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|", "|>", "'s", "'LL", *map(chr, alphabet), *map(chr, marks[112:])]
    out += ["".join(chr(rng.choice(alphabet)) for _ in range(rng.randrange(400))) for _ in range(60)]
    out += ["".join(chr(rng.choice(rng.choice([alphabet, marks]))) for _ in range(rng.randrange(60))) for _ in range(400)]
    return out + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_byte_bpe_equals_the_library():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = B.ByteBPE(RANKS, T.PATTERN)
    for t, (ids, decimals) in zip(texts(), bpe.encode_texts(texts()), strict=True):
        assert ids.tolist() == enc.encode_ordinary(t)
        assert decimals == ",".join(map(str, ids.tolist())).encode()
        assert bpe.decode(ids.astype(np.int64)) == t.encode()


def test_byte_bpe_long_pieces_take_the_same_merges(monkeypatch):
    bpe = B.ByteBPE(RANKS, T.PATTERN)
    words = ["".join(random.Random(i).choice("etaoinshr") for _ in range(150)) for i in range(20)]
    short = [x.tolist() for x in bpe.encode_pieces(words)]
    monkeypatch.setattr(B, "LONG_PIECE", 8)
    assert [x.tolist() for x in bpe.encode_pieces(words)] == short


def test_byte_bpe_frames(spark, odd_docs, no_docs):
    ids = B.encode(odd_docs, RANKS, T.PATTERN)
    back = Counter((r.doc_id, r.text) for r in B.decode(ids, RANKS, T.PATTERN).collect())
    assert back == Counter((r.doc_id, r.text or "") for r in odd_docs.collect())
    d = B.digests(odd_docs.select("doc_id", "text"), RANKS, T.PATTERN).collect()
    assert Counter(r.decoded_sha256 for r in d) == Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in odd_docs.collect())
    assert {r.n_tokens for r in d if r.doc_id in (3, 4)} == {0}
    assert B.digests(no_docs, RANKS, T.PATTERN).count() == 0


def test_chunks_give_whole_texts_ids(library):
    e = ChunkEncoder(WORDS)
    for part in (texts(1), texts(2)):
        got = e.encode(pa.array([*part, None]), 2)
        at = np.concatenate([[0], np.cumsum(got.counts)])
        for k, t in enumerate([*part, None]):
            assert got.ids[at[k] : at[k + 1]].tolist() == [*library(t), 2], t
    assert e.encode(pa.array(["a. b"]), None).ends.tolist() == [False, True, False]


def test_other_vocabularies_are_left_to_the_library():
    t = Tokenizer.from_file(T.path("byte_bpe_50k.json"))
    e = ChunkEncoder(T.path("byte_bpe_50k.json"))
    got = e.encode(pa.array(["The Cat,  sat.", None, "x"]), None)
    assert got.ids.tolist() == t.encode("The Cat,  sat.").ids + t.encode("x").ids and got.counts.tolist()[1] == 0


def test_cache_generations(library, monkeypatch):
    from veinmap.llm import word_ids

    monkeypatch.setattr(word_ids, "CACHE_CHUNKS", 20)
    e = ChunkEncoder(WORDS)
    for t in texts(3):
        assert e.encode(pa.array([t])).ids.tolist() == library(t)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_token_files(spark, odd_docs, no_docs, library, tmp_path):
    files = TF.write_token_files(odd_docs, WORDS, f"file://{tmp_path}/t")
    got = TF.read_token_files(spark, files).collect()
    want = Counter((r.doc_id, zlib.crc32(np.array([*library(r.text), 2], "<u4").tobytes()), len(library(r.text)) + 1) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == want
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert not list(tmp_path.glob("t/*.bin.*"))
    shard = files.shards[0][0]
    near, far = TF.Shard(files.folder, shard), TF.Shard(files.folder, shard)
    far.local = False
    n = len(near.keys)
    for a, b in ((0, n), (0, 1), (n // 2, n), (n, n)):
        assert near.ids(a, b).tolist() == far.ids(a, b).tolist() and len(far.ids(a, b)) == near.offsets[b] - near.offsets[a]
    assert TF.read_token_files(spark, TF.write_token_files(no_docs, WORDS)).count() == 0


def check_pieces(pieces, docs, library, limit):
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    for key, text in docs:
        ids = np.array([*library(text), 2], "<u4")
        at = 0
        for p in sorted(by.pop(key), key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert not by
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit
        padding += 0 if at.bit_count() == 1 else limit - at
    return padding


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_packing(spark, library, block):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["cat", "dog.", "unbelievably", "x!", "seven"]) for _ in range(rng.choice([0, 1, 5, 40, 300, 900])))) for i in range(80)]
    docs[7] = (7, "word " * 3000)
    docs[8] = (8, None)
    pieces = K.pack(documents(spark, docs), WORDS, limit=256, block=block).collect()
    total = sum(len(library(t)) + 1 for _, t in docs)
    assert check_pieces(pieces, docs, library, 256) < 0.1 * total
    order = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    assert order == sorted(order)


def test_packing_odd_rows(spark, odd_docs, no_docs):
    pieces = K.pack(odd_docs, WORDS).collect()
    per = Counter()
    for p in pieces:
        per[p.doc_id] += p.length
    assert per[2] == 2 * next(p.doc_tokens for p in pieces if p.doc_id == 2) and per[3] == 1 and None in per
    assert K.pack(no_docs, WORDS).count() == 0


def brute_cost(pos, cost, limit):
    """Least cost over all ways to cut, by plain dynamic programming."""
    places, costs = [0, *pos], [0, *cost]
    best = [0]
    for j in range(1, len(places)):
        best.append(min(best[i] + costs[j] + limit - (places[j] - places[i]) for i in range(j) if places[j] - places[i] <= limit))
    total = places[-1]
    return min(best[i] + K.tail_cost(total - places[i], limit) for i in range(len(places) - 1) if total - places[i] <= limit)


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    total, limit = 400, 64
    doc = np.unique(np.append(rng.integers(1, total, 10), total))
    sentence = np.unique(rng.integers(1, total, 30))
    pos, cost = K.candidates(doc, sentence, total, 16)
    got = K.cuts(pos, cost, limit, True)
    at = dict(zip(pos.tolist(), cost.tolist(), strict=True))
    edges = [0, *got]
    spent = sum(at[b] + limit - (b - a) for a, b in zip(edges[:-2], edges[1:-1], strict=True)) + K.tail_cost(edges[-1] - edges[-2], limit)
    assert edges[-1] == total and all(0 < b - a <= limit for a, b in zip(edges[:-1], edges[1:], strict=True))
    assert spent == brute_cost(pos.tolist(), cost.tolist(), limit)
