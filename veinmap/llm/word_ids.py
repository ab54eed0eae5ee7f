"""Token ids of whole texts by a word-level BPE vocabulary of the tokenizers library.

White space never joins two tokens of such a vocabulary, so a text's ids are those of its
white-space-separated chunks in order. Two changes leave fewer different chunks and the same ids: a space goes before
an ASCII mark that follows a letter or digit (where a token starts anyway), and ASCII capitals, which the vocabulary lowers,
are lowered unless a byte that isn't ASCII follows (a combining mark could compose with the one and not with
the other). Special tokens of the vocabulary are found in texts as the library finds them: texts that hold one in any
spelling aren't lowered, and their special tokens are chunks of their own.

Each batch's chunks are made a dictionary (Arrow), only chunks new to the worker are encoded, and Arrow gathers the
ids. The test suite holds this against the library's own result for whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice, and in one that is encoded at once; chunks kept by a worker (two generations of half as many).
SLICE_CHARS = 2_000_000
ENCODE_CHARS = 8_000_000
CACHE_CHUNKS = 500_000

_SENTENCE_END = r"[.!?]['\")\]]*$"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# An apostrophe may start a contraction, and a bar stands in special tokens: no space before these.
_MARK = np.zeros(256, bool)
_MARK[list(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{}~')] = True
_INNER = np.zeros(256, bool)
_INNER[[*range(48, 58), *range(97, 123)]] = True
# second bytes of the letters from U+00C0 to U+00FF, whose first byte is 0xC3
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
# small letters that stay what they are when normalised
_SMALL = re.compile("[a-zß-öø-ÿ]+").fullmatch
_ENCODERS: dict[str, "ChunkEncoder"] = {}


@dataclass
class Encoded:
    """ids of the texts one after another, the number of ids of each text, and whether a sentence ends after an id."""

    ids: np.ndarray
    counts: np.ndarray
    ends: np.ndarray


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


class ChunkEncoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # a vocabulary of lower-cased words; any other is left to the library, text by text
        self.lowers = "</w>" in (self.tokenizer.model.end_of_word_suffix or "") and all([t.id for t in self.tokenizer.model.tokenize(w)] == self.tokenizer.encode(w.upper(), add_special_tokens=False).ids for w in ("the", "unbelievable", "zqxj"))
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lowers &= all(re.fullmatch(r"<\|[a-z]+\|>", s) for s in specials)
        self.special = re.compile("|".join(map(re.escape, specials)) or "(?!)")
        self.any_case = re.compile(self.special.pattern, re.IGNORECASE)
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids as bytes of each chunk."""
        if len(self.known) > CACHE_CHUNKS // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        got = list(map(known.get, chunks))
        new = [i for i, x in enumerate(got) if x is None]
        if older:
            for i in new:
                if (x := older.get(chunks[i])) is not None:
                    got[i] = known[chunks[i]] = x
            new = [i for i in new if got[i] is None]
        merge, code, spelled, rest = self.tokenizer.model.tokenize, self.code, self.spelled, []
        for i in new:
            c = chunks[i]
            if _SMALL(c):  # one word that normalising doesn't change: the merges alone remain
                got[i] = known[c] = array(code, [t.id for t in merge(c if c.isascii() else c.translate(spelled))]).tobytes()
            else:
                rest.append(i)
        if rest:
            fresh = [chunks[i] for i in rest]
            for i, c, e in zip(rest, fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
                got[i] = known[c] = array(code, e.ids).tobytes()
        return got

    def encode(self, texts: pa.Array, end_id: int | None = None) -> Encoded:
        """Ids of an Arrow array of texts (null: empty), each followed by ``end_id`` if given."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.lowers:
            return self._whole(texts.to_pylist(), end_id)
        odd = [i for i in np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)).tolist() if self.any_case.search(texts[i].as_py())]
        if not odd:
            return self._chunked(_spaced(texts), end_id)
        out, at = [], 0
        for i in [*odd, len(texts)]:
            out.append(self._chunked(_spaced(texts[at:i]), end_id))
            if i < len(texts):
                apart = self.special.sub(lambda m: f" {m.group()} ", texts[i].as_py())
                out.append(self._chunked(_spaced(pa.array([apart], pa.large_string()), False), end_id))
            at = i + 1
        return Encoded(*(np.concatenate([getattr(x, f) for x in out]) for f in ("ids", "counts", "ends")))

    def _whole(self, texts: list[str], end_id: int | None) -> Encoded:
        tail = [] if end_id is None else [end_id]
        got = [np.array(e.ids + tail, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.array([len(x) for x in got], np.int64)
        ends = np.zeros(int(counts.sum()), bool)
        if tail:
            ends[np.cumsum(counts) - 1] = True
        return Encoded(np.concatenate([np.zeros(0, self.dtype), *got]), counts, ends)

    def _chunked(self, texts: pa.Array, end_id: int | None) -> Encoded:
        split = pc.ascii_split_whitespace(texts)
        chunks = split.flatten().dictionary_encode()
        keys = chunks.indices.to_numpy(zero_copy_only=False)
        words = chunks.dictionary
        known = self._learn(words.to_pylist())
        stop = pc.match_substring_regex(words, _SENTENCE_END).to_numpy(zero_copy_only=False)
        bounds = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
        if end_id is not None:
            # the end of a text is one more chunk
            keys = np.insert(keys, bounds, len(known))
            bounds += np.arange(1, len(bounds) + 1)
            known.append(array(self.code, [end_id]).tobytes())
            stop = np.append(stop, True)
        laid = pa.array(known, pa.large_binary()).take(pa.array(keys))
        after = np.frombuffer(laid.buffers()[1], np.int64)[: len(keys) + 1] // self.dtype.itemsize
        total = int(after[-1]) if len(keys) else 0
        ids = np.frombuffer(laid.buffers()[2], self.dtype, total) if total else np.zeros(0, self.dtype)
        ends = np.zeros(total + 1, bool)
        ends[after[1:][stop[keys]]] = True
        at = after[bounds] if len(keys) else np.zeros(len(bounds), np.int64)
        return Encoded(ids, np.diff(at, prepend=0), ends[1:])


def _spaced(texts: pa.Array, lower: bool = True) -> pa.Array:
    """ASCII capitals before ASCII lowered, and a space before a mark that follows an ASCII letter or digit, or a Latin-1 letter, of the same text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if offsets[0] == offsets[-1]:
        return texts
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    wide = data >= 128
    if lower:
        raw, data = data, _LOWER[data]
        held = np.flatnonzero(wide[1:] & ~wide[:-1])
        data[held] = raw[held]
    # a space between two texts would only be white space at an end
    at = np.flatnonzero(_MARK[data[1:]])
    before = data[at]
    at = at[_INNER[before] | (_LATIN[before] & (at > 0) & (data[at - 1] == 0xC3))] + 1
    moved = offsets - offsets[0]
    moved = moved + np.searchsorted(at, moved, "left")
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(moved), pa.py_buffer(np.insert(data, at, 32)))


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_CHARS):
    """Parts of a batch of about ``size`` bytes of text, whole texts each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), size, "right")))
        yield batch.slice(at, n)
        at += n
