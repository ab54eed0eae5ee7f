"""N-gram Jaccard join against all pairs of sets of word tuples."""

import random

import numpy as np
import pyarrow as pa
import pytest

from veinmap.llm import near_texts as N
from veinmap.llm.near_vectors import forest
from veinmap.llm.shingles import shingle_sets


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(ids, texts):
    s = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    a, b = (np.array(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    root = forest(len(ids), a, b)
    least = {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return sorted(((ids[i], len(s[i]), least.get(root[i])) for i in range(len(ids))), key=repr)


def edited(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k : k + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"]
    return w


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = []
    shared = [f"s{rng.randrange(400)}" for _ in range(70)]
    for _ in range(25):
        n = rng.choice([4, 6, 8, 10, 14, 30, 80, 200, 600])
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        if rng.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = shared
        texts += [" ".join(edited(rng, base, rng.randrange(1 + max(1, len(base) // 35)))) for _ in range(rng.randrange(1, 9))]
    texts += [texts[0], texts[0].upper(), None, "", "a b c", "A  B\nC"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.near_texts(df).collect()), key=repr)
    assert got == brute(list(range(len(texts))), texts)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.near_texts(odd_docs).collect()), key=repr)
    assert got == brute([r.doc_id for r in rows], [r.text for r in rows])
    assert N.near_texts(no_docs).count() == 0


def test_every_similar_pair_shares_a_key():
    """Pigeonhole, also where nearly all segments are empty and the neighbourhoods must help."""
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(4, 90))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = a.copy()
        if rng.random() < 0.5:  # many empty segments: hashes in one part of the universe
            a = np.unique(a >> np.uint64(int(rng.integers(1, 6))))
            b = a.copy()
        for _ in range(int(rng.integers(1, 1 + max(1, n // 8)))):
            if rng.random() < 0.5 and len(b) > 1:
                b = np.delete(b, rng.integers(len(b)))
            else:
                b = np.unique(np.append(b, rng.integers(0, int(a.max()) + 1, dtype=np.uint64)))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common) and (len(a) != len(b) or common != len(a)):
            for cost in (None, rng.integers(0, 9, N.SLOTS).astype(np.int8)):
                ka, kb = N.all_signatures(a, cost=cost), N.all_signatures(b, cost=cost)
                shared = set((ka >> np.uint64(1)).tolist()) & set((kb >> np.uint64(1)).tolist())
                assert shared, (len(a), len(b), common)


def test_long_lists_are_left_out():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 58, 20, dtype=np.uint64)  # a passage whose hashes lie in one part of the universe
    sets = [np.unique(np.concatenate([common, rng.integers(1 << 60, (1 << 64) - 1, 400, dtype=np.uint64)])) for _ in range(300)]
    cost = N.classes(N.counted(sets, 80))
    shared = lambda cost: sum(len(x) - len(set(x)) for x in [np.concatenate([N.all_signatures(s, cost=cost) for s in sets]).tolist()])
    assert cost.max() > 0 and shared(cost) < shared(None)
    assert N.classes(np.zeros(N.SLOTS, np.int64)).max() == 0


def test_buckets_of_equal_hash_are_compared(monkeypatch):
    rng = np.random.default_rng(5)
    key = (rng.integers(0, 60, 400).astype(np.uint64) << np.uint64(1)) | rng.integers(0, 2, 400).astype(np.uint64)
    who = rng.integers(0, 12, 400)
    plain = {}
    for k, w in zip(key.tolist(), who.tolist(), strict=True):
        plain.setdefault(k >> 1, {}).setdefault(w, True)
        plain[k >> 1][w] &= bool(k & 1)
    want = {frozenset((w, not probe) for w, probe in m.items()) for m in plain.values() if len(m) > 1 and not all(m.values())}

    def got():
        out, at = [], 0
        b, w, own = N.buckets_of(key, who)
        ends = [*(np.flatnonzero(np.diff(w) <= 0) + 1).tolist(), len(w)]  # members ascend within a bucket
        for e in ends:
            out.append(frozenset(zip(w[at:e].tolist(), own[at:e].tolist(), strict=True)))
            at = e
        return out

    found = got()
    assert len(found) == len(want) and set(found) == want
    monkeypatch.setattr(N, "mix", lambda x: x & np.uint64(0))  # all hashes equal
    assert set(got()) == want


def thue_morse(n, flip):
    return "".join("ab"[(i.bit_count() + flip) & 1] for i in range(n))


@pytest.mark.parametrize("n", [256, 257, 1024, 2048, 4096])
def test_words_that_a_polynomial_confuses(n):
    tail = " p q r s"
    a, b = shingle_sets(pa.array([thue_morse(n, 0) + tail, thue_morse(n, 1) + tail]))
    assert len(a) == len(b) == 1 and a[0] != b[0]


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for n in [4, 40, 300, 300, 300, 40_000]:
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 63, n // 6).astype(np.uint64)]))
        h = N.folded([N.sketch(x).tobytes() for x in (a, b)])
        far, true = N.apart(h[:1], h[1:])[0], len(np.setxor1d(a, b))
        assert far <= true and (n > 10_000 or far >= 0.6 * true)


def test_sets_of_slices_and_long_words():
    texts = ["a b c d e f", "x" * 40_000 + " b c d e " + "x" * 40_000, None, "é ü ß a b", "A\tB\nC d e F"]
    got = shingle_sets(pa.array(texts))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert (got[0] == got[4]).all()
    assert (shingle_sets(pa.array(["q", *texts])[1:])[1] == got[1]).all()


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "KEYS_AT_ONCE", 500)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(edited(rng, base, rng.randrange(8))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.near_texts(df, rounds=0).collect()), key=repr)
    assert got == brute(list(range(60)), texts)
