"""The corpus pipeline against a plain Python version of its stages."""

import random
from collections import Counter

import corpus_pipeline as P
from test_native import good, stats
from test_near_texts import brute, shingles
from test_tokens import WORDS, check_pieces
from tokenizers import Tokenizer


def corpus():
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(2000)]
    docs = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([60, 120, 400]))]
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = "edited"
            docs.append(" ".join(w))
    docs += ["too short", None, "", "same words here " * 40, docs[0], "pay 4111 1111 1111 1111 or write to me@x.org, +1 555 123 4567 " + " ".join(vocabulary[:80])]
    rng.shuffle(docs)
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)] + [(3, docs[3], "en", "s", len(docs[3] or ""))]


def plain_quality(t):
    n, chars, symbols, dup, rep = stats(t)
    lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    letters = sum(c.isalpha() for c in t or "")
    return n >= 50 and 100 * rep <= 50 * n and 100 * symbols <= 50 * n and 100 * dup <= 50 * len(lines) and 2 * n <= chars <= 20 * n and 100 * letters >= 40 * chars


def test_stages(spark, tmp_path):
    rows = corpus()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, columns)
    got = docs
    after = []
    for _, stage in P.STAGES:
        got = stage(spark, got, str(tmp_path)).persist()
        after.append(got.collect())
        if stage is not P.packing:
            assert got.columns == docs.columns
    kept = [r for r in rows if plain_quality(r[1])]
    assert Counter(r.doc_id for r in after[0]) == Counter(r[0] for r in kept)
    comp = {}
    for i, _, c in brute([r[0] for r in kept], [r[1] for r in kept]):
        comp.setdefault(c, set()).add(i)
    assert sorted(r.doc_id for r in after[1]) == sorted(comp)
    texts = {r[0]: r[1] for r in rows}
    for r in after[2]:
        if "4111" in texts[r.doc_id]:
            assert r.text.startswith("pay [CARD] or write to [EMAIL], [PHONE] word0") and r.n_chars == len(r.text)
        else:
            assert r.text == texts[r.doc_id]
    t = Tokenizer.from_file(WORDS)
    check_pieces(after[3], [(r.doc_id, r.text) for r in after[2]], lambda s: t.encode(s or "", add_special_tokens=False).ids, 4096)
    assert shingles("a b c d e f") and good("email", "x")


def test_run(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = P.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 5
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0


def test_odd_documents(spark, odd_docs):
    docs = odd_docs
    for _, stage in P.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert docs.columns == odd_docs.columns
        docs = docs.persist()
        docs.count()
    wordless = P.near_duplicates(spark, odd_docs, "")
    assert Counter(r.doc_id for r in wordless.collect()) == Counter([1, 3, 4, 5, 6, 7, 8, None, 9, -5])


def test_groups_without_a_smallest_id_of_their_own(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (1, text("c")), (1, text("d")), (2, text("d")), (3, text("e"))]
    got = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert Counter(tuple(r) for r in got.collect()) == Counter([(None, text("a")), (None, text("b")), (1, text("c")), (1, text("d")), (3, text("e"))])
