"""Quality rules, personal data and revisits: native operators against plain Python and SQL."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from veinmap.llm import pii as P
from veinmap.llm import quality as Q
from veinmap.llm import warc as V

WORD = re.compile("[^\x20\x09-\x0d]+")


def stats(t):
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(odd_docs, no_docs):
    got = Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.quality_report(odd_docs).collect())
    assert got == Counter(stats(r.text) for r in odd_docs.collect())
    assert Q.quality_report(no_docs).count() == 0


def test_quality_verdicts(spark):
    good = " ".join(f"plain{i} words" for i in range(60))
    texts = [good, "short text", "a b c " * 40, " ".join("x%%%% y&&&&" + str(i) for i in range(60)), "\n".join(["same old line of text"] * 3 + [f"l{i} m{i}" for i in range(40)]), " ".join(str(1000 + i) for i in range(80)), None]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, _stats string")
    kept = [r.kept for r in Q.quality_report(df).orderBy("doc_id").collect()]
    assert kept == [True, False, False, False, True, False, False]
    out = Q.apply_quality(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [0, 4]


def test_quality_order_never_changes_a_verdict(odd_docs, monkeypatch):
    a = {(r.doc_id, r.kept) for r in Q.quality_report(odd_docs).collect()}
    kept = Counter(r.doc_id for r in Q.apply_quality(odd_docs).collect())
    for k in range(len(Q.RULES)):
        monkeypatch.setattr(Q, "order_rules", lambda docs, text="text", rules=None, k=k: [{"rule": r} for r in Q.RULES[k:] + Q.RULES[:k][::-1]])
        assert {(r.doc_id, r.kept) for r in Q.quality_report(odd_docs).collect()} == a
        assert Counter(r.doc_id for r in Q.apply_quality(odd_docs).collect()) == kept


def test_quality_order_is_by_rejection_per_cost(spark, odd_docs, no_docs):
    cost = {"words": 0, "n_words": -3, "word_chars": -1, "n_repeat_words": 0, "n_symbols": -1, "n_letters": -1, "lines": -1}
    hits = [frozenset(["symbols", "too_short"])] * 10 + [frozenset(["letters"])] * 4 + [frozenset(["symbols"])] * 3 + [frozenset()] * 83
    got = [x["rule"].name for x in Q.greedy(Q.RULES, hits, cost)]
    # after the symbols rule nothing is left that the short rule would reject
    assert got[:2] == ["symbols", "letters"] and set(got) == {r.name for r in Q.RULES}
    assert len(Q.order_rules(no_docs)) == len(Q.RULES)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "river", "of", "words", "%%%%", "x1"]) for _ in range(rng.choice([5, 80, 400]))) for _ in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    rates = [[(x["rule"].name, round(x["rate"], 6)) for x in sorted(Q.order_rules(docs), key=lambda x: x["rule"].name)] for _ in range(2)]
    assert sum(r for _, r in rates[0]) > 0


def test_quality_stops_at_the_first_rejection(spark):
    boom = Q.Rule("boom", ("n_symbols",), lambda s: F.raise_error(F.lit("reached")).cast("boolean"))
    df = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    reason = Q.cascade(F.coalesce("text", F.lit("")), [Q.RULES[0], boom])
    assert {r.why for r in df.select(reason.alias("why")).collect()} == {"too_short"}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum((int(c) * (1 + i % 2) - (9 if int(c) * (1 + i % 2) > 9 else 0)) for i, c in enumerate(reversed(s))) % 10 == 0


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def spans(t):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if good(k, m.group())]


TRICKY = [
    "a@b.co_x@y.com z@q", "AB12 +1 (555) 123-4567..", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.004 1.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559x", "🎉 a@b.c é +49 30 123456789",
    "+" * 2000 + "1" + " " * 2000, "@" * 3000, "a@b." * 2000, "mail me a@b.com, " * 1000, "12 34  56 7-8--9", "+12 +123456789 +1234567890123456", "", None, "5" * 19 + " " + "4" * 20, "0 4111111111111111", "%@a.b", "a@-.-",
]


def test_pii_spans(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    for r in P.find_pii(df).collect():
        assert [(k, x.start, x.end) for k in BASE for x in r[k]] == spans(TRICKY[r.doc_id]), r.doc_id


def test_pii_long_runs_end_quickly(spark):
    long = ["x" * 300_000 + "@", "1" * 300_000, "1 " * 150_000, "1." * 150_000, "+1" + " " * 300_000, "A" * 300_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "doc_id long, text string")
    got = P.find_pii(df).collect()
    assert len(got) == 6 and all(not r.card and not r.email for r in got)


def test_pii_added_kinds(spark):
    texts = ["account iban GB82 WEST 1234 5698 7654 32.", "GB82 WEST 1234 5698 7654 33", "my ssn is 123-45-6789", "part 123-45-6789", "ssn 000-45-6789"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: ([(x.start, x.end) for x in r.iban], [(x.start, x.end) for x in r.ssn]) for r in P.find_pii(df).collect()}
    assert got == {0: ([(13, 40)], []), 1: ([], []), 2: ([], [(10, 21)]), 3: ([], []), 4: ([], [])}


def test_iban_ends_whatever_follows(spark):
    de, spaced, gb = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    after = ["", " The bank", " Bank: X", " I paid", " BIC ABC", " BIC COBADEFF", " 2024", " 2024-01-01", ".", ", A1", " X"]
    cases = [(f"iban {x}{y}", [(5, 5 + len(x))]) for x in (de, spaced) for y in after]
    cases += [(f"{de} {gb}", [(0, 22), (23, 45)]), (f"SE12 {spaced} 1", [(5, 32)]), (f"AB12 {spaced} 1", [(5, 32)]), ("AO06 0044 0000 6729 5030 1010 2 The END", [(0, 31)])]
    cases += [(f"{de}X", []), (f"X{de}", []), (de[:-1], []), ("DE88 3704 0044 0532 0130 00 The bank", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in P.find_pii(df).collect():
        assert [(x.start, x.end) for x in r.iban] == cases[r.doc_id][1], cases[r.doc_id]
    kind = [k for k in P.KINDS if k.name == "iban"]
    for i, r in enumerate(sorted(P.redact(df, kinds=kind).collect())):
        t, found = cases[i]
        for a, b in reversed(found):
            t = t[:a] + "[IBAN]" + t[b:]
        assert r.text == t


def test_pii_scores_follow_context(spark):
    df = spark.createDataFrame([(0, "visa card 4111111111111111"), (1, "number 4111111111111111")], "doc_id long, text string")
    got = {r.doc_id: r.card[0].score for r in P.find_pii(df).collect()}
    assert got[0] > got[1]


def test_redaction(spark, odd_docs, no_docs):
    df = spark.createDataFrame([(0, "write a@b.co or +1 555 123 4567, ip 10.0.0.1 not 999.1.1.1", "k"), (1, None, "k"), (2, "nothing here", "k"), (3, "iban GB82 WEST 1234 5698 7654 32", "k")], "doc_id long, text string, email string")
    got = {r.doc_id: r.text for r in P.redact(df).collect()}
    assert got == {0: "write [EMAIL] or [PHONE], ip [IP] not 999.1.1.1", 1: None, 2: "nothing here", 3: "iban [IBAN]"}
    assert P.redact(df).columns == df.columns
    assert Counter(tuple(r) for r in P.redact(odd_docs).collect()) == Counter(tuple(r) for r in odd_docs.collect())
    assert P.redact(no_docs).count() == 0 and P.find_pii(no_docs).count() == 0


def test_pii_query_digest(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for r in P.op6_pii(spark, str(tmp_path)).collect():
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans(TRICKY[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_prefix_sums(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: x.cast("long")).alias("a"))
    got = df.select(P.prefix_sums(F.col("a")).alias("s")).first().s
    assert got == [k * (k + 1) // 2 for k in range(1000)]


RECORDS = "record_id long, kind string, url string, at long, status int, headers map<string,string>, payload string, extra string"


def test_revisits_with_names_as_crawlers_spell_them(spark):
    rows = [
        (1, "response", "ex.org/a", 1, 200, {"ETag": '"1"', "Cache-Control": "old", "Server": "s"}, "p1", None),
        (2, "revisit", "ex.org/a", 2, 304, {"ETAG": 'W/"1"', "etag": None, "Cache-Control": "first", "cache-control": "new"}, None, None),
        (3, "response", "ex.org/b", 1, 200, {"Last-Modified": "m"}, "p3", None),
        (4, "revisit", "ex.org/b", 2, 304, {"LAST-modified": "m"}, None, None),
    ]
    got = {r.record_id: (r.response_id, r.status, r.headers) for r in V.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got == {2: (1, "resolved", {"etag": 'W/"1"', "cache-control": "new", "server": "s"}), 4: (3, "resolved", {"last-modified": "m"})}


def test_revisits(spark, monkeypatch):
    rows = [
        (1, "response", "HTTP://Ex.org:80/a/?b=2&a=1&utm_source=x#f", 10, 200, {"etag": '"1"', "server": "s", "date": "d1"}, "p1", None),
        (2, "response", "https://ex.org/a?a=1&b=2", 20, 500, {"etag": '"2"'}, "p2", None),
        (3, "revisit", "https://ex.org/a?b=2&a=1", 30, 304, {"etag": 'W/"1"', "date": "d3", "server": "other"}, None, "x"),
        (4, "revisit", "https://ex.org/a?b=2&a=1", 10, 304, {"etag": '"1"'}, None, None),
        (5, "revisit", "https://ex.org/a?b=2&a=1", 40, 304, {"etag": '"9"'}, None, None),
        (6, "revisit", "https://ex.org/a?b=2&a=1", 9000, 304, {"last-modified": "x"}, None, None),
        (7, "revisit", None, 50, 304, None, None, None),
        (8, "revisit", "ex.org/other", None, 304, None, None, None),
        (9, "response", "ex.org/other", None, 200, None, "p9", None),
        (10, "response", "ex.org/lm", 1, 200, {"last-modified": "m"}, "p10", None),
        (11, "revisit", "ex.org/lm/", 99999, 304, {"last-modified": "m", "content-type": "z"}, None, None),
        (12, "response", "ex.org/tie", 5, 200, {"etag": "a"}, "p12", None),
        (13, "response", "ex.org/tie", 5, 200, {"etag": "b"}, "p13", None),
        (14, "revisit", "ex.org/tie", 6, 304, {"etag": "b"}, None, None),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    for parts in (1, 3, 16):
        monkeypatch.setattr(V, "shuffle_parts", lambda spark, n=parts: n)
        got = {r.record_id: (r.response_id, r.status, r.headers, r.payload) for r in V.resolve_revisits(df).collect()}
        assert got == {
            3: (1, "resolved", {"etag": 'W/"1"', "server": "s", "date": "d3"}, "p1"),
            4: (None, "no_capture", {"etag": '"1"'}, None),
            5: (None, "mismatch", {"etag": '"9"'}, None),
            6: (None, "unconfirmed", {"last-modified": "x"}, None),
            7: (None, "no_capture", {}, None),
            8: (None, "no_capture", {}, None),
            11: (10, "resolved", {"last-modified": "m"}, "p10"),
            14: (13, "resolved", {"etag": "b"}, "p13"),
        }, parts
    assert V.resolve_revisits(df.limit(0)).count() == 0
    hot = spark.createDataFrame([(i, "response" if i % 4 == 0 else "revisit", "ex.org/hot", i, 200, {"etag": "e"}, f"p{i}", None) for i in range(1, 4001)], RECORDS)
    monkeypatch.setattr(V, "shuffle_parts", lambda spark: 7)
    got = {r.record_id: (r.response_id, r.payload) for r in V.resolve_revisits(hot).collect()}
    assert got == {i: (i - i % 4, f"p{i - i % 4}") if i > 4 else (None, None) for i in range(1, 4001) if i % 4}
    assert V.resolve_revisits(df.union(df.filter("record_id = 3"))).filter("record_id = 3").count() == 2


def test_redact_takes_accounts_before_cards(spark):
    iban = "GB33 BUKB 2020 1555 5555 55"
    long = "iban MT84 MALT 0110 0001 2345 MTLC AST0 01S and 4111 1111 1111 1111"
    inner = "NO93 8601 1117 947 iban DE75 5121 0800 1245 1261 99"
    df = spark.createDataFrame([(0, f"bank {iban}."), (1, long), (2, inner)], "doc_id long, text string")
    assert [r.text for r in P.redact(df).orderBy("doc_id").collect()] == ["bank [IBAN].", "iban [IBAN] and [CARD]", "[IBAN] iban [IBAN]"]


def test_pii_many_spans_end_quickly(spark):
    texts = ["mail a.b@example.org, " * 30_000, "card 4111 1111 1111 1111; " * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (len(r.email), len(r.card), {x.score for x in r.email}) for r in P.find_pii(df).collect()}
    assert got == {0: (30_000, 0, {1.0}), 1: (0, 20_000, set())}
