"""Secrets in texts: three fixed patterns, and a randomness battery for opaque strings.

Base kinds ``assign access hex`` come from patterns (matches that fail their length test are dropped). The
battery looks at every other opaque run of ``MIN_RUN`` characters or more, split at inner ``=`` (names
and values) and, where no encoding holds a part, at ``+ /`` and at ``- _`` in turn: it infers the
encoding (decimal, hex, base32, base64), maps the characters to symbols and takes three statistics against
a uniform source: chi-squared over the alphabet, the number of runs about the median, and lag-one serial correlation.

Short strings have no use for limit laws. The runs test is exact; chi-squared and serial correlation of strings with fewer than
``EXACT`` symbols a letter of the alphabet take their tails from ``DRAWS`` uniform strings of the same length, with a fixed
seed, longer ones from the limit laws. The battery's p-value is three times the least of the three (at most 1), valid whatever
their dependence.

Both kinds of error are held by the Benjamini-Hochberg rule over the candidates of a document, whose p-values know the length:

* "Ordinary text" is the first hypothesis: the likelihood ratio of uniform symbols against a first-order model of words and identifiers
  (runs in capitals are read as small letters too, and the more ordinary reading counts) has a p-value of 1 / ratio at most, which shrinks
  with the length. At ``RATE`` it holds the share of ordinary strings among what is found.
* "Uniform source" is the second: candidates whose battery rejects it, at ``ALPHA`` over those that passed the first, aren't
  secrets, and the share of true secrets among these is held.

What passes both becomes a span of the kind ``entropy``; of two that overlap, the one of more evidence.

Defined results: null and empty texts have no spans; texts are searched whole; every row is judged by
itself (ties, repeats, empty tables and extra columns change nothing).
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .word_ids import slices

# Fixed patterns of the base kinds; a run that is too short never holds a longer match, so the
# length tests of access and hex are part of their patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "entropy")

MIN_RUN = 20
RATE = 1e-3
ALPHA = 1e-3
EXACT, DRAWS = 5, 4000
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)

# Inferred encodings from narrow to wide, each with its symbols in order.
ENCODINGS = [
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]


def _classes(ch: str) -> int:
    """Character class of the model of ordinary text: 0 vowel, 1 consonant, 2 capital, 3 digit, 4 mark."""
    if ch in "aeiou":
        return 0
    return 1 if "a" <= ch <= "z" else 2 if "A" <= ch <= "Z" else 3 if ch.isdigit() else 4


# Probability of the next class in words, identifiers, numbers and paths (rows: class before).
FOLLOWS = np.log(
    np.array(
        [
            [0.14, 0.77, 0.03, 0.01, 0.05],
            [0.40, 0.49, 0.04, 0.01, 0.06],
            [0.20, 0.30, 0.40, 0.03, 0.07],
            [0.01, 0.02, 0.02, 0.85, 0.10],
            [0.20, 0.45, 0.15, 0.10, 0.10],
        ]
    )
)
_CLASS = np.array([_classes(chr(i)) for i in range(128)])
# Log-probability of a character within its class: vowels and consonants by rank-like weights, others evenly.
_WEIGHT = {c: w for c, w in zip("etaoinshrdlucmfwypvbgkjqxz", (12.0, 9.1, 8.2, 7.5, 7.0, 6.7, 6.3, 6.1, 6.0, 4.3, 4.0, 2.8, 2.8, 2.4, 2.2, 2.4, 2.0, 1.9, 1.0, 1.5, 2.0, 0.8, 0.2, 0.1, 0.2, 0.1), strict=True)}


def _within() -> np.ndarray:
    out = np.zeros(128)
    sums = {0: 0.0, 1: 0.0}
    for c, w in _WEIGHT.items():
        sums[_classes(c)] += w
    sizes = np.bincount(_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"]], minlength=5)
    for i in range(128):
        c = chr(i)
        out[i] = math.log(_WEIGHT[c] / sums[_classes(c)]) if c in _WEIGHT else -math.log(max(sizes[_CLASS[i]], 1))
    return out


_WITHIN = _within()


def infer(run: str) -> tuple[str, str] | None:
    """Narrowest encoding whose alphabet holds the run (padding left out)."""
    body = set(run.rstrip("="))
    return next(((n, a) for n, a in ENCODINGS if body <= set(a)), None)


def parts(run: str) -> list[tuple[int, int, str]]:
    """(start, end, alphabet) of the parts of an opaque run that the battery judges; ``=`` at its end is padding."""
    out = []
    for m in re.finditer("[^=]+", run):
        a, b = m.span()
        enc = infer(m.group())
        if enc is not None:
            cuts = [(a, b, enc[1])]
        else:
            odd = [(a + c.start(), a + c.end(), c.group()) for p in ("[^_-]+", "[^+/]+") for c in re.finditer(p, m.group())]
            cuts = [(x, y, infer(t)[1]) for x, y, t in dict.fromkeys(odd)]
        out += [(x, y, al) for x, y, al in cuts if y - x >= MIN_RUN]
    end = len(run.rstrip("="))
    return [(x, len(run) if y == end else y, al) for x, y, al in out]


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_squared(x: np.ndarray, k: int) -> np.ndarray:
    """Chi-squared against even counts of k symbols, for each row of symbols."""
    rows, n = x.shape
    counts = np.bincount((x + np.arange(rows)[:, None] * k).ravel(), minlength=rows * k).reshape(rows, k)
    return (counts.astype(np.int64) ** 2).sum(axis=1) * k / n - n


def _serial(x: np.ndarray) -> np.ndarray:
    """Lag-one serial correlation of each row, 1 for a constant one."""
    d = x - x.mean(axis=1, keepdims=True)
    s = (d * d).sum(axis=1)
    return np.where(s > 0, (d[:, 1:] * d[:, :-1]).sum(axis=1) / np.where(s > 0, s, 1.0), 1.0)


@lru_cache(4096)
def _drawn(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted chi-squared values and serial correlations' distances from their mean, of uniform strings of n symbols out of k."""
    x = np.random.default_rng([n, k]).integers(0, k, (DRAWS, n))
    return np.sort(_chi_squared(x, k)), np.sort(np.abs(_serial(x) + 1 / n))


def _above(drawn: np.ndarray, value: float) -> float:
    """Share of draws at or above a value, the value itself counted as one of them."""
    return (len(drawn) - int(np.searchsorted(drawn, value - 1e-9)) + 1) / (len(drawn) + 1)


@lru_cache(1 << 14)
def runs_tail(n1: int, n2: int, runs: int) -> float:
    """Two-sided exact p-value of the number of runs of n1 and n2 symbols of two kinds: all outcomes that are no more likely."""
    if not n1 or not n2:
        return 1.0
    ways = {}
    for r in range(2, 2 * min(n1, n2) + 2):
        h = r // 2
        ways[r] = 2 * math.comb(n1 - 1, h - 1) * math.comb(n2 - 1, h - 1) if r % 2 == 0 else math.comb(n1 - 1, h) * math.comb(n2 - 1, h - 1) + math.comb(n1 - 1, h - 1) * math.comb(n2 - 1, h)
    return min(1.0, sum(w for w in ways.values() if w <= ways[runs]) / math.comb(n1 + n2, n1))


def battery(run: str, alphabet: str) -> tuple[float, float, float]:
    """p-values of a uniform source: chi-squared (upper tail), runs about the median (with the number above it), serial correlation."""
    body = run.rstrip("=")
    place = {c: i for i, c in enumerate(alphabet)}
    x = np.array([[place[c] for c in body]])
    n, k = x.shape[1], len(alphabet)
    chi, serial = float(_chi_squared(x, k)[0]), float(abs(_serial(x)[0] + 1 / n))
    high = x[0] >= k // 2
    n1, n2 = int(high.sum()), int(n - high.sum())
    runs = 1 + int((high[1:] != high[:-1]).sum())
    if n < EXACT * k:
        drawn_chi, drawn_serial = _drawn(n, k)
        uniform, p_serial = _above(drawn_chi, chi), _above(drawn_serial, serial)
    else:
        df = k - 1
        z = ((max(chi, 0.0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))  # Wilson and Hilferty
        uniform, p_serial = 0.5 * math.erfc(z / math.sqrt(2)), _normal_tail(serial * math.sqrt(n))
    if n < EXACT * 64:
        p_runs = runs_tail(n1, n2, runs) if n1 and n2 else 2.0 ** (1 - n)
    elif n1 and n2:
        mean, var = 2 * n1 * n2 / n + 1, 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
        p_runs = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    return uniform, p_runs, p_serial


def battery_p(run: str, alphabet: str) -> float:
    """The battery's p-value of a uniform source, above zero."""
    return min(1.0, max(3 * min(battery(run, alphabet)), 1e-300))


def log_ratio(run: str, alphabet: str) -> float:
    """Log-likelihood of uniform symbols over that of ordinary text."""
    body = run.rstrip("=")
    ordinary = max(_ordinary(x) for x in ({body, body.lower()} if body.isupper() else {body}))
    return -len(body) * math.log(len(alphabet)) - ordinary


def _ordinary(body: str) -> float:
    codes = np.frombuffer(body.encode("ascii"), np.uint8)
    cls = _CLASS[codes]
    return float(_WITHIN[codes].sum() + FOLLOWS[cls[:-1], cls[1:]].sum()) - math.log(len(FOLLOWS))


def false_discovery(logp: list[float], rate: float = RATE, tests: int | None = None) -> list[bool]:
    """Benjamini-Hochberg over log p-values; ``tests`` counts the hypotheses (at least those given)."""
    m = max(tests or 0, len(logp))
    order = sorted(range(len(logp)), key=lambda i: logp[i])
    last = max((r for r, i in enumerate(order, 1) if logp[i] <= math.log(rate * r / m)), default=0)
    keep = set(order[:last])
    return [i in keep for i in range(len(logp))]


def _strongest(passed: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Spans (log p, start, end) in order of evidence, without those that overlap an earlier one."""
    kept: list[tuple[int, int]] = []
    for _, a, b in passed:
        i = bisect.bisect_left(kept, (b, 0)) - 1
        if i < 0 or kept[i][1] <= a:
            kept.insert(i + 1, (a, b))
    return kept


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start, then kind as listed."""
    text = text or ""
    low = text.lower()
    out = []
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found = [("hex", *m.span()) for m in HEX.finditer(text)]
    out += found
    tries = []
    taken = sorted((a, b) for _, a, b in out)
    for m in OPAQUE.finditer(text):
        for x, y, alphabet in parts(m.group()):
            a, b = m.start() + x, m.start() + y
            i = bisect.bisect_right(taken, (b, 0)) - 1
            if i < 0 or taken[i][1] <= a:
                tries.append((a, b, text[a:b], alphabet))
    if tries:
        logp = [-log_ratio(r, al) for _, _, r, al in tries]
        likely = [(p, t) for p, t, k in zip(logp, tries, false_discovery(logp), strict=True) if k]
        even = false_discovery([math.log(battery_p(r, al)) for _, (_, _, r, al) in likely], ALPHA)
        passed = sorted((p, a, b) for (p, (a, b, _, _)), rejected in zip(likely, even, strict=True) if not rejected)
        out += [("entropy", a, b) for a, b in _strongest(passed)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: counts, digest of the base spans, and all spans. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for t in part.column("text").to_pylist():
                    spans = scan(t)
                    said = [f"{k}:{a}:{b}" for k, a, b in spans]
                    base = ",".join(s for s, x in zip(said, spans, strict=True) if x[0] != "entropy")
                    rows.append((*(sum(x[0] == k for x in spans) for k in KINDS[:3]), hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
                )

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SCHEMA)


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def secrets_base_spans(spark, sf_dir: str) -> DataFrame:
    """What op7 finds of the base kinds."""
    return op7_secrets(spark, sf_dir).drop("spans")
