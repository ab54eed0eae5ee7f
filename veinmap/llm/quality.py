"""Quality rules as a short-circuit cascade (native SQL functions only).

Every rule is a condition over statistics of the text. On a bounded sample (``SAMPLE_ROWS`` rows from all
partitions, each cut to ``SAMPLE_CHARS`` code points) the cost of each statistic is timed
in the same way for all, and the rules that reject a row are noted. The order is greedy: next comes the rule
with most rejections among the rows that are left per cost of the statistics that aren't bound yet. Costs are
timed over repeated rows and rounded to powers of ``COST_STEP``, so that noise doesn't change the order.

The cascade is one nested CASE: a statistic is bound where the first rule that needs it stands, and shared by all
later ones, so a text that an early rule rejects never has the statistics of the later ones computed. The order never changes a
verdict, only what it costs: the verdict is the conjunction of all the rules.

Defined results: a null or empty text has no words and is rejected by ``too_short``; repeated
rows and ties are judged row by row; an empty table gives an empty result; extra columns, also ones named
like a statistic, pass ``apply_quality`` untouched, since statistics live in one struct with
its own name. Very long texts are judged whole.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, kept_table, let

SAMPLE_ROWS = 1000
SAMPLE_CHARS = 20_000
SAMPLE_SEED = 4
COST_STEP, LEAST_COST, TIMED = 8.0, -3, 0.1

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 50
MAX_DUP_LINE_PERCENT = 50
WORD_LENGTH = (2, 20)
MIN_ALPHA_PERCENT = 40

SPACE = " \t\n\x0b\x0c\r"
Bound = dict[str, Column]


def words(t: Column) -> Column:
    """Array of the words (maximal runs without ASCII white space) of a whole text."""
    return F.regexp_extract_all(t, F.lit(f"{WORD_CLASS}+"), F.lit(0))


def n_symbols(t: Column) -> Column:
    return (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long")


def n_letters(t: Column) -> Column:
    return (F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", ""))).cast("long")


def line_counts(t: Column) -> Column:
    """struct(n_lines, n_dup_lines): lines that hold a word, and those equal to an earlier one."""
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    return let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )


def n_repeat_words(w: Column) -> Column:
    """Words of an array covered by three-word windows that occur twice or more, first occurrences included.

    Windows are 64-bit hashes. A set tells whether any of them repeats; only then they are sorted with their
    places, so that equal windows are neighbours: n log n in the words of the text and no pairs of windows. A
    covered word counts once: sorted window starts p add min(3, gap to the next start).
    """
    windows = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))

    def starts(ranked: Column) -> Column:
        same_next = F.zip_with(ranked, F.slice(ranked, F.lit(2), F.greatest(F.size(ranked) - 1, F.lit(0))), lambda a, b: F.coalesce(a["k"] == b["k"], F.lit(False)))
        return let(
            same_next,
            lambda e: F.sort_array(
                F.filter(
                    F.transform(ranked, lambda x, j: F.when(F.get(e, j) | ((j > 0) & F.coalesce(F.get(e, j - 1), F.lit(False))), x["i"])),
                    lambda p: p.isNotNull(),
                )
            ),
        )

    def covered(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

    def of_windows(k: Column) -> Column:
        ranked = F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(let(ranked, lambda r: let(starts(r), covered)))

    return let(windows, of_windows)


# What a statistic is computed from: the text, or statistics bound before it.
STATS: dict[str, tuple[tuple[str, ...], Callable[[Column, Bound], Column]]] = {
    "words": ((), lambda t, b: words(t)),
    "n_words": (("words",), lambda t, b: F.size(b["words"]).cast("long")),
    "word_chars": (("words",), lambda t, b: F.length(F.array_join(b["words"], "")).cast("long")),
    "n_repeat_words": (("words",), lambda t, b: n_repeat_words(b["words"])),
    "n_symbols": ((), lambda t, b: n_symbols(t)),
    "n_letters": ((), lambda t, b: n_letters(t)),
    "lines": ((), lambda t, b: line_counts(t)),
}


def needed(names: tuple[str, ...], have: set[str] = frozenset()) -> list[str]:
    """The statistics to bind for ``names``, each after those that it is computed from."""
    out: list[str] = []
    for n in names:
        out += [x for x in [*needed(STATS[n][0], have), n] if x not in have and x not in out]
    return out


def bind(t: Column, names: list[str], bound: Bound, body: Callable[[Bound], Column]) -> Column:
    """``body`` with the statistics ``names`` bound, one inside the other."""
    if not names:
        return body(bound)
    return let(STATS[names[0]][1](t, bound), lambda x: bind(t, names[1:], {**bound, names[0]: x}, body))


@dataclass(frozen=True)
class Rule:
    """``judge`` builds the condition for rejecting from the statistics ``needs``."""

    name: str
    needs: tuple[str, ...]
    judge: Callable[[Bound], Column]


RULES = [
    Rule("too_short", ("n_words",), lambda s: s["n_words"] < MIN_WORDS),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda s: 100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"]),
    Rule("symbols", ("n_words", "n_symbols"), lambda s: 100 * s["n_symbols"] > MAX_SYMBOL_PERCENT * s["n_words"]),
    Rule("repeated_lines", ("lines",), lambda s: 100 * s["lines"]["n_dup_lines"] > MAX_DUP_LINE_PERCENT * s["lines"]["n_lines"]),
    Rule("word_length", ("n_words", "word_chars"), lambda s: (s["word_chars"] < WORD_LENGTH[0] * s["n_words"]) | (s["word_chars"] > WORD_LENGTH[1] * s["n_words"])),
    Rule("letters", ("word_chars", "n_letters"), lambda s: 100 * s["n_letters"] < MIN_ALPHA_PERCENT * s["word_chars"]),
]


def sample_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text): the bounded sample, drawn from all partitions with a fixed seed, as a small written table."""
    share = min(1.0, 1.5 * SAMPLE_ROWS / max(docs.count(), 1))
    cut = docs.select(F.substring(F.coalesce(F.col(text), F.lit("")), 1, SAMPLE_CHARS).alias("text"))
    return kept_table((cut.sample(share, SAMPLE_SEED) if share < 1 else cut).limit(SAMPLE_ROWS).coalesce(1), "sample")


def _seconds(sample: DataFrame, names: list[str], repeats: int) -> float:
    """Time of computing statistics over the sample, each row so many times; the less of two runs (the first of which compiles)."""
    took = []
    for _ in range(2):
        began = time.perf_counter()
        rows = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("k"))
        rows.select(F.bit_xor(bind(F.col("text"), names, {}, lambda b: F.xxhash64("k", "text", *b.values())))).collect()
        took.append(time.perf_counter() - began)
    return min(took)


def costs_of(sample: DataFrame) -> dict[str, int]:
    """Cost of each statistic beyond those that it is computed from, as a power of COST_STEP of the dearest one's.

    A statistic is computed as often as takes it about ``TIMED`` seconds, so that what a job costs anyway doesn't count.
    """
    base = {n: _seconds(sample, [], n) for n in (1, 4, 16)}
    raw: dict[str, float] = {}
    for n in STATS:
        names = needed((n,))
        once = max(_seconds(sample, names, 1) - base[1], 1e-4)
        repeats = 1 if once > TIMED else 4 if 4 * once > TIMED else 16
        each = once if repeats == 1 else max((_seconds(sample, names, repeats) - base[repeats]) / repeats, 0.0)
        raw[n] = max(each - sum(raw[x] for x in needed(STATS[n][0])), 1e-6)
    dearest = max(raw.values())
    return {n: max(round(math.log(x / dearest, COST_STEP) + 1 / 6), LEAST_COST) for n, x in raw.items()}


def greedy(rules: list[Rule], hits: list[frozenset[str]], cost: dict[str, int]) -> list[dict]:
    """The rules by falling rejection, among the rows that are left, per cost of what isn't bound yet; with the figures that decided it."""
    left, bound, todo, out = hits, set(), list(rules), []
    while todo:
        price = {r.name: sum(COST_STEP ** cost[n] for n in needed(r.needs, bound)) or COST_STEP ** (LEAST_COST - 1) for r in todo}
        rate = {r.name: sum(r.name in h for h in left) / max(len(hits), 1) for r in todo}
        best = min(todo, key=lambda r: (-rate[r.name] / price[r.name], price[r.name], r.name))
        out.append({"rule": best, "cost": price[best.name], "rate": rate[best.name]})
        todo.remove(best)
        bound |= set(needed(best.needs))
        left = [h for h in left if best.name not in h]
    return out


def order_rules(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> list[dict]:
    """The rules in the order of the cascade, by cost and selectivity on the sample."""
    rules = RULES if rules is None else rules
    sample = sample_of(docs, text)
    every = bind(F.col("text"), needed(tuple(n for r in rules for n in r.needs)), {}, lambda b: F.array(*[F.when(r.judge(b), r.name) for r in rules]))
    hits = [frozenset(x for x in row[0] if x) for row in sample.select(every).collect()]
    return greedy(rules, hits, costs_of(sample))


def cascade(t: Column, rules: list[Rule], bound: Bound | None = None) -> Column:
    """Name of the first rule that rejects, null if none does; what only later rules need isn't computed for a rejected text."""
    if not rules:
        return F.lit(None).cast("string")
    first, bound = rules[0], bound or {}
    return bind(t, needed(first.needs, set(bound)), bound, lambda b: F.when(first.judge(b), F.lit(first.name)).otherwise(cascade(t, rules[1:], b)))


def apply_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that every rule accepts, all columns unchanged (a filter: no shuffle, no Python)."""
    rules = [x["rule"] for x in order_rules(docs, text)]
    return docs.filter(let(F.coalesce(docs[text], F.lit("")), lambda t: cascade(t, rules)).isNull())


REPORTED = ("words", "n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")


def quality_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document with its statistics, the base verdict and the cascade's verdict.

    The reported statistics are bound for every row; the cascade goes on from them, so that what they don't cover
    is computed only for texts that get that far.
    """
    rules = [x["rule"] for x in order_rules(docs, text)]

    def row(t: Column, s: Bound) -> Column:
        failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
        kept = F.when(failed, False).otherwise(cascade(t, rules, s).isNull())
        return F.struct(s["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"), s["lines"]["n_dup_lines"].alias("n_dup_lines"), s["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), kept.alias("kept"))

    of = let(F.coalesce(docs[text], F.lit("")), lambda t: bind(t, list(REPORTED), {}, lambda s: row(t, s)))
    out = docs.select(F.col(key).alias("doc_id"), of.alias("_stats"))
    return out.select("doc_id", *[F.col(f"_stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
