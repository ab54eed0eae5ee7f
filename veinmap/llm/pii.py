"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

All of it is native SQL functions. A kind's pattern is applied twice at most: once to
extract its matches and, only where there are any, once to split the text at them; the
lengths of the pieces give the positions (code points, end exclusive). Patterns use possessive
repeats and look-behinds, so that no run of characters is scanned from each of its positions and the
matcher doesn't recurse; they match what the plain patterns of the base kinds match.

Kinds: ``email ip card phone`` (base, kept whatever their score) and ``iban`` (mod-97) and ``ssn``
(needs a context word), which are kept from a score of ``MIN_SCORE`` on. An ``iban`` is proposed at every
start, with the length of its country, or, where the country is in no register, with each end before a
character that isn't a letter or digit (the longest that passes mod-97 counts); what follows never changes it.

The context of a span is what stands up to ``CONTEXT_CHARS`` before and after it, as far as the next proposal of its kind,
so that a text's spans cost no more than the text. ``redact`` takes accounts before cards, whose digits they may hold.

Defined results: null and empty texts have no spans; texts of any length are searched whole; rows
are judged one by one, so ties, repeated rows and empty tables need no rule; extra columns
pass ``redact`` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, sha256_hex

CONTEXT_CHARS = 48
MIN_SCORE = 0.5
SCAN_BLOCK = 256

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Remainder by 97 of an account number with its first four characters moved last, letters as 10 to 35."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        a = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(a < 58, (rest * 10 + a - 48) % 97).otherwise((rest * 100 + a - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step)


# Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_REGISTERED = "|".join(c for cs in IBAN_LENGTHS.values() for c in cs.split())
_IBAN = "|".join([f"(?:{cs.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, cs in IBAN_LENGTHS.items()] + [f"(?!{_REGISTERED})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}"])


def iban_length(m: Column) -> Column:
    """Characters of the account number that a proposal starts with, 0 if none passes mod-97."""
    plain = lambda n: F.replace(F.substring(m, F.lit(1), n), F.lit(" "), F.lit(""))
    before_gap = F.filter(F.sequence(F.length(m), F.lit(15), F.lit(-1)), lambda n: ~F.substring(m, n + 1, F.lit(1)).rlike("[A-Z0-9]") & (F.length(plain(n)) >= 15))
    ends = F.when(m.rlike(f"^(?:{_REGISTERED})"), F.array(F.length(m))).otherwise(before_gap)
    return F.coalesce(F.get(F.filter(ends, lambda n: mod97(plain(n)) == 1), F.lit(0)), F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column] | None
    base: bool
    score: float
    context: str
    #: A literal that every match holds, to leave most texts out cheaply.
    needs: str | None = None
    #: Characters that a match takes when its text is group 1 of a look-ahead, so that proposals may overlap.
    takes: int | None = None
    #: Length of the confirmed part of a match from its start, 0 for none.
    extent: Callable[[Column], Column] | None = None


KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, True, 0.9, "mail|contact|write|schreib|correo|courriel", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(_IP), True, 0.6, r"\bip\b|host|server|address|adresse|login"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", lambda m: luhn(_digits(m)), True, 0.8, "card|visa|master|amex|credit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), True, 0.6, "phone|call|tel|mobile|fax|ruf|llam|appel", "+"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=({_IBAN})(?![A-Za-z0-9]))[A-Z0-9]{{4}}", None, False, 0.7, "iban|account|bank|konto|cuenta|compte", takes=4, extent=iban_length),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", None, False, 0.2, "ssn|social security|sozialversicherung|seguridad social"),
]


#: The order in which kinds are replaced: those that may hold another's digits first.
REDACTED = ["email", "iban", "card", "ssn", "ip", "phone"]


def prefix_sums(lens: Column) -> Column:
    """Sums of all earlier elements, in blocks of SCAN_BLOCK, so that long arrays aren't copied for each element."""

    def scan(block: Column, start: Column) -> Column:
        zero = F.struct(F.array().cast("array<bigint>").alias("a"), start.cast("bigint").alias("s"))
        return F.aggregate(block, zero, lambda acc, x: F.struct(F.array_append(acc["a"], acc["s"]).alias("a"), (acc["s"] + x).alias("s")), lambda acc: acc["a"])

    total = lambda block: F.aggregate(block, F.lit(0).cast("bigint"), lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / SCAN_BLOCK).cast("int")), lambda b: F.slice(lens, b * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)))
    return let(blocks, lambda bs: let(scan(F.transform(bs, total), F.lit(0)), lambda starts: F.flatten(F.transform(bs, lambda b, i: scan(b, F.get(starts, i))))))


# A proposal: the match, its place, and the pieces of text before and after what the pattern took.
_SPAN = "array<struct<m:string,start:bigint,end:bigint,before:string,after:string>>"


def _matches(t: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0 if kind.takes is None else 1))
    return F.when(F.contains(t, F.lit(kind.needs)), found).otherwise(F.array().cast("array<string>")) if kind.needs else found


def proposals(t: Column, kind: Kind) -> Column:
    """array<struct<m,start,end,before,after>> of every match of the kind's pattern."""

    def placed(ms: Column) -> Column:
        sizes = F.transform(ms, lambda m: (F.length(m) if kind.takes is None else F.lit(kind.takes)).cast("bigint"))

        def at(x: Column) -> Column:
            start = lambda i: F.get(x["sums"], i) + F.length(F.get(x["pieces"], i))
            return F.transform(ms, lambda m, i: F.struct(m.alias("m"), start(i).alias("start"), (start(i) + F.length(m)).alias("end"), F.get(x["pieces"], i).alias("before"), F.get(x["pieces"], i + 1).alias("after")))

        steps = lambda ps: F.zip_with(ps, sizes, lambda p, m: F.coalesce(F.length(p), F.lit(0)).cast("bigint") + F.coalesce(m, F.lit(0)))
        return let(F.split(t, kind.pattern, -1), lambda ps: let(steps(ps), lambda st: let(F.struct(prefix_sums(st).alias("sums"), ps.alias("pieces")), at)))

    return let(_matches(t, kind), lambda ms: F.when(F.size(ms) > 0, placed(ms).cast(_SPAN)).otherwise(F.array().cast(_SPAN)))


def _apart(found: Column) -> Column:
    """The spans, by start, without those that start inside an earlier one that stays."""
    clash = F.exists(F.transform(found, lambda x, i: x["start"] < F.coalesce(F.get(found, i - 1)["end"], F.lit(0))), lambda c: c)
    last = lambda kept: F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(0))
    return F.when(clash, F.aggregate(found, F.array().cast(_SPAN), lambda kept, x: F.when(x["start"] >= last(kept), F.array_append(kept, x)).otherwise(kept))).otherwise(found)


def spans(t: Column, kind: Kind) -> Column:
    """array<struct<start,end,score>> of the confirmed spans of one kind, by start."""
    found = proposals(t, kind)
    if kind.valid is not None:
        found = F.filter(found, lambda x: kind.valid(x["m"]))
    if kind.extent is not None:
        sized = F.transform(found, lambda x: let(kind.extent(x["m"]), lambda n: F.struct(x["m"].alias("m"), x["start"].alias("start"), (x["start"] + n).alias("end"), x["before"].alias("before"), x["after"].alias("after"))))
        found = let(F.filter(sized, lambda x: x["end"] > x["start"]).cast(_SPAN), _apart)

    def scored(x: Column) -> Column:
        taken = x["m"] if kind.takes is None else F.left(x["m"], F.lit(kind.takes))
        beyond = F.lit(CONTEXT_CHARS) if kind.takes is None else (x["end"] - x["start"] + CONTEXT_CHARS - kind.takes).cast("int")
        near = F.lower(F.concat(F.right(x["before"], F.lit(CONTEXT_CHARS)), taken, F.left(x["after"], beyond)))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.round(F.least(F.lit(kind.score) + F.when(near.rlike(kind.context), 0.35).otherwise(0.0), F.lit(1.0)), 2).alias("score"))

    found = F.transform(found, scored)
    return found if kind.base else F.filter(found, lambda x: x["score"] >= MIN_SCORE)


def _joined(kind: Kind, c: Column) -> Column:
    return F.transform(c, lambda x: F.concat(F.lit(f"{kind.name}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id", kinds: list[Kind] | None = None) -> DataFrame:
    """One row per document: key, and an array of (start, end, score) for each kind. A projection: no shuffle."""
    kinds = KINDS if kinds is None else kinds
    t = F.coalesce(docs[text], F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), *[_spans_of(t, k).alias(k.name) for k in kinds])


def redact(docs: DataFrame, text: str = "text", kinds: list[Kind] | None = None) -> DataFrame:
    """``docs`` with every confirmed span of ``text`` replaced by the kind's name in brackets, kind by kind.

    A replacement holds no digit, ``@`` or ``+``, so it is never part of a later match.
    """
    out = docs
    for kind in sorted(KINDS if kinds is None else kinds, key=lambda k: REDACTED.index(k.name) if k.name in REDACTED else len(REDACTED)):
        out = out.withColumn(text, F.when(out[text].isNotNull(), _redacted_text(F.coalesce(out[text], F.lit("")), kind)))
    return out


def _spans_of(text: Column, kind: Kind) -> Column:
    return let(text, lambda t: spans(t, kind))


def _redacted_text(text: Column, kind: Kind) -> Column:
    return let(text, lambda t: _redacted(t, kind))


def _redacted(t: Column, kind: Kind) -> Column:
    mark = F.lit(f"[{kind.name.upper()}]")
    if kind.base:
        ok = (lambda m: F.when(kind.valid(m), mark).otherwise(m)) if kind.valid is not None else (lambda m: mark)
        return let(
            _matches(t, kind),
            lambda ms: F.when(F.size(ms) == 0, t).otherwise(F.array_join(F.zip_with(F.split(t, kind.pattern, -1), F.transform(ms, ok), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")),
        )

    def judged(good: Column) -> Column:
        since = lambda i: F.coalesce(F.get(good, i - 1)["end"], F.lit(0))
        cut = lambda a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))
        return F.concat(F.array_join(F.transform(good, lambda x, i: F.concat(cut(since(i), x["start"]), mark)), ""), cut(since(F.size(good)), F.length(t)))

    return let(spans(t, kind), lambda good: F.when(F.size(good) == 0, t).otherwise(judged(good)))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.concat(*[_joined(k, F.col(k.name)) for k in KINDS if k.base])
    every = F.concat(*[_joined(k, F.col(k.name)) for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base],
        sha256_hex(F.array_join(base, ",")).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
        F.array_join(F.transform(F.concat(*[F.transform(k.name, lambda x: x["score"]) for k in KINDS]), lambda x: x.cast("string")), ",").alias("scores"),
    )


def pii_base_spans(spark, sf_dir: str) -> DataFrame:
    """What op6 finds of the base kinds."""
    return op6_pii(spark, sf_dir).drop("spans", "scores")
