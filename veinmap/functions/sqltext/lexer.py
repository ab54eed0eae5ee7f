"""Tokens of a SQL text by one compiled pattern; positions count from 1 and include the end."""

from __future__ import annotations

import re
from dataclasses import dataclass

_ID = r"[A-Za-z0-9_$#\x80-\x9f\xa1-\U0010ffff]"
_TOKEN = re.compile(
    rf"""
      (?P<skip>[\x00-\x20\xa0]+|--[^\n]*|/\*(?:.*?\*/|.*\Z))
    | (?P<STR>[nN]?[qQ]'(?:\[.*?\]'|\{{.*?\}}'|\(.*?\)'|<.*?>'|(?P<mark>[^\[{{(<]).*?(?P=mark)'|.*\Z)
             |[nN]?'(?:[^']|'')*(?:'|\Z))
    | (?P<QID>"(?:[^"]|"")*(?:"|\Z))
    | (?P<NUM>(?=\.?[0-9])[0-9]*(?:\.(?!\.)[0-9]*)?(?:[eE][+-]?[0-9]+)?(?:[fFdD](?!{_ID}))?)
    | (?P<ID>{_ID}+)
    | (?P<BIND>:{_ID}+|&(?=&|{_ID})&?{_ID}*\.?)
    | (?P<mk>[(),;.])
    | (?P<OP>\|\||<=|>=|<>|!=|\^=|=>|:=|\*\*|.)
    """,
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True, slots=True)
class Token:
    """``kind``: ID QID STR NUM BIND OP ( ) , ; . or EOF; ``name``: upper case unless quoted; ``key``: what keywords are compared with."""

    kind: str
    text: str
    start: int
    end: int
    name: str | None
    key: str | None


def tokenize(sql: str) -> list[Token]:
    """All tokens of the text, without an end mark. Never fails: an open string or comment ends with the text."""
    out = []
    for m in _TOKEN.finditer(sql):
        kind = m.lastgroup if m.lastgroup != "mark" else "STR"
        if m.group("STR") is not None:
            kind = "STR"
        if kind == "skip":
            continue
        text, start, end = m.group(), m.start() + 1, m.end()
        if kind == "mk":
            kind = text
        if kind == "QID":
            text = (text[1:-1] if len(text) > 1 and text.endswith('"') else text[1:]).replace('""', '"')
            out.append(Token(kind, text, start, end, text, None))
        else:
            name = text.upper()
            key = name[:128] if kind == "ID" else None if kind in ("STR", "NUM", "BIND") else text
            out.append(Token(kind, text, start, end, name, key))
    return out
