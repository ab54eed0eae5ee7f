"""Reading one statement from text to lineage."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from .grammar import Grammar
from .reader import TEXT_LIMIT
from .resolve import Resolver
from .scopes import Output

DEPTH = 50_000


@dataclass
class Analysis:
    """``refs``: (object, role, context); ``lineage`` and ``tree``: tuples in the order of their column lists."""

    status: str = "OK"
    message: str | None = None
    statement: str | None = None
    target: str | None = None
    tokens: int = 0
    refs: list[tuple[str, str, str]] = field(default_factory=list)
    lineage: list[tuple] = field(default_factory=list)
    tree: list[tuple] = field(default_factory=list)


LINEAGE_COLUMNS = ("target_column", "column_pos", "expression", "transform_type", "source_object", "source_column", "ref_role", "resolution")
TREE_COLUMNS = ("node_id", "parent_id", "node_type", "node_name", "node_text", "start_pos", "end_pos", "depth", "sibling_seq")


def tidy_name(name: str | None) -> str | None:
    return name.replace('"', "").strip(" ").upper() or None if name else None


def analyze(sql: str | None, target: str | None = None, owner: str | None = None, columns: Callable[[str], list[str]] | None = None, tree: bool = True) -> Analysis:
    """Read one statement. ``columns`` looks up a table's columns (none: no dictionary); ``target`` names what a plain query defines."""
    if not sql:
        return Analysis("FAILED", "Empty SQL text")
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    g = Grammar(sql, owner.upper() if owner else None)
    try:
        g.whole()
    except Exception as problem:  # noqa: BLE001 - a statement never stops a run
        g.status = "PARTIAL" if g.refs else "FAILED"
        g.message = f"Parse error near char {g.peek().start}: {problem}"
    out = Analysis(tokens=len(g.tokens), refs=list(g.refs), statement=g.statement, target=g.target)
    hint = g.target or tidy_name(target)
    if g.top is not None and hint is not None and g.statement not in ("DELETE", "PLSQL", "TRUNCATE"):
        try:
            out.lineage = _lineage(g, hint, columns or (lambda _: []))
        except Exception as problem:  # noqa: BLE001
            g.note(f"Column lineage error: {problem}")
    out.status, out.message = g.status, g.message
    if not g.refs and g.statement == "UNKNOWN":
        out.status = "FAILED"
    if tree:
        whole = len(sql) <= TEXT_LIMIT
        out.tree = [(n.id, n.parent, n.kind, n.name, g.span_text(n.start, n.end) if whole or n.kind != "STATEMENT" else None, n.start, n.end, n.depth, n.place) for n in g.nodes]
    return out


def _target_names(g: Grammar, target: str, outs: list[Output], columns: Callable[[str], list[str]]) -> list[str]:
    """Names of the target's columns: those listed, else the dictionary's if as many, else those of the outputs."""
    own = [o.name for o in outs]
    if "*" in own or g.top.kind not in ("SELECT", "SETOP", "VALUES"):
        return own
    if g.target_columns:
        return g.target_columns[: len(own)] + own[len(g.target_columns) :]
    known = columns(target)
    return known if len(known) == len(own) else own


def _lineage(g: Grammar, target: str, columns: Callable[[str], list[str]]) -> list[tuple]:
    outs = Resolver(columns, g.bare).outputs(g.top) or []
    rows: dict[tuple, tuple] = {}
    for place, (name, o) in enumerate(zip(_target_names(g, target, outs, columns), outs, strict=True), 1):
        if not o.origins:
            kind = o.transform if o.transform in ("AGGREGATE", "WINDOW") else "CONSTANT"
            rows.setdefault((place, None, None, "VALUE"), (name, place, o.text, kind, None, None, "VALUE", "CONSTANT"))
        for x in o.origins:
            rows.setdefault((place, x.table, x.column, x.role), (name, place, o.text, x.transform, x.table, x.column, x.role, x.how))
    return list(rows.values())
