"""Token cursor and syntax tree that the grammar works on."""

from __future__ import annotations

import re
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

from .lexer import Token, tokenize

NAME_LIMIT, COLUMN_LIMIT, TEXT_LIMIT, WINDOW_LIMIT = 261, 128, 4000, 8000
_BLANKS = re.compile(r"\s+")


def cut_bytes(text: str | None, limit: int = TEXT_LIMIT) -> str | None:
    if text is None or len(text) * 4 <= limit:
        return text
    return text.encode()[:limit].decode(errors="ignore")


@dataclass(eq=False, slots=True)
class Node:
    id: int
    parent: int | None
    kind: str
    name: str | None
    start: int
    end: int | None
    depth: int
    place: int
    children: int = 0


class Reader:
    """Cursor over the tokens of one statement that also builds the tree and collects notes."""

    def __init__(self, sql: str) -> None:
        self.sql = sql
        self.tokens = tokenize(sql)
        self.at = 0
        self.eof = Token("EOF", "", len(sql) + 1, len(sql) + 1, None, None)
        self.nodes: list[Node] = []
        self.status = "OK"
        self.message: str | None = None

    @cached_property
    def partner(self) -> dict[int, int]:
        """Place of the closing parenthesis of each opening one that has one."""
        out, open_at = {}, []
        for i, t in enumerate(self.tokens):
            if t.kind == "(":
                open_at.append(i)
            elif t.kind == ")" and open_at:
                out[open_at.pop()] = i
        return out

    # -- cursor
    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else self.eof

    @property
    def kind(self) -> str:
        return self.peek().kind

    @property
    def key(self) -> str | None:
        return self.peek().key

    def is_name(self, ahead: int = 0) -> bool:
        return self.peek(ahead).kind in ("ID", "QID")

    def step(self, count: int = 1) -> None:
        self.at = min(self.at + count, len(self.tokens))

    def take(self, *keys: str) -> bool:
        """Step over the keywords if they come next, all of them in this order."""
        if all(self.peek(i).key == k for i, k in enumerate(keys)):
            self.step(len(keys))
            return True
        return False

    def need(self, key: str) -> None:
        if not self.take(key):
            found = "" if self.kind == "EOF" else f" (found {self.peek().text[:30]})"
            self.note(f"Expected {key} at char {self.peek().start}{found}")

    def over_parens(self) -> None:
        """Step over a balanced group of parentheses."""
        depth = 0
        while self.kind == "(" or (depth and self.kind != "EOF"):
            depth += {"(": 1, ")": -1}.get(self.kind, 0)
            self.step()
            if not depth:
                return

    def skip_to(self, kinds: tuple[str, ...], keys: frozenset[str] | set[str] = frozenset()) -> None:
        """Step up to a token of these kinds or keywords, over groups of parentheses as a whole."""
        while self.kind not in (*kinds, "EOF") and self.key not in keys:
            if self.kind == "(":
                self.over_parens()
            else:
                self.step()

    @property
    def last_end(self) -> int:
        return self.tokens[min(self.at, len(self.tokens)) - 1].end if self.at and self.tokens else 0

    # -- notes
    def note(self, message: str) -> None:
        self.status = "PARTIAL" if self.status == "OK" else self.status
        if self.message is None:
            self.message = cut_bytes(message)
        elif len(self.message.encode()) < 3800:
            self.message = cut_bytes(f"{self.message} | {message}")

    # -- tree
    def node(self, kind: str, parent: Node | None, name: str | None = None, start: int | None = None, end: int | None = None) -> Node:
        if parent is not None:
            parent.children += 1
        n = Node(len(self.nodes) + 1, parent.id if parent else None, kind, cut_bytes(name), self.peek().start if start is None else start, end, parent.depth + 1 if parent else 0, parent.children if parent else 1)
        self.nodes.append(n)
        return n

    def leaf(self, kind: str, parent: Node, name: str | None = None) -> Node:
        t = self.peek()
        return self.node(kind, parent, t.text[:TEXT_LIMIT] if name is None else name, t.start, t.end)

    def close(self, node: Node) -> None:
        node.end = max(self.last_end, node.start - 1)

    @contextmanager
    def inside(self, kind: str, parent: Node, name: str | None = None, step: int = 0):
        """A node that lasts as long as the block; ``step`` tokens of its own start are stepped over first."""
        n = self.node(kind, parent, name)
        self.step(step)
        yield n
        self.close(n)

    def span_text(self, start: int, end: int | None) -> str | None:
        """Source text with blanks collapsed, of bounded length."""
        if end is None or end < start:
            return None
        return cut_bytes(_BLANKS.sub(" ", self.sql[start - 1 : min(end, start - 1 + WINDOW_LIMIT)]))
