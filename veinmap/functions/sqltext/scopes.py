"""What a statement's query blocks read and put out."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(eq=False)
class Cte:
    name: str
    scope: Scope | None = None


@dataclass(eq=False)
class Source:
    """One entry of a FROM list: a table, or the scope of a derived one (that of a CTE may come later)."""

    alias: str | None
    table: str | None = None
    inner: Scope | None = None
    cte: Cte | None = None

    @property
    def derived(self) -> Scope | None:
        return self.cte.scope if self.cte is not None else self.inner

    def named(self, name: str) -> bool:
        if self.alias is not None:
            return self.alias == name
        return self.table is not None and name in (self.table, self.table.rpartition(".")[2])


@dataclass(eq=False)
class Slot:
    """Column references (qualifier, column, role) and subqueries (scope, position) of one output."""

    refs: list[tuple[str | None, str, str]] = field(default_factory=list)
    queries: list[tuple[Scope, int]] = field(default_factory=list)


@dataclass(eq=False)
class Item:
    name: str
    text: str | None
    transform: str
    slot: Slot
    star: bool = False
    qualifier: str | None = None
    counts_rows: bool = False


@dataclass(frozen=True, slots=True)
class Origin:
    """Where a value comes from. ``how``: RESOLVED, DICTIONARY and so on."""

    table: str | None
    column: str | None
    transform: str
    role: str
    how: str


@dataclass(eq=False)
class Output:
    name: str
    text: str | None
    transform: str | None
    origins: list[Origin] = field(default_factory=list)


@dataclass(eq=False)
class Scope:
    """``kind``: SELECT, SETOP, VALUES, UPDATE, MERGE, DELETE or TFUNC."""

    kind: str
    outer: Scope | None = None
    sources: list[Source] = field(default_factory=list)
    slots: dict[int, Slot] = field(default_factory=dict)
    items: list[Item] = field(default_factory=list)
    branches: list[Scope] = field(default_factory=list)
    names: list[str] | None = None
    outputs: list[Output] | None = None
    busy: bool = False

    def slot(self, place: int) -> Slot:
        return self.slots.setdefault(place, Slot())
