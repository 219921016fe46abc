"""The statements and expressions of the dialect, as the parser gives them and as callers may build them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Column:
    name: str
    qualifier: str | None = None


@dataclass(frozen=True)
class Literal:
    """kind: int, float, varchar or null."""

    value: object
    kind: str


@dataclass(frozen=True)
class Binary:
    """op: + - * / = <> < <= > >="""

    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Logical:
    """op: and, or; over two or more operands."""

    op: str
    operands: tuple[Expr, ...]


@dataclass(frozen=True)
class Not:
    operand: Expr


@dataclass(frozen=True)
class Call:
    """A function call; star stands for COUNT(*)."""

    name: str
    args: tuple[Expr, ...] = ()
    star: bool = False


Expr = Column | Literal | Binary | Logical | Not | Call


@dataclass(frozen=True)
class Star:
    """SELECT *"""


@dataclass(frozen=True)
class Item:
    expr: Expr | Star
    alias: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None

    @property
    def binding(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Join:
    """An inner join; without a condition, a cross join."""

    left: Source
    right: Source
    on: Expr | None = None


Source = Table | Join


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    sources: tuple[Source, ...]
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    having: Expr | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Expr, ...], ...] = field(default=())


Statement = Select | CreateTable | Insert
