"""Syntax trees of the two statements."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..types import EngineType


@dataclass(frozen=True)
class Literal:
    value: int | float | str | bool


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Is:
    """``expr IS [NOT] what``; what is True, False or None."""

    expr: Expr
    what: bool | None
    negated: bool


Expr = Literal | Name | Binary | Is


@dataclass(frozen=True)
class Target:
    """One item of the select list; ``expr`` None stands for ``*``."""

    expr: Expr | None
    alias: str | None = None


@dataclass(frozen=True)
class Select:
    targets: tuple[Target, ...]
    table: str
    where: Expr | None = None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: EngineType
    nullable: bool = True
    constraints: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class Create:
    table: str
    columns: tuple[ColumnDef, ...]


Statement = Select | Create
