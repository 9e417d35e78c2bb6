"""Syntax trees of queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class QueryError(ValueError):
    """A query that cannot be understood or run."""


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Time:
    """A time literal such as -1h, -1d@d or 2026-01-01, resolved when compiled."""

    text: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Bin:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Un:
    op: str
    arg: Any


@dataclass(frozen=True)
class Test:
    """op: in, like, between, null, regex; negated as a whole."""

    op: str
    arg: Any
    others: tuple = ()
    negated: bool = False
    __test__ = False  # no test case


@dataclass(frozen=True)
class FString:
    parts: tuple


@dataclass(frozen=True)
class Glob:
    """A bare pattern as an expression: matches the raw text."""

    pattern: str


@dataclass(frozen=True)
class Agg:
    func: str
    args: tuple
    alias: str
    level: float | None = None


@dataclass(frozen=True)
class SortKey:
    name: str
    desc: bool = False


@dataclass
class Command:
    name: str
    args: dict = field(default_factory=dict)

    def __getitem__(self, key):
        return self.args.get(key)


@dataclass
class Source:
    """names with globs and !globs; cte is set for $name; earliest and latest are time texts."""

    names: list[str]
    cte: str | None = None
    earliest: str | None = None
    latest: str | None = None


@dataclass
class Query:
    source: Source | None
    commands: list[Command]


@dataclass
class Program:
    datasets: list[tuple[str, Query]]
    query: Query


# search trees
@dataclass(frozen=True)
class Word:
    text: str
    quoted: bool = False
    mode: str = "text"  # text, case or term


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: str
    quoted: bool = False


@dataclass(frozen=True)
class OneOf:
    field: str
    values: tuple


@dataclass(frozen=True)
class Junction:
    op: str  # and, or, not
    parts: tuple
