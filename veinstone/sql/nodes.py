"""The syntax tree: frozen dataclasses that compare by meaning, not by place."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Node:
    start: int = field(default=0, compare=False, kw_only=True)
    end: int = field(default=0, compare=False, kw_only=True)


@dataclass(frozen=True)
class Literal(Node):
    value: Any
    kind: str = "plain"  # plain, bigint or timestamp


@dataclass(frozen=True)
class ArrayLiteral(Node):
    items: tuple


@dataclass(frozen=True)
class Interval(Node):
    value: float
    unit: str


@dataclass(frozen=True)
class Name(Node):
    name: str
    prefix: str | None = None
    quoted: bool = field(default=False, compare=False)


@dataclass(frozen=True)
class Star(Node):
    prefix: str | None = None


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class IsNull(Node):
    arg: Node
    negated: bool = False


@dataclass(frozen=True)
class InList(Node):
    arg: Node
    items: tuple


@dataclass(frozen=True)
class InQuery(Node):
    arg: Node
    query: Node


@dataclass(frozen=True)
class Exists(Node):
    query: Node


@dataclass(frozen=True)
class Scalar(Node):
    query: Node


@dataclass(frozen=True)
class Case(Node):
    base: Node | None
    whens: tuple
    otherwise: Node | None


@dataclass(frozen=True)
class Cast(Node):
    arg: Node
    to: str
    safe: bool = False


@dataclass(frozen=True)
class Subscript(Node):
    arg: Node
    index: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple
    distinct: bool = False
    where: Node | None = None


@dataclass(frozen=True)
class OrderItem(Node):
    expr: Node
    descending: bool = False
    nulls_last: bool = False


@dataclass(frozen=True)
class Window(Node):
    name: str
    args: tuple
    partition: tuple
    order: tuple


@dataclass(frozen=True)
class Item(Node):
    expr: Node
    alias: str | None = None


@dataclass(frozen=True)
class Table(Node):
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Derived(Node):
    query: Node
    alias: str | None = None


@dataclass(frozen=True)
class TableFunction(Node):
    name: str
    args: tuple
    alias: str
    columns: tuple


@dataclass(frozen=True)
class Join(Node):
    kind: str  # inner, left, right, full, positional, lateral, lateral_left
    right: Node
    on: Node | None = None
    using: tuple = ()


@dataclass(frozen=True)
class Select(Node):
    items: tuple
    source: Node | None = None
    joins: tuple = ()
    where: Node | None = None
    group: tuple = ()
    having: Node | None = None
    distinct: bool = False
    order: tuple = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class SetOp(Node):
    op: str
    keep_all: bool
    left: Node
    right: Node
    order: tuple = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class With(Node):
    tables: tuple  # (name, query) pairs
    query: Node


def children(node: Any):
    """Direct child nodes, through tuples too."""
    if isinstance(node, tuple):
        for x in node:
            if is_dataclass(x):
                yield x
            else:
                yield from children(x)
    elif is_dataclass(node):
        for f in fields(node):
            value = getattr(node, f.name)
            if is_dataclass(value):
                yield value
            elif isinstance(value, tuple):
                yield from children(value)


def rewrite(node: Any, change) -> Any:
    """A copy in which change(n) replaces n wherever it isn't None; subqueries stay as they are."""
    if isinstance(node, tuple):
        return tuple(rewrite(x, change) for x in node)
    if not is_dataclass(node):
        return node
    new = change(node)
    if new is not None:
        return new
    if isinstance(node, (Select, SetOp, With)):
        return node
    return replace(node, **{f.name: rewrite(getattr(node, f.name), change) for f in fields(node) if isinstance(getattr(node, f.name), tuple) or is_dataclass(getattr(node, f.name))})


def walk(node: Any, into_queries: bool = False):
    """node and all nodes below it."""
    yield node
    for c in children(node):
        if into_queries or not isinstance(c, (Select, SetOp, With)):
            yield from walk(c, into_queries)
