"""Syntax tree of statements; every node is plain data and survives a JSON round trip."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from ..errors import SemanticError
from ..functions.domains import Literal


@dataclass(frozen=True)
class AttrName:
    rel: str
    name: str

    def __str__(self) -> str:
        return f"{self.rel}.{self.name}"


# predicates


@dataclass(frozen=True)
class Compare:
    left: AttrName
    op: str
    right: Literal | AttrName


@dataclass(frozen=True)
class Bool:
    """``op`` is AND, OR, NAND or NOR; the last two have no syntax."""

    op: str
    left: Any
    right: Any


# queries


@dataclass(frozen=True)
class Table:
    name: str


@dataclass(frozen=True)
class View:
    name: str


@dataclass(frozen=True)
class Select:
    source: Any
    where: Any = None


@dataclass(frozen=True)
class Project:
    source: Any
    attrs: tuple[AttrName, ...]


@dataclass(frozen=True)
class Join:
    left: Any
    right: Any
    on: Any = None


@dataclass(frozen=True)
class Union:
    left: Any
    right: Any


@dataclass(frozen=True)
class SortKey:
    attr: AttrName
    ascending: bool = True


@dataclass(frozen=True)
class Sort:
    source: Any
    keys: tuple[SortKey, ...]


QUERIES = (Table, View, Select, Project, Join, Union, Sort)

# definitions


@dataclass(frozen=True)
class AttrDef:
    name: str
    domain: str
    size: int | None = None
    primary: bool = False
    foreign: AttrName | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    attrs: tuple[AttrDef, ...]


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class CreateView:
    name: str
    query: Any


@dataclass(frozen=True)
class DropView:
    name: str


@dataclass(frozen=True)
class CreateIndex:
    table: str
    attr: str


@dataclass(frozen=True)
class DropIndex:
    table: str
    attr: str


DEFINITIONS = (CreateTable, DropTable, CreateView, DropView, CreateIndex, DropIndex)

# modifications


@dataclass(frozen=True)
class Insert:
    table: str
    attrs: tuple[AttrName, ...]
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: Any = None


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[AttrName, Literal], ...]
    where: Any = None


MODIFICATIONS = (Insert, Delete, Update)


@dataclass(frozen=True)
class Call:
    procedure: str
    args: tuple[Literal, ...]


_NODES = {c.__name__: c for c in (AttrName, Compare, Bool, SortKey, AttrDef, Call, Literal, *QUERIES, *DEFINITIONS, *MODIFICATIONS)}


def to_json(node: Any) -> Any:
    """Plain lists, dicts and scalars."""
    if type(node).__name__ in _NODES:
        return {"node": type(node).__name__} | {f.name: to_json(getattr(node, f.name)) for f in fields(node)}
    if isinstance(node, tuple):
        return [to_json(x) for x in node]
    return node


def from_json(data: Any) -> Any:
    if isinstance(data, dict):
        return _NODES[data["node"]](**{k: from_json(v) for k, v in data.items() if k != "node"})
    if isinstance(data, list):
        return tuple(from_json(x) for x in data)
    return data


def conjunctions(where: Any) -> list[tuple[Compare, ...]]:
    """The predicate as alternatives of comparisons that all hold, without repeats or alternatives implied by shorter ones."""

    def expand(node: Any) -> list[frozenset[Compare]]:
        if isinstance(node, Compare):
            return [frozenset([node])]
        if node.op == "OR":
            return expand(node.left) + expand(node.right)
        if node.op == "AND":
            return [a | b for a in expand(node.left) for b in expand(node.right)]
        raise SemanticError(f"{node.op} has no alternatives of plain comparisons")

    kept: list[frozenset[Compare]] = []
    for one in sorted(dict.fromkeys(expand(where)), key=len):
        if not any(k <= one for k in kept):
            kept.append(one)
    return [tuple(sorted(one, key=str)) for one in kept]
