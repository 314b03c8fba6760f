"""A relation: a lazy DataFrame whose columns are known by ``table.attribute``."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import SemanticError
from ..plans.tree import AttrName


@dataclass(frozen=True)
class Attr:
    """One column: where it comes from, its domain and its physical name."""

    rel: str
    name: str
    domain: str
    size: int | None
    phys: str

    @property
    def key(self) -> AttrName:
        return AttrName(self.rel, self.name)


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    attrs: tuple[Attr, ...]
    #: Sets of physical columns that no two rows agree on; known from primary keys that the engine enforced.
    keys: tuple[frozenset[str], ...] = ()

    def find(self, name: AttrName) -> Attr:
        for attr in self.attrs:
            if attr.rel == name.rel and attr.name == name.name:
                return attr
        raise SemanticError(f"unknown attribute {name}")

    def column(self, name: AttrName) -> Column:
        return self.df[f"`{self.find(name).phys}`"]

    def with_df(self, df: DataFrame) -> "Relation":
        return replace(self, df=df)

    def output(self) -> DataFrame:
        """The DataFrame under bare names; names that several tables share are ``table_name``."""
        often = Counter(name for _, name in {(a.rel, a.name) for a in self.attrs})
        names = [a.name if often[a.name] == 1 else f"{a.rel}_{a.name}" for a in self.attrs]
        seen: Counter[str] = Counter()
        columns = []
        for attr, name in zip(self.attrs, names, strict=True):
            seen[name] += 1
            columns.append(F.col(f"`{attr.phys}`").alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
        return self.df.select(*columns)


def scan(df: DataFrame, table: str, attrs: list[tuple[str, str, int | None]], primary: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> Relation:
    """A base table under physical names of its own, so that later joins never clash; columns ``more`` are kept aside."""
    known = tuple(Attr(table, name, domain, size, f"{table}.{name}") for name, domain, size in attrs)
    return Relation(df.select(*(F.col(f"`{a.name}`").alias(a.phys) for a in known), *more), known, tuple(frozenset([f"{table}.{name}"]) for name in primary))
