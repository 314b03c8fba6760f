"""Queries to relations: every node becomes one lazy DataFrame operation.

Nothing runs here.  Strategy is Catalyst's: filters reach the scan, joins are
picked by size (but see ``_dealt``), and the duplicates a SORT removes are hash-aggregated before the
range exchange that orders the rows.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import functions as F

from ..errors import SemanticError
from ..functions.domains import OTHER
from ..plans import tree as t
from .predicates import alternatives, condition
from .relation import Relation

#: A join on an equality and a comparison gets a task for so much of the product of its inputs' estimated bytes; Spark's
#: estimate where it knows nothing is above the second.
_PRODUCT_BYTES, _KNOWN_BYTES = 1 << 34, 1 << 62
_DEAL = "larkspur:deal"


class Compiler:
    """``resolve(node)`` supplies base tables and views.

    ``or_mode="bag"`` evaluates each alternative of a predicate on its own and
    concatenates the results, so a row that meets two of them appears twice.
    ``strict=False`` lets UNION combine inputs of different tables.
    """

    def __init__(self, table: Callable[[str], Relation], view: Callable[[str], Any], or_mode: str = "set", strict: bool = True):
        self.table, self.view, self.or_mode, self.strict = table, view, or_mode, strict
        self.open_views: list[str] = []

    def compile(self, node: Any) -> Relation:
        return getattr(self, "_" + type(node).__name__.lower())(node)

    def _table(self, node: t.Table) -> Relation:
        return self.table(node.name)

    def _view(self, node: t.View) -> Relation:
        if node.name in self.open_views:
            raise SemanticError(f"view ${node.name} refers to itself")
        self.open_views.append(node.name)
        try:
            return self.compile(self.view(node.name))
        finally:
            self.open_views.pop()

    def _select(self, node: t.Select) -> Relation:
        source = self.compile(node.source)
        if node.where is None:
            return source
        if self.or_mode == "bag":
            return replace(source, df=reduce(lambda a, b: a.unionAll(b), (source.df.filter(c) for c in alternatives(source, node.where))), keys=())
        return source.with_df(source.df.filter(condition(source, node.where)))

    def _project(self, node: t.Project) -> Relation:
        source = self.compile(node.source)
        attrs, columns, seen = [], [], {}
        for name in node.attrs:
            attr = source.find(name)
            seen[attr.phys] = seen.get(attr.phys, 0) + 1
            phys = attr.phys if seen[attr.phys] == 1 else f"{attr.phys}:{seen[attr.phys]}"
            columns.append(F.col(f"`{attr.phys}`").alias(phys))
            attrs.append(replace(attr, phys=phys))
        kept = {a.phys for a in attrs}
        return Relation(source.df.select(*columns), tuple(attrs), tuple(k for k in source.keys if k <= kept))

    def _join(self, node: t.Join) -> Relation:
        left, right = self.compile(node.left), self.compile(node.right)
        shared = {a.key for a in left.attrs} & {a.key for a in right.attrs}
        if shared:
            raise SemanticError(f"both sides of the join have {min(map(str, shared))}")
        attrs = left.attrs + right.attrs
        keys = tuple(a | b for a in left.keys for b in right.keys)
        if node.on is None:
            pairs = [(a, b) for a in left.attrs for b in right.attrs if a.name == b.name and a.domain == b.domain != OTHER]
            if not pairs:
                # a product is what the statement asks for
                return Relation(left.df.crossJoin(right.df), attrs, keys)
            on = reduce(operator.and_, (left.df[f"`{a.phys}`"] == right.df[f"`{b.phys}`"] for a, b in pairs))
            return Relation(left.df.join(right.df, on, "inner"), attrs, keys)
        left, right = _dealt(left, right, node.on)
        both = _Sides(left, right)
        conditions = alternatives(both, node.on) if self.or_mode == "bag" else [condition(both, node.on)]
        if _DEAL in left.df.columns:
            conditions = [c & (left.df[_DEAL] == right.df[_DEAL]) for c in conditions]
        df = reduce(lambda a, b: a.unionAll(b), (left.df.join(right.df, c, "inner").drop(_DEAL) for c in conditions))
        return Relation(df, attrs, () if self.or_mode == "bag" else keys)

    def _union(self, node: t.Union) -> Relation:
        left, right = self.compile(node.left), self.compile(node.right)
        if [(a.domain) for a in left.attrs] != [(a.domain) for a in right.attrs]:
            raise SemanticError("both sides of a union need the same domains")
        if self.strict and [a.key for a in left.attrs] != [a.key for a in right.attrs]:
            raise SemanticError("both sides of a union need the same attributes")
        return replace(left, df=left.df.unionAll(right.df), keys=())

    def _sort(self, node: t.Sort) -> Relation:
        source = self.compile(node.source)
        keys = []
        for key in node.keys:
            attr = source.find(key.attr)
            if attr.domain == OTHER:
                raise SemanticError(f"{key.attr} has no order")
            column = F.col(f"`{attr.phys}`")
            keys.append(column.asc() if key.ascending else column.desc())
        used = {source.find(k.attr).phys for k in node.keys}
        ties = [F.col(f"`{a.phys}`").asc() for a in source.attrs if a.phys not in used and a.domain != OTHER]
        # a key that every row was checked for makes rows distinct already and saves the shuffle that would tell
        rows = source.df if source.keys else source.df.dropDuplicates()
        return replace(source, df=rows.orderBy(*keys, *ties), keys=source.keys or (frozenset(a.phys for a in source.attrs),))


def _dealt(left: Relation, right: Relation, on: Any) -> tuple[Relation, Relation]:
    """Where few keys may make far more pairs than there are rows: the larger input dealt to shares of each key, the smaller one once for each share.

    Spark sizes the tasks of a join by what they read and gives no key to two of them, or leaves the tasks to the larger
    input's files.  The copies of the smaller input are together no larger than the other one.
    """
    across = [x for x in _conjuncts(on) if isinstance(x, t.Compare) and isinstance(x.right, t.AttrName)]
    equal = {name for x in across if x.op == "=" for name in (x.left, x.right)}
    if not equal or all(x.op == "=" for x in across) or left.df.isStreaming or right.df.isStreaming:
        return left, right
    sizes = {side: int(side.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for side in (left, right)}
    small, large = sorted((left, right), key=sizes.get)
    tasks = min(sizes[small] * sizes[large] // _PRODUCT_BYTES, 8 * large.df.sparkSession.sparkContext.defaultParallelism)
    shares = min(tasks, sizes[large] // max(1, sizes[small]))
    # the estimate for a join is the bare product of its inputs
    if shares < 2 or sizes[large] > _KNOWN_BYTES or any(len({a.rel for a in side.attrs}) > 1 for side in (left, right)):
        return left, right
    row = F.xxhash64(*(F.col(f"`{a.phys}`") for a in large.attrs if a.domain != OTHER))
    share = {large: F.pmod(row, F.lit(shares)), small: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))}

    def dealt(side: Relation) -> Relation:
        by = [F.col(f"`{a.phys}`") for a in side.attrs if a.key in equal]
        # a number of tasks that is asked for is not reduced by what they read
        return side.with_df(side.df.withColumn(_DEAL, share[side]).repartition(tasks, *by, _DEAL).hint("merge"))

    return dealt(left), dealt(right)


def _conjuncts(node: Any) -> list[Any]:
    """What must hold together: comparisons, and other predicates as they are."""
    if isinstance(node, t.Bool) and node.op == "AND":
        return _conjuncts(node.left) + _conjuncts(node.right)
    return [node]


class _Sides(Relation):
    """Both inputs of a join as one scope for its predicate."""

    def __init__(self, left: Relation, right: Relation):
        object.__setattr__(self, "df", None)
        object.__setattr__(self, "attrs", left.attrs + right.attrs)
        object.__setattr__(self, "sides", (left, right))

    def column(self, name: t.AttrName):
        for side in self.sides:
            if any(a.key == name for a in side.attrs):
                return side.column(name)
        raise SemanticError(f"unknown attribute {name}")
