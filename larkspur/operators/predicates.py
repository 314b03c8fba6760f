"""Predicates as Column expressions, checked for names and domains."""

from __future__ import annotations

import operator
from functools import reduce
from typing import Any

from pyspark.sql import Column

from ..errors import SemanticError
from ..functions.domains import OTHER, Literal, checked
from ..plans import tree as t
from .relation import Relation

_COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _comparison(relation: Relation, node: t.Compare) -> Column:
    left = relation.find(node.left)
    if left.domain == OTHER:
        raise SemanticError(f"{node.left} has no comparable domain")
    if isinstance(node.right, Literal):
        checked(node.right, left.domain, None, str(node.left))
        right = node.right.column()
    else:
        other = relation.find(node.right)
        if left.domain != other.domain:
            raise SemanticError(f"{node.left} is {left.domain}, {node.right} is {other.domain}")
        if left.rel == other.rel:
            raise SemanticError(f"{node.left} and {node.right} belong to one table")
        right = relation.column(node.right)
    return _COMPARE[node.op](relation.column(node.left), right)


def condition(relation: Relation, node: Any) -> Column:
    """The whole predicate as one expression, left to Catalyst to simplify and push down."""
    if isinstance(node, t.Compare):
        return _comparison(relation, node)
    left, right = condition(relation, node.left), condition(relation, node.right)
    both = left & right if node.op in ("AND", "NAND") else left | right
    return ~both if node.op in ("NAND", "NOR") else both


def alternatives(relation: Relation, node: Any) -> list[Column]:
    """One expression per conjunction of the predicate's disjunctive form."""
    return [reduce(operator.and_, (_comparison(relation, leaf) for leaf in one)) for one in t.conjunctions(node)]
