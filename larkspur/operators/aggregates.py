"""COUNT, MIN, MAX, AVG, SUM and VAR of a query as one partial-and-final aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import SemanticError
from ..functions.domains import FLOAT, INT, NUMERIC, OTHER, STRING
from .relation import Attr, Relation

#: The numeric beginning of a string; anything else counts as 0.
_NUMBER = r"^[ \t\r\n]*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"


def pick(relation: Relation, attr: str | int) -> Attr:
    """By bare name, the first that fits, or by position from 0."""
    if isinstance(attr, int):
        if not 0 <= attr < len(relation.attrs):
            raise SemanticError(f"no attribute at position {attr}")
        return relation.attrs[attr]
    for a in relation.attrs:
        if a.name == attr:
            return a
    raise SemanticError(f"unknown attribute {attr}")


def _number(column: Column, attr: Attr) -> Column:
    if attr.domain == STRING:
        return F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(`{attr.phys}`, '{_NUMBER}', 1), '') AS DOUBLE)".replace("\\", "\\\\")), F.lit(0.0))
    if attr.domain not in NUMERIC:
        raise SemanticError(f"{attr.key} is no number")
    return column.cast("double")


def aggregate(relation: Relation, function: str, attr: str | int | None = None, out: str = "value") -> DataFrame:
    """One row with the aggregate; of an empty input it is 0 in the column's own domain.

    MIN and MAX of a STRING or BYTES attribute are NULL then, as such a column
    can't hold the INT 0 that a procedure call returns for them.  AVG is a FLOAT
    (accumulated in double precision), VAR the population variance; SUM of a
    STRING attribute adds the lengths in bytes.
    """
    function = function.upper()
    if function == "COUNT":
        return relation.df.agg(F.count(F.lit(1)).alias(out))
    found = pick(relation, attr if attr is not None else 0)
    column = F.col(f"`{found.phys}`")
    if found.domain == OTHER:
        raise SemanticError(f"{found.key} has no domain to aggregate over")
    if function in ("MIN", "MAX"):
        least = (F.min if function == "MIN" else F.max)(column)
        if found.domain in NUMERIC:
            least = F.coalesce(least, F.lit(0).cast(relation.df.schema[found.phys].dataType))
        return relation.df.agg(least.alias(out))
    if function == "AVG":
        return relation.df.agg(F.coalesce(F.avg(_number(column, found)), F.lit(0.0)).cast("float").alias(out))
    if function == "SUM":
        if found.domain == STRING:
            return relation.df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).cast("long").alias(out))
        total = F.sum(column.cast("double") if found.domain == FLOAT else column)
        return relation.df.agg(F.coalesce(total, F.lit(0)).alias(out))
    if function == "VAR":
        return relation.df.agg(F.coalesce(F.var_pop(_number(column, found)), F.lit(0.0)).alias(out))
    raise SemanticError(f"unknown aggregate {function}")


def aggregate_domain(function: str, attr: Attr | None) -> str:
    if function == "COUNT" or attr is None:
        return INT
    return attr.domain if function in ("MIN", "MAX") else FLOAT
