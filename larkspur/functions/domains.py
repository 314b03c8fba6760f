"""The eight scalar domains and how Spark stores them.

There is no implicit conversion: a literal's domain must be the attribute's.
Unsigned domains ride in the next wider signed type and are range-checked.
Columns of any other Spark type are ``OTHER``: they pass through projections but
take no part in predicates.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from typing import Any

import numpy as np
from pyspark.sql import Column, functions as F, types as T

from ..errors import SemanticError

INT, UINT, LONG, ULONG, FLOAT, DOUBLE, STRING, BYTES, OTHER = "INT", "UINT", "LONG", "ULONG", "FLOAT", "DOUBLE", "STRING", "BYTES", "OTHER"

SPARK_TYPE: dict[str, T.DataType] = {
    INT: T.IntegerType(), UINT: T.LongType(), LONG: T.LongType(), ULONG: T.DecimalType(20, 0),
    FLOAT: T.FloatType(), DOUBLE: T.DoubleType(), STRING: T.StringType(), BYTES: T.BinaryType(),
}
RANGE = {INT: (-(1 << 31), (1 << 31) - 1), UINT: (0, (1 << 32) - 1), LONG: (-(1 << 63), (1 << 63) - 1), ULONG: (0, (1 << 64) - 1)}
NUMERIC = (INT, UINT, LONG, ULONG, FLOAT, DOUBLE)


@dataclass(frozen=True)
class Literal:
    """A constant with its domain, as written in a statement."""

    domain: str
    value: Any

    def column(self) -> Column:
        value = Decimal(self.value) if self.domain == ULONG else self.value
        return F.lit(value).cast(SPARK_TYPE[self.domain])


def domain_of(kind: T.DataType) -> str:
    """The domain under which a column of a registered DataFrame is known."""
    if isinstance(kind, T.DecimalType):
        return ULONG if (kind.precision, kind.scale) == (20, 0) else OTHER
    for domain in (INT, LONG, FLOAT, DOUBLE, STRING, BYTES):
        if kind == SPARK_TYPE[domain]:
            return domain
    return OTHER


def checked(literal: Literal, domain: str, size: int | None, what: str) -> Any:
    """The stored value of ``literal`` in an attribute, or SemanticError.

    A string longer than ``size - 1`` bytes is cut to that many, without leaving
    half a character behind.
    """
    if literal.domain != domain:
        raise SemanticError(f"{what} is {domain}, not {literal.domain}")
    if domain in RANGE:
        low, high = RANGE[domain]
        if not low <= literal.value <= high:
            raise SemanticError(f"{literal.value} is out of range for {domain} {what}")
        return Decimal(literal.value) if domain == ULONG else literal.value
    if domain == STRING and size is not None:
        return literal.value.encode("utf-8")[: size - 1].decode("utf-8", "ignore")
    if domain == FLOAT:
        return float(np.float32(literal.value))
    return literal.value
