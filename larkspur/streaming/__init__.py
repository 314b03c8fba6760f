"""Statements over streams.

The language has no windows or state of its own: selections, projections,
unions and joins with stored tables apply to a streaming DataFrame as they are,
and Structured Streaming runs them incrementally.
"""

from __future__ import annotations

from dataclasses import fields, is_dataclass
from typing import Any

from pyspark.sql import DataFrame

from ..engine import Engine
from ..errors import SemanticError
from ..plans import tree as t
from ..plans.parser import parse


def _sorts(node: Any) -> bool:
    return isinstance(node, t.Sort) or is_dataclass(node) and any(_sorts(getattr(node, f.name)) for f in fields(node))


def over_stream(engine: Engine, table: str, stream: DataFrame, query: str) -> DataFrame:
    """``query`` with ``table`` read from ``stream``; SORT is refused, it would need the whole input."""
    if not stream.isStreaming:
        raise SemanticError(f"{table} is no stream")
    if _sorts(parse(query)):
        raise SemanticError("SORT over a stream would never end")
    engine.register(table, stream)
    return engine.query(query)
