"""Inputs under reserved names, so that no column of theirs meets one made by an operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class Carried:
    """``df`` holds the input's columns as ``in_0``, ``in_1``, …; ``carried["text"]`` is one of them.

    Operators name their own columns without that prefix and give the input's
    columns back by ``restored``.
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*(f"in_{i}" for i in range(len(self.names))))

    def __getitem__(self, name: str) -> Column:
        return F.col(f"in_{self.names.index(name)}")

    def restored(self, *without: str) -> list[Column]:
        """The input's columns under their own names, but for those in ``without`` (in any case)."""
        left_out = {n.lower() for n in without}
        return [F.col(f"in_{i}").alias(n) for i, n in enumerate(self.names) if n.lower() not in left_out]
