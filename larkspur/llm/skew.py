"""Equi-joins whose left side may hold most of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot above ``LEAST_ROWS`` rows and above the average of this many tasks, so no more keys than this are hot.
HOT_KEYS = 50_000
LEAST_ROWS = 500


def salted_join(left: DataFrame, counted: DataFrame, key: str | list[str], spread: list[str], how: str = "inner", rows: str = "n") -> DataFrame:
    """``left`` joined to ``counted``, a written table that is unique by ``key`` (one column or several).

    Column ``rows`` of ``counted`` tells how many rows of ``left`` a key has.  A
    hot key's rows are dealt, by a hash of the ``spread`` columns, to salts of
    about equal size, and only its row of ``counted`` is repeated for them; all
    other keys meet plainly.  The table of hot keys is broadcast: it has at most
    ``HOT_KEYS`` rows whatever the input.
    """
    keys = [key] if isinstance(key, str) else key
    facts = counted.agg(F.sum(rows).alias("total"), F.max(rows).alias("most")).first()
    size = max(LEAST_ROWS, -(-(facts["total"] or 0) // HOT_KEYS))
    if (facts["most"] or 0) <= size:
        return left.join(counted, keys, how)
    hot = F.broadcast(counted.filter(F.col(rows) > size).select(*keys, F.ceil(F.col(rows) / size).cast("int").alias("_salts")))
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_salts")))
    left = left.join(hot, keys, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    right = counted.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
