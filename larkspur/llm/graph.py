"""Connected components of a link table, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch
from .skew import salted_join


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour ``m`` of each ``u``, and its number ``n`` of edges."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(id, label)`` for every id in ``edges(u, v)``; label is the least id reachable.

    Alternates the large-star and small-star steps, each a grouped minimum and an
    equi-join, until the edge set is unchanged: every edge then points from a
    member to its component's least id.  The edges of a hub, which a family of
    copies ends in, are dealt to several tasks.  Each step is written to the
    shared folder, so lineage stays short.
    """
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    current, step, seen = scratch.table(both, f"{name}-0"), 0, None
    while (now := _fingerprint(current)) != seen and now[0]:
        seen = now
        either = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(_least(either).withColumn("m", F.least("u", "m")), f"{name}-least-large")
        large = salted_join(either.filter("v > u"), least, "u", ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(large.filter("u <> v").distinct(), f"{name}-large")
        least = scratch.table(_least(large), f"{name}-least-small")
        small = salted_join(large, least, "u", ["v"]).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        step += 1
        current = scratch.table(small.filter("u <> v").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    return current.select(F.col("u").alias("id"), F.col("v").alias("label"))
