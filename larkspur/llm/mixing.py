"""Mixing sources to target weights by capped water-filling.

Sources share ``share`` times the corpus by weight; a source whose share would
exceed ``max_epochs`` times its size is clamped there and the excess is handed
on by weight until no source is above its cap.  The water level is read off one
sorted pass over the per-source sums: with sources in order of cap per weight,
it is the largest level that stays under its own source's cap.

A source's target becomes whole repetitions of every document plus a fraction.
The fraction is a seeded sample: documents stand in the order of a seeded hash
and are taken while the middle of each lies within the words still wanted, so a
source misses its target by at most half a document.  The cut is found without
sorting a source: words are summed by (source, hash bucket), and only the bucket
that holds the cut is ordered.  All of it is DataFrame expressions.

Defined results: null and empty texts have size 0 and are repeated as often as
the whole repetitions of their source, and once more where the fraction's sample
holds them; a source without a fraction is repeated whole only, so no document
of it exceeds ``max_epochs`` (rounded up where that is no integer); a null
source is a source of its own, ranked last; a source without words has target 0
and is not taken; rows that share ``doc_id`` are taken alike (null ids: alike by
text); an empty table gives no rows.  Extra columns pass through whatever their
names: ``mixed_documents`` returns the input's columns unchanged, ``mix_counts``
returns its own ``size``, ``source_size``, ``target``, ``copies`` and ``taken``
in place of input columns of those names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .columns import Carried
from .scratch import Scratch

SHARE, MAX_EPOCHS, WEIGHTS, SEED = 1.5, 2.0, (5, 2, 1), "mix-1"
BUCKET_DIGITS = 3
#: Per-source plans are broadcast up to this many sources, about 50 bytes each.
BROADCAST_SOURCES = 100_000
OUTPUTS = ("size", "source_size", "target", "copies", "taken")
_WORD = r"[^\x20\x09-\x0D]+"


def _sized(docs: Carried, seed: str) -> DataFrame:
    """The carried input with ``source``, ``size`` and ``_draw``."""
    text = docs["text"].cast("string")
    name = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    size = F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")
    return docs.df.select("*", docs["source"].cast("string").alias("source"), size.alias("size"), F.md5(F.concat(F.lit(seed + ":"), name)).alias("_draw"))


def water_fill(sources: DataFrame, share: float, max_epochs: float, weights: tuple[int, ...]) -> DataFrame:
    """``sources(source, source_size)`` with ``weight`` and ``target``; one row per source."""
    cycle = F.array(*map(F.lit, weights))
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.get(cycle, (F.col("_rank") - 1) % len(weights)))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(max_epochs)).withColumn("_turn", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_turn", "_rank")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("_total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("_below", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_below")) / F.col("_weights"))
        .withColumn("_water", F.max(F.expr("CASE WHEN _level <= _turn THEN _level END")).over(every))
    )
    target = F.coalesce(F.least(F.col("_cap"), F.col("weight") * F.col("_water")), F.col("_cap"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def mixing_plan(sized: DataFrame, scratch: Scratch, share: float, max_epochs: float, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: size, target, whole repetitions and the hash up to which one more is taken."""
    slot = F.substring("_draw", 1, BUCKET_DIGITS)
    sums = scratch.table(sized.groupBy("source", slot.alias("_slot")).agg(F.sum("size").alias("words")), "sums")
    sources = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = water_fill(sources, share, max_epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole.cast("int")).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = scratch.table(plan, "plan")
    w = Window.partitionBy("source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("reached", F.sum("words").over(w))
    run = _attach(run, plan.select("source", "wanted")).filter("reached > wanted")
    cut = run.groupBy("source").agg(F.min(F.struct("_slot", (F.col("reached") - F.col("words")).alias("base"))).alias("cut"))
    near = _attach(sized.select("source", "_draw", "size"), plan.join(cut, plan.source.eqNullSafe(cut.source)).select(plan.source, "wanted", "cut"))
    near = near.filter(slot == F.col("cut._slot")).groupBy("source", "_draw").agg(F.sum("size").alias("size"), F.first("wanted").alias("wanted"), F.first("cut.base").alias("base"))
    w = Window.partitionBy("source").orderBy("_draw").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("middle", F.col("base") + F.sum("size").over(w) - F.col("size") / 2)
    last = near.filter("middle <= wanted").groupBy("source").agg(F.max("_draw").alias("last"))
    first = cut.select("source", F.col("cut._slot").alias("opens"))
    out = plan.join(first, plan.source.eqNullSafe(first.source), "left").drop(first.source)
    out = out.join(last, out.source.eqNullSafe(last.source), "left").drop(last.source)
    # below "opens" all is taken; in its bucket up to "last"; no draw lies at or below the empty text
    until = F.when((F.col("wanted") <= 0) | F.col("opens").isNull(), F.lit("")).otherwise(F.coalesce("last", "opens"))
    return scratch.table(out.select("source", "source_size", "target", "whole", until.alias("until")), "cuts")


def _attach(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    if per_source.count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    keyed = per_source.withColumnRenamed("source", "_source")
    return rows.join(keyed, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _counted(docs: Carried, share: float = SHARE, max_epochs: float = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The input's rows with ``copies`` and what it follows from, under all carried columns and under ``doc_id`` alone."""
    scratch = Scratch(docs.df.sparkSession, "mix")
    sized = _sized(docs, seed)
    small = scratch.table(sized.select(docs["doc_id"].alias("doc_id"), "source", "size", "_draw"), "sized")
    plan = mixing_plan(small, scratch, share, max_epochs, weights)
    copies = F.when(F.col("source_size") > 0, F.col("whole") + F.when(F.col("_draw") <= F.col("until"), 1).otherwise(0)).otherwise(0)
    finish = lambda df: _attach(df, plan).withColumn("copies", copies.cast("int")).withColumn("taken", F.col("size") * F.col("copies"))
    return finish(sized), finish(small)


def mix_counts(docs: DataFrame, keep_text: bool = True, **settings) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``; settings are those of ``_counted``.

    ``keep_text=False`` returns only ``doc_id`` and ``source`` of the input's columns.
    """
    carried = Carried(docs)
    whole, small = _counted(carried, **settings)
    if not keep_text:
        return small.select("doc_id", "source", *OUTPUTS)
    return whole.select(*carried.restored(*OUTPUTS), *OUTPUTS)


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    carried = Carried(docs)
    counted = _counted(carried, **settings)[0].filter("copies > 0")
    return counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*carried.restored())


def op4_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_counts(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || doc_id::VARCHAR) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
t AS (SELECT *, cap / weight AS turn FROM w),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY turn, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / (sum(weight) OVER (ORDER BY turn, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM t),
p AS (SELECT *, max(CASE WHEN level <= turn THEN level END) OVER () AS water FROM l),
g AS (SELECT source, source_size, coalesce(least(cap, weight * water), cap) AS target FROM p),
h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM g),
j AS (
  SELECT d.doc_id, d.size, h.source_size, h.target, h.whole, h.target - h.whole * h.source_size AS wanted,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - d.size / 2.0 AS middle
  FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN (whole + CASE WHEN wanted > 0 AND middle <= wanted THEN 1 ELSE 0 END)::INTEGER ELSE 0 END AS copies FROM j)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM k
"""
