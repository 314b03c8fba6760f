"""Document fingerprints by I-Match over several randomised lexicon subsets.

A term is a lower-cased word, known by a 64-bit hash whose top bits name one of
``SLOTS`` slots; a slot's document frequency counts the documents that hold a
term of it.  The lexicon is the slots whose frequency share lies within
``[LOW, HIGH]``, a band of inverse document frequency; at most (mean distinct
terms / LOW) slots can reach it, and as one bit a slot it is ``SLOTS / 8`` bytes
at any corpus size.  A document keeps its lexicon terms, distinct and sorted,
and hashes them whole and within randomised subsets of the lexicon of a half,
a quarter, 1/16, 1/64 and 1/256, most of them small, so that short and long
documents alike have subsets that a partial edit leaves alone.  Likeness of two fingerprints is the
share of equal parts among those parts that at least one of them has.

The neighbour in descending ``doc_id`` comes from one range shuffle: rows are
dealt by quantiles of ``doc_id`` to buckets of about ``BUCKET_BYTES`` of text
(at most ``MAX_BUCKETS`` numbers on the driver), a window reads the next row in
the bucket, and each bucket's first row is also sent to the bucket before it.  An
id that fills a bucket by itself, as the null id may, has its rows dealt on to
``SUB_BUCKETS`` ranges of the text hash that orders them.  Everything is
DataFrame expressions.

Defined results: null text counts as empty; a document without lexicon terms is
fingerprinted by all its terms; equal texts have equal fingerprints; two texts
without any part in common have likeness 0; null ids come last in the order;
rows of equal id stand in order of a text hash; a single row is its own
neighbour; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
LOW, HIGH = 0.0005, 0.05
#: (first bit, bits, subsets): a subset holds the terms whose field has one value.
FIELDS = ((20, 1, 2), (18, 2, 4), (0, 4, 8), (4, 6, 24), (10, 8, 32))
ROWS_PER_BUCKET, BUCKET_BYTES, MAX_BUCKETS, SUB_BUCKETS = 2000, 16 << 20, 1 << 15, 64


def _terms(text: str) -> Column:
    return F.expr(f"array_distinct(transform(filter(split(lower({text}), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''), w -> xxhash64(w)))")


def lexicon(texts: DataFrame, scratch: Scratch, low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row ``lexicon``: an array of longs with a bit for each slot inside the band."""
    slots = texts.select(F.explode(F.array_distinct(F.transform(_terms("text"), lambda t: F.shiftrightunsigned(t, 64 - SLOT_BITS)))).alias("slot"))
    n = texts.count()
    band = slots.groupBy("slot").count().filter((F.col("count") >= low * n) & (F.col("count") <= max(high * n, 2)))
    words = band.groupBy(F.shiftright("slot", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits"))
    every = texts.sparkSession.range(SLOTS // 64).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("all"))
    return scratch.table(row.select(F.col("all.bits").alias("lexicon")), "lexicon")


def fingerprint(df: DataFrame, text: str, bits: Column, out: str) -> DataFrame:
    """``df`` with ``out array<long>``, null where a subset holds none of the text's terms."""
    df = df.withColumn("_all", F.sort_array(_terms(text))).withColumn("_bits", bits)
    inside = "filter(_all, t -> getbit(element_at(_bits, CAST(shiftrightunsigned(t, 50) AS INT) + 1), CAST(shiftrightunsigned(t, 44) & 63 AS INT)) = 1)"
    df = df.withColumn("_in", F.expr(inside))
    parts = ["xxhash64(if(size(_in) > 0, _in, _all))"]
    for first, bits_wide, subsets in FIELDS:
        # the terms that any subset of this field holds, so that each subset looks at few
        field, some = f"(t & {((1 << bits_wide) - 1) << first}L)", f"_in_{first}"
        df = df.withColumn(some, F.expr(f"filter(_in, t -> {field} < {subsets << first}L)"))
        for value in range(subsets):
            chosen = f"filter({some}, t -> {field} = {value << first}L)"
            parts.append(f"transform(array({chosen}), x -> if(size(x) > 0, xxhash64(x), NULL))[0]")
    return df.withColumn(out, F.expr(f"array({', '.join(parts)})")).drop("_all", "_bits", "_in", *(f"_in_{first}" for first, _, _ in FIELDS))


def likeness(a: str, b: str) -> Column:
    """Share of equal parts among those that either fingerprint has."""
    pairs = f"arrays_zip({a}, {b})"
    same = f"size(filter({pairs}, p -> p.{a} = p.{b}))"
    either = f"size(filter({pairs}, p -> p.{a} IS NOT NULL OR p.{b} IS NOT NULL))"
    return F.expr(f"CAST({same} AS DOUBLE) / {either}")


def _hex(fp: str) -> Column:
    return F.expr(f"array_join(transform({fp}, x -> if(x IS NULL, '-', lpad(hex(x), 16, '0'))), '.')")


def with_next(rows: DataFrame, carried: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``next_<c>`` of the row after it in descending ``doc_id``, the first after the last."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = max(1, min(MAX_BUCKETS, max(-(-facts["n"] // ROWS_PER_BUCKET), -(-(facts["bytes"] or 0) // BUCKET_BYTES))))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 10 * buckets).alias("c")).first()["c"] or []
    # an id that two neighbouring quantiles fall on fills a bucket, and gets one of its own
    full = sorted({x for x, y in zip(cuts, cuts[1:], strict=False) if x == y})
    cuts = sorted({*cuts, *(x + 1 for x in full)}) if buckets > 1 else []
    step, found = 1 << len(cuts).bit_length(), F.lit(0)
    if cuts:
        bounds = F.lit(cuts)
        steps = F.array(*(F.lit(step >> i) for i in range(step.bit_length())))
        found = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) <= F.col("doc_id"), at + s).otherwise(at))
    alone = F.col("doc_id").isNull()
    if full:
        alone = alone | F.array_contains(F.lit(full), F.col("doc_id"))
    place = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.lit(len(cuts)) - found)
    # ranges of the hash, of 2**64 values from the least on
    sub = F.when(alone, F.shiftright("text_hash", 64 - SUB_BUCKETS.bit_length() + 1) + SUB_BUCKETS // 2).otherwise(F.lit(0))
    rows = rows.withColumn("_b", (place.cast("long") * SUB_BUCKETS + sub).cast("long"))
    # at most MAX_BUCKETS + SUB_BUCKETS * (full ids + 1) rows: the first row of each bucket, and the bucket before it
    order = (F.col("doc_id").isNull(), -F.col("doc_id"), F.col("text_hash"))
    heads = rows.groupBy("_b").agg(F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("_head"))
    w = Window.orderBy("_b")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumn("_to", F.coalesce(F.lag("_b").over(w), F.last("_b").over(every)))
    heads = F.broadcast(scratch.table(heads.select(F.col("_b").alias("_hb"), (-F.col("_head.o1")).alias("_id"), F.col("_head.o2").alias("_hash"), "_to"), "heads"))
    first = (F.col("_b") == F.col("_hb")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    placed = rows.join(heads, first, "left")
    own, lent = F.struct(F.col("_b").alias("b"), F.lit(0).alias("lent")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("lent"))
    placed = placed.withColumn("_p", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, lent))))
    placed = placed.select(*rows.columns, F.col("_p.b").alias("_bucket"), F.col("_p.lent").alias("_lent")).drop("_b")
    # plain columns and one select, so that both leads share one exchange and one sort
    w = Window.partitionBy("_bucket").orderBy("_lent", F.col("doc_id").desc_nulls_last(), "text_hash")
    placed = placed.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried))
    return placed.filter("_lent = 0").drop("_bucket", "_lent")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next)``.

    ``edited`` is the text with its last half replaced by the start of the next document.
    """
    scratch = Scratch(docs.sparkSession, "imatch")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lex = lexicon(texts, scratch)
    rows = texts.withColumn("text_hash", F.xxhash64("text"))
    rows = fingerprint(rows, "text", lex.scalar(), "fp")
    rows = with_next(rows, ["text", "fp"], scratch)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("_half", F.expr("CAST(n_chars DIV 2 AS INT)"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars AS INT) - _half), substring(next_text, 1, _half))"))
    rows = fingerprint(rows.drop("text", "next_text"), "edited", lex.scalar(), "edited_fp")
    return rows.select(
        "doc_id", "n_chars", "edited", _hex("fp").alias("fingerprint"), _hex("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )


def op7_imatch(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprints(docs).withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
