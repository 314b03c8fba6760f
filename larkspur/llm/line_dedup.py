"""Removal of boilerplate lines by how many sites they spread over.

Lines (trimmed of spaces, blank ones aside) are hashed.  A line that occurs in
fewer rows than ``min_sites`` can't reach the threshold; for the others a
HyperLogLog sketch of the sites is merged by aggregation.  Estimates clearly
above or below the threshold decide; lines within ``BAND`` of it get an exact
distinct count.  A boilerplate line stays where it occurs first (least
``doc_id``, then least position) and goes everywhere else, so its words are not
lost to the corpus.

Defined results: null text has no lines and stays null; empty text is one blank
line and stays; a null site counts as one site; a null ``doc_id`` ranks last for
the first occurrence; repeated rows (same id and text) lose the same lines;
blank lines always stay; an empty table gives no rows.  Extra columns pass
through whatever their names: ``without_boilerplate`` returns the input's
columns, ``remove_boilerplate`` its own ``n_lines`` and ``n_removed`` in place of
input columns of those names.  Lines are compared by 64-bit hashes, which two
lines of 10^9 share with probability 0.03.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .columns import Carried
from .scratch import Scratch
from .skew import salted_join

MIN_SITES = 5
LG_K = 12
#: Three standard errors of a sketch with 2**LG_K registers, rounded up.
BAND = 0.06


def boilerplate_lines(lines: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES) -> DataFrame:
    """``(line, n)``: hashes of ``lines(line, site, place)`` that occur on ``min_sites`` sites or more, and in how many rows.

    ``place`` is any column whose values differ between the rows of a line.
    """
    counted = scratch.table(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites), "counted")
    often = scratch.table(salted_join(lines.select("line", "site", "place"), counted, "line", ["place"]), "often")
    spread = often.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.first("n").alias("n"))
    spread = scratch.table(spread, "spread")
    low, high = min(min_sites * (1 - BAND), min_sites - 1), max(min_sites * (1 + BAND), min_sites + 1)
    clear = spread.filter(F.col("sites") > high).select("line", "n")
    close = scratch.table(spread.filter((F.col("sites") >= low) & (F.col("sites") <= high)).select("line", "n"), "close")
    # a line near the threshold has few sites, so each task sends few rows of it on
    pairs = salted_join(often.select("line", "site", "place"), close, "line", ["place"]).groupBy("line", "site").agg(F.first("n").alias("n"))
    exact = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("sites"), F.first("n").alias("n")).filter(F.col("sites") >= min_sites)
    return clear.union(exact.select("line", "n"))


def _cut(docs: Carried, site_col: str, min_sites: int) -> DataFrame:
    """The carried input with ``kept`` (the text that is left), ``n_lines`` and ``n_removed``."""
    scratch = Scratch(docs.df.sparkSession, "lines")
    text = docs["text"].cast("string")
    # sha-free row key: equal for rows of equal id and text only, but for a 64-bit collision within one id
    key = docs.df.select("*", text.alias("text"), F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 62))).alias("key_id"), F.xxhash64(text).alias("key_text"))
    site = F.coalesce(docs[site_col].cast("string"), F.lit("\0")).alias("site")
    lines = key.filter("text IS NOT NULL").select("key_id", "key_text", docs["doc_id"].isNull().alias("last"), site, F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    lines = lines.withColumn("raw", F.trim("raw")).filter("raw <> ''").select("key_id", "key_text", "last", "site", "pos", F.xxhash64("raw").alias("line"), F.xxhash64("key_id", "key_text", "pos").alias("place"))
    lines = scratch.table(lines, "lines")
    found = scratch.table(boilerplate_lines(lines, scratch, min_sites), "boilerplate")
    places = lines.select("line", "place", F.struct("last", "key_id", "key_text", "pos").alias("at"))
    met = scratch.table(salted_join(places, found, "line", ["place"]), "met")
    first = scratch.table(met.groupBy("line").agg(F.min("at").alias("first"), F.first("n").alias("n")), "first")
    gone = salted_join(met.drop("n"), first, "line", ["place"]).filter("at <> first").groupBy("at.key_id", "at.key_text").agg(F.sort_array(F.collect_set("at.pos")).alias("gone"))
    out = key.join(gone, ["key_id", "key_text"], "left")
    every = F.split("text", "\n", -1)
    # positions by hashed set difference: linear in the lines of a document
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("gone")), lambda i: F.get(every, i))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(every))
    out = out.withColumn("n_lines", n_lines.cast("long")).withColumn("n_removed", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
    return out.withColumn("kept", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")))


def remove_boilerplate(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, plus ``n_lines`` and ``n_removed``."""
    carried = Carried(docs)
    out = _cut(carried, site_col, min_sites)
    columns = [F.col("kept").alias(n) if n == "text" else c for n, c in zip(carried.names, carried.restored(), strict=True) if n.lower() not in ("n_lines", "n_removed")]
    return out.select(*columns, "n_lines", "n_removed")


def without_boilerplate(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs``, all its columns, with boilerplate lines cut from ``text``; a document that lost all its words goes."""
    carried = Carried(docs)
    out = _cut(carried, site_col, min_sites)
    emptied = (F.col("n_removed") > 0) & ~F.col("kept").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(~emptied).select(*(F.col("kept").alias(n) if n == "text" else c for n, c in zip(carried.names, carried.restored(), strict=True)))


def op6_line_spread(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


OP6_SQL = """
WITH p AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS lines FROM documents),
u AS (SELECT doc_id, source, unnest(lines) AS raw, generate_subscripts(lines, 1) AS pos FROM p),
l AS (SELECT doc_id, source, pos, raw, trim(raw, ' ') AS line FROM u),
b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, chr(1))) >= 5),
m AS (SELECT l.doc_id, l.pos, row_number() OVER (PARTITION BY l.line ORDER BY l.doc_id, l.pos) AS nth FROM l JOIN b USING (line)),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (m.nth > 1) AS n_removed,
             coalesce(string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (coalesce(m.nth, 1) = 1), '') AS kept
      FROM l LEFT JOIN m ON l.doc_id = m.doc_id AND l.pos = m.pos GROUP BY l.doc_id)
SELECT p.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM p LEFT JOIN k USING (doc_id)
"""
