"""Sharding by a hierarchical weighted hash tree.

Shards fill racks of ``per_rack`` and regions of ``racks`` racks in order; a
node weighs as many shards as it holds.  A row descends region, rack and shard;
at each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the
row's key and the child's name, and the least draw wins.  A child's draw depends
on its own weight alone, so when weights grow, rows move only into the subtrees
whose weight grew.  A shard that opens a region of its own (the 41st of 40 in
regions of ten) therefore takes rows only into itself.

Slots count from 0 inside each shard without sorting a shard, or the rows of one
id, in one task: rows equal in every returned column become one row with a count,
in chunks of at most ``CHUNK``; these are dealt by range to partitions of about
equal size, numbered within (shard, partition), and the partitions of a shard are
laid end to end from their sums, a table of a row for each partition and shard.

Defined results: the key is ``doc_id``; a null ``doc_id`` is placed by its text;
null text has no bytes and the CRC of the empty string; repeated rows share a
shard and have slots of their own; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch

SHARDS, PER_RACK, RACKS = 40, 5, 2
BUCKETS = 256
CHUNK = 1024


def _uniform(*parts: str) -> str:
    """SQL for a hashed number inside (0, 1), equal in any engine with md5."""
    return f"(CAST(conv(substring(md5(concat_ws('/', {', '.join(parts)})), 1, 12), 16, 10) AS DOUBLE) + 0.5D) / {float(1 << 48)!r}D"


def _least_draw(count: str, weight: str, *path: str) -> str:
    """SQL for the index of the child with the least weighted draw."""
    draw = f"named_struct('draw', -ln({_uniform(*path, 'CAST(c AS STRING)')}) / ({weight}), 'c', c)"
    return f"array_min(transform(sequence(0, ({count}) - 1), c -> {draw})).c"


def place(rows: DataFrame, key: str, shards: int, out: str, per_rack: int = PER_RACK, racks: int = RACKS) -> DataFrame:
    """``rows`` with the shard of each row's string ``key`` in column ``out``."""
    region_size = per_rack * racks
    regions = -(-shards // region_size)
    in_region = f"least({region_size}, {shards} - c * {region_size})"
    rows = rows.withColumn("_region", F.expr(_least_draw(str(regions), in_region, key, "'region'")))
    held = f"least({region_size}, {shards} - _region * {region_size})"
    in_rack = f"least({per_rack}, ({held}) - c * {per_rack})"
    rows = rows.withColumn("_rack", F.expr(_least_draw(f"ceil(({held}) / {per_rack}.0D)", in_rack, key, "'rack'", "CAST(_region AS STRING)")))
    in_this = f"least({per_rack}, ({held}) - _rack * {per_rack})"
    rows = rows.withColumn("_leaf", F.expr(_least_draw(in_this, "1", key, "'shard'", "CAST(_region AS STRING)", "CAST(_rack AS STRING)")))
    return rows.withColumn(out, (F.col("_region") * region_size + F.col("_rack") * per_rack + F.col("_leaf")).cast("int")).drop("_region", "_rack", "_leaf")


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of ``docs(doc_id, text)``."""
    scratch = Scratch(docs.sparkSession, "shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text))).alias("_key"))
    rows = rows.groupBy("doc_id", "_key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_all"))
    rows = rows.withColumn("_chunk", F.explode(F.expr(f"sequence(0, CAST((_all - 1) DIV {CHUNK} AS INT))")))
    rows = rows.withColumn("_n", F.expr(f"CAST(least(_all - CAST(_chunk AS LONG) * {CHUNK}, {CHUNK}) AS INT)")).drop("_all")
    rows = place(place(rows, "_key", shards, "shard"), "_key", shards + 1, "grown_shard")
    rows = rows.withColumn("_bucket", F.expr(f"CAST(conv(substring(md5(concat('bucket/', _key)), 1, 4), 16, 10) AS INT) % {BUCKETS}"))
    placed = scratch.table(rows, "placed")
    order = ("_bucket", "_key", "text_crc32", "size", "_chunk")
    ranged = scratch.table(placed.repartitionByRange("shard", *order).withColumn("_range", F.spark_partition_id()), "ranged")
    scratch.drop("placed")
    counts = ranged.groupBy("shard", "_range").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    if shards + int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) <= 1 << 20:
        offsets = F.broadcast(offsets)
    within = Window.partitionBy("shard", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_at", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(offsets, ["shard", "_range"])
    out = out.withColumn("_i", F.explode(F.expr("sequence(0, _n - 1)")))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_offset") + F.col("_at") + F.col("_i")).cast("long").alias("slot"), "grown_shard")


def op10_shards(spark, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql_draw(count: str, weight: str, *path: str) -> str:
    key = " || '/' || ".join(("k", *path, "c::VARCHAR"))
    u = f"((('0x' || substr(md5({key}), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)"
    return f"list_min(list_transform(range({count}), lambda c: {{'draw': -ln({u}) / ({weight}), 'c': c}})).c"


def _sql_place(source: str, shards: int) -> str:
    """SQL for the descent in a tree of ``shards``, racks of 5 and regions of 10."""
    held = f"least(10, {shards} - region * 10)"
    return f"""
      (SELECT doc_id, region * 10 + rack * 5 + {_sql_draw(f"least(5, ({held}) - rack * 5)", "1", "'shard'", "region::VARCHAR", "rack::VARCHAR")} AS shard FROM
        (SELECT *, {_sql_draw(f"ceil(({held}) / 5.0)::BIGINT", f"least(5, ({held}) - c * 5)", "'rack'", "region::VARCHAR")} AS rack FROM
          (SELECT *, {_sql_draw(f"ceil({shards} / 10.0)::BIGINT", f"least(10, {shards} - c * 10)", "'region'")} AS region FROM {source})))"""


#: CRC32 byte by byte: its table follows from the polynomial, written here as the number 3988292384.
OP10_SQL = f"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, doc_id::VARCHAR AS k, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, k, (len(h) // 2 + 16)::BIGINT AS size,
        xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS text_crc32
      FROM d, tab),
a AS {_sql_place("d", 40)},
b AS {_sql_place("d", 41)},
s AS (SELECT c.*, a.shard, b.shard AS grown, ('0x' || substr(md5('bucket/' || k), 1, 4))::BIGINT % 256 AS bucket FROM c JOIN a USING (doc_id) JOIN b USING (doc_id))
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY bucket, k, text_crc32, size) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard FROM s
"""
