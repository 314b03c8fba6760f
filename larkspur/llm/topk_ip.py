"""Exact top-k by inner product over norm-sorted vectors with residual bounds.

Components become ``floor(64 * x)``.  Vectors are range-partitioned by falling
norm and packed into blocks of at most ``BLOCK``; an orthonormal rotation (the
singular vectors of at most ``SAMPLE`` rows) puts most of the length into the
first coordinates.  Every query block first meets the block of longest vectors,
which gives each query a k-th best score to beat.  Queries are then packed by
the vector length that they still need for that, so one weak query does not open
blocks for strong ones.  A (query block, candidate block) pair is opened only if
some query of the one could still beat its k-th score by norm alone.  Inside a pair, candidates are taken by falling length in
steps: partial sums over the first coordinates plus the Cauchy-Schwarz product
of the residual norms bound every score, survivors are scored exactly in
integers, and the k-th scores rise from step to step.  A last window merges each
query's at most ``k`` rows per opened block.  Bounds carry a slack for rounding
and only prune what is strictly below the k-th score, so ties are never lost.

Defined results: vectors that are null or hold null or non-finite components,
and rows without ``vec_id``, take no part; vectors of unequal length are compared
as if padded with zeros; ties go to the smaller ``vec_id``; rows that share
``vec_id`` are one query (that of the least vector) and candidates each; an empty table, or
one without queries, gives no rows; extra columns are ignored.  Scores are exact
while they fit in 53 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .arrow import map_arrow
from .scratch import Scratch

K, EVERY = 20, 20
BLOCK, QUERIES, STEP = 4096, 512, 1024
SAMPLE = 8192
_PACKED = "block long, n int, top double, ids binary, vectors binary"


def integer_vectors(df: DataFrame) -> DataFrame:
    """``(vec_id, v array<long>, norm double)`` of the rows that take part."""
    sound = "embedding IS NOT NULL AND vec_id IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(sound)
    rows = rows.select("vec_id", F.expr("transform(embedding, x -> CAST(floor(64D * x) AS BIGINT))").alias("v"))
    return rows.withColumn("norm", F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x))"))


def _packer(width: int, size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, ids, vectors = 0, [], []

        def block() -> pa.RecordBatch:
            nonlocal made
            name = (TaskContext.get().partitionId() << 32) + made
            made += 1
            i, v = np.array(ids, dtype="<i8"), np.array(vectors, dtype="<i8").reshape(len(ids), width)
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int32()), pa.array([float(np.sqrt((v.astype(float) ** 2).sum(axis=1).max()))]), pa.array([i.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["block", "n", "top", "ids", "vectors"])
            ids.clear()
            vectors.clear()
            return out

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids.append(i)
                vectors.append(v + [0] * (width - len(v)))
                if len(ids) == size:
                    yield block()
        if ids:
            yield block()

    return pack


def _unpack(ids: bytes, vectors: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype="<i8"), np.frombuffer(vectors, dtype="<i8").reshape(n, -1)


class Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, qids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.qids, self.k = qids, k
        self.scores = [np.empty(0, dtype=np.int64)] * len(qids)
        self.ids = [np.empty(0, dtype=np.int64)] * len(qids)
        self.floor = np.full(len(qids), -np.inf) if floor is None else floor.copy()

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores[q], scores)), np.concatenate((self.ids[q], ids))
        keep = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[keep], ids[keep]
        if len(keep) == self.k:
            self.floor[q] = max(self.floor[q], float(self.scores[q][-1]))


def search_block(best: Best, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray) -> int:
    """Offer a candidate block to ``best``; returns how many pairs were scored in full."""
    lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    ids, vectors, lengths = ids[order], vectors[order], lengths[order]
    head = max(1, rotation.shape[1] // 4)
    q = queries.astype(float)
    q_len = np.sqrt((q * q).sum(axis=1))
    q_head = q @ rotation[:, :head]
    q_rest = np.sqrt(np.maximum(q_len**2 - (q_head**2).sum(axis=1), 0))
    scored = 0
    for at in range(0, len(ids), STEP):
        slack = 1e-6 + 1e-9 * q_len * lengths[at]
        live = np.flatnonzero(q_len * lengths[at] + slack >= best.floor)
        if not len(live):
            break
        part = vectors[at : at + STEP].astype(float)
        c_head = part @ rotation[:, :head]
        c_rest = np.sqrt(np.maximum(lengths[at : at + STEP] ** 2 - (c_head**2).sum(axis=1), 0))
        bound = q_head[live] @ c_head.T + q_rest[live, None] * c_rest + slack[live, None]
        may = bound >= best.floor[live, None]
        may &= ids[at : at + STEP] != best.qids[live, None]
        for row, qi in enumerate(live.tolist()):
            chosen = np.flatnonzero(may[row])
            if len(chosen):
                scored += len(chosen)
                best.add(qi, vectors[at + chosen] @ queries[qi], ids[at + chosen])
    return scored


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows whose ``vec_id`` is divisible by ``every``."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.table(integer_vectors(embeddings), "vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max("norm").alias("longest")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(facts["width"], 1)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    fitted = np.array([v + [0] * (width - len(v)) for v in sample], dtype=float).reshape(-1, width)
    rotation = np.linalg.svd(fitted.T @ fitted)[0]
    parts = max(1, -(-facts["n"] // BLOCK))
    by_norm = rows.repartitionByRange(parts, F.col("norm").desc(), "vec_id").sortWithinPartitions(F.col("norm").desc(), "vec_id")
    blocks = scratch.table(map_arrow(by_norm.select("vec_id", "v"), _packer(width, BLOCK), _PACKED), "blocks")
    # of rows that share an id, the least vector asks
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    # one block of the longest vectors: BLOCK rows at most
    first = blocks.orderBy(F.col("top").desc(), "block").limit(1).collect()[0]
    shared = spark.sparkContext.broadcast((bytes(first["ids"]), bytes(first["vectors"]), first["n"], rotation))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, cvecs = _unpack(*shared.value[:3])
        for whole in batches:
            for at in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(at, QUERIES)
                qids = batch.column("vec_id").to_numpy()
                q = np.array([v + [0] * (width - len(v)) for v in batch.column("v").to_pylist()], dtype=np.int64).reshape(-1, width)
                best = Best(qids, k)
                search_block(best, q, cids, cvecs, shared.value[3])
                length = np.sqrt((q.astype(float) ** 2).sum(axis=1))
                known = np.isfinite(best.floor) & (best.floor > 0) & (length > 0)
                need = np.where(known, np.where(known, best.floor, 0.0) / np.maximum(length, 1e-300), 0.0) * (1 - 1e-9)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(best.floor), pa.array(need)], names=["vec_id", "v", "floor", "need"])

    asked = scratch.table(map_arrow(asked.select("vec_id", "v"), floors, "vec_id long, v array<long>, floor double, need double"), "asked")
    by_need = asked.repartitionByRange(max(1, -(-facts["n"] // (every * QUERIES))), F.col("need").desc(), "vec_id").sortWithinPartitions(F.col("need").desc(), "vec_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = 0
        for whole in batches:
            for at in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(at, QUERIES)
                q = np.array([v + [0] * (width - len(v)) for v in batch.column("v").to_pylist()], dtype="<i8").reshape(-1, width)
                name, made = (TaskContext.get().partitionId() << 32) + made, made + 1
                floor, need = (batch.column(c).to_numpy() for c in ("floor", "need"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([len(q)], pa.int32()), *(pa.array([x], pa.binary()) for x in (batch.column("vec_id").to_numpy().astype("<i8").tobytes(), q.tobytes(), floor.astype("<f8").tobytes())), pa.array([float(need.min())])],
                    names=["qblock", "qn", "qids", "qvectors", "floor", "need"],
                )

    ready = scratch.table(map_arrow(by_need, pack, "qblock long, qn int, qids binary, qvectors binary, floor binary, need double"), "ready")
    # block names and two numbers each; payloads join by name afterwards
    pairs = ready.select("qblock", "need").join(blocks.select("block", "top"), F.col("top") >= F.col("need")).select("qblock", "block")
    opened = pairs.join(ready, "qblock").join(blocks, "block").select("qn", "qids", "qvectors", "floor", "n", "ids", "vectors")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qids, q = _unpack(row["qids"], row["qvectors"], row["qn"])
                cids, cvecs = _unpack(row["ids"], row["vectors"], row["n"])
                best = Best(qids, k, np.frombuffer(row["floor"], dtype="<f8"))
                search_block(best, q, cids, cvecs, shared.value[3])
                sizes = [len(x) for x in best.ids]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, sizes)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], names=["query_id", "vec_id", "score"])

    found = map_arrow(opened, search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_inner_products(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
