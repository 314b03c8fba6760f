"""Document quality by a factorisation machine.

Features are every word occurrence of the whole text, hashed into ``2**15``
slots and weighted ``1/sqrt(words)``, and one-hot bins of structure statistics
and metadata read from the text (length, word shape, character classes, line
shape, repetition).  The second-order term is scored in linear time as
``(sum v x)**2 - sum (v x)**2``, halved, per factor.

The machine is fitted on the driver from at most ``TRAIN_ROWS`` labelled rows of
together at most ``TRAIN_BYTES`` of text, taken in the order of a hash of
``doc_id`` among those whose ``crc32(doc_id) mod 3`` is not 1; a fixed seed and
order make fits repeat.  Everything else covers all rows.

Defined results: null text is scored as empty text; a null ``doc_id`` is never
held out and never trains; without labels (or with one class only) every score
is the smoothed share of label 1, or 1.0 with no labels at all, so nothing is
rejected; repeated rows score alike; an empty table gives no rows; extra columns
are ignored by ``quality_scores`` and pass through ``good_documents`` whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .arrow import cuts, map_arrow, ship, sliced, utf8
from .columns import Carried
from .scratch import Scratch
from .wordhash import batched_hashes, runs

TRAIN_ROWS, TRAIN_BYTES = 12_000, 48 << 20
WORD_BITS = 15
FACTORS = 8
EPOCHS = 6
BATCH = 256
RATE = 0.15
DECAY = 1e-5
HOLD_MOD, HOLD_REST = 3, 1
BINS = 24

_CLASS = np.full(256, 7, dtype=np.int64)
for _name, _members in enumerate((range(97, 123), range(65, 91), range(48, 58), (0x20, 0x09), (0x0A, 0x0D), b".,;:'\"-()?", b"!|#$%&*=+<>@_~^/\\[]{}")):
    _CLASS[list(_members)] = _name
N_STATS = 16
N_FEATURES = (1 << WORD_BITS) + N_STATS * (BINS + 1)


def structure(text: bytes, words: np.ndarray) -> np.ndarray:
    """Structure statistics, each squashed into 0..1."""
    n, m = max(len(text), 1), max(len(words), 1)
    share = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=8) / n
    spans = runs(words, 3)
    repeated = 1 - len(np.unique(spans)) / len(spans) if len(spans) else 0.0
    distinct = len(np.unique(words)) / m
    lines = text.split(b"\n")
    line_repeat = 1 - len(set(lines)) / len(lines)
    return np.array([
        np.log1p(len(text)) / 16, np.log1p(len(words)) / 14, min(len(text) / m / 32, 1), *share, distinct, repeated,
        min(np.log1p(max(map(len, lines))) / 14, 1), line_repeat, min(np.log1p(len(lines)) / 10, 1),
    ])


def features(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Feature indices of each text: ``N_STATS`` structure bins, then one index per word occurrence."""
    base = (1 << WORD_BITS) + np.arange(N_STATS) * (BINS + 1)
    for first, hashes, offsets in batched_hashes(texts, lower=True):
        slots = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        for i, (b, e) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            stats = structure(texts[first + i], hashes[b:e])
            bins = np.where(stats > 0, 1 + np.minimum((np.sqrt(np.clip(stats, 0, 1)) * BINS).astype(int), BINS - 1), 0)
            yield np.concatenate(((base + bins).astype(np.int32), slots[b:e]))


class FactorisationMachine:
    """Bias, linear weights and ``FACTORS`` latent factors for ``N_FEATURES`` indices."""

    def __init__(self, seed: int = 3):
        self.bias = 0.0
        self.w = np.zeros(N_FEATURES)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (N_FEATURES, FACTORS))

    @staticmethod
    def _rows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(r) for r in rows])
        x = np.concatenate([np.concatenate((np.ones(N_STATS), np.full(n - N_STATS, 1 / np.sqrt(max(n - N_STATS, 1))))) for n in sizes])
        return np.concatenate(rows), x, np.concatenate(([0], np.cumsum(sizes)[:-1]))

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        idx, x, starts = self._rows(rows)
        vx = self.v[idx] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.w[idx] * x, starts) + 0.5 * ((sums**2).sum(axis=1) - squares)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> "FactorisationMachine":
        rng = np.random.default_rng(seed)
        rate = (labels.sum() + 1) / (len(labels) + 2)
        self.bias = float(np.log(rate / (1 - rate)))
        if labels.min() == labels.max():
            return self
        gw, gv, gb = np.full(N_FEATURES, 1e-2), np.full((N_FEATURES, FACTORS), 1e-2), 1e-2
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                part = order[at : at + BATCH]
                idx, x, starts = self._rows([rows[i] for i in part])
                counts = np.diff(np.append(starts, len(idx)))
                vx = self.v[idx] * x[:, None]
                sums = np.add.reduceat(vx, starts)
                score = self.bias + np.add.reduceat(self.w[idx] * x, starts) + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
                error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[part]) / len(part)
                each = np.repeat(error, counts) * x
                grad = np.bincount(idx, each, N_FEATURES) + DECAY * self.w
                gw += grad * grad
                self.w -= RATE * grad / np.sqrt(gw)
                slope = each[:, None] * (np.repeat(sums, counts, axis=0) - vx)
                for f in range(FACTORS):
                    grad = np.bincount(idx, slope[:, f], N_FEATURES) + DECAY * self.v[:, f]
                    gv[:, f] += grad * grad
                    self.v[:, f] -= 0.3 * RATE * grad / np.sqrt(gv[:, f])
                gb += float(error.sum()) ** 2
                self.bias -= RATE * float(error.sum()) / gb**0.5
        return self


def _held_out(mod: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, most_bytes: int, mod: int, rest: int) -> DataFrame:
    """``(doc_id, text, label)`` of labelled rows outside the held-out fold, at most ``limit`` rows of at most ``most_bytes`` of text."""
    scratch = Scratch(docs.sparkSession, "training")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~_held_out(mod, rest))
    chosen = known.withColumn("_turn", F.xxhash64("doc_id", F.lit(label))).orderBy("_turn", "doc_id", "label").limit(limit)
    rows = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id"), "rows")
    # rows that share an id are one text or few; their number is not bounded by the labels
    sizes = rows.groupBy("_turn", "doc_id", "label").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("bytes"))
    reached = F.sum("bytes").over(Window.orderBy("_turn", "doc_id", "label").rowsBetween(Window.unboundedPreceding, 0))
    fits = sizes.withColumn("reached", reached).filter(F.col("reached") <= most_bytes).select("doc_id", "label")
    return rows.select("doc_id", "text", "label").join(F.broadcast(fits), ["doc_id", "label"], "left_semi")


def _collect_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        packed = [f.tobytes() for f in features(utf8(batch.column("text")))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())], names=["doc_id", "label", "packed"])


def fit_quality(docs: DataFrame, labels: DataFrame) -> FactorisationMachine | None:
    """The fitted machine, or None without any labelled row."""
    known = training_rows(docs, labels, "quality", TRAIN_ROWS, TRAIN_BYTES, HOLD_MOD, HOLD_REST)
    rows = map_arrow(known, _collect_features, "doc_id long, label int, packed binary").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    packed = [np.frombuffer(x, dtype=np.int32) for x in rows.column("packed").to_pylist()]
    return FactorisationMachine().fit(packed, np.array(rows.column("label").to_pylist(), dtype=float))


def score_texts(fm: FactorisationMachine | None, texts: list[bytes]) -> list[float]:
    """The score of each text, features made and dropped in runs of about 100,000."""
    scores: list[float] = []
    own: list[np.ndarray] = []
    total = 0

    def flush() -> None:
        if own:
            raw = fm.raw(own) if fm is not None else np.full(len(own), 30.0)
            scores.extend((1 / (1 + np.exp(-np.clip(raw, -30, 30)))).tolist())
            own.clear()

    for f in features(texts):
        own.append(f)
        total += len(f)
        if total > 100_000:
            flush()
            total = 0
    flush()
    return scores


def quality_of(docs: DataFrame, labels: DataFrame, text: Column) -> Column:
    """The score of ``text`` by the machine fitted on ``docs`` and ``labels``; only the text goes to Python."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))
    ship(docs.sparkSession)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fm = model.value
        for column in columns:
            yield pa.array([s for at, n in cuts(column) for s in score_texts(fm, utf8(column.slice(at, n)))], pa.float64())

    # not deterministic for the planner: it is evaluated once, wherever the score is used
    return F.arrow_udf(run, "double").asNondeterministic()(text.cast("string"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``."""
    scored = docs.select("doc_id", quality_of(docs, labels, F.col("text")).alias("score"))
    return scored.select("doc_id", _held_out(HOLD_MOD, HOLD_REST).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is 0.5 or more."""
    carried = Carried(docs)
    return carried.df.withColumn("score", quality_of(docs, labels, carried["text"])).filter("score >= 0.5").select(*carried.restored())


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
