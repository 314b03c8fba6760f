"""Toxicity by weak supervision.

Many weak voters fire on a document: single terms of a short public lexicon,
terms and word beginnings mined from labelled training rows, surface patterns
(shouting, exclamation), the silence of all terms, and the training label itself
as one more noisy voter for either class.
A generative label model, fitted by expectation maximisation, estimates the
class rate and how often each voter fires in either class; voters that fire
together beyond what the class explains are down-weighted by their estimated
correlations.  Its posterior labels train a linear classifier over hashed terms
(words and word beginnings of four to six bytes), which scores every whole text.

Voters and classifier are fitted on the driver from at most ``TRAIN_ROWS``
labelled rows of together at most ``TRAIN_BYTES`` of text, taken in the order of
a hash of ``doc_id`` among those whose ``crc32(doc_id) mod 5`` is not 0.

Defined results: null text is scored as empty text; a null ``doc_id`` is never
held out and never trains; without labels every score is 0.0 unless a term of
the public lexicon occurs; repeated rows score alike; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import wordhash
from .arrow import map_arrow, sliced, utf8
from .quality import _held_out, training_rows
from .wordhash import SLICE, mix

TRAIN_ROWS, TRAIN_BYTES = 12_000, 48 << 20
HOLD_MOD, HOLD_REST = 5, 0
BEGINNINGS = (4, 5, 6)
MINED_VOTERS = 160
MIN_PRECISION = 0.8
FEATURES = 4096
EM_ROUNDS = 25
LABEL_ACCURACY = 0.97
FIT_ROUNDS = 300
#: A fixed list of common English insults; the label model decides what each is worth.
LEXICON = ("clown", "coward", "creep", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "liar", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless")

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Runs of about ``SLICE`` bytes of whole texts; a longer text is cut at spaces, every cut keeping its owner."""
    owners: list[int] = []
    parts: list[bytes] = []
    total = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            end = len(text)
            if end - at > SLICE:
                space = text.find(b" ", at + SLICE)
                end = space if space >= 0 else end
            owners.append(i)
            parts.append(text[at:end])
            total += end - at
            at = end + (end == 0)
            if total >= SLICE:
                yield owners, parts
                owners, parts, total = [], [], 0
    if parts:
        yield owners, parts


def terms(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(owner, term hash)`` for every word and word beginning, repeats included."""
    for owners, parts in _pieces(texts):
        raw = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
        raw = wordhash._LOWER[raw]
        # capital Latin-1 letters, two bytes in UTF-8, become small
        latin = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        raw[latin] += 0x20
        inside = np.concatenate(([0], _WORD_BYTE[raw].astype(np.int8), [0]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = edges[0::2], edges[1::2]
        up, down = wordhash._power_table(len(raw))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(wordhash._BYTE[raw] * up[: len(raw)], dtype=np.uint64)))
        owner = np.asarray(owners)[np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), begins, side="right")]
        out_owner, out = [owner], [mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))]
        for n in BEGINNINGS:
            longer = ends - begins > n
            b = begins[longer]
            out_owner.append(owner[longer])
            out.append(mix((sums[b + n] - sums[b]) * down[b] + np.uint64(n * 0x1F123BB5)))
        yield np.concatenate(out_owner), np.concatenate(out)


def patterns(text: bytes) -> tuple[bool, bool]:
    """Shouting: over a third of the letters are capital.  Exclamation: over one mark in 60 bytes."""
    raw = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, lower = raw[65:91].sum(), raw[97:123].sum()
    return bool(upper * 3 > upper + lower + 30), bool(raw[33] * 60 > len(text) + 60)


@dataclass
class LabelModel:
    """Class rate, firing rates by class (rows: clean, toxic) and the weight left to each correlated voter.

    A voter that does not fire abstains and is no evidence; silence of all term
    voters is a voter of its own.
    """

    rate: float
    fires: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        evidence = np.log(self.fires[1] / self.fires[0]) * self.weight
        logit = np.log(self.rate / (1 - self.rate)) + votes @ evidence
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_label_model(votes: np.ndarray, start: np.ndarray) -> LabelModel:
    """Expectation maximisation from first beliefs ``start``; correlations are re-estimated every round.

    The last two columns are the label's own votes (toxic, clean); their accuracy
    is given, which keeps the classes from drifting to another meaning.
    """
    n = len(votes)
    belief = start
    for _ in range(EM_ROUNDS):
        toxic, clean = belief.sum(), n - belief.sum()
        fires = np.stack(((1 - belief) @ votes + 0.05, belief @ votes + 0.05)) / (np.array([[clean], [toxic]]) + 0.1)
        fires = np.clip(fires, 1e-5, 1 - 1e-5)
        fires[:, -2:] = [[1 - LABEL_ACCURACY, LABEL_ACCURACY], [LABEL_ACCURACY, 1 - LABEL_ACCURACY]]
        expected = belief[:, None] * fires[1] + (1 - belief)[:, None] * fires[0]
        rest = votes - expected
        cov = rest.T @ rest / n
        sd = np.sqrt(np.diag(cov)) + 1e-9
        rho = np.clip(cov / sd[:, None] / sd, 0, 1)
        np.fill_diagonal(rho, 0)
        rho[rho < 0.1] = 0
        weight = 1 / (1 + rho.sum(axis=1))
        weight[-2:] = 1
        model = LabelModel(float(np.clip((toxic + 1) / (n + 2), 1e-3, 1 - 1e-3)), fires, weight)
        belief = model.posterior(votes)
    return model


@dataclass
class LinearModel:
    """Sorted term hashes with a weight each, and a bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.mask = np.zeros(1 << 20, dtype=bool)
        self.mask[self.keys >> np.uint64(44)] = True

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, position in ``keys``) pairs."""
        found = [np.empty(0, dtype=np.int64)]
        for owner, h in terms(texts):
            maybe = self.mask[h >> np.uint64(44)]
            owner, h = owner[maybe], h[maybe]
            at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
            same = self.keys[at] == h if len(self.keys) else np.zeros(0, dtype=bool)
            found.append(np.unique(owner[same] * np.int64(len(self.keys)) + at[same]))
        pairs = np.unique(np.concatenate(found))
        return pairs // max(len(self.keys), 1), pairs % max(len(self.keys), 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        owner, at = self.hits(texts)
        logit = self.bias + np.bincount(owner, self.weights[at], len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _lexicon_keys() -> np.ndarray:
    out = []
    for word in LEXICON:
        _, h = next(terms([word.encode()]))
        out.append(h[0])
    return np.sort(np.array(out, dtype=np.uint64))


def _fit_linear(rows: np.ndarray, cols: np.ndarray, n: int, keys: np.ndarray, target: np.ndarray) -> LinearModel:
    """Logistic regression on binary features, weights of 0 or more, by gradient steps with per-weight scaling."""
    w, bias = np.zeros(len(keys)), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    gw, gb = np.full(len(keys), 1e-4), 1e-4
    for _ in range(FIT_ROUNDS):
        logit = bias + np.bincount(rows, w[cols], n)
        error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target
        grad = np.bincount(cols, error[rows], len(keys)) + 0.05 * w
        gw += grad * grad
        w = np.maximum(w - 0.5 * grad / np.sqrt(gw), 0)
        gb += error.sum() ** 2
        bias -= 0.5 * error.sum() / gb**0.5
    return LinearModel(keys, w, float(bias))


def fit_toxicity(texts: list[bytes], labels: np.ndarray) -> LinearModel:
    """Mine voters, fit the label model, train the classifier on its posterior labels."""
    lexicon = _lexicon_keys()
    if not len(texts) or not labels.any():
        return LinearModel(lexicon, np.full(len(lexicon), 45.0), -40.0)
    n, pairs = len(texts), []
    for at in range(0, n, 512):
        for owner, h in terms(texts[at : at + 512]):
            toxic = labels[owner + at] > 0
            pairs.append((owner[toxic] + at, h[toxic]))
    own, h = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((own, h))
    own, h = own[order], h[order]
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])))
    keys, in_toxic = np.unique(h[fresh], return_counts=True)
    keep = in_toxic >= 3
    keys, in_toxic = keys[keep], in_toxic[keep]
    both = np.union1d(keys, lexicon)
    seen = LinearModel(both, np.zeros(len(both)), 0.0)
    rows, cols = [], []
    for at in range(0, n, 512):
        r, c = seen.hits(texts[at : at + 512])
        rows.append(r + at)
        cols.append(c)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    toxic = np.bincount(cols, labels[rows], len(both))
    total = np.bincount(cols, minlength=len(both)).astype(float)
    base = labels.mean()
    gain = np.log((toxic + 0.5) / (total + 1)) - np.log((toxic.sum() + 1) / (total.sum() + 2))
    value = np.where(toxic / np.maximum(total, 1) >= max(MIN_PRECISION, min(0.95, 3 * base)), gain * toxic, -1.0)
    mined = np.argsort(-value, kind="stable")[:MINED_VOTERS]
    voters = np.unique(np.concatenate((mined[value[mined] > 0], np.searchsorted(both, lexicon))))
    place = np.full(len(both), -1)
    place[voters] = np.arange(len(voters))
    votes = np.zeros((n, len(voters) + 5))
    used = place[cols] >= 0
    votes[rows[used], place[cols[used]]] = 1
    votes[:, -5] = ~votes.any(axis=1)
    votes[:, -4:-2] = [patterns(t) for t in texts]
    votes[:, -2], votes[:, -1] = labels, 1 - labels
    posterior = fit_label_model(votes, np.clip(labels, 0.02, 0.98)).posterior(votes)
    # features: the terms that speak most for the toxic class; common terms would add up to "clean" in long texts
    weight = np.bincount(cols, posterior[rows], len(both))
    lift = (weight + 0.5) / (posterior.sum() + 1) / ((total - weight + 0.5) / (n - posterior.sum() + 1))
    value = np.where(lift > 1.5, np.log(lift) * np.sqrt(weight), -1.0)
    best = np.argsort(-value, kind="stable")[:FEATURES]
    best = np.unique(np.concatenate((best[value[best] > 0], voters)))
    slot = np.full(len(both), -1)
    slot[best] = np.arange(len(best))
    used = slot[cols] >= 0
    return _fit_linear(rows[used], slot[cols[used]], n, both[best], posterior)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``."""
    known = training_rows(docs, labels, "toxic", TRAIN_ROWS, TRAIN_BYTES, HOLD_MOD, HOLD_REST).toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    texts = utf8(known.column("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(texts, np.array(known.column("label").to_pylist(), dtype=float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear = model.value
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(linear.scores(utf8(batch.column("text"))), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = map_arrow(rows, run, "doc_id long, score double")
    return scored.select("doc_id", _held_out(HOLD_MOD, HOLD_REST).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
