import re
import zlib

import numpy as np
import pytest

from larkspur.llm.quality import BINS, FACTORS, FactorisationMachine, N_FEATURES, N_STATS, WORD_BITS, features, quality_scores, structure
from larkspur.llm.toxicity import BEGINNINGS, fit_label_model, fit_toxicity, patterns, terms, toxicity_scores
from larkspur.llm.wordhash import word_hashes

BIG = "/root/testdata/sf0.1"


def auc(label, score):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    n = label.sum()
    return (order[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize("run, label, mod, rest, least", [(quality_scores, "quality", 3, 1, 0.98), (toxicity_scores, "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(spark, run, label, mod, rest, least):
    docs, labels = (spark.read.parquet(f"{BIG}/{n}.parquet") for n in ("documents", "labels"))
    got = run(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % mod == rest for i in got.doc_id]).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    both = both[both.held_out]
    assert auc(both[label].to_numpy(), both.score.to_numpy()) > least
    assert ((both.predicted == both[label]).mean()) > 0.95


@pytest.mark.parametrize("run", [quality_scores, toxicity_scores])
def test_odd_rows(spark, run, odd, odd_rows, empty, labels):
    assert len(run(odd, labels).collect()) == len(odd_rows)
    none = labels.filter("false")
    rows = run(odd, none).collect()
    assert {r.predicted for r in rows} == ({1} if run is quality_scores else {0})
    assert all(r.held_out is False for r in rows if r.doc_id is None)
    assert run(empty, labels).collect() == []
    odd_labels = spark.createDataFrame([(7, None, None), (8, 1, 1), (None, 0, 0), (9, 5, 5)], "doc_id long, quality int, toxic int")
    assert len(run(odd, odd_labels).collect()) == len(odd_rows)


def test_labels_of_the_held_out_fold_are_not_used(spark, docs, labels):
    from pyspark.sql import functions as F

    for run, name, mod, rest in ((quality_scores, "quality", 3, 1), (toxicity_scores, "toxic", 5, 0)):
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest
        flipped = labels.withColumn(name, F.when(held, 1 - F.col(name)).otherwise(F.col(name)))
        one, two = ({r.doc_id: r.score for r in run(docs, x).collect()} for x in (labels, flipped))
        assert one == two


def test_pairwise_term_is_the_sum_over_pairs():
    fm = FactorisationMachine()
    rng = np.random.default_rng(0)
    fm.w, fm.v = rng.normal(size=N_FEATURES), rng.normal(size=(N_FEATURES, FACTORS))
    (f,) = features([b"some words and more words"])
    x = np.concatenate((np.ones(N_STATS), np.full(len(f) - N_STATS, 1 / np.sqrt(len(f) - N_STATS))))
    want = fm.bias + (fm.w[f] * x).sum() + sum(fm.v[f[i]] @ fm.v[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i))
    assert fm.raw([f])[0] == pytest.approx(want)


def test_label_model_finds_accuracies_and_discounts_copies():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.3).astype(float)
    good = lambda p, q: (rng.random(4000) < np.where(y > 0, p, q)).astype(float)
    noisy = good(0.5, 0.1)
    votes = np.stack([good(0.6, 0.01), good(0.5, 0.02), noisy, noisy, noisy, y, 1 - y], axis=1)
    model = fit_label_model(votes, np.clip(y, 0.02, 0.98))
    assert model.fires[1, 0] == pytest.approx(0.6, abs=0.06) and model.fires[0, 0] < 0.03
    assert model.weight[2] < 0.5 < model.weight[0]
    assert ((model.posterior(votes) > 0.5) == (y > 0)).mean() > 0.97


def test_terms_fold_case_and_have_beginnings():
    (a,), (b,) = (list(terms([x])) for x in ("ÉCLAIRS".encode(), "éclairs".encode()))
    assert a[1].tolist() == b[1].tolist() and len(a[1]) == 4
    assert list(patterns(b"STOP SHOUTING " * 20)) == [True, False] and patterns(b"no! no! no! " * 30)[1]


def test_lexicon_alone_and_mined_words():
    texts = [f"plain words number {i} and more".encode() for i in range(60)] + [f"you zorgish thing number {i}".encode() for i in range(20)]
    model = fit_toxicity(texts, np.array([0.0] * 60 + [1.0] * 20))
    assert (model.scores([b"a zorgish one", b"plain text"]) > 0.5).tolist() == [True, False]
    assert (fit_toxicity([], np.zeros(0)).scores([b"what an Idiot!", b"nothing", b""]) > 0.5).tolist() == [True, False, False]


def training(docs, labels, name, mod, rest):
    """Texts and labels of the rows that may train, in the order of the fits."""
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = sorted((r.doc_id, r[name]) for r in labels.collect() if r.doc_id in text and r[name] in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % mod != rest)
    return text, [text[i] for i, _ in rows], np.array([y for _, y in rows], dtype=float)


def test_toxicity_of_every_row_is_recomputed_word_by_word(spark, docs, labels):
    text, texts, y = training(docs, labels, "toxic", 5, 0)
    model = fit_toxicity(texts, y)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    known = {}

    def hashes(word):
        if word not in known:
            ((_, h),) = terms([word])
            assert len(h) == 1 + sum(len(word) > n for n in BEGINNINGS)
            known[word] = set(h.tolist())
        return known[word]

    got = {r.doc_id: r.score for r in toxicity_scores(docs, labels).collect()}
    assert got.keys() == text.keys()
    for doc, raw in text.items():
        found = set().union(*(hashes(w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)))
        logit = model.bias + sum(weight.get(h, 0.0) for h in found)
        assert got[doc] == pytest.approx(1 / (1 + np.exp(-np.clip(logit, -40, 40))), abs=1e-9)


def test_quality_of_every_row_is_recomputed_pair_by_pair(spark, docs, labels):
    text, texts, y = training(docs, labels, "quality", 3, 1)

    def naive(raw):
        h = np.array([word_hashes(w, lower=True)[0] for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)], dtype=np.uint64)
        stats = structure(raw, h)
        bins = [0 if s <= 0 else 1 + min(int(np.sqrt(min(s, 1)) * BINS), BINS - 1) for s in stats]
        return np.array([(1 << WORD_BITS) + i * (BINS + 1) + b for i, b in enumerate(bins)] + [int(x) >> (64 - WORD_BITS) for x in h], dtype=np.int64)

    fm = FactorisationMachine().fit([naive(t) for t in texts], y)
    got = {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
    assert got.keys() == text.keys()
    for doc, raw in text.items():
        f = naive(raw)
        x = np.concatenate((np.ones(N_STATS), np.full(len(f) - N_STATS, 1 / np.sqrt(max(len(f) - N_STATS, 1)))))
        v = fm.v[f] * x[:, None]
        # every pair, a block of rows against all after it
        pairs = sum(float(np.triu(v[at : at + 512] @ v.T, at + 1).sum()) for at in range(0, len(f), 512))
        raw_score = fm.bias + float((fm.w[f] * x).sum()) + pairs
        assert got[doc] == pytest.approx(1 / (1 + np.exp(-np.clip(raw_score, -30, 30))), abs=1e-6)
