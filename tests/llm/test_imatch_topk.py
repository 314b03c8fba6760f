import hashlib
import math

import numpy as np
import pytest

from larkspur.llm import imatch, topk_ip
from larkspur.llm.imatch import fingerprints
from larkspur.llm.topk_ip import Best, search_block, top_k


def check_fingerprints(rows, df):
    got = df.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    order = sorted(rows, key=lambda r: -r[0])
    same = {}
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        r = by[doc]
        assert r.n_chars == len(text) and r.edited == text[: len(text) - half] + after[:half]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        same.setdefault(text, set()).add(r.fingerprint)
        same.setdefault(r.edited, set()).add(r.edited_fingerprint)
        if text == after:
            assert r.near_next == 1
    assert all(len(s) == 1 for s in same.values())
    return got


@pytest.mark.parametrize("bucket", [7, 2000])
def test_documents(docs, monkeypatch, bucket):
    monkeypatch.setattr(imatch, "ROWS_PER_BUCKET", bucket)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = check_fingerprints(rows, fingerprints(docs))
    assert np.mean([r.near_edited for r in got]) > 0.02 + np.mean([r.near_next for r in got])


def test_ids_that_fill_buckets(spark, monkeypatch):
    """A third of the rows without an id and a third under one id: their order is that of the text hash."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(imatch, "ROWS_PER_BUCKET", 20)
    rows = [(None, f"n{i} x") for i in range(120)] + [(50, f"m{i} y") for i in range(120)] + [(i, f"o{i} z") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = df.withColumn("text_hash", F.xxhash64("text")).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text_hash))
    after = {(r.doc_id, r.text): order[(i + 1) % len(order)].text for i, r in enumerate(order)}
    got = fingerprints(df).collect()
    assert sorted(r.edited for r in got) == sorted(t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (_, t), n in after.items())


def test_fingerprint_against_plain_python(spark, docs):
    """The lexicon band and the subset rule, recomputed from Spark's own term hashes."""
    from pyspark.sql import functions as F

    texts = docs.select("doc_id", "text")
    hashes = {r.w: r.h for r in texts.select(F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("w")).distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    sets = {r.doc_id: {hashes[w] for w in r.text.lower().split() if w in hashes} for r in texts.collect()}
    slot = lambda h: (h & (1 << 64) - 1) >> 44
    count = {}
    for s in sets.values():
        for x in {slot(h) for h in s}:
            count[x] = count.get(x, 0) + 1
    n = len(sets)
    band = {x for x, c in count.items() if imatch.LOW * n <= c <= max(imatch.HIGH * n, 2)}
    used = {r.doc_id: r.fingerprint.split(".") for r in fingerprints(docs).collect()}
    for doc, s in sets.items():
        inside = [h for h in s if slot(h) in band]
        have, at = [True], 1
        for first, bits, subsets in imatch.FIELDS:
            have += [any((h >> first) & ((1 << bits) - 1) == v for h in inside) for v in range(subsets)]
            at += subsets
        assert [x != "-" for x in used[doc]] == have


def test_odd_rows(odd, odd_rows, empty, spark):
    got = fingerprints(odd).collect()
    assert len(got) == len(odd_rows)
    assert {r.n_chars for r in got if r.doc_id in (0, 1)} == {0}
    assert fingerprints(empty).collect() == []
    (one,) = fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert one.edited == "abab" and one.near_next == 1


def test_hash_of_the_query_is_of_the_edited_text(spark):
    from .conftest import SF

    (r,) = imatch.op7_imatch(spark, SF).orderBy("doc_id").limit(1).collect()
    edited = fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).filter(f"doc_id = {r.doc_id}").first().edited
    assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def brute_top(rows, k, every):
    sound = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in sound:
        if q % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in sound if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def vectors(seed, n, d, scale=1.0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)) * rng.exponential(scale, size=(n, 1))
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize("block, queries, step", [(4096, 512, 1024), (16, 3, 4)])
def test_exact(spark, monkeypatch, block, queries, step):
    for name, value in (("BLOCK", block), ("QUERIES", queries), ("STEP", step)):
        monkeypatch.setattr(topk_ip, name, value)
    rows = vectors(1, 150, 12)
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(300, [0.0] * 12), (301, None), (302, [None] * 12), (303, [float("nan")] + [1.0] * 11), (304, [float("inf")] * 12), (None, [1.0] * 12), (305, [1.0] * 5)]
    got = {tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=7, every=5).collect()}
    assert got == brute_top(rows, 7, 5)


def test_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    rows = vectors(2, 6, 4)
    assert {tuple(r) for r in top_k(spark.createDataFrame(rows, kind)).collect()} == brute_top(rows, 20, 20)
    assert top_k(spark.createDataFrame([], kind)).collect() == []
    assert top_k(spark.createDataFrame([(3, [1.0])], kind)).collect() == []
    assert top_k(spark.createDataFrame([(0, [1.0])], kind)).collect() == []


def test_bounds_prune(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(3000, 32)) * np.geomspace(1, 0.02, 32) * rng.exponential(1, (3000, 1)) * 640).astype(np.int64)
    rotation = np.linalg.svd(v.T.astype(float) @ v)[0]
    q = v[:50]
    best = Best(np.arange(50), 20)
    scored = search_block(best, q, np.arange(3000), v, rotation)
    assert scored < 0.6 * 50 * 3000
    for i in range(50):
        s = v @ q[i]
        s[i] = np.iinfo(np.int64).min
        assert best.scores[i].tolist() == sorted(s.tolist(), reverse=True)[:20]


def test_strong_queries_open_few_blocks(spark, monkeypatch):
    """Long vectors decide most queries: blocks of short ones are opened for the few queries that point elsewhere."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(topk_ip, "BLOCK", 64)
    monkeypatch.setattr(topk_ip, "QUERIES", 16)
    long = np.abs(rng.normal(size=(64, 8))) * 20
    short = rng.normal(size=(2500, 8)) * 0.5
    short[::20] = np.abs(short[::20])
    short[40] = -np.abs(short[40])
    every = np.concatenate((short, long))
    rows = [(i, v.tolist()) for i, v in enumerate(every)]
    opened = []
    real = topk_ip.map_arrow

    def counting(df, run, schema):
        if "qvectors" in df.columns:
            opened.append(df.count())
        return real(df, run, schema)

    monkeypatch.setattr(topk_ip, "map_arrow", counting)
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    grid = np.floor(64 * every).astype(np.int64)
    scores = grid @ grid.T
    want = {(q, rank, int(i), int(scores[q, i])) for q in range(0, len(every), 20) for rank, i in enumerate(sorted((i for i in range(len(every)) if i != q), key=lambda i: (-scores[q, i], i))[:20], 1)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    queries, blocks = -(-len(every) // 20) // 16 + 1, -(-len(every) // 64)
    assert opened[0] < queries * blocks / 3


def test_an_id_with_two_vectors_asks_with_the_least(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 8192), (1, 0)]
