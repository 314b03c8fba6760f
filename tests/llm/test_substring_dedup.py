import random
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import substring_dedup
from larkspur.llm.substring_dedup import remove_repeats


def brute(rows):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[p : p + 35]) for _, w in split for p in range(len(w) - 34))
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - 34):
            if count[tuple(w[p : p + 35])] > 1:
                gone.update(range(p, p + 35))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in remove_repeats(df).collect()), key=str)


def test_planted_repeats(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(30000)}"
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 90, 200)]
    rows = []
    for i in range(80):
        text = [word() for _ in range(rng.randrange(80))]
        for p in rng.sample(passages, rng.randrange(3)):
            b = rng.randrange(0, max(1, len(p) - 34))
            text += p[b : b + rng.randrange(30, 100)] + [word() for _ in range(rng.randrange(20))]
        rows.append((i, " ".join(text)))
    rows += [(100, " ".join(passages[3] * 3)), (101, "a " * 500), (102, "a b c " * 40), (103, rows[5][1]), (103, rows[5][1])]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("bits", [1, 4])
def test_colliding_hashes_change_nothing(spark, bits):
    """k-mers of two or sixteen hashes: what decides are the words at the source coordinates."""
    rng = random.Random(6)
    common = [f"w{rng.randrange(9000)}" for _ in range(120)]
    rows = []
    for i in range(30):
        at = rng.randrange(60)
        rows.append((i, " ".join([f"u{i}-{j}" for j in range(rng.randrange(50))] + common[at : at + 60] + [f"v{i}-{j}" for j in range(rng.randrange(40))])))
    rows += [(40, rows[3][1]), (40, rows[3][1]), (41, "x y " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in remove_repeats(df, bits=bits).collect()), key=str) == brute(rows)


def test_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(odd, odd_rows, empty):
    got = sorted((tuple(r) for r in remove_repeats(odd).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in odd_rows])
    assert remove_repeats(empty).collect() == []


def test_segments_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENT", 200)
    rng = random.Random(4)
    base = [f"w{rng.randrange(9000)}" for _ in range(1500)]
    rows = [(0, " ".join(base)), (1, " ".join(["x"] * 57 + base[300:900])), (2, " ".join(base[17:400]))]
    assert run(spark, rows) == brute(rows)


def test_equal_windows_share_an_anchor():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    both = np.concatenate((words[:50], words[100:200]))
    here = {(int(a), int(f) + i - int(f)) for a, f, n in zip(*substring_dedup.paths(words), strict=True) for i in range(n)}
    covered = {}
    for a, f, n in zip(*substring_dedup.paths(words), strict=True):
        covered |= {int(f) + i: int(a) for i in range(n)}
    for a, f, n in zip(*substring_dedup.paths(both), strict=True):
        for p in range(int(f), int(f) + n):
            if p >= 50:
                assert covered[p + 50] == int(a)
    assert here
