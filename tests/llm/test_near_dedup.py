import random
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest

from larkspur.llm import near_dedup
from larkspur.llm.near_dedup import near_duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def test_matches_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_families_of_copies_and_common_passages(spark, monkeypatch):
    """Nodes far beyond a leaf: chains of near copies, and a passage that most texts share."""
    monkeypatch.setattr(near_dedup, "LEAF", 16)
    rng = random.Random(9)
    text = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    common = text(40)
    rows = []
    for _ in range(4):
        base = text(150)
        rows += [edited(rng, base, rng.choice((0.002, 0.01, 0.03, 0.06))) for _ in range(40)]
    rows += [f"{text(30)} {common} {text(30)}" for _ in range(120)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_a_large_family_stays_linear(spark, monkeypatch):
    """One family of near copies in many leaves' worth of rows: what the leaves compare grows with it, not with its square."""
    monkeypatch.setattr(near_dedup, "LEAF", 64)
    compared = []
    whole = near_dedup._in_blocks

    def counting(members, *columns):
        grouped = whole(members, *columns)
        compared.append(grouped.selectExpr("coalesce(sum(size(ms)), 0)").first()[0])
        return grouped

    monkeypatch.setattr(near_dedup, "_in_blocks", counting)
    rng = random.Random(3)
    base = " ".join(f"v{rng.randrange(5000)}" for _ in range(120))
    n = 3000
    rows = [(i, edited(rng, base, 0.004)) for i in range(n)] + [(n + i, " ".join(f"u{rng.randrange(9000)}" for _ in range(60))) for i in range(300)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == 0 for i in range(n)) > 0.99 * n and all(got[i] == i for i in range(n, n + 300))
    distinct = len({t for _, t in rows})
    assert distinct > n / 3 and sum(compared) < 40 * 10 * distinct / 4


def test_a_family_that_fades_out_stays_linear(spark, monkeypatch):
    """Copies of one page with few to many edits: those too far from all others meet no more than their likes."""
    monkeypatch.setattr(near_dedup, "LEAF", 64)
    made = []
    whole = near_dedup._in_blocks

    def counting(members, *columns):
        made.append(members.selectExpr("coalesce(sum(chunks + if(minor, blocks - 1, 0)), 0)").first()[0])
        return whole(members, *columns)

    monkeypatch.setattr(near_dedup, "_in_blocks", counting)
    rng = random.Random(4)
    base = " ".join(f"v{rng.randrange(5000)}" for _ in range(120))
    rows = [(i, edited(rng, base, rng.uniform(0, 0.12))) for i in range(1200)]
    # links that only rare shingles show: far from the page, near one another
    rows += [(1200 + 3 * i + j, edited(rng, far, 0.01)) for i, far in enumerate(edited(rng, base, 0.15) for _ in range(20)) for j in range(3)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert len(set(got.values())) > 200 and sum(made[1:]) < 10 * len(rows)


def test_odd_rows(odd, odd_rows):
    got = near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(by[i][0].n_shingles == 0 and by[i][0].component_id == i and by[i][0].kept for i in (0, 1, 2))
    assert by[3][0].n_shingles == 1 and by[5][0].component_id == 4 and not by[5][0].kept
    assert {r.component_id for i in (7, 8, 9, 10, 13) for r in by[i]} == {7} and len(by[13]) == 2
    assert all(r.component_id is None and r.kept for r in by[None])
    assert by[11][0].n_shingles > 290_000


def test_empty(empty):
    assert near_duplicates(empty).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    b = np.unique(np.concatenate((a[:3500], rng.integers(0, 1 << 63, 500).astype(np.uint64))))
    same = (near_dedup.signature(a, 256) == near_dedup.signature(b, 256)).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12


LARGER = Path("/root/testdata/sf0.1/documents.parquet")


@pytest.mark.skipif(not LARGER.exists(), reason="needs the larger table")
def test_no_link_of_the_larger_table_is_lost(spark):
    got = near_duplicates(spark.read.parquet(str(LARGER)).select("doc_id", "text")).toPandas().set_index("doc_id").component_id.to_dict()
    with duckdb.connect() as c:
        words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
        c.execute(f"CREATE TABLE d AS SELECT doc_id, {words} AS ws FROM '{LARGER}'")
        c.execute("CREATE TABLE s AS SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' ')) AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)")
        c.execute("CREATE TABLE n AS SELECT doc_id, count(*) AS n, sum(g) AS h FROM s GROUP BY doc_id")
        c.execute("CREATE TABLE r AS SELECT min(doc_id) AS doc_id, n, h FROM n GROUP BY n, h")
        c.execute("CREATE TABLE o AS SELECT s.* FROM s JOIN r USING (doc_id)")
        shared = "SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM o a JOIN o b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL"
        links = c.execute(f"SELECT u, v FROM ({shared}) JOIN r x ON u = x.doc_id JOIN r y ON v = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)").fetchall()
        copies = c.execute("SELECT r.doc_id, n.doc_id FROM n JOIN r USING (n, h) WHERE n.doc_id <> r.doc_id").fetchall()
    parent = {i: i for i in got}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links + copies:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert len(links) > 100
    assert got == {i: find(i) for i in got}
