from collections import Counter, defaultdict
import zlib

import pytest

from larkspur.llm import line_dedup, sharding
from larkspur.llm.line_dedup import remove_boilerplate
from larkspur.llm.mixing import mix_counts, mixed_documents
from larkspur.llm.sharding import shard_rows


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), list(names)
    while True:
        total = sum(weight[n] for n in open_)
        over = [n for n in open_ if left * weight[n] / total > cap * sizes[n] + 1e-9]
        if not over:
            return target | {n: left * weight[n] / total for n in open_}
        for n in over:
            target[n] = cap * sizes[n]
            open_.remove(n)
        left -= sum(target[n] for n in over)


def check_mix(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    want = brute_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1


def test_mix_targets(docs):
    check_mix(mix_counts(docs).collect())


def test_mix_repeats_and_is_seeded(docs):
    one, two = ({r.doc_id: r.copies for r in mix_counts(d).collect()} for d in (docs, docs.repartition(7)))
    assert one == two and one != {r.doc_id: r.copies for r in mix_counts(docs, seed="other").collect()}
    assert Counter(r.doc_id for r in mixed_documents(docs).collect()) == +Counter(one)
    assert mixed_documents(docs).columns == docs.columns


def test_mix_odd_rows(odd, odd_rows, empty):
    rows = mix_counts(odd).collect()
    assert len(rows) == len(odd_rows) and rows[0].node == "clash"
    by = {r.doc_id: r for r in rows}
    assert by[0].size == by[2].size == 0 and by[4].size == 4
    assert len({r.copies for r in rows if r.doc_id == 13}) == 1
    assert mix_counts(empty).collect() == []


def test_wordless_documents_are_not_repeated_beyond_the_cap(spark):
    """One source is capped at two epochs and has wordless documents, which stand wherever the sample is cut."""
    rows = [(i, "" if i % 2 else "a b c", "small") for i in range(100)] + [(1000 + i, "w " * 40 if i % 3 else None, "large") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_counts(df).collect()
    check_mix(got)
    assert {r.copies for r in got if r.source == "large"} <= {0, 1, 2}
    assert {r.copies for r in got if r.source == "small"} == {2}
    assert max(Counter(r.doc_id for r in mixed_documents(df).collect()).values()) == 2


def test_other_settings(docs):
    rows = mix_counts(docs, share=5.0, max_epochs=2.0).collect()
    assert all(r.taken == 2 * r.size for r in rows)


def test_shards(docs):
    rows = shard_rows(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    slots = defaultdict(list)
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even_and_move_little(spark):
    rows = shard_rows(spark.range(20_000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")).collect()
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) < 1.25 * 500 and min(counts.values()) > 0.75 * 500
    moved = sum(r.shard != r.grown_shard for r in rows)
    assert abs(moved - 20_000 / 41) < 100


def test_growth_inside_a_region_stays_in_its_subtree(spark):
    ids = spark.range(5000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    rows = shard_rows(ids, shards=12).collect()
    assert all(r.shard == r.grown_shard or r.grown_shard >= 10 for r in rows)


def test_shards_of_hot_ids_and_equal_rows(spark, monkeypatch):
    """A third of the rows under one id, a third equal in everything: slots stay gapless, no row is lost."""
    monkeypatch.setattr(sharding, "CHUNK", 7)
    rows = [(5, f"text {i}") for i in range(400)] + [(6, "same")] * 400 + [(i, "x") for i in range(100, 500)] + [(None, "same")] * 50
    rows = [*rows, *((None, f"t{i}") for i in range(50))]
    got = shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t) + 16, zlib.crc32(t.encode())) for i, t in rows)
    assert all(len({r.shard for r in got if r.doc_id == i}) == 1 for i in (5, 6))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_odd_rows(odd, odd_rows, empty):
    rows = shard_rows(odd).collect()
    assert len(rows) == len(odd_rows) and len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert next(r for r in rows if r.doc_id == 0).size == 16
    assert len({r.shard for r in rows if r.doc_id == 13}) == 1
    assert shard_rows(empty).collect() == []


def brute_lines(rows, sites):
    spread, first = defaultdict(set), {}
    for doc, text, site in rows:
        for i, line in enumerate(text.split("\n")):
            if key := line.strip(" "):
                spread[key].add(site)
                first[key] = min(first.get(key, (doc, i)), (doc, i))
    gone = {k for k, s in spread.items() if len(s) >= sites}
    return {doc: "\n".join(x for i, x in enumerate(text.split("\n")) if x.strip(" ") not in gone or first[x.strip(" ")] == (doc, i)) for doc, text, site in rows}


@pytest.mark.parametrize("sites", [2, 3, 5])
def test_lines_match_brute_force(docs, sites):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = {r.doc_id: r.text for r in remove_boilerplate(docs, min_sites=sites).collect()}
    assert got == brute_lines(rows, sites)


def test_many_sites_near_the_threshold(spark):
    """Sketches that estimate: lines on 290 to 310 sites, threshold 300."""
    rows = [(i * 1000 + s, f"line {i}\nown {i} {s}", f"site{s}") for i in range(20) for s in range(290 + i)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in remove_boilerplate(df, min_sites=300).collect()}
    assert got == brute_lines(rows, 300)
    assert line_dedup.BAND * 300 > 3 * 1.04 / 64 * 300 - 1


def test_line_odd_rows(odd, odd_rows, empty):
    rows = remove_boilerplate(odd, min_sites=2).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows}
    assert by[0].text is None and by[0].n_lines == 0 and by[1].text == "" and by[2].text == " \t\n "
    assert by[7].text and by[8].text == "" and by[8].n_removed == 1
    assert by[14].text == "line one\nline two\n\nline one"
    assert remove_boilerplate(empty).collect() == []
