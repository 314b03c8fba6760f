"""Every operator and stage with every name that the subpackage gives a column, as a column of the input."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import larkspur.llm
from larkspur.llm import bpe, imatch, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, topk_ip, toxicity

from .conftest import SF

SOURCES = [*Path(larkspur.llm.__file__).parent.glob("*.py")]
NAMES = sorted({n.lower() for p in SOURCES for n in re.findall(r"""(?:alias|withColumn|withColumnRenamed|AS|lit)\(?\s*"?(\w+)"?""", p.read_text())} | {"in_0", "_id", "_text", "_gone", "_draw", "whole", "until", "_source", "_copy"})
GIVEN = {"doc_id", "text", "source", "lang", "n_chars", "vec_id", "embedding"}
ROWS = [(1, "one two three four five six\nshared line", "a"), (2, "one two three four five six\nshared line", "b"), (2, None, None), (None, "", "c"), (3, "words " * 50, "a")]


@pytest.fixture(scope="module")
def crowded(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.select("*", *(F.lit(f"user {n}").alias(n) for n in NAMES if n not in GIVEN))


def checked(df, own=()):
    """The rows, once the input's own columns are found unchanged."""
    rows = df.collect()
    for r in rows:
        assert all(r[n] == f"user {n}" for n in df.columns if n in NAMES and n not in GIVEN and n not in own)
    return rows


def test_names_are_found():
    assert len(NAMES) > 150 and {"size", "label", "node", "target", "gone", "_salt", "_salts"} <= set(NAMES)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, crowded, name, stage):
    out = stage(spark, crowded, SF)
    if name != "bpe":
        assert out.columns == crowded.columns
        rows = checked(out)
    else:
        rows = out.collect()
        assert out.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"]
    assert rows


@pytest.mark.parametrize("run, own", [
    (mixing.mix_counts, mixing.OUTPUTS), (mixing.mixed_documents, ()), (line_dedup.remove_boilerplate, ("n_lines", "n_removed")),
    (lambda d: line_dedup.without_boilerplate(d, min_sites=2), ()), (lambda d: bpe.bpe_encode(d, decode=True), ("ids", "decoded")), (near_dedup.one_of_each, ()),
])
def test_operators_that_carry_columns(crowded, run, own):
    out = run(crowded)
    assert checked(out, own) and set(out.columns) >= set(crowded.columns)


@pytest.mark.parametrize("run", [near_dedup.near_duplicates, substring_dedup.remove_repeats, imatch.fingerprints, sharding.shard_rows])
def test_operators_that_ignore_columns(crowded, run):
    assert len(run(crowded).collect()) == len(ROWS)


@pytest.mark.parametrize("run", [quality.quality_scores, toxicity.toxicity_scores])
def test_classifiers(crowded, labels, run):
    assert len(run(crowded, labels.withColumn("_turn", F.lit(1))).collect()) == len(ROWS)


def test_search(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 0.5]), (21, [0.1, 0.1])], "vec_id long, embedding array<double>")
    df = df.select("*", *(F.lit(f"user {n}").alias(n) for n in NAMES if n not in GIVEN))
    assert len(topk_ip.top_k(df).collect()) == 4


def test_one_row_of_a_repeated_id_stays(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "x y"), (None, "x y"), (None, "x y")]
    got = near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "x y"), (0, "x y"), (1, "a b c d e f"), (3, "x y")]
