"""A training-corpus pipeline: five operators, each working on what the one before it kept.

Defined results, for every stage: a null text counts as empty, and a document
that was empty from the start is kept unless the quality classifier rejects it;
texts of any length are worked on whole; an empty table gives no rows; the
columns of the input come back under their names and unchanged, whatever they
are called, but for ``text`` where lines are cut.

* quality: rows that the classifier scores below 0.5 go; repeated rows score alike.
* line_dedup: boilerplate lines go from all places but the first; a document that
  lost all its words goes.  Repeated rows (same id and text) lose the same lines.
* near_dedup: one row of each near-duplicate component stays, that of the least
  ``doc_id``; of rows that share that id, which names one document, one stays.
  Rows without an id can't be named as copies and all stay.
* source_mix: a document is emitted as often as the mix takes it, at most twice.
* bpe: returns ``doc_id, source, n_tokens, ids, decoded_sha256`` for every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm.bpe import bpe_encode
from larkspur.llm.line_dedup import without_boilerplate
from larkspur.llm.mixing import mixed_documents
from larkspur.llm.near_dedup import one_of_each
from larkspur.llm.quality import good_documents
from larkspur.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines; a document that lost all its words goes."""
    return without_boilerplate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target weights."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix, with the decoded text's digest."""
    coded = bpe_encode(docs.select("doc_id", "text", "source"), decode=True)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("source_mix", mix), ("bpe", tokens)]

#: Hash draws, learned scores and BPE merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, name)
    return docs
