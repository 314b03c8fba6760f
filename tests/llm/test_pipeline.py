import hashlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from .conftest import SF
from .test_near_dedup import brute


def test_stages_in_order(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "source_mix", "bpe"]
    kept, given = docs, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        assert kept.columns == docs.columns
        given.append(kept)
    quality, lines, near, mix = (x.collect() for x in given[1:])
    assert 0 < len(quality) < docs.count()
    assert {r.doc_id for r in lines} <= {r.doc_id for r in quality}
    parts = brute([(r.doc_id, r.text) for r in lines])
    assert {r.doc_id for r in near} == {i for i, (_, c) in parts.items() if i == c}
    assert {r.doc_id for r in mix} <= {r.doc_id for r in near}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mix)
    text = {r.doc_id: r.text for r in mix}
    for r in out:
        assert list(r.ids) == t.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_odd_rows_go_through(spark, odd_rows, labels, tmp_path):
    from .conftest import SCHEMA

    spark.createDataFrame(odd_rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert r.n_tokens == len(r.ids)


def test_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
