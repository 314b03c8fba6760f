import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm.bpe import ByteBPE, bpe_decode, bpe_encode, op2_bpe

from .conftest import SF


@pytest.fixture(scope="module")
def bpe():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return ByteBPE(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(3)
    alphabet = "ab cdeé ß\n\t\r\x0b\x1c\x1d\x1f\x85 ​　漢字1²½'slt|<>😀́ǅ٣"
    out = ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "it's we'LL 'tis", "a" * 5000, "ab" * 3001, "\0\0"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(1500)]
    return out + ["".join(chr(c) for c in (rng.randrange(0x110000) for _ in range(20)) if not 0xD800 <= c < 0xE000) for _ in range(1000)]


def test_same_ids_and_text_as_the_tokenizers_library(bpe, reference):
    for text, ids, want in zip(texts(), bpe.encode(texts()), reference.encode_batch(texts(), add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids
        assert bpe.decode(ids) == reference.decode(want.ids, skip_special_tokens=False) == text


def test_leftmost_lowest_rank_first(bpe):
    """The tree's merges equal a plain scan for the least rank."""
    rank = {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(r) for k, r in zip(bpe.keys, bpe.ranks, strict=True)}
    rng = random.Random(8)
    for _ in range(300):
        word = bytes(rng.choice(b"etaoinshr .") for _ in range(rng.randrange(1, 40)))
        ids = [int(bpe.byte_id[b]) for b in word]
        while (best := min(((rank.get(p, 1 << 40), i) for i, p in enumerate(zip(ids, ids[1:], strict=False))), default=(1 << 40, 0)))[0] < 1 << 40:
            ids[best[1] : best[1] + 2] = [int(bpe.merged[best[0]])]
        assert np.frombuffer(bpe.merge_words([word])[0], dtype="<i4").tolist() == ids


def test_cache_overflow_changes_nothing(bpe, monkeypatch):
    before = [x.tolist() for x in bpe.encode(texts())]
    monkeypatch.setattr("larkspur.llm.bpe.CACHE_WORDS", 10)
    assert [x.tolist() for x in bpe.encode(texts())] == before


def test_odd_rows(odd, odd_rows, reference):
    got = bpe_decode(bpe_encode(odd.drop("decoded"))).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in got) == sorted((r[0] or -1, r[1] or "") for r in odd_rows)
    assert all(list(r.ids) == reference.encode(r.text or "", add_special_tokens=False).ids and r.size == "clash" for r in got)


def test_empty(empty):
    assert bpe_encode(empty, decode=True).collect() == []


def test_query(spark, docs, reference):
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in op2_bpe(spark, SF).collect():
        ids = reference.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())


def test_broken_bytes_decode_to_replacement_characters(bpe):
    ids = [int(bpe.byte_id[0xC3]), int(bpe.byte_id[0x28])]
    assert bpe.decode(np.array(ids)) == "�("
