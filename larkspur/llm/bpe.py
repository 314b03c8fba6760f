"""Byte-level BPE encoding and decoding with segment trees over pair ranks.

A pre-token's adjacent pairs are the leaves of a segment tree that holds
``rank * width + position``; the root is therefore the leftmost pair of lowest
rank.  Merging it touches three leaves (the pair, the token swallowed and the
pair to the left), each a logarithmic point update, and the loop ends when the
root says that no pair can merge.  Pre-tokens of equal width class advance
together as numpy rows, so the Python cost is per round, not per word.

Defined results: null text encodes as empty text, to no ids, and decodes to the
empty text; the vocabulary's special tokens found in a text become their own
ids; texts are encoded whole, whatever their length; repeated rows are each
returned; other columns of the input pass through unless they clash with the
columns made here (``ids``, ``decoded``), which win.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .arrow import cuts, map_arrow

NONE = np.int64(1) << np.int64(60)
CACHE_WORDS = 300_000
CHUNK_BYTES = 1 << 20


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


class ByteBPE:
    """A vocabulary read from a tokenizers JSON file of the byte-level BPE kind."""

    def __init__(self, vocabulary: str, pattern: str):
        spec = json.loads(vocabulary)
        ids: dict[str, int] = spec["model"]["vocab"]
        letters = byte_alphabet()
        back = {c: b for b, c in letters.items()}
        self.byte_id = np.array([ids[letters[b]] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.piece = {i: bytes(back[c] for c in token) for token, i in ids.items() if token not in self.special}
        self.piece |= {i: content.encode() for content, i in self.special.items()}
        self.split = regex.compile(pattern)
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << np.int64(32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def merge_rows(self, tokens: np.ndarray) -> np.ndarray:
        """Merge every row of ``tokens`` (-1 pads on the right) to the end; -1 marks swallowed places."""
        n, width = tokens.shape
        place = np.arange(width, dtype=np.int64)
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        if width > 1:
            ranks = self.pair_ranks(tokens[:, :-1], tokens[:, 1:])
            tree[:, width : 2 * width - 1] = np.where(ranks < NONE, ranks * width + place[:-1], NONE)
        for at in range(width - 1, 0, -1):
            tree[:, at] = np.minimum(tree[:, 2 * at], tree[:, 2 * at + 1])
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            root = tree[row, 1]
            pos = root % width
            swallowed = after[row, pos]
            new = self.merged[root // width]
            tokens[row, pos] = new
            tokens[row, swallowed] = -1
            follow = after[row, swallowed]
            after[row, pos] = follow
            inner = follow < width
            before[row[inner], follow[inner]] = pos[inner]
            right = self.pair_ranks(new, np.where(inner, tokens[row, np.minimum(follow, width - 1)], -1))
            left_pos = before[row, pos]
            left = self.pair_ranks(np.where(left_pos >= 0, tokens[row, np.maximum(left_pos, 0)], -1), new)
            tree[row, width + pos] = np.where(right < NONE, right * width + pos, NONE)
            tree[row, width + swallowed] = NONE
            has = left_pos >= 0
            tree[row[has], width + left_pos[has]] = np.where(left[has] < NONE, left[has] * width + left_pos[has], NONE)
            for leaf, rows in ((pos, row), (swallowed, row), (left_pos[has], row[has])):
                at = width + leaf
                for _ in range(width.bit_length() - 1):
                    at = at >> 1
                    tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            row = row[tree[row, 1] < NONE]
        return tokens

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, packed as little-endian int32."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        for width in sorted({1 << (int(s) - 1).bit_length() for s in sizes if s}):
            mine = np.flatnonzero((sizes <= width) & (sizes > width // 2))
            step = max(1, (1 << 17) // width)
            for at in range(0, len(mine), step):
                part = mine[at : at + step]
                raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in part), dtype=np.uint8).reshape(len(part), width)
                tokens = np.where(np.arange(width) < sizes[part, None], self.byte_id[raw], -1)
                tokens = self.merge_rows(tokens)
                alive = tokens >= 0
                flat = tokens[alive].astype("<i4").tobytes()
                ends = np.cumsum(alive.sum(axis=1)) * 4
                begin = 0
                for i, end in zip(part.tolist(), ends.tolist(), strict=True):
                    out[i] = flat[begin:end]
                    begin = end
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text."""
        pieces: list[list[str | int]] = []
        for text in texts:
            if self.split_special is None:
                pieces.append(self.split.findall(text))
                continue
            own: list[str | int] = []
            for i, part in enumerate(self.split_special.split(text)):
                own.extend([self.special[part]] if i % 2 else self.split.findall(part))
            pieces.append(own)
        fresh = list({w for own in pieces for w in own if w not in self.cache})
        if len(self.cache) + len(fresh) > CACHE_WORDS:
            self.cache.clear()
            fresh = list({w for own in pieces for w in own})
        words = [w for w in fresh if isinstance(w, str)]
        self.cache.update(zip(words, self.merge_words([w.encode("utf-8", "surrogatepass") for w in words]), strict=True))
        self.cache.update({w: np.array([w], dtype="<i4").tobytes() for w in fresh if isinstance(w, int)})
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, own)), dtype="<i4") for own in pieces]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.piece.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _loaded(vocabulary_path: str, pattern: str) -> ByteBPE:
    with open(vocabulary_path, encoding="utf-8") as f:
        return ByteBPE(f.read(), pattern)


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN


def _added(df: DataFrame, new: list[tuple[str, T.DataType]]) -> T.StructType:
    names = {n for n, _ in new}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, t) for n, t in new])


def bpe_encode(docs: DataFrame, text_col: str = "text", decode: bool = False, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``ids array<int>`` and, if ``decode``, ``decoded string`` made from those ids.

    The vocabulary file must be readable at ``path`` on every executor.
    """
    path, pattern = _defaults(path, pattern)
    schema = _added(docs, [("ids", T.ArrayType(T.IntegerType()))] + [("decoded", T.StringType())] * decode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for batch in batches:
            for at, n in cuts(batch.column(text_col), CHUNK_BYTES):
                rows = batch.slice(at, n)
                ids = bpe.encode([x or "" for x in rows.column(text_col).to_pylist()])
                columns = {f: rows.column(f) for f in rows.schema.names} | {"ids": pa.array(ids, pa.list_(pa.int32()))}
                if decode:
                    columns["decoded"] = pa.array([bpe.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([columns[f] for f in schema.names], names=schema.names)

    return map_arrow(docs, run, schema)


def bpe_decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded string``; null ids decode to the empty text."""
    path, pattern = _defaults(path, pattern)
    schema = _added(encoded, [("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for batch in batches:
            decoded = [bpe.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(ids_col).to_pylist()]
            columns = {f: batch.column(f) for f in batch.schema.names} | {"decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[f] for f in schema.names], names=schema.names)

    return map_arrow(encoded, run, schema)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = bpe_encode(docs, decode=True).drop("text")
    digest = F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
