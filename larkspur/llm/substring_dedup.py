"""Removal of long repeated passages through a compacted De Bruijn graph of words.

The edges are windows of ``WINDOW`` consecutive words.  Consecutive edges of a
document that share their least inner ``ANCHOR``-word k-mer (leftmost on ties)
form a path; a path is known by that anchor, a hash of all its words and its
source coordinate (document, first window, windows).  Anchor and path follow
from the words alone, so a window that occurs twice lies twice on paths of one
anchor, and paths of an anchor met once are done with.

Of the rest, an anchor all of whose occurrences are the same path does not
branch.  Such paths are compacted by Spark joins: a join of source coordinates
finds which path follows which; where every occurrence of one is followed by the
other and every occurrence of the other preceded by the one, the two are links
of one nonbranching path, and pointer doubling gives each chain its head and
length.  Only occurrences of heads go back to the documents, as one long span.

An anchor with several paths branches: one source coordinate of each distinct
path is opened again, its windows are counted with the path's multiplicity, and
a join carries back which of them occur elsewhere.

Hashes only bring paths together.  What decides is verified at the source
coordinates: a path and, where it is opened, each window is known by a 128-bit
BLAKE2 digest of its own words as they stand in the text, so colliding k-mers
cost time and nothing else.  Rows are named by 128 bits of ``doc_id`` and text.

Defined results: null text has no words and becomes the empty text; a text
without repeated windows keeps its words (joined by one space); repeated rows
repeat each other's windows; null ids are fine; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import map_arrow, sliced, utf8
from .scratch import Scratch
from .skew import salted_join
from .wordhash import batched_hashes, runs

WINDOW, ANCHOR = 35, 8
SPAN = WINDOW - ANCHOR + 1
SEGMENT = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)


def paths(words: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor hash, first window, windows)`` of one document's word hashes; ``bits`` of a k-mer's hash are used."""
    out = []
    for base in range(0, max(len(words) - WINDOW + 1, 0), SEGMENT - WINDOW):
        part = words[base : base + SEGMENT]
        kmers = runs(part, ANCHOR) >> np.uint64(64 - bits) << np.uint64(64 - bits)
        keys = (kmers & ~_PLACE) | np.arange(len(kmers), dtype=np.uint64)
        least, width = keys, 1
        while width * 2 <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        n = len(kmers) - SPAN + 1
        if n <= 0:
            continue
        n = min(n, SEGMENT - WINDOW)
        place = (np.minimum(least[:n], least[SPAN - width : SPAN - width + n]) & _PLACE).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        out.append((kmers[place[first]].astype(np.int64), first + base, np.diff(np.append(first, n))))
    if not out:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def digests(text: bytes, first: np.ndarray, count: np.ndarray) -> list[bytes]:
    """A digest of the words of ``count`` windows from window ``first`` on, for each pair of the two."""
    words = text.split()
    ends = np.cumsum([len(w) + 1 for w in words])
    begins, joined = ends - [len(w) + 1 for w in words], b" ".join(words)
    return [blake2b(joined[b:e], digest_size=16).digest() for b, e in zip(begins[first].tolist(), (ends[first + count + WINDOW - 2] - 1).tolist(), strict=True)]


def _digest_array(found: list[bytes]) -> pa.Array:
    offsets = np.arange(len(found) + 1, dtype=np.int32) * np.int32(16)
    return pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(found))])


def _path_emitter(bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = utf8(batch.column("text"))
            for at, hashes, offsets in batched_hashes(texts):
                found = [paths(hashes[b:e], bits) for b, e in zip(offsets[:-1], offsets[1:], strict=True)]
                anchor, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
                path = [d for text, f in zip(texts[at : at + len(found)], found, strict=True) if len(f[0]) for d in digests(text, *f[1:])]
                row = batch.column("row").take(pa.array(np.repeat(np.arange(at, at + len(found)), [len(f[0]) for f in found])))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), _digest_array(path), row, pa.array(first << 6 | count)], names=["anchor", "path", "row", "at"])

    return emit


def _open_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        for text, opened in zip(utf8(batch.column("text")), batch.column("opened").to_pylist(), strict=True):
            first, count = (np.array([f(o["at"]) for o in opened], dtype=np.int64) for f in (lambda at: at >> 6, lambda at: at & 63))
            bit = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            windows = digests(text, np.repeat(first, count) + bit, np.ones(len(bit), dtype=np.int64))
            path = [o["path"] for o, c in zip(opened, count.tolist(), strict=True) for _ in range(c)]
            n = np.repeat(np.array([o["n"] for o in opened], dtype=np.int64), count)
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.binary()), pa.array(n), pa.array(bit.astype(np.int32)), _digest_array(windows)], names=["path", "n", "bit", "window"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.arange(SPAN, dtype=np.int64)
    for batch in sliced(batches):
        n_words, n_removed, kept = [], [], []
        spans = batch.column("spans")
        for i, text in enumerate(utf8(batch.column("text"))):
            words = text.split()
            gone = 0
            if spans[i].is_valid:
                first, count, mask = (x.to_numpy() for x in spans[i].values.flatten())
                marks = np.zeros(len(words) + 1, dtype=np.int64)
                whole = count > 0
                np.add.at(marks, first[whole], 1)
                np.add.at(marks, first[whole] + count[whole] + WINDOW - 1, -1)
                row, bit = np.nonzero((mask[:, None] >> bits) & 1)
                starts = first[row] + bit
                np.add.at(marks, starts, 1)
                np.add.at(marks, starts + WINDOW, -1)
                covered = np.cumsum(marks[:-1]) > 0
                gone = int(covered.sum())
                words = [words[j] for j in np.flatnonzero(~covered).tolist()]
            n_words.append(len(words) + gone)
            n_removed.append(gone)
            kept.append(b" ".join(words).decode("utf-8"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def compacted(met: DataFrame, scratch: Scratch) -> DataFrame:
    """``(row, first, count)`` of nonbranching paths put end to end.

    ``met(row, first, windows, path, total)`` has every occurrence of the paths;
    ``total`` counts the occurrences of ``path``.
    """
    before = met.select("row", (F.col("first") + F.col("windows")).alias("first"), F.col("path").alias("up"), F.col("total").alias("up_total"))
    steps = met.select("row", "first", "path", "total").join(before, ["row", "first"])
    steps = steps.groupBy("up", "path").agg(F.count(F.lit(1)).alias("seen"), F.first("up_total").alias("up_total"), F.first("total").alias("total"))
    links = scratch.table(steps.filter("seen = total AND seen = up_total").select("path", "up", "total"), "links-0")
    # pointer doubling; a document ends, so no chain of links can close to a ring
    turn = 0
    while True:
        above = links.select(F.col("path").alias("up"), F.col("up").alias("next"))
        doubled = links.join(above, "up", "left").select("path", F.coalesce("next", "up").alias("up"), "total", F.col("next").isNotNull().alias("moved"))
        turn += 1
        doubled = scratch.table(doubled, f"links-{turn}")
        scratch.drop(f"links-{turn - 1}")
        links = doubled.select("path", "up", "total")
        if doubled.filter("moved").isEmpty():
            break
    sizes = met.select("path", "windows").groupBy("path").agg(F.first("windows").alias("windows"))
    # all paths of a chain occur equally often
    rest = links.join(sizes, "path").groupBy(F.col("up").alias("path")).agg(F.sum("windows").alias("rest"), F.first("total").alias("total"))
    rest = scratch.table(rest, "rest")
    heads = salted_join(met.drop("total"), links.select("path", "total"), "path", ["row", "first"], "left_anti", rows="total")
    heads = salted_join(heads, rest, "path", ["row", "first"], "left", rows="total")
    return heads.select("row", "first", (F.col("windows") + F.coalesce("rest", F.lit(0))).alias("count"))


def repeated_windows(rows: DataFrame, scratch: Scratch, bits: int = 64) -> DataFrame:
    """``(row, spans)`` for ``rows(row, text)``.

    A span is its first window and either a count of windows, all repeated, or
    (count 0) a bit for each window that is.
    """
    found = scratch.table(map_arrow(rows, _path_emitter(bits), "anchor long, path binary, row binary, at long"), "paths")
    again = scratch.table(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "again")
    hits = scratch.table(salted_join(found, again, "anchor", ["row", "at"], "left_semi"), "hits")
    scratch.drop("paths")
    kinds = hits.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.first("anchor").alias("anchor"), F.min(F.struct("row", "at")).alias("source"))
    kinds = scratch.table(kinds, "kinds")
    forks = scratch.table(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "forks")
    branching = salted_join(kinds, forks, "anchor", ["path"], "left_semi", rows="kinds").groupBy("source.row").agg(F.collect_list(F.struct("path", "n", F.col("source.at").alias("at"))).alias("opened"))
    # rows that are copies of one another share a name; one of them is opened
    opened = map_arrow(rows.join(branching, "row").dropDuplicates(["row"]), _open_paths, "path binary, n long, bit int, window binary")
    windows = scratch.table(opened, "windows")
    twice = windows.groupBy("window").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("places")).filter("total > 1").select("window", "places")
    twice = scratch.table(twice, "twice")
    partly = salted_join(windows, twice, "window", ["path", "bit"], "left_semi", rows="places").groupBy("path").agg(F.first("n").alias("n"), F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    straight = salted_join(kinds, forks, "anchor", ["path"], "left_anti", rows="kinds").filter("n > 1").select("path", "n", F.col("n").alias("total"), F.lit(0).cast("long").alias("mask"))
    wanted = straight.unionByName(partly.select("path", "n", F.lit(0).cast("long").alias("total"), "mask"))
    wanted = scratch.table(wanted, "wanted")
    named = hits.select("row", F.shiftright("at", 6).alias("first"), F.col("at").bitwiseAND(63).alias("windows"), "path")
    met = scratch.table(salted_join(named, wanted, "path", ["row", "first"]).drop("n"), "met")
    scratch.drop("hits", "windows")
    whole = compacted(met.filter("total > 0").drop("mask"), scratch).select("row", "first", "count", F.lit(0).cast("long").alias("mask"))
    spans = whole.union(met.filter("total = 0").select("row", "first", F.lit(0).cast("long").alias("count"), "mask")).distinct()
    return spans.groupBy("row").agg(F.collect_list(F.struct("first", "count", "mask")).alias("spans"))


def remove_repeats(docs: DataFrame, bits: int = 64) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: each text without the words of its repeated windows.

    With fewer ``bits`` of a k-mer's hash more paths meet; results are the same.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    text = F.col("text").cast("string")
    name = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))))
    rows = docs.select("doc_id", text.alias("text"), name.alias("row"))
    spans = scratch.table(repeated_windows(rows.select("row", "text"), scratch, bits), "spans")
    return map_arrow(rows.join(spans, "row", "left").drop("row"), _cut, "doc_id long, n_words long, n_removed long, kept string")


def op5_repeated_spans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 34], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM d WHERE len(ws) >= 35)),
r AS (SELECT doc_id, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM r),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT u.doc_id, count(*) AS n_words, count(c.i) AS n_removed, coalesce(string_agg(u.word, ' ' ORDER BY u.i) FILTER (c.i IS NULL), '') AS kept
      FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.i = c.i GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
