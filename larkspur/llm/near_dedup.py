"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of distinct five-word shingles (64-bit hashes).  Equal
sets collapse to one representative first, so exact copies never meet in pairs.
Representatives then descend ``TREES`` independent trees: at a node every
document is branched by two selected coordinates of its MinHash signature, each
child holding the documents that agree on that minwise token.  A node of at most
``LEAF`` documents is a leaf; a larger one branches again, at most ``MAX_DEPTH``
times.  A child that keeps half of a larger node is a leaf of any size (a family
of copies, which no token can part), while its siblings branch on.  A pair at
similarity 0.75 misses all ten root children with probability 1e-6, and each
further level keeps it with probability 0.94.

Leaves are compared in two rounds.  First, 128-bit sketches give each leaf a
minimum spanning forest over the pairs that may be similar enough; a leaf larger
than ``LEAF`` gets one for each block of it, and stars around ``PIVOTS`` members,
so what is written stays linear in its size.  These edges are confirmed on full
shingle sets and joined to components.

Large leaves that still hold several components then become families: those of
the same largest component are one.  A shingle that more than ``COMMON`` members
of a family hold is common.  Two members share at most the lesser number of their
common shingles and the rare ones that both hold, so pairs across components that
share a rare shingle and may reach the threshold so are listed and confirmed
(at most ``COMMON`` / 2 for each rare shingle of a member), as are pairs with the
``PIVOTS`` members nearest to what is common.  Members whose common shingles
alone cannot make a link with any size found in the family need no more.

Last, in the small leaves and among the remaining members of families, every
member outside the largest component meets all others: 256 minwise tokens tell
which may have a link across components (not more than 4.5 standard deviations
below the threshold), and these are compared on full sets, block by block.  Pairs
inside a component need no comparison, and of several links to one component one
is enough, so no link between components is lost.  In a family this costs
(remaining members) x (those outside the largest component) / ``LEAF`` rows,
which is quadratic where many members hold hardly more than common shingles and
yet are linked with none of the nearest.  Components come from a distributed star
contraction.

Defined results: null or empty text has no shingles, links with nothing and is
its own component; a null ``doc_id`` takes no part, its component is null and
it is kept (nothing can name it a copy); ``doc_id`` is taken to name one text;
equal texts share a component however often they occur; repeated rows are each
returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import map_arrow, sliced, utf8
from .columns import Carried
from .graph import components
from .scratch import Scratch
from .skew import salted_join
from .wordhash import batched_hashes, mix, runs

SHINGLE = 5
THRESHOLD = 75
COORDINATES, LONG_COORDINATES = 64, 256
TREES, BRANCHES = 5, 2
LEAF = 512
PIVOTS = 8
MAX_DEPTH = 8
#: Of 128 sketch bits, 16 differ on average at the threshold; five and a half standard deviations more may.
SKETCH_DISTANCE = 41
#: Of 256 tokens, 192 agree on average at the threshold; 4.5 standard deviations fewer may.
LONG_AGREE = 161
#: Shingles of a block whose full sets are compared, about (8 bytes each).
VOLUME = 500_000
#: A shingle that more members of a family hold is common to it; others are rare, and pairs that share one are listed.
COMMON = 32
#: Ids of documents whose sets are needed are broadcast up to this many (8 bytes each).
BROADCAST_IDS = 500_000

_rng = np.random.default_rng(751)
_A = _rng.integers(0, 1 << 63, LONG_COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, LONG_COORDINATES, dtype=np.uint64)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, words, offsets in batched_hashes(texts, lower=True):
        every = runs(words, SHINGLE)
        for b, e in zip(offsets[:-1], offsets[1:], strict=True):
            if e - b >= SHINGLE:
                yield np.unique(every[b : e - SHINGLE + 1])
            elif e > b:
                yield runs(words[b:e], int(e - b), 0xA24BAED4963EE407)
            else:
                yield np.empty(0, dtype=np.uint64)


def signature(shingles: np.ndarray, n: int = COORDINATES) -> np.ndarray:
    """``n`` minwise tokens of a non-empty set."""
    best = np.full(n, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        hashed = (shingles[at : at + 2048, None] * _A[:n] + _B[:n]) >> np.uint64(32)
        np.minimum(best, hashed.min(axis=0), out=best)
    return best.astype(np.uint32)


_SIGNED = "doc_id long, n_shingles int, set1 long, set2 long, sketch1 long, sketch2 long, signature array<int>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sizes, sets, sketches, sigs = [], [], [], []
        for s in shingle_sets(utf8(batch.column("text"))):
            sizes.append(len(s))
            if not len(s):
                sets.append((0, 0))
                sketches.append((0, 0))
                sigs.append([])
                continue
            sets.append((int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)), int(mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).astype(np.int64))))
            sig = signature(s)
            two = mix(sig.astype(np.uint64) + np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x100000000)) >> np.uint64(62)
            packed = (two.reshape(2, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).astype(np.int64)
            sketches.append((int(packed[0]), int(packed[1])))
            sigs.append(sig.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int32()), *(pa.array([x[i] for x in part], pa.int64()) for part in (sets, sketches) for i in (0, 1)), pa.array(sigs, pa.list_(pa.int32()))],
            names=["doc_id", "n_shingles", "set1", "set2", "sketch1", "sketch2", "signature"],
        )


def _emit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = list(shingle_sets(utf8(batch.column("text"))))
        tokens = [mix(signature(x, LONG_COORDINATES).astype(np.uint64)).astype(np.uint8).tobytes() for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(tokens, pa.binary())], names=["id", "shingles", "tokens"])


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[dict[str, np.ndarray]]:
    """The struct list of each row as numpy columns."""
    lists = batch.column(column)
    flat, ends = lists.flatten(), lists.offsets.to_numpy()
    columns = {f.name: c for f, c in zip(flat.type, flat.flatten(), strict=True)}
    arrays = {k: (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(len(c), -1) if pa.types.is_binary(c.type) else c.to_numpy()) for k, c in columns.items()}
    for b, e in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True):
        yield {k: v[b:e] for k, v in arrays.items()}


def forest(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a minimum spanning forest over the pairs of a leaf whose sketches and sizes allow a link."""
    n = len(m["id"])
    far = np.int64(255)
    sizes = m["n_shingles"].astype(np.int64)
    one, two = m["sketch1"].view(np.uint64), m["sketch2"].view(np.uint64)
    nearest, parent, free = np.full(n, far), np.full(n, -1), np.ones(n, dtype=bool)
    edges = []
    for _ in range(n):
        at = int(np.argmin(np.where(free, nearest, far + 1)))
        free[at] = False
        if parent[at] >= 0:
            edges.append((int(parent[at]), at))
        d = np.bitwise_count(one ^ one[at]).astype(np.int64) + np.bitwise_count(two ^ two[at])
        may = free & (d <= SKETCH_DISTANCE) & (np.minimum(sizes, sizes[at]) * 100 >= THRESHOLD * np.maximum(sizes, sizes[at])) & (d < nearest) & (m["id"] != m["id"][at])
        nearest[may], parent[may] = d[may], at
    if not edges:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    u, v = np.array(edges).T
    return m["id"][u], m["id"][v]


def _emit_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [forest(m) for m in _groups(batch, "ms")]
        u, v = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, dtype=np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def involved(m: dict[str, np.ndarray]) -> np.ndarray:
    """Members of a leaf that may have a link across components, by sizes and long signatures."""
    labels, counts = np.unique(m["label"], return_counts=True)
    minor = np.flatnonzero(m["label"] != labels[np.argmax(counts)])
    sizes = m["n_shingles"].astype(np.int64)
    found = np.zeros(len(sizes), dtype=bool)
    for i in minor.tolist():
        may = np.flatnonzero((m["label"] != m["label"][i]) & (np.minimum(sizes, sizes[i]) * 100 >= THRESHOLD * np.maximum(sizes, sizes[i])))
        may = may[(m["tokens"][may] == m["tokens"][i]).sum(axis=1) >= LONG_AGREE]
        found[may] = True
        found[i] |= len(may) > 0
    return m["id"][found]


def _emit_involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [involved(m) for m in _groups(batch, "ms")]
        node = np.repeat(batch.column("node").to_numpy(), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(found))], names=["node", "id"])


def across(ids: np.ndarray, label: np.ndarray, sets: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links across components, one for each document outside the largest and each component it reaches.

    ``sets`` holds the members' shingles end to end; intersections are counted
    on all of them.
    """
    sizes = np.diff(np.append(starts, len(sets)))
    labels, counts = np.unique(label, return_counts=True)
    _, dense = np.unique(sets, return_inverse=True)
    mine = np.zeros(dense.max() + 1, dtype=bool)
    for i in np.flatnonzero(label != labels[np.argmax(counts)]).tolist():
        own = dense[starts[i] : starts[i] + sizes[i]]
        mine[own] = True
        shared = np.add.reduceat(mine[dense], starts, dtype=np.int64)
        mine[own] = False
        linked = np.flatnonzero((label != label[i]) & (100 * shared >= THRESHOLD * (sizes + sizes[i] - shared)))
        for j in linked[np.unique(label[linked], return_index=True)[1]].tolist():
            yield int(ids[i]), int(ids[j])


def _emit_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ms")
        flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ids, label, sets = flat.flatten()
        ids, label, at, values = ids.to_numpy(), label.to_numpy(), sets.offsets.to_numpy(), sets.values.to_numpy()
        pairs = [p for b, e in zip(ends[:-1], ends[1:], strict=True) for p in across(ids[b:e], label[b:e], values[at[b] : at[e]], at[b:e] - at[b])]
        u, v = np.array(sorted({(min(p), max(p)) for p in pairs}), dtype=np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def leaves(sigs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, size, id)``: the leaves of all trees with two documents or more."""
    roots = F.array(*(F.struct(F.lit(c).alias("c"), F.col("signature")[c].alias("token")) for c in range(TREES * BRANCHES)))
    nodes = sigs.select("id", F.explode(roots).alias("r")).select(F.xxhash64("r.c", "r.token").alias("node"), "id")
    out, free = [], COORDINATES - TREES * BRANCHES
    sizes = scratch.table(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes-0")
    grown = scratch.table(salted_join(nodes, sizes, "node", ["id"], rows="size"), "nodes-0")
    for depth in range(MAX_DEPTH):
        out.append(grown.filter(F.col("size") <= LEAF))
        big = grown.filter(F.col("size") > LEAF)
        if big.isEmpty():
            return _union(out)
        first, gap = f"pmod(xxhash64(node, {depth}), {free})", f"1 + pmod(xxhash64(node, {depth}, 1), {free - 1})"
        picked = F.expr(f"array(CAST({first} AS INT), CAST(pmod({first} + {gap}, {free}) AS INT))")
        children = big.join(sigs.select("id", "signature"), "id").withColumn("c", F.explode(picked)).withColumn("c", F.col("c") + TREES * BRANCHES)
        children = scratch.table(children.select("id", F.col("size").alias("whole"), F.expr("xxhash64(node, c, signature[c])").alias("node")), f"children-{depth}")
        sizes = children.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.first("whole").alias("whole")).filter("size > 1")
        sizes = scratch.table(sizes.select("node", "size", ((F.col("size") > LEAF) & (F.col("size") * 2 >= F.col("whole"))).alias("family")), f"sizes-{depth + 1}")
        placed = scratch.table(salted_join(children.select("node", "id"), sizes, "node", ["id"], rows="size"), f"nodes-{depth + 1}")
        out.append(placed.filter("family"))
        grown = placed.filter("NOT family").drop("family")
    return _union([*out, grown])


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0].select("node", "size", "id")
    for p in parts[1:]:
        whole = whole.union(p.select("node", "size", "id"))
    return whole


def _in_blocks(members: DataFrame, *columns: str) -> DataFrame:
    """``(node, b, ms)``: each leaf's members by block, met by each of the leaf's chunks of ``minor`` members.

    ``members`` tells each leaf's number of ``blocks`` and ``chunks``.
    """
    rows = members.withColumn("_own", F.pmod(F.xxhash64("id", "node"), F.col("blocks"))).withColumn("_chunk", F.pmod(F.xxhash64("node", "id"), F.col("chunks")))
    every = "array_union(transform(sequence(0, chunks - 1), c -> _own * chunks + c), if(minor, transform(sequence(0, blocks - 1), o -> o * chunks + _chunk), array()))"
    return rows.withColumn("b", F.explode(F.expr(every))).groupBy("node", "b").agg(F.collect_list(F.struct(*columns)).alias("ms")).filter("size(ms) > 1")


def _with_blocks(members: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``members(node, id, label, n_shingles, …)`` of the leaves that hold several labels, with what ``_in_blocks`` needs."""
    labels = members.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("volume"))
    nodes = labels.groupBy("node").agg(F.sum("n").alias("n"), F.sum("volume").alias("volume"), F.max(F.struct("n", "label", "volume")).alias("major"), F.count(F.lit(1)).alias("labels"))
    parts = lambda n, volume: F.greatest(F.lit(1), F.ceil(n / LEAF), F.ceil(volume / VOLUME)).cast("int")
    blocks = parts(F.col("n"), F.col("volume")).alias("blocks")
    chunks = parts(F.col("n") - F.col("major.n"), F.col("volume") - F.col("major.volume")).alias("chunks")
    nodes = scratch.table(nodes.filter("labels > 1").select("node", "n", F.col("major.label").alias("major"), blocks, chunks), name)
    return salted_join(members, nodes, "node", ["id"]).withColumn("minor", F.col("label") != F.col("major")).drop("n", "major")


def _stars(marks: DataFrame, scratch: Scratch) -> DataFrame:
    """``(u, v)``: members ``v`` of large leaves and those of their leaf's pivots ``u`` that sketches and sizes allow as links."""
    me = F.struct("id", "n_shingles", "sketch1", "sketch2")
    pivots = marks.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.min(F.struct(F.xxhash64(F.lit(j), "id").alias("h"), me.alias("p"))) for j in range(PIVOTS))).alias("ps"))
    pivots = scratch.table(pivots.select("node", "n", F.array_distinct("ps.p").alias("ps")), "pivots")
    met = salted_join(marks, pivots, "node", ["id"])
    near = f"p.id <> id AND bit_count(p.sketch1 ^ sketch1) + bit_count(p.sketch2 ^ sketch2) <= {SKETCH_DISTANCE} AND least(p.n_shingles, n_shingles) * 100L >= {THRESHOLD}L * greatest(p.n_shingles, n_shingles)"
    return met.select(F.explode(F.expr(f"filter(ps, p -> {near})")).alias("p"), F.col("id").alias("v")).select(F.col("p.id").alias("u"), "v")


def _kin(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, id, n_shingles, label, common, rare)``: the members of large leaves that hold several labels, by family.

    Leaves of the same largest component are one family, which holds every pair
    of theirs.  ``common`` is the number of a member's shingles that more than
    ``COMMON`` of the family hold, ``rare`` are those that fewer share.
    """
    labels = members.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
    majors = labels.groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("major"), F.count(F.lit(1)).alias("labels"))
    majors = scratch.table(majors.filter("labels > 1").select("node", "n", F.xxhash64("major.label").alias("family")), "majors")
    kin = salted_join(members, majors, "node", ["id"]).select(F.col("family").alias("node"), "id", "n_shingles", "label")
    kin = scratch.table(kin.distinct(), "kin-members")
    each = kin.join(sets.select("id", "shingles"), "id").select("node", "id", F.explode("shingles").alias("shingle"))
    held = scratch.table(each.groupBy("node", "shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "held")
    told = salted_join(each, held, ["node", "shingle"], ["id"]).groupBy("node", "id")
    told = told.agg(F.count_if(F.col("n") > COMMON).alias("common"), F.collect_list(F.when(F.col("n") <= COMMON, F.col("shingle"))).alias("rare"))
    return scratch.table(kin.join(told, ["node", "id"], "left").withColumn("common", F.coalesce("common", F.lit(0).cast("long"))), "kin")


def _enough(mine: str, its: str, rare: str = "0") -> str:
    """Whether as many ``rare`` shingles and the lesser ``common`` of two members can make a link."""
    return f"({rare} + least({mine}.common, {its}.common)) * {100 + THRESHOLD}L >= {THRESHOLD}L * ({mine}.n_shingles + {its}.n_shingles)"


def _kin_pairs(kin: DataFrame, scratch: Scratch) -> DataFrame:
    """``(u, v)``: pairs across labels that share rare shingles, and those of each member and the ``PIVOTS`` nearest to what is common."""
    me = F.struct("id", "label", "n_shingles", "common")
    posted = kin.select("node", me.alias("a"), F.explode("rare").alias("shingle"))
    both = posted.join(posted.withColumnRenamed("a", "b"), ["node", "shingle"]).filter("a.id < b.id AND a.label <> b.label")
    both = both.groupBy("node", "a", "b").agg(F.count(F.lit(1)).alias("n")).filter(_enough("a", "b", "n"))
    # nearest: the least symmetric difference
    near = F.struct((F.col("common") * 2 - F.col("n_shingles")).alias("near"), F.col("id"), me.alias("p"))
    pivots = kin.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *(F.max(F.when(F.pmod(F.xxhash64("id"), F.lit(PIVOTS)) == j, near)).alias(f"p{j}") for j in range(PIVOTS)))
    pivots = scratch.table(pivots.select("node", "n", F.array_compact(F.array(*(f"p{j}.p" for j in range(PIVOTS)))).alias("ps")), "centres")
    met = salted_join(kin.select("node", "id", me.alias("a")), pivots, "node", ["id"])
    met = met.select("a", F.explode(F.expr(f"filter(ps, p -> p.label <> a.label AND {_enough('a', 'p')})")).alias("b"))
    return scratch.table(both.select("a", "b").union(met).select(F.col("b.id").alias("u"), F.col("a.id").alias("v")).distinct(), "kin-pairs")


def _inliers(kin: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, id, n_shingles)``: members that may have a link without a rare shingle in it.

    The lesser ``common`` of two members bounds what they share then, so a
    member's own tells how large another may be; a family's members are summed up
    by size, a fiftieth of a power of e each.
    """
    room = f"{100 + THRESHOLD}L * common - {THRESHOLD}L * n_shingles"  # THRESHOLD times the size of the largest
    steps = kin.groupBy("node", F.floor(F.log("n_shingles") * 50).alias("step")).agg(F.min("n_shingles").alias("least"), F.max(F.expr(room)).alias("room"), F.count(F.lit(1)).alias("n"))
    steps = scratch.table(steps.groupBy("node").agg(F.sum("n").alias("n"), F.collect_list(F.struct("least", "room")).alias("steps")), "steps")
    may = f"exists(steps, s -> {room} >= {THRESHOLD}L * s.least AND s.room >= {THRESHOLD}L * n_shingles)"
    return salted_join(kin.select("node", "id", "n_shingles", "common"), steps, "node", ["id"]).filter(may).select("node", "id", "n_shingles")


def _confirm(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs ``(u, v)`` whose full shingle sets are similar enough."""
    # the side that recurs is met first, while rows are still two numbers wide
    often = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("su")), "u")
    left = salted_join(pairs, scratch.table(often, f"{name}-left"), "u", ["v"]).drop("n")
    both = left.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv")), "v")
    shared = both.select("u", "v", F.size(F.array_intersect("su", "sv")).cast("long").alias("shared"), (F.size("su") + F.size("sv")).cast("long").alias("total"))
    return scratch.table(shared.filter(f"100 * shared >= {THRESHOLD} * (total - shared)").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), name)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, n_links)`` of ``docs(doc_id, text)``.

    ``n_links`` counts the confirmed links of the representative of the
    document's set; pairs that other links have already joined aren't compared.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.table(map_arrow(texts, _sign, _SIGNED), "signed")
    told = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    one_set = signed.filter(told).groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    one_set = scratch.table(one_set, "one-set")
    members = salted_join(signed.filter(told).select("doc_id", "n_shingles", "set1", "set2"), one_set, ["set1", "set2", "n_shingles"], ["doc_id"]).select("doc_id", "n_shingles", "id")
    alone = signed.filter(~told).select("doc_id", "n_shingles", F.col("doc_id").alias("id"))
    members = scratch.table(members.union(alone), "members")
    sigs = signed.filter(told).join(one_set.select(F.col("id").alias("doc_id"), "set1", "set2", "n_shingles"), ["doc_id", "set1", "set2", "n_shingles"], "left_semi")
    sigs = scratch.table(sigs.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "n_shingles", "sketch1", "sketch2", "signature"), "signatures")
    scratch.drop("signed")

    leaf = scratch.table(leaves(sigs, scratch), "leaves")
    marks = leaf.join(sigs.select("id", "n_shingles", "sketch1", "sketch2"), "id")
    blocks = marks.withColumn("blocks", F.ceil(F.col("size") / LEAF).cast("int")).withColumn("chunks", F.lit(1)).withColumn("minor", F.lit(False))
    edges = map_arrow(_in_blocks(blocks, "id", "n_shingles", "sketch1", "sketch2"), _emit_forest, "u long, v long")
    large = leaf.filter(F.col("size") > LEAF)
    if not large.isEmpty():
        edges = edges.union(_stars(marks.filter(F.col("size") > LEAF).drop("size"), scratch))
    edges = scratch.table(edges.distinct(), "forest")
    # a member of a large leaf may have its only link in another block
    active = edges.select(F.explode(F.array("u", "v")).alias("id")).union(large.select("id")).distinct()
    active = scratch.table(active, "active")
    wanted = active.withColumnRenamed("id", "doc_id")
    if active.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = map_arrow(texts.join(wanted, "doc_id", "left_semi"), _emit_sets, "id long, shingles array<long>, tokens binary")
    sets = scratch.table(sets.dropDuplicates(["id"]), "sets")
    links = _confirm(edges, sets, scratch, "links-1")
    labels = components(links, scratch, "first")
    # what is left: pairs across components, in leaves that hold several
    named = active.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    near = leaf.join(named, "id").join(sets.select("id", F.size("shingles").alias("n_shingles"), "tokens"), "id")
    near = scratch.table(near, "near")
    if not large.isEmpty():
        kin = _kin(near.filter(F.col("size") > LEAF).select("node", "id", "n_shingles", "label"), sets, scratch)
        links = links.union(_confirm(_kin_pairs(kin, scratch), sets, scratch, "links-kin"))
        labels = components(links, scratch, "kin")
        left = near.filter(F.col("size") <= LEAF).select("node", "id", "n_shingles", "tokens")
        left = left.union(_inliers(kin, scratch).join(sets.select("id", "tokens"), "id").select("node", "id", "n_shingles", "tokens"))
        near = scratch.table(left.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "near-kin")
    near = near.select("node", "id", "n_shingles", "tokens", "label")
    found = map_arrow(_in_blocks(_with_blocks(near, scratch, "mixed"), "id", "n_shingles", "label", "tokens"), _emit_involved, "node long, id long")
    found = scratch.table(found.distinct().join(near.select("node", "id", "label", "n_shingles"), ["node", "id"]), "involved")
    found = _with_blocks(found, scratch, "blocks").join(sets.select("id", "shingles"), "id")
    pairs = map_arrow(_in_blocks(found, "id", "label", "shingles"), _emit_across, "u long, v long")
    links = links.union(scratch.table(pairs.distinct(), "links-2"))
    labels = components(links, scratch, "final")
    degree = links.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    known = members.join(labels, "id", "left").join(degree, "id", "left")
    known = known.withColumn("component_id", F.coalesce("label", "id"))
    return known.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs``, all its columns, with one row of each near-duplicate component: that of its least ``doc_id``.

    Of several rows with that id, which names one document, the row of the least
    hash over all columns stays; rows without an id all stay.  Ids decide, so
    texts stay where they are as long as the ids to drop are few enough to
    broadcast; beyond that they are dealt by id once, and hashed, not sorted.
    """
    carried = Carried(docs)
    scratch = Scratch(docs.sparkSession, "one-of-each")
    found = near_duplicates(carried.df.select(carried["doc_id"].alias("doc_id"), carried["text"].alias("text"))).filter("doc_id IS NOT NULL")
    found = scratch.table(found.groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "ids")
    # what differs from "one row, which stays"
    gone = found.filter("NOT kept OR n > 1").select(F.col("doc_id").alias("gone_id"))
    again = found.filter("kept AND n > 1").select(F.col("doc_id").alias("again_id"))
    rows = carried.df.withColumn("id", carried["doc_id"].cast("long"))
    single = rows.join(_small_or_hashed(gone), F.col("id") == F.col("gone_id"), "left_anti")
    each = F.struct(*(f"in_{i}" for i in range(len(carried.names))))
    if again.isEmpty():
        return single.select(*carried.restored())
    several = rows.join(_small_or_hashed(again), F.col("id") == F.col("again_id"), "left_semi")
    first = several.groupBy("id").agg(F.min_by(each, F.xxhash64(*each_hashable(carried))).alias("row")).select("row.*")
    return single.drop("id").union(first).select(*carried.restored())


def each_hashable(carried: Carried) -> list:
    """The input's columns that can be hashed (maps and variants can't)."""
    names = [f"in_{i}" for i in range(len(carried.names))]
    return [F.col(n) for n in names if not any(word in carried.df.schema[n].dataType.simpleString() for word in ("map<", "variant"))]


def _small_or_hashed(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM p JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.other = e.u),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m ON d.doc_id = m.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
