"""An exact Jaccard join of documents' word n-gram sets in the metric space of Jaccard distance, up to connected components.

1. Equal sets are one node: groups of copies cost one row.
2. Nearly all documents are at distance 1 from nearly all others, so pivots drawn at random would copy everything everywhere. Sets are
   first cut by hash into m classes. Linked sets differ in d shingles at most, so of m = d + 1 + SPARE classes more than SPARE are equal in
   both; a node with fewer classes in common with all others links to none. Of those that are left, a node stays if the percentage of its
   shingles that a link asks for are each in some other one too, which passages shared with many don't bring about, and classes are counted
   again among these. The pivot of a class is the one of its nodes that has most
   company. A node orders its classes by their pivots, those with least company first, and goes only to the pivots of so many first ones
   that one is left in common with any node it may link to: mostly one pivot. Linked nodes meet in a pivot's region.
3. Small regions are joined at once. A larger one is cut into the Voronoi cells of pivots drawn from it: each node goes to its nearest
   pivot's cell and, by the triangle inequality, to those that are no more than two radii further, where alone a linked node may be.
   Cells are cut again in the same way. Where all pivots are so near each other that cells don't get smaller, the region is cut into rings
   about one pivot instead: linked nodes' distances to it differ by the radius at most, so they lie in one ring of that width or in
   adjacent ones. The innermost ring is linked through the pivot. Rings are joined block by block, and all that travels of a set is its
   difference from the pivot.
4. Each task returns a forest of the links it found; contracting the forests gives components.

Sets are compared by 64-bit hashes of their shingles, and nodes by a 64-bit hash of their sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import reached
from .common import dropped, fresh, small, written

N, PERCENT = 3, 90
#: A region of so many nodes, with so many shingles in all, is joined in one piece; larger ones are cut into cells, or rings and blocks of this size.
LEAF, LEAF_SHINGLES = 512, 2_000_000
#: Pivots that cut a large region into cells, and how many cells a node may be in on average before rings are taken instead.
PIVOTS, SPREAD = 8, 2.0
#: After so many cuts a region goes by rings whatever its cells.
DEEPEST = 12
BROADCAST_ROWS = 500_000

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class _Hashes(dict):
    """64-bit hashes of words; the first ones are kept, about 20 MB of them."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = value
        return value


_hashes = _Hashes()


def _mix(x: np.ndarray, k: np.uint64) -> np.ndarray:
    x = x * k
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The sorted distinct hashes of the n-word shingles; of fewer words, the whole sequence as one; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A to Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out + h[i:len(h) - width + 1 + i], _K[i % 3])
    return np.unique(out)


@lru_cache
def _bounds(percent: int) -> list[int]:
    """Set sizes at which the number of classes grows. Smaller sets than the first link to none but equal ones."""
    out = [-(-percent // (100 - percent))]
    while out[-1] < 2**31:
        out.append(out[-1] * 3 // 2 + 1)
    return out


def class_count(size_below: int, percent: int) -> tuple[int, int]:
    """(classes, spare ones) for pairs whose smaller set has fewer shingles than size_below: they differ in (size - 1) * (100 - p) / p at most."""
    d = (size_below - 1) * (100 - percent) // percent
    spare = 3 + d // 8
    return d + 1 + spare, spare


def signatures(found: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, list[int]]:
    """(marks, needs). A mark is a hash of a class of the set, in its own range of sizes and, if a smaller set of the range below may link
    to it, in that one too; the last bit tells ranges apart. needs: for marks ending in 0 and in 1, how many of them any linked set has too."""
    n, bounds, out, needs = len(found), _bounds(percent), [], [0, 0]
    if n < bounds[0]:
        return np.zeros(0, np.uint64), needs
    own = int(np.searchsorted(bounds, n, "right")) - 1
    mixed = _mix(found, _K[1])
    for k in (own, own - 1) if own and n * percent < bounds[own] * 100 else (own,):
        m, spare = class_count(bounds[k + 1], percent)
        which = ((found >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, which, mixed)
        sums = _mix(_mix(sums, _K[0]) + np.arange(k << 32, (k << 32) + m, dtype=np.uint64), _K[2])
        sums = (sums & ~np.uint64(1)) | np.uint64(k & 1)
        out.append(sums)
        needs[k & 1] = spare + 1
    return np.concatenate(out), needs


def _linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of a and b shingles with so many in common are linked."""
    return 100 * common >= percent * (a + b - common)


def profiles(docs: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """docs' columns but the text, then node, size, signatures and needs."""
    rest = [c for c in docs.columns if c != text]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, marks, needs = [], [], [], []
            for t in batch.column(text):
                found = shingles(t.as_py(), n)
                nodes.append(_name(found))
                sizes.append(len(found))
                mark, need = signatures(found, percent)
                marks.append(mark)
                needs.append(need)
            made = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), _lists(marks), pa.array(needs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], [*rest, "node", "n_shingles", "signatures", "needs"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.mapInArrow(make, f"{kinds}, node long, n_shingles long, signatures array<long>, needs array<int>")


def _name(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(values))


def _common(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections. Only shingles of two sets or more are multiplied out."""
    values, counts = np.unique(np.concatenate([*rows, *columns]), return_counts=True)
    values = values[counts > 1]
    out = np.zeros((len(rows), len(columns)), np.float32)
    if not len(values):
        return out.astype(np.int64)

    def places(sets: list[np.ndarray]) -> list[np.ndarray]:
        found = [np.minimum(np.searchsorted(values, s), len(values) - 1) for s in sets]
        return [p[values[p] == s] for p, s in zip(found, sets)]

    left, right, step = places(rows), places(columns), 8192
    for start in range(0, len(values), step):
        a, b = np.zeros((len(rows), step), np.float32), np.zeros((len(columns), step), np.float32)
        for m, sets in ((a, left), (b, right)):
            for i, p in enumerate(sets):
                m[i, p[(p >= start) & (p < start + step)] - start] = 1
        out += a @ b.T
    return np.rint(out).astype(np.int64)


def _forest(names: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of places."""
    up = list(range(len(names)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((int(names[i]), int(names[j])))
    return out


def _sets_of(part: pa.Table) -> list[np.ndarray]:
    return [np.asarray(x.values).view(np.uint64) for c in part.column("shingles").chunks for x in c]


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def by_groups(rows: DataFrame, keys: list[str], make: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """make's rows for each group of rows with equal keys (longs or ints). One group is in memory at a time, and many share a Python call's overhead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple = ()
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(k).to_numpy() for k in keys])
            cuts = [0, *((values[:, 1:] != values[:, :-1]).any(axis=0).nonzero()[0] + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(values[:, a])
                if held and key != last:
                    yield make(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield make(pa.Table.from_batches(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _leaf_links(members: DataFrame, percent: int) -> DataFrame:
    """Links within each group of (group, node, shingles)."""

    def join(part: pa.Table) -> pa.RecordBatch:
        names, found = part.column("node").to_numpy(), _sets_of(part)
        size = np.array([len(s) for s in found])
        if len(names) == 2:
            common = len(np.intersect1d(*found, assume_unique=True))
            return _edges([(int(names[0]), int(names[1]))] if _linked(common, size[0], size[1], percent) else [])
        good = np.triu(_linked(_common(found, found), size[:, None], size[None, :], percent), 1)
        return _edges(_forest(names, np.stack(good.nonzero(), axis=1)))

    return by_groups(members.select("group", "node", "shingles"), ["group"], join, "a long, b long")


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """Links within each meeting of (group, side, node, size, far, shingles): a block against a block by `side` 0 and 1, or, by 2, against itself.

    Shingles are a set's differences from the region's pivot, which are few. Two sets differ where exactly one of their differences from
    the pivot has a shingle, so these and the sizes give the intersection."""

    def join(part: pa.Table) -> pa.RecordBatch:
        names, size, found = part.column("node").to_numpy(), part.column("size").to_numpy(), _sets_of(part)
        side, far = (part.column(c).to_numpy() for c in ("side", "far"))
        rows, columns = (side != 1).nonzero()[0], (side != 0).nonzero()[0]
        if not len(rows) or not len(columns):
            return _edges([])
        held = size - np.array([len(s) for s in found])
        common = (held[rows][:, None] + held[columns][None, :]) // 2 + _common([found[i] for i in rows], [found[j] for j in columns])
        good = _linked(common, size[rows][:, None], size[columns][None, :], percent)
        good &= names[rows][:, None] != names[columns][None, :]
        good &= ~(np.abs(far[rows][:, None] - far[columns][None, :]) > _radius(percent))
        i, j = good.nonzero()
        return _edges(_forest(names, np.stack([rows[i], columns[j]], axis=1)))

    return by_groups(members.select("group", "node", "size", "side", "far", "shingles"), ["group"], join, "a long, b long")


def _radius(percent: int) -> float:
    """The greatest distance of linked sets, and a little more for rounding."""
    return (100 - percent) / 100 + 1e-9


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows with the shingles of their nodes. Few rows go to the sets, so that these are shuffled once only, to where they are compared."""
    return sets.select("node", "shingles").join(small(rows, BROADCAST_ROWS), "node")


def _with_pivots(work: DataFrame, leaf: int, level: int, count: int) -> DataFrame:
    """(region, part, node, pivot): the nodes of each region of (region, node, size), dealt over parts of about `leaf` nodes, and a copy of
    the region's pivots, drawn by hash, for each part."""
    drawn = [F.min(F.struct(F.xxhash64(F.lit(level * PIVOTS + i), "node").alias("h"), "node")) for i in range(count)]
    regions = work.groupBy("region").agg(F.count(F.lit(1)).alias("nodes"), F.sum("size").alias("weight"), F.array_distinct(F.transform(F.array(*drawn), lambda x: x["node"])).alias("pivots"))
    regions = regions.withColumn("parts", F.greatest(F.ceil(F.col("nodes") / leaf), F.ceil(F.col("weight") / LEAF_SHINGLES)).cast("int"))
    own = work.join(small(regions.select("region", "parts"), BROADCAST_ROWS), "region").select("region", F.pmod(F.xxhash64(F.lit(level), "node"), "parts").cast("int").alias("part"), "node", F.lit(False).alias("pivot"))
    copies = regions.select("region", F.explode("pivots").alias("node"), "parts").select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", F.lit(True).alias("pivot"))
    return own.unionByName(copies)


def _cells(work: DataFrame, sets: DataFrame, percent: int, leaf: int, level: int) -> DataFrame:
    """(region, node, cells, hits) of each node of (region, node, size): the pivots whose cells it is in, nearest first, and those it is linked with."""

    def measure(part: pa.Table) -> pa.RecordBatch:
        is_pivot = part.column("pivot").to_numpy(zero_copy_only=False)
        names, found = part.column("node").to_numpy(), _sets_of(part)
        order = np.argsort(names[is_pivot], kind="stable")
        pivots, mine = is_pivot.nonzero()[0][order], (~is_pivot).nonzero()[0]
        size = np.array([len(s) for s in found])
        common = _common([found[i] for i in mine], [found[j] for j in pivots]) if len(mine) else np.zeros((0, len(pivots)), np.int64)
        union = size[mine][:, None] + size[pivots][None, :] - common
        far, hit = 1 - common / union, (100 * common >= percent * union) & (names[mine][:, None] != names[pivots][None, :])
        cells = [[int(names[pivots[j]]) for j in np.argsort(row, kind="stable") if row[j] <= row.min() + 2 * _radius(percent)] for row in far]
        hits = [[int(names[pivots[j]]) for j in row.nonzero()[0]] for row in hit]
        made = [pa.array([part.column("region")[0].as_py()] * len(mine), pa.int64()), pa.array(names[mine]), pa.array(cells, pa.list_(pa.int64())), pa.array(hits, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(made, ["region", "node", "cells", "hits"])

    rows = _with_sets(_with_pivots(work, leaf, level, PIVOTS), sets)
    return by_groups(rows, ["region", "part"], measure, "region long, node long, cells array<long>, hits array<long>")


def _pivot_distances(work: DataFrame, sets: DataFrame, percent: int, leaf: int, level: int) -> DataFrame:
    """(region, pivot, node, far, hit, size, shingles) of each node of (region, node, size): its distance to the region's first pivot, and the shingles that one of the two sets has."""

    def measure(part: pa.Table) -> pa.RecordBatch:
        is_pivot = part.column("pivot").to_numpy(zero_copy_only=False)
        names, found = part.column("node").to_numpy(), _sets_of(part)
        centre = found[at := int(is_pivot.nonzero()[0][0])]
        mine = (~is_pivot).nonzero()[0]
        size = np.array([len(found[i]) for i in mine], np.int64)
        apart = [np.setxor1d(found[i], centre, assume_unique=True) for i in mine]
        common = (size + len(centre) - np.array([len(s) for s in apart], np.int64)) // 2
        union = size + len(centre) - common
        made = [pa.array([value] * len(mine), pa.int64()) for value in (part.column("region")[0].as_py(), int(names[at]))]
        made += [pa.array(names[mine]), pa.array(1 - common / union), pa.array(100 * common >= percent * union), pa.array(size), _lists(apart)]
        return pa.RecordBatch.from_arrays(made, ["region", "pivot", "node", "far", "hit", "size", "shingles"])

    rows = _with_sets(_with_pivots(work, leaf, level, 1), sets)
    return by_groups(rows, ["region", "part"], measure, "region long, pivot long, node long, far double, hit boolean, size long, shingles array<long>")


def _ring_links(work: DataFrame, sets: DataFrame, percent: int, leaf: int, level: int) -> DataFrame:
    """Links in each region of (region, node, size), by rings about its pivot."""
    far = written(_pivot_distances(work, sets, percent, leaf, level))
    hits = far.where("hit and pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    rings = far.select("region", "node", "size", F.floor(F.col("far") / _radius(percent)).cast("int").alias("ring"))
    sizes = rings.groupBy("region", "ring").agg(F.greatest(F.ceil(F.count(F.lit(1)) / leaf), F.ceil(F.sum("size") / LEAF_SHINGLES)).cast("int").alias("blocks"))
    placed = rings.join(sizes, ["region", "ring"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A block meets the blocks of its own ring, but for the innermost, whose nodes the pivot links, and all of the next ring; each meeting is a group.
    after = sizes.select("region", (F.col("ring") - 1).alias("ring"), F.col("blocks").alias("next"))
    before = sizes.select("region", (F.col("ring") + 1).alias("ring"), F.col("blocks").alias("last"))
    placed = placed.join(after, ["region", "ring"], "left").join(before, ["region", "ring"], "left")

    def meet(upto: Column, ring: Column, a: Callable, other: Column, b: Callable, side: Callable) -> Column:
        return F.transform(F.sequence(F.lit(0), upto - 1), lambda k: F.struct(F.xxhash64("region", ring, a(k), other, b(k)).alias("group"), side(k).alias("side")))

    mine, ring = F.col("block"), F.col("ring")
    same = meet(F.col("blocks"), ring, lambda k: F.least(k, mine), ring, lambda k: F.greatest(k, mine), lambda k: F.when(k == mine, 2).when(mine < k, 0).otherwise(1))
    out = F.when(F.col("next").isNotNull(), meet(F.col("next"), ring, lambda k: mine, ring + 1, lambda k: k, lambda k: F.lit(0)))
    inw = F.when(F.col("last").isNotNull(), meet(F.col("last"), ring - 1, lambda k: k, ring, lambda k: mine, lambda k: F.lit(1)))
    none = F.array().cast("array<struct<group:bigint,side:int>>")
    met = placed.select("region", "node", F.explode(F.concat(F.when(ring > 0, same).otherwise(none), F.coalesce(out, none), F.coalesce(inw, none))).alias("m"))
    blocks = met.select("region", "node", F.col("m.group").alias("group"), F.col("m.side").alias("side")).join(far.select("region", "node", "far", "size", "shingles"), ["region", "node"])
    return hits.union(_block_links(blocks, percent))


def _enough(marks: Column, bit: int) -> Column:
    """The marks that end in this bit, if there are as many as a link needs."""
    own = F.filter(marks, lambda m: m["mark"].bitwiseAND(F.lit(1)) == bit)
    return F.slice(own, 1, F.when(F.size(own) >= F.col("needs")[bit], F.size(own)).otherwise(0))


def candidates(unique: DataFrame) -> DataFrame:
    """(node, marks, company, size, needs): the nodes of (node, size, signatures, needs) that share as many classes with others as a link needs, and these."""
    marks = unique.select("node", F.explode("signatures").alias("mark"))
    shared = written(marks.groupBy("mark").agg(F.count(F.lit(1)).alias("company")).where("company > 1"))
    # Shared classes grow with the documents, so they are joined by a shuffle at every size, in which a class of many nodes can be split.
    own = marks.join(shared.hint("merge"), "mark").groupBy("node").agg(F.collect_list(F.struct("mark")).alias("marks"), F.sum("company").alias("company"))
    about = unique.select("node", "size", "needs")
    own = own.join(about, "node").withColumn("marks", F.concat(_enough(F.col("marks"), 0), _enough(F.col("marks"), 1)))
    return written(own.where(F.size("marks") > 0))


def backed(sets: DataFrame, percent: int) -> DataFrame:
    """(node): the nodes of (node, shingles) of whose shingles at least `percent` percent are each in another node too; a link asks for as many in one."""
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    shared = written(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shingle"))
    counts = each.join(shared.hint("merge"), "shingle", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    out = written(sets.select("node", F.size("shingles").alias("size")).join(counts, "node").where(100 * F.col("n") >= percent * F.col("size")).select("node"))
    dropped(shared)
    return out


def regions(unique: DataFrame) -> DataFrame:
    """(region, node, size): each node of (node, size, signatures, needs) with the pivots where it meets all nodes it may be linked with."""

    def first(marks: Column, bit: int) -> Column:
        """So many of the sorted marks that any set with all the needed ones has one of these."""
        own = _enough(marks, bit)
        return F.slice(own, 1, F.greatest(F.lit(0), F.size(own) - F.col("needs")[bit] + 1))

    own = candidates(unique)
    each = own.select("node", "company", F.explode("marks.mark").alias("mark"))
    pivots = each.groupBy("mark").agg(F.max(F.struct("company", "node")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pivots = written(pivots.select("mark", F.col("top.node").alias("pivot"), F.col("top.company").alias("rank")))
    ranked = each.select("node", "mark").join(small(pivots, BROADCAST_ROWS), "mark").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "pivot", "mark"))).alias("marks"))
    ranked = ranked.join(own.select("node", "size", "needs"), "node")
    chosen = F.array_distinct(F.concat(*(F.transform(first(F.col("marks"), bit), lambda m: m["pivot"]) for bit in (0, 1))))
    return ranked.select(F.explode(chosen).alias("region"), "node", "size")


def links(docs: DataFrame, text: str, base: DataFrame, unique: DataFrame, n: int, percent: int, leaf: int = LEAF) -> DataFrame:
    """(a, b): nodes whose sets are linked, enough of them to connect all that links connect. base: (id, node) of each row; unique: a row for each node."""
    # The sets of nodes that may have a link, made again from one text each.
    active = written(candidates(unique).select("node"))
    ids = base.join(small(active, BROADCAST_ROWS), "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")).select("id").distinct()
    chosen = docs.join(small(ids, BROADCAST_ROWS), docs["id"].eqNullSafe(ids["id"]), "left_semi").select(text)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), n) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_name, found)), pa.int64()), _lists(found)], ["node", "shingles"])

    made = chosen.mapInArrow(make, "node long, shingles array<long>").join(small(active, BROADCAST_ROWS), "node", "left_semi")
    # Only where an id has several rows can a node's set come twice; elsewhere the sets needn't be shuffled to see that.
    rows = base.join(small(ids, BROADCAST_ROWS), base["id"].eqNullSafe(ids["id"]), "left_semi").count()
    made = written(made if rows == active.count() else made.dropDuplicates(["node"]))
    kept = backed(made, percent)
    sets = written(made.join(small(kept, BROADCAST_ROWS), "node", "left_semi"))
    fewer = written(unique.join(small(kept, BROADCAST_ROWS), "node", "left_semi"))
    dropped(made)
    dropped(unique)

    met = written(regions(fewer))
    sizes = met.groupBy("region").agg(F.count(F.lit(1)).alias("nodes"), F.sum("size").alias("weight")).where("nodes > 1")
    met = written(met.join(small(sizes, BROADCAST_ROWS), "region"))

    # Regions that overlap are one neighbourhood: if it is small, its nodes are joined once instead of in each region.
    near = reached(met.where("region <> node").select(F.col("region").alias("a"), F.col("node").alias("b")), written)
    met = written(met.join(near.select(F.col("node").alias("region"), "label"), "region"))
    members = met.select("label", "node", "size").distinct()
    hoods = members.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.sum("size").alias("weight"))
    fits = (F.col("nodes") <= leaf) & (F.col("weight") <= LEAF_SHINGLES)
    once = written(hoods.where(fits).select("label"))

    together = members.join(small(once, BROADCAST_ROWS), "label", "left_semi").select(F.col("label").alias("group"), "node")
    met = written(met.join(small(once, BROADCAST_ROWS), "label", "left_anti"))
    found = written(_leaf_links(_with_sets(together, sets), percent))
    found = found.union(written(_leaf_links(_with_sets(met.where(fits).select(F.col("region").alias("group"), "node"), sets), percent)))  # each part's links are written, so that its shuffles can go
    work, level = written(met.where(~fits).select("region", "node", "size")), 0
    while not work.isEmpty():
        cells = written(_cells(work, sets, percent, leaf, level))
        found = found.union(cells.select(F.explode("hits").alias("a"), F.col("node").alias("b")))
        # Regions whose cells overlap too much are cut into rings instead.
        spread = cells.groupBy("region").agg((F.sum(F.size("cells")) / F.count(F.lit(1)) > (SPREAD if level < DEEPEST else 0.0)).alias("dense"))
        apart = work.join(small(spread, BROADCAST_ROWS), "region")
        dense = apart.where("dense").drop("dense")
        if not dense.isEmpty():
            found = found.union(written(_ring_links(dense, sets, percent, leaf, level)))
        named = cells.join(apart.where("not dense").select("region", "node", "size"), ["region", "node"]).select("region", "node", "size", "hits", F.explode("cells").alias("cell"))
        named = written(named.select(F.xxhash64("region", "cell").alias("region"), "node", "size", (F.array_contains("hits", F.col("cell")) | (F.col("node") == F.col("cell"))).alias("hit")))
        # A cell all of whose nodes are linked with its pivot is done.
        sizes = named.groupBy("region").agg(F.count(F.lit(1)).alias("nodes"), F.sum("size").alias("weight"), F.every("hit").alias("done")).where("nodes > 1 and not done")
        named = written(named.join(small(sizes, BROADCAST_ROWS), "region"))
        found = found.union(written(_leaf_links(_with_sets(named.where(fits).select(F.col("region").alias("group"), "node"), sets), percent)))
        work, level = written(named.where(~fits).select("region", "node", "size")), level + 1
    found = written(found)
    dropped(sets)
    return found


def joined(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """(id_col, n_shingles, component_id) of each row: the size of its set and the least id that links and equal sets reach.

    Rows without words or text are linked with nothing and are their own component. Equal ids do not link; repeated rows do, by their sets.
    A null id is in its component but never names it, unless there is none else; an empty table stays empty. Other columns do not matter."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    profile = written(profiles(narrow, "text", n, percent))
    base = written(profile.select("id", "node", "n_shingles"))
    first = F.first(F.struct(F.col("n_shingles").alias("size"), "signatures", "needs"))
    unique = written(profile.where(F.size("signatures") > 0).groupBy("node").agg(first.alias("x")).select("node", "x.*"))
    dropped(profile)
    of = written(reached(links(narrow, "text", base, unique, n, percent, leaf), written))
    base = base.withColumn("node", F.when(F.col("n_shingles") > 0, F.col("node")))
    labelled = base.join(small(of, BROADCAST_ROWS), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.where("label is not null").groupBy("label").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    out = labelled.join(small(least, BROADCAST_ROWS), "label", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("rows").isNotNull(), F.col("least")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that have the least id of their component; of equal rows with that id one stays."""
    kept = joined(docs, n, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    ids = written(kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")))
    inner = fresh(docs, "_kept")[0]
    out = docs.join(small(ids.select(F.col("doc_id").alias(inner)), BROADCAST_ROWS), docs["doc_id"].eqNullSafe(F.col(inner)), "left_semi")
    return out if ids.where("rows > 1").isEmpty() else out.dropDuplicates(["doc_id", "text"])
