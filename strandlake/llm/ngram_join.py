"""Operator 3, n-gram Jaccard join: count vectors in R-trees.

Every document is the set of its distinct k-word shingles.  Shingles are hashed into GROUPS groups, and the
number of a document's shingles in each group is its point.  For two documents the sum of the smaller
coordinates is at least as large as their overlap, and the same sum over the upper corners of two boxes of
points is at least as large as that of any pair in them, so a tree of boxes discards pairs without looking
at texts.  Pairs that survive are verified by their whole shingle sets.

Alone, such a tree can't cut a corpus into parts: points of unrelated texts of one length lie close
together in few dimensions, and in many dimensions every box is as wide as the space.  So the forest has one
tree for each shingle of a prefix: with the shingles of each document put in any one global order, two
documents that reach the threshold share one among the first n - ceil(t n) + 1 of either (n: set size).
The order comes from a sketch of fixed size that counts the shingles of all documents, rarest first, so
that what many texts share hardly ever founds a tree.  Any order gives the same links.

Steps (each only moves what is left):

1. One pass makes points, set sizes, fingerprints and the sketch.  Equal sets are one class from here on.
2. A second pass emits prefixes; a shingle with only one document is dropped at once.  A tree of which all
   members have one and the same preceding shingle is dropped as well: all its pairs stand in that tree.
3. In each tree the class with the smallest id is compared with the others, which is linear; what is
   linked is joined to components.
4. Trees that still hold two components are searched as R-trees for pairs across components.  A tree of
   more than a TILE is cut into tiles by size, and each pair of tiles that the threshold lets meet is a
   task's work of bounded size.  Pairs that meet in the tree of their preceding shingle are left to it.
5. Surviving pairs are verified, components are joined again.  Where a tile has more surviving pairs than
   points, the shingle sets go to the tile instead: it verifies there, joins what it links, skips pairs that
   are joined already, and gives out at most as many links as points.  So rows follow the points, never
   their pairs.

Null and empty texts have no shingles and are linked with nothing.  Rows that repeat a doc_id each get a
row, and are one node, which is linked with whatever any of its texts is linked with; where the texts differ,
neither ranks nor preceding shingles are used for it.  Rows without a
doc_id are left out.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UNKNOWN_BYTES, input_bytes, shared_path, stored, text_bytes
from .graph import components
from .shingles import shingle_set

GROUPS = 256
FANOUT = 32
#: What a tile holds at most: points, each of which counts once more for every WEIGHT shingles (8 bytes) it has.
TILE, WEIGHT = 4096, 4096
HOT = 4096
LINKS = 256
CHUNK = 1 << 14
_SHIFT = np.uint64(64 - 8)
#: Up to so many ids (8 MB) are broadcast to pick the texts to verify; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def point(shingles: np.ndarray) -> np.ndarray:
    """Counts by group, those above 255 as 255; what they leave out (n less their sum) is bounded apart."""
    return np.minimum(np.bincount((shingles >> _SHIFT).astype(np.int64), minlength=GROUPS), 255).astype(np.uint8)


def _points(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS)


def _left_out(points: np.ndarray, n: np.ndarray) -> np.ndarray:
    return n - points.sum(axis=1, dtype=np.int64)


def _cells(shingles: np.ndarray, cells: int) -> np.ndarray:
    return ((shingles >> np.uint64(17)) & np.uint64(cells - 1)).astype(np.int64)


def sketch_cells(docs: DataFrame) -> int:
    """A power of two that follows the input's bytes up to 4 million (16 MB)."""
    size = input_bytes(docs)
    return 1 << min(22, max(14, math.ceil(math.log2(max(1, size / 512))))) if size < UNKNOWN_BYTES else 1 << 18


def describe(docs: DataFrame, k: int, cells: int) -> tuple[DataFrame, np.ndarray]:
    """Points of all documents, and the sketch: how often the shingles of each cell occur in the corpus."""

    def run(batches):
        counts = np.zeros(cells, np.uint32)
        for b in batches:
            ids, sizes, prints, points = b.column(0), [], [], []
            for t in text_bytes(b.column(1)):
                s = shingle_set(t, k)
                np.add.at(counts, _cells(s, cells), np.uint32(1))
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                points.append(point(s).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), ids, pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(points, pa.binary())], names=["kind", "doc_id", "n", "print", "point"])
        rows = [(i, counts[at : at + CHUNK]) for i, at in enumerate(range(0, cells, CHUNK))]
        rows = [(i, c) for i, c in rows if c.any()]
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(rows), np.int32)), pa.array([i for i, _ in rows], pa.int64()), none, pa.nulls(len(rows), pa.binary()), pa.array([c.tobytes() for _, c in rows], pa.binary())], names=["kind", "doc_id", "n", "print", "point"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, np.uint32).astype(np.uint64)
                total[i] = total[i] + part if i in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["at", "counts"])

    spark = docs.sparkSession
    path = shared_path(spark, "points")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows.mapInArrow(run, "kind int, doc_id long, n long, print binary, point binary").write.partitionBy("kind").option("compression", "zstd").parquet(path)
    read = spark.read.schema("doc_id long, n long, print binary, point binary, kind int").parquet(path)
    parts = read.where("kind = 1").select(F.col("doc_id").alias("at"), F.col("point").alias("counts"))
    sketch = np.zeros(cells, np.uint64)
    for r in parts.repartition(max(1, cells // CHUNK // 4), "at").mapInArrow(add, "at long, counts binary").collect():
        sketch[r["at"] * CHUNK : (r["at"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.uint64)
    return read.where("kind = 0").drop("kind"), np.minimum(sketch, np.iinfo(np.uint32).max).astype(np.uint32)


def prefixes(docs: DataFrame, k: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """shingle, salt, rank and doc_id of the prefix of each document; each task emits equal sets once.

    Shingles that the sketch counts more than HOT times are dealt out over several salts.
    """
    cells = len(sketch)
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        counts = held.value
        seen: set[bytes] = set()
        for b in batches:
            found, owners, salts, ranks = [], [], [], []
            for doc_id, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                s = shingle_set(t, k)
                mark = xxhash.xxh3_128_digest(s.tobytes())
                if not len(s) or mark in seen:
                    continue
                seen.add(mark)
                often = counts[_cells(s, cells)]
                length = len(s) - -(-percent * len(s) // 100) + 1
                first = np.argsort(often, kind="stable")[:length]  # ties by hash: s is in order
                found.append(s[first])
                owners.append(np.full(length, doc_id, np.int64))
                ranks.append(np.arange(length, dtype=np.int32))
                n = often[first] // HOT
                salts.append(np.where(n > 0, 1 + hash(doc_id) % np.maximum(n, 1), 0).astype(np.int32))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(salts)), pa.array(np.concatenate(ranks)), pa.array(np.concatenate(owners))], names=["shingle", "salt", "rank", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "shingle long, salt int, rank int, doc_id long")


def _overlap(s: np.ndarray, t: np.ndarray) -> int:
    at = np.searchsorted(t, s)
    return int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(t) else 0


def reaches(overlap, union, percent: int):
    return 100 * overlap >= percent * union


def verify(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs(a, b) of which the whole shingle sets reach the threshold.

    An `a` travels once for each LINKS of its pairs, however many it has; a `b` once for each pair.
    """

    def check(batches):
        last, held = None, []
        for batch in batches:
            one, two = [], []
            for a, salt, b, text in zip(*(batch.column(i).to_pylist() for i in range(3)), text_bytes(batch.column(3)), strict=True):
                if (a, salt) != last:
                    last, held = (a, salt), []
                s = shingle_set(text, k)
                if b is None:
                    held.append(s)
                elif any(reaches(both := _overlap(s, t), len(s) + len(t) - both, percent) for t in held):
                    one.append(a)
                    two.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])

    wanted = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
    chosen = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id", "left_semi")
    often = pairs.groupBy("a").agg(F.ceil(F.count("*") / LINKS).alias("salts"))
    dealt = pairs.join(often, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b")
    centres = dealt.select("a", "salt").distinct().join(texts.select(F.col("doc_id").alias("a"), "text"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    others = dealt.join(texts.select(F.col("doc_id").alias("b"), "text"), "b").select("a", "salt", "b", "text")
    rows = centres.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    return rows.mapInArrow(check, "a long, b long")


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose points leave the threshold possible."""

    def check(batches):
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
            x, y = _points(b.column(4)), _points(b.column(5))
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64) + np.minimum(_left_out(x, n), _left_out(y, m))
            keep = pa.array(reaches(most, n + m - most, percent))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    one = pairs.join(points.select(F.col("doc_id").alias("a"), F.col("n"), F.col("point").alias("x")), "a")
    both = one.join(points.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("point").alias("y")), "b")
    near = both.where((100 * F.col("n") >= percent * F.col("m")) & (100 * F.col("m") >= percent * F.col("n")))
    return near.select("a", "b", "n", "m", "x", "y").mapInArrow(check, "a long, b long").distinct()


class RTree:
    """Points packed in order of size into boxes of FANOUT, the boxes into larger boxes, up to one."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.levels = [(points, _left_out(points, sizes), sizes, sizes)]
        while len(self.levels[-1][2]) > 1:
            upper, out, low, high = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.maximum.reduceat(upper, at), np.maximum.reduceat(out, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def pairs(self, percent: int, keep_pairs=None):
        """Chunks of index pairs (i < j) whose bound reaches the threshold, found from the root downwards.

        `keep_pairs(i, j)`, where given, says which pairs of points are wanted at all.
        """
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, p, q = stack.pop()
            if len(p) > 1 << 15:
                for i in range(0, len(p), 1 << 15):
                    stack.append((level, p[i : i + (1 << 15)], q[i : i + (1 << 15)]))
                continue
            upper, out, low, high = self.levels[level]
            keep = p < q if level == 0 else p <= q
            keep &= (100 * high[p] >= percent * low[q]) & (100 * high[q] >= percent * low[p])
            p, q = p[keep], q[keep]
            if level == 0 and keep_pairs is not None:
                keep = keep_pairs(p, q)
                p, q = p[keep], q[keep]
            most = np.minimum(upper[p], upper[q]).sum(axis=1, dtype=np.int64) + np.minimum(out[p], out[q])
            keep = (100 + percent) * most >= percent * (low[p] + low[q])
            p, q = p[keep], q[keep]
            if level == 0:
                yield p, q
            elif len(p):
                children, step = len(self.levels[level - 1][2]), np.arange(FANOUT)
                x = (p[:, None] * FANOUT + step)[:, :, None] + np.zeros(FANOUT, np.int64)
                y = (q[:, None] * FANOUT + step)[:, None, :] + np.zeros((FANOUT, 1), np.int64)
                x, y = x.reshape(-1), y.reshape(-1)
                inside = (x < children) & (y < children)
                stack.append((level - 1, x[inside], y[inside]))


class _Run:
    """The rows of one pair of tiles (i, j) of one tree: doc, comp, n, tile, rank, before, points and, later, sets."""

    def __init__(self, i: int, j: int, parts: list[tuple]):
        doc, comp, n, tile, rank, before, points, sets = (np.concatenate(x) if isinstance(x[0], np.ndarray) else [y for z in x for y in z] for x in zip(*parts, strict=True))
        order = np.argsort(n, kind="stable")
        self.doc, self.comp, self.n, self.tile, self.before, self.points = doc[order], comp[order], n[order], tile[order], before[order], points[order]
        self.rest = self.n - rank[order]  # shingles from this one on
        self.sets = [sets[k] for k in order] if sets else None
        self.apart = i != j

    def wanted(self, percent: int):
        def keep(p, q):
            ok = (self.comp[p] != self.comp[q]) & ((self.before[p] != self.before[q]) | (self.before[p] == 0))
            if self.apart:
                ok &= self.tile[p] != self.tile[q]
            return ok & ((100 + percent) * np.minimum(self.rest[p], self.rest[q]) >= percent * (self.n[p] + self.n[q]))

        return keep

    def pairs(self, percent: int):
        return RTree(self.points, self.n).pairs(percent, self.wanted(percent))

    def links(self, percent: int):
        """Verified pairs that join what no other pair before them did."""
        names, root = np.unique(self.comp, return_inverse=True)
        for p, q in self.pairs(percent):
            for x, y in zip(p.tolist(), q.tolist(), strict=True):
                if root[x] == root[y]:
                    continue
                s, t = self.sets[x], self.sets[y]
                both = _overlap(s, t)
                if reaches(both, len(s) + len(t) - both, percent):
                    root[root == root[y]] = root[x]
                    yield min(self.doc[x], self.doc[y]), max(self.doc[x], self.doc[y])


SEARCHED = "shingle long, i int, j int, a long, b long"
_SEARCHED = pa.schema([("shingle", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _runs(batches):
    """(shingle, i, j) and the run of each from rows sorted by them."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        shingle, i, j, doc, comp, n, tile, rank, before = (batch.column(x).to_numpy() for x in range(9))
        points = _points(batch.column(9))
        sets = [np.frombuffer(x, np.uint64) for x in batch.column(10).to_pylist()] if batch.num_columns > 10 else []
        cuts = np.flatnonzero((np.diff(shingle) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        for s, e in zip([0, *cuts], [*cuts, len(shingle)], strict=True):
            mine = (int(shingle[s]), int(i[s]), int(j[s]))
            if key is not None and mine != key:
                yield key, _Run(*key[1:], held)
                held = []
            key = mine
            held.append((doc[s:e], comp[s:e], n[s:e], tile[s:e], rank[s:e], before[s:e], points[s:e], sets[s:e]))
    if held:
        yield key, _Run(*key[1:], held)


def _out(key: tuple, a, b) -> pa.RecordBatch:
    k = len(a)
    return pa.RecordBatch.from_arrays([pa.array([x] * k, t) for x, t in zip(key, _SEARCHED.types, strict=False)] + [pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_SEARCHED)


def _search(percent: int, dense: float = 1.0):
    """Surviving pairs of each run; of a run with more than `dense` of them a point only the key, with null ends."""

    def run(batches):
        for key, rows in _runs(batches):
            a, b, found = [], [], 0
            for p, q in rows.pairs(percent):
                found += len(p)
                if found > dense * len(rows.n):
                    break
                a += np.minimum(rows.doc[p], rows.doc[q]).tolist()
                b += np.maximum(rows.doc[p], rows.doc[q]).tolist()
            yield _out(key, [None], [None]) if found > dense * len(rows.n) else _out(key, a, b)

    return run


def _settle(percent: int):
    """Links of each run from rows that carry their shingle sets, at most one fewer than points."""

    def run(batches):
        for key, rows in _runs(batches):
            found = list(rows.links(percent))
            yield _out(key, [x for x, _ in found], [y for _, y in found])

    return run


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and its shingles in order, as bytes."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, k).tobytes() for t in text_bytes(b.column(1))], pa.binary())], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def tiled(rows: DataFrame, percent: int, tile: int) -> DataFrame:
    """rows, once for each pair of tiles (i, j) of their tree that may hold pairs of them.

    Tiles are runs of up to a weight of `tile` by size; two meet only if their sizes may reach the threshold.
    """
    small = rows.where(F.col("m") <= tile).withColumns({"tile": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    large = with_tiles(rows.where(F.col("m") > tile), tile)
    spans = large.groupBy("shingle", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    one, two = spans.alias("one"), spans.alias("two")
    meet = one.join(two, (F.col("one.shingle") == F.col("two.shingle")) & (F.col("one.tile") <= F.col("two.tile")) & (100 * F.col("one.high") >= percent * F.col("two.low")))
    pairs = meet.select(F.col("one.shingle").alias("shingle"), F.col("one.tile").alias("i"), F.col("two.tile").alias("j"))
    sides = pairs.select("shingle", F.col("i").alias("tile"), "i", "j").union(pairs.where("i <> j").select("shingle", F.col("j").alias("tile"), "i", "j"))
    names = ["shingle", "i", "j", "class_id", "component", "n", "tile", "rank", "before", "point"]
    return small.select(*names).unionByName(large.join(sides, ["shingle", "tile"]).select(*names))


def with_tiles(rows: DataFrame, tile: int) -> DataFrame:
    """rows with their tile: by size within the tree, without a task that sees a whole tree.

    A tree's sizes are counted first; a size's rows are dealt over as many tiles as they fill.
    """
    sizes = rows.groupBy("shingle", "n").agg(F.sum("weight").alias("same"))
    upto = Window.partitionBy("shingle").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("same").over(upto), F.lit(0)))
    spread = F.pmod(F.xxhash64("class_id"), F.col("same"))
    return rows.join(starts, ["shingle", "n"]).withColumn("tile", F.floor((F.col("start") + spread) / tile).cast("int")).drop("same", "start")


def _by_tile(rows: DataFrame, work) -> DataFrame:
    return rows.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j").mapInArrow(work, SEARCHED)


def join(docs: DataFrame, k: int = 5, percent: int = 80, tile: int = TILE, dense: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id, n_shingles, class_id and component_id of each document; verified pairs (a, b) of classes."""
    points, sketch = describe(docs, k, sketch_cells(docs))
    several = points.groupBy("doc_id").agg((F.min("print") != F.max("print")).alias("several"))
    known = stored(points.select("doc_id", "n", "print").join(several, "doc_id"), "prints")
    classes = known.where("n > 0 and not several").groupBy("print", "n").agg(F.min("doc_id").alias("class_id"))
    own = F.when(F.col("several"), F.col("doc_id")).otherwise(F.coalesce("class_id", "doc_id"))
    members = stored(known.join(classes, ["print", "n"], "left").select("doc_id", "n", "several", own.alias("class_id")), "members")
    same = Window.partitionBy("shingle", "salt").orderBy("doc_id")
    beside = F.lag("doc_id").over(same).isNotNull() | F.lead("doc_id").over(same).isNotNull()
    shared = prefixes(docs, k, percent, sketch).withColumn("shared", beside | (F.col("salt") > 0)).where("shared").select("shingle", "rank", "doc_id")
    nodes = members.groupBy("doc_id", "class_id").agg(F.max("n").alias("n"), F.max("several").alias("several"))
    held = shared.join(nodes, "doc_id").groupBy("class_id", "shingle").agg(F.min("rank").alias("rank"), (F.floor(F.max("n") / WEIGHT) + 1).alias("weight"), F.max("several").alias("several"))
    along = Window.partitionBy("class_id").orderBy("rank")
    before = F.when(F.col("several"), 0).otherwise(F.coalesce(F.lag("shingle").over(along), F.lit(0)))
    held = held.withColumn("before", before).withColumn("rank", F.when(F.col("several"), 0).otherwise(F.col("rank"))).drop("several")
    held = stored(held, "held")
    trees = held.groupBy("shingle").agg(F.count("*").alias("m"), F.min("before").alias("x"), F.max("before").alias("y")).where("m > 1 and (x <> y or x = 0)")
    blocks = stored(held.join(trees.select("shingle"), "shingle"), "blocks")
    first = blocks.groupBy("shingle").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a <> z")
    stars = stored(blocks.join(first, "shingle").select("a", F.col("class_id").alias("b")).where("a <> b").distinct(), "stars")
    equal = known.groupBy("print", "n").agg(F.min("doc_id").alias("a"), F.max("several").alias("any")).where("n > 0 and any").select("print", "a")
    twins = known.where("several").join(equal, "print").select("a", F.col("doc_id").alias("b")).where("a <> b")
    links = verify(docs, stored(bounded(stars, points, percent), "survivors"), k, percent)
    links = stored(links.unionByName(twins).distinct(), "links")
    placed = stored(components(links), "components")

    def component(rows: DataFrame) -> DataFrame:
        found = placed.select(F.col("node").alias("class_id"), "component")
        return rows.join(found, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))

    now = component(blocks)
    mixed = now.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.sum("weight").alias("m")).where("x <> y").select("shingle", "m")
    left = stored(now.join(mixed, "shingle"), "unresolved")
    if left.limit(1).count():
        rows = stored(tiled(left.join(points.select(F.col("doc_id").alias("class_id"), "n", "point"), "class_id"), percent, tile), "tiled")
        found = stored(_by_tile(rows, _search(percent, dense)), "found")
        full = found.where("a is null").select("shingle", "i", "j")
        pairs = found.where("a is not null").select("a", "b").distinct()
        more = verify(docs, stored(pairs.join(stars, ["a", "b"], "left_anti"), "survivors"), k, percent)
        if full.limit(1).count():
            again = rows.join(full, ["shingle", "i", "j"])
            wanted = again.select(F.col("class_id").alias("doc_id")).distinct()
            texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id", "left_semi")
            sets = shingle_sets(texts, k).select(F.col("doc_id").alias("class_id"), "shingles")
            more = more.unionByName(_by_tile(again.join(sets, "class_id").select(*rows.columns, "shingles"), _settle(percent)).select("a", "b"))
        links = links.unionByName(stored(more.distinct(), "links"))
        placed = stored(components(links), "components")
    out = component(members).select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.col("component").alias("component_id"))
    return out, links


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of each document."""
    return join(docs, k, percent)[0]
