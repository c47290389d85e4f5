"""SimHash near-duplicates through vantage-point trees (operator 7).

Fingerprints are made of word shingles in Arrow batches.  Equal fingerprints are
one point.  A vantage-point tree over a bounded sample of the points deals all
points to shards: a node holds a vantage point and a radius, and points within
the radius go to the inner branch.  A point whose distance to the vantage point is
within half of the maximum distance of the radius goes to both branches: by the
triangle inequality two points that part there are further from one another.  So
each close pair meets in a shard, and nothing is lost.  Inside a shard a tree of
its own is searched.

A shard hands on a spanning forest of its close pairs (at most one link for each
point), so groups of thousands of near copies give links, not pairs.  Components
of the links are found by :mod:`flowtrace.llm.components`.

Defined results: text without a word (also null or empty) has fingerprint zero
and is linked like any other; repeated rows get one result each; the component of
rows without any non-null id is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtrace.llm.common import map_batches, materialise, small_batches
from flowtrace.llm.components import components

SHINGLE_WORDS, MAX_DISTANCE, SEED = 3, 2, 42
#: One in SAMPLED points, and no more than SAMPLE_POINTS, is in the sample that the top tree is fitted on.
SAMPLED, SAMPLE_POINTS = 1 << 9, 1 << 20
#: Points that a shard should hold; the top tree is as deep as that takes.
SHARD_POINTS = 1 << 14
#: Sample points that each fitted node must rest on at least.
LEAF_SAMPLE = 16
#: Radius around the fixed vantage points of levels below the fitted ones: half of 64 bits, less the middle.
DEEP_RADIUS = 31
#: Points in a leaf of a shard's own tree.
LEAF_POINTS = 256


def fingerprint(text: bytes, n: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text in UTF-8: the majority of the shingle hashes in every bit."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= n:
        return hashed(b" ".join(words), SEED)
    joined, starts, at = b" ".join(words), [0], 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    made = np.fromiter([hashed(joined[a:b - 1], SEED) for a, b in zip(starts, starts[n:])], "<u8")  # noqa: B905
    ones = np.zeros(64, "i8")
    for a in range(0, len(made), 1 << 16):  # bits of a very long text in blocks
        ones += np.unpackbits(made[a:a + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > len(made), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text_col: str = "text", n: int = SHINGLE_WORDS) -> DataFrame:
    """``df`` in a struct column ``row`` and ``fp``, the 64 bits as a signed bigint."""
    small_batches(df.sparkSession)

    def made(batch: pa.RecordBatch) -> dict[str, object]:
        values = np.array([fingerprint(t, n) for t in batch.column("text").to_pylist()], "u8")
        return {"fp": pa.array(values.view("i8"))}

    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    return map_batches(df.select(row, text), made, "fp bigint").drop("text")


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


class TopTree:
    """The tree that deals points to shards: arrays of vantage points and radii in heap order.

    The sample decides the upper levels.  Where more are needed to keep shards
    small, each level below has one vantage point for all its nodes, from a
    seeded generator, so the tree is small however many shards there are.
    """

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth, self.fitted = depth, 0
        while self.fitted < depth and len(sample) >> self.fitted > LEAF_SAMPLE:
            self.fitted += 1
        self.vantage, self.radius = np.zeros(1 << self.fitted, "u8"), np.full(1 << self.fitted, 64, "i8")
        self.deep = np.random.default_rng(SEED).integers(0, 1 << 64, depth - self.fitted, "u8")
        self._fit(np.unique(sample), 1)

    def _fit(self, points: np.ndarray, node: int) -> None:
        if node >= 1 << self.fitted or not len(points):
            return
        vantage = points[0]
        away = distances(points, vantage)
        radius = int(np.median(away))
        self.vantage[node], self.radius[node] = vantage, radius
        self._fit(points[away <= radius][1:], 2 * node)
        self._fit(points[away > radius], 2 * node + 1)

    def deal(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, shard) for every shard of a point; two points within ``reach`` have one in common.

        A point goes to both branches if it is within half of ``reach`` of the
        border.  Points that part at a node differ in their distances to its
        vantage point, and so from one another, by more than ``reach``.
        """
        which, node, half = np.arange(len(points)), np.ones(len(points), "i8"), (reach + 1) // 2
        for level in range(self.depth):
            fitted = level < self.fitted
            vantage = self.vantage[node] if fitted else self.deep[level - self.fitted]
            radius = self.radius[node] if fitted else DEEP_RADIUS
            away = np.bitwise_count(points[which] ^ vantage).astype("i8")
            inner, outer = away - half <= radius, away + half > radius
            which = np.concatenate([which[inner], which[outer]])
            node = np.concatenate([2 * node[inner], 2 * node[outer] + 1])
        return which, node - (1 << self.depth)


def close_pairs(points: np.ndarray, queries: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (point index, query index) with at most ``reach`` differing bits, by a vantage-point tree."""
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        mine, asking = todo.pop()
        if not len(mine) or not len(asking):
            continue
        vantage = points[mine[0]]
        away = distances(points[mine], vantage).astype("i8")
        radius = int(np.median(away))
        inside = away <= radius
        if len(mine) <= LEAF_POINTS or inside.all():
            step = max(1, (1 << 22) // len(mine))
            for a in range(0, len(asking), step):
                block = asking[a:a + step]
                p, q = np.nonzero(np.bitwise_count(points[mine][:, None] ^ queries[block][None, :]) <= reach)
                yield mine[p], block[q]
            continue
        seen = distances(queries[asking], vantage).astype("i8")
        todo.append((mine[inside], asking[seen - reach <= radius]))
        todo.append((mine[~inside], asking[seen + reach > radius]))


def forest(points: np.ndarray, reach: int) -> np.ndarray:
    """For every point the index of the least point that it is connected to."""
    root = np.arange(len(points))
    for a, b in close_pairs(points, points, reach):
        while True:  # hook the roots of the ends onto one another, then halve the paths
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart]))
            while (root[root] != root).any():
                root = root[root]
    return root


def _links(points: DataFrame, reach: int, top: TopTree) -> DataFrame:
    """Links (u, v) between points within ``reach``, as spanning forests of the shards."""

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column("fp").to_numpy(zero_copy_only=False).view("u8")
        which, shard = top.deal(values, reach)
        return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(values[which].view("i8"))], names=["shard", "fp"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield deal(batch)

    def search(shard: pa.Table) -> pa.Table:
        values = np.sort(shard.column("fp").to_numpy().view("u8"))
        root = forest(values, reach)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": values[linked].view("i8"), "v": values[root[linked]].view("i8")})

    return (points.mapInArrow(dealt, "shard bigint, fp bigint")
            .groupBy("shard").applyInArrow(search, "u bigint, v bigint"))


def groups(rows: DataFrame, reach: int = MAX_DISTANCE) -> DataFrame:
    """``fp``, ``least`` (least id with it), ``component_id`` and ``root`` (least fingerprint of the component) for every
    fingerprint of ``rows`` (doc_id, fp)."""
    points = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    total = points.count()
    # the smallest hashes: the same sample every time, and one of all points
    size = min(SAMPLE_POINTS, total // SAMPLED)
    sample = [r.fp for r in points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(size).collect()] if size else []
    depth = 0
    while total >> depth > SHARD_POINTS:
        depth += 1
    top = TopTree(np.array(sample, "i8").view("u8"), depth)
    roots = components(_links(points.select("fp"), reach, top)).withColumnRenamed("vertex", "fp")
    of_point = points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = roots.join(points, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    return of_point.join(linked, "root", "left").select(
        "fp", "least", F.coalesce("component_id", "least").alias("component_id"), "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS,
                    reach: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (least id reachable over links of at most ``reach`` bits) of every row."""
    ids = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialise(fingerprints(ids, n=n).select("row.doc_id", "fp"))
    return rows.join(groups(rows, reach).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS,
             reach: int = MAX_DISTANCE) -> DataFrame:
    """One row of each near-duplicate group of ``df``: that of the least id, with the columns of ``df``.

    Of several rows with that id one stays; a row without an id stays only if no
    row of its group has one.
    """
    ids = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialise(fingerprints(ids, n=n).select("row.doc_id", "fp"))
    found = groups(rows, reach).filter(F.col("least").eqNullSafe(F.col("component_id")))
    # of several fingerprints that have the least id, the least one
    keep = found.groupBy("root", "component_id").agg(F.min("fp").alias("fp"))
    whole = fingerprints(df, text_col, n)
    kept = whole.join(keep, (whole.fp == keep.fp) & whole.row[id_col].eqNullSafe(keep.component_id), "left_semi")
    return kept.select("row", "fp", F.col(f"row.`{id_col}`").alias("id")).dropDuplicates(["fp", "id"]).select("row.*")
