"""Approximate nearest neighbours by a forest of random-projection trees (operator 2).

Equal vectors are one class. Trees are fitted on the driver to a bounded sample: a node projects on the
difference of two of its points and splits at the median, so all leaves hold about as many rows. Every
class is put in one leaf of each tree. A query walks all trees at once through one priority queue, ordered by
how narrowly it missed a branch, and opens as many leaves as a calibration on the sample found to be needed
for RECALL. Queries then travel to the leaves, where candidates are ranked exactly; each
partition keeps the best of each query, and a last step merges those.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import staged

TREES = 4
#: Classes that the trees are fitted on and the search is calibrated with, at most.
SAMPLE = 32_768
#: Sample classes used as queries to calibrate the search.
TRIALS = 256
#: Share of true neighbours that the calibrated search finds in the sample.
RECALL = 0.97
#: Up to so many classes there is one leaf, and the search is exact.
ONE_LEAF = 1024
#: Queries for which a task holds results before it sends them on.
HELD = 50_000
#: Queries that meet in a leaf at a time, about: leaves with more get their candidates several times, once for each part of the queries.
MEETING = 8192
#: Products in another order of addition may differ by so much: what is so near to the last kept one is ranked exactly too.
ROUNDING = 1e-9


@dataclass
class Forest:
    """Complete binary trees; node i's children are 2i+1 and 2i+2, leaf numbers count from zero."""

    depth: int
    normals: np.ndarray  # tree x inner node x dimension
    cuts: np.ndarray  # tree x inner node
    leaves: int = 1  # that a search opens

    def place(self, x: np.ndarray) -> np.ndarray:
        """tree x row: the leaf of each unit vector."""
        out = []
        for normals, cuts in zip(self.normals, self.cuts, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (np.einsum("ij,ij->i", x, normals[at]) > cuts[at])
            out.append(at - (2**self.depth - 1))
        return np.array(out).reshape(len(self.cuts), len(x))

    def open(self, q: np.ndarray, leaves: int | None = None) -> list[tuple[int, int]]:
        """The ``(tree, leaf)`` that a query visits, in order: one queue for all trees, widest margin first."""
        inner = 2**self.depth - 1
        sides = (self.normals @ q - self.cuts).tolist() if inner else [[]] * len(self.cuts)
        queue = [(-np.inf, t, 0) for t in range(len(self.cuts))]
        found: list[tuple[int, int]] = []
        most = self.leaves if leaves is None else leaves
        while queue and len(found) < most:
            worst, t, i = heapq.heappop(queue)
            while i < inner:  # the queue gets the branch not taken
                side = sides[t][i]
                near, far = (2 * i + 2, 2 * i + 1) if side > 0 else (2 * i + 1, 2 * i + 2)
                heapq.heappush(queue, (max(worst, abs(side)), t, far))
                i = near
            found.append((t, i - inner))
        return found


def fit(x: np.ndarray, rows: int, k: int, seed: int = 5) -> Forest:
    """Trees over the unit vectors ``x``, a sample of ``rows``, and the number of leaves to open."""
    n, dim = x.shape
    depth = 0 if rows <= ONE_LEAF else max(1, int(np.log2(np.sqrt(rows) / 2) + 0.5))
    depth = min(depth, int(np.log2(max(1, n / 8))))
    trees = TREES if depth else 1
    inner = 2**depth - 1
    r = np.random.default_rng(seed)
    normals, cuts = np.zeros((trees, inner, dim)), np.zeros((trees, inner))
    for t in range(trees):
        at = np.zeros(n, np.int64)
        for level in range(depth):
            for i in range(2**level - 1, 2 ** (level + 1) - 1):
                here = np.flatnonzero(at == i)
                normal = r.normal(size=dim)
                if len(here) > 1:
                    a, b = x[r.choice(here, 2, replace=False)]
                    if (length := np.linalg.norm(a - b)) > 1e-12:
                        normal = (a - b) / length
                normals[t, i] = normal
                cuts[t, i] = np.median(x[here] @ normal) if len(here) else 0.0
            at = 2 * at + 1 + (np.einsum("ij,ij->i", x, normals[t][at]) > cuts[t][at])
    forest = Forest(depth, normals, cuts)
    total = trees * 2**depth
    if total == 1:
        return forest
    trials = r.choice(n, min(TRIALS, n), replace=False)
    place = forest.place(x)
    best = np.argsort(-np.where(np.arange(n)[None] == trials[:, None], -9.0, x[trials] @ x.T), 1)[:, :k]
    needed = []  # leaf visits after which each true neighbour has been met
    for q, true in zip(trials, best, strict=True):
        visit = np.full((trees, 2**depth), total)
        for v, (t, leaf) in enumerate(forest.open(x[q], total)):
            visit[t, leaf] = v + 1
        needed.append(visit[np.arange(trees)[:, None], place[:, true]].min(0))
    forest.leaves = int(np.quantile(np.concatenate(needed), RECALL, method="higher"))
    return forest


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every row for which ``queries`` holds, by cosine.

    Rank counts from one; ties go to the smaller id; a row is no neighbour of itself, but its copies are.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do
    rows without an id, nor vectors of another length than that of the smallest id. With fewer than ``k``
    candidates all are returned. Repeated rows of one id are one row if their vectors agree. An empty table
    gives an empty result; other columns are not read.
    """
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), queries.alias("asks")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(sound)
    dim = rows.agg(F.min_by(F.size("v"), "id")).first()[0]
    schema = "query_id long, rank int, vec_id long, score double"
    if dim is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("v") == dim)
    few = rows.select("id", "v").distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = staged(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.get("ids", 0).alias("class"), "v", "ids"), "classes")
    asking = rows.where("asks").select("id", "v").distinct().join(classes.select("class", "v"), "v").select(F.col("id").alias("query_id"), "class")
    asking = staged(asking, "asking")
    n = classes.count()
    sample = classes.select("class", "v")
    if n > SAMPLE:
        sample = sample.where(F.pmod(F.xxhash64("class"), F.lit(1 << 30)) < int(SAMPLE * 0.98 / n * (1 << 30)))
    drawn = sample.toArrow().sort_by("class")
    forest = fit(_unit(_vectors(drawn.column("v").combine_chunks())), n, k)
    keep = 2 * (k + 1)
    cuts = max(1, -(-asking.select("class").distinct().count() * forest.leaves // (forest.cuts.shape[0] * 2**forest.depth * MEETING)))

    def deal(kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                unit = _unit(_vectors(b.column(1)))
                if kind:
                    place = forest.place(unit)
                    trees, row, cut = (x.ravel() for x in np.indices((*place.shape, cuts)))
                    leaf = np.repeat(place.ravel(), cuts)
                else:
                    opened = [forest.open(q) for q in unit]
                    row = np.repeat(np.arange(len(opened)), list(map(len, opened)))
                    trees, leaf = np.array([x for o in opened for x in o]).T
                    cut = b.column(0).to_numpy()[row] % cuts
                for s in range(0, len(row), 4096):
                    part = pa.array(row[s : s + 4096])
                    columns = [pa.array(trees[s : s + 4096].astype(np.int32)), pa.array(leaf[s : s + 4096].astype(np.int64)), pa.array(cut[s : s + 4096].astype(np.int64)), pa.array(np.full(len(part), kind, np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, b.column(0).take(part), b.column(1).take(part)], names=["tree", "leaf", "cut", "kind", "class", "v"])

        return run

    dealt = "tree int, leaf long, cut long, kind int, class long, v array<double>"
    base = classes.select("class", "v")
    asked = base.join(asking.select("class").distinct(), "class", "left_semi")
    both = base.mapInArrow(deal(1), dealt).unionByName(asked.mapInArrow(deal(0), dealt))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # query: its best classes and their scores

        def out() -> pa.RecordBatch:
            size = [len(c) for c, _ in best.values()]
            columns = [np.repeat(np.array(list(best), np.int64), size), np.concatenate([c for c, _ in best.values()]), np.concatenate([s for _, s in best.values()])]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query", "class", "score"])

        here, ids, qs = None, np.empty(0, np.int64), np.empty((0, dim))
        for b in batches:
            if not b.num_rows:
                continue
            leaf = np.stack([b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy(), b.column(2).to_numpy()], 1)
            kind, names, x = b.column(3).to_numpy(), b.column(4).to_numpy(), _vectors(b.column(5))
            starts = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]).any(1)])
            for s, e in zip(starts, np.r_[starts[1:], len(kind)], strict=True):
                if here is None or not np.array_equal(leaf[s], here):
                    here, ids, qs = leaf[s], np.empty(0, np.int64), np.empty((0, dim))
                m = s + int((kind[s:e] == 0).sum())
                if m > s:
                    ids, qs = np.r_[ids, names[s:m]], np.r_[qs, x[s:m]]
                if m == e or not len(ids):
                    continue
                near = _unit(qs) @ _unit(x[m:e]).T
                last = np.partition(near, -keep, 1)[:, -keep] if near.shape[1] > keep else np.full(len(ids), -np.inf)
                for q, vector, chosen in zip(ids.tolist(), qs, near >= last[:, None] - ROUNDING, strict=True):
                    c, score = names[m:e][chosen], cosine(x[m:e][chosen], vector)
                    if q in best:
                        c, score = np.r_[best[q][0], c], np.r_[best[q][1], score]
                        c, first = np.unique(c, return_index=True)
                        score = score[first]
                    order = np.lexsort((c, -score))[:keep]
                    best[q] = (c[order], score[order])
            if len(best) > HELD:
                yield out()
                best.clear()
        if best:
            yield out()

    ranked = both.repartition("tree", "leaf", "cut").sortWithinPartitions("tree", "leaf", "cut", "kind").mapInArrow(rank, "query long, class long, score double")
    met = ranked.groupBy("query", "class").agg(F.max("score").alias("score"))
    near_classes = met.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))).where(F.col("r") <= keep)
    spread = near_classes.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    first = spread.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    own = asking.select("query_id", F.col("class").alias("query")).join(first.select("query", "vec_id", "score"), "query").where("vec_id <> query_id")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
