"""Centroid clustering by ball k-means, in whole numbers.

Each task sees its share of a cluster as a ball: the centroid and the distance of the farthest member that the task holds. Only
centroids less than twice that radius away can take a member over. Members nearer to their centroid than half the way to
its next neighbour form the stable core and stay unseen; the others lie in annuli between half the ways to one neighbour
and the next and are compared exactly with the neighbours up to theirs. Vectors never cross a shuffle: tasks send sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored

DIM, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: Largest component whose squared distances fit 64 bits at DIM components; larger ones are an error.
LARGEST = 1 << 27
#: Largest component whose products and sums are exact in doubles.
EXACT = 1 << 22
#: Rounds that tasks go through anew from the vectors before the clusters are stored.
REPLAYED = 8
#: Centroids at most, as each task holds them all, and their sums come back in one row a component.
MOST = 10_000


def kept(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of exactly dim finite components, each turned into floor(scale * x) with x as double."""
    e = F.col("embedding").cast("array<double>")
    usable = (F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(e, lambda x: F.floor(x * F.lit(float(scale))))
    large = F.exists(e, lambda x: F.abs(x) * scale >= LARGEST)
    checked = F.when(large, F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}"))).otherwise(scaled)
    return vectors.where(F.coalesce(usable, F.lit(False))).select("vec_id", checked.cast("array<int>").alias("v"))


def first_centroids(rows: DataFrame, dim: int, k: int = CLUSTERS, seed: int = 2) -> np.ndarray:
    """The vectors of the k smallest hashes of seed:vec_id, in that order; of equal ids the smaller vector comes first, null ids count as empty. Each task sends its k smallest."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.orderBy(order, "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in found], np.int64).reshape(len(found), dim)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row of x against each row of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


class Balls:
    """Centroids, and each one's others by distance."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.apart = _squared(centroids, centroids)
        self.order = np.argsort(self.apart, axis=1, kind="stable")

    def all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) by comparison with all centroids; ties go to the smaller number."""
        d = _squared(x, self.centroids)
        best = d.argmin(axis=1)
        return best, d[np.arange(len(x)), best]

    def moved(self, x: np.ndarray, was: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, starting from the clusters that the vectors had before the centroids moved."""
        gap = x - self.centroids[was]
        best, least = was.copy(), (gap * gap).sum(axis=1)
        order = np.argsort(was, kind="stable")
        borders = np.flatnonzero(np.diff(was[order])) + 1
        for rows in np.split(order, borders) if len(order) else []:
            own = int(was[rows[0]])
            radius = int(least[rows].max())
            others = self.order[own][self.order[own] != own]
            # d(x, other) <= d(x, own) needs |own other| <= 2 d(x, own): squared, apart <= 4 d
            ways = self.apart[own][others]
            near = int(np.searchsorted(ways, 4 * radius, side="right"))
            if not near:
                continue
            annulus = np.searchsorted(ways[:near], 4 * least[rows], side="right")
            moving = rows[annulus > 0]  # the others are the stable core
            if not len(moving):
                continue
            reach = annulus[annulus > 0]
            for k in np.unique(reach):
                some = moving[reach == k]
                names = np.sort(np.append(others[:k], own))
                d = _squared(x[some], self.centroids[names])
                at = d.argmin(axis=1)
                best[some], least[some] = names[at], d[np.arange(len(some)), at]
        return best, least


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _followed(x: np.ndarray, was: np.ndarray | None, history: list[Balls]) -> tuple[np.ndarray, np.ndarray]:
    """Clusters and squared distances after all rounds of history."""
    for balls in history:
        was, least = balls.all(x) if was is None else balls.moved(x, was)
    return was, least


def _assigned(batches: Iterator[pa.RecordBatch], history: list[Balls]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Each batch with its vectors, their clusters and squared distances; a column of earlier clusters, if there is one, is the third."""
    for batch in pieces(batches, 4096):
        if batch.num_rows:
            x = _matrix(batch.column(1))
            was = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) if batch.num_columns > 2 else None
            yield (batch, x, *_followed(x, was, history))


def _sums(rows: DataFrame, history: list[Balls]) -> list:
    """(cluster, at, x): sums of all members' components, and at -1 their number. A task sends one row a cluster and component."""
    k, dim = history[-1].centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for _, x, cluster, _ in _assigned(batches, history):
            order = np.argsort(cluster, kind="stable")
            names, starts = np.unique(cluster[order], return_index=True)
            total[names] += np.add.reduceat(np.column_stack((np.ones(len(x), np.int64), x))[order], starts)
        cluster, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(at - 1), pa.array(total[cluster, at])], ["cluster", "at", "x"])

    sent = rows.mapInArrow(run, "cluster bigint, at bigint, x bigint")
    return sent.groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect()


def _with_clusters(rows: DataFrame, history: list[Balls]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, _ in _assigned(batches, history):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32))], ["vec_id", "v", "cluster"])

    return rows.select("vec_id", "v", *rows.columns[2:]).mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, v array<int>, cluster int")


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): one row a usable vector; distances are squared, inertias their sums.

    Vectors that are null, of another length, or hold null or non-finite components are left out. Centroids start as the vectors of the k smallest hashes (all vectors, if there are fewer).
    Each round assigns every vector to its nearest centroid, ties to the smaller number, and replaces each centroid that has members by the floor of their mean, exactly; after the rounds
    vectors are assigned once more. Null and repeated vec_ids and repeated rows are vectors of their own. Equal starting vectors leave the later centroid empty. Components beyond
    LARGEST are an error. An empty table gives an empty result; other columns are ignored.

    A round is one scan that adds up each task's members; a task goes through the rounds since clusters were last stored, at most REPLAYED, so nothing is kept in memory between rounds.
    """
    if k > MOST:
        raise ValueError(f"more than {MOST} clusters")
    rows = stored(kept(vectors, dim, scale), "vectors")
    centroids = first_centroids(rows, dim, k, seed)
    if not len(centroids):
        nothing = "CAST(NULL AS {0})".format
        return rows.select("vec_id", F.expr(nothing("int")).alias("cluster"), *[F.expr(nothing("bigint")).alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.expr(nothing("array<bigint>")).alias("centroid"))
    history = [Balls(centroids)]
    for _ in range(rounds):
        if len(history) > REPLAYED:
            rows = stored(_with_clusters(rows, history[:-1]), "clusters")
            history = history[-1:]
        total = np.zeros((len(centroids), dim + 1), object)
        for r in _sums(rows, history):
            total[r["cluster"], r["at"] + 1] = r["x"]
        centroids = np.array([[x // t[0] for x in t[1:]] if t[0] else c for t, c in zip(total.tolist(), centroids.tolist())], np.int64)
        history.append(Balls(centroids))
    last = history

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, least in _assigned(batches, last):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(least)], ["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    found = stored(rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint"), "assigned")
    sums = {r["cluster"]: r["x"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}
    table = [(c, sums[c], sum(sums.values()), centroids[c].tolist()) for c in sorted(sums)]
    # at most MOST rows of one centroid each
    told = rows.sparkSession.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
