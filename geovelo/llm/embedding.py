"""Embedding near-duplicates: PCA-ordered tiled comparison.

Distinct vectors are rotated onto the principal axes and cut into tiles along the leading ones. Two tiles meet only if their
boxes come close enough; there, products of the leading coordinates plus the product of the suffix norms bound the cosine, and
only pairs whose bound reaches the threshold get more coordinates and at last the exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_ids, stored
from .components import components

COSINE = 0.95
#: Distinct vectors of a tile at most, tiles that the split plans at most, sampled vectors a tile, leading axes that tiles are cut and boxed by.
PER_TILE, MAX_TILES, SAMPLE, AXES = 16_384, 4096, 64, 4
#: Numbers of a tile's vectors at most, so that long vectors make smaller tiles.
TILE_NUMBERS = 1 << 21
#: Leading coordinates after which bounds are taken.
STEPS = (16, 32)
#: Room for rounding in single-precision bounds; exact cosines decide.
SLACK = 1e-4
_ROWS, _HITS = 512, 1 << 18


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Columns: eigenvectors of the unit vectors' second moments, largest first. dim * dim sums are added up on the executors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            u = _unit(_matrix(batch.column(0), dim))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["at", "x"])

    rows = vectors.select("embedding").mapInArrow(moments, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(dim * dim)
    for r in rows:
        total[r["at"]] = r["x"]
    return np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1].copy()


class Tiles:
    """Median cuts along the axis of largest spread among the leading ones; leaves are tiles."""

    def __init__(self, sample: np.ndarray, tiles: int):
        self.leaves = 0
        self.root = self._grow(sample, tiles)

    def _grow(self, sample: np.ndarray, tiles: int):
        if tiles > 1 and len(sample) > 2:
            axis = int(np.ptp(sample, axis=0).argmax())
            at = float(np.median(sample[:, axis]))
            low = sample[:, axis] < at
            if low.any() and not low.all():
                return (axis, at, self._grow(sample[low], tiles // 2), self._grow(sample[~low], tiles - tiles // 2))
        self.leaves += 1
        return self.leaves - 1

    def place(self, lead: np.ndarray) -> np.ndarray:
        out = np.empty(len(lead), np.int64)

        def walk(node, rows: np.ndarray) -> None:
            if isinstance(node, int):
                out[rows] = node
                return
            axis, at, low, high = node
            below = lead[rows, axis] < at
            walk(low, rows[below])
            walk(high, rows[~below])

        walk(self.root, np.arange(len(lead)))
        return out


def _close(a: np.ndarray, b: np.ndarray, same: bool, axes: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of pairs with an exact cosine of at least least, some at a time; of one tile with itself each pair once. a, b: unit vectors. Single precision only in bounds."""
    ra, rb = (a @ axes).astype(np.float32), (b @ axes).astype(np.float32)
    rest = lambda r, k: np.sqrt((r[:, k:].astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)
    steps = [k for k in STEPS if k < a.shape[1]] or [a.shape[1]]
    # the suffix norms as one more coordinate: the product is then the bound itself
    lead_a, lead_b = (np.concatenate((r[:, : steps[0]], rest(r, steps[0])[:, None]), axis=1) for r in (ra, rb))
    tails = [(k, rest(ra, k), rest(rb, k)) for k in steps[1:]]
    for at in range(0, len(a), _ROWS):
        from_ = at if same else 0
        bound = lead_a[at : at + _ROWS] @ lead_b[from_:].T
        hit = np.flatnonzero(bound.ravel() >= least - SLACK)
        for lo in range(0, len(hit), _HITS):
            i, j = np.divmod(hit[lo : lo + _HITS], bound.shape[1])
            i, j = i + at, j + from_
            if same:
                i, j = i[j > i], j[j > i]
            for k, ta, tb in tails:
                keep = np.einsum("ij,ij->i", ra[i, :k], rb[j, :k]) + ta[i] * tb[j] >= least - SLACK
                i, j = i[keep], j[keep]
            exact = np.einsum("ij,ij->i", a[i], b[j]) >= least
            if exact.any():
                yield i[exact], j[exact]


def _merged(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """low, the smallest position known to be reachable, after links between the positions i and j are added."""
    a, b = low[i], low[j]
    a, b = a[a != b], b[a != b]
    if not len(a):
        return low
    root = np.arange(len(low))
    while True:
        new = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            return root[low]
        root = new


def _compare(pair: pd.DataFrame, axes: np.ndarray, least: float) -> pd.DataFrame:
    """Rows (a, b, links): a's vector linked to those of class b (links null: an edge of the forest), or links of class a found here (b null). Links are added up as they are found and never held."""
    sides = [pair[pair["side"] == s] for s in (0, 1)]
    a, b = (_unit(np.array(x["embedding"].tolist(), np.float64)) if len(x) else np.zeros((0, len(axes))) for x in sides)
    same = not len(b)
    ids = np.concatenate([x["cid"].to_numpy() for x in sides])
    n = np.concatenate([x["n"].to_numpy() for x in sides])
    links, low = np.zeros(len(ids)), np.arange(len(ids))
    for i, j in _close(a, a if same else b, same, axes, least):
        j = j if same else j + len(a)
        links += np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
        low = _merged(low, i, j)
    edge, some = np.flatnonzero(low != np.arange(len(ids))), np.flatnonzero(links)
    return pd.DataFrame({"a": np.concatenate((ids[edge], ids[some])), "b": pd.array([*ids[low[edge]], *[None] * len(some)], "Int64"), "links": np.concatenate((np.zeros(len(edge)), links[some])).astype(np.int64)})


class Boxes:
    """The tiles' boxes and parts: a tile of more than per_tile rows has several parts, all with its box. Some 100 bytes a part."""

    def __init__(self, rows: list, least: float, per_tile: int):
        self.least, self.first, self.parts = least, {}, {}
        low, high = [], []
        for row in rows:
            k = max(1, -(-row["rows"] // per_tile))
            self.first[row["tile"]], self.parts[row["tile"]] = len(low), k
            low += [row["lo"]] * k
            high += [row["hi"]] * k
        self.low, self.high = np.array(low, float), np.array(high, float)

    def met(self, part: int) -> Iterator[tuple[int, int]]:
        """(pair, side) of each pair of parts that part takes part in: those whose boxes come close enough."""
        gap = np.maximum(0, np.maximum(self.low - self.high[part], self.low[part] - self.high))
        for other in np.flatnonzero((gap * gap).sum(axis=1) <= 2 - 2 * self.least + 1e-9).tolist():
            yield min(part, other) * len(self.low) + max(part, other), int(part > other)


def _links(classes: DataFrame, dim: int, least: float, per_tile: int) -> DataFrame:
    """(a, b, links) as _compare gives them, over all classes (cid, n, embedding) of one dimension. A few numbers a sampled vector and a tile reach the driver."""
    axes = principal_axes(classes, dim)
    per_tile = min(per_tile, max(256, TILE_NUMBERS // dim))
    tiles = min(MAX_TILES, max(1, -(-classes.count() // per_tile)))
    wide = min(AXES, dim)

    def leads(column: pa.Array) -> np.ndarray:
        return _unit(_matrix(column, dim)) @ axes[:, :wide]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in leads(batch.column(0)).T.copy()], [f"x{k}" for k in range(wide)])

    sample = np.zeros((0, wide))
    if tiles > 1:
        chosen = classes.join(F.broadcast(bounded_ids(classes.select("cid"), "cid", tiles * SAMPLE)), "cid").select("embedding")
        told = chosen.mapInArrow(projected, ", ".join(f"x{k} double" for k in range(wide))).toArrow()
        sample = np.stack([c.to_numpy() for c in told.columns], axis=1)
        sample = sample[np.lexsort(sample.T)]
    cuts = Tiles(sample, tiles)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = leads(batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts.place(lead)), pa.array(list(lead), pa.list_(pa.float64()))], ["cid", "n", "embedding", "tile", "lead"])

    dealt = stored(classes.select("cid", "n", "embedding").mapInArrow(placed, "cid bigint, n bigint, embedding array<double>, tile bigint, lead array<double>"), "tiles")
    edge = lambda f: F.array(*[f(F.col("lead")[k]) for k in range(wide)])
    boxes = Boxes(dealt.groupBy("tile").agg(F.count("*").alias("rows"), edge(F.min).alias("lo"), edge(F.max).alias("hi")).orderBy("tile").collect(), least, per_tile)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, tile = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 3))
            first, many = (np.array([x[t] for t in tile.tolist()], np.int64) for x in (boxes.first, boxes.parts))
            part = first + cid % many
            for p in np.unique(part).tolist():
                own = batch.filter(pa.array(part == p)).select([0, 1, 2])
                for pair, side in boxes.met(p):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(own.num_rows, pair)), pa.array(np.full(own.num_rows, side)), *own.columns], ["pair", "side", "cid", "n", "embedding"])

    met = dealt.mapInArrow(paired, "pair bigint, side bigint, cid bigint, n bigint, embedding array<double>")
    return met.groupBy("pair").applyInPandas(lambda x: _compare(x, axes, least), "a bigint, b bigint, links bigint")


def near_duplicates(vectors: DataFrame, least: float = COSINE, per_tile: int = PER_TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding).

    n_links: other rows with a cosine of least or more; component_id: smallest vec_id reachable over links, itself included;
    kept: vec_id = component_id. Null and zero vectors and those with null or non-finite components link with nothing, and
    so do vectors of different lengths with each other. Equal vectors are one class that is compared once, so copies are
    counted, not expanded. A null vec_id counts as a link of others; where no vec_id is reachable component_id is null and the row is kept.
    Repeated rows link like others; vectors of any finite size are compared in double precision. An empty table gives an empty result; other columns are ignored.
    """
    x = F.col("embedding")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("key", F.when(sound, F.xxhash64("embedding")))
    classes = rows.where("key IS NOT NULL").groupBy("key", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    dims = sorted(r[0] for r in classes.select(F.size("embedding")).distinct().collect())
    found = None
    for dim in dims:
        part = _links(classes.where(F.size("embedding") == dim), dim, least, per_tile)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "vector-links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "cid")
    rooted = classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    told = rooted.join(lows, "root").join(links, "cid", "left").select("key", "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    whole = rows.where("key IS NOT NULL").join(told, ["key", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    every = whole.unionByName(alone)
    return every.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
