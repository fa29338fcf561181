"""Density clustering of sites within categories, by cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import cut

#: Offsets of the cells that can hold sites within eps of a cell's, cells being a little narrower than eps / sqrt(2): all, and one of each opposite two.
_AROUND = [(x, y) for x in range(-2, 3) for y in range(-2, 3)]
_AHEAD = [(x, y) for x, y in _AROUND if (x, y) > (0, 0)]
_NARROW = 1.4143
#: Levels to which the boxes of two cells are halved; at this one boxes are far below a millimetre.
_LEVELS = 48


def _spread(rows: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """rows once for each offset, with the offset cell as _x, _y."""
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in offsets]))
    return rows.withColumn("_o", each).withColumns({"_x": F.col("x") + F.col("_o.x"), "_y": F.col("y") + F.col("_o.y")}).drop("_o")


def _near(few: DataFrame, many: DataFrame, eps: float) -> DataFrame:
    """Pairs of few and many within eps; few goes to the cells around it."""
    f = _spread(few, _AROUND).select("site_id", F.col("id").alias("_id"), "_x", "_y", F.col("easting").alias("_e"), F.col("northing").alias("_n"))
    m = many.withColumnRenamed("site_id", "other")
    met = f.join(m, (f["_id"] == m["id"]) & (f["_x"] == m["x"]) & (f["_y"] == m["y"]))
    return met.where(F.hypot(F.col("_e") - F.col("easting"), F.col("_n") - F.col("northing")) <= eps)


def _boxes(core: DataFrame) -> DataFrame:
    """Of each cell (id, x, y): its least site_id, the box of its sites, and the sites at the box's four sides."""
    e, n, place = F.col("easting"), F.col("northing"), F.struct("easting", "northing")
    ends = [F.min_by(place, e), F.max_by(place, e), F.min_by(place, n), F.max_by(place, n)]
    return core.groupBy("id", "x", "y").agg(F.min("site_id").alias("low"), F.min(e).alias("e0"), F.max(e).alias("e9"), F.min(n).alias("n0"), F.max(n).alias("n9"), F.array(*ends).alias("ends"))


def _judged(pairs: DataFrame, eps: float) -> DataFrame:
    """pairs of boxes a and b that may be linked, plus linked: two sites at their sides, or the farthest corners, are within eps. Pairs whose boxes are apart go."""
    gap = lambda lo, hi: F.greatest(F.lit(0.0), F.col(f"a.{lo}") - F.col(f"b.{hi}"), F.col(f"b.{lo}") - F.col(f"a.{hi}"))
    span = lambda lo, hi: F.greatest(F.col(f"a.{hi}") - F.col(f"b.{lo}"), F.col(f"b.{hi}") - F.col(f"a.{lo}"))
    apart = lambda p, q: F.hypot(p["easting"] - q["easting"], p["northing"] - q["northing"])
    touch = F.exists("a.ends", lambda p: F.exists("b.ends", lambda q: apart(p, q) <= eps))
    return pairs.where(F.hypot(gap("e0", "e9"), gap("n0", "n9")) <= eps).withColumn("linked", touch | (F.hypot(span("e0", "e9"), span("n0", "n9")) <= eps))


def _linked_cells(core: DataFrame, cells: DataFrame, side: float, eps: float) -> DataFrame:
    """(a, b): least site_ids of cells that hold core sites within eps of each other.

    Cells meet as boxes; pairs of boxes that are neither linked by a pair of sites at their sides nor apart are halved, until all are decided.
    Sites are never paired, so two cells with very many sites cost no more than two with few.
    """
    whole = F.struct(*[F.col(c) for c in ("x", "y", "e0", "e9", "n0", "n9", "ends")])
    sided = cells.select("id", "x", "y", "low", whole.alias("box"))
    left = _spread(sided, _AHEAD).select(F.col("id").alias("_id"), "_x", "_y", F.col("low").alias("la"), F.col("box").alias("a"))
    met = left.join(sided, (F.col("_id") == F.col("id")) & (F.col("_x") == sided["x"]) & (F.col("_y") == sided["y"]))
    state = cut(_judged(met.select("id", "la", F.col("low").alias("lb"), "a", F.col("box").alias("b")), eps))
    links = [state.where("linked").select("la", "lb")]
    for level in range(1, _LEVELS):
        undecided = state.where("NOT linked")
        if undecided.isEmpty():
            break
        parents = undecided.select("id", F.col("a.x").alias("px"), F.col("a.y").alias("py")).unionAll(undecided.select("id", "b.x", "b.y")).distinct()
        at = lambda c, k: F.floor(F.col(c) / side * 2**k)  # noqa: E731, B023
        inside = core.withColumns({"px": at("easting", level - 1), "py": at("northing", level - 1)}).join(parents, ["id", "px", "py"], "left_semi")
        parts = _boxes(inside.withColumns({"x": at("easting", level), "y": at("northing", level)}))
        parts = parts.select("id", F.floor(F.col("x") / 2).alias("px"), F.floor(F.col("y") / 2).alias("py"), whole.alias("box"))
        halves = undecided.select("id", "la", "lb", *[F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "ab" for c in "xy"])
        for s in "ab":
            own = parts.select(F.col("id").alias("_id"), F.col("px").alias("_px"), F.col("py").alias("_py"), F.col("box").alias(s))
            halves = halves.join(own, (F.col("id") == F.col("_id")) & (F.col(f"{s}x") == F.col("_px")) & (F.col(f"{s}y") == F.col("_py"))).drop("_id", "_px", "_py")
        judged = _judged(halves.select("id", "la", "lb", "a", "b"), eps)
        # one link decides for its two cells
        done = F.max("linked").over(Window.partitionBy("la", "lb"))
        state = cut(judged.withColumn("done", done).where("linked = done").drop("done"))
        links.append(state.where("linked").select("la", "lb").distinct())
    else:  # boxes of one site each are decided long before
        raise RuntimeError(f"cells undecided after {_LEVELS} levels")
    return reduce(DataFrame.unionAll, links).select(F.col("la").alias("a"), F.col("lb").alias("b"))


def _lowest(nodes: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """(node, label): the least node that each one is connected with. Each round takes the least label around and then that label's own."""
    both = cut(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels, total = cut(nodes.select("node", F.col("node").alias("label"))), None
    for _ in range(max_rounds):
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label").unionAll(labels)
        near = around.groupBy("node").agg(F.min("label").alias("label"))
        labels = cut(near.join(labels.select(F.col("node").alias("label"), F.col("label").alias("_next")), "label").select("node", F.least("label", "_next").alias("label")))
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def dbscan(sites: DataFrame, id_column: str, min_group: int = 5, eps: float = 15_000.0, max_rounds: int = 100) -> DataFrame:
    """sites plus cluster, per category: -1 for noise, else the rank of the cluster's smallest core site_id, from 0.

    Core sites have min_group sites of their category within eps, themselves included. A site within eps of core
    sites of several clusters goes to the lowest. Categories with fewer sites than min_group are all noise, and so are sites without a category (null or 255) or place.
    site_id must be unique and a whole number.

    Sites fall in cells whose sites are all within eps of each other. Where a cell has min_group sites all are core; only the sites of sparser cells
    are paired, with the sites around them. Clusters are components of cells, not of sites.
    """
    side = eps / _NARROW
    cell = {"x": F.floor(F.col("easting") / side), "y": F.floor(F.col("northing") / side)}
    own = sites.where(F.col(id_column).isNotNull() & (F.col(id_column) != 255) & F.col("easting").isNotNull() & F.col("northing").isNotNull()).select("site_id", F.col(id_column).alias("id"), "easting", "northing").withColumns(cell)
    counts = cut(own.groupBy("id", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    key = ["id", "x", "y"]
    sparse = cut(own.join(counts.where(F.col("n") < min_group).select(*key), key, "left_semi"))
    enough = _near(sparse, own, eps).groupBy("site_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_group).select("site_id")
    full = own.join(counts.where(F.col("n") >= min_group).select(*key), key, "left_semi")
    core = cut(full.unionByName(sparse.join(enough, "site_id", "left_semi")))
    cells = _boxes(core)
    labels = _lowest(cells.select(F.col("low").alias("node")), _linked_cells(core, cells, side, eps), max_rounds)
    named = cut(core.groupBy(*key).agg(F.min("site_id").alias("low")).join(labels.withColumnRenamed("node", "low"), "low").drop("low"))
    of_core = core.join(named, key).select("site_id", *key, "easting", "northing", "label")
    edge = sparse.join(core, "site_id", "left_anti")
    reached = _near(edge, of_core, eps).groupBy("site_id").agg(F.min("label").alias("_label"))
    found = of_core.select("site_id", F.col("label").alias("_label")).unionAll(reached)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("label")) - 1
    ranks = named.select("id", "label").distinct().select(F.col("label").alias("_label"), rank.alias("_rank"))
    return sites.join(found.join(ranks, "_label").select("site_id", "_rank"), "site_id", "left").withColumn("cluster", F.coalesce("_rank", F.lit(-1))).drop("_rank")
