"""SimHash near-duplicates: fingerprints in Arrow batches, exact Hamming links by a sharded vantage-point tree.

Fingerprints are cut into shards by a small vantage-point tree over a bounded sample. A fingerprint
lives in one shard; where the triangle inequality allows a neighbour on the far side of a ball it is
also sent there as a query. A shard that holds many is compared in tiles of bounded size. Each tile prunes
further with its own vantage points, so every pair within the radius is met, and gives out a spanning forest instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded_ids, packed, pieces, stored, unpacked, unused, utf8
from .components import components

RADIUS = 2
SHINGLE = 3
#: For the corpus pipeline, which has no digest to agree with: words of a shingle, least Jaccard similarity, bits in which each of the two SimHashes of a similar pair may differ:
#: they differ in 10 of 64 on average and in more than 24 for about one pair in a million of similarity 0.8.
NEAR = {"size": 5, "similarity": 0.8, "radius": 24}
#: Shingles from which SimHashes are compared; cells of the shingles' counts (1 MB as broadcast); nodes of a part of a tile, whose texts a task holds.
PRINTED, CELLS, PER_SET_TILE = 32, 1 << 17, 1024
#: Nodes of a tile from which a vantage point divides them; nodes of which one is taken as that, and others by which it is chosen.
LEAF, TRIED_HERE, LOOKED_AT = 8, 4, 64
#: Hubs of a node that tell which tile a pair belongs to; a value that no hub has.
FEW, NO_HUB = 4, np.iinfo(np.int64).max
#: Distinct fingerprints for which one shard is planned, shards at most, sampled fingerprints a shard: the sample that reaches the driver is at most MAX_SHARDS * SAMPLE numbers.
PER_SHARD, MAX_SHARDS, SAMPLE = 8192, 4096, 64
#: Residents, and as many queries, that one task compares at most, about; shards that hold more are cut into tiles.
PER_TILE = 32_768
#: Sampled fingerprints that are tried as a ball's vantage point; least share of the sample on either side of it.
TRIED, SIDE = 16, 0.3
#: What a fingerprint is in a tile: compared with all others there, only asking those that live there, or only asked.
BOTH, ASKS, ASKED = 0, 1, 2
_STEP = 1 << 15
#: Where the counts of each of a hash's eight bytes begin, and the bits of each byte value.
_PLACE, _BITS = 256 * np.arange(8), np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is 1 if set in over half of its shingles' XXH64 values."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    n = max(1, len(words) - size + 1)
    ends = ends[min(size, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        cuts = map(slice, starts[at : min(n, at + _STEP)].tolist(), ends[at : at + _STEP].tolist())
        hashes = np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, cuts), repeat(42)), np.uint64, min(n - at, _STEP))
        seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
        ones += (seen.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches):
        prints = np.array([fingerprint(x) for x in utf8(part.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp bigint) for every row of docs; null and wordless texts have fingerprint 0."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


@F.arrow_udf(T.LongType())
def _print(texts: pa.Array, size: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x, size[0].as_py()) for at in range(0, len(texts), 256) for x in utf8(texts[at : at + 256])], np.uint64).view(np.int64))


class Router:
    """Vantage-point tree whose leaves are shards: inner nodes (vantage point, ball radius, inside, outside)."""

    def __init__(self, sample: np.ndarray, shards: int, radius: int = RADIUS):
        self.leaves, self.radius = 0, radius
        self.root = self._grow(np.unique(sample), shards)

    def _grow(self, sample: np.ndarray, shards: int):
        cut = self._ball(sample) if shards > 1 and len(sample) > 2 else None
        if cut:
            vantage, ball = cut
            inside = np.bitwise_count(sample ^ vantage) <= ball
            near = min(shards - 1, max(1, round(shards * float(inside.mean()))))
            return (vantage, ball, self._grow(sample[inside], near), self._grow(sample[~inside], shards - near))
        self.leaves += 1
        return self.leaves - 1

    def _ball(self, sample: np.ndarray) -> tuple[np.uint64, int] | None:
        """The vantage point and ball with the fewest sampled fingerprints near the border, on either side of which SIDE of the sample lies; None if there is no such ball."""
        best, found = len(sample) + 1, None
        for vantage in sample[:: max(1, len(sample) // TRIED)]:
            upto = np.cumsum(np.bincount(np.bitwise_count(sample ^ vantage), minlength=65))
            beyond, below = np.full(self.radius, upto[-1]), np.zeros(self.radius, int)
            border = np.concatenate((upto[self.radius :], beyond)) - np.concatenate((below, upto[: len(upto) - self.radius]))
            border[np.minimum(upto, upto[-1] - upto) < SIDE * len(sample)] = len(sample) + 1
            if border.min() < best:
                best, found = int(border.min()), (vantage, int(border.argmin()))
        return found

    def route(self, prints: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(shard, positions in prints, whether they live there or only ask there)."""

        def walk(node, live: np.ndarray, ask: np.ndarray):
            if isinstance(node, int):
                yield from ((node, x, k) for x, k in ((live, True), (ask, False)) if len(x))
                return
            vantage, ball, inside, outside = node
            d_live, d_ask = (np.bitwise_count(prints[x] ^ vantage).astype(np.int16) for x in (live, ask))
            yield from walk(inside, live[d_live <= ball], ask[d_ask <= ball + radius])
            # a pair over the border is met outside: those that live just inside ask there
            border = live[(d_live <= ball) & (d_live > ball - radius)]
            yield from walk(outside, live[d_live > ball], np.concatenate((ask[d_ask > ball - radius], border)))

        yield from walk(self.root, np.arange(len(prints)), np.arange(0))


def _linked(home: np.ndarray, query: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """(n, 2) arrays of positions: a forest over all links between a home and a query position (home is part of query)."""
    if len(home) > 256:
        vantage = prints[home[0]]
        d_home, d_query = (np.bitwise_count(prints[x] ^ vantage).astype(np.int16) for x in (home, query))
        ball = int(np.median(d_home))
        inside = d_home <= ball
        if max(inside.sum(), (~inside).sum()) < 0.95 * len(home):
            yield from _linked(home[inside], query[d_query <= ball + radius], prints, radius)
            yield from _linked(home[~inside], query[d_query > ball - radius], prints, radius)
            return
    for at in range(0, len(home), 512):
        h = home[at : at + 512]
        for of in range(0, len(query), 4096):
            q = query[of : of + 4096]
            close = np.bitwise_count(prints[h][:, None] ^ prints[q][None, :]) <= radius
            close &= h[:, None] != q[None, :]
            rows, cols = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
            if not len(rows):
                continue
            close, h1, q1 = close[np.ix_(rows, cols)], h[rows], q[cols]
            low_h, low_q = h1.copy(), q1.copy()
            while True:  # the smallest position that each one reaches in this tile
                new_q = np.minimum(low_q, np.where(close, low_h[:, None], len(prints)).min(axis=0))
                new_h = np.minimum(low_h, np.where(close, new_q[None, :], len(prints)).min(axis=1))
                if (new_q == low_q).all() and (new_h == low_h).all():
                    break
                low_h, low_q = new_h, new_q
            pairs = np.concatenate((np.stack((h1, low_h), 1), np.stack((q1, low_q), 1)))
            yield np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


class Tiles:
    """Tiles of shards: a shard's residents and queries are cut by hash into parts of about most rows, and each part of the residents meets each other one and each part of the queries."""

    def __init__(self, sizes: dict[tuple[int, bool], int], most: int):
        self.parts: dict[int, tuple[int, int, int]] = {}  # by shard: its first tile, parts of its residents, parts of its queries
        first = 0
        for shard in sorted({s for s, _ in sizes}):
            lives, asks = (max(1, -(-sizes.get((shard, k), 0) // most)) for k in (True, False))
            self.parts[shard] = (first, lives, asks)
            first += lives * (lives + asks)

    def deal(self, shard: int, prints: np.ndarray, live: bool) -> Iterator[tuple[int, np.ndarray, int]]:
        """(tile, positions in prints, what they are there). Queries of the first part share the tiles in which a part of the residents meets itself."""
        first, lives, asks = self.parts[shard]
        wide = lives + asks
        part = (prints * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % (lives if live else asks)
        for p in np.unique(part).tolist():
            at = np.flatnonzero(part == p)
            if live:
                yield first + p * wide + p, at, BOTH
                yield from ((first + p * wide + q, at, ASKED) for q in (*range(p + 1, lives), *range(lives + 1, wide)))
                yield from ((first + q * wide + p, at, ASKS) for q in range(p))
            else:
                yield from ((first + q * wide + (lives + p if p else q), at, ASKS) for q in range(lives))


def _tile_links(tile: pd.DataFrame, radius: int = RADIUS) -> pd.DataFrame:
    tile = tile.sort_values(["role", "fp"])
    prints, role = tile["fp"].to_numpy(np.int64).view(np.uint64), tile["role"].to_numpy()
    found = list(_linked(np.flatnonzero(role != ASKS), np.flatnonzero(role != ASKED), prints, radius))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), int)
    values = prints.view(np.int64)
    return pd.DataFrame({"a": values[pairs[:, 0]], "b": values[pairs[:, 1]]})


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what links within radius connect. prints: distinct column fp.

    Two counts a shard reach the driver; no task gets more than about 2 * PER_TILE rows, however many fingerprints lie close together.
    """
    n = prints.count()
    shards = min(MAX_SHARDS, max(1, -(-n // PER_SHARD)))
    sample = [x[0] for x in bounded_ids(prints, "fp", shards * SAMPLE).collect()] if shards > 1 else []
    router = Router(np.array(sample, np.int64).view(np.uint64), shards, radius)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, bool], int] = {}
        for batch in batches:
            for shard, at, live in router.route(_unsigned(batch), radius):
                total[shard, live] = total.get((shard, live), 0) + len(at)
        yield pa.RecordBatch.from_pylist([{"shard": s, "live": k, "n": x} for (s, k), x in total.items()], schema=pa.schema([("shard", pa.int32()), ("live", pa.bool_()), ("n", pa.int64())]))

    if shards > 1:
        sums = prints.select("fp").mapInArrow(counted, "shard int, live boolean, n bigint").groupBy("shard", "live").agg(F.sum("n").alias("n"))
        sizes = {(r["shard"], r["live"]): r["n"] for r in sums.collect()}
    else:
        sizes = {(0, True): n}
    tiles = Tiles(sizes, PER_TILE)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _unsigned(batch)
            for shard, at, live in router.route(values, radius):
                for tile, own, role in tiles.deal(shard, values[at], live):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), tile)), pa.array(values[at[own]].view(np.int64)), pa.array(np.full(len(own), role, np.int8))], ["tile", "fp", "role"])

    met = prints.select("fp").mapInArrow(dealt, "tile bigint, fp bigint, role tinyint")
    return met.groupBy("tile").applyInPandas(lambda x: _tile_links(x, radius), "a bigint, b bigint")


def _unsigned(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the smallest doc_id reachable over links of at most radius differing bits, the
    document itself included. Null and empty texts have fingerprint zero and link like any other;
    repeated rows and ties share a component; a component whose doc_ids are all null has a null
    component_id; an empty table gives an empty result; other columns of docs are ignored.
    Exact copies of a fingerprint are one node, so a large group of copies costs one row.
    """
    each = stored(fingerprints(docs), "fingerprints")
    classes = stored(each.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-classes")
    roots = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return each.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def sketch(text: bytes | None, size: int, similarity: float, cells: np.ndarray) -> tuple[int, int, int, bytes, list[int]]:
    """Of a text's distinct shingles: two independent 64-bit SimHashes, their number, 16 bytes that are equal for equal sets, and their prefix."""
    from xxhash import xxh3_128_digest

    found = _shingles(text, size)
    if not len(found):
        return 0, 0, 0, b"", []
    mixed = found ^ (found >> np.uint64(30))
    mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    first, second = (_majority(x) for x in (found, mixed ^ (mixed >> np.uint64(31))))
    return first, second, len(found), xxh3_128_digest(found.tobytes()), _prefix(found, similarity, cells).view(np.int64).tolist()


def _shingles(text: bytes | None, size: int) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's shingles of size words."""
    from xxhash import xxh64_intdigest

    words = (text or b"").decode("utf-8", "replace").lower().encode().split()
    told = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else ()
    return np.unique(np.fromiter((xxh64_intdigest(x, 42) for x in told), np.uint64, len(told)))


def _prefix(found: np.ndarray, similarity: float, cells: np.ndarray | None = None) -> np.ndarray:
    """The shingles that come first in one order of all shingles: by the magnitude of their cell's count, then by hash. Two similar sets share at least one of them, whatever the counts are."""
    take = len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1 if len(found) else 0
    if cells is None:
        return found[:take]
    often = np.frexp(cells[_cell(found, len(cells))])[1]
    return found[np.lexsort((found, often))[:take]]


def _cell(found: np.ndarray, cells: int) -> np.ndarray:
    """Each hash's cell; cells: a power of two."""
    return (found * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        seen = np.bincount((hashes[at : at + _STEP].view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
        ones += (seen.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _frequencies(docs: DataFrame, size: int, similarity: float) -> np.ndarray:
    """For each of CELLS cells of shingles, how often they stand in a prefix by hash alone, over all documents. CELLS numbers reach the driver, and no task gives more."""
    cells = CELLS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for part in pieces(batches):
            found = np.concatenate([_prefix(_shingles(x, size), similarity) for x in utf8(part.column(0))])
            np.add.at(total, _cell(found, cells), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    sums = docs.select("text").mapInArrow(counted, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells)
    out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return out


def _sketches(size: int, similarity: float, cells):
    """A column function: text -> what sketch() tells. cells: broadcast."""

    @F.arrow_udf(T.StructType([T.StructField(n, t) for n, t in (("fp", T.LongType()), ("more", T.LongType()), ("n", T.LongType()), ("digest", T.BinaryType()), ("prefix", T.ArrayType(T.LongType())))]))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [sketch(x, size, similarity, cells.value) for at in range(0, len(texts), 256) for x in utf8(texts[at : at + 256])]
            one, two, n, digest, prefix = zip(*rows, strict=True) if rows else ((),) * 5
            prints = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]
            yield pa.StructArray.from_arrays([*prints, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], ["fp", "more", "n", "digest", "prefix"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, which come one after the other."""
    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
        keys = table.column(0).to_numpy()
        ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
            yield table.slice(lo, hi - lo)
        left = table.slice(int(ends[-1])) if len(ends) else table
    if left is not None and left.num_rows:
        yield left


def _may_link(of: int, to: np.ndarray, n: np.ndarray, one: np.ndarray, two: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """Those of the positions to that may be similar to the position of: by the sizes and, for sets large enough for it to tell, by both SimHashes."""
    most = np.maximum(n[of], n[to])
    fits = np.minimum(n[of], n[to]) >= similarity * most - 1e-9
    fits &= (most < PRINTED) | (np.bitwise_count(one[of] ^ one[to]) <= radius) & (np.bitwise_count(two[of] ^ two[to]) <= radius)
    return to[fits]


def _asked(side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(position, the positions it is compared with), so that each pair of a tile meets once: of one part (side null or all equal) all pairs, of two parts those between them."""
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for x in first.tolist():
        yield x, second if len(second) else first[first > x]


def _owned(hub: np.int64, of: int, to: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Those of the positions to whose pair with of belongs to this hub: the smallest that both have among their few. A pair without such a hub belongs to all that it meets in."""
    told = few[to]
    common = np.where((told[:, :, None] == few[of][None, None, :]).any(axis=2) & (told != NO_HUB), told, NO_HUB).min(axis=1, initial=NO_HUB)
    return to[(common == NO_HUB) | (common == hub)]


def _candidates(batches: Iterator[pa.RecordBatch], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """The rows (tile, side, node, n, fp, more) of each tile that may be similar to another one of it and belong there with it. Further columns: hub, few."""
    for rows in _runs(batches):
        n, one, two = rows.column("n").to_numpy(), *(rows.column(c).to_numpy().view(np.uint64) for c in ("fp", "more"))
        few = np.full((len(n), FEW), NO_HUB)
        lists = rows.column("few").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        few[np.arange(FEW) < size[:, None]] = lists.flatten().to_numpy()
        hub = rows.column("hub").to_numpy()
        keep = np.zeros(len(n), bool)
        for x, others in _asked(rows.column("side").to_numpy()):
            near = _owned(hub[x], x, _may_link(x, others, n, one, two, radius, similarity), few)
            keep[near] = True
            keep[x] |= len(near) > 0
        if keep.any():
            yield from rows.filter(pa.array(keep)).drop_columns(["hub", "few"]).to_batches()


def _alike(batches: Iterator[pa.RecordBatch], size: int, radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Edges (a, b): a forest over the pairs of each tile whose Jaccard similarity of shingles reaches similarity. Columns: tile, side, node, n, fp, more, packed.

    Each tile is searched by a vantage-point tree over exact Jaccard distances, in which pairs further apart than the triangle inequality allows don't meet.
    """
    for rows in _runs(batches):
        node, n, one, two = rows.column("node").to_numpy(), rows.column("n").to_numpy(), *(rows.column(c).to_numpy().view(np.uint64) for c in ("fp", "more"))
        sets = [_shingles(x, size) for x in unpacked(rows.column("packed"))]
        flat, ends = np.concatenate(sets), np.cumsum([0, *map(len, sets)])

        def apart(x: int, to: np.ndarray) -> np.ndarray:
            length = n[to]  # of each one's shingles, how many x has
            starts = np.cumsum(length) - length
            told = flat[np.arange(length.sum()) + np.repeat(ends[to] - starts, length)]
            own = sets[x]
            held = own[np.minimum(np.searchsorted(own, told), len(own) - 1)] == told
            common = np.add.reduceat(held.astype(np.int64), starts)
            return 1 - common / (n[x] + length - common)

        fits = lambda x, to: _may_link(x, to, n, one, two, radius, similarity)  # noqa: B023, E731
        tree = Balls(apart, fits, len(node), 1 - similarity + 1e-12)
        side = rows.column("side").to_numpy()
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        tree.search(first, second if len(second) else first, not len(second))
        if tree.found:
            ab = node[np.array(tree.found)]
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])


class Balls:
    """Links of one tile by a vantage-point tree over a metric; found is a forest of pairs (positions) that connects what pairs within reach connect.

    apart(x, to): exact distances. fits(x, to): those of to that may be within reach of x at all, by cheaper means.
    """

    def __init__(self, apart, fits, size: int, reach: float):
        self.apart, self.fits, self.reach, self.label = apart, fits, reach, np.arange(size)
        self.found: list[tuple[int, int]] = []

    def search(self, home: np.ndarray, query: np.ndarray, alone: bool) -> None:
        """Links each one of home with those of query within reach. alone: the tile is one part, so each pair has both of its ends in home somewhere and is compared from the smaller one.

        A ball around a vantage point divides home; a query goes to each side that its own ball of reach touches. The ball is the one after which the fewest pairs meet;
        where none leaves out a twentieth of them, the pairs are compared. The vantage point is compared with all that may be near it by that, and leaves.
        """
        todo = [(home, query)]
        while todo:
            home, query = todo.pop()
            if not len(home) or not len(query) or (self.label[query] == self.label[home[0]]).all() and (self.label[home] == self.label[home[0]]).all():
                continue
            cut = self._ball(home, query) if len(home) > LEAF else None
            if cut:
                todo += cut
                continue
            for x in home.tolist():
                others = query[(self.label[query] != self.label[x]) & ((query > x) | (not alone))]
                others = self.fits(x, others)
                if len(others):
                    self._link(x, others[self.apart(x, others) <= self.reach])

    def _ball(self, home: np.ndarray, query: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """(home, query) inside and outside of a ball around a vantage point, which is linked and left out; None if no ball pays. Of a few nodes the one that may be near most of some others is taken."""
        some = query[:: -(-len(query) // LOOKED_AT)]
        vantage = max(home[:: -(-len(home) // TRIED_HERE)].tolist(), key=lambda x: len(self.fits(x, some)))
        both = np.union1d(home, query)
        far = np.full(len(self.label), np.inf)
        far[both] = self.apart(vantage, both)
        near = query[(far[query] <= self.reach) & (query != vantage)]
        self._link(vantage, self.fits(vantage, near))
        home, query = home[home != vantage], query[query != vantage]
        slack = self.reach + 1e-9  # for rounding
        ball, asked = np.sort(far[home]), np.sort(far[query])
        inside = np.searchsorted(ball, ball, "right")
        pairs = inside * np.searchsorted(asked, ball + slack, "right") + (len(home) - inside) * (len(query) - np.searchsorted(asked, ball - slack, "left"))
        if pairs.min() > 0.95 * len(home) * len(query):
            return None
        r = ball[pairs.argmin()]
        return [(home[far[home] <= r], query[far[query] <= r + slack]), (home[far[home] > r], query[far[query] >= r - slack])]

    def _link(self, x: int, linked: np.ndarray) -> None:
        linked = linked[self.label[linked] != self.label[x]]
        for y in linked[np.unique(self.label[linked], return_index=True)[1]].tolist():
            self.found.append((x, y))
            self.label[self.label == self.label[y]] = self.label[x]


def _dealt(postings: DataFrame, similarity: float) -> DataFrame:
    """(tile, side, node, hub, few): tiles of at most 2 * PER_SET_TILE nodes in which all nodes meet that share a shingle and are of like size. postings: node, n, shingle.

    few: a node's FEW smallest hubs, by which a pair that meets in several tiles is told to belong to one.
    A shingle is named by the smallest set that has it, so near copies, which share many shingles, meet in a few tiles and not once a shingle, while a long text doesn't draw all
    that share anything with it into one tile. Names with many nodes are cut by size first: similar sets are in the same band of sizes or in neighbouring ones.
    """
    held = Window.partitionBy("shingle")
    named = postings.select("node", "n", F.min(F.struct("n", "node")).over(held)["node"].alias("hub"), F.count("*").over(held).alias("many"))
    met = stored(named.where("many > 1").select("hub", "node", "n").distinct(), "hub-nodes")
    large = stored(met.groupBy("hub").agg(F.count("*").alias("many")).where(F.col("many") > PER_SET_TILE).select("hub", F.lit(True).alias("large")), "large-hubs")
    band = F.floor(F.log(F.col("n").cast("double")) / -float(np.log(similarity)) * (1 - 1e-9)).cast("int")
    bands = F.when(F.col("large"), F.array(band, band + 1)).otherwise(F.array(F.lit(-1)))
    banded = met.join(large, "hub", "left").select("hub", "node", F.explode(bands).alias("band"))
    sizes = banded.groupBy("hub", "band").agg(F.count("*").alias("many")).where(F.col("many") > PER_SET_TILE)
    cut = banded.join(stored(sizes, "large-tiles"), ["hub", "band"], "left").withColumn("parts", F.ceil(F.coalesce("many", F.lit(1)) / PER_SET_TILE).cast("int"))
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    other = cut.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.xxhash64("hub", "band", F.least("part", "other"), F.greatest("part", "other"))
    few = met.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("hub")), 1, FEW).alias("few"))
    return other.select(tile.alias("tile"), (F.col("part") > F.col("other")).cast("int").alias("side"), "node", "hub").join(few, "node")


def _only(each: DataFrame, kept: DataFrame, row: str) -> DataFrame:
    """The rows of each whose number is in kept, by bitmaps of the numbers (4 KB for 32,768 of them) that go to every task, so that no text is shuffled."""
    bucket, bits = unused(each, "_bucket"), unused(each, "_bits")
    maps = kept.groupBy(F.bitmap_bucket_number(F.col(row)).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(row))).alias(bits))
    place = F.bitmap_bit_position(F.col(row))
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return each.join(F.broadcast(maps), (F.bitmap_bucket_number(F.col(row)) == F.col(bucket)) & (F.floor(byte / F.pow(F.lit(2.0), place % 8)) % 2 == 1), "left_semi")


def drop_similar(docs: DataFrame, similarity: float, size: int, radius: int) -> DataFrame:
    """docs with exactly one row of each group that links of similarity connect, chosen as drop_near_duplicates() does.

    Two texts are linked if the Jaccard similarity of their sets of shingles of size lower-cased words reaches similarity. Texts with equal sets are one node, wordless
    ones among them. At 0.8 SimHashes differ in some 10 of 64 bits, at which a ball of random fingerprints can never be left out; so nodes are dealt to tiles by
    shingles of their prefixes, a fifth of each set, of which similar sets share at least one. Frequent shingles come last in the prefixes' order. In a tile both SimHashes
    and sizes rule pairs out (sets of fewer than PRINTED shingles by size alone), then a vantage-point tree over exact Jaccard distances by the triangle inequality, then the whole texts' exact similarity. Null texts count as
    empty; repeated rows are one node; very long texts are compared whole; an empty table gives an empty result.
    """
    row = unused(docs, "_row")
    each = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    cells = docs.sparkSession.sparkContext.broadcast(_frequencies(each, size, similarity))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")
    told = each.select("doc_id", F.col(row).alias("row"), _sketches(size, similarity, cells)("text").alias("s")).select("doc_id", "row", "s.*")
    sets = told.groupBy("fp", "more", "n", "digest").agg(best, F.first("prefix").alias("prefix"))
    nodes = stored(sets.select(F.col("best.row").alias("node"), "fp", "more", "n", "best", "prefix"), "shingle-sets")
    # sets of so few shingles are similar only if they are equal
    wide = nodes.where(F.col("n") > int(similarity / (1 - similarity) - 1e-6)) if similarity < 1 else nodes.where("false")
    tiles = _dealt(wide.select("node", "n", F.explode("prefix").alias("shingle")), similarity).join(wide.select("node", "n", "fp", "more"), "node")
    slim = tiles.select("tile", "side", "node", "n", "fp", "more", "hub", "few").repartition("tile").sortWithinPartitions("tile")
    near = stored(slim.mapInArrow(lambda x: _candidates(x, radius, similarity), slim.drop("hub", "few").schema), "near-nodes")
    ends = stored(near.select(F.col("node").alias(row)).distinct(), "near-ends")
    texts = stored(each.select(row, "text").join(ends, row, "left_semi").select(F.col(row).alias("node"), packed("text").alias("packed")), "near-texts")
    met = near.join(texts, "node").select(*near.columns, "packed").repartition("tile").sortWithinPartitions("tile")
    edges = met.mapInArrow(lambda x: _alike(x, size, radius, similarity), "a bigint, b bigint")
    kept = nodes.select("node", "best").join(components(edges), "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("best").alias("best"))
    kept = stored(kept.select(F.col("best.row").alias(row)), "kept-rows")
    return _only(each, kept, row).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """docs with exactly one row of each near-duplicate group: the one with the smallest doc_id. Rows without a doc_id go where any document of their group has one; one of them stays in a group without any.

    Rows are told apart by a number of their own, so doc_ids may be null or stand on several texts.
    Groups are those of near_duplicates() with shingles of size words; if similarity is given, those of drop_similar().
    """
    if similarity is not None:
        return drop_similar(docs, similarity, size, radius)
    row, fp = unused(docs, "_row"), unused(docs, "_fp")
    each = stored(docs.withColumn(fp, _print("text", F.lit(size))).withColumn(row, F.monotonically_increasing_id()), "numbered")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(row).alias("row"))).alias("best")
    classes = stored(each.groupBy(F.col(fp).alias("fp")).agg(best), "fingerprint-classes")
    roots = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    kept = classes.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return _only(each, kept, row).select(*[F.col(f"`{c}`") for c in docs.columns])
