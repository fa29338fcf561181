"""Polygon files in the shapefile format against the same polygons as text."""

import struct

import pytest
from pyspark.sql import functions as F

from geovelo.sources import polygons, shapes

RINGS = {
    7: [[(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]],
    3: [[(10.5, 10), (10.5, 12), (13, 11.25), (10.5, 10)]],
    0: [],
    12: [[(20, 0), (20, 1), (21, 1)]],
}


def _write(folder, kind=5):
    """shp, shx and dbf of RINGS; 0 is a null shape."""
    body, index = b"", b""
    for k, (gid, rings) in enumerate(RINGS.items()):
        points = [p for r in rings for p in r]
        starts = [sum(map(len, rings[:j])) for j in range(len(rings))]
        content = struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points) if gid else struct.pack("<i", 0)
        index += struct.pack(">2i", (100 + len(body)) // 2, len(content) // 2)
        body += struct.pack(">2i", k + 1, len(content) // 2) + content
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + n) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    (folder / "a.shp").write_bytes(head(len(body)) + body)
    (folder / "a.shx").write_bytes(head(len(index)) + index)
    field = lambda name, size: name.ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([size]) + b"\0" * 15
    rows = b"".join(b" " + b"name".ljust(6) + (str(g) if g else "none").rjust(4).encode() for g in RINGS)
    fields = field(b"label", 6) + field(b"gid", 4) + b"\r"
    (folder / "a.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 0, 0, 0, len(RINGS), 32 + len(fields), 11) + fields + rows)
    return str(folder / "a.shp")


@pytest.mark.parametrize("split", [1, 300, 1 << 20])
def test_shapes_equal_the_text_form(spark, tmp_path, split):
    path = _write(tmp_path)
    got = shapes.read_shapes(spark, path, split=split)
    text = [(g, k, "POLYGON (" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in rings) + ")") for k, (g, rings) in enumerate(RINGS.items()) if rings]
    table = spark.createDataFrame(text, "gid int, feature_ord int, w string")
    want = polygons.edges(table, polygons.wkt_rings(F.col("w"))).select("gid", "feature_ord", "x1", "y1", "x2", "y2")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.rdd.getNumPartitions() == {1: 4, 300: 2, 1 << 20: 1}[split]


def test_other_shapes_and_missing_parts_are_errors(spark, tmp_path):
    path = _write(tmp_path)
    with pytest.raises(Exception, match="no field"):
        shapes.read_shapes(spark, path, "height").collect()
    _write(tmp_path, kind=3)
    with pytest.raises(Exception, match="not polygons"):
        shapes.read_shapes(spark, path).collect()
    (tmp_path / "a.shx").write_bytes(b"")
    with pytest.raises(Exception, match="no index"):
        shapes.read_shapes(spark, path).collect()
