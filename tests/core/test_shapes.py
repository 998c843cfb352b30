"""Chains, contour lines, mended and clipped polygons, blocks of rasters: against hand-made results and plain versions."""

import numpy as np
import pytest

from meridia.functions import mending
from meridia.operators import contours
from meridia.operators.chains import chains
from meridia.sources import raster


# chains


def test_chains_and_rings_are_put_in_order(spark):
    rng = np.random.default_rng(1)
    names = rng.permutation(400).tolist()
    open_, ring, small = names[:200], names[200:350], names[350:353]
    links = list(zip(open_, open_[1:])) + list(zip(ring, ring[1:] + ring[:1])) + list(zip(small, small[1:] + small[:1])) + [(names[360], names[361])] + [(open_[0], open_[1]), (None, 3), (4, None)]
    got = {r.element: (r.chain, r.place, r.closed) for r in chains(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {e: (open_[0], k, False) for k, e in enumerate(open_)} | {names[360]: (names[360], 0, False), names[361]: (names[360], 1, False)}
    for r in (ring, small):
        at = r.index(min(r))
        want |= {e: (min(r), k, True) for k, e in enumerate(r[at:] + r[:at])}
    assert got == want
    assert chains(spark.createDataFrame([], "a long, b long")).count() == 0


def lines_of(spark, grid, levels):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(np.asarray(grid, float))]
    out = {}
    for x in contours.contour_lines(spark.createDataFrame(rows, "r long, c long, v double"), levels).collect():
        out.setdefault((x.level, x.line, x.closed), []).append((x.place, x.row, x.col))
    return {k: [p[1:] for p in sorted(v)] for k, v in out.items()}


def test_a_peak_has_rings_and_an_edge_a_line(spark):
    y, x = np.mgrid[0:21, 0:21]
    found = lines_of(spark, -np.hypot(y - 10, x - 10), [-4.5, -12.0])
    rings = {k: v for k, v in found.items() if k[0] == -4.5}
    assert len(rings) == 1 and [k[2] for k in rings] == [True]
    (points,) = rings.values()
    assert all(abs(np.hypot(r - 10, c - 10) - 4.5) < 0.1 for r, c in points)
    steps = [np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(points, points[1:] + points[:1])]
    assert max(steps) <= np.sqrt(2) and len(points) == len(set(points))
    area = sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(points, points[1:] + points[:1])) / 2
    assert area > 0 and abs(area - np.pi * 4.5**2) < 2  # the peak is on the left
    corners = [v for k, v in found.items() if k[0] == -12.0]
    assert len(corners) == 4 and all(k[2] is False for k in found if k[0] == -12.0)


def test_saddles_and_gaps(spark):
    # v1 and v3 high, the mean above: corners 0 and 2 are cut off; below: 1 and 3 are
    assert len(lines_of(spark, [[0, 10], [10, 0]], [4.0])) == 2
    cut = sorted(tuple(map(tuple, v)) for v in lines_of(spark, [[0, 10], [10, 0]], [4.0]).values())
    assert cut == sorted([((0.4, 0.0), (0.0, 0.4)), ((0.6, 1.0), (1.0, 0.6))]) or {frozenset(v) for v in cut} == {frozenset({(0.4, 0.0), (0.0, 0.4)}), frozenset({(0.6, 1.0), (1.0, 0.6)})}
    low = {frozenset(map(tuple, v)) for v in lines_of(spark, [[0, 10], [10, 0]], [6.0]).values()}
    assert low == {frozenset({(0.0, 0.6), (0.4, 1.0)}), frozenset({(1.0, 0.4), (0.6, 0.0)})}
    assert lines_of(spark, [[0, 10], [np.nan, 10]], [5.0]) == {}
    assert lines_of(spark, [[1, 1], [1, 1]], [1.0, 2.0]) == {}


# polygons

SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]
CASES = {
    "plain": ([SQUARE], "valid", [4], 16.0),
    "closed, with repeated corners": ([[(0, 0), *SQUARE, (0, 0)]], "valid", [4], 16.0),
    "clockwise": ([SQUARE[::-1]], "valid", [4], 16.0),
    "bow-tie": ([[(0, 0), (2, 2), (2, 0), (0, 2)]], "repaired_geometry:Self-intersection[1 1]", [3, 3], 2.0),
    "courtyard": ([SQUARE, [(1, 1), (2, 1), (2, 2), (1, 2)]], "valid", [8], 15.0),
    "courtyard sticks out": ([SQUARE, [(3, 1), (5, 1), (5, 2), (3, 2)]], "repaired_geometry:Self-intersection[4 1]", [4, 8], 16.0),
    "courtyard touches a corner": ([SQUARE, [(0, 0), (2, 1), (1, 2)]], "valid", [7], 14.5),
    "courtyard on the edge": ([SQUARE, [(1, 0), (2, 0), (2, 1), (1, 1)]], "repaired_geometry", [8], 15.0),
    "nested": ([SQUARE, [(1, 1), (3, 1), (3, 3), (1, 3)], [(1.5, 1.5), (2, 1.5), (2, 2), (1.5, 2)]], "valid", [4, 8], 12.25),
    "twice the same": ([SQUARE, SQUARE], "invalid_geometry", [], 0.0),
    "a spike": ([[(0, 0), (2, 0), (2, 1), (5, 1), (2, 1), (2, 2), (0, 2)]], "repaired_geometry", [4], 4.0),
    "touching triangles": ([[(0, 0), (1, 1), (2, 0), (2, 2), (1, 1), (0, 2)]], "repaired_geometry", [3, 3], 2.0),
    "a line": ([[(0, 0), (1, 1), (2, 2)]], "invalid_geometry", [], 0.0),
    "a point": ([[(1, 1)]], "invalid_geometry", [], 0.0),
    "nothing": ([], "empty_geometry", [], 0.0),
    "not a number": ([[(0, 0), (1, float("nan")), (1, 1)]], "invalid_geometry", [], 0.0),
}


def rings_of(case):
    return [np.array(r, float).reshape(-1, 2) for r in case]


def area_of(polygons):
    return sum(mending._signed(r) for p in polygons for r in p)


@pytest.mark.parametrize("name", CASES)
def test_mended(name):
    rings, status, corners, area = CASES[name]
    said, polygons = mending.mend(rings_of(rings))
    assert said == status and sorted(sum(map(len, p)) for p in polygons) == corners and area_of(polygons) == pytest.approx(area)
    moved = mending.mend([r * 1e-4 + [32.8, 39.9] for r in rings_of(rings)])[1]  # as footprints lie
    assert area_of(moved) == pytest.approx(area * 1e-8, rel=1e-7) and len(moved) == len(polygons)


def inside(points, rings):
    odd = np.zeros(len(points), bool)
    for r in rings:
        for a, b in zip(r, np.roll(r, -1, axis=0)):
            spans = (a[1] > points[:, 1]) != (b[1] > points[:, 1])
            with np.errstate(all="ignore"):
                odd ^= spans & (points[:, 0] < (b[0] - a[0]) * (points[:, 1] - a[1]) / (b[1] - a[1]) + a[0])
    return odd


def test_mended_and_clipped_hold_the_even_odd_points():
    rng = np.random.default_rng(0)
    points = rng.random((2000, 2)) * 9
    for t in range(150):
        rings = [rng.integers(0, 9, (rng.integers(3, 9), 2)).astype(float) if t % 2 else rng.random((rng.integers(3, 9), 2)) * 9 for _ in range(rng.integers(1, 4))]
        want = inside(points, rings)
        polygons = mending.mend(rings)[1]
        assert (sum((inside(points, p).astype(int) for p in polygons), np.zeros(len(points), int)) == want).all()
        for p in polygons:
            assert mending._signed(p[0]) > 0 and all(mending._signed(h) < 0 for h in p[1:])
            assert all(len({tuple(x) for x in r.tolist()}) == len(r) for r in p)
        (w, e), (s, n) = np.sort(rng.random(2) * 9), np.sort(rng.random(2) * 9)
        box = (points[:, 0] > w) & (points[:, 0] < e) & (points[:, 1] > s) & (points[:, 1] < n)
        cut = mending.clip(rings, w, s, e, n)
        assert (sum((inside(points, p).astype(int) for p in cut), np.zeros(len(points), int)) == (want & box)).all()


def test_clipping_may_part_a_polygon(spark):
    u = [(0, 0), (5, 0), (5, 5), (4, 5), (4, 1), (1, 1), (1, 5), (0, 5)]
    df = spark.createDataFrame([(1, [[(float(x), float(y)) for x, y in u]]), (2, None), (3, [[(20.0, 20.0), (21.0, 20.0), (21.0, 21.0)]])], "id long, rings array<array<struct<lon:double,lat:double>>>")
    got = {r.id: r.p for r in df.select("id", mending.clipped(df.rings, (-1, 2, 9, 4)).alias("p")).collect()}
    assert [sorted((v.lon, v.lat) for v in p[0]) for p in got[1]] == [[(0, 2), (0, 4), (1, 2), (1, 4)], [(4, 2), (4, 4), (5, 2), (5, 4)]]
    assert got[2] == [] and got[3] == []
    status = {r.id: r.m.status for r in df.select("id", mending.mended("rings").alias("m")).collect()}
    assert status == {1: "valid", 2: "empty_geometry", 3: "valid"}


# rasters


def lzw(raw):
    """A plain encoder: a clear code every 200 bytes keeps all codes at nine bits."""
    codes = []
    for i in range(0, len(raw), 200):
        codes += [256, *raw[i : i + 200]]
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def test_blocks_of_one_grid_give_equal_rows(spark, tmp_path, monkeypatch):
    grid = np.arange(70 * 50, dtype=float).reshape(70, 50) % 301 - 40
    grid[3, 4] = grid[69, 49] = np.nan
    ways = {"strip": {}, "tiles": {"block": (32, 16)}, "deflate": {"block": (16, 16), "deflate": True}, "differenced": {"block": (16, 32), "deflate": True, "predictor": 2, "kind": "i2"}, "float64": {"kind": "f8"}, "int32 strip": {"kind": "i4", "predictor": 2}}
    for name, way in ways.items():
        (tmp_path / f"{name}.tif").write_bytes(raster.write_geotiff(grid, 32.0, 40.0, 0.01, 0.02, -9999, **way))
    with monkeypatch.context() as m:
        m.setattr(raster.zlib, "compress", lzw)
        m.setattr(raster, "DEFLATE", raster.LZW)
        (tmp_path / "lzw.tif").write_bytes(raster.write_geotiff(grid, 32.0, 40.0, 0.01, 0.02, -9999, block=(16, 16), deflate=True))
    rows = raster.geotiff(spark, str(tmp_path)).toPandas()
    want = [(r, c, 32.0 + (c + 0.5) * 0.01, 40.0 - (r + 0.5) * 0.02, v) for (r, c), v in np.ndenumerate(grid)]
    assert set(rows.tile) == {f"{n}.tif" for n in [*ways, "lzw"]}
    for _, own in rows.groupby("tile"):
        own = own.sort_values(["row", "col"])
        assert np.allclose(own[["row", "col", "lon", "lat"]].to_numpy(float), [w[:4] for w in want])
        assert np.array_equal(own["z"].to_numpy(float), [w[4] for w in want], equal_nan=True)
    blocks = raster.geotiff_blocks(spark.read.format("binaryFile").load(str(tmp_path / "deflate.tif")).select("path"))
    assert blocks.count() == 5 * 4


def test_a_large_file_is_many_tasks(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(raster.write_geotiff(np.zeros((160, 160)), 0.0, 0.0, 0.1, 0.1, block=(16, 16)))
    df = raster.geotiff(spark, str(tmp_path / "a.tif"))
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert df.groupBy(F.spark_partition_id().alias("p")).count().count() > 1 and df.count() == 160 * 160
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_long_lzw_codes():
    """Codes that grow to twelve bits: an encoder that keeps its table."""
    raw = np.random.default_rng(0).integers(0, 9, 6000).astype(np.uint8).tobytes()
    table, bits, size, word = {bytes([i]): i for i in range(256)}, f"{256:09b}", 9, b""
    n = 258
    for b in raw:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        bits += f"{table[word]:0{size}b}"
        table[word + bytes([b])] = n
        n += 1
        if n + 0 == (1 << size):
            size += 1
        if n == 4094:
            bits += f"{256:0{size}b}"
            table, size, n = {bytes([i]): i for i in range(256)}, 9, 258
        word = bytes([b])
    bits += f"{table[word]:0{size}b}" + f"{257:0{size}b}"
    packed = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert raster.unpack_lzw(packed) == raw


def test_odd_files_say_what_is_wrong():
    good = raster.write_geotiff(np.zeros((4, 4)), 0.0, 0.0, 1.0, 1.0)
    for raw, what in ((b"XX" + good[2:], "not a TIFF"), (good[:2] + b"\x2b\0" + good[4:], "classic"), (good.replace(b"\x03\x01\x03\0\x01\0\0\0\x01\0", b"\x03\x01\x03\0\x01\0\0\0\x07\0"), "compression 7")):
        with pytest.raises(ValueError, match=what):
            raster.read_geotiff(raw)
