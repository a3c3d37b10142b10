import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundline import params
from groundline.operators import contour as C
from groundline.operators import kernels as N
from groundline.operators import raster as R
from groundline.sources.points import las_header, las_points

LINE = "line array<struct<x:double,y:double>>"


def cells(spark, z):
    rows = [(0, y, x, float(v)) for (y, x), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, "tile_id int, yi int, xi int, v double")


def as_array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["yi"], r["xi"]] = r[name]
    return out


def test_ring_area(spark):
    df = spark.createDataFrame([([(0.0, 100.0), (0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)],), ([(0.0, 0.0), (1.0, 0.0)],), ([],)], LINE)
    assert sorted(r[0] for r in df.select(C.ring_area(F.col("line"))).collect()) == [0.0, 0.0, 10000.0]


def test_plane_and_flat(spark):
    z = np.tile(0.25 * 0.5 * np.arange(10), (10, 1))
    slope = as_array(R.slope(cells(spark, z), "v"), "slope", z.shape)
    assert np.allclose(slope[1:-1, 1:-1], 4 * 0.25 / math.sqrt(2))
    assert np.allclose(as_array(R.terrain_change(cells(spark, z), "v"), "terrain_change", z.shape)[1:-1, 1:-1], 0.25)
    flat = as_array(R.hillshade(cells(spark, np.full((5, 5), 3.0)), "v"), "hillshade", (5, 5))
    assert np.allclose(flat, math.sqrt(0.5))


def test_mosaic_uses_inner_windows(spark):
    tile = lambda x, v, clip: [(x, 10.0, y, k, v if clip[0] <= k < clip[1] else 99.0, 0, 3, *clip) for y in range(3) for k in range(5)]
    df = spark.createDataFrame(tile(0.0, 1.0, (0, 3)) + tile(1.0, 2.0, (1, 3)), "tl_x double, tl_y double, yi int, xi int, v double, top int, bottom int, left int, right int")
    got = sorted((r["gy"], r["gx"], r["v"]) for r in R.mosaic(df).collect())
    assert [v for gy, _, v in got if gy == got[0][0]] == [1.0, 1.0, 1.0, 2.0, 2.0]


def test_box_adjust_matches_loops(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((7, 9)), rng.random((7, 9))
    df = cells(spark, a).withColumnRenamed("v", "t").join(cells(spark, b).withColumnRenamed("v", "m"), R.KEY)
    got = as_array(R.box_adjust(df, "t", "m", 2, 0.5), "m", a.shape)
    want = b.copy()
    for y in range(7):
        for x in range(9):
            w = (a - b)[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3]
            want[y, x] += 0.5 * w.mean()
    assert np.allclose(got, want)


def test_sweeps_equal_one_by_one():
    rng = np.random.default_rng(2)
    z = rng.random((14, 11))
    got = N.smoothed(z, 40, 3, 2)
    limit, cell = math.cos(math.radians(40)), 0.5
    nx, ny = N.normal_field(z)
    cos = lambda a, b: (a[0] * b[0] + a[1] * b[1] + 1) / math.sqrt((a[0] ** 2 + a[1] ** 2 + 1) * (b[0] ** 2 + b[1] ** 2 + 1))
    clip = lambda v, n: min(max(v, 0), n - 1)
    s = np.zeros((2, *z.shape))
    for y, x in np.ndindex(z.shape):
        t = a = b = 0.0
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                j, i = clip(y + dy, 14), clip(x + dx, 11)
                d = cos((nx[y, x], ny[y, x]), (nx[j, i], ny[j, i])) - limit
                if d > 0:
                    t, a, b = t + d * d, a + nx[j, i] * d * d, b + ny[j, i] * d * d
        s[:, y, x] = a / t, b / t
    out = z.copy()
    for _ in range(2):
        for y, x in np.ndindex(z.shape):
            t = v = 0.0
            for dx, dy in [(1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1)]:
                j, i = clip(y + dy, 14), clip(x + dx, 11)
                d = cos(s[:, y, x], s[:, j, i]) - limit
                if d > 0:
                    t += d * d
                    v += (-(s[0, j, i] * -dx * cell + s[1, j, i] * dy * cell) + out[j, i]) * d * d
            if t > np.finfo(float).eps:
                out[y, x] = v / t
    assert np.allclose(got, out)


def test_contours_close_and_turn_left():
    y, x = np.indices((41, 41)) - 20.0
    cone, pit = 20 - np.hypot(x, y), np.hypot(x, y)
    hill, hole = N.stitched(cone, 10.0), [c for c in N.stitched(pit, 10.0) if np.abs(c - 20).max() < 12]
    area = lambda c: 0.5 * np.sum(c[:-1, 0] * -c[1:, 1] - c[1:, 0] * -c[:-1, 1])  # noqa: E731  y goes south
    assert len(hill) == 1 and np.array_equal(hill[0][0], hill[0][-1]) and area(hill[0]) > 300
    assert len(hole) == 1 and area(hole[0]) < -300
    assert len(N.simplified(hill[0], 0.5)) < len(hill[0])


@pytest.mark.parametrize("case", [5, 10])
def test_saddles_give_two_segments(spark, case):
    corners = [(case >> k) & 1 for k in range(4)]
    z = np.array([[corners[0], corners[1]], [corners[3], corners[2]]], float)
    assert C.segments(cells(spark, z), "v", 0.5).count() == 2


def test_sibson_reproduces_a_plane():
    rng = np.random.default_rng(3)
    x, y = rng.random(3000) * 40, rng.random(3000) * 40
    z = N.discrete_sibson(x, y, 2 * x + y, 40)
    yy, xx = np.indices((40, 40))
    assert np.abs(z - (2 * xx + yy))[3:-3, 3:-3].max() < 2.5


def test_hull():
    p = np.array([[0, 0], [4, 0], [4, 3], [0, 3], [1, 1], [2, 2], [2, 0]], float)
    assert {tuple(c) for c in N.convex_hull(p)} == {(0, 0), (4, 0), (4, 3), (0, 3)}


def test_ranges(spark):
    df = spark.createDataFrame([(1, 0.0, 0.2, False), (1, 0.21, 0.3, True), (1, 0.5, 0.6, False)], "line_id int, start double, end double, important boolean")
    got = sorted((r["start"], r["end"], r["important"]) for r in C.merged_ranges(df, 0.02).collect())
    assert got == [(0.0, 0.3, True), (0.5, 0.6, False)]


def test_params():
    with pytest.raises(ValueError):
        params.ContourParams(interval=0.5)
    with pytest.raises(ValueError):
        params.VegetationParams(green=(0.6, 0.4, 0.8))
    assert params.changed_steps(params.MapParams(), params.MapParams(scale=10_000)) == {"contours"}
    assert params.changed_steps(params.MapParams(), params.MapParams(cliff=3.0)) == {"cliffs"}


def test_las_round_trip():
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HI", head, 94, 227, 227)
    struct.pack_into("<BHI", head, 104, 0, 20, 2)
    struct.pack_into("<12d", head, 131, 0.01, 0.01, 0.01, 100, 200, 0, 110, 101, 210, 201, 5, 1)
    point = struct.pack("<iiiHBBbBH", 100, 200, 300, 7, 0b00010010, 0x82, 0, 0, 0)
    data = bytes(head) + point + point
    assert las_header(data)["bounds"] == (101, 201, 1, 110, 210, 5)
    p = las_points(data).iloc[0]
    assert (p.x, p.y, p.z, p.intensity, p.return_number, p.number_of_returns, p.classification, p.is_withheld) == (101.0, 202.0, 3.0, 7, 2, 2, 2, True)
    with pytest.raises(ValueError):
        las_header(data[:104] + b"\x80" + data[105:])
