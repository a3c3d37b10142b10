"""Areas, lines, columns, sinks and ingest: invariants, round trips and brute force, with empty and odd rows."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundline import params
from groundline.operators import columns as O
from groundline.operators import features as A
from groundline.operators import polygons as P
from groundline.sources import ingest, sinks


# ---- polygons
def test_set_operations_by_points():
    rng = np.random.default_rng(0)
    for _ in range(12):
        sets = [[P.box(*(lo := rng.uniform(0, 10, 2)), *(lo + rng.uniform(1, 5, 2))) for _ in range(5)] for _ in range(2)]
        points = rng.uniform(0, 15, (3000, 2))
        a, b = (np.any([(points[:, 0] > r[0, 0]) & (points[:, 0] < r[2, 0]) & (points[:, 1] > r[0, 1]) & (points[:, 1] < r[2, 1]) for r in s], 0) for s in sets)
        for found, want in ((P.union(*sets), a | b), (P.intersection(*sets), a & b), (P.difference(*sets), a & ~b)):
            assert (P.contains(found, points) == want).all()
        assert abs(P.area(P.union(*sets)) - P.area(P.union(sets[0])) - P.area(P.union(sets[1])) + P.area(P.intersection(*sets))) < 1e-5
    assert P.union([]) == [] and P.intersection([P.box(0, 0, 1, 1)], []) == [] and len(P.difference([P.box(0, 0, 1, 1)], [])) == 1


def test_buffers_and_holes():
    ring = P.difference([P.box(0, 0, 10, 10)], [P.box(3, 3, 6, 6)])
    assert [len(p) for p in P.polygons_of(ring)] == [2] and P.area(ring) == pytest.approx(91)
    assert P.area(P.buffered([P.box(0, 0, 10, 10)], 2)) == pytest.approx(100 + 80 + 4 * math.pi, rel=0.002)
    assert P.area(P.buffered([P.box(0, 0, 10, 10)], -2)) == pytest.approx(36)
    assert P.area(P.buffered(ring, 1)) == pytest.approx(140 + math.pi - 1, rel=0.002) and P.buffered([P.box(0, 0, 1, 1)], -2) == []
    assert P.is_valid(P.box(0, 0, 1, 1)) and not P.is_valid(np.array([(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)])) and not P.is_valid(P.box(0, 0, 1, 1)[:-1])
    assert P.touch([P.box(0, 0, 1, 1)], [P.box(1, 0, 2, 1)]) and P.touch([P.box(0, 0, 9, 9)], [P.box(2, 2, 3, 3)]) and not P.touch([P.box(0, 0, 1, 1)], [P.box(3, 0, 4, 1)])


def test_small_areas_go_into_touching_larger_ones():
    small, large, lone = [P.box(0, 0, 10, 5)], [P.box(10, 0, 30, 25)], [P.box(100, 100, 101, 101)]
    assert [P.area(p) for p in P.absorbed([small, large, lone], 225)] == [550]
    assert P.absorbed([], 225) == [] and P.absorbed([lone], 225) == []
    assert [P.area(p) for p in P.dissolved([small, large])] == [550]
    assert len(P.dissolved([[P.box(0, 0, 4, 4)], [P.box(5, 0, 9, 4)]], 1.0)) == 1 and len(P.dissolved([[P.box(0, 0, 4, 4)], [P.box(9, 0, 12, 4)]], 1.0)) == 2


def test_areas_of_a_cone_and_a_pit():
    y, x = np.mgrid[:81, :81]
    cone = 20 - np.hypot(x - 40, y - 40)
    rings = A.area_rings(cone, 0.0)
    assert len(rings) == 1 and P.area(rings) == pytest.approx(math.pi * 100, rel=0.01)
    assert P.area(A.area_rings(-cone, 0.0)) == pytest.approx(1600 - math.pi * 100, rel=0.01)
    assert P.area(A.area_rings(cone, 0.0, upper=False)) == pytest.approx(1600 - math.pi * 100, rel=0.01)
    assert A.area_rings(cone, 99.0) == [] and P.area(A.area_rings(cone, 99.0, upper=False)) == 1600
    grown = A.area_rings(cone, 0.0, buffers=(params.BufferRule("grow", 2.0),), simplify=0.1)
    assert P.area(grown) == pytest.approx(math.pi * 144, rel=0.02)


def test_lines_are_clipped_and_located():
    box = [P.box(0, 0, 4, 4)]
    parts = P.clipped(np.array([(-1, 1), (5, 1), (5, -3), (3, -3), (3, 2)]), box)
    assert [p.tolist()[0] for p in parts] == [[0, 1], [3, 0]] and [A._length(p) for p in parts] == [4, 2]
    around = np.array([(2, 2), (6, 2), (6, 6), (2, 6), (2, 2)], float)  # the seam lies inside: one part
    assert len(P.clipped(around, box)) == 1
    line = np.array([(0, 0), (10, 0), (10, 10)], float)
    assert A.located(line, np.array([10, 5])) == pytest.approx(0.75) and A.part_of(line, 0.25, 0.75).tolist() == [[5, 0], [10, 0], [10, 5]]
    assert A.rotated(around, 2)[0].tolist() == [6, 6] and A.rotated(around, 2)[-1].tolist() == [6, 6]


def test_form_lines():
    line = np.array([(x, 0.0) for x in range(101)])
    zone = lambda a, b: P.box(a, -5, b, 5)
    kept = A.pruned_form_line(line, [zone(10, 20)], [zone(10, 20), zone(22, 40)])
    assert len(kept) == 1 and kept[0][0, 0] == pytest.approx(10) and kept[0][-1, 0] == pytest.approx(40)  # a gap of 2 m is joined
    assert A.pruned_form_line(line, [], [zone(10, 12)]) == []  # short and unimportant
    short = A.pruned_form_line(line, [zone(10, 12)], [zone(10, 12)])
    assert A._length(short[0]) == pytest.approx(3.75) and A.pruned_form_line(line, [], []) == [] and A.pruned_form_line(line[:1], [], []) == []


def test_merged_lines(spark):
    p = lambda *v: [{"x": float(x), "y": float(y)} for x, y in v]
    rows = [
        (1, "Contour", 5, p((0, 0), (1, 0))), (2, "Contour", 5, p((1.2, 0), (2, 0))), (3, "Contour", 10, p((2.1, 0), (3, 0))),  # another elevation
        (4, "IndexContour", 5, p((2.1, 0), (3, 0))), (5, "Contour", 5, p((9, 9), (10, 9), (10, 10), (9.1, 9.1))),  # closes itself
        (6, "Contour", 5, p((20, 0), (21, 0), (21, 1), (20, 0))),
    ]
    df = spark.createDataFrame(rows, "line_id long, symbol string, elevation int, line array<struct<x:double,y:double>>")
    got = {(r["symbol"], r["elevation"], len(r["line"])): r["line"] for r in A.merged_lines(df).collect()}
    assert set(got) == {("Contour", 5, 3), ("Contour", 10, 2), ("IndexContour", 5, 2), ("Contour", 5, 5), ("Contour", 5, 4)}
    assert [q["x"] for q in got["Contour", 5, 3]] == [0, 1.2, 2] and got["Contour", 5, 5][0] == got["Contour", 5, 5][-1]
    assert A.merged_lines(df.filter("false")).count() == 0


def test_curves_stay_near_their_line():
    t = np.linspace(0, 2 * math.pi, 60)
    line = np.stack([10 * t, 5 * np.sin(t)], 1)
    pieces = A.bezier(line, 0.1)
    s = np.linspace(0, 1, 200)[:, None]
    at = np.vstack([(1 - s) ** 3 * c[0] + 3 * (1 - s) ** 2 * s * c[1] + 3 * (1 - s) * s**2 * c[2] + s**3 * c[3] for c in pieces])
    assert len(pieces) < 12 and max(np.hypot(*(at - q).T).min() for q in line) < 0.2
    assert np.allclose(A.bezier(np.array([(0, 0), (3, 0)]), 1.0), [[(0, 0), (1, 0), (2, 0), (3, 0)]]) and len(A.bezier(np.zeros((1, 2)), 1.0)) == 0


# ---- columns
def test_utm_known_place(spark):
    df = spark.createDataFrame([(25.0, 60.0), (27.0, 0.0)], "lon double, lat double")
    east, north = O.utm(F.col("lon"), F.col("lat"), 35)
    got = df.select(east.alias("e"), north.alias("n")).collect()
    assert got[0]["e"] == pytest.approx(388455.953, abs=0.01) and got[0]["n"] == pytest.approx(6653097.435, abs=0.01)
    assert got[1]["e"] == pytest.approx(500000, abs=1e-6) and got[1]["n"] == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError):
        O.projected(F.col("lon"), F.col("lat"), 4326)


def test_policies_and_stages(spark):
    files = spark.createDataFrame([(1, 3067), (2, None)], "file_id int, epsg int")
    assert O.assigned_crs(files, "drop").count() == 1 and O.assigned_crs(files.filter("false"), "all", 1).count() == 0
    with pytest.raises(ValueError):
        O.assigned_crs(files, "none")
    with pytest.raises(NotImplementedError):
        O.transform_files("a")
    assert O.raster_path("/a/b/map.omap", "slope") == "/a/b/map_slope.tif" and O.saved_rasters(False, {"slope": True}) == [] and O.saved_rasters(True, {"ndvd": True, "slope": True}) == ["slope", "ndvd"]
    for bad in (("make_map", 0, "p", 0), ("make_map", 1, None, 1), ("preview", 2, None, 1)):
        with pytest.raises(ValueError):
            O.check_stage(*bad)
    O.check_stage("make_map", 1, "p", 1)
    p = params.MapParams(min_size=True, intensity=(params.IntensityFilter(symbol="Marsh"), params.IntensityFilter(symbol="Marsh")))
    assert O.min_size_symbols(p, {"intensity", "cliffs"}) == ["GiganticBoulder", "Marsh"] and O.min_size_symbols(params.MapParams(), {"cliffs"}) == []
    assert not O.basemap_wanted(p) and O.basemap_wanted(params.MapParams(contour=params.ContourParams(basemap=True)))
    objects = spark.createDataFrame([(1, "Contour")], "object_id int, symbol string")
    assert O.with_symbol(objects, "FormLine").first()["symbol"] == "FormLine"
    with pytest.raises(Exception, match="another kind"):
        O.with_symbol(objects, "Marsh").collect()
    assert O.drawn(objects.withColumn("symbol", F.lit("odd"))).first()["draw_order"] is None
    assert O.relevant(spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], "min_x double, min_y double, max_x double, max_y double"), None).count() == 1


def test_changed_steps():
    old = params.MapParams()
    assert params.changed_steps(None, old) == {"contours"} and params.changed_steps(None, params.MapParams(contour=params.ContourParams(basemap=True)), "water") == {"contours", "basemap", "water"}
    assert params.changed_steps(old, params.MapParams(scale=10_000, cliff=3.0), "greens") == {"contours", "greens"}
    assert params.changed_steps(old, params.MapParams(water=0.5)) == {"water"} and params.changed_steps(old, old) == set()
    assert params.changed_steps(old, params.MapParams(contour=params.ContourParams(interval=2.5))) == {"contours"}


# ---- sinks and ingest
def test_geotiff(spark, tmp_path):
    cells = [(y, x, float(10 * y + x)) for y in range(2, 5) for x in range(7, 12) if (y, x) != (3, 8)]
    path = str(tmp_path / "m.tif")
    sinks.write_geotiff(spark.createDataFrame(cells, "gy long, gx long, v double").repartition(3), path, (500000.0, 6600000.0), 3067)
    data = open(path, "rb").read()
    assert data[:4] == b"II*\0"
    n = struct.unpack_from("<H", data, 8)[0]
    tags = {t: (k, c, data[10 + 12 * i + 8 : 10 + 12 * i + 12]) for i in range(n) for t, k, c in [struct.unpack_from("<HHI", data, 10 + 12 * i)]}
    assert list(tags) == sorted(tags)
    one = lambda t: struct.unpack("<I", tags[t][2])[0]
    assert (one(256), one(257)) == (5, 3)
    strips = struct.unpack_from("<3I", data, one(273))
    rows = [list(data[s : s + 5]) for s in strips]
    assert rows[1][1] == 0 and rows[0][0] == 1 and rows[2][4] == 255 and len(data) == strips[2] + 5
    assert struct.unpack_from("<6d", data, one(sinks.TIE_POINT))[3:5] == (500000 + 7 * 0.5 - 0.25, 6600000 - 2 * 0.5 + 0.25)
    assert struct.unpack_from("<12H", data, one(sinks.GEO_KEYS))[8:] == (3072, 0, 1, 3067)
    sinks.write_geotiff(spark.createDataFrame([], "gy long, gx long, v double"), str(tmp_path / "none.tif"), (0.0, 0.0))
    assert not (tmp_path / "none.tif").exists()


def test_map_file_and_geojson(spark, tmp_path):
    import xml.etree.ElementTree as ET

    rows = [("Contour", [[[0.0, 0.0], [15.0, 30.0]]], {"Elevation": "5"}), ("Marsh", [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]], None)]
    df = spark.createDataFrame(rows, "symbol string, coordinates array<array<array<double>>>, tags map<string,string>")
    sinks.write_map(df, str(tmp_path / "m.omap"), 15_000, (1.0, 2.0), 40.0, 3067, 2.0)
    root = ET.parse(tmp_path / "m.omap").getroot()
    found = root.findall("objects/object")
    assert len(found) == 2 and len(root.findall("symbols/symbol")) == len(sinks.CODES)
    assert found[0].get("bezier") == "2.0" and found[0].find("tags/t").text == "5" and found[0].find("coords").text == "0.000 -0.000 1.000 -2.000"
    with pytest.raises(ValueError):
        list(sinks.map_file(iter([{"symbol": "odd", "coordinates": []}]), 15_000, (0, 0)))
    features = [json.loads(r["value"]) for r in sinks.geojson(df).collect()]
    assert features[1]["geometry"]["coordinates"] == rows[1][1] and features[0]["properties"] == {"symbol": "Contour"}
    assert json.loads(sinks.geojson(df, "LineString").first()["value"])["geometry"]["coordinates"] == rows[0][1][0]
    assert sinks.geojson(df.filter("false")).count() == 0


def _las(records=(), box=(101, 201, 1, 110, 210, 5), compressed=False):
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    body = b"".join(struct.pack("<H16sHH32s", 0, b"LASF_Projection", k, len(v), b"") + v for k, v in records)
    struct.pack_into("<HII", head, 94, 227, 227 + len(body), len(records))
    struct.pack_into("<BHI", head, 104, 0x80 if compressed else 0, 20, 1)
    x0, y0, z0, x1, y1, z1 = box
    struct.pack_into("<12d", head, 131, 0.01, 0.01, 0.01, 100, 200, 0, x1, x0, y1, y0, z1, z0)
    return bytes(head) + body + struct.pack("<iiiHBBbBH", 100, 200, 300, 7, 0b00010010, 0x82, 0, 0, 0)


def test_headers_and_pruning(spark, tmp_path):
    wkt = b'PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","3067"]]'
    keys = struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, 3006)
    for name, data in {"a": _las([(2112, wkt), (34735, keys)]), "b": _las([(34735, keys)], (500, 500, 0, 600, 600, 9)), "c": _las(), "d": b"junk", "e": b""}.items():
        (tmp_path / f"{name}.las").write_bytes(data)
    files = ingest.las_files(spark, str(tmp_path))
    got = {r["path"][-5]: r for r in files.collect()}
    assert {k: r["epsg"] for k, r in got.items()} == {"a": 3067, "b": 3006, "c": None} and got["a"]["max_x"] == 110
    assert [r["path"][-5] for r in ingest.pruned(files, (550.0, 550.0, 560.0, 560.0)).collect()] == ["b"] and ingest.pruned(files, None).count() == 3


def test_points_are_sorted_so_a_box_reads_few_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    from groundline.sources.points import read_points

    points = spark.range(40_000).select((F.col("id") * 7919 % 2000).cast("double").alias("x"), (F.col("id") * 104729 % 2000).cast("double").alias("y"), F.col("id").alias("z"))
    path = str(tmp_path / "p")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    ingest.write_points(points, path, 250.0)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    box = (100.0, 100.0, 200.0, 200.0)
    got = read_points(spark, path, box)
    assert "PushedFilters: [IsNotNull(x), IsNotNull(y), GreaterThanOrEqual(x,100.0)" in got._jdf.queryExecution().toString()
    assert got.count() == points.filter("x between 100 and 200 and y between 100 and 200").count()
    groups = [pq.ParquetFile(f).metadata.row_group(g) for f in (tmp_path / "p").glob("*.parquet") for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    met = [g for g in groups if g.column(1).statistics.min <= 200 and g.column(1).statistics.max >= 100]
    assert len(groups) > 1 and len(met) < len(groups)


# ---- whole maps
def test_error_correction_comes_nearer():
    from groundline.operators import kernels as N

    y, x = np.mgrid[:48, :48]
    z = 10 + 4 * np.exp(-((x - 20) ** 2 + (y - 26) ** 2) / 150.0) + 0.05 * x
    levels = [9.0 + 1.0 * k for k in range(8)]
    rough = float(((z - N.from_contours(N.contours_of(z, levels), z)) ** 2).mean())
    assert rough < 0.5  # a range of five metres from lines a metre apart
    _, error, energy = N.error_corrected(z, levels, 3, 0.001, (0.0, 0.0))
    assert error < 0.5 and energy > 0
    plane = 2.0 * x + 0.0 * y
    places, values, slopes = N.corner_slopes(plane)
    assert np.allclose(slopes, [[2, 0]] * 4) and values.tolist() == [0, 94, 0, 94]
    lines = N.contours_of(plane, [20.0, 40.0, 60.0])
    p, v, s = N.vertex_slopes(lines, plane.shape)
    middle = (p[:, 1] > 1) & (p[:, 1] < 46) & (p[:, 0] < 40)
    assert np.allclose(N.box_mean(plane, 2)[10, 10], 20) and (s[middle, 0] > 1.5).all()


def test_map_of_a_tile(spark):
    from groundline.plans import maps as M

    y, x = np.mgrid[:41, :41]
    rasters = {"dem": 20 - np.hypot(x - 20, y - 20) / 2, "returns": (x < 20) * 1.0, "intensity": x / 40.0, "slope": np.where(x > 30, 3.0, 0.0), "ndvd": y / 40.0, "water": np.where(y > 30, 0.9, 0.0)}
    p = params.MapParams(contour=params.ContourParams(interval=2.5, basemap=True, basemap_interval=1.25), intensity=(params.IntensityFilter(0.25, 0.5, "Marsh"),))
    rows = M.tile_steps(rasters, p, M.STEPS)
    size = {s: sum(P.area([np.array(r) for r in c]) for n, k, _, c in rows if n == s) for s in {r[0] for r in rows if r[1] == "area"}}
    assert size["RoughOpenLand"] + 0 > 150 and size["Marsh"] == pytest.approx(5.0 * 20, rel=0.05) and size["GiganticBoulder"] > 80 and size["LightGreen"] > size["MediumGreen"] > size["DarkGreen"]
    assert {e for n, _, e, _ in rows if n == "Contour"} <= {5.0, 7.5, 10.0, 15.0, 17.5, 20.0} and any(n == "BasemapContour" for n, *_ in rows)
    assert M.tile_steps(rasters, p, set()) == []
    cells = spark.createDataFrame([(0, int(j), int(i), *[float(rasters[k][j, i]) for k in M.LAYERS]) for j in range(41) for i in range(41)], "tile_id int, yi int, xi int, " + ", ".join(f"{k} double" for k in M.LAYERS))
    tiles = spark.createDataFrame([(0, 100.0, 200.0)], "tile_id int, tl_x double, tl_y double")
    objects = M.tile_objects(cells, tiles, p)
    assert objects.count() == len(rows) and M.tile_objects(cells.filter("false"), tiles, p).count() == 0
    done = M.finished(objects, p).collect()
    assert {r["symbol"] for r in done} >= {"Marsh", "UncrossableWaterWithBankLine", "BasemapContour"} and all(r["coordinates"] for r in done)
    assert M.updated(objects, objects.filter("false"), ["Marsh"]).filter("symbol = 'Marsh'").count() == 0
    for bad in (lambda: M.tile_objects(cells, tiles, p, {"odd"}), lambda: M.updated(objects, objects, ["odd"])):
        with pytest.raises(ValueError):
            bad()


def test_covered_area():
    from groundline.plans import maps as M

    assert P.area(M.covered_area([(0, 0, 2, 2), (1, 1, 3, 3)])[0]) == pytest.approx(7)
    assert P.area(M.covered_area([(0, 0, 2, 2)], P.box(1, 1, 5, 5))[0]) == pytest.approx(1)
    for bad in (P.box(8, 8, 9, 9), np.array([(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)], float)):
        with pytest.raises(ValueError):
            M.covered_area([(0, 0, 2, 2)], bad)
    assert M.covered_area([(0, 0, 2, 2)], P.box(0, 0, 1, 1)[::-1])  # a clockwise filter is the same area


# ---- SQL functions and streams
def test_sql_functions(spark):
    from groundline import functions
    from groundline.operators import contour as C

    assert len(functions.register(spark)) == len(functions.FUNCTIONS)
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)], 12.5), ([(0.0, 0.0), (3.0, 4.0)], 7.0), ([], 5.0), (None, None)], "line array<struct<x:double,y:double>>, level double")
    df.createOrReplaceTempView("lines_of_test")
    got = spark.sql("SELECT gl_ring_area(line) AS a, gl_line_length(line) AS l, gl_contour_symbol(level, 2.5) AS s, gl_paper_mm(level, 10000) AS mm, gl_cell(level, 0, 0.5) AS c, gl_jitter(level, 1) AS j FROM lines_of_test").collect()
    want = df.select(C.ring_area(F.col("line")).alias("a"), O.jittered(F.col("level"), 1.0).alias("j")).collect()
    assert [r["a"] for r in got][:3] == [r["a"] for r in want][:3] == [6.0, 0.0, 0.0] and got[3]["a"] is None
    assert [r["l"] for r in got][:3] == [12.0, 5.0, 0.0] and [r["s"] for r in got] == ["IndexContour", "FormLine", "Contour", None]
    assert [r["j"] for r in got] == pytest.approx([r["j"] for r in want], nan_ok=True) if None not in [r["j"] for r in got] else got[3]["j"] is None
    assert got[0]["mm"] == 1.25 and got[0]["c"] == 25 and spark.sql("SELECT gl_boxes_meet(0, 0, 1, 1, 1, 1, 2, 2) AS m").first()["m"]


def test_running_statistics(spark, tmp_path):
    from groundline import streaming

    rows = [(0, float(k), 10.0, float(k), 5.0, 1, 1, 2 if k % 2 else 5, k == 3) for k in range(20)]
    folder = tmp_path / "points"
    for part in (rows[:12], rows[12:]):
        spark.createDataFrame(part, streaming.POINT).coalesce(1).write.mode("append").parquet(str(folder))
        stream = streaming.running_statistics(streaming.arriving_points(spark, str(folder), 1), 10.0)
        q = stream.writeStream.outputMode("complete").format("memory").queryName("blocks_of_test").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r["bx"]: (r["n_points"], r["n_ground"], r["max_z"]) for r in spark.table("blocks_of_test").collect()}
    assert got == {0: (9, 4, 9.0), 1: (10, 5, 19.0)}


def test_queries_on_empty_tables(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from groundline.plans import features as Q

    time, text = pa.timestamp("us"), pa.string()
    item = {"l_orderkey": pa.int64(), "l_partkey": pa.int64(), "l_suppkey": pa.int64(), "l_linenumber": pa.int32(), "l_quantity": pa.float64(), "l_extendedprice": pa.float64(), "l_discount": pa.float64(), "l_tax": pa.float64(), "l_returnflag": text, "l_linestatus": text, "l_shipdate": time}
    part = {"p_partkey": pa.int64(), "p_name": text, "p_brand": text, "p_type": text, "p_size": pa.int32(), "p_retailprice": pa.float64()}
    for name, kinds in (("lineitem", item), ("part", part)):
        pq.write_table(pa.schema(kinds).empty_table(), tmp_path / f"{name}.parquet")
    for name in ("return_stats", "intensity_stats", "combined_stats", "points_in_tiles", "z_range", "corner_ghosts_idw", "canopy_height_model", "vegetation_density", "slope", "box_sums", "water_mask", "contour_levels", "marching_segments", "mosaic", "ring_area", "bending_energy", "dot_knolls", "line_end_matches", "interval_merge", "line_substring", "convex_hull", "terrain_areas", "area_intersections", "dissolved_areas", "small_area_absorb", "basemap_contours", "map_tile_objects"):
        assert Q.QUERIES[name](spark, str(tmp_path)).count() >= 0
