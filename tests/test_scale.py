"""What keeps the work of large tables bounded: steps that are done once, groups that stay small, and the same results."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundline import params
from groundline.plans import maps as M


@pytest.fixture
def areas(spark):
    ring = lambda x, side: [[[x, 0.0], [x + side, 0.0], [x + side, side], [x, side], [x, 0.0]]]
    line = [[[0.0, 0.0], [9.0, 0.0]]]
    rows = [(0, "GiganticBoulder", "area", None, ring(0.0, 20.0)), (0, "GiganticBoulder", "area", None, ring(20.0, 2.0)), (1, "UncrossableWaterWithBankLine", "area", None, ring(60.0, 20.0)), (1, "Contour", "line", 5.0, line)]
    return spark.createDataFrame(rows, M.OBJECT)


def test_tiles_are_worked_on_once(spark, areas):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    done = M.finished(areas.mapInPandas(run, M.OBJECT), params.MapParams(min_size=True), {"cliffs", "water", "contours"}).groupBy("symbol").agg(F.count("*").alias("n"))
    assert {r["symbol"]: r["n"] for r in done.collect()} == {"GiganticBoulder": 1, "UncrossableWaterWithBankLine": 1, "Contour": 1}
    assert seen.value == areas.count()


SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_map_computes_the_layers_of_its_steps(spark):
    from groundline.plans import contract as B
    from groundline.plans import features as Q

    layers = Q.map_layers(spark, SMALL, {"basemap", "cliffs"})
    assert layers.columns == ["tile_id", "yi", "xi", "dem", "slope"] and layers.count() == 4 * B.PX * B.PX
    assert set(M.layers_of(M.STEPS)) == set(M.LAYERS)
    assert "exp(" not in _plan(M.tile_objects(layers, B.tiles(spark, SMALL), Q.map_params(), {"basemap", "cliffs"}))  # no densities
    assert _plan(B.dem(spark, SMALL)).count("FileScan") == 1  # the points are read once


def test_points_are_not_dealt_by_tile(spark):
    from groundline.operators import raster as R
    from groundline.plans import contract as B

    for df in (R.binned(B.points(spark, SMALL), B.tiles(spark, SMALL), B.PX), R.normalised(B.cell_means(spark, SMALL), "intensity")):
        assert "SortMergeJoin" not in _plan(df)
    assert "Exchange hash" not in _plan(R.binned(B.points(spark, SMALL), B.tiles(spark, SMALL), B.PX))


def test_blocks_of_a_grid_that_they_do_not_divide(spark):
    from groundline.operators import raster as R

    points = spark.createDataFrame([(0, 0.25, -0.25, 4.0, 2), (0, 0.25, -0.25, 2.0, 9), (0, 4.6, -0.1, 8.0, 2), (0, 1.0, -1.0, 99.0, 5)], "tile_id int, x double, y double, z double, classification int")
    tiles = spark.createDataFrame([(0, 0.0, 0.0), (1, 50.0, 0.0)], "tile_id int, tl_x double, tl_y double")
    got = {(r["tile_id"], r["yi"], r["xi"]): r["dem"] for r in R.block_dem(points, tiles, 10).collect()}
    assert set(got) == {(t, y, x) for t in (0, 1) for y in range(10) for x in range(10)}
    want = lambda y, x: 3.0 if y < 8 and x < 8 else 8.0 if y < 8 else 14 / 3
    assert all(got[0, y, x] == want(y, x) and got[1, y, x] is None for y in range(10) for x in range(10))


@pytest.mark.parametrize("n", [60, 5000])
def test_sites_of_a_tile_are_few_and_enough(spark, monkeypatch, n):
    from groundline.operators import kernels as N

    monkeypatch.setattr(N, "HELD", 100)
    rng, px = np.random.default_rng(n), 12
    places = np.round(rng.random((n, 2)) * (px if n > 1000 else px / 3) - 0.5, 1)  # with ties and, where few, an empty corner
    rows = [(t, float(x), float(y), float(v)) for t in (0, 1) for (x, y), v in zip(places, rng.random(n), strict=True)]
    kept = N.nearest_sites(spark.createDataFrame(rows, "tile_id int, cx double, cy double, z double").repartition(5), ["z"], px).toPandas()
    for tile in (0, 1):
        all_of = pd.DataFrame([r for r in rows if r[0] == tile], columns=["tile_id", "cx", "cy", "z"]).sort_values(["cx", "cy", "z"])
        few = kept[kept.tile_id == tile].sort_values(["cx", "cy", "z"])
        assert len(few) <= min(n, 2 * px * px) and set(few["n"]) == {n}
        want, got = (N.discrete_sibson(*(p[c].to_numpy() for c in ("cx", "cy", "z")), px, n=n) for p in (all_of, few))
        assert np.array_equal(want, got)


def test_tiles_get_the_sites_they_need(spark):
    from groundline.plans import features as Q

    for name in ("natural_neighbour_dem", "terrain_layers", "contours_stitched"):
        plan = _plan(Q.QUERIES[name](spark, SMALL))
        assert "SortMergeJoin" not in plan and plan.count("MapInArrow") == 2


def test_few_rows_can_be_among_the_least(spark):
    from groundline.operators.stats import among_least

    rng = np.random.default_rng(5)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 6000), rng.integers(0, 900, 6000), strict=True)] + [(None, 7.0), (None, None), (9, 3.0), (9, 1.0), (0, None)]
    got = among_least(spark.createDataFrame(rows, "k int, v double").repartition(5), ["k"], "v", 4).toPandas()
    for key in (0, 1, 2):
        all_of = sorted(v for k, v in rows if k == key and v is not None)
        mine = sorted(got[(got.k == key) & got.v.notna()].v)
        assert mine[:4] == all_of[:4] and mine == [v for v in all_of if v <= mine[-1]] and len(mine) < 100
    assert len(got[got.k.isna()]) == 2 and sorted(got[got.k == 9].v) == [1, 3] and got[got.k == 0].v.isna().sum() == 1


def test_ghosts_of_corners_come_from_few_points(spark):
    from groundline.plans import contract as B

    plan = _plan(B.QUERIES["corner_ghosts_idw"](spark, SMALL))
    assert "SortMergeJoin" not in plan and "_bound" in plan


def test_first_points_are_found_without_sorting_a_file(spark):
    from groundline.operators import stats as S

    order = ["a", "b"]
    rows = [(f, int(a), int(b), float((a * 7919 + b) % 997)) for f in (0, 1) for a in range(40) for b in range(50 if f else 3)]
    points = spark.createDataFrame(rows, "file_id int, a int, b int, intensity double").repartition(7)
    for r in S.intensity_stats(points, order, 300).collect():
        first = [v for f, *_, v in sorted(rows) if f == r["file_id"]][:300]
        after = [v for k, v in enumerate(first) if k and v >= min(first[:k])]
        assert (r["min_intensity"], r["max_intensity"]) == (min(first), max(after)) and r["mean_intensity"] == pytest.approx(np.mean(first)) and r["std_intensity"] == pytest.approx(np.std(first))
    assert "_bound" in _plan(S.intensity_stats(points, order, 300))


def test_tips_at_one_place_are_paired_once(spark):
    from groundline.operators import contour as C

    rng = np.random.default_rng(6)
    rows = [(k, int(rng.integers(0, 2)), [tuple(map(float, rng.integers(0, 6, 2))), (90.0, 90.0), tuple(map(float, rng.integers(0, 6, 2)))]) for k in range(1500)]
    matched = C.end_matches(spark.createDataFrame(rows, "line_id long, elevation int, line array<struct<x:double,y:double>>"), 1.5)
    want = {}
    for k, level, (start, *_) in rows:
        best = min(((start[0] - x) ** 2 + (start[1] - y) ** 2, i) for i, lv, (_, _, (x, y)) in rows if lv == level)
        if best[0] <= 2.25:
            want[k] = best
    assert {r["start_id"]: (r["d2"], r["end_id"]) for r in matched.collect()} == want and len(want) > 1000
    joined = max(int(m) for m in re.findall(r"number of output rows: ([\d,]+)", _metrics(matched)) or [0])
    assert joined <= 2 * 1500


def _metrics(df):
    """How many rows each operator gave, as text."""
    spark = df.sparkSession
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan

    def visit(node):
        m = node.metrics().get("numOutputRows")
        if m.isDefined():
            out.append(f"number of output rows: {m.get().value()}")
        kids = node.children()
        for k in range(kids.size()):
            visit(kids.apply(k))
        if "QueryStage" in node.nodeName():
            visit(node.plan())

    visit(plan)
    assert spark and out
    return "\n".join(out)
