"""Registered queries of areas, lines, policies and sinks, and SQL with the same rows where SQL can express them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline import params
from groundline.operators import columns as O
from groundline.operators import contour as C
from groundline.operators import features as A
from groundline.operators import kernels as N
from groundline.operators import polygons as G
from groundline.operators import raster as R
from groundline.plans import contract as B
from groundline.plans import maps as M
from groundline.plans.contract import query, r4, with_p

# ---- areas of thresholds: the SQL adds up, cell by cell, what the case of its corners leaves inside
CELLS = """c4{n} AS (SELECT tile_id, yi, xi, {v} AS nw, lead({v}) OVER r AS ne FROM {source} WINDOW r AS (PARTITION BY tile_id, yi ORDER BY xi)),
c5{n} AS (SELECT *, lead(nw) OVER k AS sw, lead(ne) OVER k AS se FROM c4{n} WINDOW k AS (PARTITION BY tile_id, xi ORDER BY yi)),
c6{n} AS (SELECT *, CASE WHEN nw >= {l} THEN 1 ELSE 0 END + CASE WHEN ne >= {l} THEN 2 ELSE 0 END + CASE WHEN se >= {l} THEN 4 ELSE 0 END + CASE WHEN sw >= {l} THEN 8 ELSE 0 END AS k,
  ({l} - nw) / nullif(ne - nw, 0) AS t, ({l} - ne) / nullif(se - ne, 0) AS r, ({l} - sw) / nullif(se - sw, 0) AS b, ({l} - nw) / nullif(sw - nw, 0) AS f FROM c5{n} WHERE ne IS NOT NULL AND sw IS NOT NULL),
c7{n} AS (SELECT tile_id, CASE k WHEN 0 THEN 0 WHEN 1 THEN t*f/2 WHEN 2 THEN (1-t)*r/2 WHEN 4 THEN (1-b)*(1-r)/2 WHEN 8 THEN b*(1-f)/2 WHEN 3 THEN (f+r)/2 WHEN 6 THEN 1-(t+b)/2 WHEN 12 THEN 1-(f+r)/2 WHEN 9 THEN (t+b)/2
  WHEN 7 THEN 1-b*(1-f)/2 WHEN 14 THEN 1-t*f/2 WHEN 13 THEN 1-(1-t)*r/2 WHEN 11 THEN 1-(1-b)*(1-r)/2 WHEN 5 THEN 1-(1-t)*r/2-b*(1-f)/2 WHEN 10 THEN (1-t)*r/2+b*(1-f)/2 ELSE 1 END AS share FROM c6{n})"""


def _area_sql(source: str, layer: str, level: float, *more: str, upper: bool = True) -> str:
    share = "share" if upper else "1 - share"
    return with_p(f"SELECT tile_id, round(sum({share}) * 0.25::DOUBLE, 2) AS area FROM c7 GROUP BY tile_id", *more, CELLS.format(v=layer, source=source, l=f"{level}::DOUBLE", n=""))


def _total(s: SparkSession, d: str, areas: DataFrame) -> DataFrame:
    """(tile_id, area) of all tiles, 0 where there is no polygon."""
    sums = areas.groupBy("tile_id").agg(F.sum("area").alias("area"))
    return B.tiles(s, d).select("tile_id").join(sums, "tile_id", "left").select("tile_id", B.rounded(F.coalesce("area", F.lit(0.0)), 2).alias("area"))


MEAN_GRID = "cg AS (SELECT g.tile_id, g.yi, g.xi, coalesce(returns, 1) AS returns, coalesce(intensity, 0) AS intensity FROM g LEFT JOIN cm USING (tile_id, yi, xi))"


def mean_grid(s: SparkSession, d: str) -> DataFrame:
    """Every cell's mean return number and intensity, 1 and 0 where there is no point."""
    grid = R.grid(B.tiles(s, d).select("tile_id"), B.PX)
    return grid.join(B.cell_means(s, d), R.KEY, "left").fillna({"returns": 1.0, "intensity": 0.0})


def slope(s: SparkSession, d: str) -> DataFrame:
    return R.slope(B.dem(s, d), "dem")


SLOPE = "sl AS (SELECT tile_id, yi, xi, sqrt(v*v + h*h) / sqrt(2.0::DOUBLE) AS slope FROM sob)"
query("cliff_areas", _area_sql("sl", "slope", 2.5, *B.TERRAIN, B.N9, B.SOBEL, SLOPE))(lambda s, d: _total(s, d, A.threshold_areas(slope(s, d), "slope", 2.5)))
query("terrain_areas", _area_sql("dem", "dem", 50.0, *B.TERRAIN))(lambda s, d: _total(s, d, A.threshold_areas(B.dem(s, d), "dem", 50.0)))
query("lowland_areas", _area_sql("dem", "dem", 50.0, *B.TERRAIN, upper=False))(lambda s, d: _total(s, d, A.threshold_areas(B.dem(s, d), "dem", 50.0, upper=False)))
query("openness_areas", _area_sql("cg", "returns", 1.5, *B.BASE, B.GRID, B.MEANS, MEAN_GRID, upper=False))(lambda s, d: _total(s, d, A.threshold_areas(mean_grid(s, d), "returns", 1.5, upper=False)))


def intensity_areas(s: SparkSession, d: str) -> DataFrame:
    f = params.IntensityFilter()
    return A.band_areas(R.normalised(mean_grid(s, d), "intensity"), "intensity", f.low, f.high)


_f = params.IntensityFilter()
NORMAL = "ni AS (SELECT tile_id, yi, xi, (intensity - min(intensity) OVER (PARTITION BY tile_id)) / max(intensity) OVER (PARTITION BY tile_id) AS intensity FROM cg)"
BANDS = [CELLS.format(v="intensity", source="ni", l=f"{level}::DOUBLE", n=n) for level, n in ((_f.low, ""), (_f.high, "h"))]
query("intensity_areas", with_p("SELECT tile_id, round((a - h) * 0.25::DOUBLE, 2) AS area FROM (SELECT tile_id, sum(share) AS a FROM c7 GROUP BY tile_id) JOIN (SELECT tile_id, sum(share) AS h FROM c7h GROUP BY tile_id) USING (tile_id)", *B.BASE, B.GRID, B.MEANS, MEAN_GRID, NORMAL, *BANDS))(
    lambda s, d: _total(s, d, intensity_areas(s, d)))
for _level, _green in zip(params.VegetationParams().green, ("light", "medium", "dark"), strict=True):
    query(f"{_green}_green_areas", _area_sql("nd", "ndvd", _level, *B.TERRAIN, B.VEG, B.NDVD))(lambda s, d, level=_level: _total(s, d, A.threshold_areas(B.index(s, d), "ndvd", level)))
query("water_areas", _area_sql("wa", "water", 0.65, *B.BASE, B.GRID, B.MOM, B.BOXES, B.WATER))(lambda s, d: _total(s, d, A.threshold_areas(B.water(s, d), "water", 0.65)))
query("buffered_areas")(lambda s, d: _total(s, d, A.threshold_areas(B.dem(s, d), "dem", 50.0, buffers=(params.BufferRule("grow", 2.0), params.BufferRule("shrink", 1.0)), simplify=params.SIMPLIFY)))

# ---- boxes as polygons: one a part, on a grid with gaps, of several sizes
_side = "CAST(4 + p_size % 21 AS DOUBLE)"
SQUARES = f"sq AS (SELECT p_partkey AS object_id, p_partkey % 5 AS symbol, (p_partkey % 40) * 16.0::DOUBLE AS x0, ((p_partkey // 40) % 40) * 16.0::DOUBLE AS y0, (p_partkey % 40) * 16.0::DOUBLE + {_side} AS x1, ((p_partkey // 40) % 40) * 16.0::DOUBLE + {_side} AS y1 FROM part WHERE p_partkey <= 1600)"


def squares(s: SparkSession, d: str) -> DataFrame:
    """Boxes on a grid of 16 m, with sides of 4 to 24 m, so some overlap; five symbols."""
    part = s.read.parquet(f"{d}/part.parquet").filter("p_partkey <= 1600")
    side = (4 + F.col("p_size") % 21).cast("double")
    x, y = (F.col("p_partkey") % 40) * 16.0, (F.floor(F.col("p_partkey") / 40) % 40) * 16.0
    b = part.select(F.col("p_partkey").alias("object_id"), (F.col("p_partkey") % 5).alias("symbol"), x.alias("x0"), y.alias("y0"), (x + side).alias("x1"), (y + side).alias("y1"))
    p = lambda a, c: F.array(F.col(a), F.col(c))
    return b.withColumn("rings", F.array(F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0"))))


query("area_intersections", f"WITH {SQUARES} SELECT a.object_id AS left_id, b.object_id AS right_id FROM sq a JOIN sq b ON a.symbol = 0 AND b.symbol = 1 AND a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0")(
    lambda s, d: A.intersecting(squares(s, d).filter("symbol = 0"), squares(s, d).filter("symbol = 1")))
#: The dissolve's area by inclusion along vertical strips: in each strip between x values the covered y length.
query("dissolved_areas", f"""WITH {SQUARES}, xs AS (SELECT DISTINCT symbol, x FROM (SELECT symbol, x0 AS x FROM sq UNION ALL SELECT symbol, x1 FROM sq)),
st AS (SELECT symbol, x, lead(x) OVER (PARTITION BY symbol ORDER BY x) AS x2 FROM xs),
iv AS (SELECT st.symbol, st.x, st.x2, y0, y1, max(y1) OVER (PARTITION BY st.symbol, st.x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM st JOIN sq ON sq.symbol = st.symbol AND x0 <= st.x AND x1 >= st.x2)
SELECT symbol, round(sum((x2 - x) * greatest(y1 - greatest(y0, coalesce(b, y0)), 0)), 4) AS area FROM iv GROUP BY symbol""")(
    lambda s, d: A.dissolved_areas(squares(s, d), "symbol").groupBy("symbol").agg(r4(F.sum("area"), "area")))
query("gap_closed_areas")(lambda s, d: A.dissolved_areas(squares(s, d).filter("symbol = 0"), "symbol", 1.0).groupBy("symbol").agg(F.count("*").alias("parts"), r4(F.sum("area"), "area")))


def absorbed(s: SparkSession, d: str) -> DataFrame:
    areas = squares(s, d).filter("object_id <= 400").withColumns({"min_area": F.lit(225.0), "symbol": F.lit("RoughOpenLand")})
    return A.absorbed_areas(areas)


query("small_area_absorb")(lambda s, d: absorbed(s, d).select("symbol", "cluster", r4("area")))
query("polygon_validity", f"WITH {SQUARES} SELECT object_id, object_id % 7 <> 0 AS valid FROM sq")(lambda s, d: _validity(squares(s, d)))


def _validity(areas: DataFrame) -> DataFrame:
    """Whether each ring is closed and does not cross itself; every seventh is made a bow tie."""
    crossed = F.expr("array(rings[0][0], rings[0][2], rings[0][1], rings[0][3], rings[0][0])")
    rings = areas.select("object_id", F.when(F.col("object_id") % 7 == 0, crossed).otherwise(F.col("rings")[0]).alias("ring"))

    def run(batches):
        for pdf in batches:
            yield pdf.assign(valid=[G.is_valid(np.array([list(p) for p in r])) for r in pdf["ring"]])[["object_id", "valid"]]

    return rings.mapInPandas(run, "object_id long, valid boolean")


# ---- lines
ZIG = """zg AS (SELECT CAST(c AS BIGINT) * 100 + CAST(k AS BIGINT) AS line_id, c % 4 AS elevation, c * 10.0::DOUBLE + k * 2 AS sx, c * 3.0::DOUBLE AS sy, c * 10.0::DOUBLE + k * 2 + 2 - 0.125::DOUBLE AS ex, c * 3.0::DOUBLE + 0.25::DOUBLE AS ey FROM range(12) a(c), range(4) b(k) WHERE k <= c % 4)"""


def zigzag(s: SparkSession) -> DataFrame:
    """Twelve chains of one to four short lines whose tips are within 0.3 m of the next one's start."""
    c, k = F.floor(F.col("id") / 4), F.col("id") % 4
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    sx, sy = c * 10.0 + k * 2, c * 3.0
    rows = s.range(48).filter((F.col("id") % 4) <= F.floor(F.col("id") / 4) % 4)
    return rows.select((c * 100 + k).cast("long").alias("line_id"), F.lit("Contour").alias("symbol"), (c % 4).alias("elevation"), F.array(p(sx, sy), p(sx + 1, sy + 1), p(sx + 2 - 0.125, sy + 0.25)).alias("line"))


query("merged_line_chains", f"WITH {ZIG} SELECT min(line_id) AS chain, count(*) AS n_lines FROM zg GROUP BY line_id // 100")(
    lambda s, d: A.merge_chains(zigzag(s).select("line_id", "elevation", "line"), 0.5).groupBy("chain").agg(F.count("*").alias("n_lines")))
query("merged_lines", f"WITH {ZIG} SELECT elevation, 2 * count(*) + 1 AS n_points, min(sx) AS first_x, max(ex) AS last_x FROM zg GROUP BY line_id // 100, elevation")(
    lambda s, d: A.merged_lines(zigzag(s)).select("elevation", F.size("line").cast("long").alias("n_points"), F.get("line", F.lit(0)).x.alias("first_x"), F.element_at("line", -1).x.alias("last_x")))


def contour_lines(s: SparkSession, d: str, interval: float = 2.5, clip: float = 2.0) -> DataFrame:
    """(tile_id, level, part, line): contours of the block terrain, simplified and clipped to the tile less a margin."""

    def run(tile, z):
        import pandas as pd

        frame, rows = [G.box(clip, clip - 63.5, 63.5 - clip, -clip)], []
        for level in M._levels(z, interval):
            parts = [p for line in N.stitched(z, level) for p in A.clipped_lines(N.simplified(line * (0.5, -0.5)), frame)]
            rows += [(tile, level, i, [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in enumerate(parts)]
        return pd.DataFrame(rows, columns=["tile_id", "level", "part", "line"])

    return N.per_tile(B.dem(s, d), run, "tile_id int, level double, part int, line array<struct<x:double,y:double>>", "dem")


query("basemap_contours")(lambda s, d: contour_lines(s, d).select("tile_id", "level", "part", F.size("line").alias("n"), O.elevation_tag(F.col("level"))["Elevation"].alias("tag")))
query("contour_energy")(lambda s, d: O.total_energy(C.bending_energy(contour_lines(s, d).filter("size(line) >= 3")), "tile_id").select("tile_id", r4("energy")))


def form_lines(s: SparkSession, d: str) -> DataFrame:
    change = R.terrain_change(B.dem(s, d), "dem", 5.0)
    lines = contour_lines(s, d).filter(C.level_symbol(F.col("level"), 5.0) == "FormLine").withColumn("line_id", F.xxhash64("tile_id", "level", "part"))
    return A.pruned_form_lines(lines.select("tile_id", "line_id", "line"), A.importance_areas(change, "terrain_change"))


query("form_lines_pruned")(lambda s, d: form_lines(s, d).select("tile_id", "line_id", "part", F.size("line").alias("n")))
query("bezier_curves")(lambda s, d: A.curved(contour_lines(s, d), 0.25).select("tile_id", "level", "part", F.size("curves").alias("n_curves")))

# ---- columns and policies
query("jittered_points", with_p("SELECT l_orderkey, l_linenumber, l_partkey, round(x + (sin(x) * 43758.5453123 - floor(sin(x) * 43758.5453123)) * 0.001 - 0.0005 - 60, 2) AS x FROM p"))(
    lambda s, d: B.P(s, d).select("l_orderkey", "l_linenumber", "l_partkey", B.rounded(O.jittered(F.col("x"), 60.0), 2).alias("x")))
query("preview_reference", with_p("SELECT file_id, round((min_x + max_x) / 2 / 10) * 10 AS ref_x, round((min_y + max_y) / 2 / 10) * 10 AS ref_y FROM f", B.SQL_F))(lambda s, d: _preview_reference(s, d))


def _preview_reference(s: SparkSession, d: str) -> DataFrame:
    x, y = O.preview_reference((F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2)
    return B.S.file_bounds(B.P(s, d)).select("file_id", x.alias("ref_x"), y.alias("ref_y"))


query("paper_millimetres", "SELECT p_partkey, round(p_size * 1000 / 15000.0::DOUBLE, 4) AS mm FROM part")(lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", r4(O.paper_mm(F.col("p_size").cast("double"), 15_000), "mm")))
query("elevation_tags", with_p("SELECT file_id, CASE WHEN level = floor(level) THEN CAST(CAST(level AS BIGINT) AS VARCHAR) ELSE CAST(level AS VARCHAR) END AS tag, CAST(round(level * 100) AS BIGINT) AS key FROM lv", B.LEVELS))(
    lambda s, d: B.level_rows(s, d).select("file_id", O.elevation_tag(F.col("level"))["Elevation"].alias("tag"), O.elevation_key(F.col("level")).alias("key")))
query("files_in_area", f"WITH {B.FILES} SELECT file_id FROM files WHERE min_x <= 700 AND max_x >= 250 AND min_y <= 500 AND max_y >= 100")(lambda s, d: O.relevant(B.files(s, d), (250.0, 100.0, 700.0, 500.0)).select("file_id"))
query("tiles_in_area", f"WITH {B.FILES}, {B.EDGES}, {B.RETILE} SELECT file_id, tile_id FROM tiles WHERE clip_min_x <= 700 AND clip_max_x >= 250 AND clip_min_y <= 500 AND clip_max_y >= 100")(
    lambda s, d: O.relevant(B.file_tiles(s, d), (250.0, 100.0, 700.0, 500.0), "clip_").select("file_id", "tile_id"))
query("test_square_overlap", f"WITH {B.FILES} SELECT file_id, greatest(least(max_x, (min_x+max_x)/2 + 340) - greatest(min_x, (min_x+max_x)/2 - 140), 0) * 300 / 230400 >= 0.5 AS covered FROM files")(lambda s, d: _covered(s, d))


def _covered(s: SparkSession, d: str) -> DataFrame:
    box = [F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    return B.files(s, d).select("file_id", O.square_covered(mid("min_x", "max_x") + 100, mid("min_y", "max_y"), box).alias("covered"))


query("pixel_windows", "WITH " + B.T + ", w AS (SELECT tile_id, tl_x, tl_y, tl_x + 1.1::DOUBLE AS cx0, tl_x + 50 + tile_id AS cx1, tl_y - 40 - tile_id AS cy0, tl_y + 0.3::DOUBLE AS cy1 FROM t) SELECT tile_id, CAST(greatest(ceil((cx0 - tl_x) / 0.5), 0) AS INT) AS \"left\", CAST(floor((cx1 - tl_x) / 0.5) AS INT) AS \"right\", CAST(greatest(ceil((tl_y - cy1) / 0.5), 0) AS INT) AS top, CAST(floor((tl_y - cy0) / 0.5) AS INT) AS bottom FROM w")(
    lambda s, d: O.pixel_window(B.tiles(s, d).withColumns({"clip_min_x": F.col("tl_x") + 1.1, "clip_max_x": F.col("tl_x") + 50 + F.col("tile_id"), "clip_min_y": F.col("tl_y") - 40 - F.col("tile_id"), "clip_max_y": F.col("tl_y") + 0.3})).select("tile_id", "left", "right", "top", "bottom"))
query("box_rings", f"WITH {B.FILES} SELECT file_id, min_x, min_y, max_x, max_y, (max_x - min_x) * (max_y - min_y) AS area FROM files")(lambda s, d: _box_rings(s, d))


def _box_rings(s: SparkSession, d: str) -> DataFrame:
    """Boxes to rings and back, with the ring's area."""
    ring = B.files(s, d).select("file_id", O.corners(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]).alias("ring"))
    return ring.select("file_id", *[b.alias(n) for b, n in zip(O.bounds_of(F.col("ring")), ("min_x", "min_y", "max_x", "max_y"), strict=True)], C.ring_area(F.col("ring")).alias("area"))


query("contour_scores", with_p("SELECT tile_id, round(avg((dem - plane)*(dem - plane)) + 0.01 * sum(abs(dem - plane)), 4) AS score FROM pl GROUP BY ALL", *B.TERRAIN, B.PLANE))(
    lambda s, d: B.planes(s, d).groupBy("tile_id").agg(F.avg((F.col("dem") - F.col("plane")) * (F.col("dem") - F.col("plane"))).alias("error"), F.sum(F.abs(F.col("dem") - F.col("plane"))).alias("energy")).select("tile_id", r4(O.contour_score(F.col("error"), F.col("energy"), 0.01), "score")))
query("preview_scores", with_p("SELECT round(avg(e), 4) AS error, round(avg(g), 4) AS energy, round(avg(e + 0.01 * g), 4) AS score FROM (SELECT avg((dem - plane)*(dem - plane)) AS e, avg(abs(dem - plane)) AS g FROM pl GROUP BY tile_id)", *B.TERRAIN, B.PLANE))(lambda s, d: _preview_scores(s, d))


def _preview_scores(s: SparkSession, d: str) -> DataFrame:
    off = F.col("dem") - F.col("plane")
    t = B.planes(s, d).groupBy("tile_id").agg(F.avg(off * off).alias("error"), F.avg(F.abs(off)).alias("energy"))
    return O.preview_scores(t.withColumn("score", O.contour_score(F.col("error"), F.col("energy"), 0.01))).select(*[r4(c) for c in ("error", "energy", "score")])


_order = "(VALUES " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(O.DRAW_ORDER)) + ") dr(draw_order, symbol)"
query("draw_order", f"WITH {B.OBJECTS} SELECT object_id, symbol, draw_order FROM ob LEFT JOIN {_order} USING (symbol)")(lambda s, d: O.drawn(B.objects(s, d)).select("object_id", "symbol", "draw_order"))
query("symbol_groups", f"WITH {B.OBJECTS} SELECT symbol, count(*) AS n_objects, array_to_string(list_sort(list(object_id)), ',') AS ids FROM ob GROUP BY symbol")(
    lambda s, d: O.by_symbol(B.objects(s, d)).select("symbol", "n_objects", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")))
query("change_symbol", f"WITH {B.OBJECTS} SELECT object_id, 'Marsh' AS symbol FROM ob")(lambda s, d: O.with_symbol(B.objects(s, d), "Marsh").select("object_id", "symbol"))
query("crs_distinct", f"WITH {B.FILES} SELECT epsg, count(*) AS n_files FROM files WHERE epsg IS NOT NULL GROUP BY epsg")(lambda s, d: O.crs_distinct(B.files(s, d)))
query("file_footprint", f"WITH {B.FILES} SELECT count(*) AS n_files, round(sum((max_x-min_x)*(max_y-min_y)) / 1e6, 4) AS km2, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM files")(
    lambda s, d: O.footprint(B.files(s, d)).withColumn("km2", B.rounded("km2")))


def _policies(s: SparkSession, d: str) -> DataFrame:
    chosen = B.files(s, d).filter("file_id % 2 = 0").select("file_id", F.lit(4326).alias("epsg"))
    given = {"all": 3067, "default": 3067}
    parts = [O.assigned_crs(B.files(s, d), p, given.get(p), chosen).select(F.lit(p).alias("policy"), "file_id", "epsg") for p in O.POLICIES]
    return O.united(parts)


query("crs_policies", f"""WITH {B.FILES} SELECT 'all' AS policy, file_id, 3067 AS epsg FROM files UNION ALL SELECT 'each', file_id, coalesce(epsg, 4326) FROM files WHERE epsg IS NOT NULL OR file_id % 2 = 0
UNION ALL SELECT 'default', file_id, coalesce(epsg, 3067) FROM files UNION ALL SELECT 'drop', file_id, epsg FROM files WHERE epsg IS NOT NULL UNION ALL SELECT 'local', file_id, NULL FROM files""")(_policies)
query("conversion_decisions", f"WITH {B.FILES} SELECT file_id, CASE WHEN NOT (min_x <= 700 AND max_x >= 250) THEN 'skip' WHEN epsg IS NOT NULL AND epsg <> 3067 THEN 'transform' WHEN file_id % 2 = 0 THEN 'keep' ELSE 'convert' END AS action FROM files")(
    lambda s, d: O.conversion_decisions(B.files(s, d).withColumns({"map_epsg": F.lit(3067), "indexed": F.col("file_id") % 2 == 0}), (250.0, -1e9, 700.0, 1e9)).select("file_id", "action"))
query("objects_of_tiles", f"WITH {B.OBJECTS} SELECT symbol, count(*) AS n FROM (SELECT * FROM ob WHERE object_id % 2 = 0 UNION ALL SELECT * FROM ob WHERE object_id % 2 = 1) GROUP BY symbol")(
    lambda s, d: O.united([B.objects(s, d).filter("object_id % 2 = 0"), B.objects(s, d).filter("object_id % 2 = 1")]).groupBy("symbol").agg(F.count("*").alias("n")))


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    """Degrees to a zone of UTM and back; the difference in degrees, rounded."""
    place = s.read.parquet(f"{d}/part.parquet").select("p_partkey", (24 + (F.col("p_partkey") % 60) / 10.0).alias("lon"), (55 + (F.col("p_size") % 50) / 4.0).alias("lat"))
    east, up = O.projected(F.col("lon"), F.col("lat"), 32635)
    lon, lat = O.lon_lat(F.col("east"), F.col("north"), 35)
    p = place.withColumns({"east": east, "north": up})
    return p.select("p_partkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


query("utm_round_trip", "SELECT p_partkey, round(24 + (p_partkey % 60) / 10.0::DOUBLE, 6) AS lon, round(55 + (p_size % 50) / 4.0::DOUBLE, 6) AS lat FROM part")(_round_trip)

# ---- terrain builder
def terrain(s: SparkSession, d: str) -> DataFrame:
    """(tile_id, yi, xi, dem, returns, intensity): all three layers interpolated from ground and water points and smoothed;
    returns and intensity normalised by tile."""
    p = B.points(s, d).filter("classification in (2, 9)").join(F.broadcast(B.tiles(s, d)), "tile_id")
    p = p.select("tile_id", ((F.col("x") - F.col("tl_x")) / 0.5).alias("cx"), ((F.col("tl_y") - F.col("y")) / 0.5).alias("cy"), "z", F.col("return_number").cast("double").alias("returns"), "intensity")

    def run(pdf):
        pdf = pdf.sort_values(["cx", "cy", "z", "returns", "intensity"])
        sites = pdf["cx"].to_numpy(), pdf["cy"].to_numpy()
        tile, out = int(pdf["tile_id"].iloc[0]), None
        for name, column in (("dem", "z"), ("returns", "returns"), ("intensity", "intensity")):
            z = N.smoothed(N.discrete_sibson(*sites, pdf[column].to_numpy(), B.PX, n=int(pdf["n"].iloc[0])), 15, 7, 5)
            cells = N.as_cells(tile, z, name)
            out = cells if out is None else out.assign(**{name: cells[name]})
        for name in ("returns", "intensity"):
            out[name] = (out[name] - out[name].min()) / out[name].max()
        return out

    return N.nearest_sites(p, ["z", "returns", "intensity"], B.PX).groupBy("tile_id").applyInPandas(run, "tile_id int, yi int, xi int, dem double, returns double, intensity double")


query("terrain_layers")(lambda s, d: terrain(s, d).select(*R.KEY, r4("dem"), r4("returns"), r4("intensity")))
QUERIES, ORACLE = B.QUERIES, B.ORACLE


# ---- whole maps
def map_layers(s: SparkSession, d: str, steps: set[str] = M.STEPS) -> DataFrame:
    """The steps' layers of the contract grid: block terrain and its slope, mean returns and intensity, density index, water.

    Each has a row a cell, so a layer that no step draws from changes no row of the others.
    """
    names = M.layers_of(steps)
    out = B.dem(s, d)
    for name in names[1:]:
        layer = {"slope": slope, "water": B.water, "ndvd": B.index}.get(name) or (lambda s, d, name=name: R.normalised(mean_grid(s, d), name))
        out = out.join(layer(s, d).select(*R.KEY, name), R.KEY)
    return out


def map_params() -> params.MapParams:
    return params.MapParams(contour=params.ContourParams(interval=2.5, basemap=True, basemap_interval=1.25), min_size=True)


MAP_STEPS = {"basemap", "contours", "cliffs", "water"}


def objects_of_map(s: SparkSession, d: str) -> DataFrame:
    return M.tile_objects(map_layers(s, d, MAP_STEPS), B.tiles(s, d), map_params(), MAP_STEPS)


query("map_tile_objects")(lambda s, d: objects_of_map(s, d).groupBy("tile_id", "symbol", "kind").agg(F.count("*").alias("n")))
query("map_finished")(lambda s, d: M.finished(objects_of_map(s, d), map_params(), MAP_STEPS).groupBy("symbol", "kind").agg(F.count("*").alias("n")))
query("error_corrected_contours")(lambda s, d: N.per_tile(B.dem(s, d), _corrected, "tile_id int, error double, energy double", "dem"))


def _corrected(tile, z):
    import pandas as pd

    if not np.isfinite(z).all():
        return pd.DataFrame([(tile, None, None)], columns=["tile_id", "error", "energy"])
    _, error, energy = N.error_corrected(z, M._levels(z, 2.5), 2, 0.01)
    return pd.DataFrame([(tile, round(error, 4), round(energy, 4))], columns=["tile_id", "error", "energy"])
