"""Registered queries of the terrain engine over the derived point view, and SQL with the same rows.

Contract grids have 128 cells of 0.5 m a file side. Doubles are rounded once, at the end, to four digits.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline import params
from groundline.operators import contour as C
from groundline.operators import kernels as N
from groundline.operators import raster as R
from groundline.operators import stats as S
from groundline.operators import tiling as G
from groundline.sources.points import DERIVED, ORDER, derived_points

PX = 128
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


#: Added before rounding in both engines, so that decimal ties at the fifth digit fall on the same side.
NUDGE = 1e-9


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            nudged = re.sub(r", ([34])\)", rf" + {NUDGE}, \1)", sql)
            ORACLE[name] = re.sub(r"(round\([a-z_]+), 2\)", rf"\1 + {NUDGE}, 2)", nudged)
        return f

    return register


def r4(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return rounded(col).alias(name or c)


def rounded(c: Column | str, digits: int = 4) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, digits)


P = derived_points
SQL_P = "WITH p AS (" + DERIVED.format(lineitem="lineitem") + ")"


def with_p(body: str, *more: str) -> str:
    return ", ".join([SQL_P, *more]) + "\n" + body


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tile a file: the place of its first sample, a quarter metre inside the corner."""
    box = [(f, (f % 2) * 64.0 + 0.25, (f // 2 + 1) * 64.0 - 0.25) for f in range(4)]
    return spark.createDataFrame(box, "tile_id int, tl_x double, tl_y double")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that count: not withheld, with their tile."""
    return P(spark, sf_dir).filter("not is_withheld").withColumn("tile_id", F.col("file_id"))


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.block_dem(points(spark, sf_dir), tiles(spark, sf_dir), PX)


T = "t AS (SELECT CAST(f AS INT) AS tile_id, (f % 2) * 64.0::DOUBLE + 0.25::DOUBLE AS tl_x, (f // 2 + 1) * 64.0::DOUBLE - 0.25::DOUBLE AS tl_y FROM range(4) r(f))"
Q = "q AS (SELECT p.*, file_id AS tile_id FROM p WHERE NOT is_withheld)"
B = "b AS MATERIALIZED (SELECT * FROM (SELECT q.*, tl_x, tl_y, CAST(round((x - tl_x) / 0.5::DOUBLE) AS INT) AS xi, CAST(round((tl_y - y) / 0.5::DOUBLE) AS INT) AS yi FROM q JOIN t USING (tile_id)) WHERE xi BETWEEN 0 AND 127 AND yi BETWEEN 0 AND 127)"
GRID = "g AS (SELECT CAST(a.tile_id AS INT) AS tile_id, CAST(y.i AS INT) AS yi, CAST(x.i AS INT) AS xi FROM t a, range(128) y(i), range(128) x(i))"
DEM = """bz AS (SELECT tile_id, yi // 8 AS bj, xi // 8 AS bi, avg(z) AS block_z FROM b WHERE classification IN (2, 9) GROUP BY ALL),
tz AS (SELECT tile_id, avg(z) AS tile_z FROM b WHERE classification IN (2, 9) GROUP BY ALL),
dem AS MATERIALIZED (SELECT g.tile_id, yi, xi, coalesce(block_z, tile_z) AS dem FROM g LEFT JOIN bz ON g.tile_id = bz.tile_id AND yi // 8 = bj AND xi // 8 = bi LEFT JOIN tz ON g.tile_id = tz.tile_id)"""
BASE = (T, Q, B)
TERRAIN = (*BASE, GRID, DEM)
H = "h AS (SELECT b.*, z - dem AS hag FROM b JOIN dem USING (tile_id, yi, xi))"
CANOPY = "canopy AS MATERIALIZED (SELECT tile_id, yi, xi, pow(avg(pow(greatest(hag, 0.0::DOUBLE), 8)), 0.125::DOUBLE) AS height FROM h GROUP BY ALL)"


def near_sql(source: str, layer: str) -> str:
    """SQL of a cell and its eight neighbours, clamped at the edges."""
    row = f"r9 AS (SELECT tile_id, yi, xi, {layer} AS c, coalesce(lag({layer}) OVER r, {layer}) AS w, coalesce(lead({layer}) OVER r, {layer}) AS e FROM {source} WINDOW r AS (PARTITION BY tile_id, yi ORDER BY xi))"
    cols = ", ".join(f"coalesce({f}({c}) OVER k, {c}) AS {n}" for n, f, c in (("nw", "lag", "w"), ("n", "lag", "c"), ("ne", "lag", "e"), ("sw", "lead", "w"), ("s", "lead", "c"), ("se", "lead", "e")))
    return f"{row}, n9 AS (SELECT tile_id, yi, xi, w, c, e, {cols} FROM r9 WINDOW k AS (PARTITION BY tile_id, xi ORDER BY yi))"


SOBEL = "sob AS (SELECT tile_id, yi, xi, (nw - ne + 2*w - 2*e + sw - se) / 1.0::DOUBLE AS v, (nw - sw + 2*n - 2*s + ne - se) / 1.0::DOUBLE AS h FROM n9)"
SHADE = f"round(greatest((v * {math.cos(3 * math.pi / 4) * math.cos(math.pi / 4)!r}::DOUBLE - h * {math.sin(3 * math.pi / 4) * math.cos(math.pi / 4)!r}::DOUBLE + {math.sin(math.pi / 4)!r}::DOUBLE) / sqrt(v*v + h*h + 1), 0), 4) AS hillshade"

# ---- filters and statistics
_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "file_id"]


def _filtered(name: str, where: str) -> None:
    cols = ", ".join(_COLUMNS)
    query(name, with_p(f"SELECT {cols}, x, y, z FROM p WHERE {where}"))(lambda s, d: P(s, d).filter(where).select(*_COLUMNS, "x", "y", "z"))


_filtered("ground_points", "NOT is_withheld AND classification = 2")
_filtered("non_withheld_points", "NOT is_withheld")
query("last_returns", with_p("SELECT l_orderkey, l_linenumber, l_partkey, return_number FROM p WHERE number_of_returns > 0 AND return_number = number_of_returns"))(lambda s, d: S.last_returns(P(s, d)).select("l_orderkey", "l_linenumber", "l_partkey", "return_number"))
query("single_returns", with_p("SELECT l_orderkey, l_linenumber, l_partkey FROM p WHERE number_of_returns = 1 AND return_number = 1"))(lambda s, d: S.single_returns(P(s, d)).select("l_orderkey", "l_linenumber", "l_partkey"))

SQL_F = "f AS (SELECT file_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, count(*) AS n_points FROM p GROUP BY file_id)"
SIDES = ["min_x", "max_x", "min_y", "max_y", "min_z", "max_z"]
query("file_bounds", with_p("SELECT file_id, " + ", ".join(f"round({c}, 4) AS {c}" for c in SIDES) + ", n_points FROM f", SQL_F))(lambda s, d: S.file_bounds(P(s, d)).select("file_id", *[r4(c) for c in SIDES], "n_points"))
query("file_density", with_p("SELECT file_id, n_points, round((max_x-min_x)*(max_y-min_y), 4) AS area, round(CASE WHEN (max_x-min_x)*(max_y-min_y) > 1e-12 THEN n_points / ((max_x-min_x)*(max_y-min_y)) ELSE 0 END, 4) AS density FROM f", SQL_F))(lambda s, d: S.file_density(P(s, d)).select("file_id", "n_points", r4("area"), r4("density")))
query("return_histogram", with_p("SELECT a.file_id, CAST(r AS INT) AS return_number, count(p.file_id) AS n FROM (SELECT DISTINCT file_id FROM p) a CROSS JOIN range(1, 16) x(r) LEFT JOIN p ON p.file_id = a.file_id AND p.return_number = r GROUP BY ALL"))(lambda s, d: S.return_histogram(P(s, d)))
RS = "rs AS (SELECT file_id, min(return_number) AS min_return, max(return_number) AS max_return, avg(return_number) AS mean_return, stddev_pop(return_number) AS std_return, count(*) AS n_points FROM p GROUP BY file_id)"
query("return_stats", with_p("SELECT file_id, min_return, max_return, round(mean_return, 4) AS mean_return, round(std_return, 4) AS std_return, n_points FROM rs", RS))(lambda s, d: S.return_stats(P(s, d)).select("file_id", "min_return", "max_return", r4("mean_return"), r4("std_return"), "n_points"))
query("intensity_stats", with_p(f"""SELECT file_id, round(min(intensity), 4) AS min_intensity, round(max(CASE WHEN intensity >= b THEN intensity END), 4) AS max_intensity, round(avg(intensity), 4) AS mean_intensity, round(stddev_pop(intensity), 4) AS std_intensity
FROM (SELECT *, min(intensity) OVER (PARTITION BY file_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY {", ".join(ORDER)}) AS k FROM p) WHERE k <= 10000) GROUP BY file_id"""))(
    lambda s, d: S.intensity_stats(P(s, d), ORDER).select("file_id", *[r4(f"{n}_intensity") for n in ("min", "max", "mean", "std")]))


@query("combined_stats", with_p("""SELECT min(min_return) AS min_return, max(max_return) AS max_return, round(sum(mean_return * rs.n_points) / sum(rs.n_points), 4) AS mean_return, round(sqrt(sum(std_return * std_return)), 4) AS std_return,
round(sum(f.n_points) / sum((max_x-min_x)*(max_y-min_y)), 4) AS density FROM rs JOIN f USING (file_id)""", RS, SQL_F))  # fmt: skip
def combined_stats(s: SparkSession, d: str) -> DataFrame:
    files = S.return_stats(P(s, d)).join(S.file_density(P(s, d)).drop("n_points"), "file_id")
    return S.combined(files, "return").select("min_return", "max_return", r4("mean_return"), r4("std_return"), r4("density"))


# ---- files and tiles
FILES = "files AS (SELECT CAST(f AS INT) AS file_id, (f % 5) * 300.0::DOUBLE + CASE WHEN f >= 15 THEN 9000 ELSE 0 END AS min_x, (f // 5) * 300.0::DOUBLE AS min_y, (f % 5) * 300.0::DOUBLE + 300 + CASE WHEN f >= 15 THEN 9000 ELSE 0 END AS max_x, (f // 5) * 300.0::DOUBLE + 300 AS max_y, CAST(CASE WHEN f % 7 = 0 THEN NULL WHEN f % 3 = 0 THEN 3006 ELSE 3067 END AS INT) AS epsg FROM range(20) r(f) WHERE f <> 7)"


def files(s: SparkSession, d: str) -> DataFrame:
    """Nineteen boxes of 300 m: a grid of three rows with a gap, and a row far away."""
    far = F.when(F.col("f") >= 15, 9000).otherwise(0)
    x, y = (F.col("f") % 5) * 300.0 + far, F.floor(F.col("f") / 5) * 300.0
    epsg = F.when(F.col("f") % 7 == 0, None).when(F.col("f") % 3 == 0, 3006).otherwise(3067).cast("int")
    return s.range(20).select(F.col("id").alias("f")).filter("f <> 7").select(F.col("f").cast("int").alias("file_id"), x.alias("min_x"), y.alias("min_y"), (x + 300).alias("max_x"), (y + 300).alias("max_y"), epsg.alias("epsg"))


EDGES = """fs AS (SELECT *, (min_x + max_x) / 2 AS cx, (min_y + max_y) / 2 AS cy, avg((max_x - min_x + max_y - min_y) / 2) OVER () AS size FROM files),
pairs AS (SELECT a.*, b.file_id AS dst, b.cx AS dx, b.cy AS dy, b.min_x AS ox0, b.max_x AS ox1, b.min_y AS oy0, b.max_y AS oy1, row_number() OVER (PARTITION BY a.file_id ORDER BY (a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy), b.file_id) AS k FROM fs a, fs b),
near AS (SELECT *, CASE WHEN dx < min_x AND dy > max_y THEN 'top_left' WHEN dx > max_x AND dy > max_y THEN 'top_right' WHEN dx > max_x AND dy < min_y THEN 'bottom_right' WHEN dx < min_x AND dy < min_y THEN 'bottom_left'
  WHEN dy > max_y THEN 'top' WHEN dx > max_x THEN 'right' WHEN dy < min_y THEN 'bottom' WHEN dx < min_x THEN 'left' ELSE 'none' END AS side
  FROM pairs WHERE k <= 9 AND dst <> file_id AND ox0 <= max_x + 0.1*size AND ox1 >= min_x - 0.1*size AND oy0 <= max_y + 0.1*size AND oy1 >= min_y - 0.1*size),
e AS (SELECT file_id AS src, side, arg_max(dst, k) AS dst FROM near GROUP BY file_id, side)"""
query("file_neighbors", f"WITH {FILES}, {EDGES} SELECT src, dst, side FROM e")(lambda s, d: G.neighbours(files(s, d)).select("src", "dst", "side"))
COMPONENTS = "comp AS (SELECT file_id, min(other) AS component FROM reach GROUP BY file_id)"
RECURSIVE = f"WITH RECURSIVE {FILES}, {EDGES}, both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), reach(file_id, other) AS (SELECT file_id, file_id FROM files UNION SELECT r.file_id, w.dst FROM reach r JOIN both_ways w ON w.src = r.other), {COMPONENTS}"
query("connected_components", f"{RECURSIVE} SELECT file_id, component FROM comp")(lambda s, d: G.components(files(s, d), G.neighbours(files(s, d))))
query("largest_component", f"{RECURSIVE}, n AS (SELECT component, count(*) AS n_files FROM comp GROUP BY ALL ORDER BY n_files DESC, component LIMIT 1) SELECT file_id, component, n_files FROM comp JOIN n USING (component)")(lambda s, d: G.largest_component(G.components(files(s, d), G.neighbours(files(s, d)))))
query("crs_mode", f"WITH {FILES} SELECT epsg, count(*) AS n_files, min(file_id) AS first_seen FROM files WHERE epsg IS NOT NULL GROUP BY epsg ORDER BY n_files DESC, first_seen DESC LIMIT 1")(lambda s, d: S.crs_mode(files(s, d)))
query("reference_point", with_p("SELECT round(avg((min_x+max_x)/2)/10)*10 AS ref_x, round(avg((min_y+max_y)/2)/10)*10 AS ref_y, round(avg((min_z+max_z)/2)/10)*10 AS ref_z FROM f", SQL_F))(lambda s, d: G.reference_point(S.file_bounds(P(s, d))))

RETILE = """has AS (SELECT src AS file_id, bool_or(side = 'top') AS above, bool_or(side = 'bottom') AS below, bool_or(side = 'left') AS before, bool_or(side = 'right') AS after FROM e GROUP BY src),
o AS (SELECT file_id, min_x - CASE WHEN before THEN 14 ELSE 0 END AS x0, max_x + CASE WHEN after THEN 14 ELSE 0 END AS x1, min_y - CASE WHEN below THEN 14 ELSE 0 END AS y0, max_y + CASE WHEN above THEN 14 ELSE 0 END AS y1,
  min_x + CASE WHEN before THEN 0 ELSE 1 END AS cx0, max_x - CASE WHEN after THEN 0 ELSE 1 END AS cx1, min_y + CASE WHEN below THEN 0 ELSE 1 END AS cy0, max_y - CASE WHEN above THEN 0 ELSE 1 END AS cy1 FROM files LEFT JOIN has USING (file_id)),
c AS (SELECT *, CAST(greatest(ceil((x1 - x0 - 14) / 242), 2) AS INT) AS nx, CAST(greatest(ceil((y1 - y0 - 14) / 242), 2) AS INT) AS ny FROM o),
m AS (SELECT *, (nx * 256 - (x1 - x0)) / (nx - 1) AS mx, (ny * 256 - (y1 - y0)) / (ny - 1) AS my FROM c),
k AS (SELECT m.*, CAST(a.i AS INT) AS xi, CAST(b.i AS INT) AS yi FROM m JOIN range(100) a(i) ON a.i < nx JOIN range(100) b(i) ON b.i < ny),
l AS (SELECT *, CASE WHEN xi = nx - 1 THEN x1 - 256 ELSE x0 + (256 - mx) * xi END AS min_x, CASE WHEN yi = ny - 1 THEN y0 + 256 ELSE y1 - (256 - my) * yi END AS max_y FROM k),
tiles AS (SELECT file_id, yi * nx + xi AS tile_id, xi, yi, nx, ny, min_x, max_y - 256 AS min_y, min_x + 256 AS max_x, max_y,
  CASE WHEN xi = 0 THEN cx0 ELSE min_x + mx / 2 END AS clip_min_x, CASE WHEN xi = nx - 1 THEN cx1 ELSE min_x + 256 - mx / 2 END AS clip_max_x,
  CASE WHEN yi = ny - 1 THEN cy0 ELSE max_y - 256 + my / 2 END AS clip_min_y, CASE WHEN yi = 0 THEN cy1 ELSE max_y - my / 2 END AS clip_max_y FROM l)"""
BOX = ["min_x", "min_y", "max_x", "max_y", "clip_min_x", "clip_min_y", "clip_max_x", "clip_max_y"]
_boxes = ", ".join(f"round({c}, 4) AS {c}" for c in BOX)


def file_tiles(s: SparkSession, d: str) -> DataFrame:
    return G.retile(files(s, d), G.neighbours(files(s, d)))


query("retile", f"WITH {FILES}, {EDGES}, {RETILE} SELECT file_id, tile_id, xi, yi, {_boxes} FROM tiles")(lambda s, d: file_tiles(s, d).select("file_id", "tile_id", "xi", "yi", *[r4(c) for c in BOX]))
query("edge_side", f"""WITH {FILES}, {EDGES}, {RETILE} SELECT file_id, tile_id, CASE WHEN xi=0 AND yi=0 THEN 'top_left' WHEN xi=nx-1 AND yi=0 THEN 'top_right' WHEN xi=nx-1 AND yi=ny-1 THEN 'bottom_right' WHEN xi=0 AND yi=ny-1 THEN 'bottom_left'
WHEN xi=0 THEN 'left' WHEN xi=nx-1 THEN 'right' WHEN yi=0 THEN 'top' WHEN yi=ny-1 THEN 'bottom' ELSE 'none' END AS edge_side FROM tiles""")(lambda s, d: G.edge_side(file_tiles(s, d)).select("file_id", "tile_id", "edge_side"))  # fmt: skip
SMALL = "small AS (SELECT CAST(i AS INT) AS file_id, CAST(j AS INT) AS tile_id, i * 40.0::DOUBLE - 4 AS min_x, j * 40.0::DOUBLE - 4 AS min_y, i * 40.0::DOUBLE + 44 AS max_x, j * 40.0::DOUBLE + 44 AS max_y FROM range(3) a(i), range(3) b(j))"


def small_tiles(s: SparkSession, d: str) -> DataFrame:
    """Nine overlapping boxes over the derived world."""
    i, j = F.floor(F.col("id") / 3), F.col("id") % 3
    return s.range(9).select(i.cast("int").alias("file_id"), j.cast("int").alias("tile_id"), (i * 40.0 - 4).alias("min_x"), (j * 40.0 - 4).alias("min_y"), (i * 40.0 + 44).alias("max_x"), (j * 40.0 + 44).alias("max_y"))


query("points_in_tiles", with_p("SELECT small.file_id AS tile_file, tile_id, count(*) AS n_points, round(avg(z), 4) AS mean_z FROM p JOIN small ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y GROUP BY ALL", SMALL))(
    lambda s, d: G.points_in_tiles(P(s, d), small_tiles(s, d)).groupBy("tile_file", "tile_id").agg(F.count("*").alias("n_points"), r4(F.avg("z"), "mean_z")))
query("tile_min_ground", with_p("SELECT small.file_id AS tile_file, tile_id, count(*) AS n_ground FROM p JOIN small ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y WHERE classification = 2 AND NOT is_withheld GROUP BY ALL HAVING count(*) >= 4", SMALL))(
    lambda s, d: G.points_in_tiles(P(s, d).filter("classification = 2 and not is_withheld"), small_tiles(s, d)).groupBy("tile_file", "tile_id").agg(F.count("*").alias("n_ground")).filter("n_ground >= 4"))
query("z_range", with_p("SELECT file_id, round(min(z), 4) AS min_z, round(max(z), 4) AS max_z FROM p WHERE classification IN (2, 9) AND NOT is_withheld GROUP BY file_id"))(
    lambda s, d: P(s, d).filter("classification in (2, 9) and not is_withheld").groupBy("file_id").agg(r4(F.min("z"), "min_z"), r4(F.max("z"), "max_z")))
query("corner_ghosts_idw", with_p("""SELECT tile_id, corner, round(sum(z / d2) / sum(1 / d2), 4) AS z FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, corner ORDER BY d2, x, y, z) AS k FROM (
SELECT q.tile_id, corner, x, y, z, greatest((x-gx)*(x-gx) + (y-gy)*(y-gy), 2.220446049250313e-16::DOUBLE) AS d2 FROM q JOIN gc USING (tile_id) WHERE classification = 2)) WHERE k <= 4 GROUP BY ALL""", Q,
    "gc AS (SELECT CAST(f AS INT) AS tile_id, CAST(c AS INT) AS corner, (f % 2) * 64.0::DOUBLE + CASE WHEN c IN (1, 2) THEN 64 ELSE 0 END AS gx, (f // 2) * 64.0::DOUBLE + CASE WHEN c >= 2 THEN 64 ELSE 0 END AS gy FROM range(4) a(f), range(4) b(c))"))(
    lambda s, d: G.corner_ghosts(points(s, d).filter("classification = 2"), tiles(s, d).select("tile_id", (F.col("tl_x") - 0.25).alias("min_x"), (F.col("tl_x") + 63.75).alias("max_x"), (F.col("tl_y") - 63.75).alias("min_y"), (F.col("tl_y") + 0.25).alias("max_y"))).select("tile_id", "corner", r4("z")))

# ---- binning
query("cell_binning", with_p("SELECT tile_id, yi, xi, count(*) AS n FROM b GROUP BY ALL", *BASE))(lambda s, d: R.binned(points(s, d), tiles(s, d), PX).groupBy(*R.KEY).agg(F.count("*").alias("n")))


def hag(s: SparkSession, d: str) -> DataFrame:
    return R.heights(points(s, d), tiles(s, d), dem(s, d), PX)


query("canopy_height_model", with_p("SELECT tile_id, yi, xi, round(height, 4) AS height FROM canopy", *TERRAIN, H, CANOPY))(lambda s, d: R.canopy_height(hag(s, d)).select(*R.KEY, r4("height")))
query("height_above_ground", with_p("SELECT l_orderkey, l_linenumber, l_partkey, round(hag, 4) AS hag FROM h", *TERRAIN, H))(lambda s, d: hag(s, d).select("l_orderkey", "l_linenumber", "l_partkey", r4("hag")))
query("height_band_filter", with_p("SELECT tile_id, count(*) AS n FROM h WHERE round(hag, 4) BETWEEN 0 AND 1.5 GROUP BY ALL", *TERRAIN, H))(lambda s, d: hag(s, d).filter(rounded("hag").between(0, 1.5)).groupBy("tile_id").agg(F.count("*").alias("n")))


def _shaded(name: str, where: str) -> None:
    layer = "lay AS MATERIALIZED (SELECT g.tile_id, g.yi, g.xi, coalesce(height, 0) AS height FROM g LEFT JOIN canopy USING (tile_id, yi, xi))"
    only = f"canopy AS MATERIALIZED (SELECT tile_id, yi, xi, pow(avg(pow(greatest(hag, 0.0::DOUBLE), 8)), 0.125::DOUBLE) AS height FROM h WHERE {where} GROUP BY ALL)"
    query(name, with_p(f"SELECT tile_id, yi, xi, {SHADE} FROM sob", *TERRAIN, H, only, layer, near_sql("lay", "height"), SOBEL))(
        lambda s, d: R.hillshade(R.filled(tiles(s, d), R.canopy_height(hag(s, d).filter(where)), "height", PX), "height").select(*R.KEY, r4("hillshade")))


_shaded("last_return_hillshade", "number_of_returns > 0 AND return_number = number_of_returns")
_shaded("surface_objects_hillshade", "hag >= 0 AND hag <= 1.5")
VEG = """vw AS (SELECT q.tile_id, o.x AS x, o.y AS y, 1 AS one FROM q, t o LIMIT 0),
v0 AS (SELECT q.*, tl_x, tl_y, CAST(round((x - tl_x) / 0.5::DOUBLE) AS INT) AS cx, CAST(round((tl_y - y) / 0.5::DOUBLE) AS INT) AS cy FROM q JOIN t USING (tile_id)),
v1 AS (SELECT v0.*, z - dem AS hag FROM v0 JOIN dem ON dem.tile_id = v0.tile_id AND dem.yi = greatest(0, least(127, cy)) AND dem.xi = greatest(0, least(127, cx)) WHERE cx BETWEEN -4 AND 131 AND cy BETWEEN -4 AND 131),
v2 AS (SELECT v1.*, CAST(cy + a.i AS INT) AS yi, CAST(cx + b.i AS INT) AS xi FROM v1, range(-4, 5) a(i), range(-4, 5) b(i)),
v3 AS (SELECT tile_id, yi, xi, hag, exp(-((x - (tl_x + 0.5*xi))*(x - (tl_x + 0.5*xi)) + (y - (tl_y - 0.5*yi))*(y - (tl_y - 0.5*yi))) / 2) AS w FROM v2 WHERE yi BETWEEN 0 AND 127 AND xi BETWEEN 0 AND 127 AND (x - (tl_x + 0.5*xi))*(x - (tl_x + 0.5*xi)) + (y - (tl_y - 0.5*yi))*(y - (tl_y - 0.5*yi)) <= 4),
veg AS MATERIALIZED (SELECT tile_id, yi, xi, sum(CASE WHEN hag < 0.2 THEN w ELSE 0 END) / sum(w) AS ground, sum(CASE WHEN hag >= 0.2 AND hag < 1.5 THEN w ELSE 0 END) / sum(w) AS low, sum(CASE WHEN hag >= 1.5 AND hag < 3 THEN w ELSE 0 END) / sum(w) AS medium, sum(CASE WHEN hag >= 3 THEN w ELSE 0 END) / sum(w) AS high FROM v3 GROUP BY ALL)"""
VEG = VEG[VEG.index("v0 AS") :]
NDVD = "nd AS (SELECT g.tile_id, g.yi, g.xi, coalesce(CASE WHEN 0.5*low + 0.35*medium + 0.15*high + ground > 1e-12 THEN ((0.5*low + 0.35*medium + 0.15*high - ground) / (0.5*low + 0.35*medium + 0.15*high + ground) + 1) / 2 ELSE 0 END, 0) AS ndvd FROM g LEFT JOIN veg USING (tile_id, yi, xi))"


def veg(s: SparkSession, d: str) -> DataFrame:
    return R.vegetation_density(points(s, d), tiles(s, d), dem(s, d), px=PX)


def index(s: SparkSession, d: str) -> DataFrame:
    return R.filled(tiles(s, d), veg(s, d).select(*R.KEY, R.ndvd().alias("ndvd")), "ndvd", PX)


query("vegetation_density", with_p("SELECT tile_id, yi, xi, round(ground, 4) AS ground, round(low, 4) AS low, round(medium, 4) AS medium, round(high, 4) AS high FROM veg", *TERRAIN, VEG))(lambda s, d: veg(s, d).select(*R.KEY, *[r4(c) for c in ("ground", "low", "medium", "high")]))
query("ndvd", with_p("SELECT tile_id, yi, xi, round(ndvd, 4) AS ndvd FROM nd", *TERRAIN, VEG, NDVD))(lambda s, d: index(s, d).select(*R.KEY, r4("ndvd")))
MEANS = "cm AS (SELECT tile_id, yi, xi, avg(return_number) AS returns, avg(intensity) AS intensity FROM b GROUP BY ALL)"


def cell_means(s: SparkSession, d: str) -> DataFrame:
    return R.binned(points(s, d), tiles(s, d), PX).groupBy(*R.KEY).agg(F.avg("return_number").alias("returns"), F.avg("intensity").alias("intensity"))


for _name, _layer in (("normalized_returns", "returns"), ("normalized_intensity", "intensity")):
    query(_name, with_p(f"SELECT tile_id, yi, xi, round(({_layer} - min({_layer}) OVER (PARTITION BY tile_id)) / max({_layer}) OVER (PARTITION BY tile_id), 4) AS {_layer} FROM cm", *BASE, MEANS))(lambda s, d, layer=_layer: R.normalised(cell_means(s, d), layer).select(*R.KEY, r4(layer)))

# ---- stencils
N9 = near_sql("dem", "dem")
query("slope", with_p("SELECT tile_id, yi, xi, round(sqrt(v*v + h*h) / sqrt(2.0::DOUBLE), 4) AS slope FROM sob", *TERRAIN, N9, SOBEL))(lambda s, d: R.slope(dem(s, d), "dem").select(*R.KEY, r4("slope")))
query("hillshade", with_p(f"SELECT tile_id, yi, xi, {SHADE} FROM sob", *TERRAIN, N9, SOBEL))(lambda s, d: R.hillshade(dem(s, d), "dem").select(*R.KEY, r4("hillshade")))
query("terrain_change", with_p("""SELECT tile_id, yi, xi, round(sqrt(zx*zx + zy*zy + 25 * (xx*xx + 2*xy*xy + yy*yy)), 4) AS terrain_change FROM (SELECT tile_id, yi, xi, (e-w)/1.0::DOUBLE AS zx, (n-s)/1.0::DOUBLE AS zy, (e-2*c+w)/0.25::DOUBLE AS xx, (n-2*c+s)/0.25::DOUBLE AS yy, (ne-nw-se+sw)/1.0::DOUBLE AS xy FROM n9)""", *TERRAIN, N9))(lambda s, d: R.terrain_change(dem(s, d), "dem").select(*R.KEY, r4("terrain_change")))
query("normal_vectors", with_p("SELECT tile_id, yi, xi, round(-(se - sw + 2*(e-w) + ne - nw) / 4.0::DOUBLE, 4) + 0.0 AS nx, round(-(nw - sw + 2*(n-s) + ne - se) / 4.0::DOUBLE, 4) + 0.0 AS ny FROM n9", *TERRAIN, N9))(lambda s, d: R.normals(dem(s, d), "dem").select(*R.KEY, (rounded("nx") + 0.0).alias("nx"), (rounded("ny") + 0.0).alias("ny")))
SUMS = "bs AS (SELECT a.tile_id, a.yi, a.xi, sum(m.d) AS d, count(*) AS n FROM dd a JOIN dd m ON m.tile_id = a.tile_id AND m.yi BETWEEN a.yi - 2 AND a.yi + 2 AND m.xi BETWEEN a.xi - 2 AND a.xi + 2 GROUP BY ALL)"
PLANE = "pl AS (SELECT tile_id, yi, xi, dem, 40 + 0.05 * xi + 0.02 * yi AS plane FROM dem)"


def planes(s: SparkSession, d: str) -> DataFrame:
    return dem(s, d).withColumn("plane", 40 + 0.05 * F.col("xi") + 0.02 * F.col("yi"))


query("raster_difference", with_p("SELECT tile_id, yi, xi, round(dem - plane, 4) AS d FROM pl", *TERRAIN, PLANE))(lambda s, d: planes(s, d).select(*R.KEY, r4(F.col("dem") - F.col("plane"), "d")))
query("raster_mse", with_p("SELECT tile_id, round(avg((dem - plane)*(dem - plane)), 4) AS mse FROM pl GROUP BY ALL", *TERRAIN, PLANE))(lambda s, d: planes(s, d).groupBy("tile_id").agg(r4(F.avg((F.col("dem") - F.col("plane")) * (F.col("dem") - F.col("plane"))), "mse")))
query("error_improvement", with_p("SELECT tile_id, yi, xi, round(greatest(abs(dem - plane - 1) - abs(dem - plane), 0), 4) AS improvement FROM pl", *TERRAIN, PLANE))(lambda s, d: planes(s, d).select(*R.KEY, r4(F.greatest(F.abs(F.col("dem") - F.col("plane") - 1) - F.abs(F.col("dem") - F.col("plane")), F.lit(0.0)), "improvement")))
query("box_adjust", with_p("SELECT pl.tile_id, pl.yi, pl.xi, round(plane + 0.5 * d / n, 4) AS plane FROM pl JOIN bs USING (tile_id, yi, xi)", *TERRAIN, PLANE, "dd AS (SELECT tile_id, yi, xi, dem - plane AS d FROM pl)", SUMS))(lambda s, d: R.box_adjust(planes(s, d), "dem", "plane", 2, 0.5).select(*R.KEY, r4("plane")))
MOM = "mo AS (SELECT tile_id, yi, xi, sum(1.0::DOUBLE) AS n, sum(intensity) AS s_i, sum(x-tl_x) AS s_x, sum(tl_y-y) AS s_y, sum(z) AS s_z, sum((x-tl_x)*(x-tl_x)) AS s_xx, sum((x-tl_x)*(tl_y-y)) AS s_xy, sum((tl_y-y)*(tl_y-y)) AS s_yy, sum((x-tl_x)*z) AS s_xz, sum((tl_y-y)*z) AS s_yz, sum(z*z) AS s_zz FROM b WHERE return_number = 1 AND number_of_returns = 1 GROUP BY ALL)"
query("plane_moments", with_p("SELECT tile_id, yi, xi, " + ", ".join(f"round({m}, 4) AS {m}" for m in R.MOMENTS) + " FROM mo", *BASE, MOM))(lambda s, d: R.plane_moments(points(s, d), tiles(s, d), PX).select(*R.KEY, *[r4(m) for m in R.MOMENTS]))


def moment_sums(s: SparkSession, d: str) -> DataFrame:
    m = R.grid(tiles(s, d).select("tile_id"), PX).join(R.plane_moments(points(s, d), tiles(s, d), PX), R.KEY, "left").fillna(0.0)
    return R.box_sum(m, R.MOMENTS, 6)


_pass = lambda source, part, order: "SELECT tile_id, yi, xi, " + ", ".join(f"sum({m}) OVER (PARTITION BY tile_id, {part} ORDER BY {order} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS {m}" for m in R.MOMENTS) + f" FROM {source}"
BOXES = "mg AS (SELECT g.tile_id, g.yi, g.xi, " + ", ".join(f"coalesce({m}, 0) AS {m}" for m in R.MOMENTS) + f" FROM g LEFT JOIN mo USING (tile_id, yi, xi)), m1 AS MATERIALIZED ({_pass('mg', 'yi', 'xi')}), m2 AS ({_pass('m1', 'xi', 'yi')})"
query("box_sums", with_p("SELECT tile_id, yi, xi, round(n, 2) AS n, round(s_i, 2) AS s_i, round(s_z, 2) AS s_z FROM m2", *BASE, GRID, MOM, BOXES))(lambda s, d: moment_sums(s, d).select(*R.KEY, *[rounded(c, 2).alias(c) for c in ("n", "s_i", "s_z")]))


def water(s: SparkSession, d: str) -> DataFrame:
    st = points(s, d).agg(F.avg("intensity").alias("i_mean"), F.stddev_pop("intensity").alias("i_std"), (F.count("*") / F.lit(128.0 * 128.0)).alias("dens"))
    sums = moment_sums(s, d).join(F.broadcast(st))  # one row
    return R.water_likelihood(sums, F.col("dens"), F.col("i_mean"), F.col("i_std"), px=PX)


WATER = """st AS (SELECT avg(intensity) AS i_mean, stddev_pop(intensity) AS i_std, count(*) / 16384.0::DOUBLE AS dens FROM q),
wc AS (SELECT tile_id, yi, xi, n, s_i, s_xx - s_x*s_x/n AS xx, s_xy - s_x*s_y/n AS xy, s_yy - s_y*s_y/n AS yy, s_xz - s_x*s_z/n AS xz, s_yz - s_y*s_z/n AS yz, greatest(s_zz - s_z*s_z/n, 0) AS zz FROM m2 WHERE n >= 6),
wd AS (SELECT *, xx*yy - xy*xy AS det FROM wc), we AS (SELECT *, (xz*yy - yz*xy)/det AS ax, (yz*xx - xz*xy)/det AS ay FROM wd WHERE det > 2.220446049250313e-16::DOUBLE),
wf AS (SELECT *, greatest(zz - ax*xz - ay*yz, 0)/n AS r2, n / ((least(yi+6, 127) - greatest(yi-6, 0) + 1) * (least(xi+6, 127) - greatest(xi-6, 0) + 1) * 0.25::DOUBLE) AS dn FROM we),
wl AS (SELECT tile_id, yi, xi, greatest(0, least(1, pow(exp(-r2/0.01::DOUBLE) * exp(-(ax*ax + ay*ay)/(0.015::DOUBLE*0.015::DOUBLE)), 0.7::DOUBLE) * pow(1/(1 + (dn/(dens*0.25::DOUBLE))*(dn/(dens*0.25::DOUBLE))), 0.15::DOUBLE)
  * pow(1/(1 + exp((s_i/n - (i_mean - 0.5::DOUBLE*greatest(i_std, 1)))/greatest(i_std, 1))), 0.15::DOUBLE) * (1 - exp(-(n-5)/6)))) AS water FROM wf, st),
wa AS (SELECT g.tile_id, g.yi, g.xi, coalesce(water, 0.0::DOUBLE) AS water FROM g LEFT JOIN wl USING (tile_id, yi, xi))"""
query("water_probability", with_p("SELECT tile_id, yi, xi, round(water, 3) AS water FROM wa", *BASE, GRID, MOM, BOXES, WATER))(lambda s, d: water(s, d).select(*R.KEY, rounded("water", 3).alias("water")))

# ---- masks and contours
_mask_sql = lambda source, test, name="": f"SELECT tile_id, sum(CASE WHEN {test} THEN 1 ELSE 0 END)::BIGINT AS n_cells, sum(CASE WHEN {test} THEN 1 ELSE 0 END) * 0.25::DOUBLE AS area{name} FROM {source} GROUP BY tile_id"
query("openness_mask", with_p(_mask_sql("(SELECT tile_id, round((returns - min(returns) OVER (PARTITION BY tile_id)) / max(returns) OVER (PARTITION BY tile_id), 4) AS v FROM cm)", "v < 0.01"), *BASE, MEANS))(lambda s, d: C.mask(R.normalised(cell_means(s, d), "returns").withColumn("returns", rounded("returns")), "returns", high=0.01))
query("green_masks", with_p(" UNION ALL ".join(_mask_sql("nd", f"round(ndvd, 4) >= {t}", f", '{n}' AS symbol") for t, n in ((0.4, "LightGreen"), (0.6, "MediumGreen"), (0.8, "DarkGreen"))), *TERRAIN, VEG, NDVD))(
    lambda s, d: _greens(index(s, d).withColumn("ndvd", rounded("ndvd"))))


def _greens(cells: DataFrame) -> DataFrame:
    parts = [C.mask(cells, "ndvd", t).withColumn("symbol", F.lit(n)) for t, n in zip(params.VegetationParams().green, ("LightGreen", "MediumGreen", "DarkGreen"), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


query("water_mask", with_p(_mask_sql("wa", "round(water, 3) >= 0.65"), *BASE, GRID, MOM, BOXES, WATER))(lambda s, d: C.mask(water(s, d).withColumn("water", rounded("water", 3)), "water", 0.65))
query("cliff_mask", with_p(_mask_sql("(SELECT tile_id, round(sqrt(v*v + h*h) / sqrt(2.0::DOUBLE), 4) AS slope FROM sob)", "slope >= 2.5"), *TERRAIN, N9, SOBEL))(lambda s, d: C.mask(R.slope(dem(s, d), "dem").withColumn("slope", rounded("slope")), "slope", 2.5))
query("intensity_mask", with_p(_mask_sql("(SELECT tile_id, round((intensity - min(intensity) OVER (PARTITION BY tile_id)) / max(intensity) OVER (PARTITION BY tile_id), 4) AS v FROM cm)", "v >= 0.2 AND v < 0.4"), *BASE, MEANS))(lambda s, d: C.mask(R.normalised(cell_means(s, d), "intensity").withColumn("intensity", rounded("intensity")), "intensity", 0.2, 0.4))
LEVELS = "lv AS (SELECT file_id, floor(min(z) / 2.5::DOUBLE) * 2.5::DOUBLE + k * 2.5::DOUBLE AS level FROM (SELECT file_id, z FROM p WHERE classification IN (2, 9)) a, range(400) r(k) GROUP BY file_id, k HAVING k < ceil((max(z) - min(z)) / 2.5::DOUBLE) + 1)"


def level_rows(s: SparkSession, d: str) -> DataFrame:
    return C.levels(P(s, d).filter("classification in (2, 9)").groupBy("file_id").agg(F.min("z").alias("min_z"), F.max("z").alias("max_z")), 2.5).select("file_id", "level")


query("contour_levels", with_p("SELECT file_id, round(level, 4) AS level FROM lv", LEVELS))(lambda s, d: level_rows(s, d).select("file_id", r4("level")))
query("contour_symbols", with_p("SELECT file_id, round(level, 4) AS level, CASE WHEN abs(level - round(level/25)*25) < 1e-8 THEN 'IndexContour' WHEN abs(level - round(level/5)*5) < 1e-8 THEN 'Contour' ELSE 'FormLine' END AS symbol FROM lv", LEVELS))(lambda s, d: level_rows(s, d).select("file_id", r4("level"), C.level_symbol(F.col("level"), 5.0).alias("symbol")))
_cases = "(VALUES " + ", ".join(f"({k}, {a}, {b}::INT)" for k, v in C.SEGMENTS.items() for a, b in v) + ") lut(k, a, b)"
_sx = lambda e: f"CASE {e} WHEN 0 THEN xi + (50 - nw)/(ne - nw) WHEN 1 THEN xi + 1 WHEN 2 THEN xi + (50 - sw)/(se - sw) ELSE xi END"
_sy = lambda e: f"CASE {e} WHEN 0 THEN yi WHEN 1 THEN yi + (50 - ne)/(se - ne) WHEN 2 THEN yi + 1 ELSE yi + (50 - nw)/(sw - nw) END"
query("marching_segments", with_p(f"""SELECT tile_id, yi, xi, a AS from_edge, b AS to_edge, round({_sx("a")}, 4) AS x1, round({_sy("a")}, 4) AS y1, round({_sx("b")}, 4) AS x2, round({_sy("b")}, 4) AS y2 FROM
(SELECT a.tile_id, a.yi, a.xi, a.dem AS nw, b.dem AS ne, c.dem AS se, e.dem AS sw FROM rd a JOIN rd b ON b.tile_id = a.tile_id AND b.yi = a.yi AND b.xi = a.xi + 1 JOIN rd c ON c.tile_id = a.tile_id AND c.yi = a.yi + 1 AND c.xi = a.xi + 1 JOIN rd e ON e.tile_id = a.tile_id AND e.yi = a.yi + 1 AND e.xi = a.xi) z
JOIN {_cases} ON k = (CASE WHEN nw >= 50 THEN 1 ELSE 0 END) + (CASE WHEN ne >= 50 THEN 2 ELSE 0 END) + (CASE WHEN se >= 50 THEN 4 ELSE 0 END) + (CASE WHEN sw >= 50 THEN 8 ELSE 0 END)""", *TERRAIN, "rd AS (SELECT tile_id, yi, xi, round(dem, 4) AS dem FROM dem)"))(
    lambda s, d: C.segments(dem(s, d).withColumn("dem", rounded("dem")), "dem", 50.0).select(*R.KEY, "from_edge", "to_edge", r4("x1"), r4("y1"), r4("x2"), r4("y2")))


# ---- mosaic
def mosaic(s: SparkSession, d: str) -> DataFrame:
    r = dem(s, d).join(tiles(s, d), "tile_id").select("tl_x", "tl_y", "yi", "xi", F.col("dem").alias("v"), F.lit(1).alias("top"), F.lit(127).alias("bottom"), F.lit(1).alias("left"), F.lit(127).alias("right"))
    return R.mosaic(r)


MOSAIC = "ms AS (SELECT CAST(round(-tl_y / 0.5::DOUBLE) AS BIGINT) + yi AS gy, CAST(round(tl_x / 0.5::DOUBLE) AS BIGINT) + xi AS gx, avg(dem) AS v FROM dem JOIN t USING (tile_id) WHERE yi BETWEEN 1 AND 126 AND xi BETWEEN 1 AND 126 GROUP BY ALL)"
query("mosaic", with_p("SELECT gy, gx, round(v, 4) AS v FROM ms", *TERRAIN, MOSAIC))(lambda s, d: mosaic(s, d).select("gy", "gx", r4("v")))
query("render_u8", with_p("SELECT gy, gx, CAST(CASE WHEN hi > lo THEN round((v - lo) * 254 / (hi - lo)) + 1 ELSE 255 END AS INT) AS byte FROM (SELECT gy, gx, round(v, 2) AS v, min(round(v, 2)) OVER () AS lo, max(round(v, 2)) OVER () AS hi FROM ms)", *TERRAIN, MOSAIC))(lambda s, d: R.rendered(mosaic(s, d).withColumn("v", rounded("v", 2))))
query("geotiff_origin", "WITH " + T + " SELECT tile_id, tl_x + 500000 - 0.25 AS origin_x, tl_y + 6600000 + 0.25 AS origin_y FROM t")(lambda s, d: tiles(s, d).select("tile_id", (F.col("tl_x") + 500000 - 0.25).alias("origin_x"), (F.col("tl_y") + 6600000 + 0.25).alias("origin_y")))

# ---- lines: one closed or open line an order, from its rows
LINES = """ln AS (SELECT l_orderkey AS line_id, l_linenumber AS k, CAST(l_partkey % 23 AS DOUBLE) AS x, CAST(l_suppkey % 19 AS DOUBLE) AS y FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
ne AS (SELECT line_id, min(k) AS k0, max(k) AS k1, count(*) AS n FROM ln GROUP BY ALL HAVING count(*) >= 4),
vx AS (SELECT ln.* FROM ln JOIN ne USING (line_id) UNION ALL SELECT ln.line_id, 100, x, y FROM ln JOIN ne ON ln.line_id = ne.line_id AND k = k0 WHERE ln.line_id % 3 <> 0),
lg AS (SELECT *, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(x, 2) OVER o AS x3, lead(y, 2) OVER o AS y3 FROM vx WINDOW o AS (PARTITION BY line_id ORDER BY k))"""


def lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of four and more vertices; two of three are closed."""
    v = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("line_id"), F.col("l_linenumber").alias("k"), "l_partkey", "l_suppkey")
    v = v.groupBy("line_id", "k").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("v"))
    v = v.select("line_id", F.struct("k", (F.col("v.l_partkey") % 23).cast("double").alias("x"), (F.col("v.l_suppkey") % 19).cast("double").alias("y")).alias("v"))
    v = v.groupBy("line_id").agg(F.array_sort(F.collect_list("v")).alias("v")).filter(F.size("v") >= 4)
    line = F.transform("v", lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))
    return v.select("line_id", F.when(F.col("line_id") % 3 != 0, F.concat(line, F.slice(line, 1, 1))).otherwise(line).alias("line"))


AREA = "ar AS (SELECT line_id, CASE WHEN line_id % 3 <> 0 OR any_value(cl) THEN sum(x*y2 - x2*y) / 2 ELSE 0 END AS area FROM (SELECT *, first_value(x) OVER o = last_value(x) OVER o AND first_value(y) OVER o = last_value(y) OVER o AS cl FROM lg WINDOW o AS (PARTITION BY line_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY line_id)"
query("ring_area", f"WITH {LINES}, {AREA} SELECT line_id, round(area, 4) AS area FROM ar")(lambda s, d: lines(s, d).select("line_id", r4(C.ring_area(F.col("line")), "area")))
query("basemap_depressions", f"WITH {LINES}, {AREA} SELECT line_id, CASE WHEN area < 0 THEN 'NegBasemapContour' ELSE 'BasemapContour' END AS symbol FROM ar")(lambda s, d: lines(s, d).select("line_id", F.when(C.ring_area(F.col("line")) < 0, "NegBasemapContour").otherwise("BasemapContour").alias("symbol")))
MOMENTS = """mv AS (SELECT line_id, avg(x) AS mid_x, avg(y) AS mid_y FROM vx GROUP BY ALL), mw AS (SELECT line_id, mid_x, mid_y, avg((x-mid_x)*(x-mid_x)) AS xx, avg((y-mid_y)*(y-mid_y)) AS yy, avg((x-mid_x)*(y-mid_y)) AS xy FROM vx JOIN mv USING (line_id) GROUP BY ALL),
my AS (SELECT *, (xx+yy+sqrt((xx-yy)*(xx-yy)+4*xy*xy))/2 AS l1, (xx+yy-sqrt((xx-yy)*(xx-yy)+4*xy*xy))/2 AS l2 FROM mw)"""
query("ring_moments", f"WITH {LINES}, {MOMENTS} SELECT line_id, round(mid_x, 4) AS mid_x, round(mid_y, 4) AS mid_y, CASE WHEN l2 < 0.01 THEN -1 ELSE round(l1/l2, 3) END AS aspect FROM my")(
    lambda s, d: C.ring_moments(lines(s, d)).select("line_id", r4("mid_x"), r4("mid_y"), F.when(_thin(), -1).otherwise(rounded("aspect", 3)).alias("aspect")))


def _thin() -> Column:
    """Whether the lesser moment is too small for a stable ratio."""
    n = F.size("line")
    dx, dy = lambda p: p.x - F.col("mid_x"), lambda p: p.y - F.col("mid_y")
    total = lambda f: F.aggregate(F.transform("line", f), F.lit(0.0), lambda a, v: a + v) / n
    xx, yy, xy = total(lambda p: dx(p) * dx(p)), total(lambda p: dy(p) * dy(p)), total(lambda p: dx(p) * dy(p))
    return (xx + yy - F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)) / 2 < 0.01


query("bending_energy", f"""WITH {LINES}, tl AS (SELECT line_id, k, x2-x AS ax, y2-y AS ay, cl FROM
(SELECT *, first_value(x) OVER o = last_value(x) OVER o AND first_value(y) OVER o = last_value(y) OVER o AS cl FROM lg WINDOW o AS (PARTITION BY line_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE x2 <> x OR y2 <> y),
tu AS (SELECT *, coalesce(lead(ax) OVER o, CASE WHEN cl THEN first_value(ax) OVER o END) AS bx, coalesce(lead(ay) OVER o, CASE WHEN cl THEN first_value(ay) OVER o END) AS b2 FROM tl WINDOW o AS (PARTITION BY line_id ORDER BY k)),
en AS (SELECT line_id, sum(CASE WHEN bx IS NULL THEN 0 ELSE pow(acos(greatest(-1, least(1, (ax*bx + ay*b2) / (sqrt(ax*ax+ay*ay) * sqrt(bx*bx+b2*b2))))), 2) / ((sqrt(ax*ax+ay*ay) + sqrt(bx*bx+b2*b2)) / 2) END) / sum(sqrt(ax*ax+ay*ay)) AS e FROM tu GROUP BY line_id)
SELECT ne.line_id, round(coalesce(e, 1000), 4) AS energy FROM ne LEFT JOIN en USING (line_id)""")(lambda s, d: C.bending_energy(lines(s, d)).select("line_id", r4("energy")))
query("dot_knolls", f"""WITH {LINES}, {AREA}, {MOMENTS}, cl AS (SELECT line_id, (line_id % 3 <> 0) OR bool_or(c) AS c FROM (SELECT line_id, first_value(x) OVER o = last_value(x) OVER o AND first_value(y) OVER o = last_value(y) OVER o AS c FROM vx WINDOW o AS (PARTITION BY line_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY line_id)
SELECT line_id, CASE WHEN NOT c OR abs(area) > 160 THEN 'kept' WHEN abs(area) < 10 THEN 'dropped' WHEN area < 0 THEN 'UDepression' WHEN (l2 > 0 AND l1/l2 < 1.5) OR area < 95 THEN 'DotKnoll' ELSE 'ElongatedDotKnoll' END AS fate FROM ar JOIN my USING (line_id) JOIN cl USING (line_id)""")(lambda s, d: C.dot_knolls(lines(s, d)).select("line_id", "fate"))  # fmt: skip
ENDS = f"{LINES}, st AS (SELECT line_id, arg_min(x, k) AS sx, arg_min(y, k) AS sy, arg_max(x, k) AS ex, arg_max(y, k) AS ey, line_id % 50 AS elevation FROM vx WHERE line_id % 3 = 0 GROUP BY line_id)"
query("line_end_matches", f"WITH {ENDS} SELECT start_id, end_id, d2 FROM (SELECT a.line_id AS start_id, b.line_id AS end_id, (a.sx-b.ex)*(a.sx-b.ex) + (a.sy-b.ey)*(a.sy-b.ey) AS d2, row_number() OVER (PARTITION BY a.line_id ORDER BY (a.sx-b.ex)*(a.sx-b.ex) + (a.sy-b.ey)*(a.sy-b.ey), b.line_id) AS k FROM st a JOIN st b USING (elevation)) WHERE k = 1 AND d2 <= 2.25")(
    lambda s, d: C.end_matches(lines(s, d).filter("line_id % 3 = 0").withColumn("elevation", F.col("line_id") % 50), 1.5))
RANGES = "ra AS (SELECT l_orderkey AS line_id, CAST(l_partkey % 100 AS DOUBLE) / 100 AS start, CAST(l_partkey % 100 + 1 + l_linenumber * 2 AS DOUBLE) / 100 AS \"end\", l_returnflag = 'A' AS important FROM lineitem)"


def ranges(s: SparkSession, d: str) -> DataFrame:
    start = F.col("l_partkey") % 100
    return s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("line_id"), (start.cast("double") / 100).alias("start"), ((start + 1 + F.col("l_linenumber") * 2).cast("double") / 100).alias("end"), (F.col("l_returnflag") == "A").alias("important"))


query("interval_merge", f"""WITH {RANGES}, i0 AS (SELECT *, max("end") OVER (PARTITION BY line_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ra), i1 AS (SELECT *, sum(CASE WHEN b IS NULL OR start - b > 0.025::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY start, "end") AS island FROM i0)
SELECT line_id, round(min(start), 4) AS start, round(max("end"), 4) AS "end", bool_or(important) AS important FROM i1 GROUP BY line_id, island""")(lambda s, d: C.merged_ranges(ranges(s, d), 0.025).select("line_id", r4("start"), r4("end"), "important"))  # fmt: skip
query("range_elongate", f"""WITH {RANGES}, a AS (SELECT line_id, (start + "end")/2 - 0.2::DOUBLE AS a, (start + "end")/2 + 0.2::DOUBLE AS b FROM ra), c AS (SELECT line_id, CASE WHEN a < 0 THEN 0 ELSE a END AS a, CASE WHEN a < 0 THEN b - a ELSE b END AS b FROM a)
SELECT line_id, round(greatest(CASE WHEN b > 1 THEN a - (b - 1) ELSE a END, 0), 4) AS start, round(CASE WHEN b > 1 THEN 1 ELSE b END, 4) AS "end" FROM c""")(lambda s, d: _elongated(ranges(s, d)))  # fmt: skip


def _elongated(r: DataFrame) -> DataFrame:
    a, b = C.elongated(F.col("start"), F.col("end"), 0.4)
    return r.select("line_id", r4(a, "start"), r4(b, "end"))


query("line_substring", f"""WITH {LINES}, sg AS (SELECT line_id, k, x, y, x2, y2, sqrt((x2-x)*(x2-x) + (y2-y)*(y2-y)) AS l FROM lg WHERE x2 IS NOT NULL), cu AS (SELECT *, sum(l) OVER (PARTITION BY line_id ORDER BY k) - l AS a0, sum(l) OVER (PARTITION BY line_id) AS whole FROM sg)
SELECT line_id, round(sum(greatest(0, least(a0 + l, 0.75 * whole) - greatest(a0, 0.25 * whole))), 3) AS length FROM cu GROUP BY line_id""")(lambda s, d: _part_length(C.substring(lines(s, d), F.lit(0.25), F.lit(0.75))))  # fmt: skip


def _part_length(m: DataFrame) -> DataFrame:
    legs = F.zip_with(F.slice("part", F.lit(1), F.size("part") - 1), F.slice("part", F.lit(2), F.size("part") - 1), lambda p, q: F.sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)))
    return m.select("line_id", F.round(F.aggregate(legs, F.lit(0.0), lambda a, v: a + v) + NUDGE, 3).alias("length"))


# ---- symbols
SYMBOLS = "sy(symbol, code, min_area) AS (VALUES " + ", ".join(f"('{n}', '{c}', {a}::DOUBLE)" for n, c, a in params.AREAS) + ")"


def symbols(s: SparkSession) -> DataFrame:
    return s.createDataFrame(params.AREAS, "symbol string, code string, min_area double")


query("symbol_table", f"WITH {SYMBOLS} SELECT symbol, code, min_area, round(min_area * 4 / 9, 4) AS min_area_10k FROM sy")(lambda s, d: symbols(s).select("symbol", "code", "min_area", r4(F.col("min_area") * 4 / 9, "min_area_10k")))
_names = "[" + ", ".join(f"'{n}'" for n, _, _ in params.AREAS) + "]"


def objects(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n, _, _ in params.AREAS])
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("object_id"), F.element_at(names, (F.col("p_partkey") % len(params.AREAS) + 1).cast("int")).alias("symbol"), F.col("p_size").cast("double").alias("size"))


OBJECTS = f"ob AS (SELECT p_partkey AS object_id, ({_names})[p_partkey % {len(params.AREAS)} + 1] AS symbol, CAST(p_size AS DOUBLE) AS size FROM part)"
query("min_size_filter", f"WITH {SYMBOLS}, {OBJECTS} SELECT object_id, symbol, size * size AS area FROM ob JOIN sy USING (symbol) WHERE size * size >= min_area")(
    lambda s, d: objects(s, d).join(F.broadcast(symbols(s)), "symbol").withColumn("area", F.col("size") * F.col("size")).filter("area >= min_area").select("object_id", "symbol", "area"))
query("bezier_error", f"WITH {SYMBOLS} SELECT symbol, CAST(CASE WHEN symbol IN ('LightGreen', 'MediumGreen', 'DarkGreen', 'RoughOpenLand') THEN 3.0 WHEN symbol = 'GiganticBoulder' THEN 1.0 WHEN symbol = 'UncrossableWaterWithBankLine' THEN 2.5 ELSE 2.0 END AS DOUBLE) AS bezier FROM sy")(
    lambda s, d: symbols(s).select("symbol", F.when(F.col("symbol").isin("LightGreen", "MediumGreen", "DarkGreen", "RoughOpenLand"), 3.0).when(F.col("symbol") == "GiganticBoulder", 1.0).when(F.col("symbol") == "UncrossableWaterWithBankLine", 2.5).otherwise(2.0).alias("bezier")))
query("map_delta_merge", f"WITH {OBJECTS}, de AS (SELECT object_id + 1000000 AS object_id, symbol, size FROM ob WHERE symbol IN ('Marsh', 'Building') AND size > 25) SELECT * FROM ob WHERE symbol NOT IN ('Marsh', 'Building', 'PrivateArea') UNION ALL SELECT * FROM de")(lambda s, d: _merged(objects(s, d)))


def _merged(old: DataFrame) -> DataFrame:
    """An update replaces the objects of its symbols; a symbol without new objects is removed."""
    new = old.filter("symbol in ('Marsh', 'Building') and size > 25").withColumn("object_id", F.col("object_id") + 1000000)
    touched = old.sparkSession.createDataFrame([("Marsh",), ("Building",), ("PrivateArea",)], "symbol string")
    return old.join(F.broadcast(touched), "symbol", "left_anti").select("object_id", "symbol", "size").unionByName(new.select("object_id", "symbol", "size"))


_base = "pow(10::DOUBLE, floor(log10(160 / ppm)))"
query("scale_bar", f"SELECT p_partkey, round(160 / ppm / {_base}, 4) AS share, CASE WHEN round(160 / ppm / {_base}, 4) >= 5 THEN 5 WHEN round(160 / ppm / {_base}, 4) >= 2 THEN 2 ELSE 1 END * {_base} AS distance FROM (SELECT p_partkey, CAST(p_size + 3 AS DOUBLE) / 7 AS ppm FROM part)")(lambda s, d: _scale_bar(s.read.parquet(f"{d}/part.parquet")))


def _scale_bar(part: DataFrame) -> DataFrame:
    most = 160 / ((F.col("p_size") + 3).cast("double") / 7)
    base = F.pow(F.lit(10.0), F.floor(F.log10(most)))
    share = rounded(most / base)
    return part.select("p_partkey", share.alias("share"), (F.when(share >= 5, 5).when(share >= 2, 2).otherwise(1) * base).alias("distance"))


# ---- kernels: rows only, checked by tests
def full_dem(s: SparkSession, d: str) -> DataFrame:
    """Natural-neighbour terrain of each tile from its ground and water points."""
    p = points(s, d).filter("classification in (2, 9)").join(F.broadcast(tiles(s, d)), "tile_id")
    p = p.select("tile_id", ((F.col("x") - F.col("tl_x")) / 0.5).alias("cx"), ((F.col("tl_y") - F.col("y")) / 0.5).alias("cy"), "z")

    def run(pdf):
        pdf = pdf.sort_values(["cx", "cy", "z"])
        return N.as_cells(int(pdf["tile_id"].iloc[0]), N.discrete_sibson(pdf["cx"].to_numpy(), pdf["cy"].to_numpy(), pdf["z"].to_numpy(), PX, n=int(pdf["n"].iloc[0])), "dem")

    return N.nearest_sites(p, ["z"], PX).groupBy("tile_id").applyInPandas(run, "tile_id int, yi int, xi int, dem double")


query("natural_neighbour_dem")(lambda s, d: full_dem(s, d).select(*R.KEY, r4("dem")))
query("smoothed_dem")(lambda s, d: N.per_tile(full_dem(s, d), lambda t, z: N.as_cells(t, N.smoothed(z, 15, 7, 5), "dem"), "tile_id int, yi int, xi int, dem double", "dem").select(*R.KEY, r4("dem")))


def _contours(simplify: bool):
    def run(t, z):
        import pandas as pd

        rows = []
        for level in [2.5 * k for k in range(math.floor(z.min() / 2.5), math.ceil(z.max() / 2.5) + 1)]:
            for k, line in enumerate(N.stitched(z, level)):
                line = N.simplified(line * 0.5) if simplify else line * 0.5
                rows.append((t, level, k, len(line), [[float(a), float(b)] for a, b in line]))
        return pd.DataFrame(rows, columns=["tile_id", "level", "line_id", "n", "line"])

    return lambda s, d: N.per_tile(full_dem(s, d), run, "tile_id int, level double, line_id int, n int, line array<array<double>>", "dem")


query("contours_stitched")(_contours(False))
query("contours_simplified")(_contours(True))


@query("convex_hull")
def convex_hull(s: SparkSession, d: str) -> DataFrame:
    """Hulls of ground points by file: hulls of parts first, then the hull of their corners."""

    def part(batches):
        import pandas as pd

        for pdf in batches:
            for f, g in pdf.groupby("file_id"):
                hull = N.convex_hull(g[["x", "y"]].to_numpy())
                yield pd.DataFrame({"file_id": f, "x": hull[:, 0], "y": hull[:, 1]})

    def whole(pdf):
        import pandas as pd

        hull = N.convex_hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({"file_id": pdf["file_id"].iloc[0], "corner": range(len(hull)), "x": hull[:, 0], "y": hull[:, 1]})

    ground = P(s, d).filter("classification = 2 and not is_withheld").select("file_id", "x", "y")
    return ground.mapInPandas(part, "file_id int, x double, y double").groupBy("file_id").applyInPandas(whole, "file_id int, corner int, x double, y double")
