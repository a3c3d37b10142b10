"""Small row, parameter and policy operators as column expressions or plain functions."""

from __future__ import annotations

import math
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline import params
from groundline.params import CELL, PREVIEW_SQUARE

#: Factor of the deterministic jitter, and its spread in metres.
JITTER, SPREAD = 43758.5453123, 0.001
#: Raster layers that can be saved, by the suffix of their file.
RASTERS = ["slope", "hillshade", "last_return", "canopy_height", "surface_objects", "ndvd"]
#: WGS84 ellipsoid and scale of a UTM zone's central meridian.
WGS84_A, WGS84_F, UTM_SCALE, UTM_EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


# ---- points and boxes
def jittered(c: Column, reference: Column | float) -> Column:
    """A coordinate moved by up to half a millimetre, the same for the same value, and relative to a reference. Null gives null."""
    share = F.pmod(F.sin(c) * F.lit(JITTER), F.lit(1.0))
    return c + share * SPREAD - SPREAD / 2 - reference


def preview_reference(x: Column, y: Column) -> tuple[Column, Column]:
    """The reference point of a preview square: its centre, rounded to 10 m."""
    return F.round(x / 10) * 10, F.round(y / 10) * 10


def paper_mm(metres: Column, scale: int) -> Column:
    """Metres on the ground as millimetres on the map."""
    return metres * 1000 / scale


def boxes_meet(a: list[Column], b: list[Column]) -> Column:
    """Whether two boxes (min_x, min_y, max_x, max_y) share a point; a null side of b is an empty filter that meets all."""
    return F.coalesce((a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1]), F.lit(True))


def relevant(boxes: DataFrame, area: tuple[float, float, float, float] | None, prefix: str = "") -> DataFrame:
    """The rows whose box meets the area; without an area, all of them."""
    if area is None:
        return boxes
    own = [F.col(prefix + c) for c in ("min_x", "min_y", "max_x", "max_y")]
    return boxes.filter(boxes_meet(own, [F.lit(float(v)) for v in area]))


def overlap_share(a: list[Column], b: list[Column]) -> Column:
    """The share of box a that box b covers; 0 for a box without area."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    size = (a[2] - a[0]) * (a[3] - a[1])
    return F.when(size > 0, w * h / size).otherwise(F.lit(0.0))


def square_covered(x: Column, y: Column, box: list[Column], side: float = PREVIEW_SQUARE, least: float = 0.5) -> Column:
    """Whether the test square around a point lies in a box by at least half."""
    h = side / 2
    return overlap_share([x - h, y - h, x + h, y + h], box) >= least


def corners(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """The closed ring of a box, counter-clockwise."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(min_x, min_y), point(max_x, min_y), point(max_x, max_y), point(min_x, max_y), point(min_x, min_y))


def bounds_of(ring: Column) -> list[Column]:
    """min_x, min_y, max_x, max_y of a ring of (x, y)."""
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def pixel_window(tiles: DataFrame, cell: float = CELL) -> DataFrame:
    """tiles with top, bottom, left and right: the first and last row and column whose place lies in the clip box.

    Needs tl_x, tl_y (the first sample's place) and the clip box.
    """
    first = lambda d: F.greatest(F.ceil(d / cell), F.lit(0)).cast("int")
    last = lambda d: F.floor(d / cell).cast("int")
    return tiles.withColumns({
        "left": first(F.col("clip_min_x") - F.col("tl_x")), "right": last(F.col("clip_max_x") - F.col("tl_x")),
        "top": first(F.col("tl_y") - F.col("clip_max_y")), "bottom": last(F.col("tl_y") - F.col("clip_min_y")),
    })


# ---- contours and symbols
def elevation_tag(level: Column) -> Column:
    """The tags of a contour: its elevation as a string, whole metres without a point."""
    text = F.when(level == F.floor(level), level.cast("long").cast("string")).otherwise(level.cast("string"))
    return F.create_map(F.lit("Elevation"), text)


def elevation_key(level: Column) -> Column:
    """Whole centimetres, so that lines of one elevation meet on equal keys."""
    return F.round(level * 100).cast("long")


def contour_score(error: Column, energy: Column, weight: float) -> Column:
    return error + weight * energy


def total_energy(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, energy): the bending energies of the lines, added up. Needs a column energy."""
    return lines.groupBy(*keys).agg(F.sum("energy").alias("energy"))


def preview_scores(tiles: DataFrame) -> DataFrame:
    """One row: the means of the tiles' error, energy and score; nulls where there is no tile."""
    return tiles.agg(*[F.avg(c).alias(c) for c in ("error", "energy", "score")])


KINDS = {n: "area" for n, _, _ in params.AREAS} | {n: "line" for n, _, _ in params.LINES} | {n: "point" for n, _ in params.POINTS}
#: Symbols in the order in which they are drawn.
DRAW_ORDER = [
    "RoughOpenLand", "OpenLand", "SandyGround", "BareRock", "LightGreen", "MediumGreen", "DarkGreen", "Marsh", "PrivateArea", "PavedAreaWithBoundary",
    "BasemapContour", "FormLine", "Contour", "IndexContour", "SlopeLineFormLine", "SlopeLineContour", "NegBasemapContour", "SmallCrossableWatercourse",
    "DotKnoll", "ElongatedDotKnoll", "UDepression", "ShallowWaterWithSolidBankLine", "UncrossableWaterWithBankLine", "GiganticBoulder", "Building",
    "SmallBoulder", "LargeBoulder",
]


def with_symbol(objects: DataFrame, symbol: str) -> DataFrame:
    """objects as objects of another symbol of their own kind; an object of another kind fails the query."""
    if symbol not in KINDS:
        raise ValueError(f"unknown symbol {symbol}")
    kinds = F.create_map(*[x for n, k in KINDS.items() for x in (F.lit(n), F.lit(k))])
    same = F.element_at(kinds, F.col("symbol")) == KINDS[symbol]
    return objects.withColumn("symbol", F.when(same, F.lit(symbol)).otherwise(F.raise_error(F.concat(F.lit(f"{symbol} is of another kind than "), F.coalesce("symbol", F.lit("null"))))))


def drawn(objects: DataFrame) -> DataFrame:
    """objects with draw_order, the place of their symbol from 0; unknown symbols come last, as null."""
    places = F.create_map(*[x for k, n in enumerate(DRAW_ORDER) for x in (F.lit(n), F.lit(k))])
    return objects.withColumn("draw_order", F.element_at(places, F.col("symbol")))


def by_symbol(objects: DataFrame) -> DataFrame:
    """(symbol, n_objects, ids): a map's objects by symbol, ids in order."""
    return objects.groupBy("symbol").agg(F.count("*").alias("n_objects"), F.array_sort(F.collect_list("object_id")).alias("ids"))


def min_size_symbols(p: params.MapParams, made: set[str]) -> list[str]:
    """The symbols that the least area applies to, each once: those of the steps that are made, if the filter is on.

    Steps are openness, greens, cliffs, intensity and water.
    """
    names = {
        "openness": ["RoughOpenLand"], "greens": ["LightGreen", "MediumGreen", "DarkGreen"], "cliffs": ["GiganticBoulder"],
        "intensity": [i.symbol for i in p.intensity], "water": ["UncrossableWaterWithBankLine"],
    }
    return list(dict.fromkeys(n for step, symbols in names.items() if p.min_size and step in made for n in symbols))


def basemap_wanted(p: params.MapParams) -> bool:
    return p.contour.basemap and p.contour.basemap_interval >= 0.1


# ---- files
def crs_distinct(files: DataFrame) -> DataFrame:
    """(epsg, n_files) of the known systems; files without one are left out."""
    return files.filter("epsg is not null").groupBy("epsg").agg(F.count("*").alias("n_files"))


def footprint(files: DataFrame) -> DataFrame:
    """One row: n_files, total area in square kilometres and the box of all files."""
    size = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    box = [F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y")]
    return files.agg(F.count("*").alias("n_files"), (F.sum(size) / 1e6).alias("km2"), *box)


POLICIES = ["all", "each", "default", "drop", "local"]


def assigned_crs(files: DataFrame, policy: str, epsg: int | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """files with the system that a policy gives: ``all`` files get epsg; ``each`` what chosen (file_id, epsg) says, others
    go; ``default`` fills gaps with epsg; ``drop`` leaves out files without one; ``local``: none has one."""
    if policy == "all":
        return files.withColumn("epsg", F.lit(epsg).cast("int"))
    if policy == "each":
        given = chosen.select("file_id", F.col("epsg").alias("_given"))
        return files.join(given, "file_id", "left").withColumn("epsg", F.coalesce("epsg", "_given").cast("int")).drop("_given").filter("epsg is not null")
    if policy == "default":
        return files.withColumn("epsg", F.coalesce("epsg", F.lit(epsg)).cast("int"))
    if policy == "drop":
        return files.filter("epsg is not null")
    if policy == "local":
        return files.withColumn("epsg", F.lit(None).cast("int"))
    raise ValueError(f"policy must be one of {POLICIES}")


def conversion_decisions(files: DataFrame, area: tuple[float, float, float, float] | None = None) -> DataFrame:
    """files with action: ``skip`` outside the area, ``keep`` if indexed and of the map's system, ``transform`` if of
    another one, else ``convert``. The map's system is map_epsg; a file without a system is taken as the map's."""
    own = [F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    inside = F.lit(True) if area is None else boxes_meet(own, [F.lit(float(v)) for v in area])
    same = F.col("epsg").isNull() | F.col("epsg").eqNullSafe(F.col("map_epsg"))
    return files.withColumn("action", F.when(~inside, "skip").when(~same, "transform").when(F.col("indexed"), "keep").otherwise("convert"))


def transform_files(*_: object) -> None:
    """Files can't be moved to another system."""
    raise NotImplementedError("transforming files between coordinate systems is not yet supported")


def raster_path(path: str, layer: str) -> str:
    """Where a layer of a map is saved: <stem>_<layer>.tif beside it."""
    if layer not in RASTERS:
        raise ValueError(f"layer must be one of {RASTERS}")
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.stem}_{layer}.tif"))


def saved_rasters(save: bool, wanted: dict[str, bool]) -> list[str]:
    """The layers that are saved: none unless saving is on."""
    return [r for r in RASTERS if save and wanted.get(r, False)]


def check_stage(stage: str, files: int = 0, path: str | None = None, with_stats: int = 0) -> None:
    """Refuse a stage that lacks its input: files for all, a path for ``make_map``, statistics for ``make_map`` and ``preview``."""
    if files < 1:
        raise ValueError(f"{stage} needs files")
    if stage == "make_map" and not path:
        raise ValueError("make_map needs a path to save to")
    if stage in ("make_map", "preview") and with_stats < files:
        raise ValueError(f"{stage} needs statistics of all files")


def united(parts: list[DataFrame]) -> DataFrame:
    """The objects of all tiles as one table."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def with_rank(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


# ---- geographic coordinates
def _series() -> tuple[float, list[float], list[float]]:
    """Radius of the rectifying sphere, and the series coefficients to the third order of the ellipsoid's third flattening."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return radius, forward, back


def utm(lon: Column, lat: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """East and north in a UTM zone from degrees on WGS84."""
    radius, forward, _ = _series()
    n = WGS84_F / (2 - WGS84_F)
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    away = F.radians(lon - (6 * zone - 183))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east, up = eta, xi
    for k, a in enumerate(forward, 1):
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        up = up + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return UTM_EAST + UTM_SCALE * radius * east, UTM_SCALE * radius * up + (0.0 if north else 10_000_000.0)


def lon_lat(east: Column, up: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Degrees on WGS84 from a UTM zone."""
    radius, _, back = _series()
    xi0, eta0 = (up - (0.0 if north else 10_000_000.0)) / (UTM_SCALE * radius), (east - UTM_EAST) / (UTM_SCALE * radius)
    xi, eta = xi0, eta0
    for k, b in enumerate(back, 1):
        xi = xi - b * F.sin(2 * k * xi0) * F.cosh(2 * k * eta0)
        eta = eta - b * F.cos(2 * k * xi0) * F.sinh(2 * k * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    e2 = WGS84_F * (2 - WGS84_F)
    lat, e = chi, math.sqrt(e2)
    for _ in range(5):  # the conformal latitude's inverse, by iteration
        lat = F.asin(F.tanh(F.atanh(F.sin(chi)) + e * F.atanh(e * F.sin(lat))))
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (6 * zone - 183), F.degrees(lat)


def projected(x: Column, y: Column, epsg: int | None) -> tuple[Column, Column]:
    """Degrees on WGS84 to a system: UTM zones by their codes; without a system nothing changes."""
    if epsg is None:
        return x, y
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return utm(x, y, epsg % 100, epsg < 32700)
    raise ValueError(f"EPSG:{epsg} is not a known projection")
