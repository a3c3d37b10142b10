"""A map from terrain layers: the steps of a tile, and what is done with all tiles' objects together.

Objects are rows (tile_id, symbol, kind, elevation, coordinates): kind is area, line or point; coordinates are rings, one
line or one point, in metres of the map's own system. A tile is one group of a fixed size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.operators import contour as C
from groundline.operators import features as A
from groundline.operators import kernels as N
from groundline.operators import polygons as P
from groundline.operators.columns import KINDS, basemap_wanted, min_size_symbols
from groundline.params import AREAS, CELL, SIMPLIFY, MapParams
from groundline.session import checkpointed

OBJECT = "tile_id int, symbol string, kind string, elevation double, coordinates array<array<array<double>>>"
STEPS = {"basemap", "contours", "openness", "greens", "water", "cliffs", "intensity"}
LAYERS = ["dem", "returns", "intensity", "slope", "ndvd", "water"]
#: The layer that a step draws from, besides the terrain.
DRAWN_FROM = {"openness": "returns", "greens": "ndvd", "water": "water", "cliffs": "slope", "intensity": "intensity"}
#: Score and its change at which error correction of a whole map ends; gaps that water and line tips close over.
FINAL_STOP, WATER_GAP, TIP_GAP = (0.9, 1.1), 1.0, 0.5


def _levels(z: np.ndarray, interval: float) -> list[float]:
    """Every contour level of a raster; none without a value."""
    if not np.isfinite(z).any():
        return []
    z = z[np.isfinite(z)]
    first = math.floor(z.min() / interval) * interval
    return [first + k * interval for k in range(math.ceil((z.max() - z.min()) / interval) + 1)]


def _symbol(level: float, interval: float) -> str:
    multiple = lambda step: abs(level - round(level / step) * step) < 1e-8
    return "IndexContour" if multiple(5 * interval) else "Contour" if multiple(interval) else "FormLine"


def tile_steps(rasters: dict[str, np.ndarray], p: MapParams, steps: set[str], cut: P.Rings | None = None, cell: float = CELL) -> list[tuple[str, str, float | None, list]]:
    """(symbol, kind, elevation, coordinates) of one tile, in metres from its first sample; ``cut`` is the area that counts."""
    z = rasters["dem"]
    rows, columns = z.shape
    frame = [P.box(0.0, -(rows - 1) * cell, (columns - 1) * cell, 0.0)]
    # closed lines run along the border where the raster ends; those parts are no contours
    edge = 1e-5
    inner = P.intersection(cut, [P.box(edge, edge - (rows - 1) * cell, (columns - 1) * cell - edge, -edge)]) if cut is not None else [P.box(edge, edge - (rows - 1) * cell, (columns - 1) * cell - edge, -edge)]
    cut = cut if cut is not None else frame
    out: list[tuple[str, str, float | None, list]] = []

    def lines(raster: np.ndarray, interval: float, symbol_of) -> None:
        for level, line in N.contours_of(raster, _levels(z, interval), SIMPLIFY, cell):
            if len(line) > 1:
                for part in P.clipped(line * (cell, -cell), inner):
                    out.append((symbol_of(level), "line", level, A.as_lists([part])))

    def areas(symbol: str, rings: P.Rings) -> None:
        for polygon in P.polygons_of(P.intersection(rings, cut)):
            out.append((symbol, "area", None, A.as_lists(polygon)))

    ring = lambda layer, level, upper=True: A.area_rings(rasters[layer], level, upper, p.buffers, SIMPLIFY, frame, cell)
    if "basemap" in steps and basemap_wanted(p):
        lines(z, p.contour.basemap_interval, lambda level: "BasemapContour")
    if "contours" in steps:
        interval = p.contour.interval / 2 if p.contour.form_lines else p.contour.interval
        raster = z
        if p.contour.algorithm == "smooth":
            raster = N.smoothed(z, 15, 15, p.contour.steps, cell)
        elif p.contour.algorithm == "naive":
            raster = N.error_corrected(z, _levels(z, interval), p.contour.steps, p.contour.energy_weight, FINAL_STOP, cell)[0]
        lines(raster, interval, lambda level: _symbol(level, p.contour.interval))
    if "openness" in steps:
        areas("RoughOpenLand", ring("returns", p.vegetation.openness, False))
    if "greens" in steps:
        for level, name in zip(p.vegetation.green, ("LightGreen", "MediumGreen", "DarkGreen"), strict=True):
            areas(name, ring("ndvd", level))
    if "water" in steps:
        areas("UncrossableWaterWithBankLine", ring("water", p.water))
    if "cliffs" in steps:
        areas("GiganticBoulder", ring("slope", p.cliff))
    if "intensity" in steps:
        for f in p.intensity:
            areas(f.symbol, P.intersection(ring("intensity", f.low), ring("intensity", f.high, False)))
    return out


def layers_of(steps: set[str]) -> list[str]:
    """The terrain and the layers that the steps draw from."""
    return [n for n in LAYERS if n == "dem" or n in {DRAWN_FROM.get(step) for step in steps}]


def tile_objects(layers: DataFrame, tiles: DataFrame, p: MapParams, steps: set[str] = STEPS) -> DataFrame:
    """The objects of every tile; layers has tile_id, yi, xi and the steps' LAYERS, tiles tile_id, tl_x and tl_y.

    Tiles without cells have no objects. Form lines are pruned by ``form_lines_pruned`` of the caller if that is wanted.
    """
    if unknown := steps - STEPS:
        raise ValueError(f"unknown steps {sorted(unknown)}")
    names = layers_of(steps)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = (int(pdf["yi"].max()) + 1, int(pdf["xi"].max()) + 1)
        rasters = {}
        for name in names:
            rasters[name] = np.full(shape, np.nan)
            rasters[name][pdf["yi"], pdf["xi"]] = pdf[name]
        x0, y0 = float(pdf["tl_x"].iloc[0]), float(pdf["tl_y"].iloc[0])
        rows = [(int(pdf["tile_id"].iloc[0]), s, k, e, [[[x + x0, y + y0] for x, y in ring] for ring in c]) for s, k, e, c in tile_steps(rasters, p, steps)]
        return pd.DataFrame(rows, columns=["tile_id", "symbol", "kind", "elevation", "coordinates"])

    return layers.select("tile_id", "yi", "xi", *names).join(F.broadcast(tiles.select("tile_id", "tl_x", "tl_y")), "tile_id").groupBy("tile_id").applyInPandas(run, OBJECT)


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("object_id", F.xxhash64("symbol", F.to_json("coordinates")))


def finished(objects: DataFrame, p: MapParams, steps: set[str] = STEPS) -> DataFrame:
    """(symbol, kind, elevation, coordinates, rotation): all tiles' objects after the steps over the whole map, in order:
    small areas, gaps of water, depressions of the basemap, lines tip to tail, small closed contours as points."""
    objects = checkpointed(objects)  # read many times below: tiles are worked on once
    least = {n: a * (4 / 9 if p.scale == 10_000 else 1) for n, _, a in AREAS}
    names = min_size_symbols(p, steps)
    areas = objects.filter("kind = 'area'").select("symbol", F.col("coordinates").alias("rings"))
    small = F.col("symbol").isin(names) if names else F.lit(False)
    size = F.create_map(*[x for n in least for x in (F.lit(n), F.lit(float(least[n])))])
    kept = _numbered(areas.filter(small).withColumn("coordinates", F.col("rings"))).dropDuplicates(["object_id"]).withColumn("min_area", F.element_at(size, F.col("symbol")))
    merged = A.absorbed_areas(kept.select("object_id", "symbol", "min_area", "rings")).select("symbol", "rings") if names else areas.limit(0)
    areas = areas.filter(~small).unionByName(merged)
    water = F.col("symbol") == "UncrossableWaterWithBankLine"
    areas = areas.filter(~water).unionByName(A.dissolved_areas(areas.filter(water), "symbol", WATER_GAP).select("symbol", "rings"))
    point = F.transform(F.get("coordinates", F.lit(0)), lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    lines = objects.filter("kind = 'line'").select("symbol", "elevation", point.alias("line"))
    down = (F.col("symbol") == "BasemapContour") & (C.ring_area(F.col("line")) < 0)
    lines = lines.withColumn("symbol", F.when(down, "NegBasemapContour").otherwise(F.col("symbol")))
    lines = A.merged_lines(lines.withColumn("line_id", F.xxhash64("symbol", "elevation", F.to_json("line"))).dropDuplicates(["line_id"]), TIP_GAP)
    own = F.col("symbol").isin("Contour", "IndexContour", "FormLine")
    fates = C.dot_knolls(lines.filter(own), p.contour.knoll_min, p.contour.knoll_max)
    as_line = F.array(F.transform("line", lambda q: F.array(q.x, q.y)))
    none = F.lit(None).cast("double")
    kept_lines = fates.filter("fate = 'kept'").select("symbol", "elevation", "line").unionByName(lines.filter(~own))
    points = fates.filter("fate not in ('kept', 'dropped')").select(F.col("fate").alias("symbol"), F.lit("point").alias("kind"), "elevation", F.array(F.array(F.array("mid_x", "mid_y"))).alias("coordinates"), F.when(F.col("fate") == "ElongatedDotKnoll", F.col("rotation")).alias("rotation"))
    out = areas.select("symbol", F.lit("area").alias("kind"), none.alias("elevation"), F.col("rings").alias("coordinates"), none.alias("rotation"))
    out = out.unionByName(kept_lines.select("symbol", F.lit("line").alias("kind"), "elevation", as_line.alias("coordinates"), none.alias("rotation")))
    return out.unionByName(points)


def updated(old: DataFrame, new: DataFrame, symbols: list[str]) -> DataFrame:
    """The old objects with those of the given symbols replaced; a symbol without new objects is removed."""
    if unknown := set(symbols) - set(KINDS):
        raise ValueError(f"unknown symbols {sorted(unknown)}")
    return old.filter(~F.col("symbol").isin(symbols)).unionByName(new.filter(F.col("symbol").isin(symbols)))


def covered_area(boxes: list[tuple[float, float, float, float]], polygon: np.ndarray | None = None) -> list[P.Rings]:
    """The union of file boxes inside a filter polygon, as polygons; none left is refused, as is an invalid filter."""
    if polygon is not None and not P.is_valid(polygon):
        raise ValueError("the filter must be a closed ring that does not cross itself")
    rings = [P.box(*b) for b in boxes]
    if polygon is not None:
        ring = P.closed(polygon)
        rings = P.intersection(rings, [ring if P.ring_area(ring) > 0 else ring[::-1]])
    found = P.polygons_of(P.union(rings)) if rings else []
    if not found:
        raise ValueError("the filter does not meet the files")
    return found
