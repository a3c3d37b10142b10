"""Rasters in cell form: one row a cell with tile_id, yi (southwards), xi, and a column a layer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.params import CELL, GROUND, TILE_PX, WATER

KEY = ["tile_id", "yi", "xi"]
MOMENTS = ["n", "s_i", "s_x", "s_y", "s_z", "s_xx", "s_xy", "s_yy", "s_xz", "s_yz", "s_zz"]


def grid(tiles: DataFrame, px: int = TILE_PX) -> DataFrame:
    """All cells of the tiles; tiles has tile_id, tl_x and tl_y, the place of the first sample."""
    return tiles.withColumn("yi", F.explode(F.sequence(F.lit(0), F.lit(px - 1)))).withColumn("xi", F.explode(F.sequence(F.lit(0), F.lit(px - 1))))


def binned(points: DataFrame, tiles: DataFrame, px: int = TILE_PX, cell: float = CELL, inside: bool = True) -> DataFrame:
    """Points with their nearest cell; those outside the grid are dropped unless told otherwise.

    Tiles go to the points, a row each: dealt by tile, all points of a tile would be sorted in one task.
    """
    near = lambda v: F.round(v / cell).cast("int")
    p = points.join(F.broadcast(tiles.select("tile_id", "tl_x", "tl_y")), "tile_id")
    p = p.withColumn("xi", near(F.col("x") - F.col("tl_x"))).withColumn("yi", near(F.col("tl_y") - F.col("y")))
    return p.filter(F.col("xi").between(0, px - 1) & F.col("yi").between(0, px - 1)) if inside else p


def block_dem(points: DataFrame, tiles: DataFrame, px: int = TILE_PX, cell: float = CELL, block: int = 8) -> DataFrame:
    """A coarse terrain model: the mean of ground and water points by block of cells, else the tile's mean."""
    p = binned(points.filter(F.col("classification").isin(GROUND, WATER)), tiles, px, cell)
    means = p.groupBy("tile_id", F.floor(F.col("yi") / block).alias("by"), F.floor(F.col("xi") / block).alias("bx")).agg(F.sum("z").alias("s"), F.count("z").alias("n"))
    # all blocks of a tile, few rows: the points are read once
    blocks = grid(tiles.select("tile_id"), -(-px // block)).select("tile_id", F.col("yi").cast("long").alias("by"), F.col("xi").cast("long").alias("bx"))
    tile = Window.partitionBy("tile_id")
    blocks = blocks.join(means, ["tile_id", "by", "bx"], "left").select("tile_id", "by", "bx", F.coalesce(F.col("s") / F.col("n"), F.sum("s").over(tile) / F.sum("n").over(tile)).alias("dem"))
    around = F.sequence(F.lit(0), F.lit(block - 1))
    cells = blocks.withColumn("oy", F.explode(around)).withColumn("ox", F.explode(around))
    cells = cells.select("tile_id", (F.col("by") * block + F.col("oy")).cast("int").alias("yi"), (F.col("bx") * block + F.col("ox")).cast("int").alias("xi"), "dem")
    return cells.filter((F.col("yi") < px) & (F.col("xi") < px)) if px % block else cells


def heights(points: DataFrame, tiles: DataFrame, dem: DataFrame, px: int = TILE_PX, cell: float = CELL) -> DataFrame:
    """Points inside the grid with their height above the terrain."""
    return binned(points, tiles, px, cell).join(dem, KEY).withColumn("hag", F.col("z") - F.col("dem"))


def canopy_height(points: DataFrame, power: float = 8.0) -> DataFrame:
    """The power mean of heights by cell; negative heights count as 0. Points come from ``heights``."""
    p = float(min(max(power, 1.0), 64.0)) if math.isfinite(power) else 1.0
    return points.groupBy(*KEY).agg(F.pow(F.avg(F.pow(F.greatest("hag", F.lit(0.0)), F.lit(p))), F.lit(1 / p)).alias("height"))


def filled(tiles: DataFrame, cells: DataFrame, layer: str, px: int = TILE_PX) -> DataFrame:
    """The layer on all cells, 0 where there is no row."""
    return grid(tiles.select("tile_id"), px).join(cells, KEY, "left").select(*KEY, F.coalesce(layer, F.lit(0.0)).alias(layer))


def vegetation_density(points: DataFrame, tiles: DataFrame, dem: DataFrame, radius: float = 2.0, px: int = TILE_PX, cell: float = CELL) -> DataFrame:
    """Shares of ground, low, medium and high returns around each cell, by a Gaussian weight within the radius.

    A point meets the cells of a fixed square around its own one, so the join is an explode with a residual test.
    """
    reach = int(math.ceil(radius / cell))
    p = binned(points, tiles, px, cell, inside=False).filter(F.col("xi").between(-reach, px - 1 + reach) & F.col("yi").between(-reach, px - 1 + reach))
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(px - 1), F.col(c)))
    d = dem.select("tile_id", F.col("yi").alias("dy"), F.col("xi").alias("dx"), "dem")
    p = p.withColumn("dy", clamp("yi")).withColumn("dx", clamp("xi")).join(d, ["tile_id", "dy", "dx"]).withColumn("hag", F.col("z") - F.col("dem"))
    around = F.sequence(F.lit(-reach), F.lit(reach))
    p = p.select("tile_id", "x", "y", "tl_x", "tl_y", "hag", F.col("yi").alias("py"), (F.col("xi")).alias("px"), F.explode(around).alias("oy")).withColumn("ox", F.explode(around))
    p = p.withColumn("yi", F.col("py") + F.col("oy")).withColumn("xi", F.col("px") + F.col("ox")).filter(F.col("xi").between(0, px - 1) & F.col("yi").between(0, px - 1))
    ex, ey = F.col("x") - (F.col("tl_x") + cell * F.col("xi")), F.col("y") - (F.col("tl_y") - cell * F.col("yi"))
    p = p.withColumn("d2", ex * ex + ey * ey).filter(F.col("d2") <= radius * radius)
    sigma = max(radius / 2, cell)
    w = F.exp(-F.col("d2") / (2 * sigma * sigma))
    share = lambda test: F.sum(F.when(test, w).otherwise(0.0)) / F.sum(w)
    h = F.col("hag")
    return p.groupBy(*KEY).agg(share(h < 0.2).alias("ground"), share((h >= 0.2) & (h < 1.5)).alias("low"), share((h >= 1.5) & (h < 3)).alias("medium"), share(h >= 3).alias("high"))


def ndvd(weights: tuple[float, float, float] = (0.5, 0.35, 0.15)) -> Column:
    """The vegetation index of the columns ground, low, medium and high, from 0 to 1."""
    v = weights[0] * F.col("low") + weights[1] * F.col("medium") + weights[2] * F.col("high")
    total = v + F.col("ground")
    return F.when(total > 1e-12, ((v - F.col("ground")) / total + 1) / 2).otherwise(F.lit(0.0))


def normalised(cells: DataFrame, layer: str) -> DataFrame:
    """(v - min) / max over each tile, as the maps use it; 0 where the greatest is 0."""
    m = cells.groupBy("tile_id").agg(F.min(layer).alias("_lo"), F.max(layer).alias("_hi"))
    return cells.join(F.broadcast(m), "tile_id").select(*KEY, F.when(F.col("_hi") == 0, F.lit(0.0)).otherwise((F.col(layer) - F.col("_lo")) / F.nullif(F.col("_hi"), F.lit(0.0))).alias(layer))


def around(cells: DataFrame, layer: str) -> DataFrame:
    """Each cell with its eight neighbours as nw n ne w c e sw s se; beyond the tile's edge the nearest cell counts.

    Two window passes over rows and columns, not eight joins.
    """
    row, column = Window.partitionBy("tile_id", "yi").orderBy("xi"), Window.partitionBy("tile_id", "xi").orderBy("yi")
    v = F.col(layer)
    r = cells.select(*KEY, F.coalesce(F.lag(v).over(row), v).alias("w"), v.alias("c"), F.coalesce(F.lead(v).over(row), v).alias("e"))
    take = lambda f, c: F.coalesce(f(F.col(c)).over(column), F.col(c))
    return r.select(*KEY, take(F.lag, "w").alias("nw"), take(F.lag, "c").alias("n"), take(F.lag, "e").alias("ne"), "w", "c", "e", take(F.lead, "w").alias("sw"), take(F.lead, "c").alias("s"), take(F.lead, "e").alias("se"))


def sobel(cell: float = CELL) -> tuple[Column, Column]:
    """Westward and northward differences of the columns of ``around``; the divisor is two cells."""
    c = F.col
    v = (c("nw") - c("ne") + 2 * c("w") - 2 * c("e") + c("sw") - c("se")) / (2 * cell)
    h = (c("nw") - c("sw") + 2 * c("n") - 2 * c("s") + c("ne") - c("se")) / (2 * cell)
    return v, h


def slope(cells: DataFrame, layer: str, cell: float = CELL) -> DataFrame:
    v, h = sobel(cell)
    return around(cells, layer).select(*KEY, (F.sqrt(v * v + h * h) / math.sqrt(2)).alias("slope"))


def hillshade(cells: DataFrame, layer: str, azimuth: float = 3 * math.pi / 4, cell: float = CELL) -> DataFrame:
    """Light from 45 degrees above the horizon on the layer's surface, never below 0."""
    v, h = sobel(cell)
    low = math.cos(math.pi / 4)
    lit = (v * (math.cos(azimuth) * low) - h * (math.sin(azimuth) * low) + math.sin(math.pi / 4)) / F.sqrt(v * v + h * h + 1)
    return around(cells, layer).select(*KEY, F.greatest(lit, F.lit(0.0)).alias("hillshade"))


def terrain_change(cells: DataFrame, layer: str, interval: float = 5.0, cell: float = CELL) -> DataFrame:
    """Gradient and scaled curvature in one dimensionless measure."""
    c, sq = F.col, cell * cell
    zx, zy = (c("e") - c("w")) / (2 * cell), (c("n") - c("s")) / (2 * cell)
    xx, yy = (c("e") - 2 * c("c") + c("w")) / sq, (c("n") - 2 * c("c") + c("s")) / sq
    xy = (c("ne") - c("nw") - c("se") + c("sw")) / (4 * sq)
    bend = interval * interval * (xx * xx + 2 * xy * xy + yy * yy)
    return around(cells, layer).select(*KEY, F.sqrt(zx * zx + zy * zy + bend).alias("terrain_change"))


def normals(cells: DataFrame, layer: str, cell: float = CELL) -> DataFrame:
    """Falls of the layer to the east and north, with weights 1-2-1 over eight cells."""
    c = F.col
    nx = -(c("se") - c("sw") + 2 * (c("e") - c("w")) + c("ne") - c("nw")) / (8 * cell)
    ny = -(c("nw") - c("sw") + 2 * (c("n") - c("s")) + c("ne") - c("se")) / (8 * cell)
    return around(cells, layer).select(*KEY, nx.alias("nx"), ny.alias("ny"))


def box_sum(cells: DataFrame, layers: list[str], half: int) -> DataFrame:
    """Sums over a square of 2 * half + 1 cells, clipped at the tile: one pass along rows, one along columns."""
    row = Window.partitionBy("tile_id", "yi").orderBy("xi").rowsBetween(-half, half)
    column = Window.partitionBy("tile_id", "xi").orderBy("yi").rowsBetween(-half, half)
    r = cells.select(*KEY, *[F.sum(c).over(row).alias(c) for c in layers])
    return r.select(*KEY, *[F.sum(c).over(column).alias(c) for c in layers])


def box_adjust(cells: DataFrame, truth: str, model: str, half: int, amplitude: float) -> DataFrame:
    """The model moved towards the truth by the mean difference over a clipped square."""
    s = box_sum(cells.withColumn("_d", F.col(truth) - F.col(model)).withColumn("_one", F.lit(1.0)), ["_d", "_one"], half)
    return cells.join(s, KEY).select(*KEY, (F.col(model) + amplitude * F.col("_d") / F.col("_one")).alias(model))


def plane_moments(points: DataFrame, tiles: DataFrame, px: int = TILE_PX, cell: float = CELL) -> DataFrame:
    """The eleven sums of a plane fit of single returns by cell, in coordinates of the tile."""
    p = binned(points.filter("return_number = 1 and number_of_returns = 1"), tiles, px, cell)
    p = p.withColumn("px", F.col("x") - F.col("tl_x")).withColumn("py", F.col("tl_y") - F.col("y"))
    s = lambda e, n: F.sum(F.expr(e)).alias(n)
    return p.groupBy(*KEY).agg(F.sum(F.lit(1.0)).alias("n"), s("intensity", "s_i"), s("px", "s_x"), s("py", "s_y"), s("z", "s_z"), s("px*px", "s_xx"), s("px*py", "s_xy"), s("py*py", "s_yy"), s("px*z", "s_xz"), s("py*z", "s_yz"), s("z*z", "s_zz"))


def water_likelihood(sums: DataFrame, density: Column, mean: Column, deviation: Column, half: int = 6, px: int = TILE_PX, cell: float = CELL) -> DataFrame:
    """How likely a cell is water, from the box sums of ``plane_moments`` and the statistics of all points."""
    c = F.col
    n = F.nullif(c("n"), F.lit(0.0))
    cov = lambda a, b: c(f"s_{a}{b}") - c(f"s_{a}") * c(f"s_{b}") / n
    s = sums.select(*KEY, "n", "s_i", density.alias("density"), mean.alias("mean"), deviation.alias("deviation"), cov("x", "x").alias("xx"), cov("x", "y").alias("xy"), cov("y", "y").alias("yy"), cov("x", "z").alias("xz"), cov("y", "z").alias("yz"), F.greatest(cov("z", "z"), F.lit(0.0)).alias("zz"))
    density, mean, deviation = c("density"), c("mean"), c("deviation")
    s = s.withColumn("det", F.nullif(c("xx") * c("yy") - c("xy") * c("xy"), F.lit(0.0)))
    s = s.withColumn("ax", (c("xz") * c("yy") - c("yz") * c("xy")) / c("det")).withColumn("ay", (c("yz") * c("xx") - c("xz") * c("xy")) / c("det"))
    extent = lambda i: F.least(c(i) + half, F.lit(px - 1)) - F.greatest(c(i) - half, F.lit(0)) + 1
    rmse2 = F.greatest(c("zz") - c("ax") * c("xz") - c("ay") * c("yz"), F.lit(0.0)) / n
    dens = n / (extent("yi") * extent("xi") * cell * cell)
    sparse = F.greatest(density * 0.25, F.lit(2.220446049250313e-16))
    d_score = 1 / (1 + (dens / sparse) * (dens / sparse))
    flat = F.exp(-rmse2 / 0.01) * F.exp(-(c("ax") * c("ax") + c("ay") * c("ay")) / (0.015 * 0.015))
    scale = F.greatest(deviation, F.lit(1.0))
    i_score = 1 / (1 + F.exp((c("s_i") / n - (mean - 0.5 * scale)) / scale))
    evidence = 1 - F.exp(-(n - 5) / 6)
    value = F.pow(flat, F.lit(0.7)) * F.pow(d_score, F.lit(0.15)) * F.pow(i_score, F.lit(0.15)) * evidence
    ok = (n >= 6) & (c("det") > 2.220446049250313e-16)
    return s.select(*KEY, F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(0.0).alias("water"))


def mosaic(rasters: DataFrame, cell: float = CELL) -> DataFrame:
    """(gy, gx, v): tiles' inner cells on one global grid; overlapping cells are averaged.

    rasters has tl_x, tl_y, yi, xi, v and the half-open inner window top, bottom, left, right.
    """
    inner = rasters.filter("yi >= top and yi < bottom and xi >= left and xi < right and v is not null and not isnan(v)")
    gx, gy = F.round(F.col("tl_x") / cell).cast("long") + F.col("xi"), F.round(-F.col("tl_y") / cell).cast("long") + F.col("yi")
    return inner.groupBy(gy.alias("gy"), gx.alias("gx")).agg(F.avg("v").alias("v"))


def rendered(cells: DataFrame, v: str = "v") -> DataFrame:
    """Values as 1 to 255 between the least and the greatest; a constant raster is 255."""
    span = cells.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    byte = F.when(F.col("_hi") > F.col("_lo"), F.round((F.col(v) - F.col("_lo")) * 254 / (F.col("_hi") - F.col("_lo"))) + 1).otherwise(255)
    return cells.join(F.broadcast(span)).select("gy", "gx", byte.cast("int").alias("byte"))
