"""Contours, threshold masks and line measures as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.operators.raster import KEY
from groundline.params import CELL

#: By the corners at or above the level (1 nw, 2 ne, 4 se, 8 sw), the edges a contour enters and leaves by;
#: edges are 0 top, 1 right, 2 bottom, 3 left, and high ground lies on the left.
SEGMENTS = {1: [(3, 0)], 2: [(0, 1)], 3: [(3, 1)], 4: [(1, 2)], 5: [(1, 0), (3, 2)], 6: [(0, 2)], 7: [(3, 2)], 8: [(2, 3)], 9: [(2, 0)], 10: [(0, 1), (2, 3)], 11: [(2, 1)], 12: [(1, 3)], 13: [(1, 0)], 14: [(0, 3)]}


def levels(ranges: DataFrame, interval: float) -> DataFrame:
    """One row a contour level for each row with min_z and max_z."""
    n = F.ceil((F.col("max_z") - F.col("min_z")) / interval).cast("int") + 1
    first = F.floor(F.col("min_z") / interval) * interval
    return ranges.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("level", first + F.col("k") * interval).drop("k")


def level_symbol(level: Column, interval: float, tolerance: float = 1e-8) -> Column:
    """Index contours at multiples of five intervals, contours at multiples of one, form lines between."""
    multiple = lambda step: F.abs(level - F.round(level / step) * step) < tolerance
    return F.when(multiple(5 * interval), "IndexContour").when(multiple(interval), "Contour").otherwise("FormLine")


def mask(cells: DataFrame, layer: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """(tile_id, n_cells, area): cells at or above low and below high, by tile; tiles without such cells have 0."""
    v = F.col(layer)
    test = F.lit(True) if low is None else v >= low
    test = test if high is None else test & (v < high)
    n = F.sum(F.when(test, 1).otherwise(0))
    return cells.groupBy("tile_id").agg(n.alias("n_cells"), (n * CELL * CELL).alias("area"))


def segments(cells: DataFrame, layer: str, level: float, cell: float = CELL) -> DataFrame:
    """Marching-squares segments between cells (inside the tile): from_edge, to_edge and both ends in cell units.

    Four corners meet in one row by two lead() windows; the case table is exploded, so no step leaves the JVM.
    """
    row, column = Window.partitionBy("tile_id", "yi").orderBy("xi"), Window.partitionBy("tile_id", "xi").orderBy("yi")
    v = F.col(layer)
    q = cells.select(*KEY, v.alias("nw"), F.lead(v).over(row).alias("ne"))
    q = q.select("*", F.lead("nw").over(column).alias("sw"), F.lead("ne").over(column).alias("se")).filter("ne is not null and sw is not null and se is not null")
    bit = lambda c, b: F.when(F.col(c) >= level, b).otherwise(0)
    q = q.withColumn("case", bit("nw", 1) + bit("ne", 2) + bit("se", 4) + bit("sw", 8)).filter("case > 0 and case < 15")
    table = F.create_map(*[x for k, s in SEGMENTS.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in s]))])
    q = q.withColumn("s", F.explode(F.element_at(table, F.col("case"))))
    part = lambda a, b: (level - F.col(a)) / (F.col(b) - F.col(a))
    x = lambda e: F.when(e == 0, F.col("xi") + part("nw", "ne")).when(e == 1, F.col("xi") + 1.0).when(e == 2, F.col("xi") + part("sw", "se")).otherwise(F.col("xi") + 0.0)
    y = lambda e: F.when(e == 0, F.col("yi") + 0.0).when(e == 1, F.col("yi") + part("ne", "se")).when(e == 2, F.col("yi") + 1.0).otherwise(F.col("yi") + part("nw", "sw"))
    a, b = F.col("s.a"), F.col("s.b")
    return q.select(*KEY, F.lit(float(level)).alias("level"), a.alias("from_edge"), b.alias("to_edge"), x(a).alias("x1"), y(a).alias("y1"), x(b).alias("x2"), y(b).alias("y2"))


def is_closed(line: Column) -> Column:
    return (F.size(line) > 2) & F.element_at(line, 1).eqNullSafe(F.element_at(line, -1))


def ring_area(line: Column) -> Column:
    """Signed area of a closed line of (x, y), counter-clockwise positive; 0 for an open one."""
    cross = F.zip_with(F.slice(line, F.lit(1), F.size(line) - 1), F.slice(line, F.lit(2), F.size(line) - 1), lambda p, q: p.x * q.y - q.x * p.y)
    return F.when(is_closed(line), F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2).otherwise(F.lit(0.0))


def ring_moments(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with mid_x, mid_y, aspect and rotation: the vertices' mean, the ratio of their principal moments and the
    direction of the axis, modulo pi."""
    n = F.size(line)
    total = lambda f: F.aggregate(F.transform(line, f), F.lit(0.0), lambda s, v: s + v)
    m = lines.withColumn("mid_x", total(lambda p: p.x) / n).withColumn("mid_y", total(lambda p: p.y) / n)
    dx, dy = lambda p: p.x - F.col("mid_x"), lambda p: p.y - F.col("mid_y")
    m = m.withColumn("xx", total(lambda p: dx(p) * dx(p)) / n).withColumn("yy", total(lambda p: dy(p) * dy(p)) / n).withColumn("xy", total(lambda p: dx(p) * dy(p)) / n)
    root = F.sqrt((F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")) + 4 * F.col("xy") * F.col("xy"))
    m = m.withColumn("l1", (F.col("xx") + F.col("yy") + root) / 2).withColumn("l2", (F.col("xx") + F.col("yy") - root) / 2)
    eps = 1000 * 2.220446049250313e-16
    flat, aligned = F.abs("l2") <= eps, F.abs("xy") <= eps
    upright = F.when(F.col("xx") >= F.col("yy"), F.lit(0.0)).otherwise(F.lit(math.pi / 2))
    angle = F.when(aligned, upright).when(flat, 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))).otherwise(F.atan2(F.col("l1") - F.col("xx"), F.col("xy")) + math.pi / 2)
    turned = F.when(angle < 0, angle + math.pi).when(angle >= math.pi, angle - math.pi).otherwise(angle)
    return m.withColumn("aspect", F.when(flat, F.lit(float("inf"))).otherwise(F.col("l1") / F.col("l2"))).withColumn("rotation", turned).drop("xx", "yy", "xy", "l1", "l2")


def bending_energy(lines: DataFrame, line: str = "line", exponent: int = 1) -> DataFrame:
    """lines with energy: squared turning angles over mean lengths, by the line's length; 1000 below three vertices.

    Legs without a length are left out; a line of such legs only has 1000 as well.
    """
    c = F.col
    legs = F.zip_with(F.slice(line, F.lit(1), F.size(line) - 1), F.slice(line, F.lit(2), F.size(line) - 1), lambda p, q: F.struct((q.x - p.x).alias("x"), (q.y - p.y).alias("y"), F.sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)).alias("l")))
    m = lines.withColumn("_legs", F.when(F.size(line) >= 3, F.filter(legs, lambda s: s.l > 0))).withColumn("_closed", is_closed(c(line)))
    turn = lambda a, b: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a.x * b.x + a.y * b.y) / (a.l * b.l))))
    follow = F.when(c("_closed"), F.concat(F.slice("_legs", F.lit(2), F.size("_legs")), F.slice("_legs", 1, 1))).otherwise(F.slice("_legs", F.lit(2), F.size("_legs")))
    m = m.withColumn("_next", follow)
    parts = F.zip_with("_legs", "_next", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), turn(a, b) * turn(a, b) / ((a.l + b.l) / 2)).otherwise(0.0))
    whole = F.aggregate(F.transform("_legs", lambda s: s.l), F.lit(0.0), lambda s, v: s + v)
    energy = F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.pow(whole, F.lit(float(exponent))), F.lit(0.0))
    return m.withColumn("energy", F.coalesce(energy, F.lit(1000.0))).drop("_legs", "_next", "_closed")


def dot_knolls(lines: DataFrame, least: float = 10.0, most: float = 160.0, aspect: float = 1.5, line: str = "line") -> DataFrame:
    """Each line with its fate: kept, dropped (a small loop below least), or a point symbol with place and rotation."""
    m = ring_moments(lines.withColumn("area", ring_area(F.col(line))), line)
    size = F.abs("area")
    small = is_closed(F.col(line)) & (size <= most)
    knoll = F.when(F.col("area") < 0, "UDepression").when((F.col("aspect") < aspect) | (F.col("area") < (most + least) / 2 + least), "DotKnoll").otherwise("ElongatedDotKnoll")
    return m.withColumn("fate", F.when(~small, "kept").when(size < least, "dropped").otherwise(knoll))


def merged_ranges(ranges: DataFrame, gap: float) -> DataFrame:
    """Ranges (line_id, start, end, important) merged where the next one starts within the gap: gaps and islands."""
    w = Window.partitionBy("line_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = ranges.withColumn("fresh", F.when(before.isNull() | (F.col("start") - before > gap), 1).otherwise(0))
    r = r.withColumn("island", F.sum("fresh").over(w))
    return r.groupBy("line_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("important").alias("important"))


def elongated(start: Column, end: Column, share: float) -> tuple[Column, Column]:
    """A range widened to the share around its middle and moved into [0, 1]."""
    a, b = (start + end) / 2 - share / 2, (start + end) / 2 + share / 2
    a, b = F.when(a < 0, F.lit(0.0)).otherwise(a), F.when(a < 0, b - a).otherwise(b)
    return F.greatest(F.when(b > 1, a - (b - 1)).otherwise(a), F.lit(0.0)), F.when(b > 1, F.lit(1.0)).otherwise(b)


def substring(lines: DataFrame, start: Column, end: Column, line: str = "line") -> DataFrame:
    """lines with part: what lies between two shares of the length, with new end points."""
    c = F.col
    legs = F.zip_with(F.slice(line, F.lit(1), F.size(line) - 1), F.slice(line, F.lit(2), F.size(line) - 1), lambda p, q: F.sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)))
    m = lines.withColumn("_l", legs)
    run = F.aggregate("_l", F.array(F.lit(0.0)), lambda s, v: F.concat(s, F.array(F.element_at(s, -1) + v)))
    m = m.withColumn("_at", run).withColumn("_from", start * F.element_at("_at", -1)).withColumn("_to", end * F.element_at("_at", -1))
    m = m.withColumn("_v", F.zip_with(line, "_at", lambda p, a: F.struct(p.x.alias("x"), p.y.alias("y"), a.alias("a"))))

    def point(at: Column) -> Column:
        low = F.element_at(F.filter("_v", lambda v: v.a <= at), -1)
        high = F.element_at(F.filter("_v", lambda v: v.a >= at), 1)
        t = F.when(high.a > low.a, (at - low.a) / (high.a - low.a)).otherwise(0.0)
        return F.struct((low.x + t * (high.x - low.x)).alias("x"), (low.y + t * (high.y - low.y)).alias("y"))

    inner = F.transform(F.filter("_v", lambda v: (v.a > c("_from")) & (v.a < c("_to"))), lambda v: F.struct(v.x.alias("x"), v.y.alias("y")))
    return m.withColumn("part", F.concat(F.array(point(c("_from"))), inner, F.array(point(c("_to"))))).drop("_l", "_at", "_from", "_to", "_v")


def end_matches(lines: DataFrame, delta: float) -> DataFrame:
    """(start_id, end_id, d2): for each line's start the nearest line end of the same elevation within delta.

    Both are dealt to buckets of the size of delta; a start looks into the nine buckets around it. Tips at one place are one
    row, an end's with its least id, so pairs grow with the places that are within delta of each other, not with the lines.
    """
    b = lambda v: F.floor(v / delta)
    tips = lines.select("elevation", "line_id", F.element_at("line", 1).alias("p"), F.element_at("line", -1).alias("q"))
    tips = tips.select("elevation", "line_id", F.col("p.x").alias("sx"), F.col("p.y").alias("sy"), F.col("q.x").alias("ex"), F.col("q.y").alias("ey"))
    ends = tips.groupBy("elevation", "ex", "ey").agg(F.min("line_id").alias("end_id"))
    ends = ends.withColumn("bx", b(F.col("ex"))).withColumn("by", b(F.col("ey")))
    near = F.sequence(F.lit(-1), F.lit(1))
    places = tips.select("elevation", "sx", "sy").distinct().select("*", F.explode(near).alias("ox")).withColumn("oy", F.explode(near))
    places = places.withColumn("bx", b(F.col("sx")) + F.col("ox")).withColumn("by", b(F.col("sy")) + F.col("oy"))
    d2 = (F.col("sx") - F.col("ex")) * (F.col("sx") - F.col("ex")) + (F.col("sy") - F.col("ey")) * (F.col("sy") - F.col("ey"))
    m = places.join(ends, ["elevation", "bx", "by"]).withColumn("d2", d2).filter(F.col("d2") <= delta * delta)
    m = m.groupBy("elevation", "sx", "sy").agg(F.min(F.struct("d2", "end_id")).alias("m"))
    return tips.select("elevation", F.col("line_id").alias("start_id"), "sx", "sy").join(m, ["elevation", "sx", "sy"]).select("start_id", "m.end_id", "m.d2")
