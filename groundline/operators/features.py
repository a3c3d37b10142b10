"""Map features: areas from thresholds, form lines, merged lines, curves and tile preparation.

Areas and lines are rows with nested arrays: a polygon is ``rings array<array<array<double>>>`` (a shell, then its holes),
a line ``array<struct<x,y>>``. Geometry runs in numpy, one tile, chain or line a call; what crosses tiles is found with
joins on equal keys. Empty tables give empty results; null geometry is empty geometry.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.operators import kernels as N
from groundline.operators import polygons as P
from groundline.operators.contour import end_matches, is_closed
from groundline.operators.tiling import components
from groundline.params import CELL, SIMPLIFY, BufferRule

AREA = "tile_id int, part int, area double, rings array<array<array<double>>>"
#: Metres around important terrain, and the gap over which a form line is joined again.
FORM_LINE_BUFFER, RECONNECT = 2.0, 3.0


def as_rings(value) -> P.Rings:
    return [np.array([list(p) for p in ring], float).reshape(-1, 2) for ring in (value if value is not None else [])]


def as_lists(rings: P.Rings) -> list:
    return [[[float(x), float(y)] for x, y in ring] for ring in rings]


def _coordinates(rings: str, k: int) -> Column:
    """All x (k = 0) or y (k = 1) of a polygon."""
    return F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p[k])))


# ---- areas
def area_rings(z: np.ndarray, level: float, upper: bool = True, buffers: tuple[BufferRule, ...] = (), simplify: float = 0.0, frame: P.Rings | None = None, cell: float = CELL) -> P.Rings:
    """The area of a raster at or above a level (``upper``) or below it, in metres east and north of the first sample."""
    rows, columns = z.shape
    frame = frame if frame is not None else [P.box(0.0, -(rows - 1) * cell, (columns - 1) * cell, 0.0)]
    # the padding's lines come to lie on the border itself
    lines = [line.clip(0, (columns - 1, rows - 1)) * (cell, -cell) for line in N.stitched(z, level)]
    rings = P.from_contours([np.vstack([x, x[:1]]) if (x[0] != x[-1]).any() else x for x in lines], frame, inverted=not upper)
    for rule in buffers:
        rings = P.buffered(rings, rule.metres if rule.direction == "grow" else -rule.metres)
    if buffers:
        rings = P.intersection(rings, frame)
    return [x for x in (N.simplified(r, simplify) for r in rings) if len(x) > 3] if simplify else rings


def threshold_areas(cells: DataFrame, layer: str, level: float, upper: bool = True, buffers: tuple[BufferRule, ...] = (), simplify: float = 0.0) -> DataFrame:
    """(tile_id, part, area, rings): the polygons where a layer is at or above a level, or below it, by tile."""

    def run(tile: int, z: np.ndarray) -> pd.DataFrame:
        parts = P.polygons_of(area_rings(z, level, upper, buffers, simplify))
        rows = [(tile, k, P.area(p), as_lists(p)) for k, p in enumerate(parts)]
        return pd.DataFrame(rows, columns=["tile_id", "part", "area", "rings"])

    return N.per_tile(cells, run, AREA, layer)


def band_areas(cells: DataFrame, layer: str, low: float, high: float) -> DataFrame:
    """(tile_id, part, area, rings): where a layer is at or above low and below high."""

    def run(tile: int, z: np.ndarray) -> pd.DataFrame:
        parts = P.polygons_of(P.intersection(area_rings(z, low), area_rings(z, high, upper=False)))
        return pd.DataFrame([(tile, k, P.area(p), as_lists(p)) for k, p in enumerate(parts)], columns=["tile_id", "part", "area", "rings"])

    return N.per_tile(cells, run, AREA, layer)


def importance_areas(cells: DataFrame, change: str, improvement: str | None = None, least_change: float = 0.8, least_error: float = 0.15) -> DataFrame:
    """(tile_id, important, buffered): where the terrain changes much, or interpolation without form lines errs; and that
    area grown by FORM_LINE_BUFFER."""
    layers = [(change, least_change)] + ([(improvement, least_error)] if improvement else [])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = (int(pdf["yi"].max()) + 1, int(pdf["xi"].max()) + 1)
        rings: P.Rings = []
        for name, level in layers:
            z = np.full(shape, np.nan)
            z[pdf["yi"], pdf["xi"]] = pdf[name]
            rings += area_rings(z, level)
        rings = P.union(rings)
        return pd.DataFrame([(int(pdf["tile_id"].iloc[0]), as_lists(rings), as_lists(P.buffered(rings, FORM_LINE_BUFFER)))], columns=["tile_id", "important", "buffered"])

    kind = "array<array<array<double>>>"
    return cells.select("tile_id", "yi", "xi", *[n for n, _ in layers]).groupBy("tile_id").applyInPandas(run, f"tile_id int, important {kind}, buffered {kind}")


def absorbed_areas(areas: DataFrame, key: str = "symbol", least: str = "min_area", cell: float = 512.0) -> DataFrame:
    """(key, cluster, area, rings): areas below their symbol's least size go into touching larger ones, else they go.

    Only areas whose boxes meet can touch, so each connected cluster of boxes is one group, and large maps are many.
    Needs object_id, key, least and rings.
    """
    x, y = _coordinates("rings", 0), _coordinates("rings", 1)
    a = areas.withColumns({"_x0": F.array_min(x), "_x1": F.array_max(x), "_y0": F.array_min(y), "_y1": F.array_max(y)})
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    dealt = a.select("object_id", key, "_x0", "_x1", "_y0", "_y1", F.explode(span("_x0", "_x1")).alias("_bx")).withColumn("_by", F.explode(span("_y0", "_y1")))
    # a sweep by rows of the bucket: each box is linked with the furthest-reaching one that begins before it
    other = dealt.select(F.col("object_id").alias("dst"), F.col(key).alias("_k"), *[F.col(f"_{c}").alias(f"o{c}") for c in ("x0", "x1", "y0", "y1", "bx", "by")])
    meet = (F.col("_x0") <= F.col("ox1")) & (F.col("_x1") >= F.col("ox0")) & (F.col("_y0") <= F.col("oy1")) & (F.col("_y1") >= F.col("oy0"))
    edges = dealt.join(other, (F.col(key) == F.col("_k")) & (F.col("_bx") == F.col("obx")) & (F.col("_by") == F.col("oby")) & meet & (F.col("object_id") < F.col("dst")))
    labels = components(areas.select(F.col("object_id").alias("file_id")), edges.select(F.col("object_id").alias("src"), "dst").distinct())
    own = areas.join(labels.select(F.col("file_id").alias("object_id"), F.col("component").alias("cluster")), "object_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("object_id")
        found = P.absorbed([as_rings(r) for r in pdf["rings"]], float(pdf[least].iloc[0]))
        return pd.DataFrame([(pdf[key].iloc[0], pdf["cluster"].iloc[0], P.area(p), as_lists(p)) for p in found], columns=[key, "cluster", "area", "rings"])

    schema = f"{key} {areas.schema[key].dataType.simpleString()}, cluster {areas.schema['object_id'].dataType.simpleString()}, area double, rings array<array<array<double>>>"
    return own.select(key, "cluster", "object_id", least, "rings").groupBy(key, "cluster").applyInPandas(run, schema)


def dissolved_areas(areas: DataFrame, key: str, gap: float = 0.0) -> DataFrame:
    """(key, part, area, rings): the areas of each key as one set, gaps of up to twice ``gap`` closed; tags are dropped."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = P.dissolved([as_rings(r) for r in pdf["rings"]], gap)
        return pd.DataFrame([(pdf[key].iloc[0], k, P.area(p), as_lists(p)) for k, p in enumerate(found)], columns=[key, "part", "area", "rings"])

    return areas.select(key, "rings").groupBy(key).applyInPandas(run, f"{key} {areas.schema[key].dataType.simpleString()}, part int, area double, rings array<array<array<double>>>")


def intersecting(left: DataFrame, right: DataFrame, cell: float = 512.0) -> DataFrame:
    """(left_id, right_id): pairs of polygons that share a point; boxes are joined by buckets, geometry then decides.

    Both need object_id and rings.
    """

    def boxed(df: DataFrame, name: str) -> DataFrame:
        x, y = _coordinates("rings", 0), _coordinates("rings", 1)
        b = df.select(F.col("object_id").alias(f"{name}_id"), F.col("rings").alias(f"{name}_rings"), F.array_min(x).alias("x0"), F.array_max(x).alias("x1"), F.array_min(y).alias("y0"), F.array_max(y).alias("y1"))
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
        b = b.withColumn("bx", F.explode(span("x0", "x1"))).withColumn("by", F.explode(span("y0", "y1")))
        return b.withColumnsRenamed({c: f"{name}_{c}" for c in ("x0", "x1", "y0", "y1")})

    p = boxed(left, "left").join(boxed(right, "right"), ["bx", "by"])
    meet = (F.col("left_x0") <= F.col("right_x1")) & (F.col("left_x1") >= F.col("right_x0")) & (F.col("left_y0") <= F.col("right_y1")) & (F.col("left_y1") >= F.col("right_y0"))
    # a pair is looked at in the bucket of the corner of its boxes' overlap only
    corner = (F.col("bx") == F.floor(F.greatest("left_x0", "right_x0") / cell)) & (F.col("by") == F.floor(F.greatest("left_y0", "right_y0") / cell))
    p = p.filter(meet & corner).select("left_id", "left_rings", "right_id", "right_rings")

    def run(batches):
        for pdf in batches:
            good = [P.touch(as_rings(a), as_rings(b)) for a, b in zip(pdf["left_rings"], pdf["right_rings"], strict=True)]
            yield pdf.loc[good, ["left_id", "right_id"]]

    kinds = [df.schema["object_id"].dataType.simpleString() for df in (left, right)]
    return p.mapInPandas(run, f"left_id {kinds[0]}, right_id {kinds[1]}")


def prepared_tile(hull: np.ndarray, box: tuple[float, float, float, float]) -> P.Rings:
    """A tile's area: its hull inside the cut box; of several parts the largest."""
    parts = P.polygons_of(P.intersection([P.closed(hull)], [P.box(*box)]))
    return max(parts, key=P.area) if parts else []


# ---- lines
def clipped_lines(line: np.ndarray, rings: P.Rings) -> list[np.ndarray]:
    return P.clipped(line, rings)


def _length(line: np.ndarray) -> float:
    return float(np.hypot(*np.diff(line, axis=0).T).sum()) if len(line) > 1 else 0.0


def located(line: np.ndarray, point: np.ndarray) -> float:
    """Where along a line, as a share of its length, the place nearest to a point lies."""
    legs = np.diff(line, axis=0)
    size = np.hypot(*legs.T)
    t = np.clip(((point - line[:-1]) * legs).sum(1) / np.maximum(size**2, 1e-300), 0, 1)
    k = int(np.hypot(*(line[:-1] + t[:, None] * legs - point).T).argmin())
    return float((size[:k].sum() + t[k] * size[k]) / size.sum())


def part_of(line: np.ndarray, start: float, end: float) -> np.ndarray:
    """What lies between two shares of the length, with new ends and without points that repeat."""
    at = np.append(0.0, np.cumsum(np.hypot(*np.diff(line, axis=0).T)))
    place = lambda s: np.array([np.interp(s * at[-1], at, line[:, k]) for k in (0, 1)])
    inner = line[(at > start * at[-1]) & (at < end * at[-1])]
    out = np.vstack([place(start), inner, place(end)])
    return out[np.append(True, (np.abs(np.diff(out, axis=0)) > 1e-12).any(1))]


def rotated(line: np.ndarray, seam: int) -> np.ndarray:
    """A closed line that begins at another of its points."""
    return np.vstack([line[seam:-1], line[: seam + 1]])


def _merged(ranges: list[list], gap: float) -> list[list]:
    out: list[list] = []
    for start, end, important in sorted(ranges):
        if out and start - out[-1][1] <= gap:
            out[-1][1], out[-1][2] = max(out[-1][1], end), out[-1][2] or important
        else:
            out.append([start, end, important])
    return out


def pruned_form_line(line: np.ndarray, important: P.Rings, buffered: P.Rings, least_open: float = 3.75, least_closed: float = 2.25) -> list[np.ndarray]:
    """The parts of a form line that are worth drawing: those in the buffered area, gaps of up to RECONNECT joined, short
    ones only if they meet important terrain, and then made as long as the least length."""
    line = np.asarray(line, float)
    whole = _length(line)
    if len(line) < 2 or whole <= np.finfo(float).eps:
        return []
    ring = bool((line[0] == line[-1]).all())
    if ring:  # the seam goes where the line is not kept, so no kept part crosses it
        outside = np.flatnonzero(~P.contains(buffered, line[:-1]))
        if len(outside) and outside[0] > 0:
            return pruned_form_line(rotated(line, int(outside[0])), important, buffered, least_open, least_closed)
    least = least_closed if ring else least_open
    parts = P.clipped(line, buffered)
    matters = lambda part: sum(map(_length, P.clipped(part, important))) > SIMPLIFY
    for part in parts:
        if len(part) > 2 and (part[0] == part[-1]).all():
            return [line] if matters(part) or whole >= least else []
    ranges = [[*sorted((located(line, part[0]), located(line, part[-1]))), matters(part)] for part in parts]
    kept = []
    for start, end, important_part in _merged(ranges, RECONNECT / whole):
        if (end - start) * whole < least:
            if not important_part:
                continue
            share, middle = min(least / whole, 1.0), (start + end) / 2
            start = min(max(middle - share / 2, 0.0), 1 - share)
            end = start + share
        kept.append([start, end, important_part])
    return [part_of(line, a, b) for a, b, _ in _merged(kept, np.finfo(float).eps)]


def pruned_form_lines(lines: DataFrame, areas: DataFrame) -> DataFrame:
    """(tile_id, line_id, part, line): the form lines of each tile pruned by the tile's importance areas.

    lines has tile_id, line_id and line; areas is of ``importance_areas``. A tile without areas keeps nothing.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for k, part in enumerate(pruned_form_line(np.array([(p["x"], p["y"]) for p in r.line]), as_rings(r.important), as_rings(r.buffered))):
                    rows.append((r.tile_id, r.line_id, k, [{"x": float(x), "y": float(y)} for x, y in part]))
            yield pd.DataFrame(rows, columns=["tile_id", "line_id", "part", "line"])

    both = lines.join(areas, "tile_id").select("tile_id", "line_id", "line", "important", "buffered")
    kind = lines.schema["line_id"].dataType.simpleString()
    return both.mapInPandas(run, f"tile_id int, line_id {kind}, part int, line array<struct<x:double,y:double>>")


def merge_chains(lines: DataFrame, delta: float) -> DataFrame:
    """(line_id, next_id, chain): which open line follows at each line's end, and the chain it belongs to.

    A line start takes the nearest end of its elevation within delta; an end goes to the nearest of several starts, the
    lesser id on a tie. A line that follows itself is a closed one. Needs line_id, elevation and line.
    """
    pairs = end_matches(lines, delta)
    chosen = pairs.groupBy("end_id").agg(F.min(F.struct("d2", "start_id")).alias("m")).select(F.col("end_id").alias("line_id"), F.col("m.start_id").alias("next_id"))
    labels = components(lines.select(F.col("line_id").alias("file_id")), chosen.filter("line_id <> next_id").select(F.col("line_id").alias("src"), F.col("next_id").alias("dst")))
    out = labels.select(F.col("file_id").alias("line_id"), F.col("component").alias("chain")).join(chosen, "line_id", "left")
    return out.select("line_id", "next_id", "chain")


def merged_lines(lines: DataFrame, delta: float = 0.5) -> DataFrame:
    """(symbol, elevation, line): lines of one symbol and elevation joined tip to tail where tips are within delta.

    Lines that are closed stay; chains that come back to their start, or within delta of it, are closed. Needs symbol,
    elevation, line_id and line. One chain is one group: its size is that of one map line.
    """
    ends = lines.withColumn("_closed", is_closed(F.col("line")) | (F.size("line") < 2))
    whole = ends.filter("_closed").select("symbol", "elevation", "line")
    loose = ends.filter("not _closed").drop("_closed")
    keyed = loose.withColumn("elevation_of", F.col("elevation")).withColumn("elevation", F.struct("symbol", "elevation"))
    chains = merge_chains(keyed.select("line_id", "elevation", "line"), delta)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        line = {r.line_id: [(p["x"], p["y"]) for p in r.line] for r in pdf.itertuples(index=False)}
        follow = {r.line_id: int(r.next_id) for r in pdf.itertuples(index=False) if not pd.isna(r.next_id)}
        begin = sorted(set(line) - set(follow.values())) or [min(line)]
        out, at = list(line[begin[0]]), begin[0]
        seen, ring = {begin[0]}, False
        while at in follow:
            at = follow[at]
            if at in seen:
                ring = True
                break
            seen.add(at)
            out = out[:-1] + line[at]
        if ring or math.dist(out[0], out[-1]) <= delta:
            out = [*out, out[0]] if out[0] != out[-1] else out
        return pd.DataFrame([(pdf["symbol"].iloc[0], pdf["elevation"].iloc[0], [{"x": float(x), "y": float(y)} for x, y in out])], columns=["symbol", "elevation", "line"])

    kinds = {c: lines.schema[c].dataType.simpleString() for c in ("symbol", "elevation")}
    schema = f"symbol {kinds['symbol']}, elevation {kinds['elevation']}, line array<struct<x:double,y:double>>"
    joined = loose.join(chains, "line_id").select("chain", "line_id", "next_id", "symbol", "elevation", "line")
    return whole.unionByName(joined.groupBy("chain").applyInPandas(run, schema))


# ---- curves
def bezier(line: np.ndarray, error: float) -> np.ndarray:
    """(n, 4, 2): cubic pieces that stay within an error of a line's points, by least squares and splitting at the worst
    point; two points give a straight piece with its thirds."""
    points = np.asarray(line, float)
    points = points[np.append(True, (np.diff(points, axis=0) != 0).any(1))]
    if len(points) < 2:
        return np.zeros((0, 4, 2))

    def unit(v: np.ndarray) -> np.ndarray:
        n = np.hypot(*v)
        return v / n if n else v

    def at(c: np.ndarray, t: np.ndarray) -> np.ndarray:
        t = t[:, None]
        return (1 - t) ** 3 * c[0] + 3 * (1 - t) ** 2 * t * c[1] + 3 * (1 - t) * t**2 * c[2] + t**3 * c[3]

    def fit(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        third = np.hypot(*(p[-1] - p[0])) / 3
        if len(p) == 2:
            return [np.array([p[0], p[0] + a * third, p[1] + b * third, p[1]])]
        t = np.append(0.0, np.cumsum(np.hypot(*np.diff(p, axis=0).T)))
        t /= t[-1]
        for turn in range(5):
            b1, b2 = 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t**2
            x, y = b1[:, None] * a, b2[:, None] * b
            rest = p - at(np.array([p[0], p[0], p[-1], p[-1]]), t)
            m = np.array([[(x * x).sum(), (x * y).sum()], [(x * y).sum(), (y * y).sum()]])
            r = np.array([(x * rest).sum(), (y * rest).sum()])
            alpha = np.linalg.solve(m, r) if abs(np.linalg.det(m)) > 1e-12 else np.array([third, third])
            alpha = np.where(alpha < 1e-6 * third * 3, third, alpha)
            c = np.array([p[0], p[0] + alpha[0] * a, p[-1] + alpha[1] * b, p[-1]])
            off = np.hypot(*(at(c, t) - p).T)
            if off.max() <= error:
                return [c]
            if turn < 4:  # move each point's place on the curve nearer to the point
                d1 = 3 * ((1 - t) ** 2)[:, None] * (c[1] - c[0]) + 6 * ((1 - t) * t)[:, None] * (c[2] - c[1]) + 3 * (t**2)[:, None] * (c[3] - c[2])
                d2 = 6 * (1 - t)[:, None] * (c[2] - 2 * c[1] + c[0]) + 6 * t[:, None] * (c[3] - 2 * c[2] + c[1])
                v = at(c, t) - p
                under = (d1 * d1).sum(1) + (v * d2).sum(1)
                t = np.maximum.accumulate(np.clip(t - np.where(np.abs(under) > 1e-12, (v * d1).sum(1) / np.where(under == 0, 1, under), 0), 0, 1))
                t[0], t[-1] = 0.0, 1.0
        k = int(np.clip(off.argmax(), 1, len(p) - 2))
        middle = unit(p[k - 1] - p[k + 1])
        return fit(p[: k + 1], a, middle) + fit(p[k:], -middle, b)

    return np.array(fit(points, unit(points[1] - points[0]), unit(points[-2] - points[-1])))


def curved(lines: DataFrame, error: float) -> DataFrame:
    """lines with curves, an array of cubic pieces of four points each."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(curves=[bezier(np.array([(p["x"], p["y"]) for p in line]), error).tolist() for line in pdf["line"]])

    from pyspark.sql import types as T

    kind = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
    return lines.mapInPandas(run, T.StructType([*lines.schema.fields, T.StructField("curves", kind)]))
