"""Sequential or topological kernels in numpy, one tile at a time, and their distributed wrapper."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from groundline.params import CELL, SIMPLIFY

#: Points that a worker adds to the sites of its tiles before it drops what is nearest to no cell.
HELD = 200_000


def per_tile(cells: DataFrame, run: Callable[[int, np.ndarray], pd.DataFrame], schema: str, layer: str) -> DataFrame:
    """run(tile_id, raster) for every tile of a layer in cell form; a tile is one group of a fixed size."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        raster = np.full((int(pdf["yi"].max()) + 1, int(pdf["xi"].max()) + 1), np.nan)
        raster[pdf["yi"], pdf["xi"]] = pdf[layer]
        return run(int(pdf["tile_id"].iloc[0]), raster)

    return cells.select("tile_id", "yi", "xi", layer).groupBy("tile_id").applyInPandas(group, schema)


def as_cells(tile_id: int, raster: np.ndarray, layer: str) -> pd.DataFrame:
    yi, xi = np.indices(raster.shape, dtype=np.int32).reshape(2, -1)
    return pd.DataFrame({"tile_id": np.int32(tile_id), "yi": yi, "xi": xi, layer: raster.ravel()})


def normal_field(z: np.ndarray, cell: float = CELL) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(z, 1, mode="edge")
    nw, n, ne, w, e, sw, s, se = p[:-2, :-2], p[:-2, 1:-1], p[:-2, 2:], p[1:-1, :-2], p[1:-1, 2:], p[2:, :-2], p[2:, 1:-1], p[2:, 2:]
    return -(se - sw + 2 * (e - w) + ne - nw) / (8 * cell), -(nw - sw + 2 * (n - s) + ne - se) / (8 * cell)


def _cosine(ax, ay, bx, by):
    return (ax * bx + ay * by + 1) / np.sqrt((ax * ax + ay * ay + 1) * (bx * bx + by * by + 1))


def smoothed(z: np.ndarray, angle: float, size: int, sweeps: int, cell: float = CELL) -> np.ndarray:
    """Feature-preserving smoothing: normals averaged where they are alike, then elevations fitted to them.

    The sweeps update in place, so a cell sees what its row and the row above have become. Cells with equal x + 2y do
    not depend on each other; they are updated together, in rising order, with the same result as one by one.
    """
    if size < 3 or size % 2 == 0 or sweeps < 1 or not 0 <= angle <= 60:
        raise ValueError("an odd size from 3, sweeps from 1 and an angle of at most 60 degrees are needed")
    limit = math.cos(math.radians(angle))
    nx, ny = normal_field(z, cell)
    h = size // 2
    px, py = np.pad(nx, h, mode="edge"), np.pad(ny, h, mode="edge")
    total, ax, ay = np.zeros_like(z), np.zeros_like(z), np.zeros_like(z)
    for dy in range(size):
        for dx in range(size):
            bx, by = px[dy : dy + z.shape[0], dx : dx + z.shape[1]], py[dy : dy + z.shape[0], dx : dx + z.shape[1]]
            d = _cosine(nx, ny, bx, by) - limit
            w = np.where(d > 0, d * d, 0.0)
            total += w
            ax += bx * w
            ay += by * w
    sx, sy = ax / total, ay / total
    rows, columns = z.shape
    yy, xx = np.indices(z.shape)
    wave = (xx + 2 * yy).ravel()
    order = np.argsort(wave, kind="stable")
    cuts = np.flatnonzero(np.diff(wave[order])) + 1
    steps = [(1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1)]
    near, weight, rise = [], [], []
    for dx, dy in steps:
        y, x = np.clip(yy + dy, 0, rows - 1), np.clip(xx + dx, 0, columns - 1)
        d = _cosine(sx, sy, sx[y, x], sy[y, x]) - limit
        near.append((y * columns + x).ravel())
        weight.append(np.where(d > 0, d * d, 0.0).ravel())
        # the offset from the neighbour to this cell, eastwards and northwards
        rise.append((-(sx[y, x] * (-dx * cell) + sy[y, x] * (dy * cell))).ravel())
    near, weight, rise = np.array(near), np.array(weight), np.array(rise)
    total = weight.sum(0)
    out = z.ravel().copy()
    for _ in range(sweeps):
        for group in np.split(order, cuts):
            value = ((rise[:, group] + out[near[:, group]]) * weight[:, group]).sum(0)
            moved = total[group] > np.finfo(float).eps
            out[group[moved]] = value[moved] / total[group[moved]]
    return out.reshape(z.shape)


def _nearest_by_ring(x: np.ndarray, y: np.ndarray, px: int, n: int) -> pd.DataFrame:
    """(cell, ring, d2, row, column, site): for each cell its nearest site in the first ring of buckets that has a site, and in
    the next one; of equally near sites that of the lesser bucket, then the one given first.

    Buckets hold a site each on average of all ``n``; a ring is counted from the cell's own bucket. Of a part of the sites the
    rows' sites are enough: what they leave out is nearest in none of the two rings of the whole set either.
    """
    size = max(1, int(math.sqrt(px * px / max(1, n))))
    blocks = -(-px // size)
    far = 2 * blocks + 2
    width = blocks + 2 * far
    j, i = (np.floor_divide(v, size) + far for v in (y, x))
    site = np.flatnonzero((j >= 0) & (j < width) & (i >= 0) & (i < width))
    key = (j[site] * width + i[site]).astype(np.int64)
    site = site[np.argsort(key, kind="stable")]
    length = np.bincount(key, minlength=width * width)
    start = length.cumsum() - length
    full = np.pad((length > 0).reshape(width, width).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    first, at = np.full((blocks, blocks), -1), np.arange(blocks) + far
    for ring in range(far + 1):
        lo, hi = at - ring, at + ring + 1
        first[(first < 0) & (full[hi][:, hi] - full[lo][:, hi] - full[hi][:, lo] + full[lo][:, lo] > 0)] = ring
        if (first >= 0).all():
            break
    block, rings, bucket = [], [], []
    for least in np.unique(first[first >= 0]).tolist():
        by, bx = np.nonzero(first == least)
        for ring in range(least, min(least + 1, far) + 1):
            for dy in range(-ring, ring + 1):
                for dx in range(-ring, ring + 1) if abs(dy) == ring else (-ring, ring) if ring else (0,):
                    k = (by + far + dy) * width + bx + far + dx
                    some = length[k] > 0
                    block.append((by * blocks + bx)[some])
                    rings.append(np.full(some.sum(), ring))
                    bucket.append(k[some])
    block, rings, bucket = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (block, rings, bucket))
    oy, ox = np.indices((size, size)).reshape(2, 1, -1)
    cy, cx = ((block // blocks)[:, None] * size + oy).ravel(), ((block % blocks)[:, None] * size + ox).ravel()
    rings, bucket = np.repeat(rings, size * size), np.repeat(bucket, size * size)
    inside = (cy < px) & (cx < px)
    cy, cx, rings, bucket = cy[inside], cx[inside], rings[inside], bucket[inside]
    chosen, d2 = np.zeros(len(cy), np.int64), np.zeros(len(cy))
    todo = np.cumsum(length[bucket]) // 1_000_000  # distances at a time
    for part in np.split(np.arange(len(cy)), np.flatnonzero(np.diff(todo)) + 1) if len(cy) else []:
        m = length[bucket[part]]
        begin, own = m.cumsum() - m, np.repeat(np.arange(len(part)), m)
        k = site[np.arange(m.sum()) - np.repeat(begin - start[bucket[part]], m)]
        d = (cx[part][own] - x[k]) ** 2 + (cy[part][own] - y[k]) ** 2
        d2[part] = np.minimum.reduceat(d, begin)
        hit = np.flatnonzero(d == d2[part][own])
        chosen[part] = k[hit[np.searchsorted(own[hit], np.arange(len(part)))]]
    out = pd.DataFrame({"cell": cy * px + cx, "ring": rings, "d2": d2, "row": bucket // width, "column": bucket % width, "site": chosen})
    return out.sort_values(["cell", "ring", "d2", "row", "column"]).drop_duplicates(["cell", "ring"])


def nearest_sites(points: DataFrame, values: list[str], px: int) -> DataFrame:
    """The points that ``discrete_sibson`` needs of each tile, with n, the number of all: at most two a cell.

    Points are dropped where they are read, and once more tile after tile; a worker holds those sites and HELD points more, so
    a tile may have any number. Needs tile_id, cx, cy in cells, and the values.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    names = ["tile_id", "cx", "cy", *values]

    def kept(batches: list) -> pa.RecordBatch:
        pdf = pa.Table.from_batches(batches).to_pandas().sort_values(names)
        parts = [g.iloc[np.unique(_nearest_by_ring(g["cx"].to_numpy(), g["cy"].to_numpy(), px, int(g["n"].iloc[0]))["site"])] for _, g in pdf.groupby("tile_id")]
        return pa.RecordBatch.from_pandas(pd.concat(parts), schema=batches[0].schema, preserve_index=False)

    def run(batches, by_tile: bool):
        held, rows, least = [], 0, HELD
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= least:
                sites = kept(held)
                tiles = sites.column("tile_id").to_numpy()
                # tiles before the last one are complete, or there are sites of very many tiles
                done = np.searchsorted(tiles, tiles[-1]) if by_tile else len(tiles) if len(tiles) >= max(2 * HELD, 4 * px * px) else 0
                if done:
                    yield sites.slice(0, done)
                held = [sites.slice(done)] if done < len(tiles) else []
                rows = len(tiles) - done
                least = HELD + rows
        if held:
            yield kept(held)

    counts = points.groupBy("tile_id").agg(F.count("*").alias("n"))
    p = points.join(F.broadcast(counts), "tile_id").select(*names, "n")
    few = p.mapInArrow(lambda batches: run(batches, False), p.schema)
    return few.repartition("tile_id").sortWithinPartitions("tile_id").mapInArrow(lambda batches: run(batches, True), p.schema)


def discrete_sibson(x: np.ndarray, y: np.ndarray, value: np.ndarray, px: int, slope: np.ndarray | None = None, n: int | None = None) -> np.ndarray:
    """Natural-neighbour interpolation on cells: each cell gives its nearest site's value to all cells within that site's
    distance; a cell's value is the mean of what it is given. Sites are in cell units. Published by Park et al., 2006.

    ``slope`` (n, 2): a site then gives its value carried on along its slope (per cell) to the cell that takes it.
    ``n``: how many sites there were, if these are what ``nearest_sites`` left of them.
    """
    near = _nearest_by_ring(x, y, px, len(x) if n is None else n)
    # one ring more than the first that has a site, for the corners
    near = near.sort_values(["cell", "d2", "ring", "row", "column"]).drop_duplicates("cell")
    if len(near) < px * px:
        raise ValueError("no site is near the tile")
    best, site = near["d2"].to_numpy().reshape(px, px), near["site"].to_numpy().reshape(px, px)
    total, taken = np.zeros(px * px), np.zeros(px * px)
    radius = np.sqrt(best)
    for r in np.unique(np.ceil(radius).astype(int)):
        at = np.flatnonzero(np.ceil(radius).astype(int).ravel() == r)
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                y2, x2 = at // px + dy, at % px + dx
                ok = (dx * dx + dy * dy <= best.ravel()[at]) & (y2 >= 0) & (y2 < px) & (x2 >= 0) & (x2 < px)
                own = site.ravel()[at[ok]]
                given = value[own] if slope is None else value[own] + slope[own, 0] * (x2[ok] - x[own]) + slope[own, 1] * (y2[ok] - y[own])
                np.add.at(total, (y2 * px + x2)[ok], given)
                np.add.at(taken, (y2 * px + x2)[ok], 1)
    return (total / np.maximum(taken, 1)).reshape(px, px)


def stitched(z: np.ndarray, level: float) -> list[np.ndarray]:
    """Closed contours of a raster in cell units (x, y southwards): the border is padded below every level, so each line
    closes; high ground lies to the left in map orientation."""
    from groundline.operators.contour import SEGMENTS

    low = min(float(np.nanmin(z)), level) - 1e6
    p = np.pad(np.nan_to_num(z, nan=low), 1, constant_values=low)
    up = p >= level
    case = up[:-1, :-1] + 2 * up[:-1, 1:] + 4 * up[1:, 1:] + 8 * up[1:, :-1]

    def place(y: int, x: int, edge: int) -> tuple[tuple, float, float]:
        (y1, x1), (y2, x2) = {0: ((y, x), (y, x + 1)), 1: ((y, x + 1), (y + 1, x + 1)), 2: ((y + 1, x), (y + 1, x + 1)), 3: ((y, x), (y + 1, x))}[edge]
        t = (level - p[y1, x1]) / (p[y2, x2] - p[y1, x1])
        return (y1, x1, y2, x2), x1 + t * (x2 - x1) - 1, y1 + t * (y2 - y1) - 1

    follow: dict[tuple, tuple] = {}
    where: dict[tuple, tuple[float, float]] = {}
    for y, x in zip(*np.nonzero((case > 0) & (case < 15)), strict=True):
        for a, b in SEGMENTS[int(case[y, x])]:
            (ka, xa, ya), (kb, xb, yb) = place(y, x, a), place(y, x, b)
            follow[ka] = kb
            where[ka], where[kb] = (xa, ya), (xb, yb)
    lines = []
    while follow:
        first, at = follow.popitem()
        line = [where[first], where[at]]
        while at != first and at in follow:
            at = follow.pop(at)
            line.append(where[at])
        lines.append(np.array(line))
    return lines


def simplified(line: np.ndarray, tolerance: float = SIMPLIFY) -> np.ndarray:
    """Douglas-Peucker simplification."""
    if len(line) < 3:
        return line
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, r = line[a], line[b], line[a + 1 : b]
        d = q - p
        norm = math.hypot(*d)
        off = np.abs(d[0] * (r[:, 1] - p[1]) - d[1] * (r[:, 0] - p[0])) / norm if norm > 0 else np.hypot(*(r - p).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """The hull's corners, counter-clockwise, by a monotone chain."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(rows):
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def corner_slopes(z: np.ndarray, reach: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, values, slopes) of a raster's four corners, in cells; slopes are differences over ``reach`` cells inwards."""
    rows, columns = z.shape
    places, values, slopes = [], [], []
    for y, x in ((0, 0), (0, columns - 1), (rows - 1, 0), (rows - 1, columns - 1)):
        dx, dy = (1 if x == 0 else -1), (1 if y == 0 else -1)
        places.append((x, y))
        values.append(z[y, x])
        slopes.append((dx * (z[y, x + dx * reach] - z[y, x]) / reach, dy * (z[y + dy * reach, x] - z[y, x]) / reach))
    return np.array(places, float), np.array(values), np.array(slopes)


def vertex_slopes(lines: list[tuple[float, np.ndarray]], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, values, slopes) of contours' points, in cells (y southwards): a slope is square to the line, towards its
    high side, and as steep as the way to the nearest point of another level tells; 0 where there is no other level. Points
    on the raster's border, where closed lines run along it, are left out."""
    places, values, normals = [], [], []
    for level, line in lines:
        ring = len(line) > 2 and (line[0] == line[-1]).all()
        p = line[:-1] if ring else line
        ahead = np.roll(p, -1, 0) if ring else np.vstack([p[1:], 2 * p[-1:] - p[-2:-1]])
        behind = np.roll(p, 1, 0) if ring else np.vstack([2 * p[:1] - p[1:2], p[:-1]])
        along = ahead - behind
        size = np.maximum(np.hypot(*along.T), 1e-12)[:, None]
        places.append(p)
        values.append(np.full(len(p), level))
        normals.append(np.stack([along[:, 1], -along[:, 0]], 1) / size)  # high ground lies to the left, y runs southwards
    if not places:
        return np.zeros((0, 2)), np.zeros(0), np.zeros((0, 2))
    place, value, normal = np.vstack(places), np.concatenate(values), np.vstack(normals)
    inner = ((place > 1e-6) & (place < np.array(shape[::-1]) - 1 - 1e-6)).all(1)
    place, value, normal = place[inner], value[inner], normal[inner]
    steep = np.zeros(len(place))
    for level in np.unique(value):
        mine, other = np.flatnonzero(value == level), np.flatnonzero(value != level)
        for a in range(0, len(mine) if len(other) else 0, 256):
            rows = mine[a : a + 256]
            d = ((place[rows, None] - place[None, other]) ** 2).sum(-1)
            k = d.argmin(1)
            steep[rows] = np.abs(value[other[k]] - level) / np.sqrt(np.maximum(d[np.arange(len(rows)), k], 1e-12))
    return place, value, normal * steep[:, None]


def from_contours(lines: list[tuple[float, np.ndarray]], frame: np.ndarray) -> np.ndarray:
    """A raster interpolated from contours and the frame's corners, with slopes; a cell that gets none keeps the frame's value."""
    place, value, slope = (np.concatenate([a, b]) for a, b in zip(vertex_slopes(lines, frame.shape), corner_slopes(frame), strict=True))
    out = discrete_sibson(place[:, 0], place[:, 1], value, frame.shape[0], slope)
    return np.where(np.isfinite(out), out, frame)


def box_mean(z: np.ndarray, half: int) -> np.ndarray:
    """The mean of the (2 half + 1) squared cells around each one, clipped at the edges."""
    total = np.pad(z.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    rows, columns = z.shape
    y, x = np.arange(rows), np.arange(columns)
    y0, y1, x0, x1 = np.maximum(y - half, 0), np.minimum(y + half + 1, rows), np.maximum(x - half, 0), np.minimum(x + half + 1, columns)
    n = (y1 - y0)[:, None] * (x1 - x0)
    return (total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]) / n


def line_energy(line: np.ndarray) -> float:
    """Squared turning angles over mean lengths, by the line's length; 1000 below three points."""
    if len(line) < 3:
        return 1000.0
    legs = np.diff(line, axis=0)
    size = np.hypot(*legs.T)
    legs, size = legs[size > 0], size[size > 0]
    if (line[0] == line[-1]).all() and len(legs):
        legs, size = np.vstack([legs, legs[:1]]), np.append(size, size[0])
        whole = size[:-1].sum()
    else:
        whole = size.sum()
    if len(legs) < 2:
        return 0.0
    cosine = np.clip((legs[:-1] * legs[1:]).sum(1) / (size[:-1] * size[1:]), -1, 1)
    return float((np.arccos(cosine) ** 2 / ((size[:-1] + size[1:]) / 2)).sum() / whole)


def contours_of(z: np.ndarray, levels: list[float], tolerance: float = SIMPLIFY, cell: float = CELL) -> list[tuple[float, np.ndarray]]:
    """(level, line) of all levels, simplified, in cells, without the padding's ends."""
    limit = np.array(z.shape[::-1]) - 1
    return [(level, simplified(line.clip(0, limit), tolerance / cell)) for level in levels for line in stitched(z, level)]


def error_corrected(z: np.ndarray, levels: list[float], steps: int, weight: float, stop: tuple[float, float] = (0.1, 0.0), cell: float = CELL) -> tuple[np.ndarray, float, float]:
    """(raster, error, energy): the terrain moved so that its contours, interpolated again, come near the true terrain.

    Each step adds a box mean of what is missing, over boxes and by amounts that shrink; it ends after ``steps``, when the
    score is at most stop[0] or changes by at most stop[1].
    """
    moved, before, error, energy = smoothed(z, 15, 15, 10, cell), math.inf, 0.0, 0.0
    for k in range(steps):
        lines = contours_of(moved, levels, cell=cell)
        again = from_contours(lines, moved)
        error = float(((z - again) ** 2).mean())
        energy = sum(line_energy(line * cell) for _, line in lines)
        score = error + weight * energy
        if score <= stop[0] or abs(score - before) <= stop[1]:
            break
        left = (steps - k) / steps
        moved = moved + left * box_mean(z - again, int(left * 30))
        before = score
    return moved, error, energy
