"""Polygons in numpy: overlay, buffers, dissolve, clipping and validity.

A polygon set is a list of rings, each an (n, 2) array whose last point repeats the first; shells run counter-clockwise,
holes clockwise. All set operations go through one arrangement: edges are cut where they meet, points are snapped to SNAP,
and of the pieces those stay that have the result on one side only. What is inside is told by winding numbers, so rings of
one operand may overlap. Empty lists are empty sets; rings below three different points are left out.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

#: Metres that points are snapped to, and corners of a full circle in a buffer.
SNAP, CIRCLE = 1e-7, 32
Rings = list[np.ndarray]


def closed(ring: np.ndarray) -> np.ndarray:
    ring = np.asarray(ring, float)
    return ring if len(ring) and (ring[0] == ring[-1]).all() else np.vstack([ring, ring[:1]])


def ring_area(ring: np.ndarray) -> float:
    """Signed area, counter-clockwise positive."""
    if len(ring) < 4:
        return 0.0
    r = ring - ring[0]
    return float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() / 2)


def area(rings: Rings) -> float:
    return sum(map(ring_area, rings))


def box(x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)


def _edges(rings: Rings) -> np.ndarray:
    """(n, 4): the edges of all rings."""
    parts = [np.hstack([r[:-1], r[1:]]) for r in map(closed, rings) if len(r) > 3]
    return np.vstack(parts) if parts else np.zeros((0, 4))


def winding(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How often the edges' rings wind around each point. Points and edges meet in horizontal strips only."""
    out = np.zeros(len(points), np.int64)
    if not len(edges) or not len(points):
        return out
    low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    strips = max(1, int(len(edges) ** 0.5))
    base, step = low.min(), max((high.max() - low.min()) / strips, 1e-9)
    first, last = ((v - base) // step for v in (low, high))
    row = (points[:, 1] - base) // step
    order = np.argsort(row, kind="stable")
    for r in np.unique(row).tolist():
        mine = order[np.searchsorted(row[order], r) : np.searchsorted(row[order], r, "right")]
        near = edges[(first <= r) & (last >= r)]
        if not len(near):
            continue
        x1, y1, x2, y2 = near.T
        for k in range(0, len(mine), 4096):
            px, py = points[mine[k : k + 4096], 0, None], points[mine[k : k + 4096], 1, None]
            side = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
            up, down = (y1 <= py) & (y2 > py) & (side > 0), (y1 > py) & (y2 <= py) & (side < 0)
            out[mine[k : k + 4096]] = up.sum(1) - down.sum(1)
    return out


def contains(rings: Rings, points: np.ndarray) -> np.ndarray:
    """Which points lie inside."""
    return winding(np.asarray(points, float).reshape(-1, 2), _edges(rings)) != 0


def _near_pairs(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of edges whose boxes meet, by a sweep in x."""
    lo, hi = np.minimum(edges[:, :2], edges[:, 2:]) - SNAP, np.maximum(edges[:, :2], edges[:, 2:]) + SNAP
    order = np.argsort(lo[:, 0], kind="stable")
    until = np.searchsorted(lo[order, 0], hi[order, 0], "right")
    a, b = [], []
    for k, i in enumerate(order):
        other = order[k + 1 : until[k]]
        other = other[(lo[other, 1] <= hi[i, 1]) & (hi[other, 1] >= lo[i, 1])]
        a.append(np.full(len(other), i))
        b.append(other)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _cut(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges cut where they meet, as snapped whole numbers (n, 4), and the edge that each piece comes from."""
    i, j = _near_pairs(edges)
    p, r = edges[i, :2], edges[i, 2:] - edges[i, :2]
    q, s = edges[j, :2], edges[j, 2:] - edges[j, :2]
    cross = lambda u, v: u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    d, w = cross(r, s), q - p
    scale = np.hypot(*r.T) * np.hypot(*s.T)
    slant = np.abs(d) > 1e-12 * np.maximum(scale, 1e-30)
    places: dict[int, list[np.ndarray]] = defaultdict(list)
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross(w, s) / d, cross(w, r) / d
    tol = lambda v: SNAP / np.maximum(np.hypot(*v.T), SNAP)
    hit = slant & (t >= -tol(r)) & (t <= 1 + tol(r)) & (u >= -tol(s)) & (u <= 1 + tol(s))
    at = p + t[:, None].clip(0, 1) * r
    for k in np.flatnonzero(hit):
        places[i[k]].append(at[k])
        places[j[k]].append(at[k])
    for k in np.flatnonzero(~slant):  # parallel: ends that lie on the other edge
        for a, b in ((i[k], j[k]), (j[k], i[k])):
            o, v = edges[a, :2], edges[a, 2:] - edges[a, :2]
            n = float(v @ v)
            for end in (edges[b, :2], edges[b, 2:]):
                x = float((end - o) @ v) / n if n else 0.0
                if 0 < x < 1 and np.hypot(*(o + x * v - end)) <= SNAP:
                    places[a].append(end)
    pieces, source = [], []
    for k, e in enumerate(edges):
        points = np.vstack([e[:2], *places.get(k, []), e[2:]])
        by = np.argsort((points - e[:2]) @ (e[2:] - e[:2]), kind="stable")
        whole = np.rint(points[by] / SNAP).astype(np.int64)
        whole = whole[np.append(True, (whole[1:] != whole[:-1]).any(1))]
        pieces.append(np.hstack([whole[:-1], whole[1:]]))
        source.append(np.full(len(whole) - 1, k))
    return (np.vstack(pieces), np.concatenate(source)) if pieces else (np.zeros((0, 4), np.int64), np.zeros(0, int))


def _rings_of(pieces: np.ndarray) -> Rings:
    """Rings from directed pieces with the inside on their left: at a crossing the leftmost turn is taken."""
    out_of: dict[tuple, list[tuple]] = defaultdict(list)
    for a, b, c, d in pieces.tolist():
        out_of[a, b].append((c, d))
    rings = []
    while out_of:
        start = next(iter(out_of))
        path, at = [start], out_of[start].pop()
        if not out_of[start]:
            del out_of[start]
        while at != start:
            before, options = path[-1], out_of.get(at)
            path.append(at)
            if not options:
                break
            if len(options) > 1:
                back = math.atan2(before[1] - at[1], before[0] - at[0])
                turn = lambda o, at=at, back=back: (back - math.atan2(o[1] - at[1], o[0] - at[0])) % (2 * math.pi) or 2 * math.pi
                options.sort(key=turn, reverse=True)
            step = options.pop()
            if not options:
                del out_of[at]
            at = step
        ring = np.array([*path, start], float) * SNAP
        if len(ring) > 3 and abs(ring_area(ring)) > SNAP:
            rings.append(without_straight(ring))
    return rings


def without_straight(ring: np.ndarray) -> np.ndarray:
    """The ring without corners on a straight line."""
    points = ring[:-1]
    before, after = points - np.roll(points, 1, 0), np.roll(points, -1, 0) - points
    bent = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) > 1e-9 * np.maximum(np.hypot(*before.T) * np.hypot(*after.T), 1e-30)
    points = points[bent] if bent.sum() > 2 else points
    return np.vstack([points, points[:1]])


def _combined(a: Rings, b: Rings, inside) -> Rings:
    """Rings of the points where ``inside`` holds of their winding numbers in a and in b."""
    ea, eb = _edges(a), _edges(b)
    edges = np.vstack([ea, eb])
    if not len(edges):
        return []
    pieces, _ = _cut(edges)
    turned = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    pieces[turned] = pieces[turned][:, [2, 3, 0, 1]]
    pieces = np.unique(pieces, axis=0)
    p = pieces * SNAP
    middle, along = (p[:, :2] + p[:, 2:]) / 2, p[:, 2:] - p[:, :2]
    size = np.hypot(*along.T)[:, None]
    normal = np.stack([-along[:, 1], along[:, 0]], 1) / size
    off = np.minimum(size * 0.01, 1e-6)
    side = lambda x: inside(winding(x, ea), winding(x, eb))
    left, right = side(middle + off * normal), side(middle - off * normal)
    keep = np.vstack([pieces[left & ~right], pieces[right & ~left][:, [2, 3, 0, 1]]])
    return _rings_of(keep)


def union(a: Rings, b: Rings = ()) -> Rings:
    """What lies in either; of one list its own dissolve."""
    return _combined(list(a), list(b), lambda x, y: (x != 0) | (y != 0))


def intersection(a: Rings, b: Rings) -> Rings:
    return _combined(list(a), list(b), lambda x, y: (x != 0) & (y != 0))


def difference(a: Rings, b: Rings) -> Rings:
    return _combined(list(a), list(b), lambda x, y: (x != 0) & (y == 0))


def _rim(ring: np.ndarray, distance: float) -> Rings:
    """What a ring's edges sweep when they move outwards by a distance (inwards by a negative one): a quadrilateral for each
    edge, a fan at each corner that bends away from it."""
    ring, d = closed(ring), abs(distance)
    v = np.diff(ring, axis=0)
    size = np.hypot(*v.T)
    ring, v, size = ring[:-1][size > 0], v[size > 0], size[size > 0]
    sign = 1.0 if distance > 0 else -1.0
    normal = sign * d * np.stack([v[:, 1], -v[:, 0]], 1) / size[:, None]
    after = np.roll(ring, -1, 0)
    parts = [np.array([p, p + n, q + n, q, p]) for p, q, n in zip(ring, after, normal, strict=True)]
    cross = np.roll(v, 1, 0)[:, 0] * v[:, 1] - np.roll(v, 1, 0)[:, 1] * v[:, 0]
    for k in np.flatnonzero(sign * cross > 1e-12 * size * np.roll(size, 1)):
        a, b = (math.atan2(n[1], n[0]) for n in (normal[k - 1], normal[k]))
        turn = (b - a) % (2 * math.pi) if sign > 0 else -((a - b) % (2 * math.pi))
        steps = max(1, math.ceil(abs(turn) / (2 * math.pi) * CIRCLE))
        angles = a + turn * np.arange(steps + 1) / steps
        arc = ring[k] + d * np.stack([np.cos(angles), np.sin(angles)], 1)
        arc[0], arc[-1] = ring[k] + normal[k - 1], ring[k] + normal[k]
        parts.append(np.vstack([ring[k], arc, ring[k]]))
    return [p if ring_area(p) > 0 else p[::-1] for p in parts if abs(ring_area(p)) > 0]


def buffered(rings: Rings, distance: float) -> Rings:
    """The set grown by a distance with round corners, or shrunk by a negative one."""
    if not distance or not rings:
        return union(rings) if rings else []
    rim = [p for r in rings if len(r) > 3 for p in _rim(r, distance)]
    return union(rings, rim) if distance > 0 else difference(rings, rim)


def polygons_of(rings: Rings) -> list[Rings]:
    """Rings grouped as polygons: each shell with the holes that lie in it and in no smaller shell."""
    shells = sorted((r for r in rings if ring_area(r) > 0), key=ring_area)
    out = [[s] for s in shells]
    low, high = (np.array([f(0) for f in (getattr(s, name) for s in shells)]).reshape(-1, 2) for name in ("min", "max"))
    for hole in (r for r in rings if ring_area(r) < 0):
        middle = (hole[0] + hole[1]) / 2
        for k in np.flatnonzero(((low <= middle) & (high >= middle)).all(1)):
            if ring_area(shells[k]) > -ring_area(hole) and contains([shells[k]], middle)[0]:
                out[k].append(hole)
                break
    return out


def from_contours(lines: list[np.ndarray], frame: Rings, inverted: bool = False) -> Rings:
    """Areas from closed contours: counter-clockwise ones are shells, clockwise ones holes of the smallest shell around
    them; open lines are left out. ``inverted``: the frame without that; without lines the whole frame."""
    rings = [np.asarray(line, float) for line in lines if len(line) > 3 and (np.asarray(line[0]) == np.asarray(line[-1])).all()]
    if inverted:
        return difference(frame, rings)
    return intersection(rings, frame) if rings else []


def clipped(line: np.ndarray, rings: Rings) -> list[np.ndarray]:
    """The parts of a line that lie inside, in its direction; a closed line's seam is no cut."""
    line = np.asarray(line, float)
    edges, own = _edges(rings), np.hstack([line[:-1], line[1:]])
    if not len(edges) or not len(own):
        return []
    pieces, source = _cut(np.vstack([own, edges]))
    p = pieces[source < len(own)] * SNAP
    good = winding((p[:, :2] + p[:, 2:]) / 2, edges) != 0
    out: list[list[np.ndarray]] = []
    for k in np.flatnonzero(good):
        if out and k and good[k - 1] and (out[-1][-1] == p[k, :2]).all():
            out[-1].append(p[k, 2:])
        else:
            out.append([p[k, :2], p[k, 2:]])
    if len(out) > 1 and (line[0] == line[-1]).all() and good[0] and good[-1]:
        out[0] = out.pop() + out[0][1:]
    return [np.array(x) for x in out]


def is_valid(ring: np.ndarray) -> bool:
    """Closed, with an area, and without a crossing of its own edges."""
    ring = np.asarray(ring, float)
    if len(ring) < 4 or (ring[0] != ring[-1]).any() or abs(ring_area(ring)) <= SNAP:
        return False
    pieces, _ = _cut(np.hstack([ring[:-1], ring[1:]]))
    starts = list(map(tuple, pieces[:, :2].tolist()))
    return len(set(starts)) == len(starts) and len(pieces) == len(np.unique(np.rint(ring[:-1] / SNAP), axis=0))


def touch(a: Rings, b: Rings) -> bool:
    """Whether two sets share a point."""
    ea, eb = _edges(a), _edges(b)
    if not len(ea) or not len(eb):
        return False
    i, j = _near_pairs(np.vstack([ea, eb]))
    if not ((i < len(ea)) != (j < len(ea))).any():
        return bool(contains(a, b[0][:1])[0] or contains(b, a[0][:1])[0])
    pa, pb = _cut(np.vstack([ea, eb]))
    ends = [set(map(tuple, pa[pb < len(ea)][:, :2].tolist())), set(map(tuple, pa[pb >= len(ea)][:, :2].tolist()))]
    return bool(ends[0] & ends[1] or contains(a, b[0][:1])[0] or contains(b, a[0][:1])[0])


def dissolved(polygons: list[Rings], gap: float = 0.0) -> list[Rings]:
    """All polygons as one set, again as polygons; gaps of up to twice ``gap`` are closed."""
    rings = [r for p in polygons for r in p]
    return polygons_of(union(rings) if not gap else buffered(buffered(rings, gap), -gap))


def absorbed(polygons: list[Rings], least: float) -> list[Rings]:
    """Small areas go into their neighbours: the first area below ``least`` merges into its largest touching area that is
    no smaller, if both then are one polygon; again until nothing changes. What stays small is left out."""
    alive = {k: (p, area(p)) for k, p in enumerate(polygons)}
    extent = lambda p: (np.vstack(p).min(0) - SNAP, np.vstack(p).max(0) + SNAP)
    boxes = {k: extent(p) for k, (p, _) in alive.items()}
    waiting = [k for k, (_, size) in alive.items() if size < least]
    while waiting:
        k = waiting.pop(0)
        own, size = alive[k]
        lo, hi = boxes[k]
        near = [i for i in alive if i != k and alive[i][1] >= size and (boxes[i][0] <= hi).all() and (boxes[i][1] >= lo).all()]
        for i in sorted(near, key=lambda i: (-alive[i][1], i)):
            if touch(own, alive[i][0]) and len(both := polygons_of(union([*own, *alive[i][0]]))) == 1:
                alive[i], boxes[i] = (both[0], area(both[0])), extent(both[0])
                del alive[k]
                waiting = [j for j, (_, a) in alive.items() if a < least]
                break
    return [p for p, size in alive.values() if size >= least]


def bounded_hull(hull: np.ndarray, x0: float, y0: float, x1: float, y1: float, reach: float, simplify) -> np.ndarray:
    """A hull whose corners near the grid's box are moved onto it, simplified."""
    ring = closed(hull).copy()
    for axis, low, high in ((0, x0, x1), (1, y0, y1)):
        v = ring[:, axis]
        v[np.abs(v - low) <= reach] = low
        v[np.abs(v - high) <= reach] = high
    return simplify(ring, reach)
