"""Geometric union of the polygons of a unit, as boundaries without the edges that parts share.

Every ring is wound with its interior on the left, edges are cut where a vertex of another ring lies on them, and edges
that occur in both directions cancel; what remains is the boundary of the union, and is joined to rings again. Parts
inside other parts go. Polygons whose edges cross (parts that overlap) stay as they are, gathered: a point lies in some
of them exactly if it lies in the union.

Defined cases: null stays null; no polygons, a single polygon, and polygons with a null in them stay as they are; rings of fewer than three different
points are left out; equal polygons count once; points on a straight line between others are dropped where parts were
joined.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Point = tuple[float, float]


def _cross(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _area(ring: list[Point]) -> float:
    """Twice the signed area; positive with the interior on the left."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def _wound(ring: list[Point], left: bool) -> list[Point] | None:
    """The ring without repeated points, its interior on the left or right; null if it has no area."""
    points = [p for p, before in zip(ring, ring[-1:] + ring[:-1], strict=True) if p != before]
    area = _area(points) if len(points) > 2 else 0.0
    if not area:
        return None
    return points if (area > 0) == left else points[::-1]


def _cut(edges: list[tuple[Point, Point]], vertices: np.ndarray) -> Iterator[tuple[Point, Point]]:
    """The edges, cut at the vertices (in order of x) that lie on them."""
    for a, b in edges:
        low, high = (np.searchsorted(vertices[:, 0], v, side) for v, side in ((min(a[0], b[0]), "left"), (max(a[0], b[0]), "right")))
        near = vertices[low:high]
        x, y = near[:, 0], near[:, 1]
        on = ((b[0] - a[0]) * (y - a[1]) == (b[1] - a[1]) * (x - a[0])) & (y >= min(a[1], b[1])) & (y <= max(a[1], b[1]))
        inner = [p for p in map(tuple, near[on].tolist()) if p not in (a, b)]
        stops = [a, *sorted(inner, key=lambda p: abs(p[0] - a[0]) + abs(p[1] - a[1])), b]
        yield from zip(stops[:-1], stops[1:], strict=True)


def _crossing(edges: list[tuple[Point, Point]]) -> bool:
    """Whether two edges cross at an inner point of both."""
    e = np.array(sorted(edges, key=lambda s: min(s[0][0], s[1][0])), float).reshape(-1, 4)
    left, right = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    side = lambda ax, ay, bx, by, px, py: np.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))
    for i in range(len(e) - 1):
        other = e[i + 1 : i + 1 + int(np.searchsorted(left[i + 1 :], right[i], "right"))]
        ax, ay, bx, by = e[i]
        cx, cy, dx, dy = other.T
        apart = side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy)
        if ((apart < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)).any():
            return True
    return False


def _rings(edges: list[tuple[Point, Point]]) -> Iterator[list[Point]]:
    """The edges joined to rings; where several go on from a point, the leftmost does."""
    after: dict[Point, list[Point]] = defaultdict(list)
    for a, b in sorted(edges, reverse=True):
        after[a].append(b)
    for start in sorted(after):
        while after[start]:
            ring, before, at = [start], start, after[start].pop()
            while at != start:
                ring.append(at)
                back = math.atan2(before[1] - at[1], before[0] - at[0])
                ways = after[at]
                turn = [(back - math.atan2(p[1] - at[1], p[0] - at[0])) % (2 * math.pi) or 2 * math.pi for p in ways]
                before, at = at, ways.pop(turn.index(min(turn)))
            yield ring


def _straightened(ring: list[Point]) -> list[Point]:
    return [p for before, p, after in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1], strict=True) if _cross(before, p, after)]


def _inside(ring: list[Point], p: Point) -> bool:
    hit = False
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            hit = not hit
    return hit


def union_of(polygons: list[list[list[Point]]]) -> list[list[list[Point]]] | None:
    """The union of polygons (closed rings, the outer one first); None if their edges cross or they are one at most."""
    distinct = list({tuple(map(tuple, p)): p for p in polygons}.values())
    if len(polygons) < 2:
        return None
    wound = [r for p in distinct for i, ring in enumerate(p) if (r := _wound(ring, i == 0))]
    edges = [e for r in wound for e in zip(r, r[1:] + r[:1], strict=True)]
    vertices = np.array(sorted({p for r in wound for p in r}), float).reshape(-1, 2)
    count = Counter(_cut(edges, vertices))
    kept = [e for e, n in count.items() for _ in range(n - count.get(e[::-1], 0))]
    if len(kept) > len(set(kept)) or _crossing(kept):
        return None
    # Winding of the other rings around the middle of a ring's first edge, which is on none of them.
    rings = [(r, _area(r) > 0, ((r[0][0] + r[1][0]) / 2, (r[0][1] + r[1][1]) / 2)) for r in _rings(kept)]
    boxes = np.array([[*map(min, zip(*r, strict=True)), *map(max, zip(*r, strict=True))] for r, _, _ in rings]).reshape(-1, 4)

    def holders(i: int) -> list[int]:
        p = rings[i][2]
        near = np.flatnonzero((boxes[:, :2] <= p).all(axis=1) & (boxes[:, 2:] >= p).all(axis=1)).tolist()
        return [j for j in near if j != i and _inside(rings[j][0], p)]

    held = [holders(i) for i in range(len(rings))]
    around = [sum(1 if rings[j][1] else -1 for j in h) for h in held]
    outer = {i: [r] for i, (r, left, _) in enumerate(rings) if left and around[i] == 0}
    for i, (r, left, _) in enumerate(rings):
        if not left and around[i] == 1:
            outer[min((j for j in held[i] if j in outer), key=lambda j: _area(rings[j][0]))].append(r)
    closed = lambda r: [*(s := _straightened(r)), s[0]]
    return [[closed(r) for r in p] for p in sorted(outer.values())]


def united(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """features with the polygons of `geometry` (rings of structs lon, lat) replaced by their union, row by row."""
    where = features.columns.index(geometry)

    def one(polygons):
        rings = [r for p in polygons or [None] for r in (p if p is not None else [None])]
        points = [q for r in rings for q in (r if r is not None else [None])]
        if None in points or any(None in (q["lon"], q["lat"]) for q in points):
            return polygons
        found = union_of([[[(q["lon"], q["lat"]) for q in r] for r in p] for p in polygons])
        return polygons if found is None else [[[{"lon": x, "lat": y} for x, y in r] for r in p] for p in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array([one(x) for x in batch.column(where).to_pylist()], batch.schema.field(where).type)
            yield pa.RecordBatch.from_arrays([column if i == where else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return features.mapInArrow(run, features.schema)
