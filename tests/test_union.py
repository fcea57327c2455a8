import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators.union import union_of, united


def box(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n), (w, s)]


def covered(polygons, x, y):
    def inside(ring):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:], strict=False)) % 2 == 1

    return any(inside(p[0]) and not any(inside(h) for h in p[1:]) for p in polygons)


CASES = {
    "side by side": ([[box(0, 0, 1, 1)], [box(1, 0, 2, 1)]], [[box(0, 0, 2, 1)]]),
    "part of an edge shared": ([[box(0, 0, 1, 3)], [box(1, 1, 2, 2)]], None),
    "apart": ([[box(0, 0, 1, 1)], [box(5, 5, 6, 6)]], [[box(0, 0, 1, 1)], [box(5, 5, 6, 6)]]),
    "wound the other way": ([[box(0, 0, 1, 1)[::-1]], [box(1, 0, 2, 1)]], [[box(0, 0, 2, 1)]]),
    "touching at a corner": ([[box(0, 0, 1, 1)], [box(1, 1, 2, 2)]], [[box(0, 0, 1, 1)], [box(1, 1, 2, 2)]]),
    "equal": ([[box(0, 0, 1, 1)], [box(0, 0, 1, 1)]], [[box(0, 0, 1, 1)]]),
    "inside another": ([[box(0, 0, 9, 9)], [box(2, 2, 3, 3)]], [[box(0, 0, 9, 9)]]),
    "filling a hole": ([[box(0, 0, 9, 9), box(2, 2, 3, 3)], [box(2, 2, 3, 3)]], [[box(0, 0, 9, 9)]]),
    "within a hole": ([[box(0, 0, 9, 9), box(2, 2, 7, 7)], [box(4, 4, 5, 5)]], 2),
    "around a hole": ([[box(0, 0, 3, 1)], [box(0, 2, 3, 3)], [box(0, 1, 1, 2)], [box(2, 1, 3, 2)]], 1),
    "no area": ([[[(0, 0), (1, 1), (0, 0)]], [box(0, 0, 1, 1)]], [[box(0, 0, 1, 1)]]),
}


@pytest.mark.parametrize("name", CASES)
def test_union(name):
    parts, want = CASES[name]
    found = union_of(parts)
    if isinstance(want, list):
        assert found == want
    elif want:
        assert len(found) == want
    rng = random.Random(3)
    for _ in range(500):
        x, y = rng.uniform(-1, 10), rng.uniform(-1, 10)
        assert covered(found, x, y) == covered(parts, x, y)
    assert all(p[i][0] == p[i][-1] for p in found for i in range(len(p)))


@pytest.mark.parametrize("seed", range(20))
def test_union_of_cells(seed):
    """Random cells of a grid: the union has their points, and no edge between two of them."""
    rng = random.Random(seed)
    cells = [(x, y) for x in range(6) for y in range(6) if rng.random() < 0.55]
    found = union_of([[box(x, y, x + 1, y + 1)] for x, y in cells])
    for x in range(6):
        for y in range(6):
            assert covered(found, x + 0.37, y + 0.41) == ((x, y) in cells)
    length = sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for p in found for r in p for a, b in zip(r, r[1:], strict=False))
    assert length == sum((x + dx, y + dy) not in cells for x, y in cells for dx, dy in ((0, 1), (1, 0), (0, -1), (-1, 0)))


def test_overlaps_and_single_polygons_stay():
    assert union_of([[box(0, 0, 2, 2)], [box(1, 1, 3, 3)]]) is None
    assert union_of([[box(0, 0, 2, 2)]]) is None
    assert union_of([]) is None


def test_united_rows(spark):
    kind = "geometry array<array<array<struct<lon:double,lat:double>>>>"
    shape = lambda parts: [[[(float(x), float(y)) for x, y in r] for r in p] for p in parts]
    two = shape([[box(0, 0, 1, 1)], [box(1, 0, 2, 1)]])
    rows = [(1, two), (2, None), (3, []), (4, shape([[box(0, 0, 2, 2)], [box(1, 1, 3, 3)]])), (5, [None]), (6, [[[(None, 1.0)]], *two]), (1, two)]
    out = united(spark.createDataFrame(rows, f"id int, {kind}"))
    sizes = {r.id: r.n for r in out.select("id", F.size("geometry").alias("n")).collect()}
    assert out.count() == 7 and sizes == {1: 1, 2: None, 3: 0, 4: 2, 5: 1, 6: 3} and out.columns == ["id", "geometry"]
    inside = out.where("id = 1").select(geo.in_multipolygon(F.col("geometry"), F.lit(1.5), F.lit(0.5)).alias("a"), geo.in_multipolygon(F.col("geometry"), F.lit(2.5), F.lit(0.5)).alias("b"))
    assert {tuple(r) for r in inside.collect()} == {(True, False)}
    assert united(out.limit(0)).count() == 0
