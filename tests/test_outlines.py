import random

import pytest

from tests.shapes import perimeter, rectangle
from trailmesh.operators import graph, outlines

STEP = [(1, 0), (0, 1), (-1, 0), (0, -1)]


def traced(group):
    """Rings of corners by following unit sides one after the other, left turns first."""
    sides = {}
    for x, y in group:
        for d, (fx, fy, nx, ny) in enumerate([(x, y, x, y - 1), (x + 1, y, x + 1, y), (x + 1, y + 1, x, y + 1), (x, y + 1, x - 1, y)]):
            if (nx, ny) not in group:
                sides.setdefault((fx, fy), []).append(d)
    left = {(p, d) for p, ds in sides.items() for d in ds}
    found = []
    while left:
        place, d = start = min(left, key=lambda s: (*s[0], s[1]))
        ring = []
        while True:
            left.discard((place, d))
            ring.append((place, d))
            place = (place[0] + STEP[d][0], place[1] + STEP[d][1])
            d = next(t for t in ((d + 1) % 4, d, (d + 3) % 4) if t in sides[place])
            if (place, d) == start:
                break
        found.append([p for i, (p, d) in enumerate(ring) if ring[i - 1][1] != d])
    return found


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) // 2


def contains(ring, x, y):
    """Even-odd rule along the row of the cell (x, y)."""
    crossed = 0
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        crossed += a[0] == b[0] and a[0] <= x and min(a[1], b[1]) <= y < max(a[1], b[1])
    return crossed % 2 == 1


def brute_polygons(group, max_filled):
    """{outer ring: holes} with rings as tuples of corners."""
    every = traced(group)
    inner_cell = {}
    for ring in every:
        x, y = ring[0]
        inner_cell[tuple(ring)] = (x, y)  # the leftmost, lowest corner has a cell of the inside above it
    holes = [r for r in every if area(r) < 0]
    filled = [r for r in holes if -area(r) * 225 <= max_filled]
    outer = [r for r in every if area(r) > 0 and not any(contains(h, *inner_cell[tuple(r)]) for h in filled)]
    polygons = {tuple(r): [] for r in outer}
    for hole in holes:
        if hole not in filled:
            around = [r for r in outer if contains(r, *inner_cell[tuple(hole)])]
            polygons[tuple(min(around, key=area))].append(tuple(hole))
    return {k: sorted(v) for k, v in polygons.items()}


def polygons_of(spark, groups, max_filled=None):
    rows = [(k, x, y) for k, group in enumerate(groups) for x, y in group]
    df = spark.createDataFrame(rows, "owner_id int, cell_x int, cell_y int")
    parts = {}
    for r in outlines.polygon_corners(df, ["owner_id"], max_filled).collect():
        parts.setdefault((r.owner_id, r.polygon), {}).setdefault((r.hole, r.ring), {})[r.position] = (r.x, r.y)
    found = [{} for _ in groups]
    for (owner, _), rings in parts.items():
        whole = {k: tuple(v[i] for i in range(len(v))) for k, v in rings.items()}
        (outer,) = [v for (hole, _), v in whole.items() if not hole]
        found[owner][outer] = sorted(v for (hole, _), v in whole.items() if hole)
    return found


def test_small_shapes(spark):
    solid, ring, diagonal = set(rectangle(3, 3)), set(rectangle(3, 3)) - {(1, 1)}, {(0, 0), (1, 1)}
    got = polygons_of(spark, [solid, ring, diagonal])
    assert got[0] == {((0, 0), (3, 0), (3, 3), (0, 3)): []}
    assert got[1] == {((0, 0), (3, 0), (3, 3), (0, 3)): [((1, 1), (1, 2), (2, 2), (2, 1))]}
    assert len(got[2]) == 2
    island = set(perimeter(9)) | {(4, 4)}
    assert [len(p) for p in polygons_of(spark, [ring, island], 150_000)] == [1, 1]
    assert [sum(map(len, p.values())) for p in polygons_of(spark, [ring, island, set(perimeter(30))], 150_000)] == [0, 0, 1]


@pytest.mark.parametrize("max_filled", [0, 225 * 3, 225 * 40])
def test_nested_rings_match_brute_force(spark, max_filled):
    chance = random.Random(max_filled)
    groups = [{(x - 5, y - 5) for x in range(14) for y in range(14) if chance.random() < p} for p in (0.3, 0.5, 0.6, 0.7, 0.85)]
    nested = set()
    for k, n in enumerate((21, 17, 13, 9, 5, 1)):  # rings inside rings
        nested |= {(x + 2 * k, y + 2 * k) for x, y in (perimeter(n) if n > 1 else [(0, 0)])}
    groups += [nested, nested | {(3 + 2 * k, 1) for k in range(8)}]
    assert polygons_of(spark, groups, max_filled) == [brute_polygons(g, max_filled) for g in groups]


def test_long_ring_and_nothing(spark):
    comb = {(x, 0) for x in range(800)} | {(x, y) for x in range(0, 800, 2) for y in range(1, 3)}
    assert polygons_of(spark, [comb]) == [brute_polygons(comb, 0)]
    empty = spark.createDataFrame([], "owner_id int, cell_x int, cell_y int")
    assert outlines.polygon_corners(empty, ["owner_id"]).count() == 0


def test_pieces_of_rings_over_any_tiles(spark, monkeypatch):
    """Rings cut by many tile borders are those of one tile; these need no rounds."""
    rng = random.Random(3)
    dots = {(rng.randrange(-20, 20), rng.randrange(-20, 20)) for _ in range(900)}
    cells = spark.createDataFrame([(o, x, y) for o in (1, 2) for x, y in dots], "owner_id long, cell_x int, cell_y int")
    found = {}
    for size in (3, 64):
        monkeypatch.setattr(outlines, "_TILE", size)
        found[size] = sorted(map(tuple, outlines.ring_corners(cells, ["owner_id"]).collect()))
    assert found[3] == found[64] and found[3]
    written = []
    real = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: written.append(1) or real(df))
    comb = [(1, x, y) for x in range(1, 60) for y in range(1, 20) if x % 2 or y == 1]
    outlines.ring_corners(spark.createDataFrame(comb, cells.schema), ["owner_id"]).collect()
    assert len(written) == 2  # the pieces, and no row for the rounds
