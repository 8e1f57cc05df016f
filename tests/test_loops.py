import random
from collections import deque

import pytest

from tests.shapes import cells, perimeter, rectangle
from trailmesh.operators import loops, regions


def components(cells_set, diagonal=False):
    left, groups = set(cells_set), []
    while left:
        start = min(left)
        left.discard(start)
        queue, group = deque([start]), {start}
        while queue:
            x, y = queue.popleft()
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    if (i, j) == (0, 0) or (not diagonal and i and j):
                        continue
                    n = (x + i, y + j)
                    if n in left:
                        left.discard(n)
                        group.add(n)
                        queue.append(n)
        groups.append(group)
    return groups


def box(group, pad=0):
    xs, ys = [c[0] for c in group], [c[1] for c in group]
    return {(x, y) for x in range(min(xs) - pad, max(xs) + pad + 1) for y in range(min(ys) - pad, max(ys) + pad + 1)}


def pockets(blocked, diagonal):
    frame = box(blocked, 1)
    corner = min(frame)
    return [g for g in components(frame - blocked, diagonal) if corner not in g]


def exact_groups(walked):
    found = []
    for region in components(walked):
        found += [hole for hole in pockets(region, True)]
    groups, claimed = [], set()
    for hole in sorted(found, key=len, reverse=True):
        group = hole - walked - claimed
        if group:
            groups.append(group)
            claimed |= group
    return groups


def brute_loops(walked):
    exact = exact_groups(walked)
    inside = set().union(*exact) if exact else set()
    grown = {(x + i, y + j) for x, y in walked for i in (-1, 0, 1) for j in (-1, 0, 1)}
    tolerant = []
    for region in components(grown):
        mine = walked & region
        closed = [g for part in components(mine)
                  for g in components(set().union(*pockets(part, False), set()) - walked)]
        if not closed:
            outside = next(g for g in components(box(region, 1) - region) if min(box(region, 1)) in g)
            closed = components(box(mine) - walked - outside)
        tolerant += closed
    return exact + [g for g in tolerant if not g & inside]


def run_loops(spark, shapes, strict=False):
    df = cells(spark, shapes)
    groups, members = loops.loop_groups(df, ["owner_id"], strict)
    sizes = {}
    for r in groups.collect():
        sizes.setdefault(r.owner_id, []).append((r.cells, r.accepted))
    inside = {}
    for r in members.collect():
        inside.setdefault((r.owner_id, r.kind, r.comp, r.grp), set()).add((r.cell_x, r.cell_y))
    return sizes, inside


def test_known_enclosures(spark):
    bridge = {(6, 2), (7, 2), (8, 2)}
    shapes = {
        1: perimeter(10),
        2: perimeter(6) | perimeter(6, 9, 0) | bridge,
        3: perimeter(12) | perimeter(4, 4, 4),
        4: perimeter(30),
        5: {(x, 0) for x in range(40)},
        6: perimeter(7) - {(3, 0)},
        7: {(x, 0) for x in range(11)} | {(0, y) for y in range(11)},
        8: rectangle(3, 3, [(1, 1)]),
        9: perimeter(10, 1019, 1019),
    }
    sizes, inside = run_loops(spark, shapes)
    assert sizes[1] == [(64, True)]
    assert sizes[2] == [(16, True)] * 2
    assert sizes[3] == [(100 - 12, True)]
    assert sizes[4] == [(784, False)]
    assert 5 not in sizes
    assert sizes[6] == [(26, True)]
    assert sizes[7] == [(19, True)]
    assert sizes[8] == [(1, True)]
    assert sizes[9] == [(64, True)]
    strict, _ = run_loops(spark, shapes, strict=True)
    assert 6 not in strict and 7 not in strict and strict[2] == [(16, True)] * 2


def test_random_grids_match_flood_fill(spark):
    rng = random.Random(7)
    shapes = {}
    for owner in range(60):
        density = rng.choice([0.35, 0.55, 0.7])
        dx, dy = rng.choice([(0, 0), (1019, -5), (-6, 2043)])
        shapes[owner] = {(x + dx, y + dy) for x in range(9) for y in range(9) if rng.random() < density}
    sizes, inside = run_loops(spark, shapes)
    got = {}
    for (owner, *_), group in inside.items():
        got.setdefault(owner, []).append(sorted(group))
    for owner, walked in shapes.items():
        assert sorted(got.get(owner, [])) == sorted(sorted(g) for g in brute_loops(walked)), owner


def test_components_across_tiles(spark):
    rng = random.Random(3)
    shape = {(x + 1000, y + 1000) for x in range(60) for y in range(60) if rng.random() < 0.6}
    for diagonal in (False, True):
        runs = regions.cell_runs(cells(spark, {1: shape}), ["owner_id"])
        labelled = regions.run_cells(regions.label_runs(runs, ["owner_id"], diagonal), ["owner_id", "label"]).collect()
        groups = {}
        for r in labelled:
            groups.setdefault(r.label, set()).add((r.cell_x, r.cell_y))
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, components(shape, diagonal)))


@pytest.mark.parametrize("limit, filled", [(666, 64), (10, 0)])
def test_fillable_limit(spark, limit, filled):
    assert loops.fillable_cells(cells(spark, {1: perimeter(10)}), ["owner_id"], limit).count() == filled


def test_merged_polygons(spark):
    shapes = {
        1: rectangle(3, 3), 2: rectangle(3, 3, [(1, 1)]), 3: perimeter(9) | {(4, 4)}, 4: perimeter(30),
        5: {(0, 0), (1, 1)}, 6: rectangle(40, 2), 7: rectangle(250, 200),
    }
    df = cells(spark, shapes)

    def summary(limit=None):
        got = {}
        for r in loops.merged_polygons(df, ["owner_id"], limit).collect():
            got.setdefault(r.owner_id, []).append((r.ring_cells, r.holes))
        return {k: sorted(v) for k, v in got.items()}

    plain, filled = summary(), summary(150_000)
    assert plain[1] == [(9, 0)] and plain[2] == [(9, 1)] and filled[2] == [(9, 0)]
    assert plain[3] == [(1, 0), (81, 1)] and filled[3] == [(81, 0)]
    assert filled[4] == [(900, 1)]
    assert plain[5] == [(1, 0), (1, 0)] and plain[6] == [(80, 0)] and plain[7] == [(50_000, 0)]
