"""Streets near probes: small rows with many pairs are dealt over all tasks."""

import math
import random

from trailmesh.operators import corridors

STREET = "id string, fetched_at timestamp, min_lat double, max_lat double, min_lon double, max_lon double"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_streets_and_probes_meet_in_dealt_buckets(spark):
    streets = spark.createDataFrame([("way/1/part/0", None, 45.0, 45.001, 5.0, 5.001)], STREET)
    probes = spark.createDataFrame([(1, 45.0005, 5.0005), (2, 46.0, 5.0)], "k long, lat double, lon double")
    met = corridors.streets_near(probes, streets, 175.0, ["k"])
    assert [r.k for r in met.collect()] == [1]
    assert "RepartitionByExpression" in plan_of(met)
    line = spark.createDataFrame([(45.0, 5.0, 45.001, 5.001)], "from_lat double, from_lon double, to_lat double, to_lon double")
    near = corridors.within_corridors(probes, line, 250.0, ["k"])
    assert [r.k for r in near.collect()] == [1]
    assert "RepartitionByExpression" in plan_of(near)


def test_corridor_distance_is_the_least_over_all_lines(spark):
    rng = random.Random(4)
    spots, lines = [], []
    for base in (45.75, 78.0):
        spots += [(len(spots) + i, base + rng.uniform(0, 0.02), 5 + rng.uniform(0, 0.06)) for i in range(150)]
        for _ in range(12):
            a = (base + rng.uniform(0, 0.02), 5 + rng.uniform(0, 0.06))
            lines.append((*a, a[0] + rng.uniform(-0.004, 0.004), a[1] + rng.uniform(-0.01, 0.01)))

    def metres(lat, lon, line):
        scale = 111320 * math.cos(math.radians(lat))
        ax, ay, bx, by = ((line[1] - lon) * scale, (line[0] - lat) * 111320, (line[3] - lon) * scale, (line[2] - lat) * 111320)
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
        return math.hypot(ax + t * dx, ay + t * dy)

    want = {k: min(metres(lat, lon, line) for line in lines) for k, lat, lon in spots}
    got = corridors.within_corridors(
        spark.createDataFrame(spots, "k long, lat double, lon double"),
        spark.createDataFrame(lines, "from_lat double, from_lon double, to_lat double, to_lon double"), 250.0, ["k"]).collect()
    assert {r.k: round(r.distance_m, 6) for r in got} == {k: round(d, 6) for k, d in want.items() if d <= 250}
    assert 0 < len(got) < len(spots)


def test_lone_centre_reaches_as_far_as_its_great_circle(spark):
    # 249.86 m by great circle, 250.14 in the planar metres of the buckets, and across a bucket's border.
    border = 10200 * 2 * 250 / 111320
    lone, spot = border - 0.0022464, border + 0.0000006
    line = spark.createDataFrame([(lone, 5.0, lone, 5.0)], "from_lat double, from_lon double, to_lat double, to_lon double")
    near = corridors.within_corridors(spark.createDataFrame([(1, spot, 5.0)], "k long, lat double, lon double"), line, 250.0, ["k"])
    assert [249.8 < r.distance_m < 250 for r in near.collect()] == [True]
