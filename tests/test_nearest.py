import math
import random

from trailmesh import constants as K
from trailmesh.operators.nearest import near_places
from trailmesh.operators.zones import next_zone


def metres(a, b):
    half = [math.sin(math.radians(b[i] - a[i]) / 2) ** 2 for i in (0, 1)]
    h = half[0] + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * half[1]
    return 2 * K.HAVERSINE_RADIUS_M * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_nearest_equals_brute_force(spark):
    """Clusters, the date line, the poles, ties, repeated places and rows without a position."""
    rng = random.Random(11)
    def anywhere():
        return rng.uniform(-90, 90), rng.uniform(-180, 180)
    centres = [anywhere() for _ in range(6)] + [(0.0, 179.99), (89.9, 10.0), (-90.0, 0.0)]
    def clustered():
        lat, lon = rng.choice(centres)
        return max(-90.0, min(90.0, lat + rng.gauss(0, 0.3))), (lon + rng.gauss(0, 0.3) + 180) % 360 - 180
    points = [(i, *(anywhere() if i % 2 else clustered()), 1 + i % 4) for i in range(160)]
    places = [(f"p{i:03d}", *(anywhere() if i % 4 == 0 else clustered())) for i in range(90)]
    places += [("q" + p[0], *p[1:]) for p in places[:9]]
    broken = [(900, None, 1.0, 1), (901, float("nan"), 1.0, 1), (902, 95.0, 1.0, 1), (903, 1.0, float("nan"), 1)]
    got = near_places(
        spark.createDataFrame(points + broken, "id long, lat double, lon double, k int"),
        spark.createDataFrame(places + [("bad", None, 0.0)], "place string, lat double, lon double"), ["id"], "place", "k").collect()
    found = {}
    for r in got:
        found.setdefault(r.id, []).append((r.distance_m, r.place))
    assert set(found) == {p[0] for p in points}
    for i, lat, lon, k in points:
        want = sorted((metres((lat, lon), p[1:]), p[0]) for p in places)[:k]
        assert [p for _, p in sorted(found[i])[:k]] == [p for _, p in want]
    # The search is one: far fewer pairs than all.
    assert len(got) < len(points) * len(places) / 4


def test_no_places_and_no_points(spark):
    points = spark.createDataFrame([(1, 45.0, 4.0)], "id long, lat double, lon double")
    places = spark.createDataFrame([], "place string, lat double, lon double")
    assert near_places(points, places, ["id"], "place").count() == 0
    assert near_places(points.limit(0), points.selectExpr("id AS place", "lat", "lon"), ["id"], "place").count() == 0


def test_next_zone_passes_over(spark):
    def square(name, lat, source="openstreetmap", level=9):
        ring = [(lat, 4.0), (lat, 4.001), (lat + 0.001, 4.001), (lat + 0.001, 4.0)]
        return name, "district", source, level, [ring], []

    corner = "array<array<struct<lat:double,lon:double>>>"
    zones = spark.createDataFrame(
        [square("a", 45.0), square("b", 45.01), square("c", 45.02), square("d", 45.03, "fallback"), square("e", 45.04, level=10)],
        f"id string, type string, source string, admin_level int, rings {corner}, holes {corner}")
    points = spark.createDataFrame([(o, 45.0005, 4.0005) for o in (1, 2, 3, 4)], "owner_id long, lat double, lon double")
    passed = spark.createDataFrame([(2, "a"), (2, "a"), (3, "a"), (3, "b"), (4, "a"), (4, "b"), (4, "c")], "owner_id long, zone_id string")
    got = {r.owner_id: (r.zone_id, r.rank) for r in next_zone(points, zones, passed, ["owner_id"]).collect()}
    assert got == {1: ("a", 0), 2: ("b", 1), 3: ("c", 1)}
