import math
import random
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.shapes import fixes
from trailmesh.functions.text import fnv1a32
from trailmesh.operators import rewards, zones
from trailmesh.sources import archive, gpx, osm

SESSION = ("owner_id long, session_id long, activity_mode string, display_name string, started_at timestamp, "
           "ended_at timestamp, distance_m double, step_count long, points long")


def recordings(spark, rows):
    """Rows of (session, points, year, month, day)."""
    data = [(1, s, "walk", f"Walk {s}", datetime(y, m, d, 8, s % 60, tzinfo=timezone.utc),
             datetime(y, m, d, 9, s % 60, tzinfo=timezone.utc), 10.0, 5, n) for s, n, y, m, d in rows]
    return spark.createDataFrame(data, SESSION)


def test_block_plans(spark):
    plans = archive.block_plans(recordings(spark, [(i, 100, 2026, 1, 1 + i) for i in range(1, 26)])).collect()
    hot = {r.session_id for r in plans if r.kind == "hot"}
    assert hot == set(range(6, 26))
    assert {r.block_id for r in plans if r.kind == "archive"} == {"archive-2026-01-01"}
    heavy = [(1, 13_000, 2025, 3, 1), (2, 13_000, 2025, 3, 2)] + [(i, 1, 2026, 1, i) for i in range(3, 23)]
    blocks = {r.session_id: r.block_id for r in archive.block_plans(recordings(spark, heavy)).collect()}
    assert (blocks[1], blocks[2]) == ("archive-2025-03-01", "archive-2025-03-02")


def test_archive_round_trip_and_refusal(spark, tmp_path):
    recs = recordings(spark, [(i, 2, 2026, 1, i) for i in range(1, 24)])
    points = fixes(spark, [(1, s, 60 * s + t, 45.75, 4.8, 5.0) for s in range(1, 24) for t in (0, 5)]).withColumn(
        "point_index", F.col("arrival") % 2)
    plans = archive.block_plans(recs)
    path = str(tmp_path / "archive")
    archive.write_archive(path, recs, plans, points)
    back, observations, repairs = archive.restore_archive(spark, path)
    assert back.count() == 23 and repairs.count() == 23
    key = ["session_id", "ts", "lat", "lon", "accuracy"]
    assert observations.select(*key).exceptAll(points.select(*key)).isEmpty() and observations.count() == 46
    archive.block_checksums(archive.block_payload(plans, points)).withColumn("crc_sum", F.col("crc_sum") + 1).write.mode(
        "overwrite").parquet(f"{path}/checksums")
    with pytest.raises(ValueError, match="block_checksums"):
        archive.restore_archive(spark, path)


def test_gpx_file(spark, tmp_path):
    data = [(1, 42, "walk", "Croix-Rousse: matin/été?", datetime(2026, 8, 7, 8, tzinfo=timezone.utc),
             datetime(2026, 8, 7, 9, tzinfo=timezone.utc), 10.0, 5, 2),
            (1, 43, "walk", "A & <B>", datetime(2026, 8, 7, 8, tzinfo=timezone.utc),
             datetime(2026, 8, 7, 9, tzinfo=timezone.utc), 10.0, 5, 0)]
    recs = spark.createDataFrame(data, SESSION)
    points = fixes(spark, [(1, 42, 0, 45.75, 4.8, 5.0), (1, 42, 5, 45.7501, 4.8, 5.0)]).withColumn("point_index", F.col("arrival"))
    names = {r.session_id: r.file_name for r in gpx.file_names(recs).collect()}
    assert names[42] == "2026-08-07-Croix-Rousse-matin-ete-42.gpx"
    gpx.write_gpx(recs, points, str(tmp_path / "gpx"))
    texts = {p.parent.name: p.read_text() for p in Path(tmp_path / "gpx").glob("*/*/*.txt")}
    assert len(texts) == 2
    track = texts[f"file_name={names[42]}"] if f"file_name={names[42]}" in texts else next(
        t for t in texts.values() if "trkpt" in t)
    assert track.count("<trkpt") == 2 and track.startswith("<?xml") and track.rstrip().endswith("</gpx>")
    assert any("A &amp; &lt;B&gt;" in t for t in texts.values())


def rings_of(spark, *relations):
    """(outer rings, inner rings, open pieces) by relation; pieces are (role, points)."""
    rows = [(k, [("way", role, [(float(a), float(b)) for a, b in points]) for role, points in pieces])
            for k, pieces in enumerate(relations)]
    schema = "id long, members array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>"
    found = osm.relation_rings(spark.createDataFrame(rows, schema)).collect()
    return {r.id: ([[(p.lat, p.lon) for p in ring] for ring in r.outer_rings],
                   [[(p.lat, p.lon) for p in ring] for ring in r.inner_rings], r.open_pieces) for r in found}


def test_ring_assembly(spark):
    square = [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]
    sides = [("outer", [(0, 0), (0, 1)]), ("outer", [(1, 1), (0, 1)]), ("", [(1, 1), (1, 0)]), ("outer", [(0, 0), (1, 0)])]
    apart = [("outer", [(0, 0), (0, 1)]), ("outer", [(5, 5), (6, 6)])]
    branch = [("outer", square[:3]), ("outer", square[2:]), ("outer", [(0, 0), (-1, -1)])]
    flat = [("outer", [(0, 0), (1, 1), (2, 2), (0, 0)])]
    found = rings_of(spark, sides, [("outer", square), ("inner", [(a / 3 + 0.1, b / 3 + 0.1) for a, b in square]),
                                    ("outer", [(a + 3, b) for a, b in square])], apart, branch, flat, [])
    assert found[0] == ([[(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]], [], 0)
    assert [len(x) for x in found[1][:2]] == [2, 1] and found[1][2] == 0
    # The two halves close the ring before the piece that branches off is reached.
    assert found[3] == ([[(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]], [], 1)
    assert found[2] == ([], [], 2) and found[4] == ([], [], 1) and found[5] == ([], [], 0)


def test_rings_that_meet_others(spark):
    square = [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]
    touching = [(-1, -1), (-1, 0), (0, 0), (0, -1), (-1, -1)]
    lens = [("outer", square[:3]), ("outer", [(0, 0), (2, 0), (1, 1)]), ("outer", square[2:])]
    hair = 4e-7  # ends across a border of roundings meet, ends a micro-degree apart do not
    found = rings_of(spark, [("outer", square), ("outer", touching)],
                     [("outer", [(0, 0), (-1, -1)]), ("outer", square[:3]), ("outer", square[2:])],
                     lens, [("outer", square[:3]), ("outer", [(1 + hair, 1 - hair), (1, 0), (hair, -hair)])],
                     [("outer", square[:3]), ("outer", [(1 + 2e-6, 1), (1, 0), (0, 0)])])
    assert found[0] == ([square, touching], [], 0)
    assert found[1] == ([], [], 3)  # the spur comes first and leads away from the ring
    assert found[2] == ([[(0, 0), (0, 1), (1, 1), (2, 0), (0, 0)]], [], 1)
    assert len(found[3][0]) == 1 and found[3][2] == 0 and found[4][:1] == ([],) and found[4][2] == 2


def test_many_pieces_at_one_place(spark):
    spokes = [("outer", [(0, 0), (math.cos(k), math.sin(k))]) for k in range(3000)]
    assert rings_of(spark, spokes)[0] == ([], [], 3000)


def test_numbers_as_json_writes_them(spark):
    from trailmesh.functions.text import plain_number

    given = {0.0: "0", -0.0: "0", 0.0005: "0.0005", -0.00012: "-0.00012", 1e-6: "0.000001", 1.25e-6: "0.00000125", 5e-7: "5e-7",
             -1.5e-9: "-1.5e-9", 0.001: "0.001", 45.0: "45", -180.0: "-180", 4.800001: "4.800001", 0.1: "0.1"}
    df = spark.createDataFrame([(v,) for v in given], "v double")
    assert [r[0] for r in df.select(plain_number(F.col("v"))).collect()] == list(given.values())


def test_long_rings_are_put_together(spark):
    rng = random.Random(4)
    corners = [(math.sin(k / 50 * math.pi), math.cos(k / 50 * math.pi)) for k in range(100)]
    pieces = [("outer", [corners[k], corners[(k + 1) % 100]][:: rng.choice((1, -1))]) for k in range(100)]
    rng.shuffle(pieces)
    (ring,), _, left = rings_of(spark, pieces)[0]
    assert left == 0 and len(ring) == 101 and ring[0] == ring[-1]
    steps = {frozenset(x) for x in zip(ring, ring[1:])}
    assert steps == {frozenset(p) for _, p in pieces}


def test_layers(spark):
    rows = [("1.5", False, False), ("100", False, False), ("", True, False), (" ", False, True), ("x", True, False),
            (None, False, True), ("-2", True, False), ("Infinity", False, False)]
    df = spark.createDataFrame(rows, "t string, bridge boolean, tunnel boolean")
    got = [r[0] for r in df.select(osm.layer_of(F.col("t"), F.col("bridge"), F.col("tunnel"))).collect()]
    assert got == [1.5, 100, 0, 0, 1, -1, -2, 0]


def test_text_hash(spark):
    def plain(text):
        h = 2166136261
        data = text.encode("utf-16-be")
        for k in range(0, len(data), 2):
            h = (h ^ int.from_bytes(data[k:k + 2])) * 16777619 & 0xFFFFFFFF
        return h

    texts = ["", "a", "été", "walk 𝔘 x", "45.75," * 5000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(fnv1a32(F.col("t"))).collect()
    assert [r[0] for r in got] == [plain(t) for t in texts]


def test_whole_degrees_have_no_decimals(spark):
    def zone(*corners):
        return [("z", [[(float(a), float(b)) for a, b in corners]], [])]

    schema = "id string, rings array<array<struct<lat:double,lon:double>>>, holes array<array<struct<lat:double,lon:double>>>"
    mark = spark.createDataFrame(zone((45, 4), (45, 5), (46.5, 4)), schema).select(
        zones.fingerprint().alias("f")).first().f
    text = ('{"holes":[],"outer":[[{"latitude":45,"longitude":4},{"latitude":45,"longitude":5},'
            '{"latitude":46.5,"longitude":4}]]}')
    h = 2166136261
    for c in text:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    assert mark == f"fnv1a:{h:08x}"


def test_zones_from_relations(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join([
        '{"type":"relation","id":1,"tags":{"admin_level":"9","name":"A"},"members":[{"type":"way","role":"outer","geometry":'
        '[{"lat":0,"lon":0},{"lat":0,"lon":1},{"lat":1,"lon":1}]},{"type":"way","role":"","geometry":'
        '[{"lat":0,"lon":0},{"lat":1,"lon":0},{"lat":1,"lon":1}]}]}',
        '{"type":"relation","id":2,"tags":{"admin_level":"8"},"members":[{"type":"way","role":"outer","geometry":'
        '[{"lat":0,"lon":0},{"lat":2,"lon":3}]}]}',
        '{"type":"relation","id":3,"tags":{"admin_level":"6","name":"C"},"members":[]}']))
    elements = osm.read_elements(spark, str(tmp_path), osm.RELATION_SCHEMA)
    found = {r.id: r for r in osm.relation_zones(elements, F.timestamp_seconds(F.lit(0))).collect()}
    assert set(found) == {"relation/1", "relation/2"}
    assert found["relation/1"].source == "openstreetmap" and len(found["relation/1"].rings[0]) == 5
    assert found["relation/2"].source == "openstreetmap_incomplete_fallback" and found["relation/2"].name == "Boundary 2"
    marked = osm.relation_zones(elements, F.timestamp_seconds(F.lit(0))).select("id", zones.is_eligible().alias("ok")).collect()
    assert {r.id: r.ok for r in marked} == {"relation/1": True, "relation/2": False}


def test_holes_and_second_ring(spark):
    ring = lambda a, b: [(a, a), (a, b), (b, b), (b, a)]
    schema = ("id string, type string, name string, parent_zone_id string, admin_level int, source string, "
              "rings array<array<struct<lat:double,lon:double>>>, holes array<array<struct<lat:double,lon:double>>>, fetched_at timestamp")
    zone = spark.createDataFrame([("z", "city", "Z", None, 8, "openstreetmap", [ring(0.0, 0.01), ring(0.02, 0.03)],
                                   [ring(0.004, 0.006)], None)], schema)
    spots = [(i, a, a) for i, a in enumerate((0.001, 0.005, 0.009, 0.015, 0.025, 0.05))]
    points = spark.createDataFrame(spots, "pid long, lat double, lon double")
    inside = sorted(r.pid for r in zones.points_in_zones(points, zone, ["pid"]).collect())
    assert inside == [0, 2, 4]
    spans = {(r.cell_x, r.cell_y) for r in zones.zone_spans(zone).select(
        F.explode(F.sequence("x0", "x1")).alias("cell_x"), F.col("y").alias("cell_y")).collect()}
    assert zones.zone_totals(zone).first().total_cells == len(spans)


def test_daily_tasks(spark):
    schema = "district_id string, local_date date, has_street boolean, has_medal boolean"
    day = datetime(2026, 8, 1).date()
    rich = rewards.daily_tasks(spark.createDataFrame([("relation/9", day, True, True)], schema)).orderBy("slot").collect()
    assert [r.slot for r in rich] == [0, 1, 2] and rich[0].kind == "explore_cells" and rich[0].target in (15, 20, 25)
    poor = rewards.daily_tasks(spark.createDataFrame([("relation/9", day, False, False)], schema)).orderBy("slot").collect()
    assert [r.kind for r in poor] == ["explore_cells", "close_loop", "explore_cells"]
    assert poor[2].target == poor[0].target + 15
