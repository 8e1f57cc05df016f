"""Totals kept per fingerprint, and what falls away when a zone changes its shape."""

from __future__ import annotations

from trailmesh import constants as K
from trailmesh.operators import zones

RINGS = "array<array<struct<lat:double,lon:double>>>"
ZONE = f"id string, source string, name string, rings {RINGS}, holes {RINGS}"


def box(south, west, side=0.004):
    south, west = float(south), float(west)
    return [[(south, west), (south, west + side), (south + side, west + side), (south + side, west)]]


def table(spark, *rows):
    return spark.createDataFrame([(i, source, name, rings, []) for i, source, name, rings in rows], ZONE)


def totals_of(df):
    return {r.zone_id: (r.total_cells, r.reused) for r in df.collect()}


def test_totals_are_counted_once_per_shape(spark):
    exact = "openstreetmap"
    first = table(spark, ("a", exact, "A", box(45, 4)), ("b", exact, "B", box(45, 5)), ("c", exact, "C", box(46, 4)))
    empty = spark.createDataFrame([], "zone_id string, cell_size_m int, geometry_fingerprint string, total_cells long")
    fresh = zones.refreshed_totals(first, empty)
    want = {r.zone_id: r.total_cells for r in zones.zone_totals(first).collect()}
    assert totals_of(fresh) == {k: (n, False) for k, n in want.items()}
    store = fresh.drop("reused")
    assert totals_of(zones.refreshed_totals(first, store)) == {k: (n, True) for k, n in want.items()}
    # b gets another shape, c goes, d is new; a row without fingerprint and one of another cell size prove nothing.
    second = table(spark, ("a", exact, "A2", box(45, 4)), ("b", exact, "B", box(45, 5, 0.002)), ("d", exact, "D", box(45, 4)))
    odd = spark.createDataFrame([("d", K.CELL_M, None, 7), ("b", 2 * K.CELL_M, None, 7), ("a", K.CELL_M, None, None)], store.schema)
    got = totals_of(zones.refreshed_totals(second, store.unionByName(odd).unionByName(store)))
    small = zones.zone_totals(second.filter("id = 'b'")).first().total_cells
    assert got == {"a": (want["a"], True), "b": (small, False), "d": (want["a"], False)} and small < want["b"]


def test_edges_are_read_of_missing_zones_only(spark, monkeypatch):
    zone = table(spark, ("a", "openstreetmap", "A", box(45, 4)), ("b", "openstreetmap", "B", box(45, 5)))
    store = zones.refreshed_totals(zone, spark.createDataFrame(
        [], "zone_id string, cell_size_m int, geometry_fingerprint string, total_cells long")).drop("reused").filter("zone_id = 'a'")
    read, edges = [], zones.zone_edges
    monkeypatch.setattr(zones, "zone_edges", lambda z: read.append(z) or edges(z))
    zones.refreshed_totals(zone, store)
    assert [[r.id for r in z.collect()] for z in read] == [["b"]]


def test_only_another_shape_drops_dependents(spark):
    exact, loose = "openstreetmap", "openstreetmap_incomplete_fallback"
    stored = table(spark, ("same", exact, "1", box(45, 4)), ("moved", exact, "2", box(45, 5)), ("refused", exact, "3", box(45, 6)),
                   ("absent", exact, "4", box(45, 7)), ("better", loose, "5", box(45, 8)))
    arrived = table(spark, ("same", exact, "new", box(45, 4)), ("moved", exact, "2", box(45.1, 5)),
                    ("refused", loose, "3", box(45.1, 6)), ("better", exact, "5", box(45.1, 8)), ("fresh", exact, "6", box(45, 9)))
    ids = ["same", "moved", "refused", "absent", "better", "fresh", "unknown"]
    totals = spark.createDataFrame([(i, 1) for i in ids], "zone_id string, total_cells long")
    seen = spark.createDataFrame([(o, i) for i in ids for o in (1, 2)], "owner_id long, zone_id string")
    merged, (kept, snapshots) = zones.replace_zones(stored, arrived, totals, seen)
    assert {r.id: (r.name, r.source) for r in merged.collect()} == {
        "same": ("new", exact), "moved": ("2", exact), "refused": ("3", exact), "absent": ("4", exact), "better": ("5", exact),
        "fresh": ("6", exact)}
    left = {"same", "refused", "absent", "fresh", "unknown"}
    assert {r.zone_id for r in kept.collect()} == left
    assert sorted((r.owner_id, r.zone_id) for r in snapshots.collect()) == sorted((o, i) for i in left for o in (1, 2))


def test_no_zones(spark):
    none = table(spark)
    store = spark.createDataFrame([("x", K.CELL_M, "fnv1a:00000000", 5)],
                                  "zone_id string, cell_size_m int, geometry_fingerprint string, total_cells long")
    assert zones.refreshed_totals(none, store).collect() == []
    merged, (kept,) = zones.replace_zones(none, none, store)
    assert merged.collect() == [] and kept.count() == 1
