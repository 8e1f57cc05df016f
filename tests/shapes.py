"""Hand-made inputs shared by the tests."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

T0 = datetime(2026, 1, 1, 12, 0, 0, tzinfo=timezone.utc)


def rectangle(w, h, skip=()):
    return {(x, y) for x in range(w) for y in range(h)} - set(skip)


def perimeter(n, dx=0, dy=0):
    return {(x + dx, y + dy) for x in range(n) for y in range(n) if x in (0, n - 1) or y in (0, n - 1)}


def cells(spark, groups):
    """``groups`` maps an owner to its cells."""
    rows = [(o, x, y) for o, group in groups.items() for x, y in group]
    return spark.createDataFrame(rows, "owner_id long, cell_x int, cell_y int")


def fixes(spark, rows):
    """Rows of (owner, session, seconds, lat, lon, accuracy)."""
    data = [(o, s, T0 + timedelta(seconds=t), lat, lon, a, i) for i, (o, s, t, lat, lon, a) in enumerate(rows)]
    return spark.createDataFrame(
        data, "owner_id long, session_id long, ts timestamp, lat double, lon double, accuracy double, arrival long")
