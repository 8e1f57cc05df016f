"""Adopted positions and first centres against a fold in arrival order."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailmesh.operators import position

T0 = datetime(2024, 5, 1, 12)
SCHEMA = "owner_id long, arrival long, ts timestamp, seen_at timestamp, lat double, lon double, accuracy double, on_route boolean"


def arrivals_of(seed, owners=12, most=60):
    rng = random.Random(seed)
    rows = []
    for owner in range(owners):
        for k in range(rng.randint(1, most)):
            ts = None if rng.random() < 0.05 else T0 + timedelta(seconds=3 * k + rng.randint(-9, 9))
            seen = None if ts is None else ts + timedelta(seconds=rng.choice([0, 1, 29, 30, 31, 90]))
            rows.append((owner, 1000 * owner + 7 * k, ts, seen, rng.choice([45.0, 45.1, 45.2, 91.0, None, float("nan")]), 4.8,
                         rng.choice([3.0, 12.0, 19.0, 20.0, 28.0, 30.0, 31.0, 60.0, 100.0, 140.0, -1.0, None, float("nan")]),
                         rng.choice([True, False, False, False, None])))
    return rows


def possible(row):
    return row[4] is not None and -90 <= row[4] <= 90


def fold(rows):
    """{arrival: adopted}"""
    shown, out = {}, {}
    for row in sorted(rows, key=lambda r: r[1]):
        owner, arrival, ts, _, _, _, accuracy, route = row
        time, moves = ts or datetime.min, False
        if possible(row):
            good = route or (accuracy is not None and 0 <= accuracy <= 30)
            moves = owner not in shown or (time >= shown[owner] and bool(good))
        if moves:
            shown[owner] = time
        out[arrival] = moves
    return out


def centres(rows, adopted):
    """{owner: (first arrival, arrival, reliable)}"""
    out = {}
    for owner, arrival, ts, seen, _, _, accuracy, route in sorted(rows, key=lambda r: r[1]):
        known = accuracy if accuracy is not None and 0 <= accuracy <= 100 else None
        if not adopted[arrival] or ts is None:
            continue
        if not route and (abs((seen - ts).total_seconds()) > 30 or (accuracy is not None and known is None)):
            continue
        reliable = bool(route) or (known is not None and known <= 20)
        if owner not in out:
            out[owner] = (arrival, arrival, reliable, known, ts)
            continue
        first, _, sure, before, since = out[owner]
        if sure or not reliable or ts < since or known is None:
            continue
        if known <= 20 if before is None else before - known >= max(10, before / 4):
            out[owner] = (first, arrival, True, known, ts)
    return {owner: c[:3] for owner, c in out.items()}


@pytest.mark.parametrize(("seed", "slice_size"), [(1, 10 ** 9), (2, 50), (3, 7)])
def test_positions_equal_the_fold(spark, seed, slice_size):
    rows = arrivals_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = position.adopted_positions(df, F.floor(F.col("arrival") / slice_size))
    want = fold(rows)
    assert {r.arrival: r.adopted for r in got.collect()} == want
    first = position.startup_centres(got.filter("adopted")).collect()
    assert {r.owner_id: (r.first_arrival, r.arrival, r.reliable) for r in first} == centres(rows, want)
    assert all(r.upgraded == (r.arrival != r.first_arrival) for r in first)


def test_no_arrivals(spark):
    got = position.adopted_positions(spark.createDataFrame([], SCHEMA), F.floor(F.col("arrival") / 5))
    assert got.collect() == [] and position.startup_centres(got).collect() == []
