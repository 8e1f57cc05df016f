import math
import random

from pyspark.sql import functions as F

from tests.shapes import fixes
from trailmesh.operators import clean, paths


def metres(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def fold(rows):
    """Reference fold over (t, lat, lon, accuracy)."""
    kept = []
    for t, lat, lon, acc in sorted(rows):
        if acc is not None and acc > 30:
            continue
        if kept:
            d = metres(kept[-1][1:3], (lat, lon))
            dt = t - kept[-1][0]
            if dt <= 0 or d < 1 or d / dt > 4:
                continue
        kept.append((t, lat, lon, acc))
    return kept


def noisy(rng, n, session):
    rows, lat, lon = [], 45.75, 4.8
    for i in range(n):
        lat += rng.choice([0, 1e-5, 2e-5])
        lon += rng.choice([-1e-5, 0, 2e-5])
        jump = 0.01 if rng.random() < 0.08 else 0
        acc = rng.choice([None, 5.0, 12.0, 30.0, 45.0])
        rows.append((1, session, i * 3 + rng.randint(0, 2), lat + jump, lon, acc))
    return rows


def test_fold_matches_and_slicing_changes_nothing(spark):
    rng = random.Random(5)
    rows = [r for s in range(6) for r in noisy(rng, 120, s)]
    rng.shuffle(rows)
    obs = fixes(spark, rows)
    want = {(s, t) for s in range(6) for t, *_ in fold([(r[2], r[3], r[4], r[5]) for r in rows if r[1] == s])}
    whole = clean.accepted_points(clean.accept_fixes(obs))
    got = {(r.session_id, r.ts.timestamp(), r.point_index) for r in whole.collect()}
    assert {(s, t - min(g[1] for g in got)) for s, t, _ in got} == {
        (s, t - min(w[1] for w in want)) for s, t in want}
    sliced = clean.accepted_points(clean.accept_fixes(obs, slice_seconds=20))
    assert {(r.session_id, r.ts.timestamp(), r.point_index) for r in sliced.collect()} == got


def test_jump_at_a_slice_border_is_seen(spark):
    # The slice starts with a jump that only the fix before it reveals, then drifts back.
    rows = [(1, 1, t, 45.75 + t * 1e-5, 4.8, 5.0) for t in range(0, 30)]
    rows += [(1, 1, 30 + t, 45.76, 4.8, 5.0) for t in range(0, 5)]
    rows += [(1, 1, 40 + t, 45.7503 + t * 1e-5, 4.8, 5.0) for t in range(0, 30)]
    obs = fixes(spark, rows)
    a = clean.accept_fixes(obs).filter("accepted").count()
    b = clean.accept_fixes(obs, slice_seconds=10).filter("accepted").count()
    assert a == b == len(fold([r[2:] for r in rows]))


def test_thousand_points(spark):
    rows = [(1, 1, i * 5, 45.75 + i * 5e-5, 4.8, 5.0) for i in range(1000)]
    points = clean.canonical_points(fixes(spark, rows))
    assert points.count() == 1000
    tail = [r.point_index for r in paths.live_tail(points).collect()]
    assert (min(tail), max(tail), len(tail)) == (700, 999, 300)
    chunks = {}
    for r in paths.chunk_vertices(points).collect():
        chunks.setdefault(r.chunk_no, []).append(r.point_index)
    assert len(chunks) == 4
    assert all(max(chunks[k]) == min(chunks[k + 1]) for k in range(3))
    assert max(len(v) for v in chunks.values()) == 256


def test_outage_leaves_two_chunks(spark):
    rows = [(1, 1, t, 45.75, 4.8 + dlon, 5.0) for dlon, t in ((0, 0), (2e-5, 1), (1e-3, 61), (1.02e-3, 62))]
    points = clean.canonical_points(fixes(spark, rows))
    assert points.count() == 4
    assert paths.chunk_vertices(points).select("run_no", "chunk_no").distinct().count() == 2
    kinds = [r.kind for r in paths.steps(points).orderBy("step_no").collect()]
    assert kinds == ["confirmed", "gap", "confirmed"]


def test_best_observation_prefers_known_accuracy_then_arrival(spark):
    rows = [(1, 1, 0, 45.0, 4.0, None), (1, 1, 0, 45.1, 4.0, 9.0), (1, 1, 0, 45.2, 4.0, 9.0)]
    best = clean.best_observations(fixes(spark, rows)).collect()
    assert [(r.lat, r.arrival) for r in best] == [(45.1, 1)]


def test_order_of_arrival_does_not_matter(spark):
    rng = random.Random(9)
    rows = noisy(rng, 80, 1)
    first = {r.ts for r in clean.canonical_points(fixes(spark, rows)).collect()}
    rng.shuffle(rows)
    assert {r.ts for r in clean.canonical_points(fixes(spark, rows)).collect()} == first


def later(df, *columns):
    """The same rows 1700 years on, where nanoseconds since 1970 do not fit into 64 bits."""
    return df.withColumns({c: F.col(c) + F.expr("INTERVAL 1700 YEARS") for c in columns})


def test_fold_takes_times_of_any_year(spark):
    obs = fixes(spark, noisy(random.Random(3), 60, 1)).withColumn(
        "seen", F.when(F.col("arrival") % 2 == 0, F.col("ts")))
    fields = ["session_id", "arrival", "accepted", "verdict", "speed_mps", "point_index"]
    now = clean.accept_fixes(obs, slice_seconds=20)
    then = clean.accept_fixes(later(obs, "ts", "seen"), slice_seconds=20)
    assert sorted(map(str, now.select(*fields).collect())) == sorted(map(str, then.select(*fields).collect()))
    moved = sorted(map(str, later(now, "ts", "seen").select("arrival", "ts", "seen").collect()))
    assert moved == sorted(map(str, then.select("arrival", "ts", "seen").collect()))
