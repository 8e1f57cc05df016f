import math
import random

import numpy as np

from tests.shapes import fixes
from trailmesh.operators import clean, simplify


def wobbly(n, seed=1):
    rng = random.Random(seed)
    lat, lon, rows = 45.75, 4.8, []
    for i in range(n):
        lat += rng.uniform(-1e-5, 3e-5)
        lon += rng.uniform(-2e-5, 3e-5)
        rows.append((1, 1, i, lat, lon, 5.0))
    return rows


def indexed(spark, rows):
    return fixes(spark, rows).withColumnRenamed("arrival", "point_index")


def test_rounds_and_in_task_agree(spark):
    rows = wobbly(400)
    want = np.flatnonzero(simplify._kept(np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), 4.0))
    points = indexed(spark, rows)
    from pyspark.sql import functions as F

    a = sorted(r.point_index for r in simplify.simplify_lines(points, F.lit(4.0)).collect())
    b = sorted(r.point_index for r in simplify.simplify_lines(points, F.lit(4.0), in_task=20).collect())
    assert a == want.tolist() == b


def test_straight_line_keeps_ends(spark):
    rows = [(1, 1, i, 45.75 + i * 1e-5, 4.8, 5.0) for i in range(50)]
    from pyspark.sql import functions as F

    for limit in (4096, 10):
        kept = simplify.simplify_lines(indexed(spark, rows), F.lit(1.0), in_task=limit).collect()
        assert sorted(r.point_index for r in kept) == [0, 49]


def test_preview_picks_even_points(spark):
    rng = random.Random(2)
    rows = [(1, 1, i, 45.75 + i * 1e-4, 4.8 + rng.choice([0, 5e-4]), 5.0) for i in range(300)]
    kept = simplify.preview_points(indexed(spark, rows), limit=20)
    got = sorted(r.preview_index for r in kept.collect())
    n = simplify.preview_points(indexed(spark, rows)).count()
    want = sorted({math.floor(i / 19 * (n - 1) + 0.5) for i in range(20)})
    assert got == want


def test_spacing_keeps_first_far_and_last(spark):
    rows = [(1, 1, i, 45.75 + i * 1e-4, 4.8, 5.0) for i in range(31)]
    points = indexed(spark, rows)
    want = [0, 9, 18, 27, 30]
    assert sorted(r.point_index for r in clean.spaced_points(points, 95.0).collect()) == want
    sliced = clean.spaced_points(points, 95.0, slice_seconds=4)
    assert sorted(r.point_index for r in sliced.collect()) == want


def test_times_of_any_year_pass(spark):
    from pyspark.sql import functions as F

    points = indexed(spark, wobbly(60)).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1700 YEARS"))
    lines = simplify.simplify_lines(points, F.lit(4.0)).join(points.select("point_index", F.col("ts").alias("was")), "point_index")
    assert lines.filter("ts = was").count() == lines.count() > 1
    chunks = points.withColumns({"run_no": F.lit(0), "chunk_no": F.lit(0)})
    assert simplify.simplify_chunks(chunks, 4.0).filter("ts > '3000-01-01'").count() == lines.count()
