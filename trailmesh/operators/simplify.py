"""Line simplification (farthest point splitting) and previews."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from trailmesh import constants as K
from trailmesh.functions.geo import haversine_m, line_distance
from trailmesh.operators.clean import RECORDING
from trailmesh.operators.grouped import map_any_time, stream_groups
from trailmesh.operators.ordered import time_slice, with_running
from trailmesh.session import checkpointed

# Ranges longer than this are split by Spark in rounds; shorter ones are finished inside a task.
IN_TASK = 4096


def great_circle_m(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    p, q = math.radians(lat), np.radians(lats)
    h = np.sin((q - p) / 2) ** 2 + math.cos(p) * np.cos(q) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * K.HAVERSINE_RADIUS_M * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def _kept(lat: np.ndarray, lon: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of one line stay."""
    keep = np.zeros(len(lat), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(lat) - 1)]
    while todo:
        a, b = todo.pop()
        if b <= a + 1:
            continue
        scale = K.METERS_PER_DEGREE * math.cos(math.radians(lat[a]))
        x, y = (lon[a + 1:b] - lon[a]) * scale, (lat[a + 1:b] - lat[a]) * K.METERS_PER_DEGREE
        ex, ey = (lon[b] - lon[a]) * scale, (lat[b] - lat[a]) * K.METERS_PER_DEGREE
        square = ex * ex + ey * ey
        if lat[a] == lat[b] and lon[a] == lon[b]:  # a closed range: great circles, as in the rounds
            off = great_circle_m(lat[a], lon[a], lat[a + 1:b], lon[a + 1:b])
        else:
            t = np.clip((x * ex + y * ey) / square, 0, 1)
            off = np.hypot(x - ex * t, y - ey * t)
        far = int(off.argmax())
        if off[far] > tolerance:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep


def _finish(line: pd.DataFrame) -> pd.DataFrame:
    if len(line) <= 2 or line["_tol"].iloc[0] <= 0:
        return line
    return line[_kept(line["lat"].to_numpy(), line["lon"].to_numpy(), float(line["_tol"].iloc[0]))]


def simplify_chunks(chunks: DataFrame, tolerance_m: float, keys: Sequence[str] = (*RECORDING, "run_no", "chunk_no")) -> DataFrame:
    """Simplified route chunks; a chunk has at most 256 vertices."""
    groups = list(keys)
    rows = chunks.withColumn("_tol", F.lit(float(tolerance_m)))
    ordered = rows.repartition(*groups).sortWithinPartitions(*groups, "point_index")
    return map_any_time(ordered, stream_groups(groups, _finish), rows.schema).drop("_tol")


def simplify_lines(points: DataFrame, tolerance: Column, keys: Sequence[str] = RECORDING, in_task: int = IN_TASK) -> DataFrame:
    """Simplified lines of any length, one per key, in order of ``point_index``.

    Long ranges are split in rounds: the farthest point of every range is found by one
    aggregate, whatever the length of the range. Ranges that have become short are gathered
    and finished inside a task.
    """
    keys = list(keys)
    ends = points.groupBy(*keys).agg(F.min("point_index").alias("_a"), F.max("point_index").alias("_b"))
    spot = points.select(*keys, "point_index", "lat", "lon")
    ranged = points.withColumn("_tol", tolerance).join(ends, keys)
    long_lines = ends.filter(F.col("_b") - F.col("_a") > in_task)
    fixed = None
    if not long_lines.isEmpty():
        ranged = checkpointed(ranged)
        while True:
            big = ranged.filter(F.col("_b") - F.col("_a") > in_task)
            corners = big.select(*keys, "_a", "_b").distinct()
            a = spot.select(*keys, F.col("point_index").alias("_a"), F.col("lat").alias("_alat"), F.col("lon").alias("_alon"))
            b = spot.select(*keys, F.col("point_index").alias("_b"), F.col("lat").alias("_blat"), F.col("lon").alias("_blon"))
            cornered = big.join(corners.join(a, [*keys, "_a"]).join(b, [*keys, "_b"]), [*keys, "_a", "_b"])
            scale = K.METERS_PER_DEGREE * F.cos(F.radians("_alat"))
            x, y = (F.col("lon") - F.col("_alon")) * scale, (F.col("lat") - F.col("_alat")) * K.METERS_PER_DEGREE
            ex, ey = (F.col("_blon") - F.col("_alon")) * scale, (F.col("_blat") - F.col("_alat")) * K.METERS_PER_DEGREE
            off = F.when((F.col("_alat") == F.col("_blat")) & (F.col("_alon") == F.col("_blon")), haversine_m("_alat", "_alon", "lat", "lon")) \
                .otherwise(line_distance(x, y, F.lit(0.0), F.lit(0.0), ex, ey))
            inner = cornered.filter("point_index > _a AND point_index < _b").withColumn("_off", off)
            farthest = inner.groupBy(*keys, "_a", "_b").agg(
                F.max(F.struct(F.col("_off"), (-F.col("point_index")).alias("n"))).alias("_f"), F.max("_tol").alias("_limit"))
            splits = farthest.select(
                *keys, "_a", "_b", F.when(F.col("_f._off") > F.col("_limit"), -F.col("_f.n")).alias("_m"))
            splits = checkpointed(splits)
            if splits.isEmpty():
                break
            joined = ranged.join(splits, [*keys, "_a", "_b"], "left")
            was_big = F.col("_b") - F.col("_a") > in_task
            # Flat ranges keep only their ends; the others fall into two, the split point ending the first.
            kept = joined.filter(~was_big | F.col("_m").isNotNull() | F.col("point_index").isin(F.col("_a"), F.col("_b")))
            left = F.col("point_index") <= F.col("_m")
            ranged = checkpointed(kept.select(
                *[c for c in ranged.columns if c not in ("_a", "_b")],
                F.when(was_big & F.col("_m").isNull(), F.col("point_index")).when(was_big & ~left, F.col("_m")).otherwise(F.col("_a")).alias("_a"),
                F.when(was_big & F.col("_m").isNull(), F.col("point_index")).when(was_big & left, F.col("_m")).otherwise(F.col("_b")).alias("_b"),
            ))
        # Every inner range needs its first vertex again, which ended the range before it.
        starts = ranged.select(*keys, "_a", "_b", "_tol").distinct().join(
            ranged.drop("_a", "_b", "_tol").withColumn("_a", F.col("point_index")), [*keys, "_a"]).select(*ranged.columns)
        fixed = ranged.unionByName(starts).dropDuplicates([*keys, "_a", "point_index"])
    rows = ranged if fixed is None else fixed
    groups = [*keys, "_a"]
    ordered = rows.repartition(*groups).sortWithinPartitions(*groups, "point_index")
    done = map_any_time(ordered, stream_groups(groups, _finish), rows.schema)
    result = done.select(*points.columns)
    return result if fixed is None else result.dropDuplicates([*keys, "point_index"])


def preview_points(points: DataFrame, keys: Sequence[str] = RECORDING, limit: int = K.PREVIEW_LIMIT) -> DataFrame:
    """Simplified lines, evenly thinned to at most ``limit`` points."""
    keys = list(keys)
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # 6, 3 and 1.5 metres by length.
    tolerance = F.when(F.col("_n") <= 2, 0.0).when(F.col("_n") > 10000, 6.0).when(F.col("_n") > 3000, 3.0).otherwise(1.5)
    sized = points.join(sizes, keys).withColumn("_wish", tolerance)
    thin = simplify_lines(sized, F.col("_wish"), keys).drop("_wish", "_n")
    placed = with_running(thin, keys, "ts", time_slice(), index="_at")
    counts = thin.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    last = F.col("_m") - 1
    # The points hit by limit evenly spaced places: one lies within half a step of index i.
    step = last / F.lit(limit - 1)
    hit = F.floor(F.round(F.col("_at") / step) * step + 0.5) == F.col("_at")
    near = hit | (F.floor(F.floor(F.col("_at") / step) * step + 0.5) == F.col("_at")) \
        | (F.floor(F.ceil(F.col("_at") / step) * step + 0.5) == F.col("_at"))
    return placed.join(counts, keys).filter((F.col("_m") <= limit) | near).select(
        *points.columns, F.col("_at").alias("preview_index"))


