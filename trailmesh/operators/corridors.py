"""Street data around paths: lookup and audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmesh import constants as K
from trailmesh.functions.geo import buckets_between, haversine_m, line_progress, near_bucket
from trailmesh.operators.clean import RECORDING, spaced_points
from trailmesh.session import dealt

# Fixed values, metres.
CORRIDOR_M, CORRIDOR_SPACING_M = 450.0, 250.0
GAP_PROBE_M = 70.0
REFRESH_PROBE_M, REFRESH_SPACING_M = 175.0, 600.0
REPAIR_M, REPAIR_SPACING_M = 250.0, 175.0


def _wide(pad: float, *lats: str) -> Column:
    """Degrees of longitude that cover ``pad`` degrees of latitude at the widest place."""
    edge = F.greatest(*[F.abs(c) for c in lats]) + pad
    return pad / F.greatest(F.lit(1 / K.METERS_PER_DEGREE), F.cos(F.radians(F.least(F.lit(89.9), edge))))


def streets_near(probes: DataFrame, streets: DataFrame, radius_m: float, ids: Sequence[str]) -> DataFrame:
    """(ids..., segment_id, fetched_at) for street boxes that meet a box around a probe."""
    pad = radius_m / K.METERS_PER_DEGREE
    size = max(0.001, 2 * pad)
    spots = probes.select(*ids, "lat", "lon", near_bucket("lat", size).alias("_gy"), near_bucket("lon", size).alias("_gx"))
    placed = streets.select(
        F.col("id").alias("segment_id"), "fetched_at", "min_lat", "max_lat", "min_lon", "max_lon",
        _wide(pad, "min_lat", "max_lat").alias("_w"), F.explode(buckets_between("min_lat", "max_lat", size, pad)).alias("_gy"),
    ).withColumn("_gx", F.explode(F.sequence(
        F.floor((F.col("min_lon") - F.col("_w")) / size), F.floor((F.col("max_lon") + F.col("_w")) / size))))
    d_lon = radius_m / F.greatest(F.lit(1.0), K.METERS_PER_DEGREE * F.cos(F.radians("lat")))
    # A bucket's streets and probes are few rows but many pairs.
    return spots.join(dealt(placed, "_gy", "_gx"), ["_gy", "_gx"]).filter(
        (F.col("max_lat") >= F.col("lat") - pad) & (F.col("min_lat") <= F.col("lat") + pad)
        & (F.col("max_lon") >= F.col("lon") - d_lon) & (F.col("min_lon") <= F.col("lon") + d_lon)
    ).select(*ids, "segment_id", "fetched_at")


def corridor_streets(points: DataFrame, streets: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Street parts around each recording: centres every 250 m, boxes of 450 m."""
    centres = spaced_points(points, CORRIDOR_SPACING_M, keys)
    return streets_near(centres, streets, CORRIDOR_M, keys).select(*keys, "segment_id").distinct()


def gaps_to_fetch(gaps: DataFrame, streets: DataFrame, as_of: Column, keys: Sequence[str] = (*RECORDING, "step_no")) -> DataFrame:
    """Gaps with no street data younger than 30 days within 70 m of their midpoint."""
    middle = gaps.select(
        *keys, "from_lat", "from_lon", "to_lat", "to_lon",
        ((F.col("from_lat") + F.col("to_lat")) / 2).alias("lat"), ((F.col("from_lon") + F.col("to_lon")) / 2).alias("lon"))
    fresh = F.unix_millis("fetched_at") >= F.unix_millis(as_of) - K.BOUNDARY_FRESH_DAYS * 86400000
    known = streets_near(middle, streets.filter(fresh), GAP_PROBE_M, keys).select(*keys).distinct()
    return middle.join(known, list(keys), "left_anti")


def samples_to_fetch(points: DataFrame, streets: DataFrame, keys: Sequence[str] = RECORDING,
                     as_of: Column | None = None) -> DataFrame:
    """Path samples every 600 m without any street within 175 m; with ``as_of``, without any fetched lately."""
    probes = spaced_points(points, REFRESH_SPACING_M, keys).select(*keys, "point_index", "lat", "lon")
    fresh = F.lit(True) if as_of is None else (
        F.unix_millis("fetched_at") >= F.unix_millis(as_of) - K.BOUNDARY_FRESH_DAYS * 86400000)
    known = streets_near(probes, streets.filter(fresh), REFRESH_PROBE_M, [*keys, "point_index"]).select(*keys, "point_index").distinct()
    return probes.join(known, [*keys, "point_index"], "left_anti")


def corridor_lines(points: DataFrame, spacing_m: float = REPAIR_SPACING_M, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Lines between the path centres of a recording; a lone centre gives a line without length."""
    centres = spaced_points(points, spacing_m, keys).select(*keys, "point_index", "lat", "lon").dropDuplicates(
        [*keys, "point_index"])
    # One row per 175 m of path: small against the fixes it stands for.
    order = Window.partitionBy(*keys).orderBy("point_index")
    both = centres.select(
        *keys, "point_index", F.lag("lat").over(order).alias("from_lat"), F.lag("lon").over(order).alias("from_lon"),
        F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), F.lead("lat").over(order).alias("_next"))
    lone = F.col("from_lat").isNull() & F.col("_next").isNull()
    return both.filter(F.col("from_lat").isNotNull() | lone).withColumns({
        "from_lat": F.coalesce("from_lat", "to_lat"), "from_lon": F.coalesce("from_lon", "to_lon")}).drop("_next")


def within_corridors(spots: DataFrame, lines: DataFrame, radius_m: float, ids: Sequence[str]) -> DataFrame:
    """Spots at most ``radius_m`` from any corridor line, with the distance to the nearest."""
    ids = list(ids)
    # Great circles, which lone centres use, are 0.1 % shorter than planar metres.
    pad = radius_m * 1.002 / K.METERS_PER_DEGREE
    size = max(0.002, 2 * pad)
    here = spots.select(
        *ids, "lat", "lon", F.greatest(F.lit(1.0), K.METERS_PER_DEGREE * F.cos(F.radians("lat"))).alias("_scale"),
        near_bucket("lat", size).alias("_gy"), near_bucket("lon", size).alias("_gx"))
    south, north = F.least("from_lat", "to_lat"), F.greatest("from_lat", "to_lat")
    west, east = F.least("from_lon", "to_lon"), F.greatest("from_lon", "to_lon")
    placed = lines.select("from_lat", "from_lon", "to_lat", "to_lon").distinct().select(
        "*", _wide(pad, "from_lat", "to_lat").alias("_w"), F.explode(buckets_between(south, north, size, pad)).alias("_gy"),
    ).select(
        "from_lat", "from_lon", "to_lat", "to_lon", (south - pad).alias("_south"), (north + pad).alias("_north"),
        (west - F.col("_w")).alias("_west"), (east + F.col("_w")).alias("_east"), "_gy",
        F.explode(F.sequence(F.floor((west - F.col("_w")) / size), F.floor((east + F.col("_w")) / size))).alias("_gx"))
    # Most pairs of a bucket are too far apart: four comparisons keep them from the costly measure.
    met = dealt(here, "_gy", "_gx").join(placed, ["_gy", "_gx"]).filter(
        F.col("lat").between(F.col("_south"), F.col("_north")) & F.col("lon").between(F.col("_west"), F.col("_east")))
    flat = met.select(
        *ids, "lat", "lon", "from_lat", "from_lon",
        ((F.col("from_lat") == F.col("to_lat")) & (F.col("from_lon") == F.col("to_lon"))).alias("_lone"),
        ((F.col("from_lon") - F.col("lon")) * F.col("_scale")).alias("_ax"),
        ((F.col("from_lat") - F.col("lat")) * K.METERS_PER_DEGREE).alias("_ay"),
        ((F.col("to_lon") - F.col("lon")) * F.col("_scale")).alias("_bx"),
        ((F.col("to_lat") - F.col("lat")) * K.METERS_PER_DEGREE).alias("_by"))
    origin = F.lit(0.0)
    metres = F.when(F.col("_lone"), haversine_m("lat", "lon", "from_lat", "from_lon")).otherwise(F.hypot(
        F.col("_ax") + F.col("_t") * (F.col("_bx") - F.col("_ax")), F.col("_ay") + F.col("_t") * (F.col("_by") - F.col("_ay"))))
    near = flat.withColumn("_t", line_progress(origin, origin, "_ax", "_ay", "_bx", "_by")).groupBy(*ids).agg(
        F.min(metres).alias("distance_m"))
    return near.filter(F.col("distance_m") <= radius_m)
