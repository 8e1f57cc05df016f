"""Street predicates, coverage of street parts by routes, and completion."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmesh import constants as K
from trailmesh.functions.geo import (
    band_latitude, bands_between, buckets_between, clamp01, haversine_m, latitude_band, line_distance, near_bucket,
    one_decimal_percent, planar_x, planar_y,
)
from trailmesh.functions.text import street_of_part
from trailmesh.operators.clean import RECORDING
from trailmesh.operators.ordered import with_running
from trailmesh.session import checkpointed, dealt

# Distances that differ by less than this count as equal, so that rounding never picks the street.
_TIE_DIGITS = 6


# ---------------------------------------------------------------- predicates

def _access_allows(foot_no: list[str]) -> Column:
    foot, access = F.lower(F.coalesce("foot", F.lit(""))), F.lower(F.coalesce("access", F.lit("")))
    barred = access.isin("no", "private") & ~foot.isin(K.FOOT_YES)
    return ~F.col("highway").isin(K.NOT_WALKABLE_HIGHWAYS) & ~foot.isin(foot_no) & ~barred


def is_routable() -> Column:
    return _access_allows(["no", "private", "use_sidepath"])


def is_walkable() -> Column:
    return _access_allows(["no", "private"])


def counts_for_loops() -> Column:
    return F.col("highway").isin(K.LOOP_HIGHWAYS)


def near_streets(streets: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Street parts whose box meets a box around a point: named first, then by name and id.

    Plain comparisons on the box columns, so that Parquet row groups can be skipped.
    """
    d_lat = radius_m / K.METERS_PER_DEGREE
    d_lon = radius_m / max(1.0, K.METERS_PER_DEGREE * math.cos(math.radians(lat)))
    return streets.filter(
        F.col("id").like("way/%/part/%")
        & (F.col("max_lat") >= lat - d_lat) & (F.col("min_lat") <= lat + d_lat)
        & (F.col("max_lon") >= lon - d_lon) & (F.col("min_lon") <= lon + d_lon)
    ).orderBy(F.col("name").asc_nulls_last(), "id")


# ---------------------------------------------------------------- geometry of parts

def _pairs(coords: str = "coords") -> Column:
    n = F.size(coords)
    at = F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.get(coords, i).alias("a"), F.get(coords, i + 1).alias("b")))


def part_length(coords: str = "coords") -> Column:
    """Great-circle length of a line string."""
    return F.aggregate(
        _pairs(coords), F.lit(0.0),
        lambda total, p: total + haversine_m(p["a"]["lat"], p["a"]["lon"], p["b"]["lat"], p["b"]["lon"]))


def part_length_legacy(coords: str = "coords") -> Column:
    """Planar length at the mid latitude of each edge, as used for legacy totals."""

    def edge(p: Column) -> Column:
        mid = (p["a"]["lat"] + p["b"]["lat"]) / 2
        return F.hypot(
            (p["b"]["lon"] - p["a"]["lon"]) * K.METERS_PER_DEGREE * F.cos(F.radians(mid)),
            (p["b"]["lat"] - p["a"]["lat"]) * K.METERS_PER_DEGREE)

    return F.aggregate(_pairs(coords), F.lit(0.0), lambda total, p: total + edge(p))


def measured_parts(streets: DataFrame) -> DataFrame:
    """Walkable parts of positive length with their bins."""
    usable = streets.filter(is_walkable() & (F.size("coords") >= 2)).withColumn("total_m", part_length())
    return usable.filter("total_m > 0").select(
        F.col("id").alias("segment_id"), street_of_part(F.col("id")).alias("street_id"), "name", "highway", "coords",
        "total_m", F.greatest(F.lit(1), F.ceil(F.col("total_m") / K.STREET_BIN_M)).cast("int").alias("total_bins"))


def part_lines(parts: DataFrame) -> DataFrame:
    """One row per planar line of a part and band of latitude, with the planar metres before it."""
    lats = F.transform("coords", lambda p: p["lat"])
    parts = parts.withColumn("_band", F.explode(bands_between(F.array_min(lats), F.array_max(lats), K.STREET_MATCH_M)))
    ref = band_latitude("_band")

    def project(p: Column) -> Column:
        ax, ay = planar_x(p["a"]["lon"], ref), planar_y(p["a"]["lat"])
        bx, by = planar_x(p["b"]["lon"], ref), planar_y(p["b"]["lat"])
        return F.struct(ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"),
                        F.hypot(bx - ax, by - ay).alias("len"))

    flat = parts.withColumn("_lines", F.transform(_pairs(), project))
    lines = flat.select(
        "segment_id", "street_id", "total_m", "total_bins", "_band",
        F.posexplode("_lines").alias("line_no", "l"),
        F.transform("_lines", lambda p: p["len"]).alias("_lens"))
    before = F.aggregate(F.slice("_lens", 1, F.col("line_no")), F.lit(0.0), lambda t, v: t + v)
    return lines.select(
        "segment_id", "street_id", "total_m", "total_bins", "_band", "line_no", "l.*",
        F.when(F.col("line_no") == 0, 0.0).otherwise(before).alias("start_m")).filter("len > 0")


# ---------------------------------------------------------------- coverage

def _in_shares(bucketed: DataFrame, crowded: DataFrame, share: Column) -> DataFrame:
    """Adds ``_salt``, the share of its bucket that a row belongs to; a bucket that is not ``crowded`` has one."""
    return bucketed.join(crowded, ["_band", "_bx", "_by"], "left").withColumn(
        "_shares", F.coalesce("_shares", F.lit(1))).withColumn("_salt", share).drop("_shares")


def street_coverage(
    route_lines: DataFrame, streets: DataFrame, keys: Sequence[str] = RECORDING, together: int = 100_000
) -> DataFrame:
    """Bins of street parts that each recording has walked.

    Every route line is sampled each 3 m; a sample counts for the nearest street line
    within 12 m and 50 degrees in either direction. Samples and street lines meet by
    20 m bucket. A busy square can hold a large share of all samples, so a bucket with more
    than ``together`` of them is dealt out in shares, and its short street list is repeated per
    share. The best line of a sample is found inside the join partition, without another shuffle.
    """
    keys = list(keys)
    dx, dy = planar_x(F.col("to_lon") - F.col("from_lon"), band_latitude(latitude_band("from_lat"))), planar_y(
        F.col("to_lat") - F.col("from_lat"))
    routes = route_lines.select(*keys, "step_no", "from_lat", "from_lon", "to_lat", "to_lon", F.hypot(dx, dy).alias("_len")).filter(
        F.col("_len") >= K.STREET_MIN_STEP_M)
    count = F.greatest(F.lit(1), F.ceil(F.col("_len") / K.STREET_SAMPLE_M).cast("int"))
    spread = routes.withColumn("_n", count).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    # A sample is placed by the scale of its own band of latitude.
    share = F.col("_i") / F.col("_n")
    banded = spread.withColumn("_band", latitude_band(F.col("from_lat") + (F.col("to_lat") - F.col("from_lat")) * share))
    ref = band_latitude("_band")
    planar = banded.withColumns({
        "_fx": planar_x("from_lon", ref), "_fy": planar_y("from_lat"),
        "_rx": planar_x("to_lon", ref) - planar_x("from_lon", ref), "_ry": planar_y("to_lat") - planar_y("from_lat")})
    size = F.hypot("_rx", "_ry")
    samples = planar.select(
        *keys, "step_no", "_i", "_band", (F.col("_rx") / size).alias("_ux"), (F.col("_ry") / size).alias("_uy"),
        (F.col("_fx") + F.col("_rx") * share).alias("_x"), (F.col("_fy") + F.col("_ry") * share).alias("_y"),
    ).select(
        "*", near_bucket("_x", K.STREET_BUCKET_M).alias("_bx"), near_bucket("_y", K.STREET_BUCKET_M).alias("_by"))
    # Read to count the buckets and again to match.
    samples = checkpointed(samples)
    crowded = checkpointed(samples.groupBy("_band", "_bx", "_by").agg(F.count(F.lit(1)).alias("_all")).filter(
        F.col("_all") > together).select("_band", "_bx", "_by", F.ceil(F.col("_all") / together).cast("int").alias("_shares")))
    samples = _in_shares(samples, crowded, F.pmod(F.xxhash64(*keys, "step_no"), F.col("_shares")).cast("int"))
    # A part is a small row, but gives many with its bands and buckets.
    lines = part_lines(dealt(measured_parts(streets), "segment_id"))
    pad = K.STREET_MATCH_M
    placed = lines.select(
        "*", F.explode(buckets_between(F.least("ax", "bx"), F.greatest("ax", "bx"), K.STREET_BUCKET_M, pad)).alias("_bx"),
    ).select(
        "*", F.explode(buckets_between(F.least("ay", "by"), F.greatest("ay", "by"), K.STREET_BUCKET_M, pad)).alias("_by"))
    placed = _in_shares(placed, crowded, F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    cosine = F.abs(F.col("_ux") * (F.col("bx") - F.col("ax")) / F.col("len")
                   + F.col("_uy") * (F.col("by") - F.col("ay")) / F.col("len"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    along = clamp01(((F.col("_x") - F.col("ax")) * dx + (F.col("_y") - F.col("ay")) * dy) / (dx * dx + dy * dy))
    met = (
        samples.join(placed, ["_band", "_bx", "_by", "_salt"])
        .filter(cosine >= math.cos(math.radians(K.STREET_MATCH_DEGREES)))
        .withColumn("_t", along)
        .withColumn("_d", F.hypot(F.col("_x") - (F.col("ax") + F.col("_t") * dx),
                                  F.col("_y") - (F.col("ay") + F.col("_t") * dy)))
        .filter(F.col("_d") <= K.STREET_MATCH_M)
    )
    bin_no = F.least(
        F.col("total_bins") - 1,
        F.floor((F.col("start_m") + F.col("_t") * F.col("len")) / F.greatest(F.lit(0.001), F.col("total_m"))
                * F.col("total_bins")).cast("int"))
    best = met.groupBy("_band", "_bx", "_by", "_salt", *keys, "step_no", "_i").agg(F.min(F.struct(
        F.round("_d", _TIE_DIGITS).alias("d"), "segment_id", "line_no", bin_no.alias("bin"), "street_id",
        "total_bins", "total_m")).alias("_m"))
    bins = best.select(*keys, "_m.segment_id", "_m.street_id", "_m.total_bins", "_m.total_m", "_m.bin").distinct()
    # At most total_bins numbers per group.
    return bins.groupBy(*keys, "segment_id", "street_id", "total_bins", "total_m").agg(
        F.array_sort(F.collect_list("bin")).alias("bins")
    ).withColumn("walked_m", _walked(F.size("bins")))


def _walked(bins: Column) -> Column:
    return F.least(F.col("total_m"), bins / F.col("total_bins") * F.col("total_m"))


def segment_progress(coverage: DataFrame, owner: Sequence[str] = ("owner_id",)) -> DataFrame:
    """Union of the bins over all recordings of an owner, for the parts they have touched."""
    bins = coverage.select(
        *owner, "segment_id", "street_id", "total_bins", "total_m", F.explode("bins").alias("bin")).distinct()
    merged = bins.groupBy(*owner, "segment_id", "street_id", "total_bins", "total_m").agg(
        F.count(F.lit(1)).alias("covered_bins"))
    walked = merged.withColumn("walked_m", _walked(F.col("covered_bins")))
    return walked.withColumn(
        "percent", F.least(F.lit(100.0), one_decimal_percent(F.col("walked_m") / F.col("total_m"))))


def street_totals(streets: DataFrame) -> DataFrame:
    return measured_parts(streets).groupBy("street_id").agg(
        F.sum("total_m").alias("total_m"), F.count(F.lit(1)).alias("parts"))


def street_states(progress: DataFrame, streets: DataFrame, owner: Sequence[str] = ("owner_id",)) -> DataFrame:
    """Per owner and street: walked metres against the whole street, complete from 90 percent on."""
    walked = progress.groupBy(*owner, "street_id").agg(F.sum("walked_m").alias("walked_m"))
    joined = walked.join(street_totals(streets).select("street_id", "total_m"), "street_id")
    return joined.select(
        *owner, "street_id", "walked_m", "total_m",
        ((F.col("total_m") > 0) & (F.col("walked_m") >= F.col("total_m") * K.STREET_DONE_SHARE)).alias("is_complete"))


def street_summary(states: DataFrame, streets: DataFrame, owner: Sequence[str] = ("owner_id",)) -> DataFrame:
    """Explored and completed streets per owner against everything loaded (one row of totals)."""
    loaded = street_totals(streets).agg(
        F.coalesce(F.sum("total_m"), F.lit(0.0)).alias("loaded_m"), F.count(F.lit(1)).alias("loaded_streets"))
    mine = states.groupBy(*owner).agg(
        F.sum("walked_m").alias("explored_m"), F.count_if(F.col("walked_m") > 0).alias("explored_streets"),
        F.count_if("is_complete").alias("completed_streets"))
    ratio = F.when(F.col("loaded_m") > 0, F.col("explored_m") / F.col("loaded_m")).otherwise(0.0)
    # ``loaded`` is the result of a global aggregate: exactly one row.
    return mine.join(F.broadcast(loaded), F.lit(True)).withColumn("percent", one_decimal_percent(ratio))


def with_completion_time(states: DataFrame, stored: DataFrame, as_of: Column,
                         owner: Sequence[str] = ("owner_id",)) -> DataFrame:
    """A completion time, once given, stays; streets completed now get ``as_of``."""
    before = stored.filter(F.col("completed_at").isNotNull()).groupBy(*owner, "street_id").agg(
        F.min("completed_at").alias("_was"))
    return states.join(before, [*owner, "street_id"], "left").select(
        *states.columns, F.coalesce("_was", F.when(F.col("is_complete"), as_of)).alias("completed_at"))


def legacy_matches(points: DataFrame, streets: DataFrame, owner: Sequence[str] = ("owner_id",)) -> DataFrame:
    """Legacy rule: one point within 12 m marks a whole part; every third point counts from 50 points on."""
    owner = list(owner)
    numbered = with_running(points, owner, ["ts"], F.to_date("ts"), index="_at")
    sizes = points.groupBy(*owner).agg(F.count(F.lit(1)).alias("_n"))
    used = numbered.join(sizes, owner).filter("_n < 50 OR _at % 3 = 0")
    pad = K.STREET_MATCH_M / K.METERS_PER_DEGREE
    size = 0.0005
    spots = used.select(*owner, "lat", "lon", near_bucket("lat", size).alias("_by"), near_bucket("lon", size).alias("_bx"))
    # At high latitudes a metre spans more degrees of longitude; pad by the wider end of the part.
    wide = pad / F.greatest(F.lit(1 / K.METERS_PER_DEGREE), F.cos(F.radians(F.least(
        F.lit(89.9), F.greatest(F.abs("min_lat"), F.abs("max_lat")) + pad))))
    parts = streets.filter(is_walkable() & (F.size("coords") >= 2)).select(
        F.col("id").alias("segment_id"), "min_lat", "max_lat", "min_lon", "max_lon", "coords",
        F.explode(buckets_between("min_lat", "max_lat", size, pad)).alias("_by"), wide.alias("_wide"),
    ).withColumn("_bx", F.explode(F.sequence(
        F.floor((F.col("min_lon") - F.col("_wide")) / size), F.floor((F.col("max_lon") + F.col("_wide")) / size))))
    to_part = F.array_min(F.transform(_pairs(), lambda p: line_distance(
        planar_x(F.col("lon"), F.col("lat")), planar_y("lat"),
        planar_x(p["a"]["lon"], F.col("lat")), planar_y(p["a"]["lat"]),
        planar_x(p["b"]["lon"], F.col("lat")), planar_y(p["b"]["lat"]))))
    return (
        spots.distinct().join(parts, ["_by", "_bx"])
        .filter(F.round(to_part, _TIE_DIGITS) <= K.STREET_MATCH_M)
        .select(*owner, "segment_id").distinct()
    )


# ---------------------------------------------------------------- streets in loops

def loop_street_lengths(groups: DataFrame, streets: DataFrame, walked: DataFrame, keys: Sequence[str],
                        owner: Sequence[str] = ("owner_id",)) -> DataFrame:
    """Walkable street metres inside each accepted group's box, all and not yet walked.

    A part lies inside if its vertex number n/2 does. Boxes and vertices meet by a grid of
    about 500 m; ``walked`` lists (owner, segment_id).
    """
    keys, owner = list(keys), list(owner)
    size = 0.005
    spots = streets.filter(counts_for_loops() & (F.size("coords") >= 1)).select(
        F.col("id").alias("segment_id"), part_length().alias("_len"),
        F.get("coords", F.floor(F.size("coords") / 2).cast("int")).alias("_v"),
    ).select("segment_id", "_len", F.col("_v.lat").alias("_lat"), F.col("_v.lon").alias("_lon"),
             near_bucket("_v.lat", size).alias("_by"), near_bucket("_v.lon", size).alias("_bx"))
    box = groups.filter("accepted").select(
        *keys, "min_lat", "max_lat", "min_lon", "max_lon",
        F.explode(buckets_between("min_lat", "max_lat", size, 0.0)).alias("_by"),
    ).withColumn("_bx", F.explode(buckets_between("min_lon", "max_lon", size, 0.0)))
    inside = box.join(spots, ["_by", "_bx"]).filter(
        "min_lat <= _lat AND _lat < max_lat AND min_lon <= _lon AND _lon < max_lon")
    seen = walked.select(*owner, "segment_id").distinct().withColumn("_seen", F.lit(True))
    sums = inside.join(seen, [*owner, "segment_id"], "left").groupBy(*keys).agg(
        F.sum("_len").alias("total_len_m"),
        F.sum(F.when(F.col("_seen").isNull(), F.col("_len")).otherwise(0.0)).alias("unwalked_len_m"))
    return groups.join(sums, keys, "left").fillna(0.0, ["total_len_m", "unwalked_len_m"])


def first_by_rank(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row per key; Spark cuts the window group limit below the shuffle."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(rank)).filter("_r = 1").drop("_r")
