"""Zones: rows of cells inside a polygon, point in polygon, completion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmesh import constants as K
from trailmesh.functions.geo import (
    cell_centre_lat, cell_centre_lon, cell_x, cell_y, crosses_ray, haversine_m, mercator_x, near_bucket,
    one_decimal_percent,
)
from trailmesh.functions.text import fnv1a32, plain_number
from trailmesh.operators.grid import CELL
from trailmesh.operators.nearest import near_places
from trailmesh.operators.regions import TILE, cut_at_tiles
from trailmesh.operators.sets import changed_keys, upsert

EXACT_SOURCE = "openstreetmap"
OFFICIAL_LEVEL = 9


def is_official_district() -> Column:
    return (F.col("type") == "district") & F.coalesce(F.col("admin_level") == OFFICIAL_LEVEL, F.lit(False))


def is_eligible() -> Column:
    return (F.col("source") == EXACT_SOURCE) & ((F.col("type") != "district") | is_official_district())


def selectable(zones: DataFrame, zone_type: str) -> DataFrame:
    """Zones of one kind for the lists: of the districts only official ones, by name."""
    return zones.filter((F.col("type") == zone_type) & ((F.col("type") != "district") | is_official_district())).orderBy("name")


def fingerprint() -> Column:
    """Hash of the geometry text; equal for equal rings and holes."""
    def point(p: Column) -> Column:
        return F.concat(F.lit('{"latitude":'), plain_number(p["lat"]), F.lit(',"longitude":'), plain_number(p["lon"]), F.lit("}"))

    def listed(items: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))

    def written(rings: str) -> Column:
        return listed(F.transform(rings, lambda r: listed(F.transform(r, point))))

    text = F.concat(F.lit('{"holes":'), written("holes"), F.lit(',"outer":'), written("rings"), F.lit("}"))
    return F.concat(F.lit("fnv1a:"), F.lower(F.lpad(F.hex(fnv1a32(text)), 8, "0")))


def zone_bounds(zones: DataFrame) -> DataFrame:
    points = F.flatten("rings")
    lats, lons = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
    return zones.select(
        F.col("id").alias("zone_id"), F.array_min(lats).alias("min_lat"), F.array_max(lats).alias("max_lat"),
        F.array_min(lons).alias("min_lon"), F.array_max(lons).alias("max_lon"))


def zone_edges(zones: DataFrame) -> DataFrame:
    """One row per edge of every ring; role 1 is a hole."""
    both = zones.select(F.col("id").alias("zone_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("role"), F.col("rings").alias("r")),
        F.struct(F.lit(1).alias("role"), F.col("holes").alias("r")))).alias("s"))
    rings = both.select("zone_id", "s.role", F.posexplode("s.r").alias("ring_no", "ring"))
    edge = F.transform(
        F.sequence(F.lit(0), F.size("ring") - 1),
        lambda i: F.struct(F.get("ring", i).alias("b"), F.get("ring", F.pmod(i - 1, F.size("ring"))).alias("a")))
    edges = rings.filter(F.size("ring") > 0).select("zone_id", "role", "ring_no", F.explode(edge).alias("e"))
    return edges.select(
        "zone_id", "role", "ring_no", F.col("e.a.lat").alias("a_lat"), F.col("e.a.lon").alias("a_lon"),
        F.col("e.b.lat").alias("b_lat"), F.col("e.b.lon").alias("b_lon"))


def zone_spans(zones: DataFrame) -> DataFrame:
    """Disjoint runs (zone_id, y, x0, x1) of the cells whose centre lies inside a zone.

    Scan lines: each edge gives its crossing with every row of cell centres it spans; the
    sorted crossings of a ring pair up into intervals, and the intervals of all outer rings
    and holes of a row are swept once. No cell is enumerated.
    """
    edges = zone_edges(zones).filter("a_lat <> b_lat")
    low, high = F.least("a_lat", "b_lat"), F.greatest("a_lat", "b_lat")
    rows = edges.withColumn("y", F.explode(F.sequence(cell_y(low) - 1, cell_y(high) + 1)))
    lat = cell_centre_lat("y")
    at = (F.col("a_lon") - F.col("b_lon")) * (lat - F.col("b_lat")) / (F.col("a_lat") - F.col("b_lat")) + F.col("b_lon")
    crossings = rows.filter((F.col("b_lat") > lat) != (F.col("a_lat") > lat)).select(
        "zone_id", "role", "ring_no", "y", at.alias("_lon"))
    # First cell whose centre is not left of the crossing, settled by the exact comparison.
    guess = F.ceil(mercator_x("_lon") / K.CELL_M - 0.5).cast("int")
    first = (F.when(cell_centre_lon(guess - 1) >= F.col("_lon"), guess - 1)
             .when(cell_centre_lon(guess) >= F.col("_lon"), guess).otherwise(guess + 1))
    along = Window.partitionBy("zone_id", "role", "ring_no", "y").orderBy("_lon")
    events = crossings.select(
        "zone_id", "role", "y", first.alias("x"),
        F.when(F.row_number().over(along) % 2 == 1, 1).otherwise(-1).alias("_step"))
    merged = events.groupBy("zone_id", "y", "x").agg(
        F.sum(F.when(F.col("role") == 0, F.col("_step")).otherwise(0)).alias("_outer"),
        F.sum(F.when(F.col("role") == 1, F.col("_step")).otherwise(0)).alias("_hole"))
    sweep = Window.partitionBy("zone_id", "y").orderBy("x")
    upto = sweep.rowsBetween(Window.unboundedPreceding, 0)
    return merged.select(
        "zone_id", "y", F.col("x").alias("x0"), (F.lead("x").over(sweep) - 1).alias("x1"),
        (F.sum("_outer").over(upto) > 0).alias("_in"), (F.sum("_hole").over(upto) > 0).alias("_out"),
    ).filter("_in AND NOT _out AND x1 >= x0").select("zone_id", "y", "x0", "x1")


def zone_totals(zones: DataFrame) -> DataFrame:
    """Cells inside each zone of any size: sums of runs, so that no cell is enumerated."""
    box = zone_bounds(zones)
    area = ((cell_x("max_lon") - cell_x("min_lon") + 1).cast("long") * (cell_y("max_lat") - cell_y("min_lat") + 1))
    sized = box.select("zone_id", area.alias("box_cells")).filter(F.col("box_cells").isNotNull())
    sums = zone_spans(zones).groupBy("zone_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_n"))
    return sized.join(sums, "zone_id", "left").select(
        "zone_id", "box_cells", F.coalesce("_n", F.lit(0)).cast("long").alias("total_cells"))


def stored_totals(zones: DataFrame, totals: DataFrame) -> DataFrame:
    """Totals as they are kept: with the cell size and the fingerprint of the geometry they were counted for."""
    stamps = zones.select(F.col("id").alias("zone_id"), F.lit(K.CELL_M).alias("cell_size_m"),
                          fingerprint().alias("geometry_fingerprint"))
    return stamps.join(totals.select("zone_id", "total_cells"), "zone_id")


def refreshed_totals(zones: DataFrame, stored: DataFrame) -> DataFrame:
    """(zone_id, cell_size_m, geometry_fingerprint, total_cells, reused) for every zone with a ring.

    Stored totals of the same cell size and fingerprint are taken over. Only zones without one are cut
    into edges and counted; rows of the store whose zone is gone or has another shape fall away.
    Rows that repeat a zone in the store count once, the largest total.
    """
    keys = ["zone_id", "cell_size_m", "geometry_fingerprint"]
    current = zones.select("*", F.col("id").alias("zone_id"), F.lit(K.CELL_M).alias("cell_size_m"),
                           fingerprint().alias("geometry_fingerprint"))
    known = stored.groupBy(*keys).agg(F.max("total_cells").alias("total_cells")).filter(F.col("total_cells").isNotNull())
    reused = known.join(current.select(*keys), keys, "left_semi")
    missing = current.join(known.select(*keys), keys, "left_anti").select(*zones.columns)
    counted = stored_totals(missing, zone_totals(missing))
    columns = [*keys, F.col("total_cells").cast("long").alias("total_cells")]
    return reused.select(*columns, F.lit(True).alias("reused")).unionByName(
        counted.select(*columns, F.lit(False).alias("reused")))


def cells_in_zones(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """Cells with every zone that holds their centre: an equi-join on grid row and tile."""
    spans = cut_at_tiles(zone_spans(zones)).select("zone_id", F.col("y").alias("cell_y"), "tx", "x0", "x1")
    placed = cells.withColumn("tx", F.floor(F.col("cell_x") / TILE).cast("int"))
    return placed.join(spans, ["cell_y", "tx"]).filter("cell_x BETWEEN x0 AND x1").select(
        *[placed[c] for c in cells.columns], "zone_id")


def points_in_zones(points: DataFrame, zones: DataFrame, point_id: Sequence[str], degrees: float = 0.02) -> DataFrame:
    """(point_id..., zone_id) for points inside zones, by counting crossings with the edges.

    Points meet zones by tiles of the zone boxes, then only the edges of those zones in the
    latitude band of the point.
    """
    ids = list(point_id)
    box = zone_bounds(zones)
    tiles = box.select(
        "*", F.explode(F.sequence(near_bucket("min_lat", degrees), near_bucket("max_lat", degrees))).alias("_ty"),
    ).withColumn("_tx", F.explode(F.sequence(near_bucket("min_lon", degrees), near_bucket("max_lon", degrees))))
    spots = points.select(*ids, "lat", "lon").distinct().select(
        "*", near_bucket("lat", degrees).alias("_ty"), near_bucket("lon", degrees).alias("_tx"))
    near = spots.join(tiles, ["_ty", "_tx"]).filter(
        "lat BETWEEN min_lat AND max_lat AND lon BETWEEN min_lon AND max_lon").select(*ids, "lat", "lon", "zone_id", "_ty")
    banded = zone_edges(zones).filter("a_lat <> b_lat").withColumnsRenamed(
        {"role": "_role", "ring_no": "_ring"}).withColumn("_ty", F.explode(F.sequence(
        near_bucket(F.least("a_lat", "b_lat"), degrees), near_bucket(F.greatest("a_lat", "b_lat"), degrees))))
    hits = near.join(banded, ["zone_id", "_ty"]).filter(
        crosses_ray("lat", "lon", "b_lat", "b_lon", "a_lat", "a_lon"))
    odd = hits.groupBy(*ids, "zone_id", "_role", "_ring").agg(F.count(F.lit(1)).alias("_n")).filter("_n % 2 = 1")
    return odd.groupBy(*ids, "zone_id").agg(F.max("_role").alias("_hole"), F.min("_role").alias("_outer")).filter(
        "_outer = 0 AND _hole = 0").select(*ids, "zone_id")


# ---------------------------------------------------------------- completion

def zone_completion(cells: DataFrame, zones: DataFrame, achievements: DataFrame,
                    owner: Sequence[str] = ("owner_id",), asked: DataFrame | None = None) -> DataFrame:
    """Completion per owner and zone from completion cells (with source).

    ``asked`` names the pairs of owner and zone to report; a zone without an explored cell
    is at 0 percent. Without it, the zones in which an owner has cells are reported.
    """
    owner = list(owner)
    flags = ("gps", "inferred", "loop_fill")
    per_cell = cells.groupBy(*owner, *CELL).agg(*[
        F.max(F.when(F.col("source") == s, 1).otherwise(0)).alias(s) for s in flags])
    counted = cells_in_zones(per_cell, zones).groupBy(*owner, "zone_id").agg(
        F.count(F.lit(1)).alias("explored_cells"), F.sum("gps").alias("walked_cells"),
        F.sum("inferred").alias("inferred_cells"), F.sum("loop_fill").alias("loop_cells"))
    if asked is not None:
        counted = asked.select(*owner, "zone_id").distinct().join(counted, [*owner, "zone_id"], "left").na.fill(
            0, ["explored_cells", "walked_cells", "inferred_cells", "loop_cells"])
    facts = zones.select(F.col("id").alias("zone_id"), is_eligible().alias("_eligible"), fingerprint().alias("fingerprint"))
    totals = zone_totals(zones.filter(is_eligible())).select("zone_id", "total_cells")
    ratio = F.col("explored_cells") / F.col("total_cells")
    percent = F.when(F.col("total_cells") > 0, F.least(F.lit(100.0), one_decimal_percent(ratio)))
    done = achievements.select(*owner, "zone_id", F.col("completed_at").alias("_done"))
    return (
        counted.join(facts, "zone_id").join(totals, "zone_id", "left")
        .join(done, [*owner, "zone_id"], "left")
        .select(
            *owner, "zone_id", "explored_cells", "walked_cells", "inferred_cells", "loop_cells", "total_cells",
            percent.alias("percent"),
            F.when(F.col("_eligible") & F.col("total_cells").isNotNull(), "available")
            .otherwise("invalid_boundary").alias("status"),
            F.col("_done").isNotNull().alias("permanently_completed"), "fingerprint")
    )


def new_achievements(completion: DataFrame, achievements: DataFrame, as_of: Column,
                     owner: Sequence[str] = ("owner_id",)) -> DataFrame:
    """Zones complete for the first time; a stored achievement is never withdrawn."""
    full = completion.filter((F.col("percent") >= 100) & (F.col("total_cells") > 0))
    return full.join(achievements.select(*owner, "zone_id"), [*owner, "zone_id"], "left_anti").select(
        *owner, "zone_id", "explored_cells", "total_cells", "fingerprint", as_of.alias("completed_at"))


def achievement_rollup(achievements: DataFrame, zones: DataFrame, owner: Sequence[str] = ("owner_id",)) -> DataFrame:
    """Achieved zones per kind; districts count only while they are official."""
    levels = zones.select(F.col("id").alias("zone_id"), "admin_level")
    kept = achievements.join(levels, "zone_id", "left").filter(
        (F.col("zone_type") == "city") | ((F.col("zone_type") == "district") & (F.col("admin_level") == OFFICIAL_LEVEL)))
    return kept.groupBy(*owner, "zone_type").agg(F.count(F.lit(1)).alias("zones"))


def progress_delta(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("owner_id", "zone_id")) -> DataFrame:
    """Change of cells and percent between two runs, and the cells still missing."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(*keys, F.col("explored_cells").alias(f"{p}_cells"), F.col("percent").alias(f"{p}_percent"),
                         F.col("total_cells").alias(f"{p}_total"), F.col("permanently_completed").alias(f"{p}_done"))

    both = side(before, "b").join(side(after, "a"), list(keys), "full")
    return both.select(
        *keys,
        (F.coalesce("a_cells", F.lit(0)) - F.coalesce("b_cells", F.lit(0))).alias("cells"),
        (F.floor((F.col("a_percent") - F.col("b_percent")) * 10 + 0.5) / 10).alias("percent"),
        F.when(F.coalesce("a_done", F.lit(False)), F.lit(0)).when(
            F.col("a_total").isNotNull(),
            F.greatest(F.lit(0), F.col("a_total") - F.col("a_cells"))).alias("remaining_cells"))


# ---------------------------------------------------------------- hierarchy and location

def _ring_holds(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd test against a ring held in the same row."""
    n = F.size(ring)
    crossings = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0),
        lambda t, i: t + F.when(crosses_ray(
            lat, lon, F.get(ring, i)["lat"], F.get(ring, i)["lon"],
            F.get(ring, F.pmod(i - 1, n))["lat"], F.get(ring, F.pmod(i - 1, n))["lon"]), 1).otherwise(0))
    return crossings % 2 == 1


def district_parents(zones: DataFrame, order: str = "id") -> DataFrame:
    """Districts with the first exact city that holds 9x9 interior samples of all their rings."""
    districts = zones.filter("type = 'district'")
    cities = zones.filter((F.col("type") == "city") & is_eligible())
    rings = districts.select(F.col("id").alias("district_id"), "holes", F.posexplode("rings").alias("ring_no", "ring"))
    lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    boxed = rings.select("*", F.array_min(lats).alias("_s"), F.array_max(lats).alias("_n"),
                         F.array_min(lons).alias("_w"), F.array_max(lons).alias("_e"))
    spots = boxed.withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(80)))).select(
        "district_id", "ring_no", "sample_no", "ring", "holes",
        (F.col("_s") + (F.floor(F.col("sample_no") / 9) + 0.5) / 9 * (F.col("_n") - F.col("_s"))).alias("lat"),
        (F.col("_w") + (F.col("sample_no") % 9 + 0.5) / 9 * (F.col("_e") - F.col("_w"))).alias("lon"))
    inside = spots.filter(
        _ring_holds(F.col("lat"), F.col("lon"), F.col("ring"))
        & ~F.exists("holes", lambda h: _ring_holds(F.col("lat"), F.col("lon"), h))
    ).select("district_id", "ring_no", "sample_no", "lat", "lon")
    wanted = rings.groupBy("district_id").agg(F.countDistinct("ring_no").alias("_rings"))
    have = inside.groupBy("district_id").agg(
        F.count(F.lit(1)).alias("_samples"), F.countDistinct("ring_no").alias("_sampled")).join(wanted, "district_id")
    held = points_in_zones(inside, cities, ["district_id", "ring_no", "sample_no"]).groupBy("district_id", "zone_id").agg(
        F.count(F.lit(1)).alias("_held"))
    parents = held.join(have.filter("_sampled = _rings"), "district_id").filter("_held = _samples").join(
        cities.select(F.col("id").alias("zone_id"), F.col(order).alias("_order")), "zone_id"
    ).groupBy("district_id").agg(F.min_by("zone_id", "_order").alias("_parent"))
    return zones.join(parents.withColumnRenamed("district_id", "id"), "id", "left").select(
        *[F.coalesce("_parent", "parent_zone_id").alias("parent_zone_id") if c == "parent_zone_id" else zones[c]
          for c in zones.columns])


def zone_centres(zones: DataFrame) -> DataFrame:
    """Mean vertex of all outer rings."""
    points = F.flatten("rings")

    def mean(field: str) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda t, p: t + p[field]) / F.size(points)

    return zones.filter(F.size(points) > 0).select(
        F.col("id").alias("zone_id"), mean("lat").alias("c_lat"), mean("lon").alias("c_lon"))


def _first_by_distance(held: DataFrame, near: DataFrame, ids: list[str]) -> DataFrame:
    """Per point the zone that holds it (rank 0), otherwise the nearest one (rank 1); ties go to the smaller id."""
    within = held.select(*ids, "zone_id", F.lit(0).alias("rank"), F.lit(0.0).alias("distance_m"))
    beside = near.select(*ids, "zone_id", F.lit(1).alias("rank"), "distance_m")
    best = within.unionByName(beside).groupBy(*ids).agg(F.min(F.struct("rank", "distance_m", "zone_id")).alias("_b"))
    return best.select(*ids, "_b.zone_id", "_b.rank", "_b.distance_m")


def best_zone(points: DataFrame, zones: DataFrame, point_id: Sequence[str]) -> DataFrame:
    """The zone that holds each point, otherwise the one with the nearest centre."""
    ids = list(point_id)
    held = points_in_zones(points, zones, ids)
    open_points = points.select(*ids, "lat", "lon").distinct().join(held.select(*ids), ids, "left_anti")
    centres = zone_centres(zones).withColumnsRenamed({"c_lat": "lat", "c_lon": "lon"})
    return _first_by_distance(held, near_places(open_points, centres, ids, "zone_id"), ids)


def next_zone(points: DataFrame, zones: DataFrame, passed_over: DataFrame, point_id: Sequence[str]) -> DataFrame:
    """The eligible zone to go for next: the one that holds the point, otherwise the nearest.

    ``passed_over`` has rows (point_id, zone_id) of zones not to be named: completed for good, or
    the one already selected. A point with every zone passed over has no row. Points repeat no id.
    """
    ids = list(point_id)
    spots, passed = points.select(*ids, "lat", "lon"), passed_over.select(*ids, "zone_id").distinct()
    offered = zones.filter(is_eligible())
    held = points_in_zones(spots, offered, ids).join(passed, [*ids, "zone_id"], "left_anti")
    # With as many zones more than are passed over, one of them is left.
    wanted = passed.groupBy(*ids).agg((F.count(F.lit(1)) + 1).alias("_wanted"))
    open_points = spots.join(held.select(*ids), ids, "left_anti").join(wanted, ids, "left").withColumn(
        "_wanted", F.coalesce("_wanted", F.lit(1)))
    centres = zone_centres(offered).withColumnsRenamed({"c_lat": "lat", "c_lon": "lon"})
    near = near_places(open_points, centres, ids, "zone_id", "_wanted").join(passed, [*ids, "zone_id"], "left_anti")
    return _first_by_distance(held, near, ids)


def merge_zones(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Upsert of zones: an exact polygon is never replaced by a fallback, otherwise the arrived one counts."""
    return upsert(stored, arrived, ["id"], [F.col("source") == EXACT_SOURCE])


def replace_zones(stored: DataFrame, arrived: DataFrame,
                  *dependents: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """The zones after ``merge_zones``, and each dependent table (keyed by zone_id) without rows of other shapes.

    What was computed for a zone goes only if an accepted arrival has another geometry; a refused fallback, a
    new name and zones that did not arrive leave it as it is.
    """
    merged = merge_zones(stored, arrived)
    touched = arrived.select("id")
    before = stored.join(touched, "id", "left_semi").select("id", fingerprint().alias("shape"))
    after = merged.join(touched, "id", "left_semi").select("id", fingerprint().alias("shape"))
    changed = changed_keys(before, after, "id", "shape").withColumnRenamed("id", "zone_id")
    return merged, tuple(d.join(changed, "zone_id", "left_anti").select(*d.columns) for d in dependents)


def parts_in_zones(parts: DataFrame, zones: DataFrame) -> DataFrame:
    """Street parts with a vertex inside a zone."""
    vertices = parts.select(F.col("id").alias("segment_id"), F.posexplode("coords").alias("vertex_no", "v")).select(
        "segment_id", "vertex_no", F.col("v.lat").alias("lat"), F.col("v.lon").alias("lon"))
    return points_in_zones(vertices, zones, ["segment_id", "vertex_no"]).select("segment_id", "zone_id").distinct()
