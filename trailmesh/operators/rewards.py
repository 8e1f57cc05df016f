"""Landmark medals and daily district tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmesh import constants as K
from trailmesh.functions.geo import cell_key, cell_x, cell_y
from trailmesh.functions.text import fnv1a32, rotated_slice, street_of_part
from trailmesh.operators.grid import CELL
from trailmesh.operators.loops import GROUP, loop_groups
from trailmesh.operators.sessions import is_final
from trailmesh.operators.zones import cells_in_zones, parts_in_zones, points_in_zones


# ---------------------------------------------------------------- medals

def anchors(medals: DataFrame) -> DataFrame:
    """Medals with the cell they stand on."""
    return medals.select("*", cell_x("lon").alias("cell_x"), cell_y("lat").alias("cell_y"))


def enclosure_ids(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Identity of each accepted enclosure from its sorted cell keys (at most 666)."""
    names = F.array_join(F.array_sort(F.collect_list(cell_key("cell_x", "cell_y"))), "|")
    return members.groupBy(*keys, *GROUP).agg(
        F.count(F.lit(1)).alias("enclosure_cells"), names.alias("_names")
    ).select(
        *keys, *GROUP, (F.col("enclosure_cells") * K.CELL_AREA_M2).alias("enclosure_area_m2"),
        F.concat(F.lit("gameplay-loop-v2:"), F.lower(F.lpad(F.hex(fnv1a32(F.col("_names"))), 8, "0"))).alias("enclosure_id"))


def medal_candidates(cells: DataFrame, lengths: DataFrame, medals: DataFrame, keys: Sequence[str],
                     collected: DataFrame | None = None) -> DataFrame:
    """Medals whose anchor cell is enclosed, once per key, for keys that walked 80 m.

    Keys without a medal inside the box of their cells are dropped before the costly
    search for enclosures.
    """
    keys = list(keys)
    spots = anchors(medals).select("album_id", "medal_id", *CELL)
    long = lengths.groupBy(*keys).agg(F.sum(F.greatest("distance_m", F.lit(0.0))).alias("_m")).filter(
        F.col("_m") >= K.MIN_LOOP_M).select(*keys)
    box = cells.join(long, keys, "left_semi").groupBy(*keys).agg(
        F.min("cell_x").alias("_x0"), F.max("cell_x").alias("_x1"), F.min("cell_y").alias("_y0"), F.max("cell_y").alias("_y1"))
    tile = 64
    tiles = box.select("*", F.explode(F.sequence(F.floor(F.col("_x0") / tile), F.floor(F.col("_x1") / tile))).alias("_tx")) \
        .withColumn("_ty", F.explode(F.sequence(F.floor(F.col("_y0") / tile), F.floor(F.col("_y1") / tile))))
    placed = spots.select(*CELL, F.floor(F.col("cell_x") / tile).alias("_tx"), F.floor(F.col("cell_y") / tile).alias("_ty"))
    worth = tiles.join(placed, ["_tx", "_ty"]).filter(
        "cell_x BETWEEN _x0 AND _x1 AND cell_y BETWEEN _y0 AND _y1").select(*keys).distinct()
    _groups, members = loop_groups(cells.join(worth, keys, "left_semi"), keys)
    ids = enclosure_ids(members, keys)
    hits = members.join(spots, list(CELL)).join(ids, [*keys, *GROUP])
    # Contours are looked at before tolerant areas.
    first = F.struct((F.col("kind") != "contour").alias("late"), "enclosure_id", "enclosure_area_m2",
                     cell_key("cell_x", "cell_y").alias("anchor"))
    best = hits.groupBy(*keys, "album_id", "medal_id").agg(F.min(first).alias("_f"))
    if collected is not None:
        on = [k for k in ("owner_id", "album_id", "medal_id") if k in best.columns]
        best = best.join(collected.select(*on), on, "left_anti")
    return best.select(*keys, "album_id", "medal_id", F.col("_f.anchor").alias("anchor_cell"),
                       F.col("_f.enclosure_area_m2").alias("enclosure_area_m2"), F.col("_f.enclosure_id").alias("enclosure_id"))


def collect_medals(candidates: DataFrame, started: DataFrame, reason: str, acquired_at: Column) -> DataFrame:
    """One event per owner and medal; over several recordings the earliest one collects it."""
    dated = candidates.join(started, ["owner_id", "session_id"])
    first = F.struct("started_at", "session_id", "anchor_cell", "enclosure_area_m2", "enclosure_id")
    return dated.groupBy("owner_id", "album_id", "medal_id").agg(F.min(first).alias("_f")).select(
        "owner_id", "album_id", "medal_id", F.col("_f.session_id").alias("session_id"), F.lit(reason).alias("reason"),
        "_f.anchor_cell", "_f.enclosure_area_m2", "_f.enclosure_id", acquired_at.alias("acquired_at"),
        F.lit("pending").alias("presentation_state"))


def album_progress(medals: DataFrame, events: DataFrame, owners: DataFrame) -> DataFrame:
    """Every medal of the albums an owner has begun, with its collection event if there is one."""
    begun = owners.select("owner_id", "album_id").distinct()
    listed = begun.join(medals.select("album_id", "medal_id", "sort_order"), "album_id")
    return listed.join(
        events.select("owner_id", "album_id", "medal_id", "reason", "session_id", "acquired_at", "presentation_state"),
        ["owner_id", "album_id", "medal_id"], "left",
    ).withColumn("is_collected", F.col("acquired_at").isNotNull())


def album_counts(progress: DataFrame) -> DataFrame:
    return progress.groupBy("owner_id", "album_id").agg(
        F.count(F.lit(1)).alias("medals"), F.count_if("is_collected").alias("collected"),
        F.count_if(F.col("presentation_state") == "pending").alias("pending"))


def visible_events(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events without a recording, or whose recording is final."""
    final = sessions.filter(is_final()).select("owner_id", "session_id")
    return events.filter(F.col("session_id").isNull()).unionByName(
        events.filter(F.col("session_id").isNotNull()).join(final, ["owner_id", "session_id"], "left_semi")
        .select(*events.columns))


def medal_evidence(cells: DataFrame, points: DataFrame, lengths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct boundary cells, points and metres that medal checks rest on."""
    keys = list(keys)
    edge = cells.select(*keys, *CELL).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("boundary_cells"))
    spots = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"))
    metres = lengths.groupBy(*keys).agg(F.sum(F.greatest("distance_m", F.lit(0.0))).alias("walked_m"))
    return metres.join(spots, keys, "left").join(edge, keys, "left").fillna(0, ["points", "boundary_cells"])


# ---------------------------------------------------------------- daily district tasks

def daily_tasks(districts: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Three tasks per district and date, drawn from a hash of both.

    ``districts`` carry district_id, local_date, has_street and has_medal; ``carry`` names
    more columns to keep, such as the owner.
    """
    seed = fnv1a32(F.concat_ws(":", F.col("district_id"), F.date_format("local_date", "yyyy-MM-dd")))
    # Fixed values.
    targets = F.array(F.lit(15), F.lit(20), F.lit(25))
    kinds = F.array_compact(F.array(
        F.lit("close_loop"), F.when(F.col("has_street"), "complete_street"), F.when(F.col("has_medal"), "collect_medal")))
    drawn = districts.select(*carry, "district_id", "local_date", seed.alias("_seed"), kinds.alias("_kinds"))
    drawn = drawn.select("*", F.get(targets, (F.col("_seed") % 3).cast("int")).alias("_cells"),
                         (F.col("_seed") % F.size("_kinds")).cast("int").alias("_from"))
    picked = F.slice(rotated_slice(F.col("_kinds"), F.col("_from"), 2), 1, F.least(F.lit(2), F.size("_kinds")))

    def task(kind: Column, target: Column) -> Column:
        return F.struct(kind.alias("kind"), target.cast("int").alias("target"))

    explore = F.array(task(F.lit("explore_cells"), F.col("_cells")))
    chosen = F.transform(picked, lambda k: task(k, F.lit(1)))
    extra = F.array(task(F.lit("explore_cells"), F.col("_cells") + 15))
    tasks = F.slice(F.concat(explore, chosen, extra), 1, 3)
    return drawn.select(*carry, "district_id", "local_date", F.posexplode(tasks).alias("slot", "t")).select(
        *carry,
        F.concat_ws(":", F.lit("expedition"), "district_id", F.date_format("local_date", "yyyy-MM-dd"),
                    F.col("slot").cast("string")).alias("id"),
        "district_id", "local_date", "slot", "t.kind", "t.target")


def opportunities(districts: DataFrame, states: DataFrame, streets: DataFrame, medals: DataFrame,
                  events: DataFrame, owners: DataFrame) -> DataFrame:
    """Per owner and district: is a known street unfinished there, is a medal still to be had?

    ``owners`` lists the (owner_id, district_id) pairs that are asked for.
    """
    inside = parts_in_zones(streets, districts).select(
        street_of_part(F.col("segment_id")).alias("street_id"), F.col("zone_id").alias("district_id")).distinct()
    street = states.filter(~F.col("is_complete")).select("owner_id", "street_id").join(inside, "street_id").select(
        "owner_id", "district_id").distinct().withColumn("has_street", F.lit(True))
    placed = points_in_zones(medals, districts, ["album_id", "medal_id"]).withColumnRenamed("zone_id", "district_id")
    total = placed.groupBy("district_id").agg(F.count(F.lit(1)).alias("_all"))
    mine = events.select("owner_id", "album_id", "medal_id").distinct().join(placed, ["album_id", "medal_id"]).groupBy(
        "owner_id", "district_id").agg(F.count(F.lit(1)).alias("_got"))
    return (
        owners.select("owner_id", "district_id").distinct()
        .join(street, ["owner_id", "district_id"], "left").join(total, "district_id", "left")
        .join(mine, ["owner_id", "district_id"], "left")
        .select("owner_id", "district_id", F.coalesce("has_street", F.lit(False)).alias("has_street"),
                (F.coalesce("_all", F.lit(0)) > F.coalesce("_got", F.lit(0))).alias("has_medal")))


def task_progress(tasks: DataFrame, districts: DataFrame, cells: DataFrame, sessions: DataFrame, states: DataFrame,
                  streets: DataFrame, events: DataFrame, medals: DataFrame, evidence: DataFrame) -> DataFrame:
    """Progress of accepted tasks by kind, since each was accepted.

    Tasks are few per owner, so each fact table is first placed in its district and reduced
    to (owner, district, time), then compared with the tasks.
    """
    accepted = tasks.filter(F.col("accepted_at").isNotNull()).select("id", "owner_id", "district_id", "kind", "accepted_at")
    on = ["owner_id", "district_id"]
    # A cell is new since T if its earliest recording started at or after T; only final ones count as new.
    starts = sessions.select("owner_id", "session_id", "started_at", is_final().alias("_final"))
    first = cells.filter(F.col("session_id").isNotNull()).join(starts, ["owner_id", "session_id"]).groupBy(
        "owner_id", *CELL).agg(F.min("started_at").alias("_first"), F.max(F.when(F.col("_final"), F.col("started_at"))).alias("_last_final"))
    explored = cells_in_zones(first, districts).select("owner_id", F.col("zone_id").alias("district_id"), "_first", "_last_final")
    a = accepted.filter("kind = 'explore_cells'").join(explored, on).filter(
        "_first >= accepted_at AND _last_final >= accepted_at").groupBy("id").agg(F.count(F.lit(1)).alias("progress"))
    inside = parts_in_zones(streets, districts).select(
        street_of_part(F.col("segment_id")).alias("street_id"), F.col("zone_id").alias("district_id")).distinct()
    finished = states.filter(F.col("is_complete") & F.col("completed_at").isNotNull()).select(
        "owner_id", "street_id", "completed_at").join(inside, "street_id")
    b = accepted.filter("kind = 'complete_street'").join(finished, on).filter("completed_at >= accepted_at").groupBy(
        "id").agg(F.count(F.lit(1)).alias("progress"))
    placed = points_in_zones(medals, districts, ["album_id", "medal_id"]).withColumnRenamed("zone_id", "district_id")
    gained = events.select("owner_id", "album_id", "medal_id", "acquired_at").join(placed, ["album_id", "medal_id"])
    c = accepted.filter("kind = 'collect_medal'").join(gained, on).filter("acquired_at >= accepted_at").groupBy(
        "id").agg(F.count(F.lit(1)).alias("progress"))
    closed = final_evidence(evidence, sessions).groupBy("expedition_id").agg(F.count(F.lit(1)).alias("progress"))
    d = accepted.filter("kind = 'close_loop'").join(closed, F.col("id") == F.col("expedition_id")).select("id", "progress")
    measured = a.unionByName(b).unionByName(c).unionByName(d)
    return tasks.join(measured, "id", "left").withColumn("progress", F.coalesce("progress", F.lit(0)))


def final_evidence(evidence: DataFrame, sessions: DataFrame) -> DataFrame:
    final = sessions.filter(is_final()).select("owner_id", "session_id")
    return evidence.join(final, ["owner_id", "session_id"], "left_semi")


def complete_tasks(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Floors progress and sets the completion time once; abandoned and unaccepted tasks stay as they are."""
    live = F.col("accepted_at").isNotNull() & F.col("abandoned_at").isNull()
    floored = F.greatest(F.lit(0), F.floor("progress"))
    return tasks.withColumn("progress", F.when(live, floored).otherwise(F.col("progress"))).withColumn(
        "was_completed_at", F.col("completed_at")).withColumn(
        "completed_at", F.coalesce("completed_at", F.when(live & (F.col("progress") >= F.col("target")), as_of)))


def new_seals(tasks: DataFrame, stored: DataFrame) -> DataFrame:
    """A seal for each task completed for the first time."""
    earned = tasks.filter(F.col("completed_at").isNotNull() & F.col("was_completed_at").isNull()).select(
        F.concat(F.lit("seal:"), F.col("id")).alias("id"), F.col("id").alias("expedition_id"), "owner_id", "district_id",
        "local_date", "kind", F.col("completed_at").alias("earned_at"))
    return earned.join(stored.select("id"), "id", "left_anti")


def active_tasks(tasks: DataFrame) -> DataFrame:
    """The latest accepted open task of each owner."""
    is_open = F.col("accepted_at").isNotNull() & F.col("abandoned_at").isNull() & F.col("completed_at").isNull()
    best = tasks.filter(is_open).groupBy("owner_id").agg(F.max(F.struct("accepted_at", "id")).alias("_b"))
    return best.select("owner_id", F.col("_b.id").alias("id"), F.col("_b.accepted_at").alias("accepted_at"))


def loop_evidence(newly_enclosed: DataFrame, tasks: DataFrame, stored: DataFrame, detected_at: Column) -> DataFrame:
    """Evidence that a recording enclosed new cells in the district of the owner's open close-loop task.

    ``newly_enclosed`` are (owner_id, session_id, district_id).
    """
    is_open = (
        (F.col("kind") == "close_loop") & F.col("accepted_at").isNotNull()
        & F.col("abandoned_at").isNull() & F.col("completed_at").isNull())
    open_tasks = tasks.filter(is_open).select(F.col("id").alias("expedition_id"), "owner_id", "district_id")
    found = newly_enclosed.select("owner_id", "session_id", "district_id").distinct().join(open_tasks, ["owner_id", "district_id"])
    return found.select("expedition_id", "owner_id", "session_id", detected_at.alias("detected_at")).join(
        stored.select("expedition_id", "session_id"), ["expedition_id", "session_id"], "left_anti")
