"""Roll-ups per owner and recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmesh import constants as K
from trailmesh.operators.clean import RECORDING
from trailmesh.operators.grid import CELL
from trailmesh.operators.loops import fillable_cells
from trailmesh.operators.sessions import is_final, local_day

# Reference areas in square metres, ascending.
AREA_LADDER = [
    ("tennis-court", 261), ("basketball-court", 420), ("olympic-pool", 1250), ("ice-rink", 1800),
    ("football-pitch", 7140), ("trafalgar-square", 9200), ("plaza-mayor", 9400), ("piazza-san-marco", 14350),
    ("bryant-park", 39000), ("liberty-island", 59500), ("alcatraz", 85000), ("ellis-island", 111300),
    ("boston-common", 200000), ("ile-de-la-cite", 225000), ("luxembourg-garden", 230000),
    ("vatican-gardens", 231000), ("vatican-city", 490000), ("ueno-park", 538000), ("retiro-park", 1180000),
    ("hyde-park", 1377200), ("ibirapuera-park", 1580000), ("monaco", 2080000), ("tiergarten", 2100000),
    ("central-park", 3411500), ("english-garden", 3750000), ("stanley-park", 4040000),
    ("golden-gate-park", 4120000), ("phoenix-park", 7070000), ("capri", 10400000), ("nauru", 21000000),
    ("bora-bora", 30550000), ("san-marino", 61200000), ("santorini", 79194000), ("hong-kong-island", 80400000),
    ("manhattan", 87000000), ("easter-island", 164000000), ("malta", 316000000), ("andorra", 468000000),
    ("lake-tahoe", 490000000), ("lake-geneva", 580030000), ("dead-sea", 605000000), ("singapore", 735700000),
    ("new-york-city-land", 778200000), ("berlin", 891800000), ("hong-kong", 1114000000),
    ("greater-london", 1572000000), ("tokyo-metropolis", 2194000000), ("luxembourg", 2586000000),
    ("rhode-island", 4001000000), ("grand-canyon-national-park", 4862893000), ("bali", 5780000000),
    ("yellowstone", 8983490000), ("cyprus", 9251000000), ("jamaica", 10991000000), ("qatar", 11581000000),
]


def lifetime(recordings: DataFrame, cells: DataFrame, as_of: Column, tz: str = "UTC") -> DataFrame:
    """Per owner: totals, latest and longest recording, today's share, explored area.

    ``recordings`` are final and carry distance_m, duration_s and step_count.
    """
    low, high = local_day(as_of, tz)
    today = (F.col("started_at") >= low) & (F.col("started_at") < high)
    rolled = recordings.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("recordings"),
        F.sum("distance_m").alias("distance_m"),
        F.sum("duration_s").alias("duration_s"),
        F.max("started_at").alias("latest_started_at"),
        F.max_by("distance_m", F.struct("started_at", "session_id")).alias("latest_distance_m"),
        F.max("distance_m").alias("longest_distance_m"),
        F.sum(F.when(today, F.col("distance_m")).otherwise(0.0)).alias("today_distance_m"),
        F.count_if(today).alias("today_recordings"),
        F.sum(F.when(today, F.col("step_count")).otherwise(0)).alias("today_steps"),
    )
    explored = cells.select("owner_id", *CELL).distinct().groupBy("owner_id").agg(F.count(F.lit(1)).alias("cells"))
    explored_cells = F.coalesce("cells", F.lit(0))
    return rolled.join(explored, "owner_id", "left").select(
        *rolled.columns, explored_cells.alias("explored_cells"), (explored_cells * K.CELL_AREA_M2).alias("area_m2"))


def recent_distance(recordings: DataFrame, as_of: Column, days: int) -> DataFrame:
    recent = F.col("started_at") >= as_of - F.make_interval(days=F.lit(days))
    return recordings.groupBy("owner_id").agg(
        F.sum(F.when(recent, F.col("distance_m")).otherwise(0.0)).alias("recent_distance_m"))


def history(recordings: DataFrame, points: DataFrame) -> DataFrame:
    """Final recordings with their point count, newest first within an owner."""
    counts = points.groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("point_count"))
    return recordings.join(counts, list(RECORDING), "left").fillna(0, ["point_count"]).orderBy(
        "owner_id", F.desc("started_at"))


def completion_stats(cells: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct cells by source and overall; counts final recordings even if about to be discarded."""
    # First one row per cell with the sources it has, then plain counts: one shuffle by cell, no expand.
    by_cell = cells.groupBy("owner_id", *CELL).agg(*[
        F.max(F.when(F.col("source") == s, 1).otherwise(0)).alias(s) for s in ("gps", "inferred", "loop_fill")])
    counted = by_cell.groupBy("owner_id").agg(
        F.sum("gps").alias("gps_cells"), F.sum("inferred").alias("inferred_cells"),
        F.sum("loop_fill").alias("loop_fill_cells"), F.count(F.lit(1)).alias("cells"))
    walked = sessions.filter(is_final()).groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("recordings"), F.sum("distance_m").alias("distance_m"))
    return counted.join(walked, "owner_id", "full")


def loop_summaries(loop_fills: DataFrame, cells: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Loops per recording; the two sides are aggregated before they meet."""
    keys = list(keys)
    loops = loop_fills.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("loops"), F.count_if("accepted").alias("accepted_loops"),
        F.count_if(~F.col("accepted")).alias("rejected_loops"), F.max("area_m2").alias("area_m2"),
        F.sum("total_len_m").alias("total_len_m"), F.sum("unwalked_len_m").alias("unwalked_len_m"),
        F.array_join(F.array_sort(F.collect_set("rejection_reason")), ",").alias("rejection_reasons"),
    )
    filled = cells.filter("source = 'loop_fill'").select(*keys, *CELL).distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("filled_cells"))
    return loops.join(filled, keys, "left").fillna(0, ["filled_cells"])


def explorer_score(walked: DataFrame, stored_fills: DataFrame, keys: Sequence[str] = ("owner_id",)) -> DataFrame:
    """Points: one per discovered cell and one more per enclosed cell."""
    on = [*keys, *CELL]
    fills = stored_fills.select(*on).distinct()
    alone = walked.select(*on).distinct().join(fills, on, "left_anti")
    derived = fillable_cells(alone.unionByName(fills), keys).select(*on)
    enclosed = fills.unionByName(derived).distinct()
    tagged = alone.withColumn("_w", F.lit(1)).unionByName(enclosed.withColumn("_w", F.lit(0)))
    return tagged.groupBy(*keys).agg(
        F.sum("_w").alias("walked_cells"), F.sum(1 - F.col("_w")).alias("enclosed_cells"),
        F.count(F.lit(1)).alias("discovered_cells"),
    ).select(
        *keys, "walked_cells", "enclosed_cells", "discovered_cells",
        (F.col("discovered_cells") + F.col("enclosed_cells")).alias("points"),
        (F.col("discovered_cells") * K.CELL_AREA_M2).alias("area_m2"))


def area_progress(areas: DataFrame, area: str = "area_m2") -> DataFrame:
    """The largest reference area reached and the next one, from the fixed ladder of 55 rows."""
    ladder = F.array(*[F.struct(F.lit(m).cast("double").alias("area"), F.lit(i).alias("id")) for i, m in AREA_LADDER])
    have = F.greatest(F.lit(0.0), F.col(area).cast("double"))
    reached = F.filter(ladder, lambda s: s["area"] <= have)
    ahead = F.filter(ladder, lambda s: s["area"] > have)
    now, nxt = F.get(reached, F.size(reached) - 1), F.get(ahead, F.lit(0))
    return areas.select(
        "*", now["id"].alias("current_id"),
        F.coalesce(have / now["area"], F.lit(0.0)).alias("current_multiple"),
        nxt["id"].alias("next_id"),
        F.coalesce(F.least(F.lit(1.0), have / nxt["area"]), F.lit(1.0)).alias("next_progress"))


def new_cells_since(cells: DataFrame, sessions: DataFrame, since: Column, before: Column | None = None,
                    keys: Sequence[str] = ("owner_id",), final_only: bool = True) -> DataFrame:
    """Cells first walked in recordings that started at or after ``since`` (and before ``before``).

    One aggregate per cell replaces the anti-join of the table with itself.
    """
    starts = sessions.select(*RECORDING, "started_at", is_final().alias("_final"))
    dated = cells.filter(F.col("session_id").isNotNull()).join(starts, list(RECORDING))
    current = F.col("started_at") >= since
    if before is not None:
        current = current & (F.col("started_at") < before)
    if final_only:
        current = current & F.col("_final")
    return dated.groupBy(*keys, *CELL).agg(
        F.bool_or(current).alias("_now"), F.bool_or(F.col("started_at") < since).alias("_then")
    ).filter("_now AND NOT _then").select(*keys, *CELL)


def revision(changelog: DataFrame) -> DataFrame:
    """Change counter per owner: the number of change rows appended so far."""
    return changelog.groupBy("owner_id").agg(F.count(F.lit(1)).alias("revision"))
