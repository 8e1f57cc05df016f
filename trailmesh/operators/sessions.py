"""Recordings: predicates, scopes, assignment of fixes, life cycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmesh import constants as K
from trailmesh.operators.clean import RECORDING
from trailmesh.operators.paths import last_points, last_speeds, path_lengths
from trailmesh.session import epoch_seconds

DAY = 86400


def is_final() -> Column:
    """Equal start and end mark a recording that is still running."""
    return F.col("ended_at") > F.col("started_at")


def finalized(sessions: DataFrame, discards: DataFrame | None = None) -> DataFrame:
    """Finished recordings without a pending discard."""
    final = sessions.filter(is_final())
    return final if discards is None else final.join(discards.select(*RECORDING), list(RECORDING), "left_anti")


def scope_since(sessions: DataFrame, start: Column) -> DataFrame:
    return sessions.filter(F.col("started_at") >= start)


def scope_overlap(sessions: DataFrame, low: Column, high: Column) -> DataFrame:
    """Recordings that overlap [low, high): ended after low and started before high."""
    return sessions.filter((F.col("ended_at") > low) & (F.col("started_at") < high))


def local_day(as_of: Column, tz: str) -> tuple[Column, Column]:
    """First instants of the local day of ``as_of`` and of the next one."""
    day = F.date_trunc("day", F.from_utc_timestamp(as_of, tz))
    return F.to_utc_timestamp(day, tz), F.to_utc_timestamp(day + F.expr("INTERVAL 1 DAY"), tz)


def display_scope(sessions: DataFrame, mode: str, as_of: Column, tz: str = "UTC",
                  selected: int | None = None) -> DataFrame:
    if mode == "selected":
        return sessions.filter(F.col("session_id") == (-1 if selected is None else selected))
    if mode == "last7":
        return scope_since(sessions, as_of - F.expr("INTERVAL 7 DAYS"))
    if mode == "today":
        return scope_overlap(sessions, *local_day(as_of, tz))
    return sessions


def assign_fixes(fixes: DataFrame, sessions: DataFrame, as_of: Column,
                 grace_seconds: int = K.GRACE_SECONDS) -> DataFrame:
    """Interval join of loose fixes to recordings.

    The preferred recording wins if the fix lies inside it. Otherwise, where falling back
    is allowed, the only recording that matches is taken. The rest waits until the batch is
    older than the grace period and is then ignored. Fixes and recordings meet on owner and
    day, so that neither a busy owner nor a long recording makes one huge join key; running
    recordings have no end and are kept apart, one row each.
    """
    ids = ["owner_id", "fix_id"]
    day = F.floor(F.unix_seconds("ts") / DAY)
    probes = fixes.select(*ids, "ts", "preferred_session_id", "allow_fallback", day.alias("_day"))
    spans = sessions.select(
        "owner_id", "session_id", "started_at", "ended_at",
        F.when(F.expr("ended_at = started_at"), F.array(F.lit(None).cast("long"))).otherwise(
            F.sequence(F.floor(F.unix_seconds("started_at") / DAY), F.floor(F.unix_seconds("ended_at") / DAY))
        ).alias("_days"),
    ).withColumn("_day", F.explode("_days")).drop("_days")
    closed = probes.join(spans.filter(F.col("_day").isNotNull()), ["owner_id", "_day"]).filter(
        "ts >= started_at AND ts <= ended_at")
    running = probes.join(spans.filter(F.col("_day").isNull()).drop("_day"), "owner_id").filter("ts >= started_at")
    hits = closed.select(*ids, "preferred_session_id", "session_id").unionByName(
        running.select(*ids, "preferred_session_id", "session_id"))
    found = hits.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("_n"), F.min("session_id").alias("_only"),
        F.max(F.when(F.col("session_id") == F.col("preferred_session_id"), F.col("session_id"))).alias("_preferred"),
    )
    chosen = F.coalesce("_preferred", F.when(F.col("allow_fallback") & (F.col("_n") == 1), F.col("_only")))
    age = F.unix_millis(as_of) - F.unix_millis("batch_created_at")
    return fixes.join(found, ids, "left").select(
        *[fixes[c] for c in fixes.columns],
        chosen.alias("session_id"),
        F.when(chosen.isNotNull(), "assigned").when(age <= grace_seconds * 1000, "deferred")
        .otherwise("ignored").alias("outcome"),
    )


def pending_repairs(repairs: DataFrame, sessions: DataFrame, discards: DataFrame) -> DataFrame:
    """Recordings marked for repair that are final and not to be discarded, in order."""
    return repairs.join(finalized(sessions, discards).select(*RECORDING), list(RECORDING)).orderBy(*RECORDING)


def underfilled(discards: DataFrame, sessions: DataFrame, point_counts: DataFrame, now: Column) -> DataFrame:
    """What becomes of recordings kept back for having fewer than two points."""
    counted = discards.join(sessions, list(RECORDING)).join(point_counts, list(RECORDING), "left")
    points = F.coalesce("points", F.lit(0))
    return counted.select(
        *RECORDING, points.alias("points"),
        F.when(points >= 2, F.when(is_final(), "promoted").otherwise("released"))
        .when(F.col("discard_after") <= now, "purged").otherwise("deferred").alias("outcome"),
    )


def finalize(stops: DataFrame, sessions: DataFrame, points: DataFrame) -> DataFrame:
    """Closes recordings: the end is at least a millisecond after the start, the longer distance counts."""
    lengths = path_lengths(points).select(*RECORDING, F.col("distance_m").alias("_path_m"), "points")
    closed = stops.join(sessions.select(*RECORDING, "started_at"), list(RECORDING)).join(lengths, list(RECORDING), "left")
    end_ms = F.greatest(F.unix_millis("stopped_at"), F.unix_millis("started_at") + 1)
    name = F.trim(F.col("name"))
    return closed.select(
        *RECORDING, "started_at", F.timestamp_millis(end_ms).alias("ended_at"),
        F.greatest(F.lit(0), F.floor((end_ms - F.unix_millis("started_at")) / 1000 + 0.5)).alias("duration_s"),
        F.greatest("reported_m", F.coalesce("_path_m", F.lit(0.0))).alias("distance_m"),
        F.when(name == "", None).otherwise(name).alias("display_name"),
        (F.coalesce("points", F.lit(0)) < 2).alias("is_underfilled"),
    )


def unfinished(sessions: DataFrame, points: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Summary of running recordings for recovery; ``as_of`` set means they go on."""
    running = sessions.filter(~is_final())
    mine = points.join(running.select(*RECORDING), list(RECORDING), "left_semi")
    facts = path_lengths(mine).join(last_points(mine).select(*RECORDING, F.col("ts").alias("_last"), "point_index"),
                                    list(RECORDING)).join(last_speeds(mine), list(RECORDING), "left")
    end = as_of if as_of is not None else F.coalesce("_last", "started_at")
    took = F.floor(F.greatest(F.lit(0.0), epoch_seconds(end) - epoch_seconds(F.col("started_at"))) + 0.5)
    return running.join(facts, list(RECORDING), "left").select(
        *RECORDING,
        F.coalesce(F.greatest(F.col("point_index") + 1, F.col("points")), F.lit(0)).alias("next_index"),
        F.greatest("stored_distance_m", F.coalesce("distance_m", F.lit(0.0))).alias("distance_m"),
        F.coalesce("last_speed_mps", F.lit(0.0)).alias("last_speed_mps"),
        F.greatest("stored_duration_s", took).alias("duration_s"),
    )


def erase_recording(table: DataFrame, gone: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Every table without the rows of erased recordings."""
    return table.join(gone.select(*keys), list(keys), "left_anti")
