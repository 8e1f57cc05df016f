"""From raw fixes to accepted points."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmesh import constants as K
from trailmesh.functions.geo import haversine_m
from trailmesh.operators.grouped import map_any_time
from trailmesh.operators.ordered import SLICE, time_slice
from trailmesh.session import checkpointed, epoch_seconds

RECORDING = ("owner_id", "session_id")


# ---------------------------------------------------------------- validity

def is_valid_fix(lat: str = "lat", lon: str = "lon", ts: str = "ts", accuracy: str = "accuracy") -> Column:
    """Finite in-range coordinates, a time, and an accuracy that is absent or not negative."""
    return F.coalesce(
        F.col(lat).between(-90, 90)
        & F.col(lon).between(-180, 180)
        & ~F.isnan(lat)
        & ~F.isnan(lon)
        & F.col(ts).isNotNull()
        & (F.col(accuracy).isNull() | ((F.col(accuracy) >= 0) & ~F.isnan(accuracy))),
        F.lit(False),
    )


def is_trustworthy_fix(**names: str) -> Column:
    accuracy = names.get("accuracy", "accuracy")
    return is_valid_fix(**names) & F.col(accuracy).isNotNull() & (F.col(accuracy) <= K.MAX_ACCURACY_M)


# ---------------------------------------------------------------- duplicates

def best_observations(
    observations: DataFrame, keys: Sequence[str] = RECORDING, arrival: str = "arrival", existing: str | None = None
) -> DataFrame:
    """One fix per recording and time: most accurate, unknown accuracy last, then first to arrive.

    A min over a struct combines map-side, so many copies of one fix stay cheap.
    """
    payload = [c for c in observations.columns if c not in (*keys, "ts", arrival, "accuracy", existing)]
    rank = [F.coalesce("accuracy", F.lit(math.inf)).alias("_rank")]
    rank += [(~F.col(existing)).alias("_new")] if existing else []
    rank += [F.col(arrival), F.col("accuracy"), *[F.col(c) for c in payload]]
    rank += [F.col(existing)] if existing else []
    best = observations.groupBy(*keys, "ts").agg(F.min(F.struct(*rank)).alias("_best"))
    return best.select(*[
        F.col(c) if c in (*keys, "ts") else F.col(f"_best.{c}").alias(c) for c in observations.columns
    ])


def first_by_id(points: DataFrame, keys: Sequence[str] = RECORDING, id_column: str = "point_id") -> DataFrame:
    """Legacy rule: the lowest id per recording and time wins."""
    payload = [c for c in points.columns if c not in (*keys, "ts")]
    rank = [id_column, *[c for c in payload if c != id_column]]
    best = points.groupBy(*keys, "ts").agg(F.min(F.struct(*rank)).alias("_best"))
    return best.select(*[F.col(c) if c in (*keys, "ts") else F.col(f"_best.{c}").alias(c) for c in points.columns])


def merge_observations(stored: DataFrame, arrived: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Stored fixes give way only to strictly more accurate ones.

    ``change`` tells what happened to each (recording, time): kept, improved or inserted;
    ``requires_rebuild`` marks the changes that are not simply newer than everything stored.
    """
    both = stored.withColumn("stored", F.lit(True)).unionByName(arrived.withColumn("stored", F.lit(False)))
    best = best_observations(both, keys, existing="stored")
    before = stored.select(*keys, "ts").distinct().withColumn("_had", F.lit(True))
    newest = stored.groupBy(*keys).agg(F.max("ts").alias("_newest"))
    merged = best.join(before, [*keys, "ts"], "left").join(newest, list(keys), "left")
    change = (
        F.when(F.col("stored"), "kept").when(F.col("_had").isNotNull(), "improved").otherwise("inserted")
    )
    return merged.select(
        *stored.columns,
        change.alias("change"),
        ((change != "kept") & F.coalesce(F.col("ts") <= F.col("_newest"), F.lit(False))).alias("requires_rebuild"),
    )


# ---------------------------------------------------------------- acceptance fold

VERDICT_FIELDS = [
    T.StructField("accepted", T.BooleanType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("speed_mps", T.DoubleType()),
    T.StructField("slice_index", T.LongType()),
]


def _metres(lat1, lon1, lat2, lon2):
    """Vector and scalar haversine used inside the fold."""
    a = (
        np.sin((lat2 - lat1) / 2) ** 2
        + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    )
    return 2 * K.HAVERSINE_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


@dataclass(frozen=True)
class FoldRule:
    """What a fix must be, on its own and against the last accepted one."""

    max_accuracy: float | None
    min_step_m: float
    max_speed: float | None

    def judge(self, distance: float, seconds: float) -> str:
        if self.max_speed is None:
            return "accepted" if distance >= self.min_step_m else "still"
        if seconds < 0 or (seconds == 0 and distance > 1):
            return "stale"
        if seconds == 0 or distance < self.min_step_m:
            return "still"
        return "jump" if distance / seconds > self.max_speed else "accepted"

    def same_start(self, distance: Column, seconds: Column) -> Column:
        """Would a usable fix be accepted after another one that far away?"""
        far = distance >= self.min_step_m
        return far if self.max_speed is None else far & (seconds > 0) & (distance / seconds <= self.max_speed)


CANONICAL = FoldRule(K.MAX_ACCURACY_M, K.MIN_STEP_M, K.MAX_SPEED_MPS)


def _fold_batches(keys: Sequence[str], rule: FoldRule):
    """Walk sorted rows once, carrying only the last accepted fix of the current group."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last, count = None, None, 0
        for batch in batches:
            n = len(batch)
            if n == 0:
                continue
            group = list(zip(*[batch[k].tolist() for k in keys]))
            lat, lon = np.radians(batch["lat"].to_numpy()), np.radians(batch["lon"].to_numpy())
            sec = batch["_sec"].to_numpy()
            usable = np.ones(n, dtype=bool)
            if rule.max_accuracy is not None:
                usable = ~(batch["accuracy"].to_numpy(dtype=float, na_value=np.nan) > rule.max_accuracy)
            seed = batch["_seed"].to_numpy(dtype=bool)
            # Distance to the row before; right whenever that row was the last accepted one.
            step_m = np.zeros(n)
            step_m[1:] = _metres(lat[:-1], lon[:-1], lat[1:], lon[1:])
            verdicts, speeds, accepted, index = [None] * n, [0.0] * n, [False] * n, [-1] * n
            last_row = -1
            for i in range(n):
                if group[i] != current:
                    current, last, last_row, count = group[i], None, -1, 0
                if seed[i]:
                    last, last_row = (lat[i], lon[i], sec[i]), i
                    continue
                if not usable[i]:
                    verdicts[i] = "weak"
                    continue
                if last is None:
                    verdicts[i] = "accepted"
                else:
                    apart = sec[i] - last[2]
                    metres = step_m[i] if last_row == i - 1 and i else _metres(last[0], last[1], lat[i], lon[i])
                    verdicts[i] = rule.judge(metres, apart)
                    if verdicts[i] in ("accepted", "jump") and apart > 0:
                        speeds[i] = float(metres / apart)
                if verdicts[i] == "accepted":
                    accepted[i], index[i] = True, count
                    count += 1
                    last, last_row = (lat[i], lon[i], sec[i]), i
            out = batch.drop(columns=["_sec", "_seed"])
            out["accepted"], out["verdict"], out["speed_mps"], out["slice_index"] = accepted, verdicts, speeds, index
            yield out[~seed]

    return fold


def _fold(rows: DataFrame, keys: Sequence[str], rule: FoldRule, seeds: DataFrame | None = None) -> DataFrame:
    """Verdicts for rows that carry a slice; ``seeds`` hold the last accepted fix before a slice."""
    groups = [*keys, SLICE]
    plain = rows.select("*", epoch_seconds(F.col("ts")).alias("_sec"), F.lit(False).alias("_seed"))
    if seeds is not None:
        lead = seeds.select(
            *[F.col(c) if c in groups else F.lit(None).cast(rows.schema[c].dataType).alias(c)
              for c in rows.columns if c not in ("lat", "lon", "ts")],
            F.col("seed_lat").alias("lat"), F.col("seed_lon").alias("lon"), F.col("seed_ts").alias("ts"),
            epoch_seconds(F.col("seed_ts")).alias("_sec"), F.lit(True).alias("_seed"),
        )
        plain = plain.unionByName(lead)
    ordered = plain.repartition(*groups).sortWithinPartitions(*groups, "_sec")
    schema = T.StructType([*rows.schema.fields, *VERDICT_FIELDS])
    return map_any_time(ordered, _fold_batches(groups, rule), schema)


def accept_fixes(
    observations: DataFrame, keys: Sequence[str] = RECORDING, slice_seconds: int = 86_400,
    rule: FoldRule = CANONICAL,
) -> DataFrame:
    """Verdict for every observation: compare it with the last accepted fix of its recording.

    The fold depends on the last accepted row only, and times must be unique within a
    recording (see ``best_observations``). Recordings are cut into time slices that are
    folded in parallel as streams of sorted rows, each as if it came first, so that no
    recording keeps a single task busy. A slice is right when the true fix before it leads
    to the same first point; the others are folded again from that fix, until none is left.

    ``point_index`` numbers the accepted fixes of a recording from 0.
    """
    rows = observations.withColumn(SLICE, time_slice("ts", slice_seconds))
    groups = [*keys, SLICE]
    done = checkpointed(
        _fold(rows, keys, rule).withColumn("seed_ts", F.lit(None).cast("timestamp"))
    )
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    while True:
        usable = F.col("verdict") != "weak"
        ends = done.groupBy(*groups).agg(
            F.max("seed_ts").alias("used_ts"),
            *[F.min_by(c, F.when(usable, F.col("ts"))).alias(f"head_{c}") for c in ("lat", "lon")],
            F.min(F.when(usable, F.col("ts"))).alias("head_ts"),
            *[F.max_by(c, F.when(F.col("accepted"), F.col("ts"))).alias(f"exit_{c}") for c in ("lat", "lon")],
            F.max(F.when(F.col("accepted"), F.col("ts"))).alias("exit_ts"),
        )
        entries = ends.select(
            *groups, "used_ts", "head_lat", "head_lon", "head_ts",
            *[F.last(f"exit_{c}", ignorenulls=True).over(before).alias(f"seed_{c}") for c in ("lat", "lon", "ts")],
        )
        metres = haversine_m("seed_lat", "seed_lon", "head_lat", "head_lon")
        seconds = epoch_seconds(F.col("head_ts")) - epoch_seconds(F.col("seed_ts"))
        same_start = rule.same_start(metres, seconds)
        stale = entries.filter(
            F.col("head_ts").isNotNull()
            & F.when(F.col("used_ts").isNull(), F.col("seed_ts").isNotNull() & ~same_start).otherwise(
                ~F.col("seed_ts").eqNullSafe(F.col("used_ts"))
            )
        ).select(*groups, "seed_lat", "seed_lon", "seed_ts")
        stale = checkpointed(stale)
        if stale.isEmpty():
            break
        redo = done.join(stale.select(*groups), groups, "left_semi").select(*rows.columns)
        seeded = stale.filter(F.col("seed_ts").isNotNull())
        again = _fold(redo, keys, rule, seeded).join(stale.select(*groups, "seed_ts"), groups)
        done = checkpointed(done.join(stale.select(*groups), groups, "left_anti").unionByName(again))
    counted = done.groupBy(*groups).agg(F.count_if("accepted").alias("_n"))
    offsets = counted.select(*groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = done.drop("seed_ts").join(offsets, groups).withColumn(
        "slice_index", F.when(F.col("accepted"), F.col("slice_index") + F.col("_before")).otherwise(-1)
    ).drop("_before")
    return numbered.drop(SLICE).withColumnRenamed("slice_index", "point_index")


def accepted_points(verdicts: DataFrame) -> DataFrame:
    """Accepted fixes, which the fold has numbered within their recording."""
    return verdicts.filter("accepted").drop("accepted", "verdict")


def canonical_points(observations: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Raw observations to the numbered accepted points of every recording."""
    valid = observations.filter(is_valid_fix())
    return accepted_points(accept_fixes(best_observations(valid, keys), keys))


def spaced_points(points: DataFrame, spacing_m: float, keys: Sequence[str] = RECORDING, **slicing: int) -> DataFrame:
    """Path centres: the first point, each point at least ``spacing_m`` from the last kept one, and the last."""
    columns = points.columns
    rule = FoldRule(None, spacing_m, None)
    folded = accept_fixes(points.select(*keys, "ts", "lat", "lon", "accuracy"), keys, rule=rule, **slicing)
    newest = points.groupBy(*keys).agg(F.max("ts").alias("_last"))
    kept = folded.select(*keys, "ts", "accepted").join(newest, list(keys)).filter("accepted OR ts = _last")
    return points.join(kept.select(*keys, "ts"), [*keys, "ts"], "left_semi").select(*columns)


def verdict_message(verdict: str = "verdict", accuracy: str = "accuracy", speed: str = "speed_mps") -> Column:
    """The reason shown to a walker; null where a fix is dropped silently."""
    v = F.col(verdict)
    # Fixed wording.
    return (
        F.when(v == "weak", F.concat(
            F.lit("GPS signal weak ("), F.floor(F.coalesce(accuracy, F.lit(0.0)) + 0.5).cast("string"),
            F.lit(" m); recording paused until GPS returns")))
        .when(v == "stale", F.lit("GPS point ignored: stale or duplicate timestamp"))
        .when(v == "jump", F.concat(
            F.lit("Jump ignored: "), F.floor(F.col(speed) * 3.6 + 0.5).cast("string"), F.lit(" km/h")))
    )


def fix_counters(verdicts: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Accepted, rejected and paused counts; the reason is that of the latest fix."""
    v = F.col("verdict")
    return verdicts.groupBy(*keys).agg(
        F.count_if(v == "accepted").alias("accepted_fixes"),
        F.count_if(v.isin("stale", "jump")).alias("rejected_fixes"),
        F.count_if(v == "weak").alias("paused_fixes"),
        F.max_by(verdict_message(), F.col("ts")).alias("last_reason"),
    )


def flag_observations(observations: DataFrame, points: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Marks every observation as processed and tells whether it became a point."""
    chosen = points.select(*keys, "ts", F.lit(True).alias("_chosen"))
    return observations.join(chosen, [*keys, "ts"], "left").select(
        *[observations[c] for c in observations.columns],
        F.lit(True).alias("processed"),
        F.col("_chosen").isNotNull().alias("accepted"),
    )


def generation(points: DataFrame, keys: Sequence[str] = RECORDING, id_column: str = "observation_id") -> DataFrame:
    """Count and highest id per recording: the stamp that optimistic checks compare."""
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.max(id_column), F.lit(0)).alias("max_id")
    )


def sequences_changed(stored: DataFrame, derived: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Recordings whose recomputed points differ in time, place, accuracy or index."""
    fields = ["ts", "lat", "lon", "accuracy"]
    left = stored.select(*keys, "point_index", F.lit(True).alias("_l"), *[F.col(f).alias(f"l_{f}") for f in fields])
    right = derived.select(*keys, "point_index", F.lit(True).alias("_r"), *[F.col(f).alias(f"r_{f}") for f in fields])
    same = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    for f in fields:
        same = same & F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}"))
    return (
        left.join(right, [*keys, "point_index"], "full")
        .groupBy(*keys)
        .agg(F.bool_and(same).alias("_same"))
        .select(*keys, (~F.col("_same")).alias("changed"))
    )
