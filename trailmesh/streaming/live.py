"""Live state per recording: reorder, accept, count, notice silence."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailmesh import constants as K
from trailmesh.operators import paths, rewards
from trailmesh.operators.clean import CANONICAL, RECORDING
from trailmesh.operators.grid import path_cells

OUTPUT = (
    "owner_id BIGINT, session_id BIGINT, ts TIMESTAMP, lat DOUBLE, lon DOUBLE, accuracy DOUBLE, point_index BIGINT, "
    "speed_mps DOUBLE, distance_m DOUBLE, accepted_fixes BIGINT, rejected_fixes BIGINT, paused_fixes BIGINT, state STRING"
)
# The last accepted fix, counters, and the fixes held back to be put in order.
STATE = (
    "lat DOUBLE, lon DOUBLE, sec DOUBLE, accepted BIGINT, rejected BIGINT, paused BIGINT, distance DOUBLE, "
    "held_due ARRAY<BIGINT>, held_sec ARRAY<DOUBLE>, held_lat ARRAY<DOUBLE>, held_lon ARRAY<DOUBLE>, "
    "held_accuracy ARRAY<DOUBLE>, silent BOOLEAN"
)
STALE_MS = 12_000
FORGET_MS = 24 * 3_600_000


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a = (math.sin(math.radians(lat2 - lat1) / 2) ** 2
         + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2)
    return 2 * K.HAVERSINE_RADIUS_M * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def _follow(reorder_ms: int, forget_ms: int = FORGET_MS):
    names = [f.split()[0] for f in OUTPUT.split(", ")]

    def follow(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lat, lon, sec, accepted, rejected, paused, distance, *held, silent = (
            state.get if state.exists else (math.nan, math.nan, math.nan, 0, 0, 0, 0.0, [], [], [], [], [], False))
        waiting, now = list(zip(*held)), state.getCurrentProcessingTimeMs()
        timed_out = state.hasTimedOut
        if not timed_out:
            silent = False
            for frame in frames:
                accuracy = [math.nan if a is None else float(a) for a in frame["accuracy"]]
                seconds = (frame["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist()
                due = [now + reorder_ms] * len(seconds)
                waiting += list(zip(due, seconds, frame["lat"].tolist(), frame["lon"].tolist(), accuracy))
        elif silent and not waiting:
            state.remove()
            return
        rows = []
        ready = [f for f in waiting if f[0] <= now]
        waiting = [f for f in waiting if f[0] > now]
        # Time order, arrival breaking ties.
        for _, t, y, x, acc in sorted(ready, key=lambda f: f[1]):
            if acc > K.MAX_ACCURACY_M:
                paused += 1
                continue
            metres = 0.0 if math.isnan(sec) else _metres(lat, lon, y, x)
            verdict = "accepted" if math.isnan(sec) else CANONICAL.judge(metres, t - sec)
            if verdict != "accepted":
                rejected += verdict in ("stale", "jump")
                continue
            speed = 0.0 if math.isnan(sec) else metres / (t - sec)
            distance, lat, lon, sec = distance + metres, y, x, t
            rows.append((*key, pd.Timestamp(t, unit="s"), y, x, None if math.isnan(acc) else acc, accepted, speed, distance,
                         accepted + 1, rejected, paused, "live"))
            accepted += 1
        if timed_out and not ready and not waiting:
            if not math.isnan(sec):
                rows.append((*key, pd.Timestamp(sec, unit="s"), lat, lon, None, accepted - 1, 0.0, distance, accepted, rejected,
                             paused, "stale"))
            silent = True
        held = [list(v) for v in zip(*waiting)] if waiting else [[], [], [], [], []]
        state.update((lat, lon, sec, accepted, rejected, paused, distance, *held, silent))
        rest = min(f[0] for f in waiting) - now if waiting else forget_ms if silent else STALE_MS
        state.setTimeoutDuration(max(1, rest))
        yield pd.DataFrame(rows, columns=names)

    return follow


def live_points(fixes: DataFrame, reorder_ms: int = K.REORDER_MS) -> DataFrame:
    """Accepted points of a stream of fixes, with running distance and counters.

    Every fix waits ``reorder_ms`` from its own arrival; the fixes that are due are taken in
    order of time, whether or not more arrive. A recording that stays silent for 12 seconds
    sends one row with state ``stale``, and its state goes after a day of silence. State is a
    few numbers per recording and the fixes of the waiting time.
    """
    return fixes.groupBy(*RECORDING).applyInPandasWithState(
        _follow(reorder_ms), OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def grown_recordings(cells_before: DataFrame, points: DataFrame) -> DataFrame:
    """New cells of the points of a batch's recordings: only where the boundary grew is a check worth it."""
    now = path_cells(points)
    return now.join(cells_before.select(*now.columns), now.columns, "left_anti")


def live_medals(cells_before: DataFrame, points: DataFrame, medals: DataFrame, collected: DataFrame,
                as_of: Column) -> DataFrame:
    """Medals enclosed by running recordings whose boundary grew, with 80 m and 4 cells at least."""
    keys = list(RECORDING)
    grown = grown_recordings(cells_before, points).select(*keys).distinct()
    mine = points.join(grown, keys, "left_semi")
    cells = path_cells(mine)
    wide = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 4").select(*keys)
    found = rewards.medal_candidates(
        cells.join(wide, keys, "left_semi"), paths.path_lengths(mine), medals, keys, collected)
    return found.withColumn("acquired_at", as_of)
