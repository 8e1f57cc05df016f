"""Quality marks, fix status and milestones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmesh import constants as K
from trailmesh.operators.clean import is_trustworthy_fix
from trailmesh.session import epoch_seconds


def _graded(base: DataFrame, rules: list[list[tuple[Column, int, str]]], fine: str) -> DataFrame:
    """Subtracts the first matching penalty of each rule; the first reason in rule order is told."""
    score, reasons = F.lit(100), []
    for rule in rules:
        penalty, reason = None, None
        for test, points, text in rule:
            penalty = F.when(test, points) if penalty is None else penalty.when(test, points)
            reason = F.when(test, text) if reason is None else reason.when(test, text)
        score = score - penalty.otherwise(0)
        reasons.append(reason)
    score = F.greatest(F.lit(0), F.least(F.lit(100), score))
    return base.select(
        "*", score.alias("score"),
        F.when(score >= 80, "Good").when(score >= 55, "OK").otherwise("Poor").alias("label"),
        F.coalesce(*reasons, F.lit(fine)).alias("reason"))


def live_quality(recordings: DataFrame) -> DataFrame:
    """Live score from accepted/rejected/paused counts, elapsed_s, current accuracy and background state."""
    accuracy, paused = F.col("accuracy"), F.col("paused_fixes")
    seen = F.col("accepted_fixes") + F.col("rejected_fixes")
    share = F.when(seen > 0, F.col("rejected_fixes") / seen).otherwise(0.0)
    pace = F.when(F.col("elapsed_s") > 0, F.col("accepted_fixes") / (F.col("elapsed_s") / 60)).otherwise(0.0)
    late, state = F.col("elapsed_s") > 60, F.col("background_status")
    # Fixed wording and weights.
    return _graded(recordings, [
        [(accuracy.isNull(), 10, "GPS accuracy unknown"),
         (accuracy > K.MAX_ACCURACY_M, 35, "weak GPS accuracy"),
         (accuracy > K.MAX_ACCURACY_M * 0.6, 15, "GPS accuracy is only fair")],
        [(paused >= 5, 20, "GPS recording paused repeatedly"), (paused > 0, 8, "GPS recording paused briefly")],
        [(share > 0.4, 35, "many GPS points rejected"), (share > 0.15, 15, "some GPS points rejected")],
        [(late & (pace < 2), 25, "GPS updates are sparse"), (late & (pace < 4), 10, "GPS updates are slow")],
        [(state == "unavailable", 15, "background tracking unavailable"),
         (state == "foreground-only", 8, "foreground-only recording")],
    ], "GPS, steps, and background recording look healthy.")


def saved_quality(recordings: DataFrame) -> DataFrame:
    """Score of a stored recording from point_count, duration_s and hidden_gaps."""
    n, took, gaps = F.col("point_count"), F.col("duration_s"), F.col("hidden_gaps")
    pace = F.when(took > 0, n / (took / 60)).otherwise(n)
    # Fixed wording and weights.
    return _graded(recordings, [
        [(n < 2, 60, "too few accepted GPS points"),
         ((took > 60) & (pace < 2), 30, "GPS updates were sparse"),
         ((took > 60) & (pace < 4), 12, "GPS updates were slow")],
        [(gaps > 3, 25, "multiple hidden gaps"), (gaps > 0, 10, "hidden GPS gaps")],
    ], "Saved report uses accepted GPS points and derived hidden gaps; rejected raw GPS counts were not "
       "persisted for older recordings.")


def fix_status(devices: DataFrame, as_of: Column) -> DataFrame:
    """State of the latest fix per device: permission, accuracy, ts, is_recording, resolved."""
    now, at = F.unix_millis(as_of), F.unix_millis("ts")
    age = F.greatest(F.lit(0), now - at)
    limit = F.when(F.col("is_recording"), 12000).otherwise(20000)
    reason = (
        F.when(F.col("permission") == "denied", "permission-denied")
        .when(F.col("permission") == "unknown", "permission-pending")
        .when(F.col("ts").isNull(), F.when(F.col("resolved"), "no-fix").otherwise("fix-pending"))
        .when(at > now + 5000, "invalid-fix")
        .when(age > limit, "stale-fix")
        .when(F.col("accuracy").isNull() | F.isnan("accuracy") | ~F.col("accuracy").between(0, 25), "weak-accuracy")
        .otherwise("good-fix")
    )
    state = F.create_map(*[F.lit(v) for pair in (
        ("permission-denied", "denied"), ("permission-pending", "acquiring"), ("no-fix", "unavailable"),
        ("fix-pending", "acquiring"), ("invalid-fix", "unavailable"), ("stale-fix", "weak-stale"),
        ("weak-accuracy", "weak-stale"), ("good-fix", "good")) for v in pair])
    dated = F.col("reason").isin("stale-fix", "weak-accuracy", "good-fix")
    return devices.withColumn("reason", reason).select(
        "*", state[F.col("reason")].alias("state"), F.when(dated, F.floor(age / 1000 + 0.5)).alias("age_s"))


def latest_positions(fixes: DataFrame, keys=("owner_id",)) -> DataFrame:
    """Newest trustworthy fix per device; of several at one time the most accurate, taken whole."""
    sound = fixes.filter(is_trustworthy_fix())
    newest = F.max(F.struct("ts", (-F.col("accuracy")).alias("rank"), "lat", "lon", "accuracy")).alias("_fix")
    return sound.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_fix.{c}").alias(c) for c in ("ts", "lat", "lon", "accuracy")])


def milestones(summaries: DataFrame) -> DataFrame:
    """Badges of a finished recording, from new_cells, distance_m, objective_percent, paused_fixes, score."""
    metres = F.col("distance_m")
    # Fixed labels and limits.
    badges = F.array_compact(F.array(
        F.when(F.col("new_cells") >= 1000, "1000 cells"),
        F.when(metres >= 25000, "25 km").when(metres >= 10000, "10 km").when(metres >= 5000, "5 km"),
        F.when(F.coalesce("objective_percent", F.lit(0)) >= 5, "District 5%"),
        F.when((F.col("paused_fixes") == 0) & (F.col("score") >= 80), "Clean GPS"),
    ))
    return summaries.withColumn("milestones", badges)


def elapsed_seconds(start: str, end: str) -> Column:
    return epoch_seconds(F.col(end)) - epoch_seconds(F.col(start))
