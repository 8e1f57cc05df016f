"""Verified archives: selection, block plans, payload, checks, restore."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailmesh import constants as K
from trailmesh.functions.text import month_label
from trailmesh.operators.clean import RECORDING
from trailmesh.operators.grouped import map_any_time
from trailmesh.operators.ordered import with_previous, with_running
from trailmesh.operators.sessions import is_final, finalized

PLAN = "owner_id long, session_id long, month string, points long, started_at timestamp, part int"


def export_selection(sessions: DataFrame, discards: DataFrame) -> DataFrame:
    """Final recordings without a pending discard, of owners who are not recording right now."""
    busy = sessions.filter(~is_final()).select("owner_id").distinct()
    return finalized(sessions, discards).join(busy, "owner_id", "left_anti")


def exported_only(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows without a recording, or of exported ones (medal events, loop evidence)."""
    inside = rows.filter(F.col("session_id").isNotNull()).join(selection.select(*RECORDING), list(RECORDING), "left_semi")
    return rows.filter(F.col("session_id").isNull()).unionByName(inside.select(*rows.columns))


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the blocks of sorted (owner, month) streams: 20 recordings or 25 000 points each."""
    current, part, held, total = None, 0, 0, 0
    for batch in batches:
        parts = []
        for owner, month, points in zip(batch["owner_id"], batch["month"], batch["points"]):
            if (owner, month) != current:
                current, part, held, total = (owner, month), 1, 0, 0
            elif held >= K.BLOCK_RECORDINGS or total + points > K.BLOCK_POINTS:
                part, held, total = part + 1, 0, 0
            held, total = held + 1, total + points
            parts.append(part)
        yield batch.assign(part=parts)


def block_plans(recordings: DataFrame) -> DataFrame:
    """(owner_id, session_id, block_id, kind, label, points) for recordings with their point count.

    The newest 20 recordings of an owner are blocks of their own; older ones are packed by
    month in order of time. The packing walks a sorted stream of headers; recordings of one
    owner do not overlap, so a month holds a bounded number.
    """
    newest = Window.partitionBy("owner_id").orderBy(F.desc("started_at"), F.desc("session_id"))
    ranked = recordings.select(*RECORDING, "started_at", "points").withColumn("_r", F.row_number().over(newest))
    hot = ranked.filter(F.col("_r") <= K.HOT_RECORDINGS).drop("_r")
    hot = hot.select(
        *RECORDING, F.concat(F.lit("hot-"), F.col("session_id").cast("string")).alias("block_id"), F.lit("hot").alias("kind"),
        F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("label"), "points")
    old = recordings.join(hot.select(*RECORDING), list(RECORDING), "left_anti").select(
        *RECORDING, month_label(F.col("started_at")).alias("month"), F.col("points").cast("long").alias("points"), "started_at")
    ordered = old.repartition("owner_id", "month").sortWithinPartitions("owner_id", "month", "started_at", "session_id")
    packed = map_any_time(ordered, _pack, StructType.fromDDL(PLAN))
    archived = packed.select(
        *RECORDING,
        F.concat(F.lit("archive-"), F.col("month"), F.lit("-"), F.lpad(F.col("part").cast("string"), 2, "0")).alias("block_id"),
        F.lit("archive").alias("kind"), F.col("month").alias("label"), "points")
    return hot.unionByName(archived)


def manifest_totals(plans: DataFrame) -> DataFrame:
    return plans.groupBy("owner_id").agg(
        F.countDistinct(F.when(F.col("kind") == "archive", F.col("block_id"))).alias("archive_blocks"),
        F.countDistinct("block_id").alias("blocks"), F.count_if(F.col("kind") == "hot").alias("hot_recordings"),
        F.sum("points").alias("points"), F.count(F.lit(1)).alias("recordings"))


def block_payload(plans: DataFrame, points: DataFrame) -> DataFrame:
    """Points with the block they go to."""
    return points.join(plans.select(*RECORDING, "block_id"), list(RECORDING))


def block_counts(plans: DataFrame, payload: DataFrame) -> DataFrame:
    """Expected and actual points per block; every block must match."""
    expected = plans.groupBy("owner_id", "block_id").agg(F.sum("points").alias("expected"))
    actual = payload.groupBy("owner_id", "block_id").agg(F.count(F.lit(1)).alias("actual"))
    return expected.join(actual, ["owner_id", "block_id"], "full").select(
        "owner_id", "block_id", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"),
    ).withColumn("matches", F.col("expected") == F.col("actual"))


def block_checksums(payload: DataFrame) -> DataFrame:
    """Order-free checksum of each block from the CRC-32 of its rows."""
    row = F.crc32(F.to_json(F.struct(*sorted(c for c in payload.columns))).cast("binary"))
    return payload.groupBy("owner_id", "block_id").agg(F.bit_xor(row).alias("crc_xor"), F.sum(row).alias("crc_sum"))


# ---------------------------------------------------------------- point references

def _reference_slice(column: str) -> Column:
    return F.floor(F.col(column) / 100_000)


def position_runs(positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, run_no, start, count) of positions given in order of ``seq``."""
    keys = list(keys)
    lagged = with_previous(positions, keys, "seq", ["position"], _reference_slice("seq"))
    broken = F.when(F.col("prev_position").isNull() | (F.col("position") != F.col("prev_position") + 1), 1).otherwise(0)
    numbered = with_running(lagged, keys, "seq", _reference_slice("seq"), sums={"run_no": broken})
    return numbered.groupBy(*keys, "run_no").agg(F.min("position").alias("start"), F.count(F.lit(1)).alias("count"))


def run_positions(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Back to single positions."""
    return runs.select(*keys, "run_no", F.explode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias("position"))


# ---------------------------------------------------------------- verification

def _rule(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def verify(recordings: DataFrame, plans: DataFrame, payload: DataFrame, events: DataFrame, collected: DataFrame,
           tasks: DataFrame, seals: DataFrame, evidence: DataFrame, stored_checksums: DataFrame | None = None) -> DataFrame:
    """(rule, violations): all zero for a sound archive."""
    ids = recordings.select(*RECORDING)

    def repeated(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")

    def orphans(df: DataFrame, parents: DataFrame, *keys: str) -> DataFrame:
        return df.join(parents.select(*keys).distinct(), list(keys), "left_anti")

    is_open = F.col("accepted_at").isNotNull() & F.col("abandoned_at").isNull() & F.col("completed_at").isNull()
    bad_row = (~is_final()) | (F.col("session_id") <= 0) | (F.col("distance_m") < 0) | (F.col("step_count") < 0) | (
        F.col("activity_mode") != "walk")
    reports = [
        _rule("recording_metadata", recordings.filter(bad_row)),
        _rule("recording_ids_unique", repeated(ids, *RECORDING)),
        _rule("blocks_cover_all", orphans(ids, plans, *RECORDING)),
        _rule("blocks_cover_once", repeated(plans, *RECORDING)),
        _rule("blocks_known_recordings", orphans(plans, ids, *RECORDING)),
        _rule("block_point_counts", block_counts(plans, payload).filter(~F.col("matches"))),
        _rule("event_ids_unique", repeated(events, "owner_id", "album_id", "medal_id")),
        _rule("events_known_recordings", orphans(events.filter(F.col("session_id").isNotNull()), ids, *RECORDING)),
        _rule("collected_have_events", orphans(collected, events, "owner_id", "album_id", "medal_id")),
        _rule("task_ids_unique", repeated(tasks, "owner_id", "id")),
        _rule("one_open_task", repeated(tasks.filter(is_open), "owner_id")),
        _rule("seals_unique", repeated(seals, "owner_id", "expedition_id")),
        _rule("seals_have_tasks", orphans(seals.withColumn("id", F.col("expedition_id")), tasks, "owner_id", "id")),
        _rule("evidence_unique", repeated(evidence, "expedition_id", "session_id")),
        _rule("evidence_known_recordings", orphans(evidence, ids, *RECORDING)),
    ]
    if stored_checksums is not None:
        fresh = block_checksums(payload)
        reports.append(_rule("block_checksums", fresh.join(stored_checksums, fresh.columns, "left_anti")))
    whole = reports[0]
    for report in reports[1:]:
        whole = whole.unionByName(report)
    return whole


# ---------------------------------------------------------------- files

def write_archive(path: str, recordings: DataFrame, plans: DataFrame, points: DataFrame) -> None:
    payload = block_payload(plans, points)
    payload.write.mode("overwrite").partitionBy("block_id").option("maxRecordsPerFile", 1_000_000).parquet(f"{path}/blocks")
    recordings.write.mode("overwrite").parquet(f"{path}/recordings")
    plans.write.mode("overwrite").parquet(f"{path}/plans")
    block_checksums(payload).write.mode("overwrite").parquet(f"{path}/checksums")


def restore_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recordings, observations, repairs) of a verified archive; raises if a rule is broken.

    Restored fixes count as processed and accepted; everything derived is marked for
    recomputation.
    """
    recordings, plans = spark.read.parquet(f"{path}/recordings"), spark.read.parquet(f"{path}/plans")
    payload = spark.read.parquet(f"{path}/blocks")
    stored = spark.read.parquet(f"{path}/checksums")
    ids = recordings.select(*RECORDING)
    counts = block_counts(plans, payload).filter(~F.col("matches"))
    fresh = block_checksums(payload.select(*[c for c in payload.columns]))
    broken = (
        _rule("blocks_cover_all", ids.join(plans.select(*RECORDING), list(RECORDING), "left_anti"))
        .unionByName(_rule("block_point_counts", counts))
        .unionByName(_rule("block_checksums", fresh.join(stored, fresh.columns, "left_anti")))
        .filter("violations > 0")
    )
    names = [r.rule for r in broken.collect()]  # at most three rows
    if names:
        raise ValueError(f"archive is not sound: {', '.join(sorted(names))}")
    observations = payload.drop("block_id", "point_index").withColumns({"processed": F.lit(True), "accepted": F.lit(True)})
    return recordings, observations, ids
