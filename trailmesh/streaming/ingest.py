"""Journal files to recordings: at-least-once delivery, late data, dead letters.

Every micro-batch writes only folders named after its id, so that a batch that runs
again replaces its own output and nothing else. Observations alone are kept by hash
bucket of their recording, and a batch reads and replaces the buckets it touches. Points
are written per touched recording; readers take the newest version of each.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailmesh import constants as K
from trailmesh.operators.clean import RECORDING, canonical_points, is_valid_fix
from trailmesh.operators.sessions import assign_fixes

BATCH = (
    "id STRING, createdAt STRING, version INT, ownerId BIGINT, preferredSessionId BIGINT, "
    "points ARRAY<STRUCT<latitude: DOUBLE, longitude: DOUBLE, timestamp: STRING, accuracy: DOUBLE>>"
)
FIX = ("owner_id BIGINT, fix_id STRING, ts TIMESTAMP, lat DOUBLE, lon DOUBLE, accuracy DOUBLE, "
       "preferred_session_id BIGINT, allow_fallback BOOLEAN, batch_created_at TIMESTAMP")
OBSERVATION = "owner_id BIGINT, session_id BIGINT, ts TIMESTAMP, lat DOUBLE, lon DOUBLE, accuracy DOUBLE, arrival STRING"


def parse_batches(lines: DataFrame) -> DataFrame:
    """Adds the parsed document ``b`` and whether it is sound; ``lines`` hold one document per row."""
    parsed = lines.withColumn("b", F.from_json("value", BATCH))
    b = F.col("b")
    sound_points = F.forall(b["points"], lambda p: F.coalesce(
        p["latitude"].isNotNull() & p["longitude"].isNotNull() & ~F.isnan(p["latitude"]) & ~F.isnan(p["longitude"])
        & F.try_to_timestamp(p["timestamp"]).isNotNull(), F.lit(False)))
    sound = (
        b["id"].isNotNull() & b["version"].isin(1, 2) & F.try_to_timestamp(b["createdAt"]).isNotNull()
        & b["points"].isNotNull() & sound_points)
    return parsed.withColumn("sound", F.coalesce(sound, F.lit(False)))


def batch_fixes(parsed: DataFrame) -> DataFrame:
    """Fixes of sound documents; version 1 names no recording, so it may fall back to the only match."""
    b = F.col("b")
    preferred = F.when((b["version"] == 2) & (b["preferredSessionId"] > 0), b["preferredSessionId"])
    rows = parsed.filter("sound").select(
        b["ownerId"].alias("owner_id"), b["id"].alias("_id"), preferred.alias("preferred_session_id"),
        F.try_to_timestamp(b["createdAt"]).alias("batch_created_at"), F.posexplode(b["points"]).alias("_at", "p"))
    return rows.select(
        "owner_id", F.concat_ws("#", "_id", F.lpad(F.col("_at").cast("string"), 9, "0")).alias("fix_id"),
        F.try_to_timestamp("p.timestamp").alias("ts"), F.col("p.latitude").alias("lat"), F.col("p.longitude").alias("lon"),
        F.col("p.accuracy").alias("accuracy"), "preferred_session_id",
        F.col("preferred_session_id").isNull().alias("allow_fallback"), "batch_created_at")


@dataclass(frozen=True)
class Ingest:
    """Tables of the ingestion below one shared folder.

    ``buckets`` is fixed once the first batch is stored. A touched bucket is written again as a
    whole, so choose it for buckets of one file or a few.
    """

    root: str
    grace_seconds: int = K.GRACE_SECONDS
    buckets: int = 4096

    def table(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.table(name)}/batch={batch_id}")

    def _read(self, spark: SparkSession, name: str, schema: str, only: Column) -> DataFrame:
        """All batches of a table that fulfil ``only``; empty while there are none."""
        return self._stored(spark, self.table(name), f"{schema}, batch BIGINT").filter(only)

    @staticmethod
    def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
        """The table below ``path``; empty while nothing is written there."""
        try:
            return spark.read.schema(schema).option("basePath", path).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*RECORDING), F.lit(self.buckets)).cast("int")

    def observations(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark, self.table("observations"), f"{OBSERVATION}, bucket INT")

    def _merge(self, spark: SparkSession, batch_id: int, fresh: DataFrame) -> DataFrame:
        """Stored and fresh observations of the touched buckets, written before any bucket is replaced.

        What earlier attempts at the same batch wrote is read too: one of them may have ended while
        it replaced a bucket. An observation that is met twice counts once.
        """
        touched = [r.bucket for r in fresh.select(self._bucket().alias("bucket")).distinct().collect()]
        attempts = self.table(f"merged/batch={batch_id}")
        known = self.observations(spark).filter(F.col("bucket").isin(touched)).unionByName(
            self._stored(spark, attempts, f"{OBSERVATION}, bucket INT, attempt STRING").drop("attempt"))
        merged = known.unionByName(fresh.withColumn("bucket", self._bucket())).dropDuplicates([*RECORDING, "arrival"])
        here = f"{attempts}/attempt=a{uuid.uuid4().hex}"
        merged.write.parquet(here)
        return spark.read.schema(f"{OBSERVATION}, bucket INT").parquet(here)

    def _replace_buckets(self, merged: DataFrame) -> None:
        merged.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "bucket").parquet(self.table("observations"))

    def points(self, spark: SparkSession) -> DataFrame:
        """The newest points of each recording."""
        schema = "owner_id BIGINT, session_id BIGINT, ts TIMESTAMP, lat DOUBLE, lon DOUBLE, accuracy DOUBLE, " \
                 "arrival STRING, speed_mps DOUBLE, point_index BIGINT"
        versions = self._read(spark, "points", schema, F.lit(True))
        changed = self._read(spark, "changes", "owner_id BIGINT, session_id BIGINT", F.lit(True))
        newest = changed.groupBy(*RECORDING).agg(F.max("batch").alias("batch"))
        return versions.join(newest, [*RECORDING, "batch"], "left_semi").drop("batch")

    def process(self, lines: DataFrame, batch_id: int, sessions: DataFrame, as_of: Column) -> None:
        """One micro-batch: parse, assign, store, and derive the touched recordings again.

        Late or better fixes need no special case: a touched recording is rebuilt from all
        its observations, so the order of arrival does not matter.
        """
        spark = lines.sparkSession
        parsed = parse_batches(lines)
        self._write(parsed.filter("NOT sound").select("value"), "dead_letters", batch_id)
        waiting = self._read(spark, "pending", FIX, F.col("batch") == batch_id - 1).drop("batch")
        fixes = batch_fixes(parsed).filter(is_valid_fix()).unionByName(waiting)
        self._write(assign_fixes(fixes, sessions, as_of, self.grace_seconds), "assigned", batch_id)
        placed = spark.read.parquet(f"{self.table('assigned')}/batch={batch_id}")
        fields = [f.split()[0] for f in FIX.split(", ")]
        self._write(placed.filter("outcome = 'deferred'").select(*fields), "pending", batch_id)
        self._write(placed.filter("outcome = 'ignored'").select(*fields), "ignored", batch_id)
        fresh = placed.filter("outcome = 'assigned'").select(
            *RECORDING, "ts", "lat", "lon", "accuracy", F.col("fix_id").alias("arrival"))
        touched = fresh.select(*RECORDING).distinct()
        merged = self._merge(spark, batch_id, fresh)
        self._replace_buckets(merged)
        mine = merged.drop("bucket").join(touched, list(RECORDING), "left_semi")
        self._write(canonical_points(mine), "points", batch_id)
        # The change notice comes last: readers see a version only when it is whole.
        self._write(touched, "changes", batch_id)

    def start(self, spark: SparkSession, inbox: str, sessions, as_of, checkpoint: str,
              available_now: bool = False) -> StreamingQuery:
        """Watches ``inbox`` for journal files; ``sessions`` and ``as_of`` are called per batch."""
        lines = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(inbox)
        writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
            lambda df, batch_id: self.process(df, batch_id, sessions(), as_of()))
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def changed_recordings(spark: SparkSession, ingest: Ingest, since: int) -> DataFrame:
    """Recordings whose points changed after batch ``since``: the work list of repair jobs."""
    rows = ingest._read(spark, "changes", "owner_id BIGINT, session_id BIGINT", F.col("batch") > since)
    return rows.select(*RECORDING).distinct()


