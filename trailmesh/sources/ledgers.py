"""Typed readers for the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVATIONS = ("owner_id BIGINT, session_id BIGINT, ts TIMESTAMP, lat DOUBLE, lon DOUBLE, accuracy DOUBLE, arrival BIGINT")
SESSIONS = ("owner_id BIGINT, session_id BIGINT, activity_mode STRING, display_name STRING, started_at TIMESTAMP, "
            "ended_at TIMESTAMP, distance_m DOUBLE, duration_s INT, step_count INT")
ROUTE_POINT = "STRUCT<latitude: DOUBLE, longitude: DOUBLE, timestamp: STRING, accuracy: DOUBLE, pointIndex: INT>"
ROUTE_SEGMENTS = f"ARRAY<STRUCT<type: STRING, confidence: STRING, points: ARRAY<{ROUTE_POINT}>>>"
ALBUM = ("id STRING, version INT, cityName MAP<STRING,STRING>, medals ARRAY<STRUCT<id: STRING, category: STRING, "
         "name: MAP<STRING,STRING>, latitude: DOUBLE, longitude: DOUBLE>>")


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def parse_route(json: Column) -> Column:
    """Route segments from JSON text, null unless every segment is well formed."""
    parsed = F.from_json(json, ROUTE_SEGMENTS)

    def sound_point(p: Column) -> Column:
        return F.coalesce(p["latitude"].isNotNull() & p["longitude"].isNotNull() & p["timestamp"].isNotNull()
                          & p["pointIndex"].isNotNull(), F.lit(False))

    def sound(s: Column) -> Column:
        return F.coalesce(
            s["type"].isin("confirmed", "inferred") & s["points"].isNotNull() & F.forall(s["points"], sound_point)
            & (s["confidence"].isNull() | s["confidence"].isin("high", "medium")), F.lit(False))

    return F.when(F.forall(parsed, sound), parsed)


def read_albums(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(albums, medals, album items) from multi-line catalogue files."""
    whole = spark.read.schema(ALBUM).option("multiLine", True).json(path)
    albums = whole.select(F.col("id").alias("album_id"), "version", F.col("cityName").alias("city_name"))
    items = whole.select(F.col("id").alias("album_id"), F.posexplode("medals").alias("sort_order", "m"))
    medals = items.select("album_id", F.col("m.id").alias("medal_id"), "m.category", "m.name",
                          F.col("m.latitude").alias("lat"), F.col("m.longitude").alias("lon"))
    return albums, medals, items.select("album_id", F.col("m.id").alias("medal_id"), "sort_order")
