"""GPX 1.1 documents, one file per recording, as streams of lines."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmesh.functions.text import xml_escape
from trailmesh.operators.clean import RECORDING

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _slug(name: str | None) -> str:
    text = unicodedata.normalize("NFKD", (name or "").strip() or "walk")
    text = re.sub("[\u0300-\u036f]", "", text)
    text = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "-", text)
    text = re.sub(r"-+", "-", re.sub(r"\s+", "-", text))
    return re.sub(r"^-|-$", "", text)[:64] or "walk"


def name_slug(name: Column) -> Column:
    """File-name form of a recording name: no accents, no reserved characters, at most 64 characters."""

    def slugs(names: pd.Series) -> pd.Series:
        return names.map(_slug)

    return F.pandas_udf(slugs, "string")(name)


def file_names(sessions: DataFrame) -> DataFrame:
    """Portable file name per recording."""
    name = F.concat_ws("-", F.date_format("started_at", "yyyy-MM-dd"), name_slug(F.col("display_name")),
                       F.concat(F.col("session_id").cast("string"), F.lit(".gpx")))
    return sessions.select(*RECORDING, name.alias("file_name"))


def _iso(column: str) -> Column:
    return F.date_format(column, ISO)


def gpx_lines(sessions: DataFrame, points: DataFrame) -> DataFrame:
    """(owner_id, file_name, line_no, value): a head, one row per track point, a tail.

    No document is built in memory: the rows of a file are sorted and written one by one.
    """
    titled = sessions.join(file_names(sessions), list(RECORDING))
    title = xml_escape(F.when(F.trim("display_name") != "", F.col("display_name")).otherwise(
        F.concat(F.lit("Recording "), F.col("session_id").cast("string"))))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="trailmesh" '
              'xmlns="http://www.topografix.com/GPX/1/1">\n  <metadata>\n    <name>'), title,
        F.lit("</name>\n    <time>"), _iso("started_at"),
        F.lit("</time>\n  </metadata>\n  <trk>\n    <name>"), title, F.lit("</name>\n    <trkseg>"))
    frame = titled.select(*RECORDING, "file_name", F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("line_no"), head.alias("value")),
        F.struct(F.lit(2**62).cast("long").alias("line_no"), F.lit("    </trkseg>\n  </trk>\n</gpx>").alias("value")),
    )).alias("l")).select("owner_id", "file_name", "l.line_no", "l.value")
    track = points.join(titled.select(*RECORDING, "file_name"), list(RECORDING)).select(
        "owner_id", "file_name", F.col("point_index").cast("long").alias("line_no"),
        F.concat(F.lit('      <trkpt lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"),
                 F.lit('">\n        <time>'), _iso("ts"), F.lit("</time>\n      </trkpt>")).alias("value"))
    return frame.unionByName(track)


def write_gpx(sessions: DataFrame, points: DataFrame, path: str) -> None:
    """One folder ``owner_id=.../file_name=...`` with one text file per recording; owners may use the same names."""
    place = ["owner_id", "file_name"]
    gpx_lines(sessions, points).repartition(*place).sortWithinPartitions(*place, "line_no").drop(
        "line_no").write.mode("overwrite").partitionBy(*place).text(path)
