"""Routes to grid cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmesh import constants as K
from trailmesh.functions.geo import cell_of, mercator_x, mercator_y
from trailmesh.operators.clean import RECORDING
from trailmesh.operators.paths import steps

CELL = ("cell_x", "cell_y")


def rasterize(
    lines: DataFrame,
    keep: Sequence[str],
    ends: Sequence[str] = ("from_lat", "from_lon", "to_lat", "to_lon"),
) -> DataFrame:
    """Distinct cells whose centre lies within the capture radius of a sample of a line.

    Samples are at most 3.75 m apart, and only the 3x3 cells around one can qualify.
    Duplicates collapse map-side before the shuffle.
    """
    a_lat, a_lon, b_lat, b_lon = ends
    measured = lines.select(
        *keep,
        mercator_x(a_lon).alias("_ax"), mercator_y(a_lat).alias("_ay"),
        mercator_x(b_lon).alias("_bx"), mercator_y(b_lat).alias("_by"),
    )
    dx, dy = F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")
    count = F.greatest(F.lit(1), F.ceil(F.hypot(dx, dy) / K.SAMPLE_M).cast("int"))
    sampled = measured.withColumn("_n", count).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    placed = sampled.select(
        *keep,
        (F.col("_ax") + dx * (F.col("_i") / F.col("_n"))).alias("_sx"),
        (F.col("_ay") + dy * (F.col("_i") / F.col("_n"))).alias("_sy"),
    )
    around = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)
    ])
    near = placed.withColumn("_o", F.explode(around)).select(
        *keep, "_sx", "_sy",
        (cell_of("_sx") + F.col("_o.i")).alias("cell_x"), (cell_of("_sy") + F.col("_o.j")).alias("cell_y"),
    )
    half = K.CELL_M / 2
    reach = F.hypot(F.col("cell_x") * K.CELL_M + half - F.col("_sx"), F.col("cell_y") * K.CELL_M + half - F.col("_sy"))
    return near.filter(reach <= K.CAPTURE_RADIUS_M).select(*keep, *CELL).distinct()


def path_cells(points: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Cells of the confirmed steps of recordings that have no frozen route."""
    return rasterize(steps(points, keys).filter("kind = 'confirmed'"), keys)


def cells_by_source(route_lines: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Cells of route lines; walked wins over inferred, low confidence gives nothing.

    ``route_lines`` are vertex pairs with ``type`` and ``confidence``.
    """
    sound = route_lines.filter((F.col("type") == "confirmed") | F.col("confidence").isin("high", "medium"))
    marked = sound.withColumn("_source", F.when(F.col("type") == "inferred", 2).otherwise(1))
    cells = rasterize(marked, [*keys, "_source"])
    return cells.groupBy(*keys, *CELL).agg(F.min("_source").alias("_source")).select(
        *keys, *CELL, F.when(F.col("_source") == 1, "gps").otherwise("inferred").alias("source")
    )


def recording_cells(points: DataFrame, route_lines: DataFrame, frozen: DataFrame,
                    keys: Sequence[str] = RECORDING) -> DataFrame:
    """Cells per recording: from the frozen route where there is one, else from the points."""
    loose = points.join(frozen.select(*keys).distinct(), list(keys), "left_anti")
    return cells_by_source(route_lines, keys).unionByName(
        path_cells(loose, keys).withColumn("source", F.lit("gps"))
    )


def boundary_edges(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Directed unit edges between a cell of the set and a cell outside it, the set on the left.

    ``dir`` counts quarter turns: 0 east, 1 north, 2 west, 3 south.
    """
    x, y = F.col("cell_x"), F.col("cell_y")

    def side(d: int, fx, fy):
        return F.struct(F.lit(d).alias("dir"), fx.alias("from_x"), fy.alias("from_y"))

    sides = F.array(side(0, x, y), side(1, x + 1, y), side(2, x + 1, y + 1), side(3, x, y + 1))
    # A shared side appears twice, once from each cell; a boundary side once.
    # Counting by side replaces a self anti-join and combines map-side.
    faces = cells.select(*keys, *CELL).distinct().withColumn("_s", F.explode(sides)).select(
        *keys, "_s.*",
        F.when(F.col("_s.dir").isin(0, 2), F.lit("h")).otherwise(F.lit("v")).alias("_axis"),
    )
    low_x = F.when(F.col("dir") == 2, F.col("from_x") - 1).otherwise(F.col("from_x"))
    low_y = F.when(F.col("dir") == 3, F.col("from_y") - 1).otherwise(F.col("from_y"))
    return (
        faces.groupBy(*keys, low_x.alias("_lx"), low_y.alias("_ly"), "_axis")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("dir").alias("dir"),
             F.min("from_x").alias("from_x"), F.min("from_y").alias("from_y"))
        .filter("_n = 1")
        .select(
            *keys, "from_x", "from_y", "dir",
            (F.col("from_x") + F.when(F.col("dir") == 0, 1).when(F.col("dir") == 2, -1).otherwise(0)).alias("to_x"),
            (F.col("from_y") + F.when(F.col("dir") == 1, 1).when(F.col("dir") == 3, -1).otherwise(0)).alias("to_y"),
        )
    )


def cell_totals(cells: DataFrame, keys: Sequence[str] = ("owner_id",)) -> DataFrame:
    """Distinct cells and their nominal area."""
    return (
        cells.select(*keys, *CELL).distinct().groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("cells"))
        .withColumn("area_m2", F.col("cells") * K.CELL_AREA_M2)
    )


def new_cells(active: DataFrame, saved: DataFrame, keys: Sequence[str] = ("owner_id",)) -> DataFrame:
    on = [*keys, *CELL]
    return active.select(*on).distinct().join(saved.select(*on), on, "left_anti")
