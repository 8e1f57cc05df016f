"""Connected regions of grid cells, as row runs.

A region may be arbitrarily large, so the plane is cut into tiles. Runs are joined up
inside each tile by a linear sweep, and the few labels that meet at tile borders are
merged as a graph. Runs, not cells, keep large solid or empty areas cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmesh.operators.graph import component_roots
from trailmesh.operators.grid import CELL
from trailmesh.operators.grouped import whole_groups
from trailmesh.session import checkpointed, dealt

TILE = 1024
# Label = tile column, tile row and number within the tile, packed into one long.
_TILE_SHIFT = 4096
_LOCAL_SHIFT = 1 << 20


def cell_runs(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal horizontal runs (y, x0, x1) of a distinct cell set.

    One grid row holds at most one cell per column of the globe, which bounds the window.
    """
    row = Window.partitionBy(*keys, "cell_y").orderBy("cell_x")
    return (
        cells.select(*keys, *CELL, (F.col("cell_x") - F.row_number().over(row)).alias("_island"))
        .groupBy(*keys, "cell_y", "_island")
        .agg(F.min("cell_x").alias("x0"), F.max("cell_x").alias("x1"))
        .select(*keys, F.col("cell_y").alias("y"), "x0", "x1")
    )


def run_cells(runs: DataFrame, keep: Sequence[str]) -> DataFrame:
    return runs.select(*keep, F.col("y").alias("cell_y"), F.explode(F.sequence("x0", "x1")).alias("cell_x"))


def cut_at_tiles(runs: DataFrame) -> DataFrame:
    tile = F.explode(F.sequence(F.floor(F.col("x0") / TILE).cast("int"), F.floor(F.col("x1") / TILE).cast("int")))
    cut = runs.withColumn("tx", tile).withColumn("ty", F.floor(F.col("y") / TILE).cast("int"))
    return cut.withColumns({
        "x0": F.greatest(F.col("x0"), F.col("tx") * TILE),
        "x1": F.least(F.col("x1"), F.col("tx") * TILE + TILE - 1),
    })


def _sweep(y: list[int], x0: list[int], x1: list[int], slack: int, first: list[int]) -> list[int]:
    """Labels of runs sorted by (tile, y, x0): runs of neighbouring rows of a tile that touch share one.

    ``first`` is where the tile of a run starts; labels count from there.
    """
    parent = list(range(len(y)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    below = 0
    for i in range(len(y)):
        below = max(below, first[i])
        while below < i and (y[below] < y[i] - 1 or (y[below] == y[i] - 1 and x1[below] < x0[i] - slack)):
            below += 1
        j = below
        while j < i and y[j] == y[i] - 1 and x0[j] <= x1[i] + slack:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
            j += 1
    return [find(i) - first[i] for i in range(len(y))]


def _label_tiles(groups: Sequence[str], slack: int):
    """Sweep the tiles of a partition sorted by (groups, y, x0)."""

    def label(tiles: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        local = _sweep(tiles["y"].tolist(), tiles["x0"].tolist(), tiles["x1"].tolist(), slack, first.tolist())
        tx, ty = tiles["tx"].to_numpy(dtype=np.int64), tiles["ty"].to_numpy(dtype=np.int64)
        base = ((tx + _TILE_SHIFT // 2) * _TILE_SHIFT + ty + _TILE_SHIFT // 2) * _LOCAL_SHIFT
        return tiles.assign(label=base + np.array(local, dtype=np.int64))

    return whole_groups(groups, label)


def label_runs(runs: DataFrame, keys: Sequence[str], diagonal: bool) -> DataFrame:
    """Runs, cut at tile borders, with the ``label`` of their connected region.

    Rows touch sideways and up and down, with ``diagonal`` also at corners. Labels are
    unique within ``keys``.
    """
    keys = list(keys)
    slack = 1 if diagonal else 0
    groups = [*keys, "tx", "ty"]
    pieces = cut_at_tiles(runs.select(*keys, "y", "x0", "x1"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("label", T.LongType())])
    labelled = checkpointed(
        dealt(pieces, *groups).sortWithinPartitions(*groups, "y", "x0").mapInPandas(
            _label_tiles(groups, slack), schema
        )
    )
    y_in, right, left = F.pmod("y", F.lit(TILE)), F.pmod("x1", F.lit(TILE)) == TILE - 1, F.pmod("x0", F.lit(TILE)) == 0
    # Sideways, and at corners, over a vertical tile border.
    rows = F.array(*[F.col("y") + d for d in range(-slack, slack + 1)])
    east = labelled.filter(right).select(*keys, F.explode(rows).alias("y"), (F.col("x1") + 1).alias("_x"),
                                         F.col("label").alias("a"))
    west = labelled.filter(left).select(*keys, "y", F.col("x0").alias("_x"), F.col("label").alias("b"))
    # Upwards over a horizontal tile border; corners were met above.
    top = labelled.filter(y_in == TILE - 1).select(
        *keys, (F.col("y") + 1).alias("y"), "tx", (F.col("x0") - slack).alias("_lo"), (F.col("x1") + slack).alias("_hi"),
        F.col("label").alias("a"))
    bottom = labelled.filter(y_in == 0).select(*keys, "y", "tx", "x0", "x1", F.col("label").alias("b"))
    meets = east.join(west, [*keys, "y", "_x"]).select(*keys, "a", "b").unionByName(
        top.join(bottom, [*keys, "y", "tx"]).filter("x0 <= _hi AND x1 >= _lo").select(*keys, "a", "b")
    )
    roots = component_roots(meets, keys)
    merged = labelled.join(roots.withColumnRenamed("node", "label"), [*keys, "label"], "left")
    return merged.select(*keys, "y", "x0", "x1", F.coalesce("root", "label").alias("label"))


def boxes(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(
        F.min("x0").alias("min_x"), F.max("x1").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )


def complement_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Empty runs of each key inside its box grown by one cell; every row of the box must hold a run."""
    row = Window.partitionBy(*keys, "y").orderBy("x0")
    box = boxes(runs, keys)
    placed = runs.select(
        *keys, "y", "x0", "x1", F.lag("x1").over(row).alias("_before"), F.lead("x0").over(row).alias("_after")
    ).join(box, list(keys))
    gaps = placed.select(*keys, "y", F.explode(F.array(
        F.struct((F.coalesce(F.col("_before"), F.col("min_x") - 2) + 1).alias("x0"), (F.col("x0") - 1).alias("x1")),
        F.when(F.col("_after").isNull(), F.struct((F.col("x1") + 1).alias("x0"), (F.col("max_x") + 1).alias("x1"))),
    )).alias("g")).filter("g IS NOT NULL AND g.x0 <= g.x1").select(*keys, "y", "g.x0", "g.x1")
    frame = box.select(*keys, F.explode(F.array(F.col("min_y") - 1, F.col("max_y") + 1)).alias("y"),
                       (F.col("min_x") - 1).alias("x0"), (F.col("max_x") + 1).alias("x1"))
    return gaps.unionByName(frame)


def enclosed_runs(runs: DataFrame, keys: Sequence[str], diagonal: bool) -> DataFrame:
    """Labelled empty runs of each key that cannot be left towards the outside."""
    keys = list(keys)
    labelled = label_runs(complement_runs(runs, keys), keys, diagonal)
    low = labelled.groupBy(*keys).agg(F.min("y").alias("y"))
    outside = labelled.join(low, [*keys, "y"]).select(*keys, "label").distinct()
    return labelled.join(outside, [*keys, "label"], "left_anti")
