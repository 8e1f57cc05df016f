"""Outlines of cell sets: rings of corners in order, which ring lies in which, polygons with holes.

A cell set of any size has its boundary cut into straight segments, each with one segment
after it. Rings are the cycles of that relation; their pieces are joined up in tiles, and the order
of the pieces is found by pointer doubling, so the rounds grow with the logarithm of the longest
ring and no ring meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmesh import constants as K
from trailmesh.operators.graph import cycle_positions
from trailmesh.operators.grid import boundary_edges
from trailmesh.session import checkpointed

# A segment is numbered by where it starts and its direction; the world has under 2^23 columns and rows of cells.
_SHIFT = 1 << 23
_SPAN = 1 << 24
# Columns and rows of a tile in which pieces of rings are joined up: at most two segments start per corner.
_TILE = 512


def _number(x: Column, y: Column, direction: Column) -> Column:
    return ((x + _SHIFT).cast("long") * _SPAN + y + _SHIFT) * 4 + direction


def start_x(ring: Column) -> Column:
    """Column of the corner that a ring is named by: the leftmost one, of these the lowest."""
    return (F.floor(ring / (4 * _SPAN)) - _SHIFT).cast("int")


def start_y(ring: Column) -> Column:
    return (F.pmod(F.floor(ring / 4), F.lit(_SPAN)) - _SHIFT).cast("int")


def outline_segments(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Longest straight pieces of the boundary, the set on their left: (keys, id, dir, from_x, from_y, to_x, to_y).

    Where two cells touch at a corner only, all four sides turn there, so no piece runs on.
    """
    flat = F.col("dir").isin(0, 2)
    sides = boundary_edges(cells, keys).select(
        *keys, "dir", F.when(flat, F.col("from_y")).otherwise(F.col("from_x")).alias("_line"),
        F.when(flat, F.least("from_x", "to_x")).otherwise(F.least("from_y", "to_y")).alias("_at"))
    row = Window.partitionBy(*keys, "dir", "_line").orderBy("_at")
    lines = sides.withColumn("_island", F.col("_at") - F.row_number().over(row)).groupBy(*keys, "dir", "_line", "_island").agg(
        F.min("_at").alias("_lo"), (F.max("_at") + 1).alias("_hi"))
    ahead = F.col("dir").isin(0, 1)
    first, last = F.when(ahead, F.col("_lo")).otherwise(F.col("_hi")), F.when(ahead, F.col("_hi")).otherwise(F.col("_lo"))
    placed = lines.select(
        *keys, "dir",
        F.when(flat, first).otherwise(F.col("_line")).alias("from_x"), F.when(flat, F.col("_line")).otherwise(first).alias("from_y"),
        F.when(flat, last).otherwise(F.col("_line")).alias("to_x"), F.when(flat, F.col("_line")).otherwise(last).alias("to_y"))
    return placed.withColumn("id", _number(F.col("from_x"), F.col("from_y"), F.col("dir")))


def following(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, next, _tx, _ty): the segment after each one, and the tile it starts in. Where two start, the left turn goes first."""
    corner = Window.partitionBy(*keys, "from_x", "from_y")
    starts = segments.select(*keys, F.col("from_x").alias("to_x"), F.col("from_y").alias("to_y"), F.col("id").alias("next"),
                             F.col("dir").alias("_dir"), F.count(F.lit(1)).over(corner).alias("_n"))
    tile = [F.floor(F.col(f"from_{c}") / _TILE).cast("int").alias(f"_t{c}") for c in "xy"]
    met = segments.select(*keys, "id", "dir", "to_x", "to_y", *tile).join(starts, [*keys, "to_x", "to_y"])
    return met.filter((F.col("_n") == 1) | (F.col("_dir") == (F.col("dir") + 1) % 4)).select(*keys, "id", "next", "_tx", "_ty")


def ring_corners(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ring, position, x, y, dir, to_x, to_y): the corners of every ring in order, none in line with its neighbours.

    Outer rings run to the left around their cells, holes to the right. A ring is named by the
    number of its first segment.
    """
    keys = list(keys)
    segments = checkpointed(outline_segments(cells, keys))
    order = cycle_positions(following(segments, keys), keys, ["_tx", "_ty"])
    return segments.join(order, [*keys, "id"]).select(
        *keys, "ring", "position", F.col("from_x").alias("x"), F.col("from_y").alias("y"), "dir", "to_x", "to_y")


def rings(corners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ring, corners, area): signed area in cells, above 0 for outer rings and below for holes."""
    twice = F.col("x").cast("long") * F.col("to_y") - F.col("to_x").cast("long") * F.col("y")
    return corners.groupBy(*keys, "ring").agg(
        F.count(F.lit(1)).alias("corners"), F.floor(F.sum(twice) / 2).alias("area"))


def ring_parents(corners: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ring, area, corners, parent): the ring directly around each one, null outside of all.

    On the row of its first corner, the next boundary to the left of a ring belongs to the ring
    around it, or to one that lies in the same ring as it does. Such chains are shortened by half a round.
    """
    keys = list(keys)
    upright = corners.filter(F.col("dir").isin(1, 3)).select(
        *keys, "ring", "x", F.explode(F.sequence(F.least("y", "to_y"), F.greatest("y", "to_y") - 1)).alias("_row"))
    row = Window.partitionBy(*keys, "_row").orderBy("x", "ring")
    left = upright.withColumn("_left", F.lag("ring").over(row)).filter(
        (F.col("x") == start_x(F.col("ring"))) & (F.col("_row") == start_y(F.col("ring")))).select(*keys, "ring", "_left")
    sides = known.select(*keys, F.col("ring").alias("_left"), (F.col("area") > 0).alias("_left_outer"))
    met = known.join(left, [*keys, "ring"]).join(sides, [*keys, "_left"], "left")
    around = F.col("_left_outer") != (F.col("area") > 0)
    state = checkpointed(met.select(
        *keys, "ring", F.when(around, F.col("_left")).alias("parent"), F.when(~around, F.col("_left")).alias("_via")))
    while not state.filter("_via IS NOT NULL").isEmpty():
        seen = state.select(*keys, F.col("ring").alias("_via"), F.col("parent").alias("_parent"), F.col("_via").alias("_next"))
        state = checkpointed(state.join(seen, [*keys, "_via"], "left").select(
            *keys, "ring", F.coalesce("parent", F.when(F.col("_next").isNull(), F.col("_parent"))).alias("parent"),
            F.col("_next").alias("_via")))
    return known.join(state.drop("_via"), [*keys, "ring"])


def _inside_any(tree: DataFrame, keys: Sequence[str], marked: Column) -> DataFrame:
    """(keys, ring, inside): whether a ring around it, at any distance, is ``marked``."""
    keys = list(keys)
    marks = tree.select(*keys, F.col("ring").alias("parent"), marked.alias("_hit"))
    state = checkpointed(tree.select(*keys, "ring", "parent").join(marks, [*keys, "parent"], "left").select(
        *keys, "ring", F.coalesce("_hit", F.lit(False)).alias("inside"), F.col("parent").alias("_up")))
    while not state.filter("_up IS NOT NULL AND NOT inside").isEmpty():
        above = state.select(*keys, F.col("ring").alias("_up"), F.col("inside").alias("_in"), F.col("_up").alias("_next"))
        state = checkpointed(state.join(above, [*keys, "_up"], "left").select(
            *keys, "ring", (F.col("inside") | F.coalesce("_in", F.lit(False))).alias("inside"), F.col("_next").alias("_up")))
    return state.drop("_up")


def polygon_rings(corners: DataFrame, keys: Sequence[str], max_filled_m2: float | None = None) -> DataFrame:
    """(keys, polygon, ring, hole, area, corners): the rings that are drawn, each with its polygon.

    A hole of at most ``max_filled_m2`` is filled, and what lies inside it vanishes. A hole that
    stays belongs to the outer ring directly around it, by whose name the polygon goes.
    """
    keys = list(keys)
    known = checkpointed(rings(corners, keys))
    tree = checkpointed(ring_parents(corners, known, keys))
    limit = -1.0 if max_filled_m2 is None else float(max_filled_m2)
    filled = (F.col("area") < 0) & (-F.col("area") * K.CELL_AREA_M2 <= limit)
    shown = tree.join(_inside_any(tree, keys, filled), [*keys, "ring"]).filter(~F.col("inside") & ~filled)
    hole = F.col("area") < 0
    return shown.select(*keys, F.when(hole, F.col("parent")).otherwise(F.col("ring")).alias("polygon"), "ring",
                        hole.alias("hole"), "area", "corners")


def polygon_corners(cells: DataFrame, keys: Sequence[str], max_filled_m2: float | None = None) -> DataFrame:
    """(keys, polygon, ring, hole, position, x, y): what is needed to draw the merged polygons."""
    keys = list(keys)
    corners = checkpointed(ring_corners(cells, keys))
    drawn = polygon_rings(corners, keys, max_filled_m2).select(*keys, "polygon", "ring", "hole")
    return corners.join(drawn, [*keys, "ring"]).select(*keys, "polygon", "ring", "hole", "position", "x", "y")
