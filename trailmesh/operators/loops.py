"""Areas enclosed by walked cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmesh import constants as K
from trailmesh.functions.geo import cell_centre_lat, cell_centre_lon
from trailmesh.operators.grid import CELL
from trailmesh.operators.regions import (
    TILE, boxes, cell_runs, cut_at_tiles, enclosed_runs, label_runs, run_cells,
)
from trailmesh.session import checkpointed

GROUP = ("kind", "comp", "grp")


def components(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """4-connected regions of a cell set, as labelled runs."""
    return label_runs(cell_runs(cells, keys), keys, diagonal=False).withColumnRenamed("label", "comp")


def exact_hole_runs(walked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs inside the hole contours of each region, islands included, outermost holes only.

    A hole contour surrounds one 8-connected part of what its region leaves empty. A region
    that lies inside a hole of another one adds nothing: the outer hole has claimed it all.
    """
    keys = list(keys)
    regions = [*keys, "comp"]
    holes = checkpointed(enclosed_runs(walked, regions, diagonal=True).withColumnRenamed("label", "grp"))
    anchor = walked.groupBy(*regions).agg(F.min(F.struct("y", "x0")).alias("_a")).select(
        *keys, F.col("comp").alias("_inner"), F.col("_a.y").alias("y"), F.col("_a.x0").alias("_x"),
        F.floor(F.col("_a.x0") / TILE).cast("int").alias("tx"),
    )
    nested = (
        cut_at_tiles(holes).join(anchor, [*keys, "y", "tx"])
        .filter("_x BETWEEN x0 AND x1 AND _inner <> comp")
        .select(*keys, F.col("_inner").alias("comp")).distinct()
    )
    return holes.join(nested, regions, "left_anti")


def hole_sizes(holes: DataFrame, walked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Empty cells and contour area of each hole, from run lengths alone."""
    keys = list(keys)
    groups = [*keys, "comp", "grp"]
    cut = cut_at_tiles(holes)
    taken = cut_at_tiles(walked.select(*keys, "y", "x0", "x1")).select(
        *keys, "y", "tx", F.col("x0").alias("_w0"), F.col("x1").alias("_w1"))
    shared = (
        cut.join(taken, [*keys, "y", "tx"]).filter("_w0 <= x1 AND _w1 >= x0")
        .groupBy(*groups).agg(F.sum(F.least("x1", "_w1") - F.greatest("x0", "_w0") + 1).alias("_taken"))
    )
    return (
        holes.groupBy(*groups).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("contour_cells"))
        .join(shared, groups, "left")
        .withColumn("cells", F.col("contour_cells") - F.coalesce("_taken", F.lit(0)))
        .drop("_taken").filter("cells > 0")
    )


def fillable_cells(cells: DataFrame, keys: Sequence[str], max_cells: int = K.MAX_LOOP_CELLS) -> DataFrame:
    """Unwalked cells inside hole contours that hold at most ``max_cells`` of them."""
    keys = list(keys)
    cells = checkpointed(cells.select(*keys, *CELL).distinct())
    walked = components(cells, keys)
    holes = exact_hole_runs(walked, keys)
    sizes = hole_sizes(holes, walked, keys).filter(F.col("cells") <= max_cells)
    small = holes.join(sizes.select(*keys, "comp", "grp"), [*keys, "comp", "grp"], "left_semi")
    return (
        run_cells(small, [*keys, "comp", "grp"])
        .join(cells.select(*keys, *CELL), [*keys, *CELL], "left_anti")
        .select(*keys, "comp", "grp", *CELL)
    )


def dilate(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return cells.select(*keys, *CELL, F.explode(near).alias("o")).select(
        *keys, (F.col("cell_x") + F.col("o.i")).alias("cell_x"), (F.col("cell_y") + F.col("o.j")).alias("cell_y")
    ).distinct()


def tolerant_groups(cells: DataFrame, keys: Sequence[str], walked: DataFrame | None = None) -> DataFrame:
    """Cells of areas enclosed when seams of one cell are allowed.

    Each region of the grown cell set uses the exact enclosures of the walked regions in it
    if there are any, else those of the grown region itself, where every unwalked cell in
    the box of its walked cells that the outside cannot reach counts.
    """
    keys = list(keys)
    cells = cells.select(*keys, *CELL).distinct()
    walked = components(cells, keys) if walked is None else walked
    grown = checkpointed(components(dilate(cells, keys), keys))
    # Which grown region holds a walked one: any walked cell lies in exactly one grown run.
    probe = walked.groupBy(*keys, "comp").agg(F.min(F.struct("y", "x0")).alias("_a")).select(
        *keys, "comp", F.col("_a.y").alias("y"), F.col("_a.x0").alias("_x"),
        F.floor(F.col("_a.x0") / TILE).cast("int").alias("tx"))
    host = (
        cut_at_tiles(grown.withColumnRenamed("comp", "host")).join(probe, [*keys, "y", "tx"])
        .filter("_x BETWEEN x0 AND x1").select(*keys, "comp", "host")
    )
    host = checkpointed(host)
    regions = [*keys, "kind", "comp"]
    blocked = walked.withColumn("kind", F.lit("exact")).unionByName(grown.withColumn("kind", F.lit("tolerant")))
    pockets = run_cells(enclosed_runs(blocked, regions, diagonal=False), regions)
    walked_box = boxes(walked.join(host, [*keys, "comp"]).drop("comp").withColumnRenamed("host", "comp"), [*keys, "comp"])
    seams = run_cells(grown, [*keys, "comp"]).withColumn("kind", F.lit("tolerant"))
    inside = (
        pockets.unionByName(seams.select(*regions, *CELL))
        .join(cells, [*keys, *CELL], "left_anti")
        .join(walked_box, [*keys, "comp"], "left")
        .filter("kind = 'exact' OR (cell_x BETWEEN min_x AND max_x AND cell_y BETWEEN min_y AND max_y)")
        .select(*regions, *CELL).distinct()
    )
    inside = checkpointed(inside)
    with_exact = inside.filter("kind = 'exact'").join(host, [*keys, "comp"]).select(
        *keys, F.lit("tolerant").alias("kind"), F.col("host").alias("comp")).distinct()
    chosen = inside.join(with_exact, regions, "left_anti")
    grouped = label_runs(cell_runs(chosen, regions), regions, diagonal=False).withColumnRenamed("label", "grp")
    return run_cells(grouped, [*keys, *GROUP])


def loop_groups(cells: DataFrame, keys: Sequence[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """All enclosed groups of a walked cell set: (groups, cells of the accepted ones).

    Exact contours come first; a tolerant group that shares a cell with one is dropped
    whole. ``strict`` leaves tolerant groups out.
    """
    keys = list(keys)
    cells = checkpointed(cells.select(*keys, *CELL).distinct())
    walked = components(cells, keys)
    holes = exact_hole_runs(walked, keys)
    sizes = checkpointed(hole_sizes(holes, walked, keys).drop("contour_cells"))
    ids = [*keys, *GROUP]
    box = boxes(holes, [*keys, "comp", "grp"])
    small = holes.join(sizes.filter(F.col("cells") <= K.MAX_LOOP_CELLS), [*keys, "comp", "grp"], "left_semi")
    exact_cells = (
        run_cells(small, [*keys, "comp", "grp"]).join(cells, [*keys, *CELL], "left_anti")
        .select(*keys, F.lit("contour").alias("kind"), "comp", "grp", *CELL)
    )
    tight = exact_cells.groupBy(*keys, "comp", "grp").agg(
        F.min("cell_x").alias("t_min_x"), F.max("cell_x").alias("t_max_x"),
        F.min("cell_y").alias("t_min_y"), F.max("cell_y").alias("t_max_y"))
    exact = sizes.join(box, [*keys, "comp", "grp"]).join(tight, [*keys, "comp", "grp"], "left").select(
        *keys, F.lit("contour").alias("kind"), "comp", "grp", "cells",
        *[F.coalesce(f"t_{c}", c).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])
    if strict:
        groups, members = exact, exact_cells
    else:
        seen = checkpointed(tolerant_groups(cells, keys, walked))
        tile = F.floor(F.col("cell_x") / TILE).cast("int")
        claimed = (
            seen.select(*ids, "cell_x", F.col("cell_y").alias("y"), tile.alias("tx"))
            .join(cut_at_tiles(holes.select(*keys, "y", "x0", "x1")), [*keys, "y", "tx"])
            .filter("cell_x BETWEEN x0 AND x1").select(*ids).distinct()
        )
        loose = seen.join(claimed, ids, "left_anti")
        loose_groups = loose.groupBy(*ids).agg(
            F.count(F.lit(1)).alias("cells"), F.min("cell_x").alias("min_x"), F.max("cell_x").alias("max_x"),
            F.min("cell_y").alias("min_y"), F.max("cell_y").alias("max_y"))
        groups = exact.unionByName(loose_groups)
        members = exact_cells.unionByName(loose)
    accepted = F.col("cells") <= K.MAX_LOOP_CELLS
    groups = groups.select(
        *ids, "cells", (F.col("cells") * K.CELL_AREA_M2).alias("area_m2"), accepted.alias("accepted"),
        F.when(~accepted, "loop_area_too_large").alias("rejection_reason"),
        cell_centre_lat("min_y").alias("min_lat"), cell_centre_lat("max_y").alias("max_lat"),
        cell_centre_lon("min_x").alias("min_lon"), cell_centre_lon("max_x").alias("max_lon"),
    )
    return groups, members


def passes_length_gate(lengths: DataFrame) -> DataFrame:
    """Recordings long enough to be searched for loops: at least 4 points and 80 m."""
    return lengths.filter((F.col("points") >= K.MIN_LOOP_POINTS) & (F.col("distance_m") >= K.MIN_LOOP_M))


def completion_cells(saved: DataFrame, active: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored and active cells by source plus the fillable interior as ``loop_fill``."""
    keys = list(keys)
    known = saved.select(*keys, *CELL, "source").unionByName(active.select(*keys, *CELL, "source")).distinct()
    inside = fillable_cells(known.select(*keys, *CELL).distinct(), keys)
    return known.unionByName(inside.select(*keys, *CELL, F.lit("loop_fill").alias("source")))


def merged_polygons(cells: DataFrame, keys: Sequence[str], max_filled_m2: float | None = None) -> DataFrame:
    """One row per merged polygon: area inside its outer ring and the holes that stay open.

    Holes of at most ``max_filled_m2`` are filled, and regions that lie inside a filled hole
    vanish in it. A ring is named by its region and, for a hole, by the empty part it
    surrounds; areas follow from run lengths, so no outline is traced.
    """
    keys = list(keys)
    regions = [*keys, "comp"]
    walked = components(checkpointed(cells.select(*keys, *CELL).distinct()), keys)
    holes = checkpointed(enclosed_runs(walked, regions, diagonal=True).withColumnRenamed("label", "grp"))
    limit = -1.0 if max_filled_m2 is None else float(max_filled_m2)
    rings = holes.groupBy(*regions, "grp").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("hole_cells")).withColumn(
        "filled", F.col("hole_cells") * K.CELL_AREA_M2 <= limit)
    filled = holes.join(rings.filter("filled").select(*regions, "grp"), [*regions, "grp"], "left_semi")
    anchor = walked.groupBy(*regions).agg(F.min(F.struct("y", "x0")).alias("_a")).select(
        *keys, F.col("comp").alias("_inner"), F.col("_a.y").alias("y"), F.col("_a.x0").alias("_x"),
        F.floor(F.col("_a.x0") / TILE).cast("int").alias("tx"))
    swallowed = cut_at_tiles(filled).join(anchor, [*keys, "y", "tx"]).filter(
        "_x BETWEEN x0 AND x1 AND _inner <> comp").select(*keys, F.col("_inner").alias("comp")).distinct()
    solid = walked.groupBy(*regions).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_solid"))
    per_region = rings.groupBy(*regions).agg(
        F.sum("hole_cells").alias("_inside"), F.count_if(~F.col("filled")).alias("holes"),
        F.sum(F.when(~F.col("filled"), F.col("hole_cells")).otherwise(0)).alias("hole_cells"))
    return solid.join(swallowed, regions, "left_anti").join(per_region, regions, "left").select(
        *keys, "comp", (F.col("_solid") + F.coalesce("_inside", F.lit(0))).alias("ring_cells"),
        F.coalesce("holes", F.lit(0)).alias("holes"), F.coalesce("hole_cells", F.lit(0)).alias("hole_cells"))
