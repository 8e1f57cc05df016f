"""Queries on the grid: cells, edges, components and enclosures."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmesh.catalog.registry import query
from trailmesh.catalog.sqltext import raster
from trailmesh.functions import geo
from trailmesh.operators import grid, loops, outlines, paths, regions, sets, stats

O = ["owner_id"]


def route_lines(d):
    s = d.steps.filter("kind = 'confirmed' OR distance_m < 60")
    gap = F.col("kind") == "gap"
    return s.withColumn("type", F.when(gap, "inferred").otherwise("confirmed")).withColumn(
        "confidence", F.when(gap, F.when(F.col("step_no") % 3 == 0, "low").when(F.col("step_no") % 3 == 1, "medium")
                             .otherwise("high")))


def walked(d):
    """Distinct cells per owner and recording."""
    return grid.path_cells(d.points)


def explored(d):
    return walked(d).select("owner_id", *grid.CELL).distinct()


@query("flagship_explored_by_owner", """
SELECT p.owner_id, recordings, points, round(distance_m, 3) AS distance_m, coalesce(c.cells, 0) AS cells,
       coalesce(c.cells, 0) * 225 AS area_m2
FROM (SELECT owner_id, count(*) AS recordings, CAST(sum(points) AS BIGINT) AS points, sum(distance_m) AS distance_m
      FROM lens GROUP BY owner_id) p
LEFT JOIN (SELECT owner_id, count(*) AS cells FROM ocells GROUP BY owner_id) c ON c.owner_id = p.owner_id""")
def _(d):
    lengths = paths.path_lengths(d.points).groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("recordings"), F.sum("points").alias("points"), F.sum("distance_m").alias("distance_m"))
    cells = grid.cell_totals(walked(d))
    return lengths.join(cells, "owner_id", "left").select(
        "owner_id", "recordings", "points", F.round("distance_m", 3).alias("distance_m"),
        F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("area_m2", F.lit(0)).alias("area_m2"))


@query("geo1_cell_of_fix", """
SELECT observation_id, concat(CAST(cx AS VARCHAR), ':', CAST(cy AS VARCHAR)) AS cell_key,
       round(degrees((cx * 15 + 7.5) / 6378137.0), 6) AS centre_lon,
       round(degrees(atan(exp((cy * 15 + 7.5) / 6378137.0)) * 2 - pi() / 2), 6) AS centre_lat
FROM (SELECT observation_id, CAST(floor({mercx:lon} / 15) AS INT) AS cx, CAST(floor({mercy:lat} / 15) AS INT) AS cy
      FROM obs)""")
def _(d):
    placed = d.observations.select("observation_id", geo.cell_x("lon").alias("cx"), geo.cell_y("lat").alias("cy"))
    return placed.select(
        "observation_id", geo.cell_key("cx", "cy").alias("cell_key"),
        F.round(geo.cell_centre_lon("cx"), 6).alias("centre_lon"),
        F.round(geo.cell_centre_lat("cy"), 6).alias("centre_lat"))


@query("geo2_path_cells", "SELECT owner_id, session_id, cell_x, cell_y FROM cells")
def _(d):
    return walked(d)


@query("geo3_cells_by_source", "SELECT owner_id, session_id, cell_x, cell_y, source FROM scells")
def _(d):
    return grid.cells_by_source(route_lines(d))


MIXED = {
    "loose_steps": "SELECT * FROM steps WHERE reason IS NULL AND session_id % 2 = 1",
    "loose_cells": raster("loose_steps", "owner_id, session_id"),
}


@query("geo3_recording_cells", """
SELECT owner_id, session_id, cell_x, cell_y, source FROM scells WHERE session_id % 2 = 0
UNION ALL SELECT owner_id, session_id, cell_x, cell_y, 'gps' FROM loose_cells""", MIXED)
def _(d):
    lines = route_lines(d).filter("session_id % 2 = 0")
    frozen = d.points.filter("session_id % 2 = 0").select("owner_id", "session_id").distinct()
    return grid.recording_cells(d.points, lines, frozen)


@query("geo4_boundary_edges", """
SELECT owner_id, cell_x + dx AS from_x, cell_y + dy AS from_y, dir FROM ocells c,
  (VALUES (0, 0, 0, 0, -1), (1, 1, 0, 1, 0), (2, 1, 1, 0, 1), (3, 0, 1, -1, 0)) s(dir, dx, dy, nx, ny)
WHERE NOT EXISTS (SELECT 1 FROM ocells n WHERE n.owner_id = c.owner_id AND n.cell_x = c.cell_x + nx
                    AND n.cell_y = c.cell_y + ny)""")
def _(d):
    return grid.boundary_edges(explored(d), O).select("owner_id", "from_x", "from_y", "dir")


COMPONENTS = {
    "near4": "SELECT ox, oy FROM offs WHERE abs(ox) + abs(oy) = 1",
    "seeds": """
SELECT owner_id, cell_x, cell_y, cell_x AS sx, cell_y AS sy FROM ocells a
WHERE NOT EXISTS (SELECT 1 FROM ocells b WHERE b.owner_id = a.owner_id AND b.cell_y = a.cell_y AND b.cell_x = a.cell_x - 1)
  AND NOT EXISTS (SELECT 1 FROM ocells b WHERE b.owner_id = a.owner_id AND b.cell_y = a.cell_y - 1 AND b.cell_x = a.cell_x)
UNION
SELECT c.owner_id, c.cell_x, c.cell_y, f.sx, f.sy FROM seeds f JOIN near4 n ON true
JOIN ocells c ON c.owner_id = f.owner_id AND c.cell_x = f.cell_x + n.ox AND c.cell_y = f.cell_y + n.oy""",
    "comps": "SELECT owner_id, cell_x, cell_y, min(CAST(sx AS BIGINT) * 10000000 + sy) AS g FROM seeds GROUP BY ALL",
}


@query("geo8_components", """
SELECT owner_id, count(*) AS cells, min(cell_x) AS min_x, max(cell_x) AS max_x, min(cell_y) AS min_y,
       max(cell_y) AS max_y FROM comps GROUP BY owner_id, g""", COMPONENTS)
def _(d):
    labelled = loops.components(explored(d), O)
    return labelled.groupBy("owner_id", "comp").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("cells"), F.min("x0").alias("min_x"), F.max("x1").alias("max_x"),
        F.min("y").alias("min_y"), F.max("y").alias("max_y")).drop("comp")


@query("geo7_fillable_cells", "SELECT owner_id, cell_x, cell_y FROM ofill")
def _(d):
    return loops.fillable_cells(explored(d), O).select("owner_id", *grid.CELL)


@query("geo11_exact_loops", """
SELECT owner_id, count(*) AS cells, count(*) * 225 AS area_m2, count(*) <= 666 AS accepted
FROM oholes_grp GROUP BY owner_id, g""")
def _(d):
    groups, _members = loops.loop_groups(explored(d), O, strict=True)
    return groups.select("owner_id", "cells", "area_m2", "accepted")


@query("geo10_tolerant_loops")
def _(d):
    groups, _members = loops.loop_groups(explored(d), O)
    return groups.select("owner_id", "kind", "cells", "area_m2", "accepted", "rejection_reason")


@query("geo11_recording_loops")
def _(d):
    """Loops of single recordings that pass the length gate."""
    long = loops.passes_length_gate(paths.path_lengths(d.points)).select("owner_id", "session_id")
    cells = walked(d).join(long, ["owner_id", "session_id"], "left_semi")
    groups, _members = loops.loop_groups(cells, ["owner_id", "session_id"])
    return groups.drop("comp", "grp")


@query("geo12_completion_cells", """
SELECT owner_id, cell_x, cell_y, 'gps' AS source FROM ocells
UNION ALL SELECT owner_id, cell_x, cell_y, 'loop_fill' FROM ofill""")
def _(d):
    cells = walked(d).withColumn("source", F.lit("gps"))
    return loops.completion_cells(cells.filter("session_id % 2 = 0"), cells.filter("session_id % 2 = 1"), O)


@query("agg10_cell_totals", "SELECT owner_id, count(*) AS cells, count(*) * 225 AS area_m2 FROM ocells GROUP BY owner_id")
def _(d):
    return grid.cell_totals(walked(d))


@query("agg10_new_cells_of_active", """
SELECT DISTINCT owner_id, cell_x, cell_y FROM cells a WHERE session_id % 100 > 0 AND NOT EXISTS (
  SELECT 1 FROM cells b WHERE b.owner_id = a.owner_id AND b.cell_x = a.cell_x AND b.cell_y = a.cell_y
    AND b.session_id % 100 = 0)""")
def _(d):
    cells = walked(d)
    return grid.new_cells(cells.filter("session_id % 100 > 0"), cells.filter("session_id % 100 = 0"))


@query("agg11_explorer_score", """
SELECT owner_id, CAST(sum(w) AS BIGINT) AS walked_cells, CAST(sum(1 - w) AS BIGINT) AS enclosed_cells,
       count(*) AS discovered_cells, CAST(count(*) + sum(1 - w) AS BIGINT) AS points, count(*) * 225 AS area_m2
FROM (SELECT owner_id, cell_x, cell_y, 1 AS w FROM ocells UNION ALL SELECT owner_id, cell_x, cell_y, 0 FROM ofill)
GROUP BY owner_id""")
def _(d):
    cells = explored(d)
    return stats.explorer_score(cells, cells.limit(0))


@query("set1_union_sources", """
SELECT owner_id, cell_x, cell_y FROM cells WHERE session_id % 2 = 0
UNION SELECT owner_id, cell_x, cell_y FROM cells WHERE session_id % 2 = 1""")
def _(d):
    cells = walked(d).select("session_id", "owner_id", *grid.CELL)
    return sets.union_distinct(cells.filter("session_id % 2 = 0").drop("session_id"),
                               cells.filter("session_id % 2 = 1").drop("session_id"))


@query("set2_cells_in_component", """
SELECT owner_id, cell_x, cell_y FROM ocells INTERSECT
SELECT owner_id, cell_x + ox, cell_y + oy FROM cells, offs WHERE session_id % 100 = 0""")
def _(d):
    first = walked(d).filter("session_id % 100 = 0")
    return explored(d).join(loops.dilate(first, O), [*O, *grid.CELL], "left_semi")


@query("set3_inferred_only", """
SELECT owner_id, cell_x, cell_y FROM scells WHERE source = 'inferred'
EXCEPT SELECT owner_id, cell_x, cell_y FROM scells WHERE source = 'gps'""")
def _(d):
    by_source = grid.cells_by_source(route_lines(d))
    # One grouping answers the difference; no self join.
    return by_source.groupBy("owner_id", *grid.CELL).agg(F.min("source").alias("first")).filter(
        "first = 'inferred'").drop("first")


@query("set4_distinct_cell_sources", "SELECT DISTINCT owner_id, cell_x, cell_y, source FROM scells")
def _(d):
    return grid.cells_by_source(route_lines(d)).select("owner_id", *grid.CELL, "source").distinct()


@query("set5_insert_or_ignore", """
SELECT DISTINCT owner_id, cell_x, cell_y, source FROM scells a WHERE NOT EXISTS (
  SELECT 1 FROM cells b WHERE b.owner_id = a.owner_id AND b.cell_x = a.cell_x AND b.cell_y = a.cell_y)""")
def _(d):
    new = grid.cells_by_source(route_lines(d)).select("owner_id", *grid.CELL, "source")
    return sets.only_new(new, explored(d), ["owner_id", *grid.CELL])


@query("geo2_row_runs", """
SELECT owner_id, cell_y AS y, min(cell_x) AS x0, max(cell_x) AS x1 FROM (
  SELECT *, cell_x - row_number() OVER (PARTITION BY owner_id, cell_y ORDER BY cell_x) AS g FROM ocells)
GROUP BY owner_id, cell_y, g""")
def _(d):
    return regions.cell_runs(explored(d), O)


@query("geo5_ring_areas", """
SELECT c.owner_id, polygons, coalesce(holes, 0) AS holes FROM (
  SELECT owner_id, count(DISTINCT g) AS polygons FROM comps GROUP BY owner_id) c
LEFT JOIN (SELECT owner_id, count(DISTINCT g) AS holes FROM oholes_grp GROUP BY owner_id) h ON h.owner_id = c.owner_id""", COMPONENTS)
def _(d):
    """Outer rings and holes per owner; no region of the derived walks lies inside another one's hole."""
    return loops.merged_polygons(explored(d), O).groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("polygons"), F.sum("holes").alias("holes"))


@query("geo6_filled_polygons")
def _(d):
    return loops.merged_polygons(explored(d), O, 150_000).drop("comp")


PATCHES = {
    "patches": """
SELECT DISTINCT (o_orderkey // 4000) % 5 AS owner_id, CAST(o_orderkey // 4000 * 61 + o_custkey % 60 AS INT) AS cell_x,
       CAST((CAST(floor(o_totalprice) AS BIGINT) + o_orderkey) % 60 - 30 AS INT) AS cell_y FROM orders""",
    "psides": """
SELECT owner_id, cell_x + dx AS fx, cell_y + dy AS fy, dir, cell_x + dx + [1, 0, -1, 0][dir + 1] AS tx,
       cell_y + dy + [0, 1, 0, -1][dir + 1] AS ty
FROM patches c, (VALUES (0, 0, 0, 0, -1), (1, 1, 0, 1, 0), (2, 1, 1, 0, 1), (3, 0, 1, -1, 0)) s(dir, dx, dy, nx, ny)
WHERE NOT EXISTS (SELECT 1 FROM patches n WHERE n.owner_id = c.owner_id AND n.cell_x = c.cell_x + nx
                    AND n.cell_y = c.cell_y + ny)""",
    # The side after each one: the turn to the left before straight on, before the turn to the right.
    "pnext": """
SELECT a.owner_id, a.fx, a.fy, a.dir, min(struct_pack(turn := (b.dir - a.dir + 5) % 4 * -1, dir := b.dir)).dir AS ndir
FROM psides a JOIN psides b ON a.owner_id = b.owner_id AND b.fx = a.tx AND b.fy = a.ty AND (b.dir - a.dir + 4) % 4 <> 2
GROUP BY ALL""",
    "pturns": """
SELECT n.owner_id, n.fx, n.fy, n.dir, n.ndir, n.fx + [1, 0, -1, 0][n.dir + 1] AS tx, n.fy + [0, 1, 0, -1][n.dir + 1] AS ty,
       ((CAST(n.fx AS BIGINT) + 8388608) * 16777216 + n.fy + 8388608) * 4 + n.dir AS id FROM pnext n""",
    "plink": """
SELECT a.owner_id, a.id, b.id AS next, a.fx, a.fy, a.dir FROM pturns a JOIN pturns b
ON a.owner_id = b.owner_id AND b.fx = a.tx AND b.fy = a.ty AND b.dir = a.ndir""",
    "pwalk": """
SELECT owner_id, id AS ring, id AS at, 0 AS step FROM plink
UNION ALL SELECT w.owner_id, w.ring, l.next, w.step + 1 FROM pwalk w JOIN plink l
ON l.owner_id = w.owner_id AND l.id = w.at AND l.next > w.ring""",
    "prings": """
SELECT w.owner_id, w.ring FROM pwalk w JOIN plink l ON l.owner_id = w.owner_id AND l.id = w.at AND l.next = w.ring""",
    "pring_sides": """
SELECT w.owner_id, w.ring, w.step, l.fx, l.fy, l.dir, l.next FROM pwalk w JOIN prings r ON r.owner_id = w.owner_id AND r.ring = w.ring
JOIN plink l ON l.owner_id = w.owner_id AND l.id = w.at""",
    "pcorners": """
SELECT a.owner_id, a.ring, a.fx AS x, a.fy AS y, row_number() OVER (PARTITION BY a.owner_id, a.ring ORDER BY a.step) - 1 AS position
FROM pring_sides a JOIN pring_sides b ON a.owner_id = b.owner_id AND a.ring = b.ring
 AND b.next = ((CAST(a.fx AS BIGINT) + 8388608) * 16777216 + a.fy + 8388608) * 4 + a.dir WHERE a.dir <> b.dir""",
    "pareas": """
SELECT owner_id, ring, sum(CASE dir WHEN 0 THEN -fy WHEN 2 THEN fy ELSE 0 END) AS area,
       arg_min(fx, step) AS sx, arg_min(fy, step) AS sy FROM pring_sides GROUP BY 1, 2""",
    # Every ring that lies around the cell at another ring's first corner: its upright sides to the left are odd in number.
    "paround": """
SELECT r.owner_id, r.ring, r.area, s.ring AS outside, o.area AS outside_area FROM pareas r
JOIN pring_sides s ON s.owner_id = r.owner_id AND s.ring <> r.ring AND s.dir IN (1, 3) AND s.fx <= r.sx
 AND (CASE s.dir WHEN 1 THEN s.fy ELSE s.fy - 1 END) = r.sy
JOIN pareas o ON o.owner_id = s.owner_id AND o.ring = s.ring
GROUP BY ALL HAVING count(*) % 2 = 1""",
    "pgone": "SELECT DISTINCT owner_id, ring FROM paround WHERE outside_area < 0 AND -outside_area * 225 <= 1000",
}


@query("geo5_rings", """
SELECT a.owner_id, a.ring, corners, CAST(area AS BIGINT) AS area FROM pareas a JOIN (
  SELECT owner_id, ring, count(*) AS corners FROM pcorners GROUP BY 1, 2) c ON c.owner_id = a.owner_id AND c.ring = a.ring""", PATCHES)
def _(d):
    """Every ring with its signed area in cells."""
    return outlines.rings(outlines.ring_corners(d.patches, O), O)


@query("geo5_ring_corners", "SELECT owner_id, ring, position, x, y FROM pcorners", PATCHES)
def _(d):
    return outlines.ring_corners(d.patches, O).select("owner_id", "ring", "position", "x", "y")


@query("geo6_polygon_rings", """
SELECT a.owner_id, a.ring AS polygon, a.ring, false AS hole, CAST(a.area AS BIGINT) AS area FROM pareas a
ANTI JOIN pgone g ON g.owner_id = a.owner_id AND g.ring = a.ring WHERE a.area > 0
UNION ALL
SELECT h.owner_id, arg_min(outside, outside_area), h.ring, true, CAST(h.area AS BIGINT) FROM paround h
WHERE h.area < 0 AND -h.area * 225 > 1000 AND outside_area > 0
  AND NOT EXISTS (SELECT 1 FROM pgone g WHERE g.owner_id = h.owner_id AND g.ring = h.outside)
GROUP BY h.owner_id, h.ring, h.area""", PATCHES)
def _(d):
    """Outer rings and open holes by polygon; holes of up to four cells are filled."""
    corners = outlines.ring_corners(d.patches, O)
    return outlines.polygon_rings(corners, O, 1000).drop("corners")


@query("geo6_polygon_corners", """
SELECT owner_id, ring AS polygon, ring, false AS hole, position, x, y FROM pcorners c
WHERE EXISTS (SELECT 1 FROM pareas a WHERE a.owner_id = c.owner_id AND a.ring = c.ring AND a.area > 0)
UNION ALL
SELECT c.owner_id, polygon, c.ring, true, position, x, y FROM pcorners c JOIN (
  SELECT owner_id, ring, arg_min(outside, outside_area) AS polygon FROM paround WHERE area < 0 AND outside_area > 0
  GROUP BY 1, 2) h ON h.owner_id = c.owner_id AND h.ring = c.ring""", PATCHES)
def _(d):
    """Corners of the merged polygons of all patches, no hole filled."""
    return outlines.polygon_corners(d.patches, O)


@query("geo1_cells_of_keys", """
SELECT DISTINCT concat(CAST(cell_x AS VARCHAR), ':', CAST(cell_y AS VARCHAR)) AS cell_key, cell_x, cell_y FROM cells""")
def _(d):
    """Keys written and read again."""
    keys = walked(d).select(geo.cell_key("cell_x", "cell_y").alias("cell_key")).distinct()
    return keys.select("cell_key", geo.cell_from_key("cell_key").alias("c")).select("cell_key", "c.cell_x", "c.cell_y")
