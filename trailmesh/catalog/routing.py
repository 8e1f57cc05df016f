"""Queries on the street graph, gap routing, corridors and line shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmesh.catalog.registry import query
from trailmesh.catalog.sqltext import CTES
from trailmesh.catalog.streets import WAYS, ways
from trailmesh.operators import clean, corridors, paths, routing, simplify
from trailmesh.plans import jobs
from trailmesh.sources import osm


CTES["ln"] = """
SELECT id, lat1, lon1, lat2, lon2, len,
       concat(CAST(CAST(round(lat1 * 1e6) AS BIGINT) AS VARCHAR), ':', CAST(CAST(round(lon1 * 1e6) AS BIGINT) AS VARCHAR)) AS ak,
       concat(CAST(CAST(round(lat2 * 1e6) AS BIGINT) AS VARCHAR), ':', CAST(CAST(round(lon2 * 1e6) AS BIGINT) AS VARCHAR)) AS bk
FROM walkable"""
CTES["adj"] = "SELECT ak AS a, bk AS b, len FROM ln UNION SELECT bk, ak, len FROM ln"
CTES["gapx"] = "SELECT * FROM steps WHERE reason IS NOT NULL"
CTES["gends"] = """
SELECT session_id, step_no, 0 AS side, p_lat AS lat, p_lon AS lon FROM gapx
UNION ALL SELECT session_id, step_no, 1, lat, lon FROM gapx"""
CTES["sn0"] = """
SELECT *, lat1 + (lat2 - lat1) * t AS s_lat, lon1 + (lon2 - lon1) * t AS s_lon FROM (
  SELECT g.session_id, g.step_no, g.side, g.lat, g.lon, l.id, l.ak, l.bk, l.lat1, l.lon1, l.lat2, l.lon2,
         {prog:0|0|(l.lon1 - g.lon) * 111320.0 * cos(radians(g.lat))|(l.lat1 - g.lat) * 111320.0|(l.lon2 - g.lon) * 111320.0 * cos(radians(g.lat))|(l.lat2 - g.lat) * 111320.0} AS t
  FROM gends g JOIN ln l ON abs(l.lat1 - g.lat) < 0.0006 AND abs(l.lon1 - g.lon) < 0.0008)"""
CTES["sn1"] = """
SELECT *, least(ak, bk) || '>' || greatest(ak, bk) AS ek, round({hav:lat|lon|s_lat|s_lon}, 6) AS snap FROM sn0"""
CTES["sn"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, step_no, side ORDER BY snap, ek) - 1 AS no,
                      min(snap) OVER (PARTITION BY session_id, step_no, side) AS best FROM sn1 WHERE snap <= 30)
WHERE snap <= best + 4 AND no < 6"""
CTES["hook"] = """
SELECT session_id, step_no, side, no, snap, ak AS node, {hav:s_lat|s_lon|lat1|lon1} AS h FROM sn
UNION ALL SELECT session_id, step_no, side, no, snap, bk, {hav:s_lat|s_lon|lat2|lon2} FROM sn"""

def gaps(d):
    return d.steps.filter("kind = 'gap'")


@query("geo13_street_graph", "SELECT a AS src, b AS dst, round(len, 3) AS dist_m FROM adj")
def _(d):
    _lines, _nodes, edges = routing.street_graph(d.streets)
    return edges.select("src", "dst", F.round("dist_m", 3).alias("dist_m"))


@query("joi8_snap_candidates", """
SELECT session_id, step_no, side, no AS snap_no, ek AS edge_key, round(snap, 3) AS snap_m FROM sn""")
def _(d):
    snaps = routing.snap_candidates(routing.gap_ends(gaps(d)), routing.street_lines(d.streets), routing.GAP)
    return snaps.select("session_id", "step_no", "side", "snap_no", "edge_key", F.round("snap_m", 3).alias("snap_m"))


LEVEL = {
    **WAYS,
    "pc": """
SELECT id AS way, concat('way/', CAST(id AS VARCHAR), '/part/', CAST(row_number() OVER (PARTITION BY id ORDER BY i, s) - 1 AS VARCHAR)) AS id,
       a_lat + (b_lat - a_lat) * f AS lat1, a_lon + (b_lon - a_lon) * f AS lon1,
       a_lat + (b_lat - a_lat) * g AS lat2, a_lon + (b_lon - a_lon) * g AS lon2 FROM piece""",
    "pk": """
SELECT *, CAST(round(lat1 * 1e6) AS BIGINT) * 1000000000 + CAST(round(lon1 * 1e6) AS BIGINT) AS ak,
       CAST(round(lat2 * 1e6) AS BIGINT) * 1000000000 + CAST(round(lon2 * 1e6) AS BIGINT) AS bk,
       {planx:lon1|45.75} AS x1, {plany:lat1} AS y1, {planx:lon2|45.75} AS x2, {plany:lat2} AS y2 FROM pc""",
    "xx": """
SELECT *, (qx * sy - qy * sx) / cr AS t, (qx * ry - qy * rx) / cr AS u FROM (
  SELECT *, rx * sy - ry * sx AS cr FROM (
    SELECT p.id AS pid, q.id AS qid, p.lat1, p.lon1, p.lat2, p.lon2, p.x2 - p.x1 AS rx, p.y2 - p.y1 AS ry,
           q.x2 - q.x1 AS sx, q.y2 - q.y1 AS sy, q.x1 - p.x1 AS qx, q.y1 - p.y1 AS qy
    FROM pk p JOIN pk q ON p.way // 10 = q.way // 10 AND p.id < q.id AND p.ak NOT IN (q.ak, q.bk) AND p.bk NOT IN (q.ak, q.bk)))
WHERE abs(cr) >= 0.000001""",
}


def level_parts(d):
    """Parts of the derived ways, all at ground level."""
    parts = osm.way_parts(ways(d), F.timestamp_seconds(F.lit(0)))
    return parts.withColumns({"bridge": F.lit(False), "tunnel": F.lit(False), "layer": F.lit(0)})


@query("joi9_crossings", """
SELECT pid AS part_id, qid AS r_part_id, round(lat1 + (lat2 - lat1) * greatest(0, least(1, t)), 6) AS lat,
       round(lon1 + (lon2 - lon1) * greatest(0, least(1, t)), 6) AS lon
FROM xx WHERE t BETWEEN -0.00001 AND 1.00001 AND u BETWEEN -0.00001 AND 1.00001""", LEVEL)
def _(d):
    met = routing.crossings(routing.street_lines(level_parts(d)))
    return met.select("part_id", "r_part_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("joi10_endpoint_joins", """
SELECT count(*) AS joins, round(sum(dist), 2) AS metres FROM (
  SELECT p.k AS pk, q.k AS qk, min({hav:p.lat|p.lon|q.lat|q.lon}) AS dist
  FROM (SELECT DISTINCT way, ak AS k, lat1 AS lat, lon1 AS lon FROM pk UNION SELECT way, bk, lat2, lon2 FROM pk) p
  JOIN (SELECT DISTINCT way, ak AS k, lat1 AS lat, lon1 AS lon FROM pk UNION SELECT way, bk, lat2, lon2 FROM pk) q
    ON p.way // 10 = q.way // 10 AND p.k < q.k GROUP BY p.k, q.k) WHERE dist > 0.15 AND dist <= 8""", LEVEL)
def _(d):
    joins = routing.endpoint_joins(routing.street_lines(level_parts(d)))
    return joins.agg(F.count(F.lit(1)).alias("joins"), F.round(F.sum("dist_m"), 2).alias("metres"))


CTES["gap_limit"] = """
SELECT session_id, step_no, p_lat, p_lon, lat AS e_lat, lon AS e_lon, d AS straight, dt AS seconds,
       greatest(d * 2.25, d + 250) AS most FROM gapx"""
# Every way without repeated nodes that can still be short enough.
CTES["ways_on"] = """
SELECT h.session_id, h.step_no, h.no AS start_no, h.snap AS start_snap, h.node, h.h AS dist, [h.node] AS passed FROM hook h WHERE side = 0
UNION ALL
SELECT w.session_id, w.step_no, w.start_no, w.start_snap, a.b, w.dist + a.len, list_append(w.passed, a.b)
FROM ways_on w JOIN adj a ON a.a = w.node
JOIN gap_limit g ON g.session_id = w.session_id AND g.step_no = w.step_no
WHERE NOT list_contains(w.passed, a.b)
  AND w.start_snap + w.dist + a.len + {hav:CAST(split_part(a.b, ':', 1) AS DOUBLE) / 1e6|CAST(split_part(a.b, ':', 2) AS DOUBLE) / 1e6|g.e_lat|g.e_lon} <= g.most + 0.000001"""
CTES["all_routes"] = """
SELECT w.session_id, w.step_no, start_no, e.no AS end_no, start_snap, e.snap AS end_snap, dist + e.h AS street, len(passed) AS nodes
FROM ways_on w JOIN hook e ON e.session_id = w.session_id AND e.step_no = w.step_no AND e.side = 1 AND e.node = w.node
UNION ALL
SELECT s.session_id, s.step_no, s.no, e.no, s.snap, e.snap, {hav:s.s_lat|s.s_lon|e.s_lat|e.s_lon}, 0
FROM sn s JOIN sn e ON e.session_id = s.session_id AND e.step_no = s.step_no AND s.side = 0 AND e.side = 1 AND s.ek = e.ek"""
CTES["bridged"] = """
SELECT r.*, start_snap + street + end_snap AS route, g.straight FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, step_no ORDER BY round(start_snap + street + end_snap, 6), start_no, end_no, nodes) AS best
  FROM all_routes) r
JOIN gap_limit g ON g.session_id = r.session_id AND g.step_no = r.step_no
WHERE best = 1 AND start_snap + street + end_snap <= most AND (seconds <= 0 OR street / seconds <= 4)"""


@query("joi11_bridged_gaps", """
SELECT session_id, step_no, round(route, 3) AS route_m, round(start_snap, 3) AS start_snap_m, round(end_snap, 3) AS end_snap_m,
       CASE WHEN start_snap <= 12 AND end_snap <= 12 AND route <= greatest(straight * 1.35, straight + 60) THEN 'high'
            ELSE 'medium' END AS confidence FROM bridged""")
def _(d):
    out = routing.bridge_gaps(gaps(d), d.streets)
    return out.select("session_id", "step_no", F.round("route_m", 3).alias("route_m"),
                      F.round("start_snap_m", 3).alias("start_snap_m"), F.round("end_snap_m", 3).alias("end_snap_m"), "confidence")


@query("joi11_route_nodes", "SELECT session_id, step_no, nodes FROM bridged")
def _(d):
    """How many street vertices each route passes, found back through the vertices before."""
    return routing.bridge_gaps(gaps(d), d.streets).select("session_id", "step_no", F.size("path").alias("nodes"))


@query("job1_frozen_routes")
def _(d):
    lines = jobs.freeze_routes(d.points, d.streets).lines
    return lines.groupBy("owner_id", "session_id", "type").agg(F.count(F.lit(1)).alias("lines"))


CENTRES = {
    "ptn": "SELECT *, point_index + 1 AS k FROM pts",
    "cen": """
SELECT session_id, k, lat AS c_lat, lon AS c_lon, true AS kept FROM ptn WHERE k = 1
UNION ALL
SELECT p.session_id, p.k, CASE WHEN {hav:c.c_lat|c.c_lon|p.lat|p.lon} >= 100 THEN p.lat ELSE c.c_lat END,
       CASE WHEN {hav:c.c_lat|c.c_lon|p.lat|p.lon} >= 100 THEN p.lon ELSE c.c_lon END, {hav:c.c_lat|c.c_lon|p.lat|p.lon} >= 100
FROM cen c JOIN ptn p ON p.session_id = c.session_id AND p.k = c.k + 1""",
}


@query("seq2_path_centres", """
SELECT session_id, k - 1 AS point_index FROM cen c
WHERE kept OR k = (SELECT max(k) FROM ptn p WHERE p.session_id = c.session_id)""", CENTRES)
def _(d):
    return clean.spaced_points(d.points, 100.0).select("session_id", "point_index")


@query("seq3_simplified_chunks")
def _(d):
    chunks = paths.chunk_vertices(d.points)
    return simplify.simplify_chunks(chunks, 1.0).select("session_id", "run_no", "chunk_no", "point_index")


@query("win10_preview_points")
def _(d):
    return simplify.preview_points(d.points).select("session_id", "point_index", "preview_index")


@query("joi17_corridor_streets", """
SELECT DISTINCT c.session_id, s.id AS segment_id FROM (
  SELECT p.session_id, p.lat, p.lon FROM ptn p WHERE p.k = 1 OR p.k = (SELECT max(k) FROM ptn q WHERE q.session_id = p.session_id)) c
JOIN streets s ON greatest(lat1, lat2) >= c.lat - 450 / 111320.0 AND least(lat1, lat2) <= c.lat + 450 / 111320.0
  AND greatest(lon1, lon2) >= c.lon - 450 / (111320.0 * cos(radians(c.lat)))
  AND least(lon1, lon2) <= c.lon + 450 / (111320.0 * cos(radians(c.lat)))""", CENTRES)
def _(d):
    """The derived walks never get 250 m from their start, so the centres are first and last points."""
    return corridors.corridor_streets(d.points, d.streets).select("session_id", "segment_id")


@query("joi18_gaps_to_fetch", """
SELECT session_id, step_no FROM (SELECT *, (p_lat + lat) / 2 AS m_lat, (p_lon + lon) / 2 AS m_lon FROM gapx) g
WHERE NOT EXISTS (SELECT 1 FROM streets s WHERE CAST(split_part(s.street_id, '/', 2) AS BIGINT) % 3 = 0
  AND greatest(lat1, lat2) >= m_lat - 70 / 111320.0 AND least(lat1, lat2) <= m_lat + 70 / 111320.0
  AND greatest(lon1, lon2) >= m_lon - 70 / (111320.0 * cos(radians(m_lat)))
  AND least(lon1, lon2) <= m_lon + 70 / (111320.0 * cos(radians(m_lat))))""")
def _(d):
    """Only every third way has been fetched lately."""
    way = F.regexp_extract("id", "^way/([^/]+)", 1).cast("long")
    dated = d.streets.withColumn("fetched_at", F.timestamp_seconds(F.when(way % 3 == 0, 9000000).otherwise(0)))
    return corridors.gaps_to_fetch(gaps(d), dated, F.timestamp_seconds(F.lit(9000000))).select("session_id", "step_no")


@query("joi18_samples_to_fetch", """
SELECT session_id, k - 1 AS point_index FROM ptn c
WHERE (k = 1 OR k = (SELECT max(k) FROM ptn p WHERE p.session_id = c.session_id))
  AND NOT EXISTS (SELECT 1 FROM streets s WHERE CAST(split_part(s.street_id, '/', 2) AS BIGINT) // 10 % 10 = 0
  AND greatest(lat1, lat2) >= c.lat - 175 / 111320.0 AND least(lat1, lat2) <= c.lat + 175 / 111320.0
  AND greatest(lon1, lon2) >= c.lon - 175 / (111320.0 * cos(radians(c.lat)))
  AND least(lon1, lon2) <= c.lon + 175 / (111320.0 * cos(radians(c.lat))))""", CENTRES)
def _(d):
    """Only the ways of every tenth walker have been fetched lately."""
    user = F.floor(F.regexp_extract("id", "^way/([^/]+)", 1).cast("long") / 10)
    dated = d.streets.withColumn("fetched_at", F.timestamp_seconds(F.when(user % 10 == 0, 9000000).otherwise(0)))
    return corridors.samples_to_fetch(d.points, dated, as_of=F.timestamp_seconds(F.lit(9000000))).select(
        "session_id", "point_index")


@query("joi21_parts_in_corridors", """
SELECT DISTINCT id FROM (
  SELECT id, (a_lon - lon) * sc AS px, (a_lat - lat) * 111320.0 AS py, (b_lon - lon) * sc AS qx, (b_lat - lat) * 111320.0 AS qy,
         a_lat = b_lat AND a_lon = b_lon AS lone, {hav:lat|lon|a_lat|a_lon} AS far
  FROM (SELECT id, lat1 + (lat2 - lat1) * 0.5 AS lat, lon1 + (lon2 - lon1) * 0.5 AS lon,
               greatest(1.0, 111320.0 * cos(radians(lat1 + (lat2 - lat1) * 0.5))) AS sc FROM streets) s
  JOIN (SELECT DISTINCT arg_min(lat, k) AS a_lat, arg_min(lon, k) AS a_lon, arg_max(lat, k) AS b_lat, arg_max(lon, k) AS b_lon
        FROM ptn GROUP BY session_id) c ON abs(s.lat - c.a_lat) < 0.02 AND abs(s.lon - c.a_lon) < 0.02)
WHERE CASE WHEN lone THEN far ELSE sqrt(
    pow(px + (qx - px) * greatest(0, least(1, -(px * (qx - px) + py * (qy - py)) / nullif(pow(qx - px, 2) + pow(qy - py, 2), 0))), 2)
  + pow(py + (qy - py) * greatest(0, least(1, -(px * (qx - px) + py * (qy - py)) / nullif(pow(qx - px, 2) + pow(qy - py, 2), 0))), 2)
  ) END <= 250""", CENTRES)
def _(d):
    """Street parts within 250 m of the walkers' paths, whose centres are their first and last points."""
    lines = corridors.corridor_lines(d.points)
    mid = osm.midpoint()
    spots = d.streets.select("id", mid["lat"].alias("lat"), mid["lon"].alias("lon"))
    return corridors.within_corridors(spots, lines, corridors.REPAIR_M, ["id"]).select("id")
