"""Queries on streets and their completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmesh.catalog.cells import walked
from trailmesh.catalog.registry import query
from trailmesh.operators import loops, sets, streets
from trailmesh.sources import osm



def coverage(d):
    return streets.street_coverage(d.steps.filter("kind = 'confirmed'"), d.streets)


COVER = {
    "rl": """
SELECT session_id, owner_id, step_no, fx, fy, tx - fx AS rx, ty - fy AS ry, {hyp:tx - fx|ty - fy} AS len FROM (
  SELECT *, {planx:p_lon|45.75} AS fx, {plany:p_lat} AS fy, {planx:lon|45.75} AS tx, {plany:lat} AS ty
  FROM steps WHERE reason IS NULL)""",
    "smp": """
SELECT session_id, owner_id, step_no, i, fx + rx * (i / n) AS x, fy + ry * (i / n) AS y, rx / len AS ux, ry / len AS uy
FROM (SELECT *, greatest(1, CAST(ceil(len / 3) AS INT)) AS n FROM rl WHERE len >= 1.5),
     LATERAL (SELECT unnest(range(0, n + 1)) AS i)""",
    "sl": """
SELECT id, street_id, len AS total_m, greatest(1, CAST(ceil(len / 4) AS INT)) AS bins,
       {planx:lon1|45.75} AS ax, {plany:lat1} AS ay, {planx:lon2|45.75} AS bx, {plany:lat2} AS by_
FROM walkable""",
    "slb": """
SELECT s.*, {hyp:bx - ax|by_ - ay} AS pl, gx.g AS gx, gy.g AS gy FROM sl s,
  LATERAL (SELECT unnest(range(CAST(floor((least(ax, bx) - 12) / 20) AS BIGINT), CAST(floor((greatest(ax, bx) + 12) / 20) AS BIGINT) + 1)) AS g) gx,
  LATERAL (SELECT unnest(range(CAST(floor((least(ay, by_) - 12) / 20) AS BIGINT), CAST(floor((greatest(ay, by_) + 12) / 20) AS BIGINT) + 1)) AS g) gy""",
    "met": """
SELECT *, {hyp:x - (ax + t * (bx - ax))|y - (ay + t * (by_ - ay))} AS dist FROM (
  SELECT *, {prog:x|y|ax|ay|bx|by_} AS t FROM smp JOIN slb
    ON slb.gx = CAST(floor(x / 20) AS BIGINT) AND slb.gy = CAST(floor(y / 20) AS BIGINT))
WHERE abs(ux * (bx - ax) / pl + uy * (by_ - ay) / pl) >= cos(radians(50))""",
    "hit": """
SELECT session_id, owner_id, id, street_id, total_m, bins,
       least(bins - 1, CAST(floor(t * pl / greatest(0.001, total_m) * bins) AS INT)) AS bin FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, step_no, i ORDER BY round(dist, 6), id) AS r FROM met WHERE dist <= 12)
WHERE r = 1""",
    "cov": """
SELECT owner_id, session_id, id, street_id, total_m, bins, count(DISTINCT bin) AS n,
       string_agg(DISTINCT CAST(bin AS VARCHAR), ',' ORDER BY CAST(bin AS VARCHAR)) AS list
FROM hit GROUP BY ALL""",
    "prg": """
SELECT owner_id, id, street_id, total_m, bins, count(DISTINCT bin) AS n,
       least(total_m, count(DISTINCT bin) / bins * total_m) AS walked_m FROM hit
GROUP BY owner_id, id, street_id, total_m, bins""",
    "stt": "SELECT street_id, sum(len) AS total_m, count(*) AS parts FROM walkable GROUP BY street_id",
    "sst": """
SELECT p.owner_id, p.street_id, sum(p.walked_m) AS walked_m, any_value(s.total_m) AS total_m,
       sum(p.walked_m) >= any_value(s.total_m) * 0.9 AS is_complete
FROM prg p JOIN stt s ON s.street_id = p.street_id GROUP BY p.owner_id, p.street_id""",
}


@query("joi6_street_coverage", """
SELECT session_id, id AS segment_id, n AS covered_bins, list AS bins, round(total_m, 3) AS total_m FROM cov""", COVER)
def _(d):
    text = F.transform("bins", lambda b: b.cast("string"))
    return coverage(d).select(
        "session_id", "segment_id", F.size("bins").alias("covered_bins"), F.array_join(F.array_sort(text), ",").alias("bins"),
        F.round("total_m", 3).alias("total_m"))


@query("agg7_segment_progress", """
SELECT owner_id, id AS segment_id, n AS covered_bins, round(walked_m, 3) AS walked_m,
       least(100, floor(walked_m / total_m * 1000 + 0.5) / 10) AS percent FROM prg""", COVER)
def _(d):
    return streets.segment_progress(coverage(d)).select(
        "owner_id", "segment_id", "covered_bins", F.round("walked_m", 3).alias("walked_m"), "percent")


@query("agg6_street_states", """
SELECT owner_id, street_id, round(walked_m, 3) AS walked_m, round(total_m, 3) AS total_m, is_complete FROM sst""", COVER)
def _(d):
    states = streets.street_states(streets.segment_progress(coverage(d)), d.streets)
    return states.withColumns({c: F.round(c, 3) for c in ("walked_m", "total_m")})


@query("agg6_street_summary", """
SELECT s.owner_id, round(sum(walked_m), 3) AS explored_m, count(*) AS explored_streets,
       count(CASE WHEN is_complete THEN 1 END) AS completed_streets, round(any_value(t.m), 2) AS loaded_m,
       any_value(t.n) AS loaded_streets, floor(sum(walked_m) / any_value(t.m) * 1000 + 0.5) / 10 AS percent
FROM sst s, (SELECT sum(total_m) AS m, count(*) AS n FROM stt) t GROUP BY s.owner_id""", COVER)
def _(d):
    states = streets.street_states(streets.segment_progress(coverage(d)), d.streets)
    return streets.street_summary(states, d.streets).withColumns(
        {"explored_m": F.round("explored_m", 3), "loaded_m": F.round("loaded_m", 2)})


@query("agg8_completion_times", """
SELECT owner_id, street_id, is_complete,
       CASE WHEN owner_id % 2 = 0 AND street_id LIKE '%1' THEN 1000 WHEN is_complete THEN 9999999 END AS completed_s
FROM sst""", COVER)
def _(d):
    states = streets.street_states(streets.segment_progress(coverage(d)), d.streets)
    stored = states.filter("owner_id % 2 = 0 AND street_id LIKE '%1'").select(
        "owner_id", "street_id", F.timestamp_seconds(F.lit(1000)).alias("completed_at"))
    out = streets.with_completion_time(states, stored, F.timestamp_seconds(F.lit(9999999)))
    return out.select("owner_id", "street_id", "is_complete", F.unix_seconds("completed_at").alias("completed_s"))


@query("joi7_legacy_matches", """
SELECT DISTINCT owner_id, id AS segment_id FROM (
  SELECT p.owner_id, w.id, p.lat AS la, {planx:p.lon|p.lat} AS x, {plany:p.lat} AS y, {planx:w.lon1|p.lat} AS ax,
         {plany:w.lat1} AS ay, {planx:w.lon2|p.lat} AS bx, {plany:w.lat2} AS by_
  FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY t_s) - 1 AS k,
               count(*) OVER (PARTITION BY owner_id) AS n FROM pts) p
  JOIN walkable w ON abs(w.lat1 - p.lat) < 0.0005 AND abs(w.lon1 - p.lon) < 0.0006
  WHERE n < 50 OR k % 3 = 0)
WHERE round({hyp:x - (ax + {prog:x|y|ax|ay|bx|by_} * (bx - ax))|y - (ay + {prog:x|y|ax|ay|bx|by_} * (by_ - ay))}, 6) <= 12""")
def _(d):
    return streets.legacy_matches(d.points, d.streets)


@query("flt3_streets_near", """
SELECT id FROM streets WHERE greatest(lat1, lat2) >= 45.7525 - 300 / 111320.0 AND least(lat1, lat2) <= 45.7525 + 300 / 111320.0
  AND greatest(lon1, lon2) >= 4.81 - 300 / (111320.0 * cos(radians(45.7525)))
  AND least(lon1, lon2) <= 4.81 + 300 / (111320.0 * cos(radians(45.7525)))""")
def _(d):
    return streets.near_streets(d.streets, 45.7525, 4.81, 300.0).select("id")


@query("flt4_walkability", """
SELECT id, routable, walkable, for_loops FROM (SELECT id,
    highway <> 'motorway' AND foot NOT IN ('no', 'private', 'use_sidepath')
      AND NOT (access IN ('no', 'private') AND foot NOT IN ('designated', 'permissive', 'yes')) AS routable,
    highway <> 'motorway' AND foot NOT IN ('no', 'private')
      AND NOT (access IN ('no', 'private') AND foot NOT IN ('designated', 'permissive', 'yes')) AS walkable,
    highway = 'residential' AS for_loops
  FROM (SELECT id, highway, CASE k % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'use_sidepath' WHEN 3 THEN 'private' ELSE '' END AS foot,
               CASE k % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'no' ELSE '' END AS access
        FROM (SELECT *, CAST(round(lat1 * 1e6) AS BIGINT) // 100 AS k FROM streets)))""")
def _(d):
    k = F.floor(F.round(F.col("coords")[0]["lat"] * 1e6) / 100)
    tagged = d.streets.withColumns({
        "foot": F.when(k % 5 == 0, "No").when(k % 5 == 1, "yes").when(k % 5 == 2, "use_sidepath").when(k % 5 == 3, "PRIVATE"),
        "access": F.when(k % 3 == 0, "private").when(k % 3 == 1, "no")})
    return tagged.select("id", streets.is_routable().alias("routable"), streets.is_walkable().alias("walkable"),
                         streets.counts_for_loops().alias("for_loops"))


WAYS = {
    "way": """
SELECT user_id * 10 + k AS id, k, [(0, 0), (4, 0), (4, 10), (10, 10)] AS v, lat0, lon0
FROM origins CROSS JOIN (SELECT r_regionkey AS k FROM region WHERE r_regionkey < 3) r""",
    "edge": """
SELECT id, k, i, (lat0 + 100 * v[i][2] + 40 * k) / 1e6 AS a_lat, (lon0 + 143 * v[i][1]) / 1e6 AS a_lon,
       (lat0 + 100 * v[i + 1][2] + 40 * k) / 1e6 AS b_lat, (lon0 + 143 * v[i + 1][1]) / 1e6 AS b_lon
FROM way, LATERAL (SELECT unnest([1, 2, 3]) AS i)""",
    "piece": """
SELECT *, s / n AS f, (s + 1) / n AS g FROM (SELECT *, greatest(1, CAST(ceil({hav:a_lat|a_lon|b_lat|b_lon} / 35) AS INT)) AS n FROM edge),
  LATERAL (SELECT unnest(range(0, n)) AS s)""",
}


def ways(d):
    """Ways of four vertices along and across each square, with a few tags."""
    origins = d.table("events").select("user_id").distinct()
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    base = origins.withColumn("k", k)
    u = F.col("user_id")
    lat0 = F.lit(45750000) + F.floor(u / 25).cast("long") * 1500
    lon0 = F.lit(4800000) + (u % 25) * 2200

    def at(x: int, y: int):
        return F.struct(((lat0 + 100 * y + 40 * F.col("k")) / 1e6).alias("lat"), ((lon0 + 143 * x) / 1e6).alias("lon"))

    tags = F.create_map(
        F.lit("highway"), F.lit("residential"), F.lit("name"), F.concat(F.lit("Rue "), u.cast("string")),
        F.lit("bridge"), F.when(F.col("k") == 1, "yes").otherwise("no"),
        F.lit("tunnel"), F.when(F.col("k") == 2, "1").otherwise("no"),
        F.lit("layer"), F.when(u % 3 == 0, "2").when(u % 3 == 1, "-1").otherwise("x"))
    return base.select(F.lit("way").alias("type"), (u * 10 + F.col("k")).alias("id"), tags.alias("tags"),
                       F.array(at(0, 0), at(4, 0), at(4, 10), at(10, 10)).alias("geometry"))


@query("src3_way_parts", """
SELECT concat('way/', CAST(id AS VARCHAR), '/part/', CAST(row_number() OVER (PARTITION BY id ORDER BY i, s) - 1 AS VARCHAR)) AS id,
       round(a_lat + (b_lat - a_lat) * f, 7) AS lat1, round(a_lon + (b_lon - a_lon) * f, 7) AS lon1,
       round(a_lat + (b_lat - a_lat) * g, 7) AS lat2, round(a_lon + (b_lon - a_lon) * g, 7) AS lon2 FROM piece""", WAYS)
def _(d):
    parts = osm.way_parts(ways(d), F.timestamp_seconds(F.lit(0)))
    c = F.col("coords")
    return parts.select("id", F.round(c[0]["lat"], 7).alias("lat1"), F.round(c[0]["lon"], 7).alias("lon1"),
                        F.round(c[1]["lat"], 7).alias("lat2"), F.round(c[1]["lon"], 7).alias("lon2"))


@query("src3_parts_in_radius", """
SELECT count(*) AS parts, count(DISTINCT id) AS ways FROM (
  SELECT id, a_lat + (b_lat - a_lat) * (f + g) / 2 AS m_lat, a_lon + (b_lon - a_lon) * (f + g) / 2 AS m_lon FROM piece)
WHERE {hav:45.7525|4.81|m_lat|m_lon} <= 450""", WAYS)
def _(d):
    near = osm.within_radius(osm.way_parts(ways(d), F.timestamp_seconds(F.lit(0))), 45.7525, 4.81, 450.0)
    return near.agg(F.count(F.lit(1)).alias("parts"),
                    F.countDistinct(F.regexp_extract("id", "^(way/[^/]+)", 1)).alias("ways"))


@query("flt7_topology_tags", """
SELECT id, k = 1 AS bridge, k = 2 AS tunnel,
       CASE (id // 10) % 3 WHEN 0 THEN 2 WHEN 1 THEN -1 ELSE CASE k WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END END AS layer
FROM way""", WAYS)
def _(d):
    parts = osm.way_parts(ways(d), F.timestamp_seconds(F.lit(0)))
    way = F.regexp_extract("id", "^way/([^/]+)", 1).cast("long").alias("id")
    return parts.select(way, "bridge", "tunnel", "layer").distinct()


@query("set6_upsert_streets", """
SELECT id, CASE WHEN user_id % 3 = 0 THEN concat('New ', id) ELSE coalesce(name, '') END AS name FROM (
  SELECT *, CAST(split_part(street_id, '/', 2) AS BIGINT) // 10 AS user_id FROM streets)""")
def _(d):
    user = F.floor(F.regexp_extract("id", "^way/([^/]+)", 1).cast("long") / 10)
    arrived = d.streets.filter(user % 3 == 0).withColumns({
        "name": F.concat(F.lit("New "), F.col("id")), "fetched_at": F.timestamp_seconds(F.lit(100))})
    merged = sets.upsert(d.streets, arrived, ["id"], [F.col("fetched_at")])
    return merged.select("id", F.coalesce("name", F.lit("")).alias("name"))


@query("agg18_loop_streets")
def _(d):
    """Street metres inside each enclosed area, walked parts excluded in the second sum."""
    cells = walked(d).select("owner_id", "cell_x", "cell_y").distinct()
    groups, _members = loops.loop_groups(cells, ["owner_id"])
    seen = streets.segment_progress(coverage(d)).filter("walked_m >= 0.5 * total_m")
    out = streets.loop_street_lengths(groups, d.streets, seen, ["owner_id", *loops.GROUP])
    return out.select("owner_id", "kind", "cells", "accepted", F.round("total_len_m", 3).alias("total_len_m"),
                      F.round("unwalked_len_m", 3).alias("unwalked_len_m"))
