"""Queries on fixes, points, steps and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmesh.catalog.registry import query
from trailmesh.operators import clean, paths


def t_s():
    return F.unix_seconds("ts").alias("t_s")


@query("win2_best_observations", """
SELECT session_id, t_s, observation_id, accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, t_s ORDER BY accuracy NULLS LAST, observation_id) AS r
  FROM (SELECT session_id, t_s - t_s % 20 AS t_s, observation_id, CAST(accuracy AS DOUBLE) AS accuracy FROM obs))
WHERE r = 1""")
def _(d):
    coarse = d.observations.withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") - F.unix_seconds("ts") % 20))
    return clean.best_observations(coarse).select("session_id", t_s(), "observation_id", "accuracy")


@query("win3_merge_observations", """
SELECT session_id, t_s, observation_id, accuracy, change, requires_rebuild FROM (
  SELECT a.*, CASE WHEN stored THEN 'kept' WHEN had THEN 'improved' ELSE 'inserted' END AS change,
         (NOT stored) AND coalesce(t_s <= newest, false) AS requires_rebuild
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id, t_s
                    ORDER BY coalesce(accuracy, 1e9), CASE WHEN stored THEN 0 ELSE 1 END, observation_id) AS r,
               max(CASE WHEN stored THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, t_s) = 1 AS had,
               max(CASE WHEN stored THEN t_s END) OVER (PARTITION BY session_id) AS newest
        FROM (SELECT session_id, t_s - t_s % 10 AS t_s, observation_id, CAST(accuracy AS DOUBLE) AS accuracy,
                     observation_id % 2 = 0 AS stored FROM obs)) a WHERE r = 1)""")
def _(d):
    coarse = d.observations.withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") - F.unix_seconds("ts") % 10))
    merged = clean.merge_observations(
        coarse.filter("observation_id % 2 = 0"), coarse.filter("observation_id % 2 = 1")
    )
    return merged.select("session_id", t_s(), "observation_id", "accuracy", "change", "requires_rebuild")


@query("win4_lowest_id", """
SELECT session_id, t_s, min(observation_id) AS observation_id
FROM (SELECT session_id, t_s - t_s % 15 AS t_s, observation_id FROM obs) GROUP BY session_id, t_s""")
def _(d):
    coarse = d.observations.withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") - F.unix_seconds("ts") % 15))
    return clean.first_by_id(coarse, id_column="observation_id").select("session_id", t_s(), "observation_id")


@query("flt5_trustworthy_fixes", """
SELECT session_id, count(*) AS valid_fixes, count(CASE WHEN accuracy <= 30 THEN 1 END) AS trustworthy_fixes
FROM obs WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 GROUP BY session_id""")
def _(d):
    return d.observations.filter(clean.is_valid_fix()).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("valid_fixes"), F.count_if(clean.is_trustworthy_fix()).alias("trustworthy_fixes")
    )


@query("seq1_canonical_points", """
SELECT owner_id, session_id, point_index, t_s, observation_id, round(speed, 4) AS speed_mps FROM pts""")
def _(d):
    return d.points.select(
        "owner_id", "session_id", "point_index", t_s(), "observation_id", F.round("speed_mps", 4).alias("speed_mps")
    )


@query("agg12_fix_counters", """
SELECT owner_id, session_id, count(CASE WHEN verdict = 'accepted' THEN 1 END) AS accepted_fixes,
       count(CASE WHEN verdict IN ('jump', 'stale') THEN 1 END) AS rejected_fixes,
       count(CASE WHEN verdict = 'weak' THEN 1 END) AS paused_fixes,
       arg_max(CASE WHEN verdict = 'weak' THEN concat('GPS signal weak (', CAST(accuracy AS VARCHAR),
                        ' m); recording paused until GPS returns')
                    WHEN verdict = 'jump' THEN concat('Jump ignored: ',
                        CAST(CAST(floor(speed * 3.6 + 0.5) AS BIGINT) AS VARCHAR), ' km/h')
                    WHEN verdict = 'accepted' THEN '' END, t_s) AS last_reason
FROM verdicts GROUP BY owner_id, session_id""")
def _(d):
    return clean.fix_counters(d.verdicts).withColumn("last_reason", F.coalesce("last_reason", F.lit("")))


@query("jo22_flag_observations", """
SELECT o.observation_id, o.session_id, true AS processed, p.observation_id IS NOT NULL AS accepted
FROM obs o LEFT JOIN pts p ON p.session_id = o.session_id AND p.t_s = o.t_s""")
def _(d):
    return clean.flag_observations(d.observations, d.points).select(
        "observation_id", "session_id", "processed", "accepted"
    )


@query("agg17_generation", """
SELECT owner_id, session_id, count(*) AS row_count, max(observation_id) AS max_id FROM obs GROUP BY ALL""")
def _(d):
    return clean.generation(d.observations)


@query("set8_changed_sequences", """
SELECT coalesce(a.session_id, b.session_id) AS session_id,
       NOT bool_and(coalesce(a.t_s = b.t_s AND a.observation_id = b.observation_id, false)) AS changed
FROM pts a FULL JOIN (SELECT * FROM pts WHERE NOT (session_id % 5 = 0 AND point_index > 20)) b
  ON a.session_id = b.session_id AND a.point_index = b.point_index GROUP BY 1""")
def _(d):
    stored = d.points.filter("NOT (session_id % 5 = 0 AND point_index > 20)")
    return clean.sequences_changed(stored, d.points).select("session_id", "changed")


@query("win1_steps", """
SELECT owner_id, session_id, step_no, round(d, 3) AS distance_m, CAST(dt AS DOUBLE) AS seconds,
       CASE WHEN reason IS NULL THEN 'confirmed' ELSE 'gap' END AS kind, coalesce(reason, '') AS reason
FROM steps""")
def _(d):
    return d.steps.select(
        "owner_id", "session_id", "step_no", F.round("distance_m", 3).alias("distance_m"), "seconds", "kind",
        F.coalesce("reason", F.lit("")).alias("reason"),
    )


@query("agg9_path_lengths", """
SELECT owner_id, session_id, points, round(distance_m, 3) AS distance_m FROM lens""")
def _(d):
    return paths.path_lengths(d.points).withColumn("distance_m", F.round("distance_m", 3))


RUNS = {
    "runs": """
SELECT p.*, sum(CASE WHEN s.reason IS NOT NULL THEN 1 ELSE 0 END)
         OVER (PARTITION BY p.session_id ORDER BY p.point_index) AS run_no
FROM pts p LEFT JOIN steps s ON s.session_id = p.session_id AND s.step_no = p.point_index"""
}


@query("win5_route_chunks", """
SELECT owner_id, session_id, run_no, chunk_no, count(*) AS vertices, min(point_index) AS first_index,
       max(point_index) AS last_index
FROM (SELECT *, unnest(CASE WHEN pos % 255 = 0 AND pos > 0 AND pos = n - 1 THEN [pos // 255 - 1]
                            WHEN pos % 255 = 0 AND pos > 0 THEN [pos // 255 - 1, pos // 255]
                            ELSE [pos // 255] END) AS chunk_no
      FROM (SELECT *, row_number() OVER (PARTITION BY session_id, run_no ORDER BY point_index) - 1 AS pos,
                   count(*) OVER (PARTITION BY session_id, run_no) AS n FROM runs) WHERE n > 1)
GROUP BY owner_id, session_id, run_no, chunk_no""", RUNS)
def _(d):
    return paths.chunk_vertices(d.points).groupBy("owner_id", "session_id", "run_no", "chunk_no").agg(
        F.count(F.lit(1)).alias("vertices"), F.min("point_index").alias("first_index"),
        F.max("point_index").alias("last_index"),
    )


@query("win7_movement", """
SELECT session_id, step_no, round(b, 3) AS bearing_deg, round(d / dt, 4) AS speed_mps,
       CASE WHEN b >= 45 AND b < 135 THEN 'east' WHEN b >= 135 AND b < 225 THEN 'south'
            WHEN b >= 225 AND b < 315 THEN 'west' ELSE 'north' END AS direction
FROM (SELECT *, CASE WHEN b0 < 0 THEN b0 + 360 ELSE b0 END AS b FROM (
  SELECT *, degrees(atan2(sin(radians(lon) - radians(p_lon)) * cos(radians(lat)),
    cos(radians(p_lat)) * sin(radians(lat))
    - sin(radians(p_lat)) * cos(radians(lat)) * cos(radians(lon) - radians(p_lon)))) AS b0 FROM steps))""")
def _(d):
    return paths.movement(d.points).select(
        "session_id", "step_no", F.round("bearing_deg", 3).alias("bearing_deg"),
        F.round("speed_mps", 4).alias("speed_mps"), "direction",
    )


@query("win8_live_tail", """
SELECT session_id, point_index, t_s FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_s DESC) AS r FROM pts) WHERE r <= 10""")
def _(d):
    return paths.live_tail(d.points, limit=10).select("session_id", "point_index", t_s())


@query("win8_last_points", """
SELECT p.session_id, p.point_index, p.t_s, round(coalesce(s.d / s.dt, 0), 4) AS last_speed_mps
FROM pts p LEFT JOIN steps0 s ON s.session_id = p.session_id AND s.step_no = p.point_index
WHERE p.point_index = (SELECT max(point_index) FROM pts q WHERE q.session_id = p.session_id)""")
def _(d):
    speeds = paths.last_speeds(d.points)
    return paths.last_points(d.points).join(speeds, ["owner_id", "session_id"], "left").select(
        "session_id", "point_index", t_s(),
        F.round(F.coalesce("last_speed_mps", F.lit(0.0)), 4).alias("last_speed_mps"),
    )


@query("win8_points_after", "SELECT session_id, point_index FROM pts WHERE point_index > 20")
def _(d):
    return paths.points_after(d.points, 20).select("session_id", "point_index")


@query("agg22_bounds", """
SELECT session_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon
FROM pts GROUP BY session_id""")
def _(d):
    return paths.bounds(d.points).drop("owner_id")


@query("win6_drawable_lines", """
SELECT owner_id, session_id, count(*) AS pieces, min(vertices) AS fewest, max(vertices) AS most FROM (
  SELECT owner_id, session_id, g, count(*) + 1 AS vertices FROM (
    SELECT *, sum(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY step_no) AS g FROM steps)
  WHERE reason IS NULL GROUP BY owner_id, session_id, g)
GROUP BY owner_id, session_id""")
def _(d):
    """Stored confirmed steps as drawable lines; the derived runs are all shorter than 256 vertices."""
    confirmed = d.steps.filter("kind = 'confirmed'")
    after = confirmed.select("owner_id", "session_id", (F.col("step_no") + 1).alias("step_no"), F.lit(True).alias("_had"))
    segments = confirmed.join(after, ["owner_id", "session_id", "step_no"], "left").select(
        "owner_id", "session_id", F.col("step_no").alias("seg_no"), F.lit("confirmed").alias("type"),
        F.lit(2).alias("vertices"), F.col("_had").isNotNull().alias("joined"))
    lines = paths.drawable_lines(segments).groupBy("owner_id", "session_id", "line_no").agg(
        (F.sum(F.col("vertices") - 1) + 1).alias("vertices"))
    return lines.groupBy("owner_id", "session_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.min("vertices").alias("fewest"), F.max("vertices").alias("most"))
