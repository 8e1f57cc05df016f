"""Queries on recordings and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmesh.catalog.cells import explored, route_lines, walked
from trailmesh.catalog.registry import query
from trailmesh.operators import clean, grid, paths, position, quality, sessions, stats

R = ["owner_id", "session_id"]

def as_of():
    return F.timestamp_seconds(F.lit(5110000))



def recordings(d):
    """Sessions with distance, point count and duration."""
    lengths = paths.path_lengths(d.points)
    return d.sessions.join(lengths, R, "left").fillna(0, ["distance_m", "points"]).withColumn(
        "duration_s", F.unix_seconds("ended_at") - F.unix_seconds("started_at"))


def final_recordings(d):
    return sessions.finalized(recordings(d), d.discards)


@query("flt1_finalized", "SELECT owner_id, session_id FROM final_sess")
def _(d):
    return sessions.finalized(d.sessions, d.discards).select(*R)


@query("flt2_scope_today", """
SELECT session_id FROM sess WHERE end_s > 5110000 - 5110000 % 86400 AND start_s < 5110000 - 5110000 % 86400 + 86400""")
def _(d):
    return sessions.display_scope(d.sessions, "today", as_of()).select("session_id")


@query("flt2_scope_last7", "SELECT session_id FROM sess WHERE start_s >= 5110000 - 7 * 86400")
def _(d):
    return sessions.display_scope(d.sessions, "last7", as_of()).select("session_id")


@query("flt2_scope_selected", "SELECT session_id FROM sess WHERE session_id = 701")
def _(d):
    return sessions.display_scope(d.sessions, "selected", as_of(), selected=701).select("session_id")


@query("asf2_overlap_local_day", """
SELECT session_id FROM sess WHERE end_s > 5094000 AND start_s < 5094000 + 86400""")
def _(d):
    """The local day in a zone one hour east of UTC in winter."""
    return sessions.scope_overlap(d.sessions, *sessions.local_day(as_of(), "Europe/Paris")).select("session_id")


FIXES = {
    "loose": """
SELECT owner_id, observation_id AS fix_id, t_s - CASE WHEN observation_id % 7 = 0 THEN 3000 ELSE 0 END AS t_s,
       CASE WHEN observation_id % 3 = 0 THEN session_id WHEN observation_id % 3 = 1 THEN session_id + 1 END AS preferred,
       observation_id % 3 = 2 OR observation_id % 5 = 0 AS fallback, (observation_id % 2) * 600 AS age
FROM obs""",
    "hits": """
SELECT l.fix_id, count(*) AS n, min(s.session_id) AS only_one,
       max(CASE WHEN s.session_id = l.preferred THEN s.session_id END) AS pref
FROM loose l JOIN sess s ON s.owner_id = l.owner_id AND l.t_s >= s.start_s AND (s.end_s = s.start_s OR l.t_s <= s.end_s)
GROUP BY l.fix_id""",
}


def loose_fixes(d):
    e = F.col("observation_id")
    return d.observations.select(
        "owner_id", e.alias("fix_id"), "lat", "lon", "accuracy",
        F.timestamp_seconds(F.unix_seconds("ts") - F.when(e % 7 == 0, 3000).otherwise(0)).alias("ts"),
        F.when(e % 3 == 0, F.col("session_id")).when(e % 3 == 1, F.col("session_id") + 1).alias("preferred_session_id"),
        ((e % 3 == 2) | (e % 5 == 0)).alias("allow_fallback"),
        F.timestamp_seconds(F.lit(5110000) - (e % 2) * 600).alias("batch_created_at"))


@query("joi1_assign_fixes", """
SELECT l.fix_id, coalesce(pref, CASE WHEN fallback AND n = 1 THEN only_one END) AS session_id,
       CASE WHEN coalesce(pref, CASE WHEN fallback AND n = 1 THEN only_one END) IS NOT NULL THEN 'assigned'
            WHEN age <= 300 THEN 'deferred' ELSE 'ignored' END AS outcome
FROM loose l LEFT JOIN hits h ON h.fix_id = l.fix_id""", FIXES)
def _(d):
    return sessions.assign_fixes(loose_fixes(d), d.sessions, as_of()).select("fix_id", "session_id", "outcome")


@query("joi2_pending_repairs", """
SELECT owner_id, session_id FROM final_sess WHERE session_id % 4 = 1""")
def _(d):
    marked = d.sessions.filter("session_id % 4 = 1").select(*R)
    return sessions.pending_repairs(marked, d.sessions, d.discards)


@query("joi3_new_cells_since", """
SELECT owner_id, cell_x, cell_y FROM cells c JOIN sess s USING (owner_id, session_id)
GROUP BY owner_id, cell_x, cell_y
HAVING bool_or(start_s >= owner_id * 100000 + 500 AND end_s > start_s) AND NOT bool_or(start_s < owner_id * 100000 + 500)""")
def _(d):
    since = F.timestamp_seconds(F.col("owner_id") * 100000 + 500)
    return stats.new_cells_since(walked(d), d.sessions, since)


@query("joi3_new_cells_today", """
SELECT owner_id, cell_x, cell_y FROM cells c JOIN sess s USING (owner_id, session_id)
GROUP BY owner_id, cell_x, cell_y
HAVING bool_or(start_s >= 5097600 AND start_s < 5184000) AND NOT bool_or(start_s < 5097600)""")
def _(d):
    low, high = sessions.local_day(as_of(), "UTC")
    return stats.new_cells_since(walked(d), d.sessions, low, high, final_only=False)


@query("agg1_lifetime", """
SELECT r.owner_id, count(*) AS recordings, round(sum(distance_m), 3) AS distance_m,
       CAST(sum(duration_s) AS BIGINT) AS duration_s, max(start_s) AS latest_s,
       round(arg_max(distance_m, start_s), 3) AS latest_distance_m, round(max(distance_m), 3) AS longest_distance_m,
       round(sum(CASE WHEN start_s // 86400 = 59 THEN distance_m ELSE 0 END), 3) AS today_distance_m,
       count(CASE WHEN start_s // 86400 = 59 THEN 1 END) AS today_recordings,
       CAST(sum(CASE WHEN start_s // 86400 = 59 THEN step_count ELSE 0 END) AS BIGINT) AS today_steps,
       coalesce(any_value(c.n), 0) AS explored_cells, coalesce(any_value(c.n), 0) * 225 AS area_m2
FROM final_recs r LEFT JOIN (SELECT owner_id, count(*) AS n FROM ocells GROUP BY owner_id) c ON c.owner_id = r.owner_id
GROUP BY r.owner_id""")
def _(d):
    out = stats.lifetime(final_recordings(d), walked(d), as_of())
    return out.withColumn("latest_s", F.unix_seconds("latest_started_at")).drop("latest_started_at").withColumns(
        {c: F.round(c, 3) for c in ("distance_m", "latest_distance_m", "longest_distance_m", "today_distance_m")})


@query("agg2_recent_distance", """
SELECT owner_id, round(sum(CASE WHEN start_s >= 5110000 - 30 * 86400 THEN distance_m ELSE 0 END), 3) AS recent_distance_m
FROM final_recs GROUP BY owner_id""")
def _(d):
    out = stats.recent_distance(final_recordings(d), as_of(), 30)
    return out.withColumn("recent_distance_m", F.round("recent_distance_m", 3))


@query("agg3_history", """
SELECT owner_id, session_id, display_name, start_s, round(distance_m, 3) AS distance_m, points AS point_count
FROM final_recs""")
def _(d):
    return stats.history(final_recordings(d), d.points).select(
        *R, "display_name", F.unix_seconds("started_at").alias("start_s"),
        F.round("distance_m", 3).alias("distance_m"), "point_count")


@query("agg4_completion_stats", """
SELECT coalesce(c.owner_id, r.owner_id) AS owner_id, gps_cells, inferred_cells, CAST(0 AS BIGINT) AS loop_fill_cells,
       cells, recordings, round(distance_m, 3) AS distance_m
FROM (SELECT owner_id, count(DISTINCT CASE WHEN source = 'gps' THEN (cell_x, cell_y) END) AS gps_cells,
             count(DISTINCT CASE WHEN source = 'inferred' THEN (cell_x, cell_y) END) AS inferred_cells,
             count(DISTINCT (cell_x, cell_y)) AS cells FROM scells GROUP BY owner_id) c
FULL JOIN (SELECT owner_id, count(*) AS recordings, sum(distance_m) AS distance_m FROM recs WHERE end_s > start_s
           GROUP BY owner_id) r ON r.owner_id = c.owner_id""")
def _(d):
    cells = grid.cells_by_source(route_lines(d))
    return stats.completion_stats(cells, recordings(d)).withColumn("distance_m", F.round("distance_m", 3))


@query("agg19_revision", "SELECT owner_id, count(*) AS revision FROM scells GROUP BY owner_id")
def _(d):
    return stats.revision(grid.cells_by_source(route_lines(d)))


@query("agg20_underfilled", """
SELECT d.session_id, coalesce(p.n, 0) AS points,
       CASE WHEN coalesce(p.n, 0) >= 2 THEN CASE WHEN end_s > start_s THEN 'promoted' ELSE 'released' END
            WHEN d.session_id * 1000 + 300 <= 5110000 THEN 'purged' ELSE 'deferred' END AS outcome
FROM discards d JOIN sess s ON s.session_id = d.session_id
LEFT JOIN (SELECT session_id, count(*) AS n FROM pts WHERE session_id % 46 = 0 OR point_index < 1 GROUP BY session_id) p
  ON p.session_id = d.session_id""")
def _(d):
    kept = d.points.filter("session_id % 46 = 0 OR point_index < 1")
    counts = kept.groupBy(*R).agg(F.count(F.lit(1)).alias("points"))
    marked = d.discards.withColumn("discard_after", F.timestamp_seconds(F.col("session_id") * 1000 + 300))
    return sessions.underfilled(marked, d.sessions, counts, as_of()).drop("owner_id")


@query("agg21_finalize", """
SELECT s.session_id, greatest(stop_s, start_s + 0.001) AS end_s,
       CAST(greatest(0, floor(greatest(stop_s, start_s + 0.001) - start_s + 0.5)) AS BIGINT) AS duration_s,
       round(greatest(s.session_id % 300, coalesce(l.distance_m, 0)), 3) AS distance_m,
       CASE WHEN s.session_id % 2 = 0 THEN 'Evening' END AS display_name, coalesce(l.points, 0) < 2 AS is_underfilled
FROM (SELECT *, CASE WHEN session_id % 5 = 0 THEN start_s - 10 ELSE start_s + 200 END AS stop_s FROM sess) s
LEFT JOIN lens l ON l.session_id = s.session_id""")
def _(d):
    sid, start = F.col("session_id"), F.unix_seconds("started_at")
    stops = d.sessions.select(
        *R, F.timestamp_seconds(F.when(sid % 5 == 0, start - 10).otherwise(start + 200)).alias("stopped_at"),
        (sid % 300).cast("double").alias("reported_m"),
        F.when(sid % 2 == 0, "  Evening ").otherwise("   ").alias("name"))
    out = sessions.finalize(stops, d.sessions, d.points)
    return out.select("session_id", (F.unix_millis("ended_at") / 1000.0).alias("end_s"), "duration_s",
                      F.round("distance_m", 3).alias("distance_m"), "display_name", "is_underfilled")


@query("agg24_unfinished", """
SELECT s.session_id, coalesce(l.points, 0) AS next_index, round(coalesce(l.distance_m, 0), 3) AS distance_m,
       coalesce((SELECT max(t_s) FROM pts p WHERE p.session_id = s.session_id), start_s) - start_s AS duration_s
FROM sess s LEFT JOIN lens l ON l.session_id = s.session_id WHERE end_s = start_s""")
def _(d):
    stored = d.sessions.withColumn("stored_distance_m", F.lit(0.0)).withColumn("stored_duration_s", F.lit(0))
    return sessions.unfinished(stored, d.points).select(
        "session_id", "next_index", F.round("distance_m", 3).alias("distance_m"), "duration_s")


@query("flt9_fix_status", """
SELECT owner_id, reason, CASE reason WHEN 'permission-denied' THEN 'denied' WHEN 'permission-pending' THEN 'acquiring'
         WHEN 'invalid-fix' THEN 'unavailable' WHEN 'good-fix' THEN 'good' ELSE 'weak-stale' END AS state,
       CASE WHEN reason IN ('stale-fix', 'weak-accuracy', 'good-fix') THEN greatest(0, now_s - t_s) END AS age_s
FROM (SELECT *, CASE WHEN owner_id % 11 = 0 THEN 'permission-denied' WHEN owner_id % 11 = 1 THEN 'permission-pending'
                WHEN t_s > now_s + 5 THEN 'invalid-fix'
                WHEN greatest(0, now_s - t_s) > CASE WHEN owner_id % 2 = 0 THEN 12 ELSE 20 END THEN 'stale-fix'
                WHEN accuracy IS NULL OR accuracy > 25 THEN 'weak-accuracy' ELSE 'good-fix' END AS reason
      FROM (SELECT owner_id, max(t_s) AS t_s, arg_max(coalesce(accuracy, 999), t_s) AS accuracy,
                   max(t_s) + 5 * (owner_id % 9) - 10 AS now_s FROM obs GROUP BY owner_id))""")
def _(d):
    newest = d.observations.groupBy("owner_id").agg(
        F.max("ts").alias("ts"), F.max_by("accuracy", "ts").alias("accuracy"))
    devices = newest.select(
        "*", F.when(F.col("owner_id") % 11 == 0, "denied").when(F.col("owner_id") % 11 == 1, "unknown")
        .otherwise("granted").alias("permission"),
        (F.col("owner_id") % 2 == 0).alias("is_recording"), F.lit(True).alias("resolved"))
    now = F.timestamp_seconds(F.unix_seconds("ts") + 5 * (F.col("owner_id") % 9) - 10)
    return quality.fix_status(devices, now).select("owner_id", "reason", "state", "age_s")


@query("win9_latest_position", """
SELECT owner_id, t_s, accuracy, lat, lon FROM obs WHERE accuracy <= 30
QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY t_s DESC, accuracy, lat DESC, lon DESC) = 1""")
def _(d):
    return quality.latest_positions(d.observations).select("owner_id", F.unix_seconds("ts").alias("t_s"), "accuracy", "lat", "lon")


# Some fixes lie off the map; a fix is seen up to 58 seconds after its time.
ARRIVALS = {"arrivals": """
SELECT o.owner_id, o.session_id, o.observation_id AS arrival, o.t_s, o.t_s + o.observation_id % 59 AS seen_s,
       CASE WHEN o.observation_id % 31 = 0 THEN o.lat + 90 ELSE o.lat END AS y, o.lon AS x, o.accuracy,
       coalesce(v.verdict = 'accepted', false) AS on_route,
       row_number() OVER (PARTITION BY o.owner_id ORDER BY o.observation_id) AS k
FROM obs o LEFT JOIN verdicts v ON v.session_id = o.session_id AND v.t_s = o.t_s""", "shown": """
SELECT owner_id, k, y <= 90 AS adopted, CASE WHEN y <= 90 THEN t_s END AS now_s FROM arrivals WHERE k = 1
UNION ALL
SELECT owner_id, k, moves, CASE WHEN moves THEN t_s ELSE now_s END
FROM (SELECT a.owner_id, a.k, a.t_s, s.now_s, a.y <= 90 AND (s.now_s IS NULL
             OR (a.t_s >= s.now_s AND (a.on_route OR coalesce(a.accuracy <= 30, false)))) AS moves
      FROM shown s JOIN arrivals a ON a.owner_id = s.owner_id AND a.k = s.k + 1)"""}


def adopted(d):
    """Observations in the order of their ids, with the decision to show them."""
    routes = d.verdicts.filter("verdict = 'accepted'").select(*R, "ts").withColumn("on_route", F.lit(True))
    i = F.col("observation_id")
    arrivals = d.observations.join(routes, [*R, "ts"], "left").withColumn(
        "lat", F.when(i % 31 == 0, F.col("lat") + 90).otherwise(F.col("lat"))).withColumn(
        "seen_at", F.timestamp_seconds(F.unix_seconds("ts") + i % 59))
    return position.adopted_positions(arrivals, F.floor(F.col("arrival") / 100_000))


@query("win9_adopted_positions", """
SELECT a.owner_id, a.arrival, a.t_s, a.on_route, s.adopted FROM arrivals a JOIN shown s USING (owner_id, k)""", ARRIVALS)
def _(d):
    return adopted(d).select("owner_id", "arrival", F.unix_seconds("ts").alias("t_s"),
                             F.coalesce("on_route", F.lit(False)).alias("on_route"), "adopted")


@query("win9_startup_centre", """
SELECT session_id, first_arrival, arrival <> first_arrival AS upgraded, arrival, t_s, accuracy, reliable FROM centre
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY k DESC) = 1""", {**ARRIVALS, "candidate": """
SELECT a.*, a.on_route OR coalesce(a.accuracy <= 20, false) AS reliable,
       row_number() OVER (PARTITION BY a.session_id ORDER BY a.k) AS n
FROM arrivals a JOIN shown s USING (owner_id, k) WHERE s.adopted AND (a.on_route OR a.seen_s - a.t_s <= 30)""", "centre": """
SELECT session_id, n AS k, n, arrival AS first_arrival, arrival, t_s, accuracy, reliable FROM candidate WHERE n = 1
UNION ALL
SELECT session_id, k, n, first_arrival, CASE WHEN up THEN b_arrival ELSE arrival END, CASE WHEN up THEN b_t ELSE t_s END,
       CASE WHEN up THEN b_accuracy ELSE accuracy END, reliable OR up
FROM (SELECT c.session_id, b.n AS k, b.n, c.first_arrival, c.arrival, c.t_s, c.accuracy, c.reliable, b.arrival AS b_arrival,
             b.t_s AS b_t, b.accuracy AS b_accuracy,
             NOT c.reliable AND b.reliable AND b.t_s >= c.t_s AND coalesce(CASE WHEN c.accuracy IS NULL THEN b.accuracy <= 20
               ELSE c.accuracy - b.accuracy >= greatest(10, c.accuracy * 0.25) END, false) AS up
      FROM centre c JOIN candidate b ON b.session_id = c.session_id AND b.n = c.n + 1)"""})
def _(d):
    return position.startup_centres(adopted(d).filter("adopted"), R).select(
        "session_id", "first_arrival", "upgraded", "arrival", F.unix_seconds("ts").alias("t_s"), "accuracy", "reliable")


@query("flt10_live_quality", """
SELECT session_id, score, CASE WHEN score >= 80 THEN 'Good' WHEN score >= 55 THEN 'OK' ELSE 'Poor' END AS label
FROM (SELECT session_id, greatest(0, 100
    - CASE WHEN acc IS NULL THEN 10 WHEN acc > 30 THEN 35 WHEN acc > 18 THEN 15 ELSE 0 END
    - CASE WHEN paused >= 5 THEN 20 WHEN paused > 0 THEN 8 ELSE 0 END
    - CASE WHEN rejected > 0.4 * (ok + rejected) THEN 35 WHEN rejected > 0.15 * (ok + rejected) THEN 15 ELSE 0 END
    - CASE WHEN el > 60 AND ok * 60 < 2 * el THEN 25 WHEN el > 60 AND ok * 60 < 4 * el THEN 10 ELSE 0 END
    - CASE session_id % 3 WHEN 0 THEN 15 WHEN 1 THEN 8 ELSE 0 END) AS score
  FROM (SELECT session_id, count(CASE WHEN verdict = 'accepted' THEN 1 END) AS ok,
               count(CASE WHEN verdict IN ('jump', 'stale') THEN 1 END) AS rejected,
               count(CASE WHEN verdict = 'weak' THEN 1 END) AS paused, max(t_s) - min(t_s) AS el,
               nullif(arg_max(coalesce(accuracy, -1), t_s), -1) AS acc FROM verdicts GROUP BY session_id))""")
def _(d):
    counters = clean.fix_counters(d.verdicts).drop("last_reason")
    now = d.observations.groupBy(*R).agg(
        F.max_by("accuracy", "ts").alias("accuracy"),
        (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("elapsed_s"))
    state = F.when(F.col("session_id") % 3 == 0, "unavailable").when(F.col("session_id") % 3 == 1, "foreground-only") \
        .otherwise("active")
    live = counters.join(now, R).withColumn("background_status", state)
    return quality.live_quality(live).select("session_id", "score", "label")


@query("flt11_saved_quality", """
SELECT session_id, gaps AS hidden_gaps, cells_walked, score,
       CASE WHEN score >= 80 THEN 'Good' WHEN score >= 55 THEN 'OK' ELSE 'Poor' END AS label
FROM (SELECT r.session_id, coalesce(g.n, 0) AS gaps, coalesce(c.n, 0) AS cells_walked, greatest(0, 100
    - CASE WHEN points < 2 THEN 60 WHEN duration_s > 60 AND points * 60 < 2 * duration_s THEN 30
           WHEN duration_s > 60 AND points * 60 < 4 * duration_s THEN 12 ELSE 0 END
    - CASE WHEN coalesce(g.n, 0) > 3 THEN 25 WHEN coalesce(g.n, 0) > 0 THEN 10 ELSE 0 END) AS score
  FROM final_recs r
  LEFT JOIN (SELECT session_id, count(*) AS n FROM steps WHERE reason IS NOT NULL GROUP BY session_id) g
    ON g.session_id = r.session_id
  LEFT JOIN (SELECT session_id, count(*) AS n FROM cells GROUP BY session_id) c ON c.session_id = r.session_id)""")
def _(d):
    gaps = d.steps.groupBy(*R).agg(F.count_if(F.col("kind") == "gap").alias("hidden_gaps"))
    cells = walked(d).groupBy(*R).agg(F.count(F.lit(1)).alias("cells_walked"))
    report = final_recordings(d).withColumnRenamed("points", "point_count").join(gaps, R, "left").join(
        cells, R, "left").fillna(0, ["hidden_gaps", "cells_walked"])
    return quality.saved_quality(report).select("session_id", "hidden_gaps", "cells_walked", "score", "label")


@query("flt12_milestones", """
SELECT session_id, concat(CASE WHEN n >= 60 THEN '1000 cells,' ELSE '' END,
  CASE WHEN distance_m * 20 >= 25000 THEN '25 km,' WHEN distance_m * 20 >= 10000 THEN '10 km,'
       WHEN distance_m * 20 >= 5000 THEN '5 km,' ELSE '' END,
  CASE WHEN session_id % 9 >= 5 THEN 'District 5%,' ELSE '' END,
  CASE WHEN session_id % 2 = 0 AND session_id % 101 >= 80 THEN 'Clean GPS,' ELSE '' END) AS milestones
FROM (SELECT r.session_id, r.distance_m, coalesce(c.n, 0) AS n FROM final_recs r LEFT JOIN
      (SELECT session_id, count(*) AS n FROM cells GROUP BY session_id) c ON c.session_id = r.session_id)""")
def _(d):
    """Scaled-up totals, so that every badge occurs."""
    cells = walked(d).groupBy(*R).agg(F.count(F.lit(1)).alias("n"))
    sid = F.col("session_id")
    summary = final_recordings(d).join(cells, R, "left").select(
        sid, F.when(F.col("n") >= 60, 1000).otherwise(0).alias("new_cells"), (F.col("distance_m") * 20).alias("distance_m"),
        (sid % 9).alias("objective_percent"), (sid % 2).alias("paused_fixes"), (sid % 101).alias("score"))
    out = quality.milestones(summary)
    return out.select("session_id", F.concat_ws("", F.transform("milestones", lambda m: F.concat(m, F.lit(",")))).alias(
        "milestones"))


@query("asf1_area_ladder", """
SELECT owner_id, area_m2, CASE WHEN area_m2 >= 39000 THEN 'bryant-park' WHEN area_m2 >= 14350 THEN 'piazza-san-marco'
    WHEN area_m2 >= 9400 THEN 'plaza-mayor' WHEN area_m2 >= 9200 THEN 'trafalgar-square'
    WHEN area_m2 >= 7140 THEN 'football-pitch' WHEN area_m2 >= 1800 THEN 'ice-rink'
    WHEN area_m2 >= 1250 THEN 'olympic-pool' WHEN area_m2 >= 420 THEN 'basketball-court'
    WHEN area_m2 >= 261 THEN 'tennis-court' END AS current_id
FROM (SELECT owner_id, count(*) * 225 AS area_m2 FROM ocells GROUP BY owner_id)""")
def _(d):
    return stats.area_progress(grid.cell_totals(walked(d))).select("owner_id", "area_m2", "current_id")


@query("top2_longest_recording", """
SELECT owner_id, arg_max(session_id, distance_m * 1000000 - session_id) AS session_id FROM final_recs GROUP BY owner_id""")
def _(d):
    return final_recordings(d).groupBy("owner_id").agg(
        F.max_by("session_id", F.col("distance_m") * 1000000 - F.col("session_id")).alias("session_id"))


@query("top1_newest_recordings", """
SELECT owner_id, session_id, rank FROM (SELECT owner_id, session_id,
  row_number() OVER (PARTITION BY owner_id ORDER BY start_s DESC) AS rank FROM final_recs) WHERE rank <= 3""")
def _(d):
    """Newest three per owner; the limit is pushed below the shuffle by Spark's window group limit."""
    from pyspark.sql import Window

    newest = Window.partitionBy("owner_id").orderBy(F.desc("started_at"))
    ranked = sessions.finalized(d.sessions, d.discards).select(*R, F.row_number().over(newest).alias("rank"))
    return ranked.filter("rank <= 3")


@query("set7_erase_recording", "SELECT owner_id, session_id, point_index FROM pts WHERE session_id % 10 <> 3")
def _(d):
    gone = d.sessions.filter("session_id % 10 = 3")
    return sessions.erase_recording(d.points, gone).select(*R, "point_index")


@query("agg5_loop_summaries", """
SELECT l.owner_id, l.session_id, loops, accepted_loops, rejected_loops, area_m2, total_len_m, unwalked_len_m, rejection_reasons,
       coalesce(filled_cells, 0) AS filled_cells
FROM (SELECT owner_id, session_id, count(*) AS loops, count(*) FILTER (o % 3 = 0) AS accepted_loops,
             count(*) FILTER (o % 3 > 0) AS rejected_loops, max(o % 500) AS area_m2, sum(o % 90) AS total_len_m, sum(o % 7) AS unwalked_len_m,
             coalesce(string_agg(DISTINCT CASE o % 3 WHEN 1 THEN 'street' WHEN 2 THEN 'too_large' END, ','
                                 ORDER BY CASE o % 3 WHEN 1 THEN 'street' WHEN 2 THEN 'too_large' END), '') AS rejection_reasons
      FROM (SELECT owner_id, session_id, observation_id AS o FROM pts WHERE observation_id % 5 = 0) GROUP BY ALL) l
LEFT JOIN (SELECT owner_id, session_id, count(*) AS filled_cells FROM (SELECT DISTINCT owner_id, session_id, cell_x, cell_y FROM cells)
           WHERE cell_x % 4 = 0 GROUP BY ALL) c USING (owner_id, session_id)""")
def _(d):
    """Every fifth accepted point stands for an evaluated loop, every fourth column of cells for filled ones."""
    o = F.col("observation_id")
    found = d.points.filter(o % 5 == 0).select(
        *R, (o % 3 == 0).alias("accepted"), (o % 500).alias("area_m2"), (o % 90).alias("total_len_m"), (o % 7).alias("unwalked_len_m"),
        F.when(o % 3 == 1, "street").when(o % 3 == 2, "too_large").alias("rejection_reason"))
    cells = walked(d).withColumn("source", F.when(F.col("cell_x") % 4 == 0, "loop_fill").otherwise("gps"))
    return stats.loop_summaries(found, cells)
