"""Queries on exports, archives and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmesh.catalog.registry import query
from trailmesh.catalog.rewards import TASKS, evidence, events, tasks
from trailmesh.catalog.stats import final_recordings
from trailmesh.operators import clean, sets
from trailmesh.sources import archive, gpx, ledgers, osm

R = ["owner_id", "session_id"]


@query("src7_gpx_names", r"""
SELECT session_id, concat(strftime(to_timestamp(start_s) AT TIME ZONE 'UTC', '%Y-%m-%d'), '-Walk-', CAST(session_id AS VARCHAR),
       CASE WHEN session_id % 3 = 0 THEN '-ete-&-"nuit"' ELSE '' END, '-', CAST(session_id AS VARCHAR), '.gpx') AS file_name
FROM (SELECT * FROM final_sess)""".replace('-ete-&-"nuit"', "-ete-&-nuit"))
def _(d):
    return gpx.file_names(final_recordings(d)).select("session_id", "file_name")


@query("src7_gpx_track_points", """
SELECT p.session_id, p.point_index AS line_no, concat('      <trkpt lat="', CAST(lat AS VARCHAR), '" lon="', CAST(lon AS VARCHAR), '">',
       chr(10), '        <time>', strftime(to_timestamp(t_s) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z'), '</time>', chr(10),
       '      </trkpt>') AS value
FROM pts p JOIN final_sess s ON s.session_id = p.session_id""")
def _(d):
    lines = gpx.gpx_lines(final_recordings(d), d.points)
    names = gpx.file_names(final_recordings(d)).select("owner_id", "session_id", "file_name")
    return lines.filter(F.col("line_no").between(0, 2**61)).join(names, ["owner_id", "file_name"]).select(
        "session_id", "line_no", "value")


BLOCKS = {
    "headz": """
SELECT o_orderkey AS session_id, o_custkey AS owner_id, epoch(o_orderdate) + o_orderkey % 86400 AS s,
       strftime(o_orderdate, '%Y-%m') AS month, CAST(floor(o_totalprice / 20 + 0.5) AS BIGINT) AS points FROM orders""",
    "rankz": "SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY s DESC, session_id DESC) AS r FROM headz",
    "oldr": """
SELECT *, row_number() OVER (PARTITION BY owner_id, month ORDER BY s, session_id) AS k FROM rankz WHERE r > 20""",
    "packz": """
SELECT owner_id, month, session_id, k, points, 1 AS part, 1 AS held, points AS total FROM oldr WHERE k = 1
UNION ALL
SELECT o.owner_id, o.month, o.session_id, o.k, o.points,
       CASE WHEN p.held >= 20 OR p.total + o.points > 25000 THEN p.part + 1 ELSE p.part END,
       CASE WHEN p.held >= 20 OR p.total + o.points > 25000 THEN 1 ELSE p.held + 1 END,
       CASE WHEN p.held >= 20 OR p.total + o.points > 25000 THEN o.points ELSE p.total + o.points END
FROM packz p JOIN oldr o ON o.owner_id = p.owner_id AND o.month = p.month AND o.k = p.k + 1""",
    "planz": """
SELECT owner_id, session_id, concat('hot-', CAST(session_id AS VARCHAR)) AS block_id, 'hot' AS kind, points FROM rankz WHERE r <= 20
UNION ALL SELECT owner_id, session_id, concat('archive-', month, '-', lpad(CAST(part AS VARCHAR), 2, '0')), 'archive', points FROM packz""",
}


def many_recordings(d):
    """Recording headers in the shape of orders, so that owners have enough of them; few owners, to fill months."""
    k = F.col("o_orderkey")
    return d.table("orders").select(
        F.floor(F.col("o_custkey")).alias("owner_id"), k.alias("session_id"),
        F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 86400).alias("started_at"),
        F.floor(F.col("o_totalprice") / 20 + 0.5).cast("long").alias("points"))


@query("src8_block_plans", "SELECT owner_id, session_id, block_id, kind FROM planz",
       {k: v.replace("o_custkey AS owner_id", "o_custkey % 25 AS owner_id") for k, v in BLOCKS.items()})
def _(d):
    few = many_recordings(d).withColumn("owner_id", F.col("owner_id") % 25)
    return archive.block_plans(few).select("owner_id", "session_id", "block_id", "kind")


@query("src8_manifest_totals", """
SELECT owner_id, count(DISTINCT CASE WHEN kind = 'archive' THEN block_id END) AS archive_blocks, count(DISTINCT block_id) AS blocks,
       count(CASE WHEN kind = 'hot' THEN 1 END) AS hot_recordings, CAST(sum(points) AS BIGINT) AS points, count(*) AS recordings
FROM planz GROUP BY owner_id""", {k: v.replace("o_custkey AS owner_id", "o_custkey % 25 AS owner_id") for k, v in BLOCKS.items()})
def _(d):
    few = many_recordings(d).withColumn("owner_id", F.col("owner_id") % 25)
    return archive.manifest_totals(archive.block_plans(few))


@query("src9_block_counts", """
SELECT owner_id, concat('hot-', CAST(session_id AS VARCHAR)) AS block_id, points AS expected, points AS actual, true AS matches
FROM final_recs""")
def _(d):
    recs = final_recordings(d)
    plans = archive.block_plans(recs)
    return archive.block_counts(plans, archive.block_payload(plans, d.points))


RUNS = {
    "posz": "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY point_index) - 1 AS seq, point_index AS position FROM pts WHERE observation_id % 7 > 0",
    "brkz": "SELECT *, CASE WHEN position = lag(position) OVER (PARTITION BY session_id ORDER BY seq) + 1 THEN 0 ELSE 1 END AS b FROM posz",
    "runz": "SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY seq) AS run_no FROM brkz",
}


def positions(d):
    from trailmesh.operators.ordered import time_slice, with_running

    kept = d.points.filter("observation_id % 7 > 0")
    return with_running(kept, ["session_id"], "ts", time_slice(), index="seq").select(
        "session_id", "seq", F.col("point_index").alias("position"))


@query("src10_position_runs", """
SELECT session_id, min(position) AS start, count(*) AS count FROM runz GROUP BY session_id, run_no""", RUNS)
def _(d):
    return archive.position_runs(positions(d), ["session_id"]).select("session_id", "start", "count")


@query("src10_positions_back", "SELECT session_id, position FROM posz", RUNS)
def _(d):
    runs = archive.position_runs(positions(d), ["session_id"])
    return archive.run_positions(runs, ["session_id"]).select("session_id", "position")


@query("src11_verify_archive", """
SELECT * FROM (VALUES ('recording_metadata', 0), ('recording_ids_unique', 0), ('blocks_cover_all', 0), ('blocks_cover_once', 0),
  ('blocks_known_recordings', 0), ('block_point_counts', 0), ('event_ids_unique', 0), ('collected_have_events', 0),
  ('task_ids_unique', 0), ('seals_unique', 0), ('seals_have_tasks', 0), ('evidence_unique', 0)) v(rule, violations)
UNION ALL SELECT 'events_known_recordings', count(*) FROM ev WHERE session_id IS NOT NULL
  AND (owner_id, session_id) NOT IN (SELECT (owner_id, session_id) FROM final_sess)
UNION ALL SELECT 'one_open_task', count(*) FROM (SELECT DISTINCT owner_id FROM pr)
UNION ALL SELECT 'evidence_known_recordings', count(*) FROM sess s JOIN pr USING (owner_id)
  WHERE s.session_id % 2 = 1 AND (s.owner_id, s.session_id) NOT IN (SELECT (owner_id, session_id) FROM final_sess)""", TASKS)
def _(d):
    """All fifteen rules. The derived data break three of them: events and evidence of recordings that were
    discarded, and owners with several open tasks."""
    recs = final_recordings(d).withColumn("distance_m", F.coalesce("distance_m", F.lit(0.0)))
    plans = archive.block_plans(recs)
    payload = archive.block_payload(plans, d.points)
    ev = events(d)
    t = tasks(d)
    seals = t.filter("kind = 'explore_cells'").select("owner_id", F.col("id").alias("expedition_id"))
    return archive.verify(recs, plans, payload, ev, ev, t, seals, evidence(d))


@query("src13_export_selection", """
SELECT owner_id, session_id FROM final_sess f WHERE NOT EXISTS (
  SELECT 1 FROM sess s WHERE s.owner_id = f.owner_id AND s.end_s = s.start_s)""")
def _(d):
    return archive.export_selection(d.sessions, d.discards).select(*R)


@query("src1_route_json", """
SELECT session_id, step_no, CASE WHEN step_no % 5 IN (0, 1, 2) THEN 0 ELSE 2 END AS points FROM steps""")
def _(d):
    """Stored route text per step, with broken and ill-formed ones, which read as null."""
    def vertex(p: str):
        return F.struct(F.col(f"{p}_lat").alias("latitude"), F.col(f"{p}_lon").alias("longitude"),
                        F.date_format(f"{p}_ts", gpx.ISO).alias("timestamp"), F.col(f"{p}_point_index").cast("int").alias("pointIndex"))

    n = F.col("step_no") % 5
    text = F.to_json(F.array(F.struct(
        F.when(n == 1, "guess").otherwise("confirmed").alias("type"), F.when(n == 2, "low").alias("confidence"),
        F.array(vertex("from"), vertex("to")).alias("points"))))
    stored = d.steps.select("session_id", "step_no", F.when(n == 0, F.substring(text, 1, 40)).otherwise(text).alias("json"))
    parsed = stored.withColumn("route", ledgers.parse_route(F.col("json")))
    first = F.get("route", F.lit(0))["points"]
    return parsed.select("session_id", "step_no", F.coalesce(F.when(first.isNotNull(), F.size(first)), F.lit(0)).alias("points"))


@query("flt6_poi_category", """
SELECT p_partkey AS id, CASE p_size % 8 WHEN 0 THEN 'nature' WHEN 1 THEN 'history' WHEN 2 THEN 'art' WHEN 3 THEN 'culture'
  WHEN 4 THEN 'architecture' WHEN 5 THEN 'culture' END AS category FROM part WHERE p_size % 8 <= 5""")
def _(d):
    return osm.poi_candidates(places(d)).select((F.col("external_id") - 1).alias("id"), "category")


def places(d):
    """Places with tags by part size; kinds 6 and 7 are not wanted."""
    s = F.col("p_size") % 8
    pick = lambda k, v: F.map_filter(F.create_map(F.lit(k), v), lambda _k, x: x.isNotNull())
    tags = F.map_concat(
        pick("name", F.concat(F.lit(" "), F.col("p_name"))),
        pick("leisure", F.when(s == 0, "park").when(s == 6, "pitch")),
        pick("historic", F.when(s == 1, "castle").when(s == 7, "wreck")),
        pick("tourism", F.when(s == 2, "gallery").when(s == 3, "museum")),
        pick("amenity", F.when(s == 4, "place_of_worship").when(s == 5, "theatre")))
    at = F.when(F.col("p_partkey") % 2 == 0, 45.75)
    return d.table("part").select(
        F.lit("node").alias("type"), (F.col("p_partkey") + 1).cast("long").alias("id"), at.alias("lat"), at.alias("lon"),
        F.struct(F.lit(45.7).alias("lat"), F.lit(4.8).alias("lon")).alias("center"), tags.alias("tags"))


@query("joi19_fresh_routes", """
SELECT session_id FROM (SELECT session_id, count(*) AS n FROM pts GROUP BY session_id) WHERE session_id % 3 > 0 AND n > 1""")
def _(d):
    """Frozen routes whose count and highest id still match; every third one is out of date."""
    now = clean.generation(d.points)
    frozen = now.filter("row_count > 1").withColumn(
        "max_id", F.when(F.col("session_id") % 3 == 0, F.col("max_id") - 1).otherwise(F.col("max_id")))
    return sets.still_valid(frozen, now, R, ["row_count", "max_id"]).select("session_id")


@query("set9_frozen_routes", """
SELECT session_id, CASE WHEN session_id % 3 > 0 THEN 'kept' ELSE 'derived' END AS origin FROM (SELECT DISTINCT session_id FROM pts)""")
def _(d):
    now = clean.generation(d.points)
    frozen = now.withColumn("max_id", F.when(F.col("session_id") % 3 == 0, F.col("max_id") - 1).otherwise(F.col("max_id")))
    out = sets.freeze(frozen.withColumn("origin", F.lit("kept")), now.withColumn("origin", F.lit("derived")), now, R,
                      ["row_count", "max_id"])
    return out.select("session_id", "origin")
