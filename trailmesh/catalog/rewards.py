"""Queries on medals and daily tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmesh.catalog.cells import walked
from trailmesh.catalog.registry import query
from trailmesh.catalog.streets import COVER, coverage
from trailmesh.catalog.zones import ZCTE
from trailmesh.operators import paths, rewards, streets, zones
from trailmesh.session import checkpointed

R = ["owner_id", "session_id"]

def now():
    return F.timestamp_seconds(F.lit(9000000))


# Medal events derived for the checks: walkers collect some of the medals in their square.
EVENTS = {
    "ev": """
SELECT o.user_id AS owner_id, m.medal_id, CASE WHEN m.medal_id % 4 = 0 THEN NULL ELSE o.user_id * 100 END AS session_id,
       o.user_id * 100000 + 1000 AS acq_s, CASE WHEN m.medal_id % 3 = 0 THEN 'pending' ELSE 'presented' END AS state
FROM origins o JOIN medal m ON m.medal_id % 150 = o.user_id WHERE m.medal_id % 2 = 0""",
}


def events(d):
    users = d.table("events").select("user_id").distinct()
    m, u = F.col("medal_id"), F.col("user_id")
    return d.medals.join(users, m % 150 == u).filter(m % 2 == 0).select(
        u.alias("owner_id"), "album_id", m, F.when(m % 4 != 0, u * 100).alias("session_id"),
        F.lit("recording").alias("reason"), F.timestamp_seconds(u * 100000 + 1000).alias("acquired_at"),
        F.when(m % 3 == 0, "pending").otherwise("presented").alias("presentation_state"))


@query("joi13_visible_events", """
SELECT owner_id, medal_id FROM ev WHERE session_id IS NULL OR session_id IN (SELECT session_id FROM sess WHERE end_s > start_s)""",
       EVENTS)
def _(d):
    return rewards.visible_events(events(d), d.sessions).select("owner_id", "medal_id")


@query("joi14_album_counts", """
SELECT o.owner_id, (SELECT count(*) FROM medal) AS medals, o.collected, o.pending FROM (
  SELECT owner_id, count(*) AS collected, count(CASE WHEN state = 'pending' THEN 1 END) AS pending FROM ev GROUP BY owner_id) o""",
       EVENTS)
def _(d):
    ev = events(d)
    return rewards.album_counts(rewards.album_progress(d.medals, ev, ev)).select("owner_id", "medals", "collected", "pending")


@query("joi12_medals_enclosed")
def _(d):
    """Medals enclosed by everything an owner has walked."""
    found = rewards.medal_candidates(
        walked(d).select("owner_id", "cell_x", "cell_y").distinct(), paths.path_lengths(d.points), d.medals, ["owner_id"])
    return found.select("owner_id", "medal_id", "anchor_cell", "enclosure_area_m2")


@query("rew6_medals_of_recordings")
def _(d):
    found = rewards.medal_candidates(walked(d), paths.path_lengths(d.points), d.medals, R)
    return rewards.collect_medals(found, d.sessions.select(*R, "started_at"), "recording", now()).select(
        "owner_id", "medal_id", "session_id", "reason", "anchor_cell", "enclosure_area_m2")


@query("agg23_medal_evidence", """
SELECT l.owner_id, l.session_id, l.points, coalesce(c.n, 0) AS boundary_cells, round(l.distance_m, 3) AS walked_m
FROM lens l LEFT JOIN (SELECT session_id, count(*) AS n FROM cells GROUP BY session_id) c ON c.session_id = l.session_id""")
def _(d):
    out = rewards.medal_evidence(walked(d), d.points, paths.path_lengths(d.points), R)
    return out.select(*R, "points", "boundary_cells", F.round("walked_m", 3).alias("walked_m"))


HASH = {
    "dd": """
SELECT z.id AS district_id, o.o_orderdate AS day, o.o_orderkey % 2 = 0 AS has_street, o.o_orderkey % 3 = 0 AS has_medal, o.o_orderkey AS k,
       concat(z.id, ':', strftime(o.o_orderdate, '%Y-%m-%d')) AS txt
FROM orders o JOIN zones z ON z.k = o.o_orderkey % 5""",
    "fnv": """
SELECT k, txt, 0 AS i, CAST(2166136261 AS BIGINT) AS h FROM dd
UNION ALL
SELECT k, txt, i + 1, (xor(h, CAST(ord(substr(txt, i + 1, 1)) AS BIGINT)) * 16777619) & 4294967295 FROM fnv WHERE i < length(txt)""",
    "sd": "SELECT dd.*, f.h FROM dd JOIN fnv f ON f.k = dd.k AND f.i = length(dd.txt)",
    "kd": """
SELECT *, [15, 20, 25][CAST(h % 3 AS INT) + 1] AS ct, CASE WHEN has_street AND has_medal THEN ['close_loop', 'complete_street', 'collect_medal']
  WHEN has_street THEN ['close_loop', 'complete_street'] WHEN has_medal THEN ['close_loop', 'collect_medal'] ELSE ['close_loop'] END AS ks FROM sd""",
}


@query("rew1_daily_tasks", """
SELECT k, 0 AS slot, 'explore_cells' AS kind, ct AS target FROM kd
UNION ALL SELECT k, 1, ks[CAST(h % len(ks) AS INT) + 1], 1 FROM kd
UNION ALL SELECT k, 2, CASE WHEN len(ks) = 1 THEN 'explore_cells' ELSE ks[CAST((h + 1) % len(ks) AS INT) + 1] END,
  CASE WHEN len(ks) = 1 THEN ct + 15 ELSE 1 END FROM kd""", HASH)
def _(d):
    """A draw for every order: its date and one of the districts."""
    k = F.col("o_orderkey")
    asked = d.table("orders").select(
        k.alias("k"), F.concat(F.lit("relation/"), (k % 5).cast("string")).alias("district_id"),
        F.to_date("o_orderdate").alias("local_date"), (k % 2 == 0).alias("has_street"), (k % 3 == 0).alias("has_medal"))
    return rewards.daily_tasks(asked, carry=["k"]).select("k", "slot", "kind", "target")


def tasks(d, cells=None):
    """Three accepted tasks per walker and district that their cells touch."""
    cells = walked(d) if cells is None else cells
    pairs = zones.cells_in_zones(cells.select("owner_id", "cell_x", "cell_y").distinct(), d.zones).select(
        "owner_id", F.col("zone_id").alias("district_id")).distinct()
    kinds = F.array(*[F.lit(x) for x in ("explore_cells", "complete_street", "collect_medal", "close_loop")])
    t = pairs.select("*", F.posexplode(kinds).alias("slot", "kind"))
    return t.select(
        F.concat_ws("/", F.col("owner_id").cast("string"), "district_id", "kind").alias("id"), "owner_id", "district_id",
        F.to_date(F.lit("1970-04-01")).alias("local_date"), "slot", "kind", F.lit(1).alias("target"),
        F.timestamp_seconds(F.col("owner_id") * 100000 + 500).alias("accepted_at"),
        F.lit(None).cast("timestamp").alias("abandoned_at"), F.lit(None).cast("timestamp").alias("completed_at"))


def evidence(d, listed=None):
    listed = tasks(d) if listed is None else listed
    return d.sessions.filter("session_id % 2 = 1").join(
        listed.filter("kind = 'close_loop'").select(F.col("id").alias("expedition_id"), "owner_id"), "owner_id").select(
        "expedition_id", *R, F.col("started_at").alias("detected_at"))


def states(d):
    s = streets.street_states(streets.segment_progress(coverage(d)), d.streets)
    return s.withColumn("completed_at", F.when(F.col("is_complete"), F.timestamp_seconds(
        F.col("owner_id") * 100000 + F.when(F.col("owner_id") % 2 == 0, 900).otherwise(100))))


TASKS = {
    **ZCTE, **COVER, **EVENTS,
    "pr": "SELECT DISTINCT owner_id, zone_id FROM incell",
    "newc": """
SELECT owner_id, cell_x, cell_y FROM cells JOIN sess USING (owner_id, session_id) GROUP BY owner_id, cell_x, cell_y
HAVING min(start_s) >= owner_id * 100000 + 500 AND bool_or(end_s > start_s AND start_s >= owner_id * 100000 + 500)""",
    "instr": """
SELECT DISTINCT s.street_id, z.id AS zone_id FROM (SELECT street_id, lat1 AS lat, lon1 AS lon FROM streets UNION ALL SELECT street_id, lat2, lon2 FROM streets) s
JOIN zones z ON s.lat >= z.min_lat AND s.lat < z.max_lat AND s.lon >= z.min_lon AND s.lon < z.max_lon""",
    "inmed": """
SELECT medal_id, z.id AS zone_id FROM medal m JOIN zones z
ON m.lat >= z.min_lat AND m.lat < z.max_lat AND m.lon >= z.min_lon AND m.lon < z.max_lon""",
    "meas": """
SELECT i.owner_id, i.zone_id, 'explore_cells' AS kind, count(*) AS progress FROM incell i JOIN newc n USING (owner_id, cell_x, cell_y) GROUP BY ALL
UNION ALL SELECT s.owner_id, i.zone_id, 'complete_street', count(*) FROM sst s JOIN instr i USING (street_id)
  WHERE s.is_complete AND s.owner_id % 2 = 0 GROUP BY ALL
UNION ALL SELECT e.owner_id, i.zone_id, 'collect_medal', count(*) FROM ev e JOIN inmed i USING (medal_id) GROUP BY ALL
UNION ALL SELECT p.owner_id, p.zone_id, 'close_loop', count(*) FROM pr p JOIN sess s ON s.owner_id = p.owner_id
  WHERE s.session_id % 2 = 1 AND s.end_s > s.start_s GROUP BY ALL""",
    "tk": """
SELECT p.owner_id, p.zone_id AS district_id, k.kind, coalesce(m.progress, 0) AS progress
FROM pr p CROSS JOIN (VALUES ('explore_cells'), ('complete_street'), ('collect_medal'), ('close_loop')) k(kind)
LEFT JOIN meas m ON m.owner_id = p.owner_id AND m.zone_id = p.zone_id AND m.kind = k.kind""",
}


def progress(d):
    """Cells, tasks and progress are written once, since each is read more than once."""
    cells = checkpointed(walked(d))
    listed = checkpointed(tasks(d, cells))
    return checkpointed(rewards.task_progress(
        listed, d.zones, cells, d.sessions, states(d), d.streets, events(d), d.medals, evidence(d, listed)))


@query("rew3_task_progress", "SELECT owner_id, district_id, kind, progress FROM tk", TASKS)
def _(d):
    return progress(d).select("owner_id", "district_id", "kind", "progress")


@query("rew4_new_seals", """
SELECT concat('seal:', CAST(owner_id AS VARCHAR), '/', district_id, '/', kind) AS id, kind FROM tk WHERE progress >= 1""", TASKS)
def _(d):
    done = rewards.complete_tasks(progress(d), now())
    return rewards.new_seals(done, done.select("id").filter("id = ''")).select("id", "kind")


@query("top2_active_task", """
SELECT owner_id, max(concat(CAST(owner_id AS VARCHAR), '/', district_id, '/', kind)) AS id FROM tk WHERE progress < 1 GROUP BY owner_id""",
       TASKS)
def _(d):
    return rewards.active_tasks(rewards.complete_tasks(progress(d), now())).select("owner_id", "id")


@query("rew2_opportunities", """
SELECT p.owner_id, p.zone_id AS district_id,
       EXISTS (SELECT 1 FROM sst s JOIN instr i ON i.street_id = s.street_id WHERE s.owner_id = p.owner_id AND NOT s.is_complete AND i.zone_id = p.zone_id) AS has_street,
       (SELECT count(*) FROM inmed i WHERE i.zone_id = p.zone_id) >
       (SELECT count(*) FROM ev e JOIN inmed i ON i.medal_id = e.medal_id WHERE e.owner_id = p.owner_id AND i.zone_id = p.zone_id) AS has_medal
FROM pr p""", TASKS)
def _(d):
    asked = tasks(d).select("owner_id", "district_id").distinct()
    return rewards.opportunities(d.zones, states(d), d.streets, d.medals, events(d), asked)


@query("rew5_loop_evidence", """
SELECT concat(CAST(p.owner_id AS VARCHAR), '/', p.zone_id, '/close_loop') AS expedition_id, s.session_id
FROM pr p JOIN sess s ON s.owner_id = p.owner_id WHERE s.session_id % 2 = 0""", TASKS)
def _(d):
    found = d.sessions.join(tasks(d).select("owner_id", "district_id").distinct(), "owner_id").select(
        "owner_id", "session_id", "district_id")
    return rewards.loop_evidence(found, tasks(d), evidence(d), now()).select("expedition_id", "session_id")


@query("joi13_final_evidence", """
SELECT concat(CAST(p.owner_id AS VARCHAR), '/', p.zone_id, '/close_loop') AS expedition_id, count(*) AS loops
FROM pr p JOIN sess s ON s.owner_id = p.owner_id WHERE s.session_id % 2 = 1 AND s.end_s > s.start_s GROUP BY ALL""", TASKS)
def _(d):
    return rewards.final_evidence(evidence(d), d.sessions).groupBy("expedition_id").agg(F.count(F.lit(1)).alias("loops"))


