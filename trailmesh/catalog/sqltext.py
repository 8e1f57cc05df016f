"""SQL building blocks for the cross-checks: common table expressions by name.

``with_ctes(body)`` puts the expressions that a body mentions, and those that they
mention, in front of it. ``{hav:a,b,c,d}`` and friends expand to formulas.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def hav(a: str, b: str, c: str, d: str) -> str:
    s1 = f"sin(radians(({c}) - ({a})) / 2)"
    s2 = f"sin(radians(({d}) - ({b})) / 2)"
    h = f"({s1} * {s1} + cos(radians({a})) * cos(radians({c})) * {s2} * {s2})"
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def mercx(lon: str) -> str:
    return f"(6378137.0 * radians({lon}))"


def mercy(lat: str) -> str:
    return f"(6378137.0 * ln(tan(pi() / 4 + radians({lat}) / 2)))"


def planx(lon: str, ref: str) -> str:
    return f"(({lon}) * 111320.0 * cos(radians({ref})))"


def plany(lat: str) -> str:
    return f"(({lat}) * 111320.0)"


def prog(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    dx, dy = f"(({bx}) - ({ax}))", f"(({by}) - ({ay}))"
    sq = f"({dx} * {dx} + {dy} * {dy})"
    return (
        f"(CASE WHEN {sq} = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, "
        f"((({px}) - ({ax})) * {dx} + (({py}) - ({ay})) * {dy}) / {sq})) END)"
    )


def hyp(dx: str, dy: str) -> str:
    return f"sqrt(({dx}) * ({dx}) + ({dy}) * ({dy}))"


FORMULAS = {"hav": hav, "mercx": mercx, "mercy": mercy, "planx": planx, "plany": plany, "prog": prog, "hyp": hyp}


def expand(text: str) -> str:
    def one(match: re.Match) -> str:
        args = [a.strip() for a in match.group(2).split("|")]
        return FORMULAS[match.group(1)](*args)

    pattern = re.compile(r"\{(\w+):([^{}]*)\}")
    while pattern.search(text):
        text = pattern.sub(one, text)
    return text


def with_ctes(body: str, extra: dict[str, str]) -> str:
    known = {**CTES, **extra}
    order: list[str] = []

    def need(text: str, me: str | None = None) -> None:
        for name in known:
            if name != me and name not in order and re.search(rf"\b{name}\b", text):
                need(known[name], name)
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return expand(body)
    # Shared steps are computed once; a step that refers to itself is kept anyway.
    def kept(name: str) -> str:
        return "" if re.search(rf"\b{name}\b", known[name]) else "MATERIALIZED "

    parts = ",\n".join(f"{n} AS {kept(n)}({known[n].strip()})" for n in order)
    return expand(f"WITH RECURSIVE {parts}\n{body.strip()}")


CTES["fx_seq"] = """
SELECT event_id, user_id, event_type,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq
FROM events"""

CTES["fx_lap"] = """
SELECT event_id, user_id, event_type, seq,
       CAST(floor(seq / 41.0) AS BIGINT) AS lap, CAST(seq % 41 AS BIGINT) AS s
FROM fx_seq"""

CTES["obs"] = """
SELECT event_id AS observation_id, user_id AS owner_id, user_id * 100 + lap AS session_id,
       (45750000 + CAST(floor(user_id / 25.0) AS BIGINT) * 1500 + lap * 300
         + 100 * (CASE WHEN s <= 10 THEN 0 WHEN s <= 20 THEN s - 10 WHEN s <= 30 THEN 10 ELSE 40 - s END)
         + (CASE WHEN event_id % 29 = 0 THEN 900 ELSE 0 END)) / 1e6 AS lat,
       (4800000 + (user_id % 25) * 2200
         + 143 * (CASE WHEN s <= 10 THEN s WHEN s <= 20 THEN 10 WHEN s <= 30 THEN 30 - s ELSE 0 END)) / 1e6 AS lon,
       (user_id * 100 + lap) * 1000 + 5 * s AS t_s,
       CASE WHEN event_id % 17 = 0 THEN 45 WHEN event_id % 11 = 0 THEN NULL
            ELSE 4 + event_id % 20 END AS accuracy
FROM fx_lap WHERE NOT (event_type = 'error' AND event_id % 3 = 0)"""

CTES["sess"] = """
SELECT owner_id, session_id, 'walk' AS activity_mode,
       concat('Walk ', CAST(session_id AS VARCHAR), CASE WHEN session_id % 3 = 0 THEN ': été & "nuit"' ELSE '' END)
         AS display_name,
       min(t_s) AS start_s,
       CASE WHEN session_id % 37 = 0 THEN min(t_s) ELSE max(t_s) + 5 END AS end_s,
       CAST(count(*) * 7 AS BIGINT) AS step_count
FROM obs GROUP BY owner_id, session_id"""

CTES["discards"] = "SELECT session_id FROM sess WHERE session_id % 23 = 0"

CTES["final_sess"] = """
SELECT * FROM sess WHERE end_s > start_s AND session_id NOT IN (SELECT session_id FROM discards)"""

CTES["obs_rn"] = """
SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_s) AS rn FROM obs"""

CTES["fold"] = """
SELECT session_id, rn, CASE WHEN accuracy > 30 THEN 'weak' ELSE 'accepted' END AS verdict,
       CASE WHEN accuracy > 30 THEN NULL ELSE lat END AS a_lat,
       CASE WHEN accuracy > 30 THEN NULL ELSE lon END AS a_lon,
       CASE WHEN accuracy > 30 THEN NULL ELSE t_s END AS a_t, CAST(0 AS DOUBLE) AS speed
FROM obs_rn WHERE rn = 1
UNION ALL
SELECT session_id, rn, verdict,
       CASE WHEN verdict = 'accepted' THEN lat ELSE a_lat END,
       CASE WHEN verdict = 'accepted' THEN lon ELSE a_lon END,
       CASE WHEN verdict = 'accepted' THEN t_s ELSE a_t END,
       CASE WHEN verdict IN ('accepted', 'jump') AND a_t IS NOT NULL THEN d / (t_s - a_t) ELSE 0 END
FROM (SELECT o.session_id, o.rn, o.lat, o.lon, o.t_s, f.a_lat, f.a_lon, f.a_t,
             {hav:f.a_lat|f.a_lon|o.lat|o.lon} AS d,
             CASE WHEN o.accuracy > 30 THEN 'weak'
                  WHEN f.a_t IS NULL THEN 'accepted'
                  WHEN o.t_s < f.a_t THEN 'stale'
                  WHEN {hav:f.a_lat|f.a_lon|o.lat|o.lon} < 1 THEN 'still'
                  WHEN {hav:f.a_lat|f.a_lon|o.lat|o.lon} / (o.t_s - f.a_t) > 4 THEN 'jump'
                  ELSE 'accepted' END AS verdict
      FROM fold f JOIN obs_rn o ON o.session_id = f.session_id AND o.rn = f.rn + 1)"""

CTES["verdicts"] = """
SELECT o.*, f.verdict, f.speed FROM obs_rn o JOIN fold f ON o.session_id = f.session_id AND o.rn = f.rn"""

CTES["pts"] = """
SELECT owner_id, session_id, observation_id, t_s, lat, lon, accuracy, speed,
       row_number() OVER (PARTITION BY session_id ORDER BY t_s) - 1 AS point_index
FROM verdicts WHERE verdict = 'accepted'"""

CTES["pairs"] = """
SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(t_s) OVER w AS p_t
FROM pts WINDOW w AS (PARTITION BY session_id ORDER BY t_s)"""

CTES["steps0"] = """
SELECT owner_id, session_id, point_index AS step_no, p_lat, p_lon, p_t, lat, lon, t_s,
       {hav:p_lat|p_lon|lat|lon} AS d, t_s - p_t AS dt
FROM pairs WHERE p_t IS NOT NULL"""

CTES["steps"] = """
SELECT *, CASE WHEN dt > 0 AND d / dt > 4 THEN 'impossible walk speed'
               WHEN d > 15 AND dt > 6 THEN concat('large GPS gap ', CAST(CAST(floor(d + 0.5) AS BIGINT) AS VARCHAR),
                    ' m over ', CAST(CAST(floor(dt + 0.5) AS BIGINT) AS VARCHAR), ' s') END AS reason
FROM steps0"""

CTES["merc"] = """
SELECT owner_id, session_id, step_no, {mercx:p_lon} AS ax, {mercy:p_lat} AS ay, {mercx:lon} AS bx, {mercy:lat} AS bx_y
FROM steps WHERE reason IS NULL"""

CTES["samples"] = """
SELECT m.owner_id, m.session_id, ax + (bx - ax) * (i / n) AS sx, ay + (bx_y - ay) * (i / n) AS sy
FROM (SELECT *, greatest(1, CAST(ceil({hyp:bx - ax|bx_y - ay} / 3.75) AS INT)) AS n FROM merc) m,
     LATERAL (SELECT unnest(range(0, n + 1)) AS i)"""

CTES["offs"] = "SELECT a.v AS ox, b.v AS oy FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v)"

CTES["cells"] = """
SELECT DISTINCT owner_id, session_id, cx AS cell_x, cy AS cell_y
FROM (SELECT owner_id, session_id, sx, sy, CAST(floor(sx / 15) AS INT) + ox AS cx, CAST(floor(sy / 15) AS INT) + oy AS cy
      FROM samples, offs)
WHERE {hyp:cx * 15 + 7.5 - sx|cy * 15 + 7.5 - sy} <= 15 / sqrt(2.0)"""

CTES["ocells"] = "SELECT DISTINCT owner_id, cell_x, cell_y FROM cells"

CTES["lens"] = """
SELECT p.session_id, p.owner_id, count(*) AS points, coalesce(sum(d), 0) AS distance_m
FROM pts p LEFT JOIN steps0 s ON s.session_id = p.session_id AND s.step_no = p.point_index
GROUP BY p.session_id, p.owner_id"""

CTES["origins"] = """
SELECT DISTINCT user_id, 45750000 + CAST(floor(user_id / 25.0) AS BIGINT) * 1500 AS lat0,
       4800000 + (user_id % 25) * 2200 AS lon0 FROM events"""

CTES["streets"] = """
SELECT concat('way/', CAST(o.user_id * 10 + r.r_regionkey AS VARCHAR), '/part/', CAST(n.n_nationkey AS VARCHAR)) AS id,
       concat('way/', CAST(o.user_id * 10 + r.r_regionkey AS VARCHAR)) AS street_id,
       CASE WHEN o.user_id % 13 = 0 AND r.r_regionkey = 3 THEN 'motorway' ELSE 'residential' END AS highway,
       CASE WHEN o.user_id % 7 = 0 AND r.r_regionkey = 2 THEN NULL
            ELSE concat('Rue ', CAST(o.user_id AS VARCHAR), ' ', r.r_name) END AS name,
       (o.lat0 + 100 * (CASE r.r_regionkey WHEN 0 THEN 0 WHEN 1 THEN n.n_nationkey WHEN 2 THEN 10
            ELSE 10 - n.n_nationkey END)) / 1e6 AS lat1,
       (o.lon0 + 143 * (CASE r.r_regionkey WHEN 0 THEN n.n_nationkey WHEN 1 THEN 10 WHEN 2 THEN 10 - n.n_nationkey
            ELSE 0 END)) / 1e6 AS lon1,
       (o.lat0 + 100 * (CASE r.r_regionkey WHEN 0 THEN 0 WHEN 1 THEN n.n_nationkey + 1 WHEN 2 THEN 10
            ELSE 9 - n.n_nationkey END)) / 1e6 AS lat2,
       (o.lon0 + 143 * (CASE r.r_regionkey WHEN 0 THEN n.n_nationkey + 1 WHEN 1 THEN 10 WHEN 2 THEN 9 - n.n_nationkey
            ELSE 0 END)) / 1e6 AS lon2
FROM origins o CROSS JOIN (SELECT * FROM region WHERE r_regionkey < 4) r
CROSS JOIN (SELECT * FROM nation WHERE n_nationkey < 10) n"""

CTES["walkable"] = "SELECT *, {hav:lat1|lon1|lat2|lon2} AS len FROM streets WHERE highway <> 'motorway'"

CTES["zones"] = """
SELECT concat('relation/', CAST(r_regionkey AS VARCHAR)) AS id, r_name AS name, r_regionkey AS k,
       (45750000 - 200 + r_regionkey * 1500) / 1e6 AS min_lat, (45750000 + 1300 + r_regionkey * 1500) / 1e6 AS max_lat,
       (4800000 - 200) / 1e6 AS min_lon, (4800000 + 27500) / 1e6 AS max_lon,
       CASE WHEN r_regionkey = 4 THEN 10 ELSE 9 END AS admin_level
FROM region"""

CTES["medal"] = """
SELECT s_suppkey AS medal_id,
       (45750000 + CAST(floor((s_suppkey % 150) / 25.0) AS BIGINT) * 1500 + 500) / 1e6 AS lat,
       (4800000 + ((s_suppkey % 150) % 25) * 2200 + 715) / 1e6 AS lon
FROM supplier"""


def raster(source: str, keep: str, a_lat: str = "p_lat", a_lon: str = "p_lon", b_lat: str = "lat", b_lon: str = "lon") -> str:
    """Distinct (keep, cell_x, cell_y) of the lines in ``source``."""
    return f"""
SELECT DISTINCT {keep}, cx AS cell_x, cy AS cell_y FROM (
  SELECT {keep}, sx, sy, CAST(floor(sx / 15) AS INT) + ox AS cx, CAST(floor(sy / 15) AS INT) + oy AS cy FROM (
    SELECT {keep}, ax + (bx - ax) * (i / n) AS sx, ay + (b_y - ay) * (i / n) AS sy
    FROM (SELECT *, greatest(1, CAST(ceil({{hyp:bx - ax|b_y - ay}} / 3.75) AS INT)) AS n FROM (
            SELECT {keep}, {{mercx:{a_lon}}} AS ax, {{mercy:{a_lat}}} AS ay, {{mercx:{b_lon}}} AS bx,
                   {{mercy:{b_lat}}} AS b_y FROM {source})) m,
         LATERAL (SELECT unnest(range(0, n + 1)) AS i)) s, offs)
WHERE {{hyp:cx * 15 + 7.5 - sx|cy * 15 + 7.5 - sy}} <= 15 / sqrt(2.0)"""


CTES["recs"] = """
SELECT s.*, coalesce(l.distance_m, 0) AS distance_m, coalesce(l.points, 0) AS points, s.end_s - s.start_s AS duration_s
FROM sess s LEFT JOIN lens l ON l.session_id = s.session_id"""

CTES["final_recs"] = """
SELECT * FROM recs WHERE end_s > start_s AND session_id NOT IN (SELECT session_id FROM discards)"""

# Route lines: confirmed steps, and short gaps as inferred ones of changing confidence.
CTES["lines"] = """
SELECT owner_id, session_id, step_no, p_lat, p_lon, lat, lon,
       CASE WHEN reason IS NULL THEN 'confirmed' ELSE 'inferred' END AS type,
       CASE WHEN reason IS NULL THEN NULL WHEN step_no % 3 = 0 THEN 'low' WHEN step_no % 3 = 1 THEN 'medium'
            ELSE 'high' END AS confidence
FROM steps WHERE reason IS NULL OR d < 60"""

CTES["line_marks"] = """
SELECT *, CASE WHEN type = 'inferred' THEN 2 ELSE 1 END AS src FROM lines
WHERE type = 'confirmed' OR confidence IN ('high', 'medium')"""

CTES["line_cells"] = raster("line_marks", "owner_id, session_id, src")

CTES["scells"] = """
SELECT owner_id, session_id, cell_x, cell_y, CASE WHEN min(src) = 1 THEN 'gps' ELSE 'inferred' END AS source
FROM line_cells GROUP BY owner_id, session_id, cell_x, cell_y"""

# Enclosed cells per owner: what an 8-connected flood from outside cannot reach.
CTES["obox"] = """
SELECT owner_id, min(cell_x) - 1 AS x0, max(cell_x) + 1 AS x1, min(cell_y) - 1 AS y0, max(cell_y) + 1 AS y1
FROM ocells GROUP BY owner_id"""

CTES["oempty"] = """
SELECT b.owner_id, x.x, y.y FROM obox b, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS x) x,
     LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) y
WHERE NOT EXISTS (SELECT 1 FROM ocells c WHERE c.owner_id = b.owner_id AND c.cell_x = x.x AND c.cell_y = y.y)"""

CTES["oout"] = """
SELECT owner_id, x0 AS x, y0 AS y FROM obox
UNION
SELECT e.owner_id, e.x, e.y FROM oout f JOIN offs o ON true
JOIN oempty e ON e.owner_id = f.owner_id AND e.x = f.x + o.ox AND e.y = f.y + o.oy"""

CTES["oholes"] = """
SELECT owner_id, x, y FROM oempty EXCEPT SELECT owner_id, x, y FROM oout"""

CTES["oholes_seed"] = """
SELECT owner_id, x, y, x AS sx, y AS sy FROM oholes
UNION
SELECT h.owner_id, h.x, h.y, f.sx, f.sy FROM oholes_seed f JOIN offs o ON true
JOIN oholes h ON h.owner_id = f.owner_id AND h.x = f.x + o.ox AND h.y = f.y + o.oy"""

CTES["oholes_grp"] = """
SELECT owner_id, x, y, min(CAST(sx AS BIGINT) * 10000000 + sy) AS g FROM oholes_seed GROUP BY owner_id, x, y"""

CTES["ofill"] = """
SELECT owner_id, x AS cell_x, y AS cell_y FROM oholes_grp
WHERE (owner_id, g) IN (SELECT (owner_id, g) FROM oholes_grp GROUP BY owner_id, g HAVING count(*) <= 666)"""
