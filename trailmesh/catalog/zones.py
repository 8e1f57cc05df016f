"""Queries on zones and their completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmesh.catalog.cells import explored, route_lines, walked
from trailmesh.catalog.registry import query
from trailmesh.operators import grid, loops, sets, zones
from trailmesh.sources import osm

# The same boundaries as SQL: a rectangle holds a point if min <= v < max on both axes.
ZCTE = {
    "centres": """
SELECT owner_id, cell_x, cell_y, degrees((cell_x * 15 + 7.5) / 6378137.0) AS c_lon,
       degrees(atan(exp((cell_y * 15 + 7.5) / 6378137.0)) * 2 - pi() / 2) AS c_lat FROM ocells""",
    "incell": """
SELECT owner_id, cell_x, cell_y, z.id AS zone_id FROM centres c JOIN zones z
  ON c_lat >= z.min_lat AND c_lat < z.max_lat AND c_lon >= z.min_lon AND c_lon < z.max_lon""",
    "zrows": """
SELECT id, y FROM zones, LATERAL (SELECT unnest(range(CAST(floor({mercy:min_lat} / 15) AS INT) - 1, CAST(floor({mercy:max_lat} / 15) AS INT) + 2)) AS y)
WHERE degrees(atan(exp((y * 15 + 7.5) / 6378137.0)) * 2 - pi() / 2) >= min_lat
  AND degrees(atan(exp((y * 15 + 7.5) / 6378137.0)) * 2 - pi() / 2) < max_lat""",
    "zcols": """
SELECT id, x FROM zones, LATERAL (SELECT unnest(range(CAST(floor({mercx:min_lon} / 15) AS INT) - 1, CAST(floor({mercx:max_lon} / 15) AS INT) + 2)) AS x)
WHERE degrees((x * 15 + 7.5) / 6378137.0) >= min_lon AND degrees((x * 15 + 7.5) / 6378137.0) < max_lon""",
    "ztot": """
SELECT r.id, r.n * c.n AS total FROM (SELECT id, count(*) AS n FROM zrows GROUP BY id) r
JOIN (SELECT id, count(*) AS n FROM zcols GROUP BY id) c ON c.id = r.id""",
    "zbox": """
SELECT id, (CAST(floor({mercx:max_lon} / 15) AS BIGINT) - CAST(floor({mercx:min_lon} / 15) AS BIGINT) + 1)
         * (CAST(floor({mercy:max_lat} / 15) AS BIGINT) - CAST(floor({mercy:min_lat} / 15) AS BIGINT) + 1) AS box FROM zones""",
    "zcomp": """
SELECT i.owner_id, i.zone_id, count(*) AS explored, any_value(t.total) AS total, any_value(z.admin_level) AS lvl
FROM incell i JOIN ztot t ON t.id = i.zone_id JOIN zones z ON z.id = i.zone_id GROUP BY i.owner_id, i.zone_id""",
}


@query("joi4_cells_in_zones", "SELECT owner_id, cell_x, cell_y, zone_id FROM incell", ZCTE)
def _(d):
    return zones.cells_in_zones(explored(d), d.zones).select("owner_id", "cell_x", "cell_y", "zone_id")


@query("joi4_fixes_in_zones", """
SELECT observation_id, z.id AS zone_id FROM obs o JOIN zones z
  ON o.lat >= z.min_lat AND o.lat < z.max_lat AND o.lon >= z.min_lon AND o.lon < z.max_lon""", ZCTE)
def _(d):
    return zones.points_in_zones(d.observations, d.zones, ["observation_id"])


@query("agg13_zone_totals", """
SELECT b.id AS zone_id, b.box AS box_cells, t.total AS total_cells
FROM zbox b JOIN ztot t ON t.id = b.id""", ZCTE)
def _(d):
    return zones.zone_totals(d.zones)


def suppliers(zone_id: str = "id"):
    return F.regexp_extract(zone_id, "([0-9]+)$", 1).cast("long")


# The rectangles of the suppliers, and the cells with their centre inside: rows times columns.
BLOCKS = {
    "blocks": """
SELECT s_suppkey AS k, (45750000 + s_suppkey % 200 * 1500) / 1e6 AS min_lat,
       (45750000 + s_suppkey % 200 * 1500 + 700 + s_suppkey % 7 * 300) / 1e6 AS max_lat,
       (4800000 + s_suppkey // 200 * 3000) / 1e6 AS min_lon,
       (4800000 + s_suppkey // 200 * 3000 + 900 + s_suppkey % 5 * 400) / 1e6 AS max_lon FROM supplier""",
    "brows": """
SELECT k, count(*) AS n FROM (SELECT k, min_lat, max_lat, unnest(range(CAST(floor({mercy:min_lat} / 15) AS INT) - 1,
  CAST(floor({mercy:max_lat} / 15) AS INT) + 2)) AS y FROM blocks)
WHERE degrees(atan(exp((y * 15 + 7.5) / 6378137.0)) * 2 - pi() / 2) >= min_lat
  AND degrees(atan(exp((y * 15 + 7.5) / 6378137.0)) * 2 - pi() / 2) < max_lat GROUP BY k""",
    "bcols": """
SELECT k, count(*) AS n FROM (SELECT k, min_lon, max_lon, unnest(range(CAST(floor({mercx:min_lon} / 15) AS INT) - 1,
  CAST(floor({mercx:max_lon} / 15) AS INT) + 2)) AS x FROM blocks)
WHERE degrees((x * 15 + 7.5) / 6378137.0) >= min_lon AND degrees((x * 15 + 7.5) / 6378137.0) < max_lon GROUP BY k"""}


@query("agg13_refreshed_totals", """
SELECT concat('relation/', CAST(r.k AS VARCHAR)) AS zone_id, r.k % 4 = 0 AS reused,
       CASE WHEN r.k % 4 = 0 THEN 100000 + r.k ELSE r.n * c.n END AS total_cells
FROM brows r JOIN bcols c ON c.k = r.k""", BLOCKS)
def _(d):
    """Every fourth total is stored for the present shape, every fourth for another one or another cell size, others not at all."""
    k = suppliers("zone_id")
    counts = d.blocks.select(F.col("id").alias("zone_id")).withColumn("total_cells", 100_000 + k)
    stored = zones.stored_totals(d.blocks, counts).filter(k % 4 != 3).withColumns({
        "geometry_fingerprint": F.when(k % 4 == 1, "fnv1a:00000000").otherwise(F.col("geometry_fingerprint")),
        "cell_size_m": F.when(k % 4 == 2, 2 * F.col("cell_size_m")).otherwise(F.col("cell_size_m"))})
    return zones.refreshed_totals(d.blocks, stored).select("zone_id", "reused", "total_cells")


@query("set6_dependents_of_zones", """
SELECT c_custkey AS owner_id, concat('relation/', CAST(s_suppkey AS VARCHAR)) AS zone_id,
       CASE WHEN s_suppkey % 4 = 2 THEN concat('New ', s_name) ELSE s_name END AS name
FROM customer JOIN supplier ON s_suppkey = c_custkey // 15 + 1 WHERE s_suppkey % 4 <> 1""")
def _(d):
    """Of the zones a fourth arrives as a fallback of another shape, a fourth with another shape, a fourth with a new name."""
    k = suppliers()
    north = F.transform("rings", lambda ring: F.transform(
        ring, lambda p: F.struct((p["lat"] + 0.001).alias("lat"), p["lon"].alias("lon"))))
    arrived = d.blocks.filter(k % 4 != 3).withColumns({
        "source": F.when(k % 4 == 0, "openstreetmap_incomplete_fallback").otherwise("openstreetmap"),
        "name": F.when(k % 4 == 1, F.col("name")).otherwise(F.concat(F.lit("New "), F.col("name"))),
        "rings": F.when(k % 4 == 2, F.col("rings")).otherwise(north)})
    snapshots = d.table("customer").select(
        F.col("c_custkey").alias("owner_id"),
        F.concat(F.lit("relation/"), (F.floor(F.col("c_custkey") / 15) + 1).cast("string")).alias("zone_id"))
    merged, (kept,) = zones.replace_zones(d.blocks, arrived, snapshots)
    return kept.join(merged.select(F.col("id").alias("zone_id"), "name"), "zone_id").select("owner_id", "zone_id", "name")


def asked_zones(d):
    """Every walker asks for two zones, whether or not they have been there."""
    owner = F.col("owner_id")
    pairs = d.sessions.select("owner_id").distinct().select("owner_id", F.explode(F.array(owner % 5, (owner + 1) % 5)).alias("k"))
    return pairs.select("owner_id", F.concat(F.lit("relation/"), F.col("k").cast("string")).alias("zone_id"))


@query("agg14_zone_completion", """
SELECT a.owner_id, z.id AS zone_id, coalesce(c.explored, 0) AS explored_cells, CASE WHEN z.admin_level = 9 THEN t.total END AS total_cells,
       CASE WHEN z.admin_level = 9 THEN least(100, floor(coalesce(c.explored, 0) / t.total * 1000 + 0.5) / 10) END AS percent,
       CASE WHEN z.admin_level = 9 THEN 'available' ELSE 'invalid_boundary' END AS status
FROM (SELECT DISTINCT owner_id FROM sess) a
JOIN zones z ON CAST(split_part(z.id, '/', 2) AS BIGINT) IN (a.owner_id % 5, (a.owner_id + 1) % 5)
JOIN ztot t ON t.id = z.id LEFT JOIN zcomp c ON c.owner_id = a.owner_id AND c.zone_id = z.id""", ZCTE)
def _(d):
    cells = explored(d).withColumn("source", F.lit("gps"))
    none = d.spark.createDataFrame([], "owner_id long, zone_id string, completed_at timestamp")
    return zones.zone_completion(cells, d.zones, none, asked=asked_zones(d)).select(
        "owner_id", "zone_id", "explored_cells", "total_cells", "percent", "status")


@query("agg14_completion_with_fills", """
SELECT owner_id, zone_id, count(*) AS explored_cells, count(CASE WHEN s = 'gps' THEN 1 END) AS walked_cells,
       count(CASE WHEN s = 'loop_fill' THEN 1 END) AS loop_cells
FROM (SELECT c.owner_id, c.s, z.id AS zone_id FROM (
        SELECT owner_id, s, degrees((cell_x * 15 + 7.5) / 6378137.0) AS c_lon,
               degrees(atan(exp((cell_y * 15 + 7.5) / 6378137.0)) * 2 - pi() / 2) AS c_lat
        FROM (SELECT *, 'gps' AS s FROM ocells UNION ALL SELECT *, 'loop_fill' FROM ofill)) c
      JOIN zones z ON c_lat >= z.min_lat AND c_lat < z.max_lat AND c_lon >= z.min_lon AND c_lon < z.max_lon)
GROUP BY owner_id, zone_id""", ZCTE)
def _(d):
    cells = explored(d).withColumn("source", F.lit("gps"))
    whole = loops.completion_cells(cells, cells.limit(0), ["owner_id"])
    none = d.spark.createDataFrame([], "owner_id long, zone_id string, completed_at timestamp")
    return zones.zone_completion(whole, d.zones, none).select(
        "owner_id", "zone_id", "explored_cells", "walked_cells", "loop_cells")


def small_zones(d):
    """A district around each medal, small enough to be completed."""
    box = d.medals.select(
        F.concat(F.lit("relation/m"), F.col("medal_id").cast("string")).alias("id"), "lat", "lon", "medal_id")
    corner = lambda dy, dx: F.struct((F.col("lat") + dy).alias("lat"), (F.col("lon") + dx).alias("lon"))
    ring = F.array(corner(-0.00053, -0.0005), corner(-0.00053, 0.0005), corner(-0.00047, 0.0005), corner(-0.00047, -0.0005))
    return box.select(
        "id", F.lit("district").alias("type"), F.concat(F.lit("District "), F.col("medal_id").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("parent_zone_id"), F.lit(9).alias("admin_level"), F.lit("openstreetmap").alias("source"),
        F.array(ring).alias("rings"), F.array().cast("array<array<struct<lat:double,lon:double>>>").alias("holes"),
        F.timestamp_seconds(F.lit(0)).alias("fetched_at"))


SMALL = {
    **ZCTE,
    "zones": """
SELECT concat('relation/m', CAST(medal_id AS VARCHAR)) AS id, lat + -0.00053 AS min_lat, lat + -0.00047 AS max_lat,
       lon + -0.0005 AS min_lon, lon + 0.0005 AS max_lon, 9 AS admin_level FROM medal""",
}


@query("agg14_new_achievements", """
SELECT owner_id, zone_id, explored AS explored_cells, total AS total_cells FROM zcomp
WHERE explored >= total AND NOT (owner_id % 3 = 0)""", SMALL)
def _(d):
    cells = explored(d).withColumn("source", F.lit("gps"))
    none = d.spark.createDataFrame([], "owner_id long, zone_id string, completed_at timestamp")
    completion = zones.zone_completion(cells, small_zones(d), none)
    stored = completion.filter("owner_id % 3 = 0").select("owner_id", "zone_id")
    out = zones.new_achievements(completion, stored, F.timestamp_seconds(F.lit(0)))
    return out.select("owner_id", "zone_id", "explored_cells", "total_cells")


@query("agg15_progress_delta", """
SELECT a.owner_id, a.zone_id, a.explored - coalesce(b.explored, 0) AS cells,
       CASE WHEN b.explored IS NOT NULL AND a.lvl = 9 THEN floor((least(100, floor(a.explored / a.total * 1000 + 0.5) / 10)
             - least(100, floor(b.explored / b.total * 1000 + 0.5) / 10)) * 10 + 0.5) / 10 END AS percent,
       CASE WHEN a.lvl = 9 THEN greatest(0, a.total - a.explored) END AS remaining_cells
FROM zcomp a LEFT JOIN (
  SELECT i.owner_id, i.zone_id, count(*) AS explored, any_value(t.total) AS total FROM incell i JOIN ztot t ON t.id = i.zone_id
  WHERE (owner_id, cell_x, cell_y) IN (SELECT (owner_id, cell_x, cell_y) FROM cells WHERE session_id % 100 = 0)
  GROUP BY i.owner_id, i.zone_id) b ON b.owner_id = a.owner_id AND b.zone_id = a.zone_id""", ZCTE)
def _(d):
    cells = walked(d).withColumn("source", F.lit("gps"))
    none = d.spark.createDataFrame([], "owner_id long, zone_id string, completed_at timestamp")
    after = zones.zone_completion(cells, d.zones, none)
    before = zones.zone_completion(cells.filter("session_id % 100 = 0"), d.zones, none)
    return zones.progress_delta(before, after)


@query("agg16_achievement_rollup", """
SELECT owner_id, 'district' AS zone_type, count(*) AS zones FROM zcomp WHERE lvl = 9 GROUP BY owner_id""", ZCTE)
def _(d):
    achieved = zones.cells_in_zones(explored(d), d.zones).select("owner_id", "zone_id").distinct().withColumn(
        "zone_type", F.lit("district"))
    return zones.achievement_rollup(achieved, d.zones)


@query("flt8_eligible_zones", """
SELECT id AS zone_id, admin_level = 9 AS is_eligible FROM zones""", ZCTE)
def _(d):
    return d.zones.select(F.col("id").alias("zone_id"), zones.is_eligible().alias("is_eligible"))


@query("flt8_zone_scope", """
SELECT p_partkey AS id, CASE p_size WHEN 2 THEN 'country' WHEN 8 THEN 'city' WHEN 9 THEN 'district' WHEN 10 THEN 'district' END AS scope
FROM part""")
def _(d):
    return d.table("part").select(F.col("p_partkey").alias("id"), osm.zone_scope(F.col("p_size").cast("string")).alias("scope"))


@query("flt13_stale_boundaries", """
SELECT o_orderkey AS id, o_orderdate IS NULL OR date_diff('day', o_orderdate, TIMESTAMP '1998-10-31 00:00:00') >= 30 AS is_stale
FROM orders""")
def _(d):
    return d.table("orders").select(
        F.col("o_orderkey").alias("id"),
        osm.is_stale(F.col("o_orderdate").cast("timestamp"), F.lit("1998-10-31 00:00:00").cast("timestamp")).alias("is_stale"))


@query("joi15_zone_of_fix", """
SELECT observation_id, arg_min(zone_id, (CASE WHEN inside THEN 0 ELSE 1 END) * 1e9 + (CASE WHEN inside THEN 0 ELSE dist END)) AS zone_id,
       min(CASE WHEN inside THEN 0 ELSE 1 END) AS rank
FROM (SELECT o.observation_id, z.id AS zone_id,
             o.lat >= z.min_lat AND o.lat < z.max_lat AND o.lon >= z.min_lon AND o.lon < z.max_lon AS inside,
             {hav:o.lat|o.lon|(z.min_lat + z.max_lat) / 2|(z.min_lon + z.max_lon) / 2} AS dist
      FROM obs o CROSS JOIN zones z) GROUP BY observation_id""", ZCTE)
def _(d):
    return zones.best_zone(d.observations, d.zones, ["observation_id"]).select("observation_id", "zone_id", "rank")


@query("joi15_next_zone", """
SELECT owner_id, arg_min(zone_id, score) AS zone_id, min(CASE WHEN inside THEN 0 ELSE 1 END) AS rank
FROM (SELECT p.owner_id, z.id AS zone_id, inside, CASE WHEN inside THEN 0 ELSE 1e9 + dist END AS score
      FROM (SELECT o.owner_id, z.id,
                   o.lat >= z.min_lat AND o.lat < z.max_lat AND o.lon >= z.min_lon AND o.lon < z.max_lon AS inside,
                   {hav:o.lat|o.lon|(z.min_lat + z.max_lat) / 2|(z.min_lon + z.max_lon) / 2} AS dist
            FROM (SELECT owner_id, arg_max(lat, observation_id) AS lat, arg_max(lon, observation_id) AS lon
                  FROM obs GROUP BY owner_id) o CROSS JOIN zones z) p
      JOIN zones z ON z.id = p.id
      WHERE NOT EXISTS (SELECT 1 FROM zcomp c WHERE c.owner_id = p.owner_id AND c.zone_id = p.id))
GROUP BY owner_id""", SMALL)
def _(d):
    """From the last fix of each walker the nearest small district in which nothing is explored yet."""
    where = d.observations.groupBy("owner_id").agg(
        F.max_by("lat", "observation_id").alias("lat"), F.max_by("lon", "observation_id").alias("lon"))
    areas = small_zones(d)
    begun = zones.cells_in_zones(explored(d), areas).select("owner_id", "zone_id").distinct()
    return zones.next_zone(where, areas, begun, ["owner_id"]).select("owner_id", "zone_id", "rank")


@query("joi16_streets_in_zones", """
SELECT DISTINCT s.id AS segment_id, z.id AS zone_id FROM (
  SELECT id, lat1 AS lat, lon1 AS lon FROM streets UNION ALL SELECT id, lat2, lon2 FROM streets) s
JOIN zones z ON s.lat >= z.min_lat AND s.lat < z.max_lat AND s.lon >= z.min_lon AND s.lon < z.max_lon""", ZCTE)
def _(d):
    return zones.parts_in_zones(d.streets, d.zones)


@query("joi16_medals_in_zones", """
SELECT medal_id, z.id AS zone_id FROM medal m JOIN zones z
  ON m.lat >= z.min_lat AND m.lat < z.max_lat AND m.lon >= z.min_lon AND m.lon < z.max_lon""", ZCTE)
def _(d):
    return zones.points_in_zones(d.medals, d.zones, ["medal_id"])


@query("joi20_zones_to_recompute", """
SELECT c.owner_id, c.zone_id FROM zcomp c JOIN (SELECT owner_id, count(*) AS rev FROM ocells GROUP BY owner_id) r
  ON r.owner_id = c.owner_id WHERE (c.owner_id + length(c.zone_id)) % 2 = 1 OR c.owner_id % 5 = 0""", ZCTE)
def _(d):
    """Stored results are valid for the same geometry and revision; the rest is computed again."""
    cells = explored(d)
    rev = cells.groupBy("owner_id").agg(F.count(F.lit(1)).alias("revision"))
    shape = d.zones.select(F.col("id").alias("zone_id"), zones.fingerprint().alias("fingerprint"))
    asked = zones.cells_in_zones(cells, d.zones).select("owner_id", "zone_id").distinct()
    current = asked.join(rev, "owner_id").join(shape, "zone_id")
    stored = current.filter((F.col("owner_id") + F.length("zone_id")) % 2 == 0).withColumn(
        "revision", F.when(F.col("owner_id") % 5 == 0, F.col("revision") - 1).otherwise(F.col("revision")))
    return sets.to_recompute(current, stored, ["owner_id", "zone_id"], ["fingerprint", "revision"]).select(
        "owner_id", "zone_id")


@query("set6_upsert_zones", """
SELECT id, 'openstreetmap' AS source,
       CASE WHEN k % 2 = 1 THEN concat('New ', name) ELSE name END AS name FROM zones""", ZCTE)
def _(d):
    """Even zones receive a fallback, which must not replace them; odd ones a new exact polygon."""
    k = F.regexp_extract("id", "([0-9]+)$", 1).cast("int")
    arrived = d.zones.withColumns({
        "name": F.concat(F.lit("New "), F.col("name")),
        "source": F.when(k % 2 == 0, "openstreetmap_incomplete_fallback").otherwise("openstreetmap")})
    return zones.merge_zones(d.zones, arrived).select("id", "source", "name")


def cities_and_districts(d):
    """The derived districts plus one city around the first three of them."""
    corner = lambda a, b: F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon"))
    ring = F.array(corner(45.7495, 4.79), corner(45.7495, 4.83), corner(45.7545, 4.83), corner(45.7545, 4.79))
    city = d.table("region").filter("r_regionkey = 0").select(
        F.lit("relation/city").alias("id"), F.lit("city").alias("type"), F.lit("City").alias("name"),
        F.lit(None).cast("string").alias("parent_zone_id"), F.lit(8).alias("admin_level"),
        F.lit("openstreetmap").alias("source"), F.array(ring).alias("rings"),
        F.array().cast("array<array<struct<lat:double,lon:double>>>").alias("holes"), F.timestamp_seconds(F.lit(0)).alias("fetched_at"))
    return d.zones.unionByName(city)


@query("joi5_district_parents", """
SELECT id, CASE WHEN k <= 2 THEN 'relation/city' END AS parent_zone_id FROM zones
UNION ALL SELECT 'relation/city', NULL""", ZCTE)
def _(d):
    return zones.district_parents(cities_and_districts(d)).select("id", "parent_zone_id")


def _corner(lat: str, lon: str) -> str:
    number = "regexp_replace(CAST({} AS VARCHAR), '[.]0$', '')".format
    return f"chr(123), '\"latitude\":', {number(lat)}, ',\"longitude\":', {number(lon)}, chr(125)"


# The geometry text of the rectangles, hashed character by character.
HASHED = {
    **ZCTE,
    "ztxt": "SELECT id AS k, concat(chr(123), '\"holes\":[],\"outer\":[[', " + ", ',', ".join([
        _corner("min_lat", "min_lon"), _corner("min_lat", "max_lon"), _corner("max_lat", "max_lon"), _corner("max_lat", "min_lon"),
    ]) + ", ']]', chr(125)) AS txt FROM zones",
    "zhash": """
SELECT k, txt, 0 AS i, CAST(2166136261 AS BIGINT) AS h FROM ztxt
UNION ALL
SELECT k, txt, i + 1, (xor(h, CAST(ord(substr(txt, i + 1, 1)) AS BIGINT)) * 16777619) & 4294967295 FROM zhash WHERE i < length(txt)""",
}


@query("geo14_zone_fingerprints", """
SELECT k AS id, concat('fnv1a:', lpad(lower(to_hex(h)), 8, '0')) AS fingerprint FROM zhash WHERE i = length(txt)""", HASHED)
def _(d):
    return d.zones.select("id", zones.fingerprint().alias("fingerprint"))


RELATIONS = {
    "rel": """
SELECT s_suppkey AS k, s_suppkey % 5 AS kind, s_suppkey * 700 - 7000 AS y, 9000 - s_suppkey * 300 AS x, s_name FROM supplier""",
}


@query("geo9_relation_rings", """
SELECT k AS id, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS outer_rings,
       CASE kind WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 3 ELSE 0 END AS open_pieces,
       CASE kind WHEN 0 THEN 2000.0 WHEN 1 THEN 2320.0 WHEN 2 THEN 2000.0 ELSE 0 END AS twice_area FROM rel""", RELATIONS)
def _(d):
    """Rings of relations in pieces: what closes, what stays open, and the area in 1e-9 square degrees."""
    found = osm.relation_rings(d.relations)
    area = F.aggregate("outer_rings", F.lit(0.0), lambda total, r: total + F.abs(osm.twice_signed_area(r)))
    return found.select("id", F.size("outer_rings").alias("outer_rings"), "open_pieces", F.round(area * 1e9, 3).alias("twice_area"))


@query("src4_relation_zones", """
SELECT concat('relation/', k) AS id, CASE WHEN k % 2 = 0 THEN 'district' ELSE 'city' END AS type, s_name AS name,
       CASE WHEN k % 2 = 0 THEN 9 ELSE 8 END AS admin_level,
       CASE WHEN kind < 2 THEN 'openstreetmap' ELSE 'openstreetmap_incomplete_fallback' END AS source,
       CASE kind WHEN 1 THEN 2 ELSE 1 END AS rings, CASE kind WHEN 1 THEN 10 ELSE 5 END AS points,
       round((y - CASE kind WHEN 1 THEN 400 WHEN 2 THEN 500 WHEN 3 THEN 500 ELSE 0 END) / 1e6, 6) AS min_lat,
       round((y + 1000) / 1e6, 6) AS max_lat FROM rel""", RELATIONS)
def _(d):
    """Boundary relations as zones: exact rings where every piece closes, else their box."""
    found = osm.relation_zones(d.relations, F.timestamp_seconds(F.lit(0)))
    lats = F.transform(F.flatten("rings"), lambda p: p["lat"])
    return found.select("id", "type", "name", "admin_level", "source", F.size("rings").alias("rings"), F.size(lats).alias("points"),
                        F.round(F.array_min(lats), 6).alias("min_lat"), F.round(F.array_max(lats), 6).alias("max_lat"))


def _near_zero(dy: int, dx: int) -> str:
    """A corner by whole micro-degrees, without zeros at the end."""
    def number(v: str) -> str:
        return f"regexp_replace(regexp_replace(printf('%.6f', ({v}) / 1e6), '0+$', ''), '[.]$', '')"

    return (f"chr(123), '\"latitude\":', {number(f'y + {dy}')}, ',\"longitude\":', {number(f'x + {dx}')}, chr(125)")


@query("geo14_relation_fingerprints", """
SELECT k AS id, concat('fnv1a:', lpad(lower(to_hex(h)), 8, '0')) AS fingerprint FROM zhash WHERE i = length(txt)""", {
    **HASHED, **RELATIONS,
    "ztxt": "SELECT k, concat(chr(123), '\"holes\":[],\"outer\":[[', " + ", '],[', ".join(
        ", ',', ".join(_near_zero(*c) for c in ring) for ring in (
            ((0, 0), (0, 1000), (1000, 1000), (1000, 0), (0, 0)), ((0, 0), (0, -400), (-400, -400), (-400, 0), (0, 0)))
    ) + ", ']]', chr(125)) AS txt FROM rel WHERE kind = 1"})
def _(d):
    """Fingerprints of the touching rings, some of them within a thousandth of a degree of the equator or the meridian."""
    whole = osm.relation_zones(d.relations.filter("id % 5 = 1"), F.timestamp_seconds(F.lit(0)))
    return whole.select(F.regexp_extract("id", "[0-9]+", 0).cast("long").alias("id"), zones.fingerprint().alias("fingerprint"))


@query("geo3_sources_in_zones", """
SELECT c.owner_id, z.id AS zone_id, c.source, count(*) AS cells FROM (
  SELECT DISTINCT owner_id, cell_x, cell_y, source, degrees((cell_x * 15 + 7.5) / 6378137.0) AS c_lon,
         degrees(atan(exp((cell_y * 15 + 7.5) / 6378137.0)) * 2 - pi() / 2) AS c_lat FROM scells) c
JOIN zones z ON c_lat >= z.min_lat AND c_lat < z.max_lat AND c_lon >= z.min_lon AND c_lon < z.max_lon
GROUP BY ALL""", ZCTE)
def _(d):
    cells = grid.cells_by_source(route_lines(d)).select("owner_id", "cell_x", "cell_y", "source").distinct()
    return zones.cells_in_zones(cells, d.zones).groupBy("owner_id", "zone_id", "source").agg(F.count(F.lit(1)).alias("cells"))
