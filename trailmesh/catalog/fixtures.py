"""Walk tables derived from the driver's tables, in integer micro-degrees."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmesh.operators import clean, paths
from trailmesh.operators.ordered import with_running
from trailmesh.session import checkpointed, dealt, scratch_folder

# Verdicts of a session, by application, scratch folder and table folder.
_VERDICTS: dict[tuple[str, str, str], DataFrame] = {}


def _side(k, at_side) -> F.Column:
    """One of four expressions by side number."""
    return F.when(k == 0, at_side[0]).when(k == 1, at_side[1]).when(k == 2, at_side[2]).otherwise(at_side[3])


class Data:
    """Lazy derived tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def observations(self) -> DataFrame:
        events = self.table("events").select("event_id", "user_id", "event_type", "ts")
        seq = with_running(events, ["user_id"], ["ts", "event_id"], F.to_date("ts"), index="seq")
        s, e, u = F.col("seq") % 41, F.col("event_id"), F.col("user_id")
        lap = F.floor(F.col("seq") / 41).cast("long")
        north = F.when(s <= 10, 0).when(s <= 20, s - 10).when(s <= 30, 10).otherwise(40 - s)
        east = F.when(s <= 10, s).when(s <= 20, 10).when(s <= 30, 30 - s).otherwise(0)
        lat = (F.lit(45750000) + F.floor(u / 25).cast("long") * 1500 + lap * 300 + north * 100
               + F.when(e % 29 == 0, 900).otherwise(0))
        lon = F.lit(4800000) + (u % 25) * 2200 + east * 143
        accuracy = F.when(e % 17 == 0, 45).when(e % 11 == 0, None).otherwise(4 + e % 20)
        return seq.filter(~((F.col("event_type") == "error") & (e % 3 == 0))).select(
            u.alias("owner_id"),
            (u * 100 + lap).alias("session_id"),
            e.alias("observation_id"),
            F.timestamp_seconds((u * 100 + lap) * 1000 + 5 * s).alias("ts"),
            (lat / 1e6).alias("lat"),
            (lon / 1e6).alias("lon"),
            accuracy.cast("double").alias("accuracy"),
            e.alias("arrival"),
        )

    @cached_property
    def verdicts(self) -> DataFrame:
        """Written once per session and folder: nearly every query starts here."""
        key = (self.spark.sparkContext.applicationId, scratch_folder(self.spark), self.sf_dir)
        if key not in _VERDICTS:
            cleaned = clean.best_observations(self.observations.filter(clean.is_valid_fix()))
            _VERDICTS[key] = checkpointed(clean.accept_fixes(checkpointed(cleaned)))
        return _VERDICTS[key]

    @cached_property
    def points(self) -> DataFrame:
        return clean.accepted_points(self.verdicts)

    @cached_property
    def steps(self) -> DataFrame:
        return paths.steps(self.points)

    @cached_property
    def sessions(self) -> DataFrame:
        spans = self.observations.groupBy("owner_id", "session_id").agg(
            F.min("ts").alias("started_at"), F.max("ts").alias("_last"),
            (F.count(F.lit(1)) * 7).alias("step_count"),
        )
        sid = F.col("session_id")
        return spans.select(
            "owner_id", "session_id", F.lit("walk").alias("activity_mode"),
            F.concat(F.lit("Walk "), sid.cast("string"),
                     F.when(sid % 3 == 0, ': été & "nuit"').otherwise("")).alias("display_name"),
            "started_at",
            F.when(sid % 37 == 0, F.col("started_at"))
            .otherwise(F.timestamp_seconds(F.unix_seconds("_last") + 5)).alias("ended_at"),
            "step_count",
        )

    @cached_property
    def patches(self) -> DataFrame:
        """Scattered cells, about two thirds of squares of 60: islands, holes, islands in holes, touching corners."""
        k, square = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 4000).cast("int")
        return self.table("orders").select(
            (square % 5).cast("long").alias("owner_id"), (square * 61 + F.col("o_custkey") % 60).cast("int").alias("cell_x"),
            ((F.floor(F.col("o_totalprice")) + k) % 60 - 30).cast("int").alias("cell_y")).distinct()

    @cached_property
    def relations(self) -> DataFrame:
        """A boundary relation per supplier: whole rings, touching ones, cut up, with a spur, or open; some near (0, 0)."""
        s, kind = F.col("s_suppkey"), F.col("s_suppkey") % 5
        lat0, lon0 = s * 700 - 7000, F.lit(9000) - s * 300

        def points(*at) -> F.Column:
            return F.array(*[F.struct((y / 1e6).alias("lat"), (x / 1e6).alias("lon")) for y, x in (
                (lat0 + dy, lon0 + dx) for dy, dx in at)])

        def pieces(*ways) -> F.Column:
            return F.array(*[F.struct(F.lit("way").alias("type"), F.lit("outer").alias("role"), points(*w).alias("geometry"))
                             for w in ways])

        a, b, c, d = (0, 0), (0, 1000), (1000, 1000), (1000, 0)
        spur, halves = (a, (-500, -500)), ((a, b, c), (a, d, c))
        members = F.when(kind == 0, pieces((c, d), (b, a), (d, a), (b, c))).when(
            kind == 1, pieces((a, b, c, d, a), (a, (0, -400), (-400, -400), (-400, 0), a))).when(
            kind == 2, pieces(*halves, spur)).when(kind == 3, pieces(spur, *halves)).otherwise(
            pieces((a, b), (b, c), (d, c)))
        return self.table("supplier").select(
            F.lit("relation").alias("type"), s.alias("id"), F.create_map(
                F.lit("admin_level"), F.when(s % 2 == 0, "9").otherwise("8"), F.lit("name"), F.col("s_name")).alias("tags"),
            F.lit(None).cast("struct<minlat:double,minlon:double,maxlat:double,maxlon:double>").alias("bounds"),
            members.alias("members"))

    @cached_property
    def discards(self) -> DataFrame:
        return self.sessions.filter("session_id % 23 = 0").select("owner_id", "session_id")

    @cached_property
    def streets(self) -> DataFrame:
        # Small rows, but forty streets each. Dealing by user would be left out, as the rows already lie by user.
        origins = dealt(self.table("events").select("user_id").distinct())
        region = self.table("region").filter("r_regionkey < 4").select("r_regionkey", "r_name")
        nation = self.table("nation").filter("n_nationkey < 10").select("n_nationkey")
        # Both grids are fixed at 4 and 10 rows by the filters, so this only multiplies by 40.
        grid = region.join(nation, F.lit(True))
        k, n, u = F.col("r_regionkey"), F.col("n_nationkey"), F.col("user_id")
        lat0 = F.lit(45750000) + F.floor(u / 25).cast("long") * 1500
        lon0 = F.lit(4800000) + (u % 25) * 2200
        ten = F.lit(10)
        lat1, lon1 = lat0 + 100 * _side(k, (F.lit(0), n, ten, 10 - n)), lon0 + 143 * _side(k, (n, ten, 10 - n, F.lit(0)))
        lat2 = lat0 + 100 * _side(k, (F.lit(0), n + 1, ten, 9 - n))
        lon2 = lon0 + 143 * _side(k, (n + 1, ten, 9 - n, F.lit(0)))
        lines = origins.join(F.broadcast(grid), F.lit(True)).select(
            F.concat(F.lit("way/"), (u * 10 + k).cast("string"), F.lit("/part/"), n.cast("string")).alias("id"),
            F.when((u % 7 == 0) & (k == 2), None)
            .otherwise(F.concat(F.lit("Rue "), u.cast("string"), F.lit(" "), F.col("r_name"))).alias("name"),
            F.when((u % 13 == 0) & (k == 3), "motorway").otherwise("residential").alias("highway"),
            (lat1 / 1e6).alias("lat1"), (lon1 / 1e6).alias("lon1"),
            (lat2 / 1e6).alias("lat2"), (lon2 / 1e6).alias("lon2"),
        )
        point = lambda a, b: F.struct(F.col(a).alias("lat"), F.col(b).alias("lon"))
        return lines.select(
            "id", "name", "highway",
            F.lit(None).cast("string").alias("access"), F.lit(None).cast("string").alias("foot"),
            F.lit(False).alias("bridge"), F.lit(False).alias("tunnel"), F.lit(0).alias("layer"),
            F.array(point("lat1", "lon1"), point("lat2", "lon2")).alias("coords"),
            F.least("lat1", "lat2").alias("min_lat"), F.greatest("lat1", "lat2").alias("max_lat"),
            F.least("lon1", "lon2").alias("min_lon"), F.greatest("lon1", "lon2").alias("max_lon"),
            F.timestamp_seconds(F.lit(0)).alias("fetched_at"),
        )

    @cached_property
    def zones(self) -> DataFrame:
        k = F.col("r_regionkey")
        box = self.table("region").select(
            F.concat(F.lit("relation/"), k.cast("string")).alias("id"),
            F.lit("district").alias("type"),
            F.col("r_name").alias("name"),
            F.lit(None).cast("string").alias("parent_zone_id"),
            F.when(k == 4, 10).otherwise(9).alias("admin_level"),
            F.lit("openstreetmap").alias("source"),
            ((45750000 - 200 + k * 1500) / 1e6).alias("lat1"), ((45750000 + 1300 + k * 1500) / 1e6).alias("lat2"),
            (F.lit(4800000 - 200) / 1e6).alias("lon1"), (F.lit(4800000 + 27500) / 1e6).alias("lon2"),
        )
        corner = lambda a, b: F.struct(F.col(a).alias("lat"), F.col(b).alias("lon"))
        ring = F.array(corner("lat1", "lon1"), corner("lat1", "lon2"), corner("lat2", "lon2"), corner("lat2", "lon1"))
        return box.select(
            "id", "type", "name", "parent_zone_id", "admin_level", "source",
            F.array(ring).alias("rings"),
            F.array().cast("array<array<struct<lat:double,lon:double>>>").alias("holes"),
            F.timestamp_seconds(F.lit(0)).alias("fetched_at"),
        )

    @cached_property
    def blocks(self) -> DataFrame:
        """A rectangular zone per supplier."""
        s = F.col("s_suppkey")
        south, west = F.lit(45750000) + (s % 200) * 1500, F.lit(4800000) + F.floor(s / 200).cast("long") * 3000
        north, east = south + 700 + (s % 7) * 300, west + 900 + (s % 5) * 400
        ring = F.array(*[F.struct((y / 1e6).alias("lat"), (x / 1e6).alias("lon"))
                         for y, x in ((south, west), (south, east), (north, east), (north, west))])
        return self.table("supplier").select(
            F.concat(F.lit("relation/"), s.cast("string")).alias("id"), F.lit("district").alias("type"), F.col("s_name").alias("name"),
            F.lit(None).cast("string").alias("parent_zone_id"), F.lit(9).alias("admin_level"), F.lit("openstreetmap").alias("source"),
            F.array(ring).alias("rings"), F.array().cast("array<array<struct<lat:double,lon:double>>>").alias("holes"),
            F.timestamp_seconds(F.lit(0)).alias("fetched_at"))

    @cached_property
    def medals(self) -> DataFrame:
        m = F.col("s_suppkey") % 150
        return self.table("supplier").select(
            F.lit("album/1").alias("album_id"),
            F.col("s_suppkey").alias("medal_id"),
            F.col("s_name").alias("name"),
            ((F.lit(45750000) + F.floor(m / 25).cast("long") * 1500 + 500) / 1e6).alias("lat"),
            ((F.lit(4800000) + (m % 25) * 2200 + 715) / 1e6).alias("lon"),
            F.col("s_suppkey").cast("int").alias("sort_order"),
        )
