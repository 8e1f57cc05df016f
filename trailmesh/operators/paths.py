"""Steps between accepted points, route chunks and movement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmesh import constants as K
from trailmesh.functions.geo import bearing_deg, haversine_m, round_half_up
from trailmesh.operators.clean import RECORDING
from trailmesh.operators.ordered import time_slice, with_previous, with_running
from trailmesh.session import epoch_seconds


def steps(points: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Successive points of a recording as confirmed steps or gaps with a reason."""
    fields = ["lat", "lon", "ts", "accuracy", "point_index"]
    pairs = with_previous(points, keys, "ts", fields, time_slice()).filter(F.col("prev_ts").isNotNull())
    metres = haversine_m("prev_lat", "prev_lon", "lat", "lon")
    seconds = F.greatest(F.lit(0.0), epoch_seconds(F.col("ts")) - epoch_seconds(F.col("prev_ts")))
    measured = pairs.select(
        *keys,
        F.col("point_index").alias("step_no"),
        *[F.col(f"prev_{f}").alias(f"from_{f}") for f in fields],
        *[F.col(f).alias(f"to_{f}") for f in fields],
        metres.alias("distance_m"),
        seconds.alias("seconds"),
    )
    # Fixed wording.
    reason = F.when(
        (F.col("seconds") > 0) & (F.col("distance_m") / F.col("seconds") > K.MAX_SPEED_MPS),
        F.lit("impossible walk speed"),
    ).when(
        (F.col("distance_m") > K.MAX_CONFIRMED_STEP_M) & (F.col("seconds") > K.MAX_CONFIRMED_STEP_S),
        F.concat(
            F.lit("large GPS gap "), round_half_up("distance_m").cast("string"), F.lit(" m over "),
            round_half_up("seconds").cast("string"), F.lit(" s"),
        ),
    )
    return measured.withColumn("reason", reason).withColumn(
        "kind", F.when(F.col("reason").isNull(), "confirmed").otherwise("gap")
    )


def path_lengths(points: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    pairs = with_previous(points, keys, "ts", ["lat", "lon"], time_slice())
    return pairs.groupBy(*keys).agg(
        F.coalesce(F.sum(haversine_m("prev_lat", "prev_lon", "lat", "lon")), F.lit(0.0)).alias("distance_m"),
        F.count(F.lit(1)).alias("points"),
    )


def chunk_vertices(points: DataFrame, keys: Sequence[str] = RECORDING, closed: bool = True) -> DataFrame:
    """Vertices of the drawable route chunks.

    A chunk is a run of confirmed steps cut at 256 vertices; neighbours share the cut
    vertex. Runs of a single point vanish, but for the last one while still recording.
    """
    marked = steps(points, keys)
    breaks = marked.filter("kind = 'gap'").select(*keys, F.col("step_no").alias("point_index"), F.lit(1).alias("_gap"))
    runs = with_running(
        points.join(breaks, [*keys, "point_index"], "left"),
        keys, "ts", time_slice(), sums={"run_no": F.coalesce("_gap", F.lit(0))},
    ).drop("_gap")
    # Position within the run: runs are unbroken in point_index, so the first index is enough.
    spans = runs.groupBy(*keys, "run_no").agg(
        F.min("point_index").alias("_first"), F.max("point_index").alias("_last")
    )
    final = spans.groupBy(*keys).agg(F.max("run_no").alias("_final_run"))
    spans = spans.join(final, list(keys))
    placed = runs.join(spans, [*keys, "run_no"]).withColumn("_at", F.col("point_index") - F.col("_first"))
    single = F.col("_first") == F.col("_last")
    placed = placed.filter(~single if closed else ~single | (F.col("run_no") == F.col("_final_run")))
    stride = K.CHUNK_VERTICES - 1
    own = F.floor(F.col("_at") / stride)
    on_cut = (F.col("_at") % stride == 0) & (F.col("_at") > 0)
    is_last = F.col("point_index") == F.col("_last")
    chunks = F.when(on_cut & is_last, F.array(own - 1)).when(on_cut, F.array(own - 1, own)).otherwise(F.array(own))
    return placed.select(
        *[placed[c] for c in points.columns], "run_no", F.explode(chunks.cast("array<bigint>")).alias("chunk_no"),
        ((F.col("_last") > F.col("_first"))).alias("drawable"),
    )


def live_tail(points: DataFrame, keys: Sequence[str] = RECORDING, limit: int = K.LIVE_TAIL) -> DataFrame:
    """The newest points of each recording; numbering makes this a filter on the highest index."""
    newest = points.groupBy(*keys).agg(F.max("point_index").alias("_newest"))
    return points.join(newest, list(keys)).filter(F.col("point_index") > F.col("_newest") - limit).drop("_newest")


def points_after(points: DataFrame, index: int) -> DataFrame:
    return points.filter(F.col("point_index") > index)


def last_points(points: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.max("ts").alias("ts"),
        *[F.max_by(c, "ts").alias(c) for c in ("lat", "lon", "accuracy", "point_index")],
    )


def last_speeds(points: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Speed over the last two points; zero where there are not two or time stands still."""
    moved = steps(points, keys)
    speed = F.when(F.col("seconds") > 0, F.col("distance_m") / F.col("seconds")).otherwise(0.0)
    return moved.groupBy(*keys).agg(F.max_by(speed, F.col("step_no")).alias("last_speed_mps"))


def movement(points: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Bearing, speed, facing and a moving flag for each step."""
    walked = steps(points, keys)
    bearing = bearing_deg("from_lat", "from_lon", "to_lat", "to_lon")
    speed = F.when(F.col("seconds") > 0, F.col("distance_m") / F.col("seconds"))
    return walked.select(
        *keys, "step_no", "distance_m", "seconds", bearing.alias("bearing_deg"), speed.alias("speed_mps")
    ).withColumn("direction", facing(F.col("bearing_deg")))


def facing(bearing: Column) -> Column:
    """Four-way direction of a bearing."""
    b = F.pmod(bearing, F.lit(360.0))
    return F.when((b >= 45) & (b < 135), "east").when((b >= 135) & (b < 225), "south").when(
        (b >= 225) & (b < 315), "west").otherwise("north")


def bounds(points: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
    )


def _merge_pieces(keys: Sequence[str]):
    """Number drawable lines along sorted streams of pieces, carrying the size of the open line only."""

    def run(batches):
        current, number, size, open_line = None, -1, 0, False
        for batch in batches:
            out = []
            names = zip(*[batch[k].tolist() for k in keys])
            for name, kind, points, joined in zip(names, batch["type"], batch["vertices"], batch["joined"]):
                if name != current:
                    current, number, size, open_line = name, -1, 0, False
                if open_line and kind == "confirmed" and joined and size + points - 1 <= K.CHUNK_VERTICES:
                    size += points - 1
                else:
                    number, size = number + 1, points
                    open_line = kind == "confirmed"
                out.append(number)
            yield batch.assign(line_no=out)

    return run


def drawable_lines(segments: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Drawable lines of stored route segments: long ones are cut at 256 vertices, and confirmed pieces
    that adjoin are merged while they fit.

    ``segments`` carry seg_no, type, vertices and joined (starts where the one before ended).
    """
    keys = list(keys)
    stride = K.CHUNK_VERTICES - 1
    count = F.greatest(F.lit(1), F.ceil((F.col("vertices") - 1) / stride)).cast("int")
    pieces = segments.select(
        *keys, "seg_no", "type", F.col("vertices").alias("_all"), F.col("joined").alias("_first_joined"),
        F.explode(F.sequence(F.lit(0), count - 1)).alias("piece_no"),
    ).select(
        *keys, "seg_no", "piece_no", "type",
        F.least(F.lit(K.CHUNK_VERTICES), F.col("_all") - F.col("piece_no") * stride).cast("long").alias("vertices"),
        (F.col("_first_joined") | (F.col("piece_no") > 0)).alias("joined"), F.lit(0).cast("long").alias("line_no"))
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "seg_no", "piece_no").mapInPandas(
        _merge_pieces(keys), pieces.schema)
