"""Where a device is shown: fixes adopted in the order of their arrival, and the first centre of a map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmesh import constants as K
from trailmesh.operators.ordered import SLICE
from trailmesh.session import epoch_seconds


def _on_the_map() -> Column:
    return F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False))


def _accuracy_within(limit: float) -> Column:
    """NaN is larger than any number, so it is never within."""
    return F.coalesce(F.col("accuracy").between(0, limit), F.lit(False))


def adopted_positions(arrivals: DataFrame, slice_by: Column, keys: Sequence[str] = ("owner_id",), order: str = "arrival",
                      max_accuracy: float = K.MAX_ACCURACY_M) -> DataFrame:
    """Adds ``adopted``: does the device's shown position move to this fix when it arrives?

    Takes ts, lat, lon, accuracy and on_route (true for accepted points of a route). The first fix with
    possible coordinates is adopted whatever its accuracy. Later ones must not be older than the
    position shown, and must be on the route or accurate enough. A fix without a time is older than all.
    ``order`` is unique within a key, and ``slice_by`` does not decrease along it.

    The position shown always has the latest time of all fixes so far that pass the rules on the fix
    alone, adopted or not, since those that were not are older. So a running maximum replaces the
    fold, and only one row per slice is carried on.
    """
    keys = list(keys)
    time = F.coalesce("ts", F.to_timestamp(F.lit("0001-01-01 00:00:00")))
    sound = F.coalesce(F.col("on_route"), F.lit(False)) | _accuracy_within(max_accuracy)
    rated = arrivals.select("*", slice_by.alias(SLICE), time.alias("_time"), _on_the_map().alias("_possible"),
                            (_on_the_map() & sound).alias("_sound"))
    possible, latest = F.when(F.col("_possible"), F.col(order)), F.when(F.col("_sound"), F.col("_time"))
    slices = rated.groupBy(*keys, SLICE).agg(
        F.min(possible).alias("_least"), F.min_by("_time", possible).alias("_time"), F.max(latest).alias("_latest"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    start = F.min(F.when(F.col("_least").isNotNull(), F.struct("_least", "_time"))).over(whole)
    carried = slices.withColumn("_start", start).select(
        *keys, SLICE, F.col("_start._least").alias("_first"),
        F.greatest(F.max("_latest").over(before),
                   F.max(F.when(F.col("_least") == F.col("_start._least"), F.col("_time"))).over(before)).alias("_carry"))
    within = Window.partitionBy(*keys, SLICE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rated.join(carried, [*keys, SLICE]).withColumn(
        "_candidate", F.col("_sound") | (F.col("_possible") & (F.col(order) == F.col("_first"))))
    shown = F.greatest("_carry", F.max(F.when(F.col("_candidate"), F.col("_time"))).over(within))
    adopted = F.col("_candidate") & F.coalesce(F.col("_time") >= shown, F.lit(True))
    return joined.select(*[rated[c] for c in arrivals.columns], F.coalesce(adopted, F.lit(False)).alias("adopted"))


def startup_centres(adopted: DataFrame, keys: Sequence[str] = ("owner_id",), order: str = "arrival",
                    max_accuracy: float = K.MAX_ACCURACY_M) -> DataFrame:
    """(keys, first_<order>, upgraded, then order, ts, lat, lon, accuracy, reliable of the centre), a row per key with one.

    Takes adopted fixes with on_route and seen_at. A fix off the route must be fresh when seen, and its accuracy
    possible or absent. The first such fix is the centre. If it is weak, the first reliable and
    substantially more accurate one that follows replaces it; a reliable centre stays. Both are
    minima that combine before the shuffle.
    """
    keys = list(keys)
    route = F.coalesce(F.col("on_route"), F.lit(False))
    possible = _accuracy_within(K.STARTUP_POSSIBLE_ACCURACY_M)
    fresh = F.abs(epoch_seconds(F.col("seen_at")) - epoch_seconds(F.col("ts"))) <= K.STARTUP_MAX_AGE_S
    usable = _on_the_map() & F.col("ts").isNotNull() & (
        route | (F.coalesce(fresh, F.lit(False)) & (F.col("accuracy").isNull() | possible)))
    known = F.when(possible, F.col("accuracy"))
    reliable = route | F.coalesce(known <= min(K.STARTUP_LOCK_ACCURACY_M, max_accuracy), F.lit(False))
    candidates = adopted.filter(usable).select(
        *keys, F.struct(order, "ts", "lat", "lon", "accuracy", known.alias("known"), reliable.alias("reliable")).alias("_fix"))
    first = candidates.groupBy(*keys).agg(F.min_by("_fix", f"_fix.{order}").alias("_first"))
    old, new = F.col("_first.known"), F.col("_fix.known")
    needed = F.greatest(F.lit(K.STARTUP_MIN_GAIN_M), old * K.STARTUP_MIN_GAIN_SHARE)
    better = F.when(old.isNull(), new <= K.STARTUP_LOCK_ACCURACY_M).otherwise(old - new >= needed)
    follows = (F.col(f"_fix.{order}") > F.col(f"_first.{order}")) & (F.col("_fix.ts") >= F.col("_first.ts"))
    upgrade = F.when(~F.col("_first.reliable") & F.col("_fix.reliable") & follows & better, F.col("_fix"))
    chosen = candidates.join(first, keys).groupBy(*keys).agg(
        F.first("_first").alias("_first"), F.min_by(upgrade, upgrade[order]).alias("_better"))
    centre = F.coalesce("_better", "_first")
    return chosen.select(*keys, F.col(f"_first.{order}").alias(f"first_{order}"), F.col("_better").isNotNull().alias("upgraded"),
                         *[centre[c].alias(c) for c in (order, "ts", "lat", "lon", "accuracy", "reliable")])
