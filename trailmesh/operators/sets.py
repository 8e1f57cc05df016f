"""Set-wise writes: append only what is new, upsert by key, freeze and reuse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_distinct(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.distinct()


def only_new(candidates: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: candidates whose key is not stored yet, one row per key."""
    fresh = candidates.join(stored.select(*keys), list(keys), "left_anti")
    payload = [c for c in candidates.columns if c not in keys]
    if not payload:
        return fresh.select(*keys).distinct()
    best = fresh.groupBy(*keys).agg(F.min(F.struct(*payload)).alias("_p"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_p.{c}").alias(c) for c in candidates.columns])


def upsert(stored: DataFrame, arrived: DataFrame, keys: Sequence[str], rank: Sequence[Column]) -> DataFrame:
    """One row per key: highest ``rank`` wins, then the arrived row.

    ``rank`` columns are comparable (booleans, numbers, times); the max over a struct
    combines map-side.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(arrived.withColumn("_new", F.lit(1)))
    payload = [c for c in stored.columns if c not in keys]
    ranked = F.struct(*[r.alias(f"_r{i}") for i, r in enumerate(rank)], F.col("_new"))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*payload), ranked).alias("_p"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_p.{c}").alias(c) for c in stored.columns])


def changed_keys(before: DataFrame, after: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Keys whose fingerprint is no longer the stored one."""
    old = before.select(key, F.col(fingerprint).alias("_old"))
    return after.join(old, key).filter(~F.col(fingerprint).eqNullSafe(F.col("_old"))).select(key)


def still_valid(results: DataFrame, current: DataFrame, keys: Sequence[str], stamps: Sequence[str]) -> DataFrame:
    """Cached results whose stamps (fingerprint, revision, count, highest id) all match the current ones."""
    return results.join(current.select(*keys, *stamps), [*keys, *stamps], "left_semi")


def to_recompute(current: DataFrame, results: DataFrame, keys: Sequence[str], stamps: Sequence[str]) -> DataFrame:
    return current.join(results.select(*keys, *stamps), [*keys, *stamps], "left_anti")


def freeze(frozen: DataFrame, derived: DataFrame, current: DataFrame, keys: Sequence[str],
           stamps: Sequence[str]) -> DataFrame:
    """Frozen rows that still match the point generation, and derived ones for the others."""
    keep = still_valid(frozen, current, keys, stamps)
    return keep.unionByName(derived.join(keep.select(*keys), list(keys), "left_anti"))
