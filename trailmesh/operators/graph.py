"""Connected components by alternating star contraction, order on cycles by pointer doubling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmesh.operators.grouped import whole_groups
from trailmesh.session import checkpointed, dealt


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64(*edges.columns).cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def component_roots(edges: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """(keys, node, root) for every node on an edge; the root is the smallest node reached.

    Each round hangs neighbours under the smallest node they see (large stars, then small
    stars), which settles in a number of rounds logarithmic in the longest path. Only a
    count and a checksum come to the driver.
    """
    keys = list(keys)
    current = checkpointed(
        edges.select(*keys, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    )
    seen = _fingerprint(current)
    if seen[0] == 0:
        return current.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = current.unionByName(current.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(*keys, "u").agg(F.min("v").alias("_m"))
        large = (
            both.filter("v > u").join(lowest, [*keys, "u"])
            .select(*keys, F.col("v").alias("u"), F.least("u", "_m").alias("v"))
        )
        large = large.unionByName(current.join(lowest, [*keys, "u"]).select(*keys, "u", F.col("_m").alias("v"))).distinct()
        small_min = large.groupBy(*keys, "u").agg(F.min("v").alias("_m"))
        hung = large.join(small_min, [*keys, "u"])
        small = hung.select(*keys, F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("_m").alias("v")),
            F.struct(F.greatest("v", "_m").alias("u"), F.least("v", "_m").alias("v")),
        )).alias("e")).select(*keys, "e.u", "e.v").filter("u <> v").distinct()
        current = checkpointed(small)
        now = _fingerprint(current)
        if now == seen:
            return current.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def _pieces(groups: Sequence[str]):
    """Join up the links of each group: every id with the first one of its piece, the steps from there and the piece's end."""

    def join(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        ids, after, group = rows["id"].tolist(), rows["next"].tolist(), first.tolist()
        at = {key: i for i, key in enumerate(zip(group, ids))}
        to = [at.get(key, -1) for key in zip(group, after)]
        n = len(ids)
        led = [False] * n
        for j in to:
            if j >= 0:
                led[j] = True
        head, away, end, low, low_away = [-1] * n, [0] * n, [None] * n, [0] * n, [0] * n
        # Pieces that come from other groups first, then whole cycles from their smallest id.
        order = [i for i in range(n) if not led[i]] + sorted((i for i in range(n) if led[i]), key=ids.__getitem__)
        for start in order:
            if head[start] >= 0:
                continue
            i, steps, least, least_away = start, 0, ids[start], 0
            while i >= 0 and head[i] < 0:
                head[i], away[i] = start, steps
                if ids[i] < least:
                    least, least_away = ids[i], steps
                last, steps, i = i, steps + 1, to[i]
            if i < 0:
                end[start], low[start], low_away[start] = after[last], least, least_away
        return rows.drop(columns=["next"]).assign(
            _head=[ids[h] for h in head], _off=away, _end=pd.array([end[h] for h in head], dtype="Int64"),
            _low=[low[h] for h in head], _low_away=[low_away[h] for h in head])

    return whole_groups(groups, join)


def cycle_positions(links: DataFrame, keys: Sequence[str], tiles: Sequence[str]) -> DataFrame:
    """(keys, id, ring, position) for a relation (keys, id, next, tiles) in which every id is the next of one other.

    The ring is the smallest id of a cycle, at position 0. ``tiles`` are columns that cut the ids of a
    key into groups of bounded size, within which most follow each other: there pieces of cycles are
    joined up by themselves, and many are whole. Pointer doubling over the other pieces: in each
    round every piece learns the smallest id of twice as many that follow it, and how far away
    that is; when nothing changes any more, all have seen their whole cycle.
    """
    keys, groups = list(keys), [*keys, *tiles]
    rows = links.select(*groups, "id", "next")
    long = [T.StructField(c, T.LongType()) for c in ("_head", "_off", "_end", "_low", "_low_away")]
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "next"], *long])
    placed = checkpointed(dealt(rows, *groups).sortWithinPartitions(*groups).mapInPandas(_pieces(groups), schema).drop(*tiles))
    whole = placed.filter("_end IS NULL").select(*keys, "id", F.col("_head").alias("ring"), F.col("_off").alias("position"))
    # A piece from outside a group ends at the first id of another one.
    state = checkpointed(placed.filter("_end IS NOT NULL").groupBy(*keys, F.col("_head").alias("id")).agg(
        F.min("_end").alias("_to"), F.min("_low").alias("ring"), F.min("_low_away").alias("_away"),
        F.count(F.lit(1)).alias("_size")).withColumn("_gone", F.col("_size")))
    moved = not state.isEmpty()
    while moved:
        ahead = state.select(*keys, F.col("id").alias("_to"), F.col("_to").alias("_next"), F.col("ring").alias("_ring"),
                             F.col("_away").alias("_more"), F.col("_gone").alias("_further"))
        nearer = F.col("ring") <= F.col("_ring")
        both = checkpointed(state.join(ahead, [*keys, "_to"]).select(
            *keys, "id", "_size", F.col("_next").alias("_to"), F.least("ring", "_ring").alias("ring"),
            F.when(nearer, F.col("_away")).otherwise(F.col("_gone") + F.col("_more")).alias("_away"),
            (F.col("_gone") + F.col("_further")).alias("_gone"), (~nearer).alias("_moved")))
        moved = not both.filter("_moved").isEmpty()
        state = both.drop("_moved")
    sizes = state.groupBy(*keys, "ring").agg(F.sum("_size").alias("_steps"))
    heads = state.join(sizes, [*keys, "ring"]).select(*keys, F.col("id").alias("_head"), "ring", "_away", "_steps")
    cut = placed.filter("_end IS NOT NULL").select(*keys, "id", "_head", "_off").join(heads, [*keys, "_head"]).select(
        *keys, "id", "ring", F.pmod(F.col("_off") - F.col("_away"), F.col("_steps")).alias("position"))
    return whole.unionByName(cut)
