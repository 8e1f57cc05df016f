"""The prefix trie of conversations, by burst containers.

Every turn becomes a 16-byte id (a digest of role and text), a conversation the sequence of
its ids. Conversations with equal sequences are one entry with a count. All entries begin in
one container under the root. A container with more than ``capacity`` entries bursts: what
its entries share becomes a head (a chain of nodes without branches), and the entries are
dealt out by their next turn id to containers under that head. So no container is larger
than a task can hold, however many conversations begin alike. What is left in a container is
sorted by its ids and swept once: neighbours share the nodes of their common prefix.

Containers and heads hold whole subtrees, so sums over subtrees are those inside a container,
and for heads the sums over all containers and heads below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmesh.llm.arrow import map_batches
from trailmesh.session import checkpointed

WIDTH = 16
CAPACITY = 4096
CAPACITY_BYTES = 8 << 20
ROOT = b""
SLICE = 8192
NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends string")


def digest(column: Column) -> Column:
    return F.unhex(F.md5(column))


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """(conv_id, ids, sizes): the turns of each conversation in order, 16 bytes of id a turn, and the texts' bytes.

    Null turns come first; rows with the same turn come in the order of their ids. A null role
    or text is an empty one, rows without a conversation are left out. Texts are not shuffled;
    the ids of one conversation (some 40 bytes a turn) come together in one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(F.col(turn_col).alias("turn"),
                    F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
                    F.octet_length(text).alias("size"))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("turn")).filter("conv_id is not null")
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return gathered.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("ids"), F.col("turns.size").alias("sizes"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Ids that two sequences have in common at their beginning."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH:mid * WIDTH] == b[low * WIDTH:mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def _classes(rows: DataFrame) -> DataFrame:
    """(key, conv, n, ends): of the conversations with one key, the smallest, their number, and a digest of all.

    The digest covers the ids in ascending order, joined by commas. Ids are ordered and written
    out in slices of even size, so that a large class is split; one task then reads the
    slices of a class one after the other, without holding them.
    """
    ordered = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            starts = sorted({p for a, b in zip(starts, [*starts[1:], len(keys)], strict=True) for p in range(a, b, SLICE)})
            ends = [*starts[1:], len(keys)]
            yield {"key": [keys[a] for a in starts], "first": [ids[a] for a in starts],
                   "n": [b - a for a, b in zip(starts, ends, strict=True)],
                   "text": [",".join(map(str, ids[a:b])) for a, b in zip(starts, ends, strict=True)]}

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, first, n, sha = None, None, 0, None
        for batch in batches:
            done = []
            for k, f, m, text in zip(*(batch.column(c).to_pylist() for c in ("key", "first", "n", "text")), strict=True):
                if k == key:
                    sha.update(b"," + text.encode())
                    n += m
                    continue
                if key is not None:
                    done.append((key, first, n, sha.hexdigest()))
                key, first, n, sha = k, f, m, hashlib.sha256(text.encode())
            yield {c: [d[i] for d in done] for i, c in enumerate(("key", "conv", "n", "ends"))}
        if key is not None:
            yield {"key": [key], "conv": [first], "n": [n], "ends": [sha.hexdigest()]}

    sliced = map_batches(ordered, cut, "key binary, first long, n long, text string")
    return map_batches(sliced.repartition("key").sortWithinPartitions("key", "first"), digested,
                       "key binary, conv long, n long, ends string")


def _shared(heads: DataFrame) -> DataFrame:
    """Adds ``until``, the depth down to which the least and the greatest sequence of a container agree."""
    columns = "box binary, path array<binary>, top int, above long, n long, conv long, sizes array<int>, until int"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            low, high = batch.column("low").to_pylist(), batch.column("high").to_pylist()
            yield {**{c: batch.column(c) for c in ("box", "path", "top", "above", "n", "conv", "sizes")},
                   "until": [shared_turns(a, b) for a, b in zip(low, high, strict=True)]}

    return map_batches(heads, measure, columns)


def _burst(entries: DataFrame, root: int, capacity: int, capacity_bytes: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Entries in containers of bounded size, the heads above them, and what ends at a head.

    A container is named by a digest of the ids down to its topmost node, at depth ``top``;
    ``path`` names the heads above it, ``above`` is the smallest conversation of the nearest.
    """
    active = entries.filter(F.length("ids") > 0).select(
        "ids", "sizes", "n", "conv", "ends", digest(F.substring("ids", 1, WIDTH)).alias("box"), F.lit(1).alias("top"),
        F.lit(root).cast("long").alias("above"), F.array(F.lit(ROOT)).alias("path"))
    settled: DataFrame | None = None
    heads: DataFrame | None = None
    ended = entries.filter(F.length("ids") == 0).select(F.lit(ROOT).alias("box"), F.col("ends").alias("_ends"))
    while True:
        large = checkpointed(active.groupBy("box").agg(F.count(F.lit(1)).alias("c"), F.sum(F.length("ids")).alias("b")).filter(
            (F.col("c") > capacity) | (F.col("b") > capacity_bytes) & (F.col("c") > 1)).select("box", F.lit(True).alias("large")))
        if large.isEmpty():
            return (active if settled is None else settled.unionByName(active)), heads, ended
        marked = checkpointed(active.join(large, "box", "left"))
        small = marked.filter("large is null").drop("large")
        settled = small if settled is None else settled.unionByName(small)
        inside = marked.filter("large").drop("large")
        found = inside.groupBy("box").agg(
            F.first("path").alias("path"), F.first("top").alias("top"), F.first("above").alias("above"),
            F.sum("n").alias("n"), F.min("conv").alias("conv"), F.min(F.struct("ids", "sizes")).alias("least"),
            F.max("ids").alias("high"))
        fresh = checkpointed(_shared(found.select("box", "path", "top", "above", "n", "conv", F.col("least.sizes").alias("sizes"),
                                                  F.col("least.ids").alias("low"), "high")))
        heads = fresh if heads is None else heads.unionByName(fresh)
        dealt = checkpointed(inside.join(fresh.select("box", "until", F.col("conv").alias("_conv")), "box"))
        ended = ended.unionByName(dealt.filter(F.length("ids") == F.col("until") * WIDTH).select("box", F.col("ends").alias("_ends")))
        active = dealt.filter(F.length("ids") > F.col("until") * WIDTH).select(
            "ids", "sizes", "n", "conv", "ends", digest(F.expr(f"substring(ids, 1, (until + 1) * {WIDTH})")).alias("box"),
            (F.col("until") + 1).alias("top"), F.col("_conv").alias("above"),
            F.concat("path", F.array("box")).alias("path"))


def swept(rows: list[tuple[bytes, list[int], int, int, str]], top: int, above: int) -> list[list]:
    """Nodes from depth ``top`` down, for entries (ids, sizes, n, conv, ends) in the order of their ids.

    A node is [conv, depth, parent's conv, n, children, leaves, saved, ends].
    """
    nodes: list[list] = []  # parents come before their children
    sizes_of: list[int] = []
    parents: list[int] = []
    way: list[int] = []  # the nodes on the way to the entry before
    before = b""
    for ids, sizes, n, conv, ends in rows:
        del way[max(0, shared_turns(before, ids) - top + 1):]
        for depth in range(top + len(way), len(ids) // WIDTH + 1):
            parents.append(way[-1] if way else -1)
            way.append(len(nodes))
            nodes.append([conv, depth, above, 0, 0, 0, 0, None])
            sizes_of.append(sizes[depth - 1])
        last = nodes[way[-1]]
        last[3] += n
        last[0], last[7] = min(last[0], conv), ends
        before = ids
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if not node[4]:
            node[5] = 1
        node[6] += (node[3] - 1) * sizes_of[i]
        if parents[i] >= 0:
            parent = nodes[parents[i]]
            parent[0] = min(parent[0], node[0])
            parent[3] += node[3]
            parent[4] += 1
            parent[5] += node[5]
            parent[6] += node[6]
    for i, parent in enumerate(parents):
        if parent >= 0:
            nodes[i][2] = nodes[parent][0]
    return nodes


def _sweep(settled: DataFrame) -> DataFrame:
    """All nodes inside the containers; the topmost one of a container carries its ``path``."""
    ordered = settled.repartition("box").sortWithinPartitions("box", "ids")
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "path")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        box, place, rows, out = None, None, [], []

        def close() -> None:
            nodes = swept(rows, place[0], place[1])
            out.extend((*node, None if i else place[2]) for i, node in enumerate(nodes))

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("ids", "sizes", "n", "conv", "ends", "box", "top", "above")}
            paths = batch.column("path")
            for i, key in enumerate(columns["box"]):
                if key != box:
                    if rows:
                        close()
                    box, rows = key, []
                    place = columns["top"][i], columns["above"][i], paths[i].as_py()
                rows.append(tuple(columns[c][i] for c in ("ids", "sizes", "n", "conv", "ends")))
            if out:
                yield {c: [row[i] for row in out] for i, c in enumerate(names)}
                out.clear()
        if rows:
            close()
            yield {c: [row[i] for row in out] for i, c in enumerate(names)}

    return map_batches(ordered, work, f"{NODES}, path array<binary>")


def _head_nodes(heads: DataFrame) -> DataFrame:
    """The chain of nodes of every head."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for head in batch.to_pylist():
                depth = np.arange(head["top"], head["until"] + 1)
                size = np.array([0, *head["sizes"]], np.int64)[depth]
                saved = head["below"] + (head["n"] - 1) * np.cumsum(size[::-1])[::-1]
                steps = len(depth)
                yield {"conv_id": [head["conv"]] * steps, "depth": depth, "saved_tokens": saved,
                       "parent_conv_id": [head["above"], *[head["conv"]] * (steps - 1)], "n_convs": [head["n"]] * steps,
                       "n_children": [*[1] * (steps - 1), head["children"]], "n_leaves": [head["leaves"]] * steps,
                       "ends": [*[None] * (steps - 1), head["_ends"]]}

    return map_batches(heads, work, NODES)


def prefix_trie(rows: DataFrame, capacity: int = CAPACITY, capacity_bytes: int = CAPACITY_BYTES) -> DataFrame:
    """One row per node of the trie over (conv_id, ids, sizes), as ``sequences`` gives them.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends):
    ``conv_id`` is the smallest conversation that begins with the node's turns, ``n_convs``
    their number, ``n_leaves`` counts the childless nodes of the subtree, ``saved_tokens`` sums
    (n_convs - 1) times the bytes of the last text over it, both with the node itself. ``ends``
    is the SHA-256, in lower-case hex, of the conversations that end at the node, ascending and
    joined by commas; of the empty text if there are none. The root has depth 0 and no parent.

    ``conv_id`` is unique and not null; a conversation without turns ends at the root; no
    rows give no nodes. Containers burst above ``capacity`` different sequences or
    ``capacity_bytes`` of their ids, so rounds are as many as branching turns at which
    so many sequences still agree.
    """
    rows = checkpointed(rows.select("conv_id", "ids", "sizes"))
    keyed = rows.select(digest(F.col("ids")).alias("key"), "conv_id")
    found = _classes(keyed).select("conv", "n", "ends")
    entries = checkpointed(found.join(rows, F.col("conv") == F.col("conv_id")).select("ids", "sizes", "n", "conv", "ends"))
    total = entries.agg(F.min("conv").alias("conv"), F.sum("n").alias("n"))
    first = total.first()  # one row
    settled, heads, ended = _burst(entries, first.conv, capacity, capacity_bytes)
    inside = checkpointed(_sweep(settled))
    root = total.filter("n is not null").select(
        F.lit(ROOT).alias("box"), F.array().cast("array<binary>").alias("path"), F.lit(0).alias("top"),
        F.lit(None).cast("long").alias("above"), "n", "conv", F.array().cast("array<int>").alias("sizes"), F.lit(0).alias("until"))
    heads = root if heads is None else root.unionByName(heads)
    own = (F.col("n") - 1) * F.aggregate(F.expr("slice(sizes, greatest(top, 1), until - top + 1)"), F.lit(0).cast("long"),
                                         lambda a, x: a + x)
    zero = F.lit(0).cast("long")
    tops = inside.filter("path is not null").select("path", "n_leaves", "saved_tokens")
    parts = tops.unionByName(heads.select("path", zero.alias("n_leaves"), own.alias("saved_tokens")))
    below = parts.select(F.explode("path").alias("box"), "n_leaves", "saved_tokens",
                         (F.element_at("path", -1)).alias("_near")).groupBy("box").agg(
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"),
        F.sum(F.when(F.col("_near") == F.col("box"), 1).otherwise(0)).alias("children"))
    told = heads.join(below, "box", "left").join(ended, "box", "left").select(
        "top", "until", "conv", "above", "n", "sizes", F.coalesce("children", zero).alias("children"),
        F.coalesce("leaves", F.lit(1).cast("long")).alias("leaves"), F.coalesce("below", zero).alias("below"), "_ends")
    nodes = inside.drop("path").unionByName(_head_nodes(told))
    return nodes.withColumn("ends", F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())))
