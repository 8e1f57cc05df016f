"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

Documents are posted under each (coordinate, value) of a prefix of their signature. Two
documents that agree in at least ``matches`` of ``coordinates`` coordinates share a posting
list of any prefix of ``coordinates - matches + 1``, so no such pair is lost. Within a list,
collisions are counted over the whole signature; documents that are already connected are
skipped. Lists thus yield groups of candidates, and within a group links are confirmed on
full shingle sets. ``matches`` is set so low that a true pair falls below it with a
probability of at most ``miss``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmesh.llm.arrow import map_batches, slices
from trailmesh.llm.shingles import shingle_sets
from trailmesh.operators.graph import component_roots
from trailmesh.session import checkpointed

COORDINATES = 64


def least_matches(coordinates: int, similarity: float, miss: float) -> int:
    """The largest count that a pair of this similarity reaches but for a chance of ``miss``."""
    below = 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if below > miss:
            return max(k, 1)
    return coordinates


def signature(shingles: np.ndarray, multipliers: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The least value of every permutation, over all shingles."""
    low = np.full(len(masks), 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        part = short[at:at + 2048]
        np.minimum(low, ((part[:, None] ^ masks) * multipliers).min(axis=0), out=low)
    return low


def permutations(coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 31, coordinates, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, rng.integers(0, 1 << 32, coordinates, dtype=np.uint32)


def connected(marks: np.ndarray, sizes: np.ndarray, matches: int, percent: int,
              confirm: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """Links (x, y) that connect rows like all pairs with enough equal marks would.

    Breadth first: a row is compared only with rows no link has reached yet, so a group of
    alike rows costs little more than its size. ``confirm`` says which candidates of a row
    are truly linked to it.
    """
    left = np.arange(len(sizes))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            fits = (sizes[left] * 100 >= sizes[x] * percent) & (sizes[x] * 100 >= sizes[left] * percent)
            near = left[fits]
            near = near[(marks[near] == marks[x]).sum(axis=1) >= matches]
            if len(near) and confirm is not None:
                near = near[confirm(x, near)]
            if len(near):
                for y in near.tolist():
                    yield x, y
                queue += near.tolist()
                left = left[~np.isin(left, near, assume_unique=True)]


def _signed(docs: DataFrame, shingle: int, coordinates: int, seed: int) -> DataFrame:
    """(doc, n, print, sig): size, fingerprint and signature of every document's shingle set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        odd, masks = permutations(coordinates, seed)
        for part in slices(batches, "text"):
            sizes, prints, signatures = [], [], []
            for found in shingle_sets(part.column("text"), shingle):
                sizes.append(len(found))
                prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                signatures.append(signature(found, odd, masks).tobytes() if len(found) else None)
            yield {"doc": part.column("doc"), "n": sizes, "print": prints, "sig": signatures}

    return map_batches(docs, work, "doc long, n long, print binary, sig binary")


def _posted(reps: DataFrame, prefix: int) -> DataFrame:
    """(c, v, rep, n, marks): a posting per coordinate of the prefix; marks are the signature's low bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                if not batch.num_rows:
                    continue
                rows = batch.num_rows
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(rows, -1)
                marks = np.repeat(pa.array([r.tobytes() for r in (sig & 0xFF).astype(np.uint8)], pa.binary())
                                  .to_numpy(zero_copy_only=False), prefix)
                yield {
                    "c": np.tile(np.arange(prefix, dtype=np.int32), rows), "v": sig[:, :prefix].reshape(-1).astype(np.int64),
                    "rep": np.repeat(batch.column("rep").to_numpy(), prefix),
                    "n": np.repeat(batch.column("n").to_numpy(), prefix), "marks": pa.array(marks, pa.binary()),
                }

    return map_batches(reps, work, "c int, v long, rep long, n long, marks binary")


def _cells(rows: DataFrame, blocks: str, key: str) -> DataFrame:
    """Rows of a group of ``blocks`` blocks, once for every pair of blocks that theirs is part of."""
    placed = rows.withColumn("_at", F.pmod(F.xxhash64(key), F.col(blocks)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    return placed.withColumn("_other", other).withColumns({
        "_lo": F.least("_at", "_other"), "_hi": F.greatest("_at", "_other")}).drop("_at", "_other")


def _candidates(reps: DataFrame, coordinates: int, matches: int, percent: int, block: int) -> DataFrame:
    """(a, b): links that join all representatives with enough collisions into groups."""
    postings = _posted(reps, coordinates - matches + 1)
    # Written, so that the planner knows how few these are and leaves the postings where they are.
    crowded = checkpointed(postings.groupBy("c", "v").count().filter(F.col("count") > block).select(
        "c", "v", F.ceil(F.col("count") / block).alias("_blocks")))
    rows = postings.join(crowded, ["c", "v"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    rows = _cells(rows, "_blocks", "rep")
    partitions = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["c", "v", "_lo", "_hi"]
    ordered = rows.repartition(partitions, *keys).sortWithinPartitions(*keys)

    def settled(reps_: np.ndarray, sizes: np.ndarray, marks: np.ndarray, edges: list) -> Iterator[dict]:
        lengths = np.diff(edges)
        starts = np.array(edges[:-1])
        pairs = starts[lengths == 2]  # most lists: compare them all at once
        hit = (marks[pairs] == marks[pairs + 1]).sum(axis=1) >= matches
        small, large = np.minimum(sizes[pairs], sizes[pairs + 1]), np.maximum(sizes[pairs], sizes[pairs + 1])
        pairs = pairs[hit & (small * 100 >= large * percent)]
        a, b = [reps_[pairs]], [reps_[pairs + 1]]
        for s, n in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
            links = np.array(list(connected(marks[s:s + n], sizes[s:s + n], matches, percent)), np.int64).reshape(-1, 2)
            a.append(reps_[s + links[:, 0]])
            b.append(reps_[s + links[:, 1]])
        return {"a": np.concatenate(a), "b": np.concatenate(b)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []  # the last list may go on in the next batch
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 8192:
                continue
            out, held = _split(held, keys, last=False)
            if out is not None:
                yield settled(*out)
        out, _ = _split(held, keys, last=True)
        if out is not None:
            yield settled(*out)

    return map_batches(ordered.select(*keys, "rep", "n", "marks"), work, "a long, b long").distinct()


def _split(held: list[pa.RecordBatch], keys: list[str], last: bool):
    """The complete lists of ``held`` as arrays, and what is left of the last one."""
    rows = [b for b in held if b.num_rows]
    if not rows:
        return None, []
    table = pa.Table.from_batches(rows).combine_chunks()
    columns = [table.column(k).to_numpy() for k in keys]
    change = np.zeros(table.num_rows - 1, bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
    rest = []
    if not last:
        rest = table.slice(edges[-2]).to_batches()
        table, edges = table.slice(0, edges[-2]), edges[:-1]
        if len(edges) < 2:
            return None, rest
    n = table.num_rows
    marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(n, -1)
    return (table.column("rep").to_numpy(), table.column("n").to_numpy(), marks, edges), rest


def _confirmed(docs: DataFrame, members: DataFrame, shingle: int, coordinates: int, matches: int, percent: int,
               seed: int, block: int, block_shingles: int) -> DataFrame:
    """(a, b): links between representatives, confirmed on the full sets made anew from their texts."""
    sizes = members.groupBy("root").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_shingles)).alias("_blocks"))
    placed = members.join(sizes, "root")
    # Members grow with the corpus: the join is planned as a shuffle whatever their number.
    texts = docs.join(placed.hint("merge"), F.col("doc") == F.col("rep")).select("root", "rep", "_blocks", "text", "print")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in slices(batches, "text"):
            sets = list(shingle_sets(part.column("text"), shingle))
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            same = [p == q for p, q in zip(prints, part.column("print").to_pylist(), strict=True)]
            keep = pa.array(same)
            yield {"root": part.column("root").filter(keep), "rep": part.column("rep").filter(keep),
                   "_blocks": part.column("_blocks").filter(keep),
                   "shingles": [s.tobytes() for s, good in zip(sets, same, strict=True) if good]}

    shaped = map_batches(texts, work, "root long, rep long, _blocks long, shingles binary")

    def link(table: pa.Table) -> pa.Table:
        order = np.argsort(reps := table.column("rep").to_numpy(), kind="stable")
        reps = reps[order]
        blobs = table.column("shingles").to_pylist()
        sets = [np.frombuffer(blobs[i], np.uint64) for i in order]
        odd, masks = permutations(coordinates, seed)
        marks = np.array([signature(s, odd, masks) for s in sets])
        lengths = np.array([len(s) for s in sets])

        def confirm(x: int, near: np.ndarray) -> np.ndarray:
            mine = sets[x]
            others = np.concatenate([sets[y] for y in near])
            place = np.minimum(np.searchsorted(mine, others), len(mine) - 1)
            starts = np.cumsum(lengths[near]) - lengths[near]
            shared = np.add.reduceat((mine[place] == others).astype(np.int64), starts)
            return shared * 100 >= percent * (lengths[near] + len(mine) - shared)

        links = np.array(list(connected(marks, lengths, matches, percent, confirm)), np.int64).reshape(-1, 2)
        return pa.table({"a": reps[links[:, 0]], "b": reps[links[:, 1]]})

    return _cells(shaped, "_blocks", "rep").groupBy("root", "_lo", "_hi").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    percent: int = 85, coordinates: int = COORDINATES, miss: float = 1e-5, seed: int = 11,
                    list_block: int = 20_000, block: int = 2048, block_shingles: int = 2_000_000) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per input row.

    Two documents are linked if ``100 * shared >= percent * union`` on their whole sets of
    distinct word shingles. Null texts and texts without words have an empty set and link
    with nothing. Documents with equal sets are compared once, as their smallest id; rows
    that repeat an id and a text share one result. A null id links with nothing and is kept.
    Crowded posting lists and large groups are cut into blocks, each pair of blocks a task
    of its own, so memory is bounded and no pair is left out. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    matches = least_matches(coordinates, percent / 100, miss)
    signed = checkpointed(_signed(rows, shingle, coordinates, seed))
    reps = checkpointed(signed.filter("n > 0 and doc is not null").groupBy("print").agg(
        F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    found = _candidates(reps.select("rep", "n", "sig"), coordinates, matches, percent, list_block)
    groups = component_roots(found, []).select(F.col("node").alias("rep"), "root")
    groups = groups.unionByName(groups.select(F.col("root").alias("rep"), "root")).distinct()
    members = checkpointed(reps.select("rep", "n", "print").join(groups, "rep"))
    links = _confirmed(rows, members, shingle, coordinates, matches, percent, seed, block, block_shingles)
    roots = component_roots(links, []).select(F.col("node").alias("rep"), "root")
    settled = reps.select("print", "rep").join(roots, "rep", "left").select(
        "print", F.coalesce("root", "rep").alias("_root"))
    joined = signed.join(settled, "print", "left").withColumn(
        "component_id", F.when(F.col("doc").isNull() | (F.col("n") == 0), F.col("doc")).otherwise(F.col("_root")))
    return joined.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                         F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))
