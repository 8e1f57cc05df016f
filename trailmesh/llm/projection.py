"""Near-duplicate vectors by pairs of blocks, or by sorted projection passes.

The vectors of a label are dealt to blocks by their signs under random directions through the
label's mean. Every pair of blocks is compared in full, unless the balls around the two blocks
are further apart than two linked vectors can be. So every link is found; a group holds two
blocks, and leaves counts and one edge per connected vector.

A caller that names a number of passes gets a search that can miss links instead.
Each pass writes a vector's signs under its own random directions one after the other, sorts
all vectors by these bits, and compares every vector with the ``window`` before it. Vectors
at a small angle share long prefixes of their bits in most passes, so they stand close in
some pass. The directions go through the mean of each label, and a label gets as many passes
as its size and its density ask for. Pairs that are verified are joined across passes; then
every component is compared once more in full, block by block, so that the links inside it
are counted exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmesh.llm.arrow import map_batches
from trailmesh.operators.graph import component_roots
from trailmesh.session import checkpointed

BITS = 62
FOUND = "kind int, a long, b long, part int, side int, place long, pass int, label string, vec binary"
MOST_NUMBERS = 1 << 22  # in the vectors of one block


def usable(vector: Column) -> Column:
    """Not null, at least one component, all of them finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; they are scaled by their largest component first, so that nothing overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def linked(rows: np.ndarray, columns: np.ndarray, threshold: float) -> np.ndarray:
    return rows @ columns.T >= threshold


def needed(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links of a lower triangle, those that connect the same rows.

    A row keeps the link to its nearest linked predecessor, and those further links that
    this predecessor does not have itself.
    """
    any_link = links.any(axis=1)
    nearest = links.shape[1] - 1 - np.argmax(links[:, ::-1], axis=1)
    implied = links[nearest] & any_link[:, None]
    keep = links & ~implied
    rows = np.flatnonzero(any_link)
    keep[rows, nearest[rows]] = True
    return np.nonzero(keep)


class Band:
    """Rows of one sorted stream; compares each with the ``window`` rows before it."""

    def __init__(self, window: int, threshold: float):
        self.window, self.threshold = window, threshold
        self.keys = np.zeros((0, 3), np.int64)  # pass, label's run, representative
        self.vectors: list[bytes] = []

    def links(self, keys: np.ndarray, vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Links between the new rows, and between them and the rows kept from before."""
        old = len(self.keys)
        keys, vectors = np.concatenate([self.keys, keys]), self.vectors + vectors
        found_a, found_b = [], []
        for at in range(old, len(keys), 512):
            lo, hi = max(0, at - self.window), min(len(keys), at + 512)
            here = keys[lo:hi]
            for a, b in _runs(here):
                if b - a < 2 or lo + b <= at:
                    continue
                x = unit_rows(np.array([np.frombuffer(v) for v in vectors[lo + a:lo + b]]))
                hit = linked(x, x, self.threshold)
                place = np.arange(len(x))
                gap = place[:, None] - place[None, :]
                hit &= (gap > 0) & (gap <= self.window)
                hit[: max(0, at - lo - a)] = False  # both rows were here before
                r, c = needed(hit)
                found_a.append(here[a + r, 2])
                found_b.append(here[a + c, 2])
        self.keys, self.vectors = keys[-self.window:], vectors[-self.window:]
        empty = np.zeros(0, np.int64)
        return np.concatenate(found_a or [empty]), np.concatenate(found_b or [empty])


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with the same pass and label."""
    change = np.flatnonzero((keys[1:, :2] != keys[:-1, :2]).any(axis=1)) + 1
    edges = [0, *change.tolist(), len(keys)]
    yield from zip(edges, edges[1:], strict=False)


def label_numbers(labels: list[str]) -> np.ndarray:
    """A number per label that is the same for equal labels of any batch."""
    known = {label: int.from_bytes(hashlib.blake2b(label.encode(), digest_size=7).digest())
             for label in set(labels)}
    return np.array([known[label] for label in labels], np.int64)


def by_size(batches: Iterator[pa.RecordBatch], step: int = 2048) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches, and their vectors as unit rows; a label holds vectors of one size, a slice one label."""
    for whole in batches:
        if not whole.num_rows:
            continue
        numbers = whole.column("label").dictionary_encode().indices.to_numpy()
        order = np.argsort(numbers, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1):
            for at in range(0, len(rows), step):
                batch = whole.take(pa.array(rows[at:at + step]))
                flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
                yield batch, unit_rows(flat.reshape(batch.num_rows, -1))


def _means(vectors: DataFrame) -> DataFrame:
    """(label, n, mean): rows of a label and their mean direction.

    Tasks send one partial sum per slice of a label. The mean is rounded, so that the order of
    summation does not show in it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, x in by_size(batches):
            yield {"label": batch.column("label").slice(0, 1), "n": [len(x)], "part": [x.sum(axis=0).tolist()]}

    partial = map_batches(vectors, work, "label string, n long, part array<double>")
    sums = partial.select("label", "n", F.posexplode("part").alias("at", "x")).groupBy("label", "at").agg(
        F.sum("n").alias("n"), F.sum("x").alias("x"))
    axes = F.array_sort(F.collect_list(F.struct("at", F.round(F.col("x") / F.col("n"), 6).alias("x"))))
    return sums.groupBy("label").agg(F.max("n").alias("n"), axes["x"].alias("mean"))


def passes_for(sample: np.ndarray, mean: np.ndarray, n: int, window: int, threshold: float, miss: float,
               most: int) -> int:
    """Passes after which a pair at the threshold was within ``window`` but for a share ``miss`` of pairs.

    One bit is the same for two vectors whose residuals stand at the angle t with probability
    1 - t / pi. So a partner at the threshold shares the first k bits of a vector with probability
    q ** k, and of the n rows those of the sample tell how many are expected to share them too. With
    the best k the pair is met when all that share the bits fit into the window. Sampled rows that
    are themselves linked to the vector are left out: they are no strangers that drive a pair apart.
    """
    if n <= window or len(sample) < 2:
        return 1  # the window holds the whole label
    residual = sample - mean
    square = np.maximum((residual * residual).sum(axis=1), 1e-12)
    own = 1 - np.arccos(np.clip(1 - (1 - threshold) / square, -1, 1)) / np.pi
    cosine = np.clip(residual @ residual.T / np.sqrt(square[:, None] * square[None, :]), -1, 1)
    same = 1 - np.arccos(cosine) / np.pi
    same[sample @ sample.T >= threshold] = 0
    met, shared = np.full(len(sample), window / n), np.ones_like(same)
    for k in range(1, BITS + 1):
        shared *= same
        rows = n * shared.sum(axis=1) / (len(sample) - 1)
        met = np.maximum(met, own ** k * np.minimum(1, window / np.maximum(rows, 1)))
    missed = np.ones(len(sample))
    for passes in range(1, most + 1):
        missed *= 1 - met
        if missed.mean() <= miss:
            return passes
    return most


def _plans(vectors: DataFrame, window: int, threshold: float, miss: float, most: int, sample: int,
           seed: int) -> DataFrame:
    """(label, mean, passes) per label; the density comes from about ``sample`` rows of each label."""
    means = _means(vectors)
    chosen = F.pmod(F.xxhash64(F.col("vec"), F.lit(seed)), F.col("n")) < sample

    def plan(table: pa.Table) -> pa.Table:
        x = unit_rows(np.array(table.column("vec").to_pylist(), np.float64))
        mean = table.column("mean")[0].as_py()
        passes = passes_for(x, np.array(mean), table.column("n")[0].as_py(), window, threshold, miss, most)
        return pa.table({"label": [table.column("label")[0].as_py()], "passes": pa.array([passes], pa.int32())})

    rated = vectors.join(means, "label").filter(chosen).groupBy("label").applyInArrow(plan, "label string, passes int")
    # A label of which no row was chosen gets all passes.
    return means.join(rated, "label", "left").select("label", "mean", F.coalesce("passes", F.lit(most)).alias("passes"))


def _signed(vectors: DataFrame, seed: int) -> DataFrame:
    """(pass, label, bits, rep, vec): a row per vector and pass; ``vectors`` carry the plan of their label."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        directions: dict[tuple[int, int], np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch, x in by_size(batches):
            n, d = x.shape
            x = x - np.array(batch.column("mean")[0].as_py())
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(n, d)
            data = [row.tobytes() for row in flat]
            for p in range(batch.column("passes")[0].as_py()):
                if (p, d) not in directions:
                    directions[p, d] = np.random.default_rng([seed, p, d]).standard_normal((d, BITS))
                yield {"pass": np.full(n, p, np.int32), "label": batch.column("label"),
                       "bits": ((x @ directions[p, d]) >= 0) @ weights, "rep": batch.column("rep"), "vec": data}

    return map_batches(vectors, work, "pass int, label string, bits long, rep long, vec binary")


def _neighbours(signed: DataFrame, partitions: int, window: int, threshold: float) -> DataFrame:
    """Verified links of all passes (kind 0), and the rows at the ends of partitions (kind 1)."""
    ordered = signed.repartitionByRange(partitions, "pass", "label", "bits", "rep").sortWithinPartitions(
        "pass", "label", "bits", "rep")

    def border(rows: list[tuple], side: int, at: int) -> dict:
        n, part = len(rows), TaskContext.get().partitionId()
        nothing = [None] * n
        return {"kind": [1] * n, "a": [r[2] for r in rows], "b": nothing, "part": [part] * n, "side": [side] * n,
                "place": list(range(at, at + n)), "pass": [r[0] for r in rows], "label": [r[1] for r in rows],
                "vec": [r[3] for r in rows]}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        band, first, last, seen = Band(window, threshold), [], [], 0
        for batch in batches:
            passes, labels, reps, vectors = (batch.column(c).to_pylist() for c in ("pass", "label", "rep", "vec"))
            if not passes:
                continue
            rows = list(zip(passes, labels, reps, vectors, strict=True))
            seen += len(rows)
            first += rows[: window - len(first)]
            last = (last + rows[-window:])[-window:]
            keys = np.stack([np.array(passes, np.int64), label_numbers(labels), np.array(reps, np.int64)], axis=1)
            a, b = band.links(keys, vectors)
            if len(a):
                none = [None] * len(a)
                yield {"kind": [0] * len(a), "a": a, "b": b, "part": none, "side": none, "place": none, "pass": none,
                       "label": none, "vec": none}
        if first:
            yield border(last, 0, seen - len(last))
            yield border(first, 1, 0)

    return map_batches(ordered, work, FOUND)


def _across_borders(found: DataFrame, window: int, threshold: float) -> DataFrame:
    """Links between the first rows of a partition and the ``window`` rows before them, of however many partitions.

    At most 2 * window rows a group.
    """
    ends = found.filter("kind = 1")
    # A row per partition of the sort that has rows. ``start`` counts the rows before it.
    parts = ends.filter("side = 0").groupBy("part").agg((F.max("place") + 1).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("part").rowsBetween(1, window)
    parts = parts.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    parts = parts.withColumn("later", F.collect_list(F.struct(F.col("part").alias("border"), "start")).over(after))
    reached = F.filter("later", lambda x: x["start"] - window < F.col("start") + F.col("size"))
    borders = parts.select("part", F.col("start").alias("offset"), F.explode(reached).alias("x")).select(
        "part", "offset", "x.border", F.col("x.start").alias("border_start"))
    left = ends.filter("side = 0").join(borders, "part").withColumn("place", F.col("offset") + F.col("place")).filter(
        F.col("place") >= F.col("border_start") - window)
    right = ends.filter("side = 1").withColumn("border", F.col("part"))
    columns = ["border", "side", "place", "pass", "label", "a", "vec"]

    def compare(table: pa.Table) -> pa.Table:
        order = table.sort_by([("side", "ascending"), ("place", "ascending")])
        passes, labels, reps = (order.column(c).to_pylist() for c in ("pass", "label", "a"))
        keys = np.stack([np.array(passes, np.int64), label_numbers(labels), np.array(reps, np.int64)], axis=1)
        a, b = Band(window, threshold).links(keys, order.column("vec").to_pylist())
        return pa.table({"a": a, "b": b})

    both = left.select(*columns).unionByName(right.select(*columns))
    return both.groupBy("border").applyInArrow(compare, "a long, b long")


def _counted(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(rep, links): vectors linked to each representative within its component.

    A component is cut into blocks of about ``block`` vectors, and every pair of blocks is one
    group, so the largest component is spread over many tasks; only counts leave a group.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    placed = members.join(sizes, "root").withColumn("_at", F.pmod(F.xxhash64("rep"), F.col("_blocks")))
    paired = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).select(
        "root", "rep", "copies", "vec", "_at", F.least("_at", "_other").alias("_lo"),
        F.greatest("_at", "_other").alias("_hi"))

    def count(table: pa.Table) -> pa.Table:
        at, lo, hi = (table.column(c).to_numpy() for c in ("_at", "_lo", "_hi"))
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        x = unit_rows(np.array(table.column("vec").to_pylist(), np.float64))
        left, right = np.flatnonzero(at == lo), np.flatnonzero(at == hi)
        links = np.zeros(len(rep), np.int64)
        for s in range(0, len(left), 512):
            rows = left[s:s + 512]
            hit = linked(x[rows], x[right], threshold)
            if lo[0] == hi[0]:
                hit &= rows[:, None] != right[None, :]
            else:
                links[right] += copies[rows] @ hit
            links[rows] += hit @ copies[right]
        return pa.table({"rep": rep, "links": links})

    counted = paired.groupBy("root", "_lo", "_hi").applyInArrow(count, "rep long, links long")
    return counted.groupBy("rep").agg(F.sum("links").alias("links"))


def _blocks(vectors: DataFrame, block: int, seed: int) -> DataFrame:
    """(label, block, rep, copies, vec): vectors dealt to blocks that hold near ones together.

    A label is cut into cells by as many signs as it has doublings of a block; cells that hold
    more are cut by a hash. Blocks of large labels are larger, up to four times ``block``.
    """
    rows = F.least(F.greatest(F.lit(block), F.least(F.lit(4 * block), F.ceil(F.col("n") / 8))),
                   F.greatest(F.lit(1), F.floor(F.lit(MOST_NUMBERS) / F.size("mean"))))
    sizes = _means(vectors).withColumn("rows", rows.cast("long")).withColumn(
        "signs", F.greatest(F.lit(0), F.least(F.lit(30), F.floor(F.log2(F.col("n") / F.col("rows"))).cast("int"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, x in by_size(batches):
            signs, d = batch.column("signs")[0].as_py(), x.shape[1]
            directions = np.random.default_rng([seed, d]).standard_normal((d, 30))[:, :signs]
            above = (x - np.array(batch.column("mean")[0].as_py())) @ directions >= 0
            yield {"label": batch.column("label"), "cell": above @ (1 << np.arange(signs, dtype=np.int64)),
                   **{c: batch.column(c) for c in ("rows", "rep", "copies", "vec")}}

    columns = "label string, cell long, rows long, rep long, copies long, vec array<double>"
    placed = checkpointed(map_batches(vectors.join(sizes, "label"), work, columns))
    pieces = placed.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / F.max("rows")).alias("_pieces"))
    piece = F.pmod(F.xxhash64("rep"), F.col("_pieces"))
    return checkpointed(placed.join(pieces, ["label", "cell"]).select(
        "label", (F.shiftleft("cell", 32) + piece).alias("block"), "rep", "copies", "vec"))


def _vectors(table: pa.Table) -> np.ndarray:
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return unit_rows(flat.reshape(table.num_rows, -1))


def _block_pairs(placed: DataFrame, threshold: float) -> DataFrame:
    """(label, lo, hi) of the blocks that may hold linked vectors, by the balls around them."""

    def ball(table: pa.Table) -> pa.Table:
        x = _vectors(table)
        centre = x.mean(axis=0)
        radius = np.sqrt(((x - centre) ** 2).sum(axis=1)).max()
        return pa.table({"label": table.column("label").slice(0, 1), "block": table.column("block").slice(0, 1),
                         "centre": pa.array([centre.tolist()]), "radius": [float(radius)]})

    balls = checkpointed(placed.groupBy("label", "block").applyInArrow(
        ball, "label string, block long, centre array<double>, radius double"))
    other = balls.select("label", F.col("block").alias("hi"), F.col("centre").alias("_c"), F.col("radius").alias("_r"))
    square = F.aggregate(F.zip_with("centre", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    # Unit vectors with this cosine are so far apart; a little more covers rounding.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    return balls.join(other, "label").filter("block <= hi").filter(
        (F.col("block") == F.col("hi")) | (F.sqrt(square) <= F.col("radius") + F.col("_r") + reach)).select(
        "label", F.col("block").alias("lo"), "hi")


def connected(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and the columns of links, the first column that each one reaches; the number of columns if none."""
    rows, columns = np.full(hit.shape[0], hit.shape[1]), np.arange(hit.shape[1])
    some, far = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    links = hit[np.ix_(some, far)]
    if not links.size:
        return rows, columns
    ours = columns[far]
    while True:
        least = np.where(links, ours, hit.shape[1]).min(axis=1)
        now = np.minimum(ours, np.where(links, least[:, None], hit.shape[1]).min(axis=0))
        if (now == ours).all():
            break
        ours = now
    rows[some], columns[far] = least, ours
    return rows, columns


def _links(placed: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, other): the links of a vector in a pair of blocks, or an edge to another vector.

    The edges connect the same vectors as all links do.
    """
    sides = pairs.select("label", F.col("lo").alias("block"), "lo", "hi").unionByName(
        pairs.filter("lo <> hi").select("label", F.col("hi").alias("block"), "lo", "hi"))

    def compare(table: pa.Table) -> pa.Table:
        at, lo, hi = (table.column(c).to_numpy() for c in ("block", "lo", "hi"))
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        x = _vectors(table)
        left, right = np.flatnonzero(at == lo), np.flatnonzero(at == hi)
        links, a, b = np.zeros(len(rep), np.int64), [], []
        for s in range(0, len(left), 512):
            rows = left[s:s + 512]
            hit = linked(x[rows], x[right], threshold)
            if lo[0] == hi[0]:
                hit &= rows[:, None] != right[None, :]
            else:
                links[right] += copies[rows] @ hit
            if not hit.any():
                continue
            links[rows] += hit @ copies[right]
            for mine, first in zip((rows, right), connected(hit), strict=True):
                used = np.flatnonzero(first < len(right))
                to = rep[right[first[used]]]
                moved = rep[mine[used]] != to
                a.append(rep[mine[used]][moved])
                b.append(to[moved])
        some = np.flatnonzero(links)
        ends = np.concatenate([np.zeros(0, np.int64), *a])
        others = np.concatenate([np.zeros(0, np.int64), *b])
        return pa.table({
            "rep": np.concatenate([rep[some], ends]),
            "links": pa.array([*links[some].tolist(), *[None] * len(ends)], pa.int64()),
            "other": pa.array([*[None] * len(some), *others.tolist()], pa.int64())})

    return placed.join(sides, ["label", "block"]).groupBy("label", "lo", "hi").applyInArrow(
        compare, "rep long, links long, other long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.98, miss: float = 1e-6, most_passes: int | None = None, window: int = 512,
                    block: int = 2048, sample: int = 256, seed: int = 7) -> DataFrame:
    """(id, n_links, component_id, kept), one row per input row.

    Vectors are compared by cosine, in double precision, within equal labels and equal
    dimensions. A null label or id, and a vector that is null, empty, zero, or holds null or
    non-finite components, links with nothing: no links, its own component, kept. Equal
    vectors are compared once and count as linked to each other; rows that repeat an id are
    vectors of their own with that id. The id must be an integer. No link is left out; the work
    on a label grows with the pairs of its blocks whose balls come near each other.

    With ``most_passes`` the search goes by passes: links inside a component are complete, but
    a link between two components is missed if its vectors are further apart than ``window`` in
    every pass. A label is given the passes after which that befalls a share ``miss`` of pairs at
    the threshold, as rated from its size and about ``sample`` of its rows (``passes_for``), but
    ``most_passes`` at most; a label within the window needs one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("string").alias("_label"),
                          F.col(vector_col).cast("array<double>").alias("_vec"))
    good = F.col("_id").isNotNull() & F.col("_label").isNotNull() & usable(F.col("_vec"))
    # Adding 0.0 turns -0.0 into 0.0, so that equal vectors have one form.
    rows = rows.withColumn("_good", good).withColumn("_vec", F.transform("_vec", lambda x: x + F.lit(0.0)))
    # A number per distinct vector: two of them can have the same smallest id, if rows repeat ids.
    distinct = checkpointed(rows.filter("_good").groupBy("_label", "_vec").agg(
        F.min("_id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    labelled = distinct.select(F.concat_ws("/", "_label", F.size("_vec").cast("string")).alias("label"), "rep", "copies",
                               F.col("_vec").alias("vec"))
    if most_passes is None:
        placed = _blocks(labelled, block, seed)
        found = checkpointed(_links(placed, _block_pairs(placed, threshold), threshold))
        edges = found.filter("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    else:
        plans = checkpointed(_plans(labelled, window, threshold, miss, most_passes, sample, seed))
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = checkpointed(_neighbours(_signed(labelled.join(plans, "label"), seed), partitions, window, threshold))
        edges = found.filter("kind = 0").select("a", "b").unionByName(_across_borders(found, window, threshold))
    roots = component_roots(edges, []).select(F.col("node").alias("rep"), "root")
    roots = roots.unionByName(roots.select(F.col("root").alias("rep"), "root")).distinct()
    members = checkpointed(distinct.select("rep", "id", "copies", F.col("_vec").alias("vec")).join(roots, "rep"))
    smallest = members.groupBy("root").agg(F.min("id").alias("_least"))
    least = members.select("rep", "root").join(smallest, "root").select("rep", "_least")
    if most_passes is None:
        counted = found.filter("links IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    else:
        counted = _counted(members.drop("id"), threshold, block)
    results = distinct.join(least, "rep", "left").join(counted, "rep", "left").select(
        F.col("_label").alias("_l"), F.col("_vec").alias("_v"), F.coalesce("_least", "id").alias("_root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    match = (F.col("_label") == F.col("_l")) & (F.col("_vec") == F.col("_v"))
    joined = rows.filter("_good").join(results, match)
    alone = rows.filter(~F.col("_good")).select(
        F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"),
        F.lit(True).alias("kept"))
    return joined.select(
        F.col("_id").alias(id_col), F.col("_links").alias("n_links"), F.col("_root").alias("component_id"),
        (F.col("_id") == F.col("_root")).alias("kept")).unionByName(alone)
