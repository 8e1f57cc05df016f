"""Removal of repeated runs of lines, by a suffix array over line numbers.

Lines that occur more than once get a number; every other line ends a segment. The suffixes
of all segments are sorted by prefix doubling: a round names each suffix by the pair of
names of its first 2^k lines and of the 2^k lines after them. A name is the rank of the
first suffix that has it, so a class is refined in place, and suffixes that are alone, or
that have ended, take no part in later rounds. Neighbours in the suffix array are compared
for their longest common prefix, and from these prefixes follows, for every line, the longest
run from there on that also begins earlier in the corpus. Runs with enough words are later
copies of a maximal repeated run and are deleted; the first copy stays.

The order of the text is the order of document ids, and of lines within a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmesh.llm.arrow import map_batches
from trailmesh.session import checkpointed

PLACE_BITS = 36
#: Lines compared at a time when neighbours of the suffix array are matched.
STEP = 64
INF = 1 << 30


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("body"), text.alias("text"))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _lines(marked: DataFrame) -> DataFrame:
    """(doc, body, p, q, words, h1, h2): the lines that are not blank; p counts these, q counts all lines."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("q"), _bare(x).alias("line")))
    rows = marked.filter("doc is not null and text is not null").select(
        "doc", "body", F.posexplode(F.filter(numbered, lambda s: s["line"] != "")).alias("p", "s"))
    line = F.col("s.line")
    return rows.select("doc", "body", "p", F.col("s.q").alias("q"), F.regexp_count(line, F.lit("[^ \t\r]+")).alias("words"),
                       F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def _numbered(classes: DataFrame) -> DataFrame:
    """Adds to sorted classes (name, x, y, n) the column ``rank``: name, plus the rows of lesser classes of that name.

    Classes are sorted across all partitions; where a name goes on in a later partition, the
    rows it has in earlier ones are added from one row per partition.
    """
    ordered = classes.repartitionByRange("name", "x", "y").sortWithinPartitions("name", "x", "y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, name_now, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            name, n = batch.column("name").to_numpy(), batch.column("n").to_numpy()
            before = np.cumsum(n) - n
            starts = np.concatenate([[0], np.flatnonzero(name[1:] != name[:-1]) + 1])
            base = np.repeat(before[starts], np.diff([*starts.tolist(), len(name)]))
            local = before - base
            if name[0] == name_now:
                local[: starts[1] if len(starts) > 1 else len(name)] += total
            name_now, total = int(name[-1]), int(local[-1] + n[-1])
            yield {"name": name, "x": batch.column("x"), "y": batch.column("y"), "n": n, "before": local,
                   "part": np.full(len(name), part), "last": np.zeros(len(name), bool)}
        if name_now is not None:
            yield {"name": [name_now], "x": [None], "y": [None], "n": [total], "before": [None], "part": [part],
                   "last": [True]}

    found = checkpointed(map_batches(ordered, work, "name long, x long, y long, n long, before long, part int, last boolean"))
    earlier = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = found.filter("last").select("name", "part", F.col("n").alias("_n"))
    # At most one row per partition here; a name may begin in one partition as the last and go on in the next.
    starts = found.filter("not last").groupBy("name", "part").agg(F.lit(0).cast("long").alias("_n")).join(
        ends.select("name").distinct(), "name", "left_semi").join(ends.select("name", "part"), ["name", "part"], "left_anti")
    carried = ends.unionByName(starts).withColumn("_carried", F.sum("_n").over(earlier)).select("name", "part", "_carried")
    return found.filter("not last").join(carried, ["name", "part"], "left").select(
        "name", "x", "y", "n", (F.col("name") + F.col("before") + F.coalesce("_carried", F.lit(0))).alias("rank"))


def _positions(active: DataFrame) -> DataFrame:
    """Numbers the repeated lines in text order (g); seg and last are the ends of their segment.

    ``ids``, on the first line of a segment, holds the names of all its lines. Rows that
    repeat a document are dropped here. A document's lines stay in one task.
    """
    ordered = active.repartitionByRange("doc", "body").sortWithinPartitions("doc", "body", "p")
    columns = ("doc", "body", "p", "q", "words", "name")

    def settled(rows: dict[str, np.ndarray], first: int) -> dict:
        doc, body, p = rows["doc"], rows["body"], rows["p"]
        breaks = (doc[1:] != doc[:-1]) | (body[1:] != body[:-1]) | (p[1:] != p[:-1] + 1)
        starts = np.concatenate([[0], np.flatnonzero(breaks) + 1])
        sizes = np.diff([*starts.tolist(), len(doc)])
        ids: list = [None] * len(doc)
        for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            ids[s] = rows["name"][s:s + n]
        return {**rows, "g": first + np.arange(len(doc)), "seg": first + np.repeat(starts, sizes),
                "last": first + np.repeat(starts + sizes - 1, sizes), "ids": ids}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        following, held = (TaskContext.get().partitionId() << PLACE_BITS) + 1, []

        def flush(keep_last: bool):
            nonlocal following, held
            table = pa.Table.from_batches(held)
            rows = {c: table.column(c).to_numpy() for c in columns}
            key = np.stack([rows["doc"], rows["body"], rows["p"].astype(np.int64)])
            fresh = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
            end = len(fresh)
            if keep_last:  # the last document may go on in the next batch
                same = (rows["doc"] == rows["doc"][-1]) & (rows["body"] == rows["body"][-1])
                end = int(np.argmax(same))
            held = table.slice(end).to_batches()
            rows = {c: v[:end][fresh[:end]] for c, v in rows.items()}
            if len(rows["doc"]):
                out = settled(rows, following)
                following += len(rows["doc"])
                return out
            return None

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 20_000 and (out := flush(True)):
                    yield out
        if held and (out := flush(False)):
            yield out

    return map_batches(ordered.select(*columns), work, "doc long, body long, p int, q int, words int, name long, "
                       "g long, seg long, last long, ids array<long>")


def _suffix_names(positions: DataFrame) -> DataFrame:
    """(g, name): names whose order is the order of the suffixes; equal ones have the same lines to their ends."""
    todo = checkpointed(positions.select("g", "last", "name"))
    done: list[DataFrame] = []
    reach = 1
    while not todo.isEmpty():
        named = todo.select("g", "name")
        for part in done:
            named = named.unionByName(part)
        ahead = F.when(F.col("g") + reach <= F.col("last"), F.col("g") + reach)
        pairs = todo.withColumn("_ahead", ahead).join(
            named.select(F.col("g").alias("_ahead"), F.col("name").alias("_next")), "_ahead", "left").select(
            "g", "last", "name", F.coalesce("_next", F.lit(0)).alias("x"))
        pairs = checkpointed(pairs)
        classes = checkpointed(pairs.groupBy("name", "x").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "y", F.lit(0).cast("long")))
        refined = _numbered(classes)
        after = checkpointed(pairs.join(refined.select("name", "x", "n", "rank"), ["name", "x"]).select(
            "g", "last", F.col("rank").alias("name"), ((F.col("n") > 1) & (F.col("x") > 0)).alias("_open")))
        done.append(after.filter("not _open").select("g", "name"))
        todo = after.filter("_open").select("g", "last", "name")
        reach *= 2
    names = done[0] if done else todo.select("g", "name")
    for part in done[1:]:
        names = names.unionByName(part)
    return names


def _neighbours(suffixes: DataFrame) -> DataFrame:
    """The suffix array in partitions: part, place, and the suffix before each (prev, prev_seg)."""
    columns = ("doc", "body", "p", "q", "words", "first", "g", "seg")
    ordered = suffixes.repartitionByRange("name", "g").sortWithinPartitions("name", "g")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, place, end = TaskContext.get().partitionId(), 0, None
        nothing = (None, None, None)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = {c: batch.column(c) for c in columns}
            g, seg, first = (rows[c].to_pylist() for c in ("g", "seg", "first"))
            before = end or nothing
            yield {**rows, "prev": [before[0], *g[:-1]], "prev_seg": [before[1], *seg[:-1]],
                   "prev_first": [before[2], *first[:-1]], "part": [part] * n,
                   "place": np.arange(place, place + n), "end": [False] * n}
            end, place = (g[-1], seg[-1], first[-1]), place + n
        if end is not None:
            yield {**{c: [None] for c in columns}, "prev": [end[0]], "prev_seg": [end[1]], "prev_first": [end[2]],
                   "part": [part], "place": [None], "end": [True]}

    schema = ("doc long, body long, p int, q int, words int, first long, g long, seg long, prev long, prev_seg long, "
              "prev_first long, part int, place long, end boolean")
    found = checkpointed(map_batches(ordered.select(*columns, "name").drop("name"), work, schema))
    # One row per partition: its last suffix comes before the first of the next partition that has rows.
    ends = found.filter("end").select(
        F.lead("part").over(Window.orderBy("part")).alias("part"), F.lit(0).cast("long").alias("place"),
        F.col("prev").alias("_g"), F.col("prev_seg").alias("_s"), F.col("prev_first").alias("_f")).filter("part is not null")
    return found.filter("not end").join(ends, ["part", "place"], "left").withColumns({
        "prev": F.coalesce("prev", "_g"), "prev_seg": F.coalesce("prev_seg", "_s"),
        "prev_first": F.coalesce("prev_first", "_f")}).drop("end", "_g", "_s", "_f")


def _common_prefixes(array: DataFrame, segments: DataFrame) -> DataFrame:
    """(g, lcp): lines that a suffix has in common with the one before it in the array, where any."""
    todo = array.filter("first = prev_first").select("g", "seg", "prev", "prev_seg", F.lit(0).cast("long").alias("lcp"))
    left = segments.select("seg", F.col("ids").alias("_a"))
    right = segments.select(F.col("seg").alias("prev_seg"), F.col("ids").alias("_b"))
    done: DataFrame | None = None
    while True:
        def cut(ids: str, start: Column) -> Column:
            return F.slice(ids, (start + F.col("lcp") + 1).cast("int"), F.lit(STEP))

        near = todo.join(left, "seg").select("g", "seg", "prev", "prev_seg", "lcp",
                                             cut("_a", F.col("g") - F.col("seg")).alias("_a"))
        both = near.join(right, "prev_seg").withColumn("_b", cut("_b", F.col("prev") - F.col("prev_seg")))
        equal = F.zip_with("_a", "_b", lambda a, b: F.coalesce(a == b, F.lit(False)))
        differs = F.array_position(equal, False)
        step = F.when(differs > 0, differs - 1).otherwise(F.size(equal))
        found = checkpointed(both.withColumn("_n", step).select(
            "g", "seg", "prev", "prev_seg", (F.col("lcp") + F.col("_n")).alias("lcp"), (F.col("_n") == STEP).alias("_open")))
        part = found.filter("not _open").select("g", "lcp")
        done = part if done is None else done.unionByName(part)
        todo = found.filter("_open").select("g", "seg", "prev", "prev_seg", "lcp")
        if todo.isEmpty():
            return done


def longest_earlier(g: np.ndarray, common: np.ndarray, before: list, after: list, last: int) -> np.ndarray:
    """Per suffix, the longest prefix it shares with one that begins earlier in the text.

    ``common[i]`` counts the lines shared with the suffix before; ``last`` those the final
    one shares with the suffix after the block. ``before`` and ``after`` are the chains of
    the blocks on either side.
    """
    up = _one_side(g, common, before)[0]
    back = np.concatenate([common[1:], [last]])[::-1]
    return np.maximum(up, _one_side(g[::-1], back, after)[0][::-1])


def _one_side(g: np.ndarray, common: np.ndarray, chain: list) -> tuple[np.ndarray, list, int]:
    """Matches with the nearest earlier suffix on one side, the block's own chain, and its least common prefix.

    A chain lists, from the block's end inwards, (lines shared with all rows up to the end,
    place in the text), both falling; only the lowest place of equal numbers of lines.
    """
    found = np.zeros(len(g), np.int64)
    places, shared = [], []  # a stack of falling shared prefixes between rising places
    least = INF
    for i, (place, lines) in enumerate(zip(g.tolist(), common.tolist(), strict=True)):
        least = min(least, lines)
        while places and places[-1] > place:
            lines = min(lines, shared.pop())
            places.pop()
        if places:
            found[i] = lines
        else:
            for reach, other in chain:
                if other < place:
                    found[i] = min(lines, reach)
                    break
                if reach == 0:
                    break
        places.append(place)
        shared.append(lines)
    own, reach = [], INF
    for place, lines in zip(reversed(places), reversed(shared), strict=True):
        if reach <= 0:
            break
        if own and own[-1][0] == reach:
            own[-1] = (reach, place)
        else:
            own.append((reach, place))
        reach = min(reach, lines)
    return found, own, least


def _carried(blocks: list[tuple]) -> dict[int, list]:
    """The chain that reaches every block, from (block, own chain, least common prefix) in order."""
    reached, chain = {}, []
    for block, own, least in blocks:
        reached[block] = chain
        own = [tuple(x) for x in own]
        # What lies before the block is reached through all of it; its own rows come first.
        passed = [(min(reach, least), place) for reach, place in chain if min(reach, least) > 0]
        merged: list[tuple[int, int]] = []
        for reach, place in own + passed:
            if merged and place >= merged[-1][1]:
                continue
            if merged and merged[-1][0] == reach:
                merged[-1] = (reach, place)
            else:
                merged.append((reach, place))
        chain = merged
    return reached


def _earlier_runs(array: DataFrame) -> DataFrame:
    """(doc, body, p, q, words, run): the longest run from each line on that also begins earlier."""
    stored = checkpointed(array)
    pairs = "array<struct<reach:long,place:long>>"

    def sorted_rows(table: pa.Table) -> pa.Table:
        return table.sort_by("place")

    def summary(table: pa.Table) -> pa.Table:
        rows = sorted_rows(table)
        g, common = rows.column("g").to_numpy(), rows.column("lcp").to_numpy()
        _, down, least = _one_side(g, common, [])
        _, up, _ = _one_side(g[::-1], np.concatenate([common[1:], [INF]])[::-1], [])
        shaped = [[{"reach": r, "place": p} for r, p in chain] for chain in (down, up)]
        kind = pa.list_(pa.struct([("reach", pa.int64()), ("place", pa.int64())]))
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()),
                         "down": pa.array([shaped[0]], kind), "up": pa.array([shaped[1]], kind),
                         "head": [int(common[0])], "inner": [int(common[1:].min()) if len(common) > 1 else INF],
                         "least": [int(least)]})

    # One short row per partition: a chain has at most as many entries as there are lengths of shared prefixes.
    blocks = sorted(stored.groupBy("part").applyInArrow(
        summary, f"part int, down {pairs}, up {pairs}, head long, inner long, least long").collect())
    before = _carried([(b.part, b.down, b.least) for b in blocks])
    tails = {b.part: n.head for b, n in zip(blocks, blocks[1:], strict=False)}
    backward = [(b.part, b.up, min(b.inner, tails.get(b.part, 0))) for b in reversed(blocks)]
    after = _carried(backward)
    sent = array.sparkSession.sparkContext.broadcast((before, after, tails))

    def resolve(table: pa.Table) -> pa.Table:
        rows = sorted_rows(table)
        before, after, tails = sent.value
        part = rows.column("part")[0].as_py()
        run = longest_earlier(rows.column("g").to_numpy(), rows.column("lcp").to_numpy(), before[part], after[part],
                              tails.get(part, 0))
        rows = rows.select(["doc", "body", "p", "q", "words"]).append_column("run", pa.array(run))
        return rows.filter(pa.array(run > 0))

    kind = "doc long, body long, p int, q int, words int, run long"
    return stored.groupBy("part").applyInArrow(resolve, kind)


def _removed(runs: DataFrame, positions: DataFrame, least_words: int) -> DataFrame:
    """(doc, body, removed): the lines, counted over all lines, that lie in a later copy with enough words."""
    rows = positions.select("doc", "body", "p", "q", "words").join(
        runs.select("doc", "body", "p", "run"), ["doc", "body", "p"], "left")

    def cover(table: pa.Table) -> pa.RecordBatch:
        doc, body, words = (table.column(c).to_numpy() for c in ("doc", "body", "words"))
        run = table.column("run").fill_null(0).to_numpy()
        total = np.concatenate([[0], np.cumsum(words)])
        at = np.arange(len(run))
        long_enough = (run > 0) & (total[at + run] - total[at] >= least_words)
        # A run ends within its document, so nothing is carried into the next one.
        change = np.zeros(len(run) + 1, np.int64)
        np.add.at(change, at[long_enough], 1)
        np.add.at(change, (at + run)[long_enough], -1)
        gone = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        new = np.ones(len(gone), bool)
        new[1:] = (doc[gone[1:]] != doc[gone[:-1]]) | (body[gone[1:]] != body[gone[:-1]])
        first = np.flatnonzero(new)
        lines = pa.array(table.column("q").to_numpy()[gone].astype(np.int32))
        removed = pa.ListArray.from_arrays(pa.array(np.append(first, len(gone)).astype(np.int32)), lines)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[gone[first]]), pa.array(body[gone[first]]), removed], names=["doc", "body", "removed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 20_000:
                table = pa.Table.from_batches(held)
                doc, body = table.column("doc").to_numpy(), table.column("body").to_numpy()
                # The last document may go on in the next batch.
                cut = int(np.argmax((doc == doc[-1]) & (body == body[-1])))
                if cut:
                    yield cover(table[:cut])
                    held = table[cut:].to_batches()
        if held:
            yield cover(pa.Table.from_batches(held))

    # A document's lines follow each other in a sorted stream.
    ordered = rows.select("doc", "body", "p", "q", "words", "run").repartition("doc", "body").sortWithinPartitions("doc", "body", "p")
    return ordered.mapInArrow(work, "doc long, body long, removed array<int>")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 10) -> DataFrame:
    """(doc, body, removed) for the documents that lose lines; ``body`` is a hash of their text."""
    marked = _marked(docs, id_col, text_col)
    lines = checkpointed(_lines(marked))
    counted = checkpointed(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit(1).cast("long").alias("name"), F.col("h1").alias("x"), F.col("h2").alias("y"), "n"))
    named = _numbered(counted).select(F.col("x").alias("h1"), F.col("y").alias("h2"), F.col("rank").alias("name"))
    positions = checkpointed(_positions(lines.join(named, ["h1", "h2"])))
    names = _suffix_names(positions)
    suffixes = positions.select("doc", "body", "p", "q", "words", F.col("name").alias("first"), "g", "seg").join(names, "g")
    array = checkpointed(_neighbours(checkpointed(suffixes)))
    common = _common_prefixes(array, positions.filter("ids is not null").select("seg", "ids"))
    array = array.join(common, "g", "left").withColumn("lcp", F.coalesce("lcp", F.lit(0))).select(
        "doc", "body", "p", "q", "words", "g", "part", "place", "lcp")
    return checkpointed(_removed(_earlier_runs(array), positions, least_words))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           least_words: int = 10) -> DataFrame:
    """``docs`` with ``text_col`` cleaned, and the columns ``n_lines`` and ``n_removed`` added, or put in place of such.

    Lines are compared without white space at their ends. A run of lines is deleted if it has
    at least ``least_words`` words and the same run begins earlier: in a document with a
    smaller id (or the same id and a smaller hash of its text), or higher up. Overlapping
    copies count. Blank lines are never compared; runs go on across them, and they stay,
    unless nothing else does: then the text is empty. A null text stays null with 0 lines, a
    null id leaves a document as it is; rows that repeat an id and a text share one result.
    """
    removed = repeated_lines(docs, id_col, text_col, least_words).select(
        F.col("doc").alias("_doc"), F.col("body").alias("_body"), F.col("removed").alias("_gone"))
    # The input's columns travel inside a struct, so that their names cannot clash with those used here.
    row = docs.select(F.struct("*").alias("_row"))
    text = F.col("_row")[text_col].cast("string")
    keyed = row.withColumns({"_key": F.col("_row")[id_col].cast("long"), "_hash": F.xxhash64(text)})
    joined = keyed.join(removed, (F.col("_key") == F.col("_doc")) & (F.col("_hash") == F.col("_body")), "left")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("_gone", i))
    some = F.exists(kept, lambda x: _bare(x) != "")
    cleaned = F.when(F.col("_gone").isNull(), text).when(some, F.array_join(kept, "\n")).otherwise("")
    columns = [(cleaned if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns
               if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
                         F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"))
