"""Packing whole documents into as few sequences as possible: dominance reduction, then best fit.

Documents longer than the capacity are cut into full pieces and a rest; no other document is
cut. What matters for packing are the lengths alone, so the instance is the number of pieces
of each length: at most ``capacity`` numbers, whatever the size of the corpus. Pieces of the
same length are interchangeable, so a decision holds for as many of them as there are.

The reduction goes through the lengths from the longest down. For a longest piece j it looks
for a small set F that dominates every set that could fill j's sequence: whatever else was
put there can be exchanged, piece for piece, for the rest of F, so some best packing has F
together. Such a sequence is fixed for good, the instance shrinks, and the search begins
again. With k the number of pieces that still fit beside j:

* k = 0: F is j alone.
* k = 1, or a piece fills j's sequence exactly: F is j and the longest piece that fits.
* k = 2: the same, if that piece is no shorter than any two that fit together; otherwise j,
  that piece and the longest third one, if no two pieces longer than the third fit with j.

What is left is packed by best fit, the longest first: each piece goes to the fullest
sequence that has room for it.

Spark does the work on documents: texts become ids and are written once, pieces of a length
are numbered by task and place within it, and each number finds its sequence in the plan.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmesh.llm.arrow import map_batches, slices
from trailmesh.llm.packing import WordTokenizer, _tokenizer
from trailmesh.session import checkpointed

CAPACITY = 4096
END_ID = 1
#: Sequences of one kind: how many, and (length, pieces) in each, longest first.
Pattern = tuple[int, tuple[tuple[int, int], ...]]


class Stock:
    """How many pieces there are of each length."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.counts)

    def take(self, length: int, pieces: int) -> None:
        self.counts[length] -= pieces
        if not self.counts[length]:
            del self.counts[length]
            del self.lengths[bisect_left(self.lengths, length)]

    def smallest(self, j: int, pieces: int) -> list[int]:
        """Lengths of the smallest pieces other than one of length ``j``."""
        found: list[int] = []
        for n in self.lengths:
            found += [n] * min(pieces - len(found), self.counts[n] - (n == j))
            if len(found) >= pieces:
                break
        return found

    def longest_up_to(self, room: int, *without: int) -> int:
        """The longest piece of at most ``room``, the given ones left out; 0 if there is none."""
        for n in reversed(self.lengths[:bisect_right(self.lengths, room)]):
            if self.counts[n] > without.count(n):
                return n
        return 0

    def above(self, least: int, j: int) -> list[int]:
        """The two smallest pieces longer than ``least``, one of length ``j`` left out."""
        found: list[int] = []
        for n in self.lengths[bisect_right(self.lengths, least):]:
            found += [n] * min(2 - len(found), self.counts[n] - (n == j))
            if len(found) >= 2:
                break
        return found

    def best_pair(self, j: int, room: int) -> int:
        """The largest sum of two pieces that is at most ``room``, one of length ``j`` left out."""
        usable = [n for n in self.lengths[:bisect_right(self.lengths, room)] if self.counts[n] > (n == j)]
        best, low, high = 0, 0, len(usable) - 1
        while low <= high:
            total = usable[low] + usable[high]
            if total > room:
                high -= 1
                continue
            if low < high or self.counts[usable[low]] - (usable[low] == j) >= 2:
                best = max(best, total)
            low += 1
        return best


def dominating(stock: Stock, j: int, capacity: int) -> list[int]:
    """A set with ``j`` that dominates all others with it, or nothing."""
    room = capacity - j
    fits, total = 0, 0
    for n in stock.smallest(j, 3):
        total += n
        if total > room:
            break
        fits += 1
    if not fits:
        return [j]
    second = stock.longest_up_to(room, j)
    if fits == 1 or second == room:
        return [j, second]
    if fits == 2:
        if second >= stock.best_pair(j, room):
            return [j, second]
        third = stock.longest_up_to(room - second, j, second)
        others = stock.above(third, j)
        if third and (len(others) < 2 or sum(others) > room):
            return [j, second, third]
    return []


def reduce(stock: Stock, capacity: int) -> list[Pattern]:
    """Fixes dominating sets until none is found; the stock keeps the rest."""
    fixed: list[Pattern] = []
    shrunk = True
    while shrunk:
        shrunk = False
        for j in reversed(list(stock.lengths)):
            while stock.counts.get(j):
                chosen = dominating(stock, j, capacity)
                if not chosen:
                    break
                # The set still dominates while its pieces last, since fewer others can only fit worse.
                times = min(stock.counts[n] // chosen.count(n) for n in chosen)
                for n in set(chosen):
                    stock.take(n, times * chosen.count(n))
                fixed.append((times, tuple((n, chosen.count(n)) for n in sorted(set(chosen), reverse=True))))
                shrunk = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit of the longest pieces first; sequences that are alike are kept as one pattern."""
    open_: dict[int, list[tuple[int, tuple]]] = {}  # by room left
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(room: int, times: int, content: tuple) -> None:
        if not room:
            done.append((times, content))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((times, content))

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = min(capacity // n, left)
                put(capacity - each * n, max(1, left // each), ((n, each),))
                left -= each * max(1, left // each)
                continue
            room = rooms[at]
            times, content = open_[room].pop()
            if not open_[room]:
                del open_[room]
                del rooms[at]
            each = min(room // n, left)  # the fullest sequence stays the fullest while there is room
            whole = min(times, left // each)
            if whole < times:
                put(room, times - whole, content)
            put(room - each * n, whole, content + ((n, each),))
            left -= each * whole
    return done + [kind for group in open_.values() for kind in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use up all pieces."""
    stock = Stock(counts)
    fixed = reduce(stock, capacity)
    return fixed + best_fit(stock.counts, capacity)


def slots(patterns: Iterable[Pattern]) -> dict[str, np.ndarray]:
    """For the pieces of each length, numbered from 0: which numbers lie where.

    Row by row, by length and first number: the pieces from ``first`` on go to the sequences
    from ``sequence`` on, ``each`` to a sequence, at ``offset`` and behind each other.
    """
    rows, used, sequence = [], {}, 0
    for times, content in patterns:
        offset = 0
        for n, each in content:
            first = used.get(n, 0)
            rows.append((n, first, sequence, each, offset))
            used[n] = first + times * each
            offset += n * each
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "each", "offset"), table.T, strict=True))


def tokenized(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int,
              make_tokenizer: Callable[[str], WordTokenizer]) -> DataFrame:
    """Pieces with their ids, and for each the number ``nth`` among those of its length in its task."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tokenizer = _tokenizer(make_tokenizer, path)
        task, seen = TaskContext.get().partitionId(), {}
        for part in slices(batches, "text"):
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids", "task", "nth")}
            for doc, ids in zip(part.column("doc_id").to_pylist(), tokenizer.encode(part.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                ids = ids.astype("<u2" if int(ids.max()) < 1 << 16 else "<u4")  # as short as they can be stored
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    cut = ids[start:start + capacity]
                    nth = seen[len(cut)] = seen.get(len(cut), -1) + 1
                    for c, v in zip(out, (doc, piece, start, len(cut), cut.tobytes(), task, nth), strict=True):
                        out[c].append(v)
            yield out

    return map_batches(rows, work, "doc_id long, piece int, start long, length long, ids binary, task int, nth long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID,
                   make_tokenizer: Callable[[str], WordTokenizer] = WordTokenizer) -> DataFrame:
    """Pieces of all documents: (doc_id, piece, start, length, ids, sequence_id, offset).

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers. A document's ids are
    those of its whole text followed by ``end_id``; a null or empty text has ``end_id`` alone.
    A document of at most ``capacity`` ids is one piece; a longer one is cut into pieces of
    ``capacity`` ids and a rest. ``sequence_id`` counts from 0, ``offset`` is gapless from 0.
    Rows that repeat are packed each, a null id is carried as null, other columns are not
    read, an empty table gives no rows. Pieces of one length may be any share of all pieces.
    The driver holds one number per length and the plan, at most some ``capacity`` patterns.
    """
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    pieces = checkpointed(tokenized(docs, path, id_col, text_col, capacity, end_id, make_tokenizer))
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = checkpointed(per_task.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    # At most `capacity` rows.
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))
    numbered = pieces.join(per_task.drop("n").hint("shuffle_hash"), ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids", (F.col("base") + F.col("nth")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = sent.value
        most = max(counts.values(), default=0) + 1
        key = table["length"] * most + table["first"]
        for part in batches:
            length, number = (part.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(key, length * most + number, "right") - 1
            number = number - table["first"][at]
            row, behind = np.divmod(number, table["each"][at])
            wide = [np.frombuffer(b, "<u2" if len(b) == 2 * n else "<u4").astype("<u4").tobytes()
                    for b, n in zip(part.column("ids").to_pylist(), length.tolist(), strict=True)]
            yield {**{c: part.column(c) for c in ("doc_id", "piece", "start", "length")}, "ids": wide,
                   "sequence_id": table["sequence"][at] + row, "offset": table["offset"][at] + behind * length}

    return map_batches(numbered, place, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, "
                                        "offset long")
