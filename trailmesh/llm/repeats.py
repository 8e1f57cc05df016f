"""Periodic runs in word sequences, by branching tandem repeats on an enhanced suffix array.

A run is a stretch of words that repeats with a period and that no neighbouring word
prolongs. Per document a suffix array of the words is built by prefix doubling, with its
inverse and the common prefixes of neighbours. Every interval of suffixes with a common
prefix of ``depth`` words falls into children, which differ in the next word. For the
suffixes i of all children but the largest, the inverse array tells whether i + depth or
i - depth lies in the same interval, but in another child: then the prefix stands twice in
a row, and the word after the second copy ends the repetition. Such squares are rotated to
the left as far as the words agree, and those with the same stretch are one run, whose
period is the smallest. The intervals exist as array positions only; no tree is built.

The arrays of many documents are built at once: words of different documents are different
symbols, so no interval spans two documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmesh.llm.arrow import map_batches, slices

LEAST_WORDS = 6
LEAST_COPIES = 4
RUNS = "array<struct<start:long,length:long,period:long>>"


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the names of all prefixes of 1, 2, 4, ... symbols.

    A name is the first place, in the order, of the suffixes that share the prefix; it has
    -1 at the end of the text. Only suffixes that are not yet alone are compared again.
    """
    n = len(symbols)
    order = np.argsort(symbols)
    ordered = symbols[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    places = np.arange(n)
    names = np.full(n + 1, -1, np.int32)
    names[order] = np.maximum.accumulate(np.where(fresh, places, 0))
    levels, width = [names], 1
    while True:
        alone = fresh & np.append(fresh[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order, levels
        at = order[open_]
        after = names[np.minimum(at + width, n)]
        key = names[at].astype(np.int64) * (n + 1) + after + 1
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        fresh[open_] = first
        names = names.copy()
        names[at] = np.maximum.accumulate(np.where(first, open_, 0))
        levels.append(names)
        width *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """``lcp[k]``: symbols that the suffixes at k - 1 and k share; 0 at both ends (n + 1 values)."""
    lcp = np.zeros(len(order) + 1, np.int64)
    k = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[k - 1], order[k]
    shared = np.zeros(len(k), np.int64)
    for i in range(len(levels) - 1, -1, -1):
        step = (levels[i][a] == levels[i][b]).astype(np.int64) << i
        a, b, shared = a + step, b + step, shared + step
    lcp[k] = shared
    return lcp


def _nearest(lcp: np.ndarray, k: np.ndarray, step: int, strict: bool) -> np.ndarray:
    """For the places ``k``, the nearest one before (-1) or after (+1) with a smaller (or equal) value."""
    link = np.arange(len(lcp)) + step
    todo = k
    while len(todo):
        there = lcp[link[todo]]
        todo = todo[there >= lcp[todo] if strict else there > lcp[todo]]
        link[todo] = link[link[todo]]
    return link[k]


def squares(order: np.ndarray, lcp: np.ndarray, least_size: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(i, depth) of all branching squares: ``depth`` words at i, the same again, then another word.

    Intervals of fewer than ``least_size`` suffixes are passed over.
    """
    n = len(order)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    k = np.flatnonzero(lcp > 0)
    lower, upper = _nearest(lcp, k, -1, True), _nearest(lcp, k, 1, True)
    wide = upper - lower >= least_size
    k, lower, upper = k[wide], lower[wide], upper[wide]
    # A child ends before each place with the interval's own depth; the last one ends with the interval.
    last = _nearest(lcp, k, 1, False) == upper
    begin = np.concatenate([_nearest(lcp, k, -1, False), k[last]])
    end = np.concatenate([k, upper[last]])
    depth = np.concatenate([lcp[k], lcp[k[last]]])
    low, high = np.concatenate([lower, lower[last]]), np.concatenate([upper, upper[last]])
    # All children of an interval but the largest.
    by = np.lexsort((begin - end, depth, low))
    head = np.ones(len(by), bool)
    head[1:] = (low[by][1:] != low[by][:-1]) | (depth[by][1:] != depth[by][:-1])
    small = by[~head]
    begin, end, depth, low, high = begin[small], end[small], depth[small], low[small], high[small]
    sizes = end - begin
    i = order[_spans(begin, sizes)]
    own = np.repeat(np.arange(len(small)), sizes)
    found = []
    for way in (1, -1):
        j = i + way * depth[own]
        inside = np.flatnonzero((j >= 0) & (j < n))
        place, child = inverse[j[inside]], own[inside]
        hit = (place >= low[child]) & (place < high[child]) & ((place < begin[child]) | (place >= end[child]))
        found.append((np.minimum(i[inside], j[inside])[hit], depth[child[hit]]))
    both = np.concatenate([f[0] * (n + 1) + f[1] for f in found])
    both = np.unique(both)
    return both // (n + 1), both % (n + 1)


def runs_of(symbols: np.ndarray, least_words: int = LEAST_WORDS, least_copies: int = LEAST_COPIES
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of ``least_words`` words and ``least_copies`` periods or more, by start."""
    if not len(symbols):
        return (np.zeros(0, np.int64),) * 3
    order, levels = suffix_array(symbols)
    # The first words of all copies but the last begin with the same whole period, and the last copy too.
    i, depth = squares(order, common_prefixes(order, levels), max(2, least_copies))
    start, other = i.copy(), i + depth
    for k in range(len(levels) - 1, -1, -1):  # rotated to the left by 2^k words where these agree
        left = np.flatnonzero(start >= 1 << k)
        same = left[levels[k][start[left] - (1 << k)] == levels[k][other[left] - (1 << k)]]
        start[same] -= 1 << k
        other[same] -= 1 << k
    length = i + 2 * depth - start
    enough = length >= np.maximum(least_words, least_copies * depth)
    start, length, depth = start[enough], length[enough], depth[enough]
    by = np.lexsort((depth, length, start))
    start, length, depth = start[by], length[by], depth[by]
    # The same stretch under a multiple of its period is the same run.
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[first], length[first], depth[first]


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS,
              least_copies: int = LEAST_COPIES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs``.

    Words are stretches of characters other than space, tab, line feed, vertical tab, form
    feed and carriage return. ``runs`` lists (start, length, period) in words, by start and
    period, of all runs of at least ``least_words`` words and ``least_copies`` periods (2 or
    more). ``collapsed`` joins with one space the words that no run contains after its first
    period. A null or empty text has no words, no runs and an empty ``collapsed``; a null id is
    carried, rows that repeat are answered each, other columns are not read. Nothing is
    shuffled. Memory: some 250 bytes a word of a slice, which is a few MB of text or one
    longer text.
    """
    if least_copies < 2:
        raise ValueError("a run has two periods at least")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shape = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in slices(batches, "text", 2 << 20):
            lists = pc.ascii_split_whitespace(part.column("text").fill_null(""))
            words = lists.flatten()
            some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.cumsum(some)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            words = words.filter(pa.array(some))
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.diff(edges)
            owner = np.repeat(np.arange(len(counts)), counts)
            start, length, period = runs_of(owner * (int(codes.max(initial=0)) + 1) + codes, least_words, least_copies)
            change = np.zeros(len(codes) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            kept = np.cumsum(change[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(kept)])[edges]
            if not kept.all():
                words = words.filter(pa.array(kept))
            own = owner[start] if len(start) else np.zeros(0, np.int64)
            by = np.lexsort((period, start))  # lists are sorted by start, then period
            start, length, period, own = start[by], length[by], period[by], own[by]
            each = pa.StructArray.from_arrays([pa.array(start - edges[own]), pa.array(length), pa.array(period)],
                                              fields=list(shape))
            yield {
                "doc_id": part.column("doc_id"), "n_words": counts,
                "runs": pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(own, np.arange(len(counts) + 1)).astype(np.int32)), each),
                "collapsed": pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words), " "),
            }

    return map_batches(rows, work, f"doc_id long, n_words long, runs {RUNS}, collapsed string")
