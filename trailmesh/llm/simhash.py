"""Benchmark decontamination by SimHash over windows of the size of each item.

Every window of a document that has as many words as an item gets a fingerprint of its word
shingles, weighted by how often they occur in it. Fingerprints are looked up in a multi-index:
four blocks of 16 bits, each listed under all values within a quarter of the radius, so every
item within the Hamming radius is found in at least one block. What is found is verified by
the exact weighted similarity of the two shingle multisets. A shingle that repeats can turn more
bits than the radius allows, so wherever a document holds enough of an item's shingles the
shared counts of all windows are taken as well, whatever their fingerprints.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmesh.llm.arrow import map_batches, slices
from trailmesh.llm.shingles import HASH_KEY, mix, rolling

BLOCKS, BLOCK_BITS = 4, 16
#: If no shingle repeats, a pair of similarity 0.8 lies beyond 19 bits in less than one of a thousand; such pairs, and
#: those with repeats, are found by their shared counts.
RADIUS = 19
FILTER_BITS = 20
MATCHES = "doc long, item_id long, similarity double, start_word long, n_words long"


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters, marks, digits; lower case) of all texts, and where each text begins."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}\p{N}\p{M}]+", " ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(plain))
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(names, hash_key=HASH_KEY, categorize=False) if len(names) else np.zeros(0, np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    blank = (names == "")[codes] if len(names) else np.zeros(0, bool)
    words = hashes[codes].astype(np.uint64)
    if blank.any():  # a text without words is one empty piece
        offsets = offsets - np.concatenate([[0], np.cumsum(blank)])[offsets]
        words = words[~blank]
    return words, offsets


def signs(shingles: np.ndarray) -> np.ndarray:
    """A row of 64 values +1 or -1 per shingle."""
    bits = np.unpackbits(mix(shingles).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of 64 sums; a tie counts as 1."""
    return np.packbits(sums >= 0, axis=1).view(">u8").astype(np.uint64).reshape(-1)


@dataclass
class Size:
    """The items of one number of words."""

    words: int
    items: list[int]  # positions in the index
    prints: np.ndarray
    keys: np.ndarray  # sorted: block and value
    entries: np.ndarray  # item, parallel to keys
    pieces: np.ndarray  # sorted: the distinct shingles of each item
    owners: np.ndarray  # item, parallel to pieces
    wanted: np.ndarray  # how often the item has the shingle, parallel to pieces

    def promising(self, shingles: np.ndarray, least: float) -> list[int]:
        """Items of which the distinct ``shingles`` can make up ``least`` shared ones."""
        lo, hi = np.searchsorted(self.pieces, shingles, "left"), np.searchsorted(self.pieces, shingles, "right")
        n = hi - lo
        at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        most = np.bincount(self.owners[at], weights=self.wanted[at], minlength=len(self.items))
        return np.flatnonzero(most >= least).tolist()


class Index:
    """Fingerprints, multi-index and shingles of a block of items."""

    def __init__(self, items: Iterable[tuple[int, str]], shingle: int, least_words: int, radius: int):
        self.shingle, self.radius = shingle, radius
        self.ids: list[int] = []
        self.counts: list[Counter] = []
        near = [np.array([sum(1 << b for b in c) for c in combinations(range(BLOCK_BITS), k)], np.int64)
                for k in range(radius // BLOCKS + 1)]
        self.near = np.concatenate(near)
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        every: list[np.ndarray] = []
        for item, text in items:
            words, _ = normal_words(pa.array([text], pa.string()))
            if len(words) < max(least_words, 1):
                continue
            found = rolling(words, min(shingle, len(words)))
            by_size.setdefault(len(words), []).append((len(self.ids), found))
            self.ids.append(item)
            self.counts.append(Counter(found.tolist()))
            every.append(found)
        self.known = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.known & np.uint64((1 << FILTER_BITS) - 1)] = True
        self.sizes = [self._size(n, rows) for n, rows in sorted(by_size.items())]

    def _size(self, words: int, rows: list[tuple[int, np.ndarray]]) -> Size:
        prints = packed(np.array([signs(found).sum(axis=0) for _, found in rows]))
        keys, entries = [], []
        for b in range(BLOCKS):
            value = ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
            keys.append(((b << BLOCK_BITS) | (value[:, None] ^ self.near)).reshape(-1))
            entries.append(np.repeat(np.arange(len(rows)), len(self.near)))
        keys, entries = np.concatenate(keys), np.concatenate(entries)
        order = np.argsort(keys, kind="stable")
        each = [np.unique(found, return_counts=True) for _, found in rows]
        pieces, wanted = np.concatenate([e[0] for e in each]), np.concatenate([e[1] for e in each])
        owners = np.repeat(np.arange(len(rows)), [len(e[0]) for e in each])
        rank = np.argsort(pieces, kind="stable")
        return Size(words, [r for r, _ in rows], prints, keys[order], entries[order].astype(np.int32), pieces[rank],
                    owners[rank], wanted[rank])

    def holds(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles some item has."""
        maybe = self.filter[shingles & np.uint64((1 << FILTER_BITS) - 1)]
        at = np.flatnonzero(maybe)
        if len(at):
            place = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
            maybe[at] = self.known[place] == shingles[at]
        return maybe

    def within_radius(self, size: Size, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) for all fingerprints within the radius of each other."""
        pairs = []
        for b in range(BLOCKS):
            key = (b << BLOCK_BITS) | ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
            lo, hi = np.searchsorted(size.keys, key, "left"), np.searchsorted(size.keys, key, "right")
            n = hi - lo
            if n.any():
                window = np.repeat(np.arange(len(prints)), n)
                entry = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
                pairs.append(window * len(size.prints) + size.entries[entry])
        if not pairs:
            return
        pairs = np.unique(np.concatenate(pairs))
        window, item = pairs // len(size.prints), pairs % len(size.prints)
        close = np.bitwise_count(prints[window] ^ size.prints[item]) <= self.radius
        yield from zip(window[close].tolist(), item[close].tolist(), strict=True)

    def matches(self, words: np.ndarray, hashes: np.ndarray, percent: int) -> Iterator[tuple[int, float, int, int]]:
        """(item id, similarity, first word, words) of the best window of each item found in a document.

        ``hashes`` are the document's shingles. Windows that hold no shingle of any item have
        similarity 0 to all of them and are passed over.
        """
        hits = np.flatnonzero(self.holds(hashes))
        if not len(hits):
            return
        best: dict[int, tuple[float, int, int]] = {}
        for lo, hi in _stretches(hits, 2 * self.sizes[-1].words):
            # The part of the document whose windows can touch these hits.
            reach = self.sizes[-1].words
            a, b = max(0, lo - reach), min(len(hashes), hi + reach + 1)
            sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(hashes[a:b]), axis=0)])
            mine = hits[(hits >= a) & (hits < b)] - a
            touched = np.zeros(b - a + 1, np.int32)
            np.add.at(touched, mine + 1, 1)
            touched = np.cumsum(touched)
            for size in self.sizes:
                span = size.words - self.shingle + 1  # shingles in a window
                if len(words) < size.words:  # a shorter document is one window
                    if a > 0 or b < len(hashes):
                        continue
                    span = len(hashes)
                if span < 1 or span > b - a:
                    continue
                starts = np.arange(b - a - span + 1)
                held = touched[starts + span] - touched[starts]
                starts = starts[held > 0]
                if not len(starts):
                    continue
                # shared * 100 >= percent * union, for the union of a window and an item of this size
                least = percent * (span + size.words - self.shingle + 1) / (100 + percent) - 1e-6
                if held.max() >= least:
                    for i in size.promising(np.unique(hashes[a + mine]), least):
                        shared = self._shared(size.items[i], hashes[a:b], span)
                        w = int(np.argmax(shared))
                        if shared[w] >= least:
                            self._verify(size.items[i], hashes[a + w:a + w + span], a + w, percent, best)
                prints = packed(sums[starts + span] - sums[starts])
                for w, i in self.within_radius(size, prints):
                    start = a + int(starts[w])
                    self._verify(size.items[i], hashes[start:start + span], start, percent, best)
        for i, (similarity, start, span) in sorted(best.items()):
            yield self.ids[i], similarity, start, span + self.shingle - 1

    def _shared(self, item: int, hashes: np.ndarray, span: int) -> np.ndarray:
        """Sum of the lesser counts of each shingle of the item and of every window of ``span`` shingles.

        An occurrence counts in the windows that hold it but not yet as many earlier ones as the item has.
        """
        counts = self.counts[item]
        keys = np.array(sorted(counts), np.uint64)
        wanted = np.array([counts[k] for k in keys.tolist()])
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        place = np.flatnonzero(keys[at] == hashes)
        order = np.argsort(at[place], kind="stable")
        place, group = place[order], at[place][order]
        before = np.arange(len(place)) - wanted[group]
        full = before >= np.searchsorted(group, group, "left")
        since = np.where(full, place[np.maximum(before, 0)] + 1, 0)
        steps = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(steps, np.maximum(since, np.maximum(place - span + 1, 0)), 1)
        np.add.at(steps, place + 1, -1)
        return np.cumsum(steps)[:len(hashes) - span + 1]

    def _verify(self, item: int, window: np.ndarray, start: int, percent: int, best: dict) -> None:
        wanted = self.counts[item]
        own = Counter(window.tolist())
        shared = sum(min(n, wanted[s]) for s, n in own.items() if s in wanted)
        union = len(window) + wanted.total() - shared
        if shared * 100 >= percent * union:
            found = (shared / union, start, len(window))
            if item not in best or (-found[0], found[1]) < (-best[item][0], best[item][1]):
                best[item] = found


def _stretches(hits: np.ndarray, gap: int) -> Iterator[tuple[int, int]]:
    """First and last hit of every group of hits that lie closer than ``gap``."""
    cuts = np.flatnonzero(np.diff(hits) > gap) + 1
    edges = [0, *cuts.tolist(), len(hits)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(hits[a]), int(hits[b - 1])


def _search(docs: DataFrame, index: Index, percent: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found = sent.value
        for part in slices(batches, "text"):
            words, offsets = normal_words(part.column("text"))
            hashes = rolling(words, found.shingle)
            ids = part.column("doc").to_pylist()
            marked = np.concatenate([[0], np.cumsum(found.holds(hashes))]) if len(hashes) else np.zeros(1, np.int64)
            rows = []
            for doc, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                end = b - found.shingle + 1
                if end <= a or marked[end] == marked[a]:
                    continue
                rows += [(doc, *m) for m in found.matches(words[a:b], hashes[a:end], percent)]
            if rows:
                yield dict(zip(("doc", "item_id", "similarity", "start_word", "n_words"), zip(*rows, strict=True),
                               strict=True))

    return map_batches(docs, work, MATCHES)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, percent: int = 80,
                 least_words: int = 5, radius: int = RADIUS, item_block: int = 2000) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): per document and item found in it, the best window.

    Similarity is the sum of the lesser over the sum of the greater counts of each shingle;
    ``percent`` or more is a match, and of equal windows the first counts. A document with
    fewer words than an item is one window. Items with fewer than ``least_words`` words prove
    nothing and are left out, as are null texts and items without an id; at least ``shingle``
    words are needed. Rows that repeat are searched each. Items go to the tasks in blocks of
    ``item_block``, one pass over the documents for each, so what is broadcast is bounded.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col).cast("string")).dropna().distinct()
    stream = (tuple(r) for r in items.toLocalIterator())
    result = None
    while block := list(islice(stream, item_block)):
        index = Index(sorted(block), shingle, max(least_words, shingle), radius)
        if index.ids:
            part = _search(rows, index, percent)
            result = part if result is None else result.unionByName(part)
    if result is None:
        result = docs.sparkSession.createDataFrame([], MATCHES)
    return result.withColumnRenamed("doc", id_col).withColumnRenamed("item_id", item_col)
