"""Cost-balanced packing of token ids into sequences of a fixed capacity.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n``: the work of the dense
layers and of attention inside the piece. Long documents first fill whole sequences; the
remaining tails, in descending order, each go to the cheapest sequence that still has room.
Only where a tail fits nowhere whole is it cut, so that sequences end full. What is left
over at the end of a block forms sequences whose lengths are powers of two, which need no
padding.

Packing happens where the documents are read, in blocks of about ``block_tokens`` ids, so
ids are never shuffled. Sequence numbers carry the number of the input partition: pass a
stored table, so that a lost task finds the same rows in the same partition again.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmesh.llm.arrow import map_batches, slices

CAPACITY = 4096
END_ID = 2
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
#: Texts with other characters than printable Latin-1, or with a special token, are encoded as a whole.
UNUSUAL = "[^\t\n\r -~\u00a1-\u00ff]|<\\|"
#: Fixed pattern of this vocabulary's words, for Latin-1 in lower case.
WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]"
    "|[^\\sa-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff0-9\u00b2\u00b3\u00b9\u00bc-\u00be]+")
WORD_END = "</w>"


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every span, one span after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


class WordTokenizer:
    """Token ids of texts, looked up word by word; only new words reach the tokenizer.

    In this vocabulary no token crosses a word's end, so a bounded table of words gives the
    same ids as encoding whole texts, several times faster.
    """

    def __init__(self, path: str, max_words: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        tokens = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.ends_word = np.array([(t or "").endswith(WORD_END) for t in tokens])
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def add(self, names: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names)), strict=True))

    def learn(self, words: list[str]) -> None:
        """Encodes new words, many in one text, and cuts the ids at the words' ends."""
        texts = [" ".join(words[i:i + 64]) for i in range(0, len(words), 64)]
        codes = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(c.ids, np.uint32) for c in codes])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            raise ValueError("the vocabulary does not mark the ends of words")
        self.add(words, ids, np.diff(ends, prepend=0))

    def chunks(self, chunks: list[str]) -> np.ndarray:
        """Numbers, in the table, of the given pieces between white space."""
        if len(self.known) > self.max_words:
            self.clear()
        known = self.known
        found = np.fromiter((known.get(c, -1) for c in chunks), np.int64, len(chunks))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [chunks[i] for i in missing]
            words = [WORDS.findall(c) for c in new]
            fresh = list({w for ws in words for w in ws if w not in known})
            if fresh:
                self.learn(fresh)
            joined = [(c, ws) for c, ws in zip(new, words, strict=True) if c not in known]
            if joined:
                parts = np.fromiter((known[w] for _, ws in joined for w in ws), np.int64)
                sizes = np.array([len(ws) for _, ws in joined])
                counts = np.add.reduceat(self.counts[parts], np.cumsum(sizes) - sizes)
                self.add([c for c, _ in joined], self.ids[spans(self.starts[parts], self.counts[parts])], counts)
            found[missing] = [known[c] for c in new]
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text, without special ones; a null text has none."""
        texts = texts.fill_null("")
        unusual = pc.match_substring_regex(texts, UNUSUAL)
        odd = np.flatnonzero(unusual.to_numpy(zero_copy_only=False)).tolist()
        plain = pc.if_else(unusual, "", texts) if odd else texts
        lists = pc.ascii_split_whitespace(pc.utf8_lower(plain))
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        if "" in names:  # white space at an end leaves an empty piece
            names[names.index("")] = " "
        table = self.chunks([n for n in names if n != " "])
        numbers = np.full(len(names), -1, np.int64)
        numbers[[i for i, n in enumerate(names) if n != " "]] = table
        starts = np.where(numbers < 0, 0, self.starts[numbers]) if len(self.starts) else np.zeros(len(names), np.int64)
        counts = np.where(numbers < 0, 0, self.counts[numbers]) if len(self.counts) else np.zeros(len(names), np.int64)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        stream = self.ids[spans(starts[codes], counts[codes])]
        edges = np.concatenate([[0], np.cumsum(counts[codes])])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        found = [stream[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for i in odd:
            found[i] = self.whole(texts[i].as_py())
        return found


def capacities(tokens: int, capacity: int) -> list[int]:
    """Full sequences, then powers of two for the rest."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0,
           quadratic: float = 1.0 / CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of the given lengths.

    Sequences end exactly full. Ties go to the longer, then the earlier document, and to the
    lower sequence.
    """
    pieces, tails = [], []
    sequence = 0
    for d, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            tails.append((n % capacity, d, n - n % capacity))
    sizes = np.array(capacities(sum(t[0] for t in tails), capacity), np.int64)
    room, cost = sizes.copy(), np.zeros(len(sizes))
    tails.sort(key=lambda t: (-t[0], t[1]))
    for n, d, start in tails:
        while n:
            fits = np.flatnonzero(room >= n)
            if len(fits):
                best, part = int(fits[np.argmin(cost[fits])]), n
            else:  # cut: fill the sequence with most room
                best = int(np.argmax(room))
                part = int(room[best])
            pieces.append((d, start, part, sequence + best, int(sizes[best] - room[best])))
            room[best] -= part
            cost[best] += linear * part + quadratic * part * part
            start, n = start + part, n - part
    return pieces


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, linear: float = 1.0,
                   quadratic: float = 1.0 / CAPACITY, block_tokens: int = 1 << 21,
                   make_tokenizer: Callable[[str], WordTokenizer] = WordTokenizer) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers. A document's ids are
    those of its whole text followed by ``end_id``; a null or empty text has ``end_id`` alone.
    Rows that repeat are packed each. A null id is carried as null. Other columns are not read.
    Memory: ids of one block, and a bounded table of words per worker.
    """
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def packed(block: list[tuple[int | None, np.ndarray]], first: int) -> tuple[dict, int]:
        order = sorted(range(len(block)), key=lambda i: (-len(block[i][1]), block[i][0] is None, block[i][0] or 0))
        block = [block[i] for i in order]
        pieces = assign([len(ids) for _, ids in block], capacity, linear, quadratic)
        pieces.sort(key=lambda p: (p[3], p[4]))
        out = {
            "doc_id": [block[d][0] for d, *_ in pieces],
            "start": [p[1] for p in pieces],
            "length": [p[2] for p in pieces],
            "ids": [block[d][1][s:s + n].astype("<u4").tobytes() for d, s, n, _, _ in pieces],
            "doc_tokens": [len(block[p[0]][1]) for p in pieces],
            "sequence_id": [first + p[3] for p in pieces],
            "offset": [p[4] for p in pieces],
        }
        return out, max(p[3] for p in pieces) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tokenizer = _tokenizer(make_tokenizer, path)
        following = TaskContext.get().partitionId() << 36
        block, tokens = [], 0
        end = np.array([end_id], np.uint32)
        for part in slices(batches, "text"):
            for doc, ids in zip(part.column("doc_id").to_pylist(), tokenizer.encode(part.column("text")), strict=True):
                ids = np.concatenate([ids, end])
                block.append((doc, ids))
                tokens += len(ids)
                if tokens >= block_tokens:
                    out, used = packed(block, following)
                    following += used
                    block, tokens = [], 0
                    yield out
        if block:
            yield packed(block, following)[0]

    return map_batches(rows, work, PIECES)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(make, path: str) -> WordTokenizer:
    """One tokenizer per worker process, kept between tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = make(path)
    return _TOKENIZERS[path]
