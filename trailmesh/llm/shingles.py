"""Word shingles of many texts at once, as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

HASH_KEY = "trailmesh-words!"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z lower-cased, split at ASCII white space), and where each text begins."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(names, hash_key=HASH_KEY, categorize=False) if len(names) else np.zeros(0, np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words = hashes[codes]
    blank = (names == "")[codes] if len(names) else np.zeros(0, bool)
    if blank.any():  # white space at an end of a text leaves an empty piece
        offsets = offsets - np.concatenate([[0], np.cumsum(blank)])[offsets]
        words = words[~blank]
    return words.astype(np.uint64), offsets


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` words in a row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
    return out


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Per text its distinct shingles, sorted; of a shorter text all its words as one; none of one without words."""
    words, offsets = word_hashes(texts)
    hashes = rolling(words, size)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(hashes[a:b - size + 1])
        else:
            yield rolling(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)
