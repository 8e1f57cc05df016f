import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import awkward
from trailmesh.llm import queries, repeats


def brute_runs(words, least_words=6, least_copies=4):
    """(start, length, period) by comparing every word with those behind it."""
    found = {}
    for q in range(1, len(words) // least_copies + 1):
        equal = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        start = None
        for i, same in enumerate(equal):
            if same and start is None:
                start = i
            elif not same and start is not None:
                if i - start + q >= max(least_words, least_copies * q):
                    found.setdefault((start, i - start + q), q)
                start = None
    return sorted((s, n, q) for (s, n), q in found.items())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_of_random_words_match_brute_force():
    chance = random.Random(5)
    for _ in range(1500):
        words = [chance.randrange(chance.choice([1, 2, 3, 4])) for _ in range(chance.randint(0, 70))]
        if len(words) > 10 and chance.random() < 0.6:
            period, start = chance.randint(1, 7), chance.randrange(len(words))
            for i in range(start + period, len(words)):
                words[i] = words[i - period]
            for _ in range(chance.randint(0, 2)):
                words[chance.randrange(len(words))] = chance.randrange(3)
        copies = chance.choice([2, 3, 4])
        got = list(zip(*(x.tolist() for x in repeats.runs_of(np.array(words, np.int64), 6, copies)), strict=True))
        assert got == brute_runs(words, 6, copies), words


def test_suffix_array_and_common_prefixes():
    chance = random.Random(6)
    for _ in range(200):
        words = [chance.randrange(3) for _ in range(chance.randint(1, 40))]
        order, levels = repeats.suffix_array(np.array(words, np.int64))
        assert order.tolist() == sorted(range(len(words)), key=lambda i: words[i:])
        lcp = repeats.common_prefixes(order, levels)
        for k in range(1, len(words)):
            a, b = words[order[k - 1]:], words[order[k]:]
            shared = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[k] == shared


@pytest.mark.parametrize("words", [["la"] * 40_000, ["a", "b", "c"] * 13_000 + ["a"]])
def test_long_runs_take_no_longer(words):
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    got = repeats.runs_of(np.array([code[w] for w in words], np.int64))
    assert [x.tolist() for x in got] == [[0], [len(words)], [len(code)]]


def test_awkward_texts(spark):
    rows = awkward.texts() + [(30, "a b " * 5 + "a"), (31, "x y\x0bz\x1cq " * 7), (30, "a b " * 5 + "a"),
                              (32, "no " * 5), (33, "la " * 9 + "da " * 8), (None, "ho " * 8)]
    df = awkward.clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted((r.doc_id or -1, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in repeats.word_runs(df).collect())
    want = []
    for doc, text in rows:
        words = split(text)
        runs = brute_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((doc or -1, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert got == sorted(want)
    assert repeats.word_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeats.word_runs(df, least_copies=1)


def test_repetitive_documents_follow_the_rule(spark):
    from zlib import crc32

    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(300)] + [(None, "a b"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r, (doc, text) in zip(queries.repetitive(df).collect(), rows, strict=True):
        words, h = split(text), crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert (r.doc_id, split(r.text)) == (doc, words)
    assert df.filter(F.crc32(F.col("doc_id").cast("string")) % 10 == 0).count() > 10
