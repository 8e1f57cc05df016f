import random
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tests.llm import awkward
from trailmesh.llm import bestfit


def fewest(items, capacity):
    """The least number of sequences, by trying all assignments."""
    items, best = sorted(items, reverse=True), len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                at = rooms.index(room)
                go(i + 1, rooms[:at] + [room - items[i]] + rooms[at + 1:])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def contents(patterns):
    used = Counter()
    for times, content in patterns:
        for n, each in content:
            used[n] += times * each
    return used


def test_reduction_never_costs_a_sequence():
    chance = random.Random(3)
    fixed_some = 0
    for _ in range(600):
        capacity = chance.choice([10, 20, 50])
        least = chance.choice([1, capacity // 4, capacity // 3])
        most = chance.choice([capacity, capacity // 2])
        items = Counter(chance.randint(min(least, most), most) for _ in range(chance.randint(0, 9)))
        stock = bestfit.Stock(dict(items))
        fixed = bestfit.reduce(stock, capacity)
        fixed_some += bool(fixed and stock.counts)
        left = list(Counter(stock.counts).elements())
        assert sum(t for t, _ in fixed) + fewest(left, capacity) == fewest(list(items.elements()), capacity), items
        assert contents(fixed) + Counter(stock.counts) == items
    assert fixed_some > 5


@pytest.mark.parametrize("shape", ["short", "spread", "all alike"])
def test_plan_uses_every_piece_once(shape):
    chance = np.random.default_rng(1)
    lengths = {"short": chance.lognormal(5.5, 1.3, 50_000).clip(1, 4096), "spread": chance.integers(1, 4097, 50_000),
               "all alike": np.full(50_000, 1000)}[shape].astype(int)
    counts = dict(Counter(lengths.tolist()))
    patterns = bestfit.plan(counts)
    assert contents(patterns) == Counter(counts)
    assert all(sum(n * each for n, each in content) <= bestfit.CAPACITY for _, content in patterns)
    sequences, least = sum(t for t, _ in patterns), -(-int(lengths.sum()) // bestfit.CAPACITY)
    assert sequences == {"all alike": 12_500}.get(shape, sequences) and sequences <= max(1.01 * least, 12_500)
    assert len(patterns) < 3 * bestfit.CAPACITY  # what the driver holds does not grow with the corpus


def test_best_fit_is_that_of_single_pieces():
    chance = random.Random(4)
    for _ in range(300):
        capacity = chance.choice([12, 30])
        counts = Counter(chance.randint(1, capacity) for _ in range(chance.randint(0, 40)))
        rooms = []
        for n in sorted(counts.elements(), reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - n)
            else:
                rooms.append(capacity - n)
        patterns = bestfit.best_fit(dict(counts), capacity)
        got = Counter({})
        for times, content in patterns:
            got[capacity - sum(n * each for n, each in content)] += times
        assert got == Counter(rooms)


def test_documents_come_back_whole(spark):
    rows = awkward.texts() + [(40 + i, "same words here") for i in range(400)]
    df = awkward.clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = bestfit.pack_documents(df, capacity=64).collect()
    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for d, t in rows)
    texts, places = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and r.start == 64 * r.piece and (r.length == 64 or len(ids))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None and r.doc_id < 40:
            texts.setdefault(r.doc_id, {})[r.piece] = tuple(ids.tolist())
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 64
    for doc, parts in texts.items():
        assert want[(doc, sum((parts[k] for k in range(len(parts))), ()))] == 1
    lengths = Counter(r.length for r in got)
    cut = Counter()
    for (_, ids), n in want.items():
        cut[64] += n * (len(ids) // 64)
        cut[len(ids) % 64] += n
    del cut[0]
    assert lengths == +cut
    assert sorted(places) == list(range(len(places)))
    assert bestfit.pack_documents(df.limit(0)).count() == 0
