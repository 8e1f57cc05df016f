import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest

from tests.llm import awkward
from trailmesh.llm import burst, queries


def brute_trie(sequences):
    """Rows of the trie over {conversation: list of (role, text)}."""
    members = defaultdict(list)
    for c in sorted(sequences):
        for d in range(len(sequences[c]) + 1):
            members[tuple(sequences[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[k] for k in children[node])
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
    rows = []
    for node, inside in members.items():
        ends = ",".join(str(c) for c in inside if len(sequences[c]) == len(node))
        rows.append((inside[0], len(node), members[node[:-1]][0] if node else None, len(inside), len(children[node]),
                     leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def told(nodes):
    return sorted((tuple(r) for r in nodes.collect()), key=repr)


def ordered(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in found.items()}


@pytest.mark.parametrize(("capacity", "capacity_bytes"), [(1, 1 << 20), (3, 1 << 20), (20, 100), (4096, 1 << 23)])
def test_containers_of_any_size_give_the_same_trie(spark, capacity, capacity_bytes):
    chance = random.Random(capacity)
    rows = []
    for c in range(160):
        turns = [chance.choice("ab") for _ in range(chance.randint(1, 7))]
        if c % 3 == 0:  # a third begins alike, and some of these are copies
            turns = list("hhhhhhhhhh") + turns[: c % 4]
        rows += [(c, k, "user" if k % 2 else None, None if t == "b" and k == 1 else t * (1 + k)) for k, t in enumerate(turns)]
    chance.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = told(burst.prefix_trie(burst.sequences(awkward.clash(df)), capacity, capacity_bytes))
    assert got == brute_trie(ordered(rows))


def test_awkward_conversations(spark):
    rows = [(1, None, "user", "x"), (1, 0, None, None), (1, 1, "", ""), (2, None, "user", "x"), (2, 5, None, ""),
            (None, 0, "user", "lost"), (3, 0, "us", "erx"), (4, 0, "user", "x"), (4, 0, "user", "x"),
            (5, 3, "user", "ü日本" * 50_000), (-7, 0, "user", "x")]
    df = awkward.clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert told(burst.prefix_trie(burst.sequences(df))) == brute_trie(ordered(rows))
    assert burst.prefix_trie(burst.sequences(df.limit(0))).count() == 0


def test_large_class_is_digested_in_slices(spark, monkeypatch):
    monkeypatch.setattr(burst, "SLICE", 7)
    rows = [(c, 0, "user", "same") for c in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert told(burst.prefix_trie(burst.sequences(df))) == brute_trie(ordered(rows))


def test_rebuilt_conversations(spark):
    chance = random.Random(9)
    rows = [(c, k, "user", f"{c // 10} {k} {chance.randint(0, 1)}") for c in range(200) if c % 15
            for k in range(chance.randint(1, 10))]
    whole = ordered(rows)
    want = {}
    for c, own in whole.items():
        h = crc32(str(c).encode()) % 9
        want[c] = whole.get(c - c % 5, [])[:h] + own[h:]
    assert any(not turns for turns in want.values())
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert told(burst.prefix_trie(queries.rebuilt(df), 4)) == brute_trie(want)
