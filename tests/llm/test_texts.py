"""MinHash, line dedup, decontamination and packing against plain versions, on awkward rows."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.awkward import clash, texts
from trailmesh.llm import lines, minhash, packing, simhash

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = texts()
    return clash(spark.createDataFrame(rows + [rows[0], rows[12]], SCHEMA))  # two rows repeat


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("limits", [{}, {"list_block": 2, "block": 1, "block_shingles": 40}])
def test_near_duplicates_equal_all_pairs(docs, limits):
    want = brute.near_duplicates(dict.fromkeys(texts()))
    for row in minhash.near_duplicates(docs, **limits).collect():
        if row.doc_id is not None:
            assert (row.n_shingles, row.component_id) == want[row.doc_id], row
            assert row.kept == (row.doc_id == row.component_id)
        else:
            assert row.kept and row.component_id is None


def test_near_duplicates_of_nothing(nothing):
    assert minhash.near_duplicates(nothing).collect() == []


def test_matches_bound():
    assert minhash.least_matches(64, 0.85, 1e-5) == 41
    assert minhash.least_matches(4, 1.0, 0.5) == 4


@pytest.mark.parametrize("least_words", [1, 10])
def test_lines_equal_all_pairs(docs, least_words):
    want = brute.repeated_lines([t for t in texts() if t[0] is not None], least_words)
    got = lines.without_repeated_lines(docs, least_words=least_words)
    assert got.columns == [*(c for c in docs.columns if c != "n_removed"), "n_lines", "n_removed"]
    rows = got.collect()
    assert len(rows) == len(texts()) + 2
    for row in rows:
        if row.doc_id is None:
            assert row.n_removed == 0
        else:
            assert row.text == want[row.doc_id], row.doc_id
        assert row.n_lines == (len(row.text.split("\n")) + row.n_removed if row.text else row.n_lines)


def test_lines_of_nothing(nothing):
    assert lines.without_repeated_lines(nothing).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=6), min_size=1, max_size=7), st.integers(1, 5))
def test_longest_earlier_over_blocks(segments, size):
    """Chains across any number of blocks give what all pairs give."""
    suffixes, g = [], 0
    for segment in segments:
        for k in range(len(segment)):
            suffixes.append((segment[k:], g))
            g += 1
    suffixes.sort()

    def shared(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    want = [max([shared(s, t) for t, h in suffixes if h < i], default=0) for s, i in suffixes]
    places = np.array([i for _, i in suffixes])
    common = np.array([0] + [shared(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False)])
    blocks = [slice(a, a + size) for a in range(0, len(suffixes), size)]
    down, up, tails = [], [], {}
    for n, b in enumerate(blocks):
        own, c = places[b], common[b]
        _, d, least = lines._one_side(own, c, [])
        _, u, _ = lines._one_side(own[::-1], np.append(c[1:], lines.INF)[::-1], [])
        tail = int(common[b.stop]) if b.stop < len(common) else 0
        if b.stop < len(common):
            tails[n] = tail
        down.append((n, d, least))
        up.append((n, u, min(int(c[1:].min()) if len(c) > 1 else lines.INF, tail)))
    before, after = lines._carried(down), lines._carried(up[::-1])
    got = np.concatenate([
        lines.longest_earlier(places[b], common[b], before[n], after[n], tails.get(n, 0)) for n, b in enumerate(blocks)])
    assert got.tolist() == want


def test_decontamination_equals_all_windows(spark, docs):
    items = [(1, "The quick brown fox jumps over the lazy dog while seven wizards boil strong coffee at dawn"),
             (2, " ".join(f"word{k}" for k in range(10, 40))), (3, None), (None, "a b c d e f"), (4, ""), (5, "too short"),
             (6, "la la la la la la la la la la la la")]
    bench = clash(spark.createDataFrame(items, "item_id long, text string"))
    want = brute.contaminated([t for t in texts() if t[0] is not None],
                              [i for i in items if i[0] is not None and i[0] != 5])
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in simhash.contaminated(docs, bench, item_block=2)
           .collect() if r.doc_id is not None}
    assert {(20, 1), (21, 1), (1, 2), (16, 6)} <= set(want)
    assert got == want


def test_decontamination_of_nothing(spark, docs, nothing):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert simhash.contaminated(nothing, bench).collect() == []
    assert simhash.contaminated(docs, bench.limit(0)).columns == ["doc_id", "item_id", "similarity", "start_word", "n_words"]
    assert simhash.contaminated(docs, bench.limit(0)).collect() == []


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 500, 30))) for k in range(50)]
    index = simhash.Index(items, 5, 5, simhash.RADIUS)
    size = index.sizes[0]
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 30), replace=False)) for _ in range(400)],
                     np.uint64)
    prints = size.prints[rng.integers(0, 50, 400)] ^ flips
    want = {(w, i) for w in range(400) for i in range(50)
            if bin(int(prints[w]) ^ int(size.prints[i])).count("1") <= simhash.RADIUS}
    assert set(index.within_radius(size, prints)) == want


def test_packing_round_trip(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts() if i is not None}
    pieces = packing.pack_documents(docs, block_tokens=20_000).toPandas()
    assert not pieces.duplicated(["sequence_id", "offset"]).any()
    twice = {1, 13}
    for doc, rows in pieces[pieces.doc_id.notna()].groupby("doc_id"):
        covered = np.zeros(len(want[doc]), int)
        for r in rows.itertuples():
            ids = np.array(want[doc][r.start:r.start + r.length], "<u4").tobytes()
            assert r.doc_tokens == len(want[doc]) and zlib.crc32(ids) == zlib.crc32(r.ids)
            covered[r.start:r.start + r.length] += 1
        assert (covered == (2 if doc in twice else 1)).all()
    for _, rows in pieces.sort_values("offset").groupby("sequence_id"):
        total = int(rows.length.sum())
        assert (rows.offset == rows.length.cumsum() - rows.length).all()
        assert total <= 4096 and total & (total - 1) == 0  # no padding at all


def test_packing_of_nothing(nothing):
    assert packing.pack_documents(nothing).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=30))
def test_assignment_fills_sequences(lengths):
    pieces = packing.assign(lengths, capacity=16)
    seen = {d: sorted((s, n) for e, s, n, _, _ in pieces if e == d) for d in range(len(lengths))}
    for d, n in enumerate(lengths):
        at = 0
        for s, k in seen[d]:
            assert s == at
            at += k
        assert at == n
    filled = {}
    for _, _, n, q, _ in pieces:
        filled[q] = filled.get(q, 0) + n
    assert all(f == 16 or f & (f - 1) == 0 for f in filled.values()) and sum(f == 16 for f in filled.values()) == sum(lengths) // 16


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(st.sampled_from("aB '1.é²ß\n\t\x1c<|Σs"), max_size=30)),
                min_size=1, max_size=6))
def test_word_table_equals_tokenizer(batch):
    import pyarrow as pa

    for text, ids in zip(batch, TABLE.encode(pa.array(batch, pa.string())), strict=True):
        assert ids.tolist() == TABLE.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


TABLE = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), max_words=50)


def test_decontamination_with_repeated_words(spark):
    """A run of one word turns more bits of a fingerprint than the radius allows; such windows count all the same."""
    rng = np.random.default_rng(9)
    docs, items = [], []
    for k, (size, run) in enumerate([(60, 6), (60, 5), (120, 11), (200, 12), (200, 20), (300, 28)]):
        words = [f"k{k}w{x}" for x in rng.integers(0, 10_000, size)]
        head, tail = " ".join(words[:size - run]), " ".join(words[size - run:])
        other = " ".join(f"z{x}" for x in rng.integers(0, 10_000, 40))
        items += [(2 * k, f"{head} {tail}"), (2 * k + 1, f"{other} {head}" + " so" * run)]
        docs += [(3 * k, f"{other} {head}" + " la" * (run + 30)), (3 * k + 1, f"{other} {head} {tail}"),
                 (3 * k + 2, " la" * 50 + f" {head}" + " so" * (run // 2) + " la" * 40)]
    want = brute.contaminated(docs, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = simhash.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, item_block=5)
    assert {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in found.collect()} == want
    missed = simhash.Index(items, 5, 5, simhash.RADIUS)
    missed._shared = lambda item, hashes, span: np.zeros(1)  # by fingerprints alone
    alone = set()
    for doc, text in docs:
        words, _ = simhash.normal_words(pa.array([text]))
        alone |= {(doc, m[0]) for m in missed.matches(words, simhash.rolling(words, 5), 80)}
    assert alone < set(want)
