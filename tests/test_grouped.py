"""Groups of a sorted partition, many in one call."""

import numpy as np
import pandas as pd

from trailmesh.operators import regions
from trailmesh.operators.grouped import whole_groups


def test_groups_of_any_batches_are_seen_whole():
    rows = pd.DataFrame({"g": [0, 0, 0, 1, 2, 2, 3, 3, 3, 3], "h": list("aaaaabbbbb"), "v": range(10)})
    calls = []

    def fn(part, first):
        calls.append(len(part))
        return part.assign(first=part["v"].to_numpy()[first])

    for size in (1, 2, 3, 10):
        calls.clear()
        cut = [rows.iloc[i:i + size].reset_index(drop=True) for i in range(0, 10, size)]
        out = pd.concat(list(whole_groups(["g", "h"], fn)(iter(cut))))
        assert out["first"].tolist() == [0, 0, 0, 3, 4, 5, 6, 6, 6, 6] and out["v"].tolist() == list(range(10))
    assert calls == [6, 4]  # five groups, one call for the complete ones, one for the last


def test_sweep_of_several_tiles_equals_one_after_the_other():
    rng = np.random.default_rng(5)
    tiles = []
    for _ in range(20):
        at = sorted({(int(y), int(x)) for y, x in rng.integers(0, 6, (int(rng.integers(1, 20)), 2))})
        tiles.append(([y for y, _ in at], [2 * x for _, x in at], [2 * x + int(rng.integers(0, 2)) for _, x in at]))
    flat = [[v for t in tiles for v in t[k]] for k in range(3)]
    first = [sum(len(u[0]) for u in tiles[:n]) for n, t in enumerate(tiles) for _ in t[0]]
    for slack in (0, 1):
        alone = [v for t in tiles for v in regions._sweep(*t, slack, [0] * len(t[0]))]
        assert regions._sweep(*flat, slack, first) == alone
