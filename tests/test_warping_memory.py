"""What the warping solvers hold at once does not grow with the pairs of a batch."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import warping
from tidemark.operators import dtw

SOLVERS = {
    "band": lambda x, y: warping.dtw_distances(x, y, "symmetric", 7),
    "shape": lambda x, y: warping.dtw_distances(x, y, "symmetric", 7, True),
    "weighted": lambda x, y: warping.weighted_dtw(x, y, "cityblock", window=7, weight=1.2)[:, -1, -1],
}


@pytest.mark.parametrize("name", list(SOLVERS))
def test_a_batch_is_solved_in_small_parts(name):
    rng = np.random.default_rng(0)
    a, b = (pd.Series([[w] for w in rng.normal(size=(1100, 64))]) for _ in range(2))
    tracemalloc.start()
    got = dtw.solve_pairs(a, b, SOLVERS[name])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48e6
    for k in (0, 1024, 1099):
        x, y = dtw.as_matrix(a[k])[None], dtw.as_matrix(b[k])[None]
        assert got[k] == SOLVERS[name](x, y)[0]
