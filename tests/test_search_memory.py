"""A task's search holds one slice of scores, whatever the size of its batches."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from quarry.operators import retrieval


def test_scores_are_held_by_slices():
    rng = np.random.default_rng(3)
    asked, items = rng.integers(-3, 4, (1000, 4)).astype(float), rng.integers(-2, 3, (6000, 4)).astype(float)
    keys = rng.permutation(6000)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 3000]), pa.array(items[a : a + 3000].tolist(), pa.list_(pa.float64()))], names=["_k", "_v"]) for a in (0, 3000)]
    tracemalloc.start()
    out = list(retrieval._best_of_task(SimpleNamespace(value=(asked, 7, None)))(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80_000_000  # the scores of a batch alone are 24 MB, and were copied
    found = {}
    for n, k, score in zip(*(out[0].column(c).to_pylist() for c in ("_n", "_k", "score"))):
        found.setdefault(n, []).append((k, score))
    with np.errstate(divide="ignore", invalid="ignore"):
        exact = np.round(items @ asked.T / (np.sqrt((items**2).sum(1))[:, None] * np.sqrt((asked**2).sum(1))), 6)
    exact = np.nan_to_num(exact, nan=-9.0)
    for n in range(0, 1000, 83):
        first = np.lexsort((keys, -exact[:, n]))[:7]
        # equal scores by key
        assert [k for k, _ in found[n]] == keys[first].tolist()
