"""The k best items of a query, kept from chunk to chunk: the same as from all scores, ordered whole."""

import numpy as np
import pyarrow as pa
import pytest

from weftline.operators import vectors as V


def _rows(r, n, width, odd):
    """Few different values, so that many scores tie or all but tie; some rows null, of another width or zero."""
    rows = [[float(x) for x in r.integers(-2, 3, width)] for _ in range(n)]
    if odd:
        for i, x in ((0, None), (1, [1.0, 2.0]), (2, [0.0] * width), (3, [float("nan")] * width), (4, [1.0, None] + [0.0] * (width - 2))):
            rows[i] = x
    return pa.array(rows, pa.list_(pa.float64()))


def _whole(left, names, right, ids, k, floor, skip):
    best = np.full((len(ids), len(names)), -np.inf)
    for a in left:
        for b in right:
            np.maximum(best, V._same(a, b), out=best)
    best = np.round(np.where(np.isfinite(best), best, 0.0), 6)
    if skip:
        best[ids[:, None] == names] = -np.inf
    order = np.lexsort((np.broadcast_to(names, best.shape), -best), axis=1)[:, :k]
    return sorted((int(ids[i]), int(names[j]), best[i, j]) for i in range(len(ids)) for j in order[i] if best[i, j] >= floor)


@pytest.mark.parametrize("seed,k,floor,skip,odd,second", [(1, 6, -1.0, False, False, False), (2, 5, 0.3, True, True, True), (3, 40, 0.0, False, True, False), (4, 3, -1.0, True, True, True)])
def test_items_kept_from_chunk_to_chunk(monkeypatch, seed, k, floor, skip, odd, second):
    monkeypatch.setattr(V, "SOME", 200)
    r = np.random.default_rng(seed)
    none = lambda n: pa.array([None] * n, pa.list_(pa.float64()))
    side = lambda n: [V._matrix(_rows(r, n, 7, odd)), V._matrix(_rows(r, n, 7, odd) if second else none(n))]
    ids, names = r.permutation(60), r.permutation(90)
    left, right = side(60), side(90)
    one = V.Nearest(ids, k, floor)
    for low, high in ((0, 4), (4, 50), (50, 90)):
        one.meet(left, names[low:high], [(x[low:high], n[low:high]) for x, n in right], skip)
    got = sorted((int(a), int(b), c) for a, b, c in zip(*one.rows()))
    assert got == _whole(left, names, right, ids, k, floor, skip)


def test_a_block_has_k_rows_for_a_query_however_many_chunks_it_meets():
    """Before, k rows for each query and chunk of items were passed on."""
    r = np.random.default_rng(7)
    left = [V._matrix(_rows(r, 20, 7, False))]
    one = V.Nearest(np.arange(20), 3, -1.0)
    for chunk in range(30):
        one.meet(left, np.arange(10) + 10 * chunk, [V._matrix(_rows(r, 10, 7, False))], False)
    assert len(one.rows()[0]) == 60
