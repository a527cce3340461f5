"""MaxScore against brute force where there are many chunks, and the products it spares."""

from __future__ import annotations

import numpy as np
import pytest

from wavefield.llm import maxscore


def _clustered(rng, n, width, clusters):
    middles = rng.normal(size=(clusters, width))
    return np.floor(1024 * (middles[rng.integers(0, clusters, n)] + 0.2 * rng.normal(size=(n, width))))


@pytest.mark.parametrize("size,near", [(16, 8), (512, 64)])
def test_chunks_and_products(size, near):
    rng = np.random.default_rng(1)
    v = _clustered(rng, 1_500, 32, 12)
    v[700:720] = v[3]  # ties
    ids = rng.permutation(1_500).astype(np.int64)
    parts = maxscore.chunks(ids, v, size, near)
    assert len(parts) > 10 and sorted(np.concatenate([x.ids for x in parts])) == list(range(1_500))
    high, low = (np.array([getattr(x, end) for x in parts]) for end in ("high", "low"))
    products = probed = 0
    for at in range(0, 1_500, 50):
        q, top = v[at], maxscore.TopK(10)
        products += maxscore.search_all(q, ids[at], parts, np.maximum(q * high, q * low), top)
        scores = (v @ q).astype(np.int64)
        best = [i for i in np.lexsort((ids, -scores)) if i != at][:10]
        assert top.ids.tolist() == ids[best].tolist() and top.scores.tolist() == scores[best].tolist()
        threshold = top.threshold()
        for k, x in enumerate(parts):
            bounds = np.maximum(q * high[k], q * low[k])
            again = maxscore.TopK(10)
            again.scores, again.ids = top.scores, top.ids
            if bounds.sum() >= threshold:
                done = maxscore.search(q, ids[at], x, bounds, again)
                probed += 0 < done < len(x.ids) * 32
    assert probed > 20  # lists read for some candidates only
    assert products < 0.5 * 30 * 1_500 * 32


def test_short_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 2.0, -1.0]), (100, [0.5]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, []), (3, [-3.0, 0.25, 8.0])]
    vectors = maxscore.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in maxscore.top_k(vectors.where("vec_id % 100 = 0"), vectors).collect()}
    s = 1024 * 1024
    assert [got[0, k] for k in range(1, 6)] == [(1, 3 * s), (1, 3 * s), (100, s // 2), (2, 0), (3, int(-10.5 * s))]
    assert [got[100, k] for k in range(1, 6)] == [(0, s // 2), (1, s // 2), (1, s // 2), (2, 0), (3, int(-1.5 * s))]
    assert len(got) == 10
