import math
import random

import numpy as np
import pytest

from strandloom.llm import topk as T


def brute(rows, k, scale=T.SCALE):
    ok = [(i, [math.floor(x * scale) if abs(x) < 1e12 else math.floor(int(x) * scale) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 100:
            continue
        own = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b)))), c) for c, b in ok if c != q)[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(own)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    base = [rnd.gauss(0, 0.2) for _ in range(20)]
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(20)]) for i in range(400)]
    rows += [(1000 + i, base) for i in range(150)] + [(2000 + i, [x + rnd.gauss(0, 0.01) for x in base]) for i in range(80)]
    rows += [(3000, None), (3001, [None, 1.0]), (3002, [math.nan] * 20), (3003, [math.inf] + [0.0] * 19), (3004, []), (3100, [0.5] * 3), (None, base), (7, [0.1] * 20)]
    if seed == 2:
        rows += [(4000, [1e30, -2e25, 3.5]), (4001, [1e9] * 20)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, unit string").repartition(5)
    got = T.top_k(df, df.where("vec_id % 100 = 0"), 10, n_candidates=64, n_queries=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (5, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, T.top_k(df, df.where("vec_id = 0"), 10).collect())) == [(0, 1, 5, 1024 * 2048)]
    assert T.top_k(df.limit(0), df.limit(0), 10).count() == 0


def test_bounds_drop_pairs_before_the_last_slice():
    """Vectors around far centres: half way, few pairs are left, and the result is that of all products."""
    rnd = np.random.default_rng(0)
    centre = rnd.normal(0, 300, (12, 64))
    c = np.floor(centre[rnd.integers(0, 12, 3000)].T + rnd.normal(0, 20, (64, 3000)))
    q, trace = c[:, :100], []
    found = list(T.search_block(q, np.arange(100), c, np.arange(3000), 10, trace=trace))
    for i, own, score in found:
        all_ = q[:, i] @ c
        all_[i] = -np.inf
        want = np.lexsort((np.arange(3000), -all_))[:10]
        assert own.tolist() == want.tolist() and score.tolist() == all_[want].astype(int).tolist()
    left = lambda d: sum(n for at, n, _ in trace if at == d) / sum(m for at, _, m in trace if at == d)
    assert sorted(i for i, _, _ in found) == list(range(100)) and left(32) < 0.25 and left(48) < 0.1


def test_no_structure_still_drops_pairs():
    """Directions without structure, with a floor from elsewhere: most pairs go before the last quarter of the dimensions."""
    rnd = np.random.default_rng(1)
    c = rnd.normal(0, 1, (64, 4000))
    c = np.floor(1024 * c / np.sqrt((c * c).sum(0)))
    trace = []
    list(T.search_block(c[:, :64], np.arange(64), c, np.arange(4000), 10, trace=trace))
    left = lambda d: sum(n for at, n, _ in trace if at == d) / sum(m for at, _, m in trace if at == d)
    assert left(40) < 0.75 and left(48) < 0.3 and left(56) < 0.05
