import math
import random

import pytest

from strandloom.llm import mixing as M


def brute_targets(size):
    """source -> target, by resharing the excess until none is above its cap."""
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, done = sum(size.values()), {}
    while True:
        free = [s for s in order if s not in done]
        left = total - sum(done.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            return done | share
        done |= {s: 3.0 * size[s] for s in over}


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rnd = random.Random(seed)
    names = ["a", "b", "B", "é", None, "tiny", "z", "empty"][: 5 + seed]
    rows = []
    for i in range(900):
        s = rnd.choice(names + ["a"] * 4)
        n = 0 if s == "empty" else 1 if s == "tiny" else int(rnd.lognormvariate(3, 1))
        rows.append((i, s, "w " * n if n else rnd.choice([None, "", " \n"]), 5))
    rows += [(1, "a", "w w w", 5)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int").repartition(4)
    got = M.mix(docs, bucket_rows=200).collect()
    assert len(got) == len(rows)
    size, taken = {}, {}
    for r in got:
        assert r.taken == r.copies * r.size <= 3 * r.size
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = brute_targets(size)
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(4, 0.01 * t), (s, taken[s], t)
    again = M.mix(docs.repartition(7), bucket_rows=200).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in got) == sorted((r.doc_id, r.size, r.taken) for r in again)


def test_base_rates_tilt(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * (i % 7 + 1)) for i in range(300)], "doc_id long, source string, text string")
    from pyspark.sql import functions as F

    got = M.mix(docs, base=F.when(F.col("doc_id") < 150, 2.0).otherwise(0.5)).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target
    assert sum(r.copies for r in got if r.doc_id < 150) > 3 * sum(r.copies for r in got if r.doc_id >= 150)


def test_empty(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def brute_lambda(sizes, target):
    """lambda of one source by bisection: tokens at rates min(3, exp(lambda size / unit)) are the target."""
    unit = sum(x * x for x in sizes) / sum(sizes)
    low, high = -1e4, 1e4
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(x * min(3, math.exp(min(50, mid * x / unit))) for x in sizes) < target else (low, mid)
    return low, unit


def test_documents_are_tilted_by_newton(spark):
    """Rates differ within a source, follow the dual's solution, and are no single multiplier."""
    rnd = random.Random(5)
    rows = [(s, int(rnd.lognormvariate(3, 1)) + 1, 1.0) for s in "aab" for _ in range(300)] + [(None, 7, 1.0)] * 20
    targets = {"a": 0.4 * sum(x for s, x, _ in rows if s == "a"), "b": 2.2 * sum(x for s, x, _ in rows if s == "b"), None: 3.0 * 7 * 20}
    sizes = spark.createDataFrame(rows, "source string, size long, base double")
    got = {r["source"]: (r["lambda"], r["unit"]) for r in M.newton_rates(sizes, spark.createDataFrame(list(targets.items()), "source string, target double")).collect()}
    assert set(got) == {"a", "b"}  # the third is at its bound
    for s, (lam, unit) in got.items():
        own = [x for t, x, _ in rows if t == s]
        want, u = brute_lambda(own, targets[s])
        assert math.isclose(lam, want, abs_tol=2e-7) and math.isclose(unit, u, rel_tol=1e-9)
        rates = [min(3, math.exp(lam * x / unit)) for x in own]
        assert math.isclose(sum(r * x for r, x in zip(rates, own)), targets[s], rel_tol=1e-6) and max(rates) > 1.5 * min(rates)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * (i % 5), 1, 2, 3, 4) for i in range(40)] + [(1, "a", "w", 1, 2, 3, 4)], "doc_id long, source string, text string, _key int, _copies int, _row int, size int")
    got = M.mix_documents(docs)
    assert got.columns == docs.columns and set(map(tuple, got.collect())) <= set(map(tuple, docs.collect())) and got.count() > 10
