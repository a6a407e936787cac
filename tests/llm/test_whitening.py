import math
from fractions import Fraction

import numpy as np
import pytest

from strandloom.llm import whitening as W


def brute(vectors, most=16):
    """x, n, exact deviations, |whitened|, explained of the vectors that take part, by numpy's eigenvectors."""
    own = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in own]
    fit = sorted({tuple(v) for v in x})
    n, dims = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(dims)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in fit])
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][: min(most, dims)]
    place = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in x])
    return n, deviation, place @ vectors_[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(700, 24)) * np.linspace(0.5, 4, 24) + 3
    out = [[np.float32(c) for c in v] for v in base]
    out += [out[3]] * 300 + [None, [float("nan")] + [0.0] * 23, [float("inf")] + [0.0] * 23, [None] + [0.0] * 23]
    return out


def test_rows_equal_a_single_decomposition(spark, tmp_path, vectors):
    table(spark, vectors).repartition(40).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = W.op11_embedding_whitening(spark, str(tmp_path)).toPandas()
    n, deviation, white, share = brute(vectors)
    assert len(rows) == 1000 * 16 and set(rows.n) == {n} == {len({tuple(v) for v in vectors[:700]})}
    assert rows[rows.component == 1].sort_values("vec_id").deviation.tolist() == deviation
    got = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.abs(got), np.abs(white), atol=1e-8)
    assert (np.abs(np.abs((got * white).sum(0)) - (white**2).sum(0)) < 1e-6).all()  # one sign for all rows
    assert np.allclose(rows.groupby("component").explained.first(), share, rtol=1e-9)
    assert rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-9


def test_merging_keeps_all_that_one_decomposition_has():
    rnd = np.random.default_rng(1)
    x = rnd.integers(999_000, 1_001_000, (3000, 12))
    parts = [W.Summary.of_block(p) for p in np.array_split(x, [1, 5, 17, 400, 401, 2000])]
    while len(parts) > 1:
        parts = [a.merged(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    whole = x - x.mean(0)
    assert parts[0].n == 3000 and parts[0].sums == x.sum(0).tolist() and parts[0].rows.shape == (12, 12)
    want = whole.T @ whole
    assert np.abs(parts[0].rows.T @ parts[0].rows - want).max() < 1e-12 * want.max()


def test_defined_cases(spark):
    run = lambda vs: W.whiten(table(spark, vs)).collect()
    assert run([]) == [] and run([None, []]) == [] and run([[1.0, 2.0]] * 5) == []  # nothing varies
    low = run([[float(i), 0.0] for i in range(6)])
    assert {len(r.whitened) for r in low} == {1} and low[0].identity_error < 1e-9  # one dimension varies
    short = run([[1.0], [1.0, 0.0], [0.0, 2.0], [5.0, 1.0]])  # filled up with zeros
    assert [r.n for r in short] == [3] * 4 and short[0].whitened == short[1].whitened
    huge = run([[3e38, 0.0], [0.0, 1.0], [1.0, 2.0], [-3e38, 5.0]])
    assert [r.deviation is None for r in huge] == [True, False, False, True]
    far = run([[2.0**40, 0.0], [0.0, 1.0], [1.0, 2.0]])
    assert far[1].deviation is None or isinstance(far[1].deviation, int)


def test_clashing_columns_are_kept(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i)], "a", i, None) for i in range(5)], "vec_id long, embedding array<float>, n string, X int, whitened string")
    out = W.whiten(df)
    assert out.columns[:5] == df.columns and out.count() == 5 and {r.n for r in out.collect()} == {"a"} and {r["n_"] for r in out.collect()} == {5}
