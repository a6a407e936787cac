"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Fit: each task keeps, of the distinct vectors it has read, their number, exact sums, and all singular values and right
singular vectors of the centred rows. To take in more rows, or another such summary, it stacks the scaled vectors of
both, appends one row for the difference of their means (weight sqrt(n1 n2 / (n1 + n2))) and decomposes again: nothing is
truncated, so the result is that of one decomposition of all rows. Summaries meet FAN at a time, level by level, in tasks;
a summary's size is set by the dimension d alone (d x d doubles), and only the last one reaches the driver. Means are
taken from integer sums, so no rounding gathers over the levels. A second pass over the distinct vectors measures how far
the covariance of the whitened ones is from the identity, by (number, mean, centred products) merged in the same tree.

Defined cases: rows with a null vector, or one with a null, NaN or infinite entry, are dropped; vectors shorter than the
longest are filled up with zeros; an entry too large for a long counts as the largest one; vec_id is passed on as it is,
null or repeated too; components of no variance (fewer distinct vectors than dimensions, or equal ones) cannot be scaled
to one and are left out, so one distinct vector gives no row; a deviation too large for a long is null; an empty table gives none;
other columns are ignored by the query and kept by whiten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import _io

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
FAN, BLOCK = 16, 2048  # summaries merged at a time; rows decomposed at a time
LONG = (1 << 63) - 1
EPS = np.finfo(np.float64).eps
SUMMARY = "node long, n long, sums string, rows binary"
MOMENTS = "node long, n long, mean binary, products binary"


def whole_numbers(vector: Column) -> Column:
    """array<long> of floor(SCALE * c) + SHIFT, saturated; null where the vector or an entry is null or not finite."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    most = F.lit(LONG - SHIFT)
    one = lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE), -most), most) + SHIFT
    return F.when(vector.isNotNull() & ~F.exists(vector, bad), F.transform(vector, one))


def exact_sums(x: np.ndarray) -> list[int]:
    small = len(x) == 0 or int(np.abs(x).max()) < (1 << 62) // len(x)
    return [int(v) for v in (x if small else x.astype(object)).sum(0)]


class Summary:
    """n rows with their integer sums, and a matrix of at most d rows with the same centred products."""

    def __init__(self, n: int, sums: list[int], rows: np.ndarray):
        self.n, self.sums, self.rows = n, sums, rows

    def mean_from(self, other: Summary) -> np.ndarray:
        """The difference of the means, from exact integers."""
        return np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)], np.float64)

    def merged(self, other: Summary) -> Summary:
        if not self.n or not other.n:
            return other if not self.n else self
        n = self.n + other.n
        apart = np.sqrt(self.n / n * other.n) * self.mean_from(other)
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums)], scaled_vectors(np.vstack([self.rows, other.rows, apart])))

    @staticmethod
    def of_block(x: np.ndarray) -> Summary:
        sums, n = exact_sums(x), len(x)
        base = x[0]
        part = (x - base).astype(np.float64) if int(np.abs(x).max()) < LONG // 2 else (x.astype(object) - base).astype(np.float64)
        mean = np.array([(s - int(b) * n) / n for s, b in zip(sums, base)], np.float64)
        return Summary(n, sums, scaled_vectors(part - mean))

    def row(self, node: int) -> dict:
        return {"node": node, "n": self.n, "sums": " ".join(map(str, self.sums)), "rows": self.rows.astype("<f8").tobytes()}

    @staticmethod
    def read(r) -> Summary:
        sums = [int(v) for v in r.sums.split()]
        return Summary(int(r.n), sums, np.frombuffer(r.rows, "<f8").reshape(-1, len(sums)) if sums else np.zeros((0, 0)))


def scaled_vectors(rows: np.ndarray) -> np.ndarray:
    """Singular values times right singular vectors: all of them, at most as many as there are dimensions."""
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def blocks(batches: Iterator[pa.RecordBatch], column: str, dims: int) -> Iterator[np.ndarray]:
    """The vectors of a list column, dims wide, at most BLOCK at a time."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            yield b.column(column).slice(at, BLOCK).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def merge_tree(rows: DataFrame, schema: str, merge: Callable[[pd.DataFrame], dict]) -> dict | None:
    """The one row that is left when rows (node, ...) have been merged FAN at a time, level by level; None if there were none."""
    rows = _io.stored(rows, "summaries")
    n = rows.agg(F.max("node")).first()[0]
    if n is None:
        return None

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([merge(f.sort_values("node")) | {"node": key[0]}])

    while True:
        rows = rows.groupBy(F.floor(F.col("node") / FAN).alias("parent")).applyInPandas(run, schema)
        n //= FAN
        if not n:
            return rows.first().asDict()


def fit(distinct: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray, np.ndarray] | None:
    """Number, sums, eigenvalues (falling) and unit eigenvectors (rows) of the covariance of the vectors x of a table; None if it is empty."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Summary(0, [], np.zeros((0, dims)))
        for x in blocks(batches, "x", dims):
            own = own.merged(Summary.of_block(x))
        if own.n:
            yield pa.RecordBatch.from_pylist([own.row(TaskContext.get().partitionId())])

    def merge(f: pd.DataFrame) -> dict:
        own = Summary(0, [], np.zeros((0, dims)))
        for r in f.itertuples():
            own = own.merged(Summary.read(r))
        return own.row(0)

    last = merge_tree(distinct.mapInArrow(first, SUMMARY), SUMMARY, merge)
    if last is None:
        return None
    n, sums = last["n"], [int(v) for v in last["sums"].split()]
    _, s, v = np.linalg.svd(np.frombuffer(last["rows"], "<f8").reshape(-1, dims), full_matrices=False)
    v *= np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]  # the largest entry of each is positive
    return n, sums, s**2 / n, v


class Model:
    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, most: int):
        k = min(most, int((values > EPS * len(sums) * values[:1]).sum()))
        self.n, self.sums, self.values, self.k = n, sums, values[:k], k
        self.by = (vectors[:k] / np.sqrt(values[:k])[:, None]).T
        self.explained = values[:k] / values.sum() if k else values[:0]
        self.whole = [s // n for s in sums]
        self.part = np.array([(s - w * n) / n for s, w in zip(sums, self.whole)])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        whole = np.array(self.whole, np.int64)
        near = (x - whole).astype(np.float64) if int(np.abs(x).max()) < LONG // 2 else (x.astype(object) - whole).astype(np.float64)
        return (near - self.part) @ self.by

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact; None where it is beyond a long."""
        most = max(int(np.abs(x).max()) * self.n, *map(abs, self.sums))
        if 2 * most < LONG:
            off = x * self.n - np.array(self.sums, np.int64)
            if int(np.abs(off).max()) ** 2 * off.shape[1] < LONG:
                return (off * off).sum(1).tolist()
        off = x.astype(object) * self.n - np.array(self.sums, object)
        return [int(v) if v <= LONG else None for v in (off * off).sum(1)]


def identity_error(distinct: DataFrame, model: Model, dims: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""

    def combine(a: tuple, b: tuple) -> tuple:
        n, apart = a[0] + b[0], b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] / n * b[0])

    def row(node: int, m: tuple) -> dict:
        return {"node": node, "n": m[0], "mean": m[1].astype("<f8").tobytes(), "products": m[2].astype("<f8").tobytes()}

    none = (0, np.zeros(model.k), np.zeros((model.k, model.k)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = none
        for x in blocks(batches, "x", dims):
            w = model.whitened(x)
            mean = w.mean(0)
            own = combine(own, (len(w), mean, (w - mean).T @ (w - mean)))
        if own[0]:
            yield pa.RecordBatch.from_pylist([row(TaskContext.get().partitionId(), own)])

    def merge(f: pd.DataFrame) -> dict:
        own = none
        for r in f.itertuples():
            own = combine(own, (int(r.n), np.frombuffer(r.mean, "<f8"), np.frombuffer(r.products, "<f8").reshape(model.k, model.k)))
        return row(0, own)

    last = merge_tree(distinct.mapInArrow(first, MOMENTS), MOMENTS, merge)
    cov = np.frombuffer(last["products"], "<f8").reshape(model.k, model.k) / last["n"]
    return float(np.abs(cov - np.eye(model.k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """The rows of vectors that take part, with n, deviation, and whitened, explained (arrays, an entry for each component) and identity_error; clashing names are made longer."""
    x = _io.fresh(vectors, "x")
    rows = vectors.withColumn(x, whole_numbers(F.col(vector))).where(F.col(x).isNotNull())
    names = {c: _io.fresh(vectors, c) for c in ("n", "deviation", "whitened", "explained", "identity_error")}
    more = f"{names['n']} long, {names['deviation']} long, {names['whitened']} array<double>, {names['explained']} array<double>, {names['identity_error']} double"
    dims = rows.agg(F.max(F.size(x))).first()[0] or 0
    filled = F.concat(F.col(x), F.array_repeat(F.lit(SHIFT).cast("long"), dims - F.size(x)))
    rows = rows.withColumn(x, F.when(F.size(x) < dims, filled).otherwise(F.col(x)))
    distinct = _io.stored(rows.select(F.col(x).alias("x")).distinct(), "distinct-vectors")
    got = fit(distinct, dims) if dims else None
    model = Model(*got, components) if got else None
    if not model or not model.k:
        return rows.drop(x).limit(0).selectExpr("*", *[f"CAST(NULL AS {p.split(' ', 1)[1]}) AS {p.split(' ', 1)[0]}" for p in more.split(", ")])
    error = identity_error(distinct, model, dims)

    @F.pandas_udf("deviation long, whitened array<double>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            dev, white = [], []
            for at in range(0, len(s), BLOCK):
                own = np.stack(s.iloc[at : at + BLOCK].to_numpy())
                dev += model.deviations(own)
                white += list(model.whitened(own))
            yield pd.DataFrame({"deviation": pd.array(dev, "Int64"), "whitened": white})

    at = _io.fresh(vectors, "place")
    rows = rows.withColumn(at, place(x))
    share = F.array(*[F.lit(float(v)) for v in model.explained])
    return rows.select(*[F.col(f"`{c}`") for c in vectors.columns], F.lit(model.n).cast("long").alias(names["n"]), F.col(at)["deviation"].alias(names["deviation"]), F.col(at)["whitened"].alias(names["whitened"]), share.alias(names["explained"]), F.lit(error).alias(names["identity_error"]))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(_io.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c"))
    return each.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
