"""Exact top-k by integer inner product: columnar branch and bound.

Components x become floor(scale * x). Candidates are packed into blocks in vertical layout (a matrix of dimensions by
vectors); queries into blocks of their own. Every pair of a query block and a candidate block is one unit of work,
keyed for the shuffle, so no task holds more than one block of each kind. In it, like queries form small groups, and
dimensions are ordered by the group's and the candidates' energy and taken a few at a time: after each slice, what the
remaining dimensions can add is bounded by the product of remaining norms, a query drops each candidate that can't reach
its k-th best any more, and candidates that no query of the group wants are compacted away. Once few pairs are left, each
goes on alone. A query's bound to beat comes from one block searched before the others, and is raised by the full scores
of its best candidates half way. The last survivors' sums are exact. Each unit emits at most k rows a query, ranked once
more over all blocks.

The arithmetic is exact: sums that could pass 2**53 go through Python integers instead of doubles. A score beyond a
long is held at its end.

Defined cases: a vector that is null, or holds a null or non-finite component, takes no part, as query or
candidate; vectors of unequal length are compared over their common dimensions; an empty vector scores 0; ties go to
the smaller vec_id; rows with a null vec_id take no part; rows that repeat a vec_id are candidates each, but a query's
own vec_id never is one; fewer than k candidates give fewer rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

import ast
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm import _io

SCALE = 1024
CANDIDATES, QUERIES = 4096, 512  # vectors in a block
SLICE = 8  # dimensions summed between two bounds
GROUP = 32  # queries that share a compacted block
PROMISING = 16  # times k: candidates of a query summed whole half way, for its bound
ALONE = 0.03  # share of pairs left from which each pair goes on alone
EXACT = float(1 << 53)
PACKED = "block long, n long, dims int, ids binary, data binary, kind string"


def quantise(vec, scale: int) -> list[int] | None:
    """Components as integers; None if the vector takes no part."""
    if vec is None:
        return None
    x = np.asarray(vec, object if any(v is None for v in vec) else np.float64)
    if x.dtype == object or not np.isfinite(x).all():
        return None
    y = np.floor(x * scale)
    if len(y) and (not np.isfinite(y).all() or np.abs(y).max() >= EXACT):
        return [math.floor(int(a) * scale) if a.is_integer() else math.floor(a * scale) for a in map(float, x)]
    return y.astype(np.int64).tolist()


def _pack(block: int, ids: list[int], vectors: list[list[int]]) -> dict:
    """One block: vertical layout in the narrowest integers, padded with zeros to the longest vector; kind "wide" holds literals for integers beyond 53 bits."""
    dims = max(map(len, vectors), default=0)
    most = max((abs(v) for x in vectors for v in x), default=0)
    own = [x + [0] * (dims - len(x)) for x in vectors]
    kind = "wide" if most >= EXACT else next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max)
    data = repr(own).encode() if kind == "wide" else np.ascontiguousarray(np.array(own, kind).reshape(len(own), dims).T).tobytes()
    return {"block": block, "n": len(ids), "dims": dims, "ids": np.array(ids, np.int64).tobytes(), "data": data, "kind": kind}


def _unpack(n: int, dims: int, ids: bytes, data: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    if kind == "wide":
        return np.frombuffer(ids, np.int64), np.array(ast.literal_eval(data.decode()), object).reshape(n, dims).T
    return np.frombuffer(ids, np.int64), np.frombuffer(data, kind).reshape(dims, n)


def like_groups(q: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Indices of the queries (columns) in groups of at most so many, each with its likes: sorted by the nearest of a few queries far from each other."""
    n = q.shape[1]
    if n > size:
        unit = q / np.maximum(np.sqrt((q * q).sum(0)), 1e-300)
        near, best, own = np.full(n, -np.inf), np.zeros(n, np.int64), 0
        for i in range(-(-n // size)):
            like = unit[:, own] @ unit
            best[like > near] = i
            near = np.maximum(near, like)
            own = int(near.argmin())
        order = np.argsort(best, kind="stable")
    else:
        order = np.arange(n)
    for at in range(0, n, size):
        yield order[at : at + size]


def search_block(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, step: int = SLICE, floor: np.ndarray | None = None, trace: list | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """q, c: dims x vectors. Yields (query index, candidate indices, scores): the k best that reach floor, exact. trace gets (dims summed, pairs left, all pairs) for each group and slice."""
    dims = min(len(q), len(c))
    q, c = q[:dims], c[:dims]
    if q.dtype == object or c.dtype == object or float(np.abs(q, dtype=np.float64).max(initial=0)) * float(np.abs(c, dtype=np.float64).max(initial=0)) * dims >= EXACT / 4:
        q, c = q.astype(object), c.astype(object)
        scores = q.T.dot(c) if dims else np.zeros((q.shape[1], c.shape[1]), object)
        for i in range(q.shape[1]):
            held = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in scores[i]]
            own = sorted((j for j in range(c.shape[1]) if c_ids[j] != q_ids[i]), key=lambda j: (-held[j], c_ids[j]))[:k]
            yield i, np.array(own, np.int64), np.array([held[j] for j in own], np.int64)
        return
    q, c = q.astype(np.float64), c.astype(np.float64)
    least = np.full(q.shape[1], -np.inf) if floor is None else floor.astype(np.float64)
    for group in like_groups(q, GROUP):
        own = q[:, group]
        i, j, score = survivors(own, q_ids[group], c, c_ids, k, step, least[group], trace)
        for at in range(len(group)):
            mine = i == at
            js, ss = j[mine], score[mine]
            if len(js) > k:
                keep = ss >= np.partition(ss, len(ss) - k)[len(ss) - k]  # all ties of the k-th
                js, ss = js[keep], ss[keep]
            order = np.lexsort((c_ids[js], -ss))[:k]
            yield int(group[at]), js[order], ss[order].astype(np.int64)


def survivors(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, step: int, least: np.ndarray, trace: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of all pairs that may be among a query's k best; scores are whole."""
    dims, all_pairs = len(q), q.shape[1] * c.shape[1]
    order = np.argsort(-(c * c).sum(1) * (q * q).sum(1), kind="stable")
    q, c = np.ascontiguousarray(q[order]), np.ascontiguousarray(c[order])
    whole = c
    rest = lambda x: np.sqrt(np.append(np.cumsum((x * x)[::-1], 0)[::-1], np.zeros((1, x.shape[1])), 0)) * (1 + 1e-9)
    q_rest, c_rest = rest(q), rest(c)
    live = np.arange(c.shape[1])
    part = np.zeros((q.shape[1], len(live)))
    part[q_ids[:, None] == c_ids[None, :]] = -np.inf  # a query's own row
    at, half = 0, False
    while at < dims and len(live):
        end = min(at + step, dims)
        part += q[at:end].T @ c[at:end]
        at = end
        if not half and 2 * at >= dims and len(live) > k:  # full scores of the best so far
            half = True
            some = min(len(live), PROMISING * k)
            top = np.argpartition(part, len(live) - some, axis=1)[:, len(live) - some :]
            full = part[np.arange(len(top))[:, None], top] + np.einsum("dq,dqk->qk", q[at:], whole[at:][:, live[top]])
            least = np.maximum(least, np.partition(full, some - k, axis=1)[:, some - k])
        wanted = part + q_rest[at][:, None] * c_rest[at][None, :] >= least[:, None]
        part[~wanted] = -np.inf
        n = int(wanted.sum())
        if trace is not None:
            trace.append((at, n, all_pairs))
        if at < dims and n < ALONE * all_pairs:
            break
        any_ = wanted.any(0)
        if any_.mean() < 0.8:
            live, part, c, c_rest = live[any_], np.ascontiguousarray(part[:, any_]), np.ascontiguousarray(c[:, any_]), c_rest[:, any_]
    i, j = np.nonzero(np.isfinite(part))
    score, j = part[i, j], live[j]
    whole_rest = rest(whole) if at < dims else None
    while at < dims and len(i):  # pair by pair
        end = min(at + step, dims)
        score = score + np.einsum("dp,dp->p", q[at:end][:, i], whole[at:end][:, j])
        at = end
        wanted = score + q_rest[at][i] * whole_rest[at][j] >= least[i]
        i, j, score = i[wanted], j[wanted], score[wanted]
        if trace is not None:
            trace.append((at, len(i), all_pairs))
    return i, j, score


def blocks(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id, embedding -> packed blocks of at most `size` vectors."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, held = [], []

        def flush():
            return pd.DataFrame([_pack(uuid.uuid4().int >> 65, ids, held)])

        for f in frames:
            for i, v in zip(f.vec_id, f.embedding):
                if (own := quantise(v, scale)) is not None:
                    ids.append(int(i))
                    held.append(own)
                if len(ids) == size:
                    yield flush()
                    ids, held = [], []
        if ids:
            yield flush()

    return vectors.mapInPandas(packed, PACKED)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, scale: int = SCALE, n_candidates: int = CANDIDATES, n_queries: int = QUERIES) -> DataFrame:
    """vectors and queries: vec_id, embedding. Returns query_id, rank (from 1), vec_id, score."""
    def pick(df):
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")

    n = _io.parts(vectors.sparkSession)
    # stored: a block keeps its number and its rows whatever is computed again later
    cand = _io.stored(blocks(pick(vectors).repartition(n), n_candidates, scale), "candidates")
    ask = _io.stored(blocks(pick(queries).repartition(max(1, n // 8)), n_queries, scale), "queries")
    groups = cand.count()
    if not groups:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cand = cand.withColumn("unit", F.pmod(F.xxhash64("block"), F.lit(groups))).select("unit", *[F.col(c).alias("c_" + c) for c in cand.columns])
    # the stated query set against all rows: every query block goes to every group of candidate blocks
    ask = ask.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>"))).select("unit", *[F.col(c).alias("q_" + c) for c in ask.columns])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                c_ids, c = _unpack(r.c_n, r.c_dims, r.c_ids, r.c_data, r.c_kind)
                q_ids, q = _unpack(r.q_n, r.q_dims, r.q_ids, r.q_data, r.q_kind)
                floor = np.frombuffer(r.q_floor, "<f8") if r.q_floor else None
                found = [(i, own, score) for i, own, score in search_block(q, q_ids, c, c_ids, k, floor=floor) if len(own)]
                if found:
                    i = np.repeat([x[0] for x in found], [len(x[1]) for x in found])
                    yield pd.DataFrame({"block": r.q_block, "at": i, "query_id": q_ids[i], "vec_id": c_ids[np.concatenate([x[1] for x in found])], "score": np.concatenate([x[2] for x in found])})

    def first_floor(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each query block, the k-th best scores in one block of candidates (minus infinity where there are fewer than k)."""
        for f in frames:
            for r in f.itertuples():
                c_ids, c = _unpack(r.c_n, r.c_dims, r.c_ids, r.c_data, r.c_kind)
                q_ids, q = _unpack(r.q_n, r.q_dims, r.q_ids, r.q_data, r.q_kind)
                floor = np.full(len(q_ids), -np.inf)
                for i, own, score in search_block(q, q_ids, c, c_ids, k):
                    if len(own) == k and abs(int(score[-1])) < EXACT:
                        floor[i] = score[-1]
                yield pd.DataFrame({"q_block": [r.q_block], "q_floor": [floor.astype("<f8").tobytes()]})

    pilot = cand.orderBy(F.desc("c_n"), "c_block").limit(1).drop("unit")
    one = ask.where("unit = 0").drop("unit").withColumn("c_block", F.lit(pilot.select("c_block").first()[0]))
    floors = _io.stored(one.join(pilot, "c_block").mapInPandas(first_floor, "q_block long, q_floor binary"), "floors")
    ask = ask.join(floors, "q_block", "left")
    found = cand.join(ask, "unit").drop("unit").mapInPandas(search, "block long, at long, query_id long, vec_id long, score long")
    best = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _io.table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 10
"""
