"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits; bit b is set if it is set in more than half of the XXH64 hashes (seed 42) of a text's 4-word
shingles. Equal fingerprints are collapsed first, so copies never meet each other in pairs.

Search: the bits are dealt to parts, correlated bits together; parts get thresholds t_i with sum(t_i + 1) = distance
+ 1, so two fingerprints within the distance agree within t_i on some part. A dynamic programme allots the thresholds
(and the number of parts is chosen) by estimated cost: probes to shuffle, and candidate pairs to verify, estimated
from all fingerprints' bit correlations and a bounded sample of fingerprints. The plan only decides cost; the search
is exact under any plan. Each fingerprint goes to the buckets of its own signature and of its variants within t_i;
within a bucket every pair is verified over all 64 bits, and only a spanning forest of the verified links leaves the
task. Large buckets are split again by the pigeonhole over the remaining bits, and compared block by block.

Defined cases: null or empty text, or one without words, has fingerprint 0 and links like any other; fewer than four
words make one shingle; a null doc_id takes part, but component_id is the smallest non-null doc_id (null if there is
none); repeated rows are kept; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import _io
from strandloom.llm.components import components, local_roots

BITS, DISTANCE, SHINGLE, SEED = 64, 4, 4, 42
SAMPLE = 2048  # fingerprints in the cost estimate
LARGE = 1500  # bucket members compared in one matrix
PROBE_S, PAIR_S = 2e-6, 5e-9  # cost of a shuffled probe and of a verified pair
ONES = np.uint64(1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    starts = np.zeros(len(words), np.int64)
    np.cumsum(np.fromiter(map(len, words[:-1]), np.int64, len(words) - 1) + 1, out=starts[1:])
    ends = np.append(starts[shingle:] - 1, len(joined)).tolist()
    one = xxhash.xxh64_digest
    hashes = b"".join([one(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    more = 2 * np.add.reduce(bits, axis=0, dtype=np.uint32) > len(bits)
    return int.from_bytes(np.packbits(more).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = np.array([fingerprint(t, shingle) for t in f.text], np.uint64)
            yield pd.DataFrame({"doc_id": f.doc_id, "fp": fp.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Plan:
    parts: tuple[tuple[int, ...], ...]  # bit positions, 0 the lowest
    thresholds: tuple[int, ...]  # -1: the part is not probed


def signature(fp: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & ONES) << np.uint64(k)
    return out


def group_bits(corr: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """m parts of nearly equal size; each grows by the free bit most correlated with it."""
    free, parts = set(range(BITS)), []
    for size in [BITS // m + (i < BITS % m) for i in range(m)]:
        score = np.abs(corr)
        first = max(free, key=lambda b: (score[b, sorted(free)].sum(), -b))
        part = [first]
        free.remove(first)
        while len(part) < size:
            best = max(free, key=lambda b: (score[b, part].sum(), -b))
            part.append(best)
            free.remove(best)
        parts.append(tuple(part))
    return tuple(parts)


def allot(costs: list[list[float]], distance: int) -> tuple[float, tuple[int, ...]]:
    """costs[i][t + 1]: cost of threshold t for part i. The cheapest thresholds with sum(t + 1) = distance + 1."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for own in costs:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (cost, ts) in best.items():
            for t1, c in enumerate(own):
                if used + t1 <= distance + 1 and ((total := cost + c), ts) < step.get(used + t1, (math.inf, ())):
                    step[used + t1] = (total, (*ts, t1 - 1))
        best = step
    return best[distance + 1]


def make_plan(corr: np.ndarray, sample: np.ndarray, n: int, distance: int = DISTANCE) -> Plan:
    """n: all distinct fingerprints; sample: some of them, as unsigned integers."""
    found = []
    for m in range(1 if distance == 0 else 2, distance + 2):
        parts = group_bits(corr, m)
        costs = []
        for bits in parts:
            sig = signature(sample, bits)
            apart = np.bitwise_count(sig[:, None] ^ sig[None, :])
            pairs = max(len(sample) * (len(sample) - 1), 1)
            own = [0.0]
            for t in range(distance + 1):
                share = max((apart <= t).sum() - len(sample), 0) / pairs
                ball = sum(math.comb(len(bits), k) for k in range(t + 1))
                share = max(share, ball / 2.0 ** len(bits))
                own.append(n * ball * PROBE_S + n * n * share * PAIR_S)
            costs.append(own)
        cost, ts = allot(costs, distance)
        found.append((cost, m, parts, ts))
    _, _, parts, ts = min(found)
    return Plan(parts, ts)


def linked_roots(fp: np.ndarray, distance: int, deep: bool = True) -> np.ndarray:
    """For every member of a bucket (distinct fingerprints), the index of a member it is linked to, directly or not."""
    n = len(fp)
    if n > LARGE and deep:  # within the distance, at least one of distance + 1 runs of bits is equal
        a, b = [], []
        cuts = np.linspace(0, BITS, distance + 2).astype(int)
        for lo, hi in itertools.pairwise(cuts):
            key = (fp >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1)
            order = np.argsort(key, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if len(own) > 1:
                    root = linked_roots(fp[own], distance, deep=False)
                    a.append(own)
                    b.append(own[root])
        return local_roots(n, np.concatenate([np.zeros(0, int), *a]), np.concatenate([np.zeros(0, int), *b]))
    root = np.arange(n)
    for at in range(0, n, LARGE):
        rows = fp[at : at + LARGE]
        for to in range(0, at + LARGE, LARGE):
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ fp[None, to : to + LARGE]) <= distance)
            more = j + to < i + at
            root = local_roots(n, np.concatenate([np.arange(n), i[more] + at]), np.concatenate([root, j[more] + to]))
    return root


def probe(nodes: DataFrame, plan: Plan) -> DataFrame:
    """part, sig, fp: every fingerprint under its own signature and its variants within the part's threshold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f.fp.to_numpy(np.int64).view(np.uint64)
            for part, (bits, t) in enumerate(zip(plan.parts, plan.thresholds)):
                if t < 0:
                    continue
                sig = signature(fp, bits)
                for k in range(t + 1):
                    for flips in itertools.combinations(range(len(bits)), k):
                        turned = sig ^ np.uint64(sum(1 << b for b in flips))
                        yield pd.DataFrame({"part": np.full(len(fp), part, np.int32), "sig": turned.view(np.int64), "fp": fp.view(np.int64)})

    return nodes.select("fp").mapInPandas(run, "part int, sig long, fp long")


def forest(distance: int):
    """Rows sorted by part and sig -> links u, v of a spanning forest of the verified pairs met in a bucket."""

    def links(sig: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        edge = np.flatnonzero(np.append(True, np.any(sig[1:] != sig[:-1], axis=1)))
        size = np.diff(np.append(edge, len(fp)))
        start = np.repeat(edge, size)
        left = np.repeat(size, size) - (np.arange(len(fp)) - start)  # members from here to the bucket's end
        small = np.repeat(size, size) <= 64
        a, b = [], []
        for k in range(1, min(64, int(size.max(initial=1)))):
            i = np.flatnonzero(small & (left > k))
            i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= distance]
            a.append(i)
            b.append(i + k)
        for at, n in zip(edge[size > 64].tolist(), size[size > 64].tolist()):
            own = np.arange(at, at + n)
            names, first = np.unique(fp[own], return_index=True)
            a.append(own[first])
            b.append(own[first][linked_roots(names, distance)])
        if not a:
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        names, at = np.unique(fp, return_inverse=True)
        root = local_roots(len(names), at[np.concatenate(a)], at[np.concatenate(b)])
        moved = root != np.arange(len(names))
        return pd.DataFrame({"u": names[moved].view(np.int64), "v": names[root[moved]].view(np.int64)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the frames of a bucket that may go on
        for f in frames:
            if not len(f):
                continue
            held.append(f)
            if held[0].part.iat[0] == f.part.iat[-1] and held[0].sig.iat[0] == f.sig.iat[-1]:
                continue
            f = pd.concat(held) if len(held) > 1 else f
            sig, fp = f[["part", "sig"]].to_numpy(np.int64), f.fp.to_numpy(np.int64).view(np.uint64)
            cut = int(np.flatnonzero(np.any(sig != sig[-1], axis=1))[-1]) + 1
            yield links(sig[:cut], fp[:cut])
            held = [f.iloc[cut:]]
        if held:
            f = pd.concat(held)
            yield links(f[["part", "sig"]].to_numpy(np.int64), f.fp.to_numpy(np.int64).view(np.uint64))

    return run


def bit_correlation(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """Correlations of the 64 bits over all distinct fingerprints, and their number."""

    def gram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for f in frames:
            bits = np.unpackbits(f.fp.to_numpy("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total, n = total + bits.T @ bits, n + len(bits)
        if n:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel(), "n": n})

    rows = nodes.select("fp").mapInPandas(gram, "i int, j int, v double, n long").groupBy("i", "j").agg(F.sum("v"), F.sum("n")).collect()  # 64 x 64
    both, n = np.zeros((BITS, BITS)), 0
    for i, j, v, n in rows:
        both[i, j] = v
    mean = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return cov / np.outer(sd, sd), n


def near_duplicates(docs: DataFrame, *, distance: int = DISTANCE, shingle: int = SHINGLE, sample: int = SAMPLE, plan: Plan | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text)."""
    prints = _io.stored(fingerprints(docs, shingle), "fingerprints")
    nodes = _io.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    if plan is None:
        corr, n = bit_correlation(nodes)
        some = [r[0] for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()]
        plan = make_plan(corr, np.array(some, np.int64).view(np.uint64), n, distance)
    probes = probe(nodes, plan).repartition(_io.parts(docs.sparkSession), "part", "sig").sortWithinPartitions("part", "sig")
    roots = components(probes.mapInPandas(forest(distance), "u long, v long")).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = _io.stored(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The row with the smallest doc_id of each group; rows without a doc_id are kept."""
    rows, key = _io.named(docs.where("doc_id IS NOT NULL"))
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("_key"), "component_id")
    found = found.join(rows.select(F.col(key).alias("_key"), F.col("doc_id").alias("_id")), "_key")
    kept = found.groupBy("component_id").agg(F.min(F.struct("_id", "_key"))["_key"].alias("_key"))
    return rows.join(kept, rows[key] == kept["_key"], "left_semi").select(docs.columns).unionAll(docs.where("doc_id IS NULL"))


def op6_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_io.table(spark, sf_dir, "documents"))
