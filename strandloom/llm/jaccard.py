"""Near-duplicates by Jaccard similarity of five-word shingles, exactly: every pair at SIMILARITY or more is found.

1. A text becomes the sorted set of its shingles' 64-bit hashes; equal sets are one node.
2. Prefix filter: two sets at similarity s or more share a member among the first n - ceil(s n) + 1 of each, in any one
   order of all shingles. The order puts shingles common in a sample last, so common passages seldom meet; the sample
   decides cost, never results. Of the nodes of a shingle, only those of sizes at SIMILARITY or more can be pairs: sorted by
   size, they fall into runs, and shingles with the same run of nodes make one bucket.
3. In each bucket bitmaps of the sets are compared (2 to 4 bits a shingle, each set's shingles marked by the low bits of
   their hashes): every bit that only one set has is a shingle that the other lacks, which bounds the overlap. A node
   without a partner under that bound leaves the bucket, before any whole set moves.
4. Each node first meets one of its buckets, with whole sets. Of the others, those whose nodes are all linked by then
   have nothing to add. In the rest the bitmaps are compared again, now only between nodes not linked; who has no possible
   partner left leaves, buckets left with the same nodes become one, and every node is compared with all not yet linked to it.

A bucket of more than SPLIT nodes is dealt out: in step 4 first into parts that share the bucket's smallest node, which
links a group of copies by way of it; where that leaves more than one group, every pair of parts meets in a task.

Defined cases: words are lower-cased (ASCII) and split at ASCII white space; fewer than five words make one shingle;
texts without words (null, empty) are copies of each other; an empty table gives none.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import _io
from strandloom.llm.components import components

SHINGLE, TENTHS, SEED = 5, 8, 42  # TENTHS: the similarity in tenths
SAMPLE, COMMON = 20_000, 200_000  # nodes looked at, and common shingles held, for the order
SPLIT = 4096  # nodes of a bucket in one place
WAVE_BYTES = 128 << 20  # of sets sent to buckets at once, or as many as all sets have once


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    n = max(len(words) - SHINGLE + 1, 1)
    ends = (starts[min(SHINGLE, len(words)) :] - 1)[:n].tolist()
    one = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([one(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends)]), ">u8").astype(np.uint64))


def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int | None, int, np.ndarray, bool]]:
    """key, node (hash of the set), set, and whether the node is new to this task, for rows of (key, text)."""
    seen: set[int] = set()
    for f in frames:
        for k, t in zip(f["key"], f.text):
            own = shingles(t)
            node = int(np.array(xxhash.xxh3_64_intdigest(own.tobytes()), np.uint64).view(np.int64))
            yield k, node, own, node not in seen
            seen.add(node)


def batches(rows: Iterator[tuple], names: list[str], n: int = 1000) -> Iterator[pd.DataFrame]:
    while out := list(itertools.islice(rows, n)):
        yield pd.DataFrame(out, columns=names)


def common_shingles(texts: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that more than one text of a sample has, and in how many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            held = Counter()
            for _, _, own, new in hashed(iter([f])):
                if new:
                    held.update(own.view(np.int64).tolist())
            yield pd.DataFrame({"h": np.fromiter(held.keys(), np.int64, len(held)), "n": np.fromiter(held.values(), np.int64, len(held))})

    n = texts.count()
    some = texts if n <= sample else texts.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < max(1, (sample << 20) // n))
    rows = some.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    h, count = rows.h.to_numpy(np.int64).view(np.uint64), rows.n.to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], count[order]


def bitmap(h: np.ndarray) -> np.ndarray:
    """Bytes of a power of two of bits, at least twice the shingles; the bit of each is set."""
    bits = max(64, 1 << (2 * len(h) - 1).bit_length()) if len(h) else 64
    held = np.zeros(bits, bool)
    held[(h & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(held)


def prefixes(texts: DataFrame, common: np.ndarray, count: np.ndarray) -> DataFrame:
    """key, node, and (null where the task had the node before) first: the first shingles of the node, bits: the bitmap of all, n: how many shingles it has."""

    def cut(h: np.ndarray) -> tuple:
        most, first = len(h) + (-TENTHS * len(h) // 10) + 1 if len(h) else 0, h  # n - ceil(s n) + 1
        if len(common) and len(h):
            at = np.minimum(np.searchsorted(common, h), len(common) - 1)
            first = h[np.argsort(np.where(common[at] == h, count[at], 0), kind="stable")]
        return first[:most].tobytes(), bitmap(h).tobytes(), len(h)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from batches(((k, node, *(cut(own) if new else [None] * 3)) for k, node, own, new in hashed(frames)), ["key", "node", "first", "bits", "n"])

    return texts.mapInPandas(run, "key long, node long, first binary, bits binary, n int")


def probes(rows: DataFrame) -> DataFrame:
    """shingle, n, node for the first shingles of each node."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                first = [np.frombuffer(r, "<i8") for r in f["first"]]
                many = [len(x) for x in first]
                yield pd.DataFrame({"shingle": np.concatenate(first), "n": np.repeat(f.n.to_numpy(np.int32), many), "node": np.repeat(f.node.to_numpy(np.int64), many)})

    return rows.where("first IS NOT NULL").select("node", "first", "n").mapInPandas(run, "shingle long, n int, node long")


def sets(texts: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, hashes (the whole set), bits, n of each wanted node, from one of its texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from batches(((node, own.astype("<u8").tobytes(), bitmap(own).tobytes(), len(own)) for _, node, own, _ in hashed(frames)), ["node", "hashes", "bits", "n"], 200)

    keys = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")).select("key")
    return texts.join(keys, "key", "left_semi").mapInPandas(run, "node long, hashes binary, bits binary, n int")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def whole_groups(frames: Iterator[pd.DataFrame], by: str) -> Iterator[pd.DataFrame]:
    """Frames sorted by a column, cut so that none ends inside a group."""
    held: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        held.append(f)
        if held[0][by].iat[0] == f[by].iat[-1]:
            continue
        f = pd.concat(held) if len(held) > 1 else f
        cut = int(np.flatnonzero((f[by] != f[by].iat[-1]).to_numpy())[-1]) + 1
        yield f.iloc[:cut]
        held = [f.iloc[cut:]]
    if held:
        yield pd.concat(held)


def same_nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shingle, n and node -> bucket, node, of runs of several nodes whose sizes, one after the other, allow SIMILARITY; equal runs have the same bucket."""
    for f in whole_groups(frames, "shingle"):
        s, n, node = f.shingle.to_numpy(np.int64), f.n.to_numpy(np.int64), f.node.to_numpy(np.int64)
        new = np.append(True, (s[1:] != s[:-1]) | (node[1:] != node[:-1]))
        s, n, node = s[new], n[new], node[new]
        edge = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (10 * n[:-1] < TENTHS * n[1:])))
        size = np.diff(np.append(edge, len(s)))
        bucket = np.repeat(np.add.reduceat(mixed(node.view(np.uint64)), edge), size)
        more = np.repeat(size, size) > 1
        yield pd.DataFrame({"bucket": bucket[more].view(np.int64), "node": node[more]}).drop_duplicates()


def groups(f: pd.DataFrame, by: str) -> Iterator[tuple[int, int]]:
    b = f[by].to_numpy()
    edge = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    return zip(edge.tolist(), np.append(edge[1:], len(b)).tolist())


def partners(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """unit, bucket, node, root, bits, n sorted by unit -> bucket, node, root of the nodes that may have a partner of another root in a unit."""
    for f in whole_groups(frames, "unit"):
        n, root = f.n.to_numpy(np.int64), f.root.to_numpy(np.int64)
        keep = np.zeros(len(f), bool)
        for lo, hi in groups(f, "unit"):
            keep[lo:hi] = may_link([np.frombuffer(r, np.uint64) for r in f.bits.iloc[lo:hi]], n[lo:hi], root[lo:hi])
        yield f.loc[keep, ["bucket", "node", "root"]]


def halved(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (one a row) of half as many bits for the same sets."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


def may_link(bits: list[np.ndarray], n: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which of the sets have one of another root with which SIMILARITY is possible. Sizes that allow it differ by less than two, so their bitmaps by one doubling at most."""
    found, long = np.zeros(len(bits), bool), np.array([len(x) for x in bits])
    levels = {m: np.flatnonzero(long == m) for m in np.unique(long).tolist()}
    held = {m: np.stack([bits[i] for i in at]) for m, at in levels.items()}
    for m in levels:
        pairs = [(levels[m], held[m], levels[m], held[m])]
        if 2 * m in levels:
            pairs.append((levels[m], held[m], levels[2 * m], halved(held[2 * m])))
        for at, own, others, theirs in pairs:
            many, much = np.bitwise_count(own).sum(1, dtype=np.int64), np.bitwise_count(theirs).sum(1, dtype=np.int64)
            for k, i in enumerate(at.tolist()):
                if found[i] and found[others].all():
                    continue
                size = n[others]
                live = np.flatnonzero((10 * np.minimum(size, n[i]) >= TENTHS * np.maximum(size, n[i])) & (root[others] != root[i]) & ~(found[others] & found[i]))
                both = np.bitwise_count(theirs[live] & own[k]).sum(1, dtype=np.int64)
                most = np.minimum(n[i] - (many[k] - both), size[live] - (much[live] - both))
                near = others[live[(10 + TENTHS) * most >= TENTHS * (size[live] + n[i])]]
                if len(near):
                    found[near] = found[i] = True
    return found


def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """unit, node, root, hashes sorted by unit -> links u, v between nodes at SIMILARITY or more, a spanning forest of each unit."""
    for f in whole_groups(frames, "unit"):
        u, v = [], []
        for lo, hi in groups(f, "unit"):
            own = [np.frombuffer(r, "<u8") for r in f.hashes.iloc[lo:hi]]
            names, root = f.node.to_numpy()[lo:hi], f.root.to_numpy()[lo:hi]
            for i, j in forest(own, root):
                u.append(names[i])
                v.append(names[j])
        yield pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def forest(own: list[np.ndarray], root: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs at SIMILARITY or more that link what is linked; nodes of one root count as linked."""
    n = np.array([len(x) for x in own])
    flat, at = np.concatenate(own), np.repeat(np.arange(len(own)), n)
    left = np.ones(len(own), bool)
    while left.any():
        first = int(np.flatnonzero(left)[0])
        todo = np.flatnonzero(left & (root == root[first])).tolist()
        left[todo] = False
        while todo and left.any():
            i = todo.pop()
            a = own[i]
            live = left & (10 * np.minimum(n, n[i]) >= TENTHS * np.maximum(n, n[i]))
            if not live.any():
                continue
            which = live[at]
            x, owner = flat[which], at[which]
            both = np.bincount(owner[a[np.minimum(np.searchsorted(a, x), len(a) - 1)] == x], minlength=len(own))
            near = np.flatnonzero(live & (10 * both >= TENTHS * (n + n[i] - both)))
            for j in near.tolist():
                yield i, j
            new = np.flatnonzero(left & np.isin(root, root[near])).tolist()
            left[new] = False
            todo += new


def sized(met: DataFrame, split: int) -> DataFrame:
    """bucket, m (its nodes), pivot (the smallest), parts."""
    return met.groupBy("bucket").agg(F.count("*").alias("m"), F.min("node").alias("pivot")).where("m > 1").withColumn("parts", F.ceil(F.col("m") / split))


def dealt(met: DataFrame, size: DataFrame) -> DataFrame:
    """met (bucket, node, any others) with unit: small buckets whole, and every pair of the parts of a large one."""
    both = met.join(size.select("bucket", "parts"), "bucket").withColumn("_p", F.pmod(F.xxhash64("node"), F.col("parts")))
    both = both.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return both.withColumn("unit", F.xxhash64("bucket", F.least("_p", "_q"), F.greatest("_p", "_q"))).drop("_p", "_q", "parts").distinct()


def around_pivots(met: DataFrame, size: DataFrame) -> DataFrame:
    """unit, node: the parts of each bucket, each with the bucket's pivot."""
    part = lambda p: F.xxhash64("bucket", p)
    own = met.join(size, "bucket").where("node <> pivot OR parts = 1").select(part(F.pmod(F.xxhash64("node"), F.col("parts"))).alias("unit"), "node")
    return own.unionAll(size.where("parts > 1").select("bucket", "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p")).select(part(F.col("p")).alias("unit"), F.col("pivot").alias("node")))


def possible(met: DataFrame, size: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Of met (bucket, node, root) those that may have a partner of another root in their bucket; sets: node, bits, n."""
    units = dealt(met, size).join(sets, "node").select("unit", "bucket", "node", "root", "bits", "n")
    return units.repartition(parts, "unit").sortWithinPartitions("unit").mapInPandas(partners, "bucket long, node long, root long").distinct()


def merged(met: DataFrame) -> DataFrame:
    """met (bucket, node, any others) with one bucket for all that hold the same nodes."""
    same = met.groupBy("bucket").agg(F.xxhash64(F.bit_xor(F.xxhash64("node")), F.count("*")).alias("_same"))
    return met.join(same, "bucket").withColumn("bucket", F.col("_same")).drop("_same").distinct()


def linked(units: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    both = units.join(nodes.select("node", "hashes"), "node").select("unit", "node", "root", "hashes")
    return both.repartition(parts, "unit").sortWithinPartitions("unit").mapInPandas(links, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", *, sample: int = SAMPLE, wave_bytes: int = WAVE_BYTES, split: int = SPLIT) -> DataFrame:
    """key, root for every row of docs (key, text): rows of the same root are copies, or linked by near copies."""
    spark, parts = docs.sparkSession, _io.parts(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    with _io.small_batches(spark):
        rows = _io.stored(prefixes(texts, *common_shingles(texts, sample)), "shingle-prefixes", "uncompressed")
        met = probes(rows).repartition(parts, "shingle").sortWithinPartitions("shingle", "n", "node")
        met = _io.stored(met.mapInPandas(same_nodes, "bucket long, node long").distinct(), "shingle-buckets")
        # one row a node: the same set may be new to several tasks
        one = rows.where("first IS NOT NULL").groupBy("node").agg(F.first(F.struct("bits", "n")).alias("x")).select("node", "x.*")
        may = _io.stored(possible(met.withColumn("root", F.col("node")), sized(met, split), one, parts).select("bucket", "node"), "possible-partners")
        _io.drop(met)
        met = _io.stored(merged(may), "merged-buckets")
        nodes = _io.stored(sets(texts, rows, met.select("node").distinct()), "shingle-nodes")
    size = _io.stored(sized(met, split), "bucket-sizes")
    one = met.join(size, "bucket").groupBy("node").agg(F.max(F.struct("m", "bucket"))["bucket"].alias("bucket"))
    one = _io.stored(one.select("bucket", "node"), "first-buckets")
    with _io.small_batches(spark):
        first = _io.stored(linked(around_pivots(one, sized(one, split)).withColumn("root", F.col("node")), nodes, parts), "first-links")
    roots = components(first)
    now = _io.stored(met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "bucket-roots")
    open_ = now.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket")
    with _io.small_batches(spark):
        may = _io.stored(possible(now.join(open_, "bucket"), size, nodes.select("node", "bits", "n"), parts), "open-partners")
    met = merged(may)
    rest = _io.stored(dealt(met, sized(met, split)), "open-buckets")
    moved = 8 * (rest.join(nodes.select("node", "n"), "node").agg(F.sum("n")).first()[0] or 0)
    held = 8 * (nodes.agg(F.sum("n")).first()[0] or 0)
    waves, found = -(-moved // max(wave_bytes, held)), first
    for i in range(waves):  # only so many bytes of sets are on their way at once
        own = rest.where(F.pmod(F.xxhash64("unit"), F.lit(waves)) == i)
        with _io.small_batches(spark):
            found = found.unionAll(_io.stored(linked(own, nodes, parts), "more-links"))
    roots = components(found)
    return rows.select("key", "node").join(roots, "node", "left").select(F.col("key").alias(key), F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of rows: that with the smallest doc_id; a row without one stays only if none of its group has one."""
    docs, key = _io.named(docs)
    rows = docs.select(F.col(key).cast("long").alias("key"), "text", F.col("doc_id").alias("id"))
    found = near_duplicates(rows, "key", **options)
    if key != "doc_id":
        found = found.join(rows.select("key", "id"), "key")
    else:
        found = found.withColumn("id", F.col("key"))
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("key")))["key"].alias("key")).select("key")
    return docs.join(kept, docs[key] == kept["key"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns if c != key or key == "doc_id"])
