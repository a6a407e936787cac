"""Exact Jaccard join on word n-grams: prefix filtering, rarest n-grams first, with length, positional and suffix filters.

A text becomes the set of its n-grams' 64-bit hashes; equal sets are one node from there on (64 bits of a hash name it).
1. Order: n-grams are counted over all rows in a table of CELLS counters of fixed size (one n-gram, one counter), and
   sorted by (counter, hash), rarest first. Any order that is the same for all sets is right; this one is cheap.
2. Prefix: two sets at similarity t or more share one of the first n - ceil(t n) + 1 n-grams of each. Nodes meet in a join
   on these n-grams (probes). A pair stays if the sizes allow t (length filter), and if at its first common n-gram the
   rest of both is long enough (positional filter).
3. Suffix filter: each set is cut into parts by the low bits of its hashes; the differences of the parts' sizes add up to
   at most the number of n-grams that only one set has. What is left is verified once, on whole sets.
4. Hubs first: of the nodes that share an n-gram, the one with the fewest rarer n-grams before it (an original has none of
   its copies' edits) meets all others: pairs in proportion to rows. Nodes linked by then need no link again, so only
   nodes of different components still meet, without the hub, in units of at most 2 BLOCK nodes.
A family of near copies is so linked by way of its hub and never expanded into all pairs, and no link between different components is lost.

Defined cases: A-Z is lower-cased, words end at ASCII white space; a text of fewer words than n is one n-gram as a
whole; a text without words (null, empty) has no n-gram and no link, not even to its copies; a null doc_id takes part,
but component_id is the smallest doc_id that is not null, or null; rows with the same doc_id are rows of their own; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm import _io
from strandloom.llm.components import components

WORDS, PERCENT = 3, 90
CELLS, SLICE = 1 << 16, 1 << 10  # counters of the order; counters in a row
BLOCK = 512  # nodes of a shared n-gram that meet the same number of others in one unit
BROADCAST = 1 << 20  # keys of texts that are sent to all tasks: 8 MB
ROWS = 500  # texts turned into sets at a time


class WordHashes(dict):
    """The hash of each word, kept for the words last met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngram_set(text: str | None, n: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))] if words else [], np.uint64)
    each = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    total, many = np.zeros(len(words) - n + 1, np.uint64), len(words) - n + 1
    for i in range(n):  # the i-th word has an odd factor of its own
        total += each[i : i + many] * np.uint64(xxhash.xxh3_64_intdigest(b"%d" % i) | 1)
    return np.unique(mixed(total))


def named_set(own: np.ndarray) -> int | None:
    return int(np.array(xxhash.xxh3_64_intdigest(own.tobytes()), np.uint64).view(np.int64)) if len(own) else None


def counted(texts: DataFrame, n: int) -> DataFrame:
    """key, node, n for each text; and after each task's rows the counters of their n-grams in rows of (slice, counts)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, counts = WordHashes(), np.zeros(CELLS, np.int64)
        for f in frames:
            for part in _io.slices(iter([f]), ROWS):
                sets = [ngram_set(t, n, memo) for t in part.text]
                counts += np.bincount((np.concatenate(sets) >> np.uint64(48)).astype(np.int64), minlength=CELLS)
                nodes = pd.array([named_set(s) for s in sets], "Int64")
                yield pd.DataFrame({"key": part["key"].astype("Int64"), "node": nodes, "n": [len(s) for s in sets], "slice": pd.array([None] * len(sets), "Int32"), "counts": None})
        rows = counts.reshape(-1, SLICE)
        used = np.flatnonzero(rows.any(1))
        yield pd.DataFrame({"key": pd.array([None] * len(used), "Int64"), "node": pd.array([None] * len(used), "Int64"), "n": 0, "slice": pd.array(used, "Int32"), "counts": [rows[i].astype("<i8").tobytes() for i in used]})

    return texts.mapInPandas(run, "key long, node long, n int, slice int, counts binary")


def order_of(rows: DataFrame) -> np.ndarray:
    """The counters, summed over all tasks: CELLS numbers, whatever the size of the corpus."""

    def add(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [key[0]], "counts": [sum(np.frombuffer(c, "<i8") for c in f.counts).tobytes()]})

    parts = rows.where("slice IS NOT NULL").withColumn("some", F.spark_partition_id() % 16).groupBy("slice", "some").applyInPandas(lambda k, f: add(k, f), "slice int, counts binary")
    out = np.zeros((CELLS // SLICE, SLICE), np.int64)
    for r in parts.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():
        out[r.slice] = np.frombuffer(r.counts, "<i8")
    return out.reshape(-1)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def part_sizes(own: np.ndarray) -> bytes:
    """How many n-grams fall in each of a power of two of parts: two to four in one on average, and 64 parts or more."""
    parts = max(64, 1 << max(len(own) // 2, 1).bit_length() - 1)
    return np.minimum(np.bincount((own & np.uint64(parts - 1)).astype(np.int64), minlength=parts), 255).astype(np.uint8).tobytes()


def probed(texts: DataFrame, n: int, order: np.ndarray, percent: int) -> DataFrame:
    """node, n, prefix (the rarest n-grams), parts (part_sizes), once or more for each set that some text has."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, seen = WordHashes(), set()
        for f in frames:
            for part in _io.slices(iter([f]), ROWS):
                out = []
                for t in part.text:
                    own = ngram_set(t, n, memo)
                    node = named_set(own)
                    if node is None or node in seen:
                        continue
                    if len(seen) >= 1 << 16:  # a set told again is only told again
                        seen.clear()
                    seen.add(node)
                    most, count = prefix_size(len(own), percent), order[(own >> np.uint64(48)).astype(np.int64)]
                    if most < len(own):
                        near = np.argpartition(count, most - 1)
                        at = np.flatnonzero(count <= count[near[most - 1]])
                        at = at[np.lexsort((own[at], count[at]))][:most]
                    else:
                        at = np.lexsort((own, count))
                    out.append((node, len(own), own[at].astype("<u8").tobytes(), part_sizes(own)))
                yield pd.DataFrame(out, columns=["node", "n", "prefix", "parts"])

    return texts.mapInPandas(run, "node long, n int, prefix binary, parts binary")


def probes(rows: DataFrame) -> DataFrame:
    """gram, node, n, pos (from 0) for each n-gram of each prefix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part in _io.slices(iter([f]), ROWS):
                grams = [np.frombuffer(p, "<i8") for p in part.prefix]
                many = [len(g) for g in grams]
                yield pd.DataFrame({"gram": np.concatenate(grams), "node": np.repeat(part.node.to_numpy(), many), "n": np.repeat(part.n.to_numpy(), many), "pos": np.concatenate([np.arange(m) for m in many])})

    return rows.select("node", "n", "prefix").mapInPandas(run, "gram long, node long, n int, pos int")


def passes(a: str, b: str, percent: int) -> Column:
    """Length and positional filter for the columns (n, pos) of two sides that share an n-gram."""
    n1, n2, p1, p2 = F.col(f"{a}n"), F.col(f"{b}n"), F.col(f"{a}pos"), F.col(f"{b}pos")
    rest = F.lit(1) + F.least(n1 - p1 - 1, n2 - p2 - 1)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * rest >= percent * (n1 + n2))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most as many n-grams as only one of two sets has, from the part_sizes of both, row by row."""
    a, b = a.astype(np.int32), b.astype(np.int32)
    while a.shape[-1] != b.shape[-1]:
        if a.shape[-1] < b.shape[-1]:
            a, b = b, a
        half = a.shape[-1] // 2
        a = a[..., :half] + a[..., half:]
    return np.abs(a - b).sum(-1)


def allowed(n1, n2, percent: int):
    """How many n-grams at most only one of two sets at the similarity has, for sizes or arrays of them."""
    total = n1 + n2
    return total - 2 * -(-percent * total // (100 + percent))


def suffix_filtered(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v) those that part_sizes allow; rows: node, n, parts, one row a node."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = np.zeros(len(f), bool)
            for i, (n1, n2, a, b) in enumerate(zip(f.n1, f.n2, f.a, f.b)):
                keep[i] = apart(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)) <= allowed(n1, n2, percent)
            yield f.loc[keep, ["u", "v"]]

    one = lambda c, n, s: rows.select(F.col("node").alias(c), F.col("n").alias(n), F.col("parts").alias(s))
    return pairs.join(one("u", "n1", "a"), "u").join(one("v", "n2", "b"), "v").select("u", "v", "n1", "n2", "a", "b").mapInPandas(run, "u long, v long")


def sets_of(texts: DataFrame, rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node, own (the whole set) of each wanted node, from one of its texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for f in frames:
            for part in _io.slices(iter([f]), ROWS):
                sets = [ngram_set(t, n, memo) for t in part.text]
                yield pd.DataFrame({"node": [named_set(s) for s in sets], "own": [s.astype("<u8").tobytes() for s in sets]})

    keys = _io.stored(rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")).select("key"), "set-keys")
    few = keys.count() <= BROADCAST  # else the texts are shuffled
    return texts.join(F.broadcast(keys) if few else keys, "key", "left_semi").mapInPandas(run, "node long, own binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v, both (common n-grams), either (of one or both) of the pairs (u, v) at the similarity or more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            both, either = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for i, (a, b) in enumerate(zip(f.a, f.b)):
                x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                both[i] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
                either[i] = len(x) + len(y) - both[i]
            keep = 100 * both >= percent * either
            yield f[["u", "v"]].assign(both=both, either=either)[keep]

    one = lambda c, s: sets.select(F.col("node").alias(c), F.col("own").alias(s))
    return pairs.join(one("u", "a"), "u").join(one("v", "b"), "v").select("u", "v", "a", "b").mapInPandas(run, "u long, v long, both long, either long")


def met(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Rows (unit, side, two, node, n, pos, root, parts) sorted by unit, n and node -> u, v of a unit that pass all filters, of different roots, and if the unit has two sides, of different sides."""
    for f in whole_units(frames):
        unit, side, two, node, n, pos, root = (f[c].to_numpy() for c in ("unit", "side", "two", "node", "n", "pos", "root"))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        parts = [np.frombuffer(p, np.uint8) for p in f.parts]
        long = np.array([len(p) for p in parts])
        at, stacks = np.zeros(len(f), np.int64), {}
        for m in np.unique(long).tolist():
            own = np.flatnonzero(long == m)
            at[own], stacks[m] = np.arange(len(own)), np.stack([parts[i] for i in own])
        live, k, u, v = np.arange(len(f)), 0, [], []
        while len(live):  # every row and the k-th after it, while that is in its unit and short enough
            k += 1
            live = live[live + k < len(f)]
            live = live[(unit[live + k] == unit[live]) & (percent * n[live + k] <= 100 * n[live])]
            i, j = live, live + k
            rest = 1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1)
            good = (root[i] != root[j]) & ((100 + percent) * rest >= percent * (n[i] + n[j])) & (~two[i] | (side[i] != side[j]))
            i, j = i[good], j[good]
            for x, y in {(a, b) for a, b in zip(long[i].tolist(), long[j].tolist())}:
                own = np.flatnonzero((long[i] == x) & (long[j] == y))
                own = own[apart(stacks[x][at[i[own]]], stacks[y][at[j[own]]]) <= allowed(n[i[own]], n[j[own]], percent)]
                u.append(np.minimum(node[i[own]], node[j[own]]))
                v.append(np.maximum(node[i[own]], node[j[own]]))
        none = np.zeros(0, np.int64)
        yield pd.DataFrame({"u": np.concatenate([none, *u]), "v": np.concatenate([none, *v])})


def whole_units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames sorted by unit, cut so that none ends inside a unit."""
    held: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        held.append(f)
        if held[0].unit.iat[0] == f.unit.iat[-1]:
            continue
        f = pd.concat(held)
        cut = int(np.flatnonzero((f.unit != f.unit.iat[-1]).to_numpy())[-1]) + 1
        yield f.iloc[:cut]
        held = [f.iloc[cut:]]
    if held:
        yield pd.concat(held)


def near_links(texts: DataFrame, *, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For texts (key, unique; text): rows (key, node, n), verified links (u, v, both, either) between nodes that connect all
    that links connect, and roots (node, root) of nodes with a link."""
    spark, tasks = texts.sparkSession, _io.parts(texts.sparkSession)
    both = _io.stored(counted(texts, words), "ngram-counts")
    order, rows = order_of(both), both.where("slice IS NULL").select("key", "node", "n")
    own = _io.stored(probed(texts, words, order, percent), "ngram-prefixes", "uncompressed")
    # one shuffle: the hub of each n-gram, and whether the next smaller or larger node is of a size for a link
    gram, by_size = Window.partitionBy("gram"), Window.partitionBy("gram").orderBy("n", "node")
    each = probes(own).select("*", F.lag("n").over(by_size).alias("below"), F.lead("n").over(by_size).alias("above"))
    each = each.select("*", F.min(F.struct("pos", "n", "node")).over(gram).alias("hub"), F.max("node").over(gram).alias("hi"), F.min("node").over(gram).alias("lo"))
    near = F.coalesce(100 * F.col("below") >= percent * F.col("n"), F.lit(False)) | F.coalesce(100 * F.col("n") >= percent * F.col("above"), F.lit(False))
    each = each.where((F.col("lo") != F.col("hi")) & (F.col("node") != F.col("hub.node")) & near)
    shared = each.select("gram", "node", "n", "pos", F.col("hub.node").alias("hub_node"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos"))
    shared = _io.stored(shared, "shared-ngrams")
    star = shared.where(passes("", "hub_", percent)).select(F.least("node", "hub_node").alias("u"), F.greatest("node", "hub_node").alias("v")).distinct()
    star = _io.stored(star, "hub-pairs")

    def once(pairs: DataFrame) -> DataFrame:
        """node, n, parts of the nodes of some pairs, a row each."""
        ends = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()
        return own.join(ends, "node", "left_semi").groupBy("node").agg(F.first(F.struct("n", "parts")).alias("x")).select("node", "x.*")

    def ends_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()

    star = _io.stored(suffix_filtered(star, once(star), percent), "filtered-pairs")
    sets = _io.stored(sets_of(texts, rows, ends_of(star), words), "ngram-sets")
    first = _io.stored(verified(star, sets, percent), "hub-links")
    roots = components(first.select("u", "v"))
    # nodes without their hub, in n-grams where different components are left
    now = shared.select("gram", "node", "n", "pos").distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    now = _io.stored(now, "open-probes")
    size = now.groupBy("gram").agg(F.count("*").alias("m"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    open_ = now.join(size.select("gram", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "gram")
    open_ = open_.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.withColumn("unit", F.xxhash64("gram", F.least("side", "other"), F.greatest("side", "other")))
    nodes = own.join(open_.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("parts").alias("parts"))
    open_ = open_.select("unit", "side", (F.col("side") != F.col("other")).alias("two"), "node", "n", "pos", "root")
    units = open_.join(nodes, "node").repartition(tasks, "unit").sortWithinPartitions("unit", "n", "node")
    rest = _io.stored(units.mapInPandas(lambda frames: met(frames, percent), "u long, v long").distinct(), "cross-pairs").join(star, ["u", "v"], "left_anti")
    more = ends_of(rest).join(sets.select("node"), "node", "left_anti")
    sets = sets.unionAll(_io.stored(sets_of(texts, rows, more, words), "more-sets"))
    links = first.unionAll(_io.stored(verified(rest, sets, percent), "cross-links"))
    return rows, links, components(links.select("u", "v"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    docs, key = _io.named(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    texts = docs.select(F.col(key).alias("key"), "text")
    rows, _, roots = near_links(texts, **options)
    found = rows.join(roots, "node", "left").select("key", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "node").alias("root"))
    if key == "doc_id":
        found = found.withColumn("doc_id", F.col("key"))
    else:
        found = found.join(docs.select(F.col(key).alias("key"), "doc_id"), "key")
    found = _io.stored(found, "ngram-groups")
    least = found.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")).where("m > 1").drop("m")
    out = found.join(least, "root", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_io.table(spark, sf_dir, "documents"))
