"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

Pieces of one length are interchangeable, so the whole corpus is packed by one exact best-fit-decreasing run over
its length histogram (at most `capacity` rows, whatever the corpus), in which a segment tree over remaining
capacities finds the tightest open bin. Runs of equal bins move as one group, and the resulting placements say for
the k-th piece of a length which bin and offset it gets; every piece then looks up its own place. So packing is
global, not by partition, and nothing that grows with the corpus reaches the driver.

Defined cases: null text is empty; every document gets the end id, so an empty one is a piece of one token; a
document longer than the capacity is cut into full pieces, with the shorter rest first; null or repeated doc_ids are
packed like any others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm import _io, tokens

CAPACITY = 2048
SALT_ROWS = 10_000


class CapacityTree:
    """Segment tree over capacities 0..capacity: the smallest non-empty one of at least x, in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.full = [False] * (2 * self.size)

    def set(self, at: int, full: bool) -> None:
        i = at + self.size
        self.full[i] = full
        while i > 1:
            i //= 2
            self.full[i] = self.full[2 * i] or self.full[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.full[i]:
            return least
        while i > 1:  # up to the first right neighbour that holds something, then down its left edge
            if i % 2 == 0 and self.full[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.full[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> tuple[pd.DataFrame, int]:
    """Placements (length, first, many, bin, offset): pieces first .. of a length go to bins from `bin`, `many` to a bin, from `offset` on. Also the number of bins."""
    tree, open_bins, out, bins = CapacityTree(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_bins.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            many = room // length
            used = min(n, left // many)
            if used:
                out.append((length, rank, many, first, capacity - room))
                put(room - many * length, first, used)
                left, rank = left - used * many, rank + used * many
            if used < n and left:  # the last pieces of this length share one bin
                out.append((length, rank, left, first + used, capacity - room))
                put(room - left * length, first + used, 1)
                left, used = 0, used + 1
            put(room, first + used, n - used)
    return pd.DataFrame(out, columns=["length", "first", "many", "bin", "offset"], dtype=np.int64), bins


def cut(docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: str = tokens.BYTE_FILE, tokenizer_path: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> pieces (doc_id, piece, start, length, ids_crc32 and, with_ids, ids)."""

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = tokens.encoder(vocabulary, tokenizer_path), np.array([end_id], "<u4").tobytes()
        for f in frames:
            rows = []
            for doc, x in zip(f.doc_id.astype(object), encode(f.text)):
                x, at, k = x + end, 0, 0
                n = len(x) // 4
                step = n % capacity or capacity
                while at < n:
                    own = x[4 * at : 4 * (at + step)]
                    rows.append((None if pd.isna(doc) else int(doc), k, at, step, zlib.crc32(own)) + ((np.frombuffer(own, "<u4").astype(np.int64),) if with_ids else ()))
                    at, step, k = at + step, capacity, k + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInPandas(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces (length and any identifying columns; doc_id, piece order them)."""
    with _io.small_batches(pieces.sparkSession):
        pieces = _io.stored(pieces, "pieces")  # ranks below need one fixed set of rows
    salts = max(1, -(-pieces.count() // salt_rows))
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = counts.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # a row for each length, capacity at most
    placements, _ = plan(histogram, capacity)
    table = {k: g.drop(columns="length").to_numpy(np.int64) for k, g in placements.groupby("length")}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seq, off = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for length, at in f.groupby("length").indices.items():
                rows, rank = table[length], f._rank.to_numpy()[at]
                first, many, bin_, offset = rows[np.searchsorted(rows[:, 0], rank, "right") - 1].T
                seq[at], off[at] = bin_ + (rank - first) // many, offset + (rank - first) % many * length
            yield f.drop(columns="_rank").assign(sequence_id=seq, offset=off)

    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_row", F.row_number().over(own) - 1).join(before, ["length", "_salt"])
    kept = [c for c in pieces.columns if c != "_salt"]
    ranked = ranked.select(*kept, (F.col("_row") + F.col("_before")).alias("_rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_salt")
    return ranked.mapInPandas(place, schema + ", sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(_io.table(spark, sf_dir, "documents")))
