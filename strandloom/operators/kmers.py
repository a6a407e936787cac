"""K-mers, patterns and symbol positions.

Arrays are exploded with the outer form and a filter after it: for the inner form the optimizer adds a filter on the
array's size below, with the whole expression of the sequence copied into the lambda, to be run for every element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.functions.flat import ends_of, flat, fixed


def window_counts(texts: DataFrame, col: str, k: int) -> DataFrame:
    """word (binary), n: every string of k bytes in a column of texts and how often it occurs. Texts are counted many at a time, so what is grouped is a row for each word of a stretch, not one for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, bounds in flat(b, 0):
                data = np.asarray(data)
                at = np.flatnonzero(np.arange(k, len(data) + k) <= ends_of(bounds))
                if not len(at):
                    continue
                known = np.flatnonzero(np.bincount(data, minlength=256))
                if len(known) ** k < 1 << 62:
                    digit = np.zeros(256, np.int64)
                    digit[known] = np.arange(len(known))
                    code = np.zeros(len(data) - k + 1, np.int64)
                    for i in range(k):
                        code *= len(known)
                        code += digit[data[i : len(data) - k + 1 + i]]
                    code = code[at]
                    if len(known) ** k <= 1 << 22:
                        n = np.bincount(code)
                        code = np.flatnonzero(n)
                        n = n[code]
                    else:
                        code, n = np.unique(code, return_counts=True)
                    words = np.empty((len(code), k), np.uint8)
                    for i in range(k - 1, -1, -1):
                        words[:, i] = known[code % len(known)]
                        code = code // len(known)
                else:
                    wide = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, k)[at])
                    words, n = np.unique(wide, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([fixed(words, pa.binary()), pa.array(n.astype(np.int64))], ["word", "n"])

    counts = texts.select(F.col(col).cast("binary").alias("raw")).mapInArrow(run, "word binary, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def kmer_freq(seqs: DataFrame, k: int = 7, share: float = 1.0) -> DataFrame:
    """kmer, n over the first `share` of each sequence."""
    seq = F.col("seq") if share >= 1 else F.substring(F.col("seq"), F.lit(1), F.floor(F.length("seq") * share).cast("int"))
    return window_counts(seqs.select(seq.alias("seq")), "seq", k).select(F.col("word").cast("string").alias("kmer"), "n")


def with_starts(seqs: DataFrame, pattern: str) -> DataFrame:
    """doc_id, starts: 1-based starts of all matches, overlapping ones too."""
    raw = seqs.select("doc_id", F.col("seq").cast("binary").alias("raw"))
    if not pattern:
        return raw.select("doc_id", S.overlapping_starts(F.col("raw"), pattern).cast("array<bigint>").alias("starts"))
    wanted = pattern.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, bounds in flat(b, 1):
                hit = np.arange(len(wanted), len(data) + len(wanted)) <= ends_of(bounds)
                for i, c in enumerate(wanted):
                    hit[: len(data) - i] &= data[i:] == c
                at = np.flatnonzero(hit)
                first = np.searchsorted(at, bounds)
                starts = pa.array(at + 1 - np.repeat(bounds[:-1], np.diff(first)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), starts)], ["doc_id", "starts"])

    kind = raw.schema["doc_id"].dataType.simpleString()
    return raw.mapInArrow(run, f"doc_id {kind}, starts array<bigint>")


def pattern_positions(seqs: DataFrame, pattern: str) -> DataFrame:
    """1-based starts and lengths of matches of a plain string that do not overlap, from the left."""
    pieces = seqs.select("doc_id", F.posexplode_outer(F.split("seq", "\\Q" + pattern + "\\E")).alias("i", "piece"))
    before = F.sum(F.length("piece")).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return pieces.withColumn("before", before).where("i > 0").select("doc_id", (F.col("before") + (F.col("i") - 1) * len(pattern) + 1).cast("long").alias("start"), F.lit(len(pattern)).alias("len"))


def pattern_overlap(seqs: DataFrame, pattern: str) -> DataFrame:
    return with_starts(seqs, pattern).select("doc_id", F.explode_outer("starts").alias("start")).where("start IS NOT NULL")


def pattern_count(seqs: DataFrame, pattern: str) -> DataFrame:
    return with_starts(seqs, pattern).select("doc_id", F.size("starts").cast("long").alias("n"))


def occ_positions(seqs: DataFrame, symbol: str) -> DataFrame:
    """The n-th occurrence (from 1) of a symbol and its place (from 1)."""
    at = with_starts(seqs, symbol).select("doc_id", F.posexplode_outer("starts").alias("n", "pos")).where("pos IS NOT NULL")
    return at.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "pos")


def alphabet_audit(texts: DataFrame, col: str, allowed: str = "ACGT") -> DataFrame:
    """Symbols outside the alphabet and how often each stands."""
    odd = texts.select(F.regexp_replace(F.upper(col), f"[{allowed}]", "").alias("t"))
    return odd.select(F.explode(F.split("t", "")).alias("symbol")).where("symbol <> ''").groupBy("symbol").agg(F.count("*").alias("n"))


def chunk_overlap(seqs: DataFrame, pieces: int, overlap: int) -> DataFrame:
    """Equal chunks of trunc(size / pieces) and a rest; every chunk but the first starts `overlap` symbols early."""
    size = F.greatest(F.floor(F.length("seq") / pieces), F.lit(1)).cast("int")
    out = seqs.where("seq <> ''").withColumn("size", size)
    out = out.select("doc_id", "seq", "size", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / F.col("size")).cast("int"))).alias("chunk"))
    begin = F.greatest(F.col("chunk") * F.col("size") - overlap, F.lit(0))
    end = F.least((F.col("chunk") + 1) * F.col("size"), F.length("seq"))
    return out.select("doc_id", "chunk", begin.cast("long").alias("offset"), (end - begin).cast("long").alias("size"), F.substring(F.col("seq"), begin + 1, end - begin).alias("content"))


def lead_extents(texts: DataFrame, col: str, header: str) -> DataFrame:
    """For each header symbol: its place (from 1) and the length up to the next one, or to the end."""
    pieces = texts.select("doc_id", F.posexplode_outer(F.transform(F.split(col, "\\Q" + header + "\\E"), lambda x: F.length(x))).alias("i", "n"))
    before = F.sum(F.col("n") + 1).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return pieces.withColumn("pos", before).where("i > 0").select("doc_id", F.col("pos").cast("long").alias("pos"), (F.col("n") + 1).cast("long").alias("len"))
