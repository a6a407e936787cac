"""A quality classifier: gradient-boosted trees over statistics of whole texts.

Statistics of characters, words and lines are computed once for each document, in one pass over Arrow batches; the
trees are flat arrays, walked for a whole batch at a time. The model is fitted on the driver from a bounded sample of
labelled rows (SAMPLE, the smallest by a hash of doc_id): only their statistics reach it. Labels of rows whose
crc32(doc_id as text) is divisible by 5 are never read; lang, source and doc_id are no inputs.

Defined cases: null text is an empty one, and empty texts have a score; labels that are null or not 0 or 1 are left
out, and several for one document count by their mean; without labels, or with one class, every score is the class's
smoothed share; null doc_id: held_out is false; repeated rows are scored each; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import _io, gbt

SAMPLE = 15_000
THRESHOLD = 0.3
BYTES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "marks": b"#*$%&|<>",
    "bang": b"!?",
    "stop": b".,;:",
    "bar": b"|",
    "bracket": b"()[]{}<>",
    "code": b"=_/\\+@~^`",
    "quote": b"\"'",
    "line": b"\n",
    "high": bytes(range(128, 256)),
}
MASKS = np.stack([np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for v in BYTES.values()]).astype(np.float64)
NAMES = (*BYTES, "log_bytes", "log_words", "word_bytes", "unique_words", "unique_pairs", "top_word", "short_words", "long_words", "ended_words", "capital_words",
         "symbol_words", "log_lines", "line_words", "repeated_lines", "ended_lines", "entropy", "compressed")


def statistics(text: str | None) -> list[float]:
    """The values of NAMES for one text."""
    raw = (text or "").encode()
    n = max(len(raw), 1)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = count[count > 0] / n
    words = raw.split()
    n_words = max(len(words), 1)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(len(lines), 1)
    capital = ended = symbol = short = long = 0
    for w, k in seen.items():
        size = len(w)
        short += k * (size <= 3)
        long += k * (size > 12)
        capital += k * (65 <= w[0] <= 90)
        last = w[-1]
        ended += k * (last in b".,;:!?")
        symbol += k * (last in b"#*$%&|<>!")
    pairs = len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)
    return [
        *(MASKS @ count / n).tolist(),
        math.log1p(len(raw)),
        math.log1p(len(words)),
        (len(raw) - len(words)) / n_words,
        len(seen) / n_words,
        pairs,
        max(seen.values(), default=0) / n_words,
        short / n_words,
        long / n_words,
        ended / n_words,
        capital / n_words,
        symbol / n_words,
        math.log1p(len(lines)),
        len(words) / n_lines,
        1 - len(set(lines)) / n_lines if lines else 0.0,
        sum(x.rstrip()[-1] in b".!?" for x in lines) / n_lines,
        float(-(share * np.log2(share)).sum()),
        len(zlib.compress(raw, 1)) / n,
    ]


def table_of(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in texts.to_pylist()], float).reshape(-1, len(NAMES))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, **options) -> gbt.Trees:
    """Fit on at most `sample` labelled documents outside the held-out fold."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("y IN (0, 1)").where(fold(F.col("doc_id")) != 0)
    own = own.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = _io.stored(own, "labels")  # at most `sample` rows of two numbers: small enough to broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = table_of(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(own), "doc_id").select("y", "text").mapInArrow(run, "y double, x array<double>").toPandas()
    rows = rows.iloc[np.lexsort([*np.stack(rows.x.to_list()).T, rows.y])] if len(rows) else rows  # any order of tasks gives the same model
    x = np.stack(rows.x.to_list()) if len(rows) else np.zeros((0, len(NAMES)))
    return gbt.fit(x, rows.y.to_numpy(float), **options)


def score(docs: DataFrame, model: gbt.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.probability(table_of(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: gbt.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score the threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.probability(table_of(b.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _io.table(spark, sf_dir, "documents")
    return score(docs, train(docs, _io.table(spark, sf_dir, "labels")))
