"""A corpus pipeline of the training-data operators: STAGES, each written as Parquet and reread as the next one's docs.

Each stage works on all rows of its predecessor; all but the last return the columns of documents. In order: documents
that the quality classifier rejects go; of each group of near-duplicates
(linked by SimHash as in op6, or by an exact check after it: five-word shingles, Jaccard similarity 0.8 or more) the document with the smallest doc_id stays;
strings of 400 bytes and runs of 51 words that occur again are cut out of the texts (a document that is nothing else is left with an empty
text); documents are repeated or left out so that sources meet their target words; and what is left is packed into
sequences. Copies of a document carry its doc_id, so the last stage has a row for each copy of each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import _io, jaccard, mixing, packing, quality, simhash, suffixes
from strandloom.llm.components import components


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, _io.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Links by SimHash, and those that an exact check finds beside them; a group is what either joins. A row without a doc_id stays only if none of its group has one."""
    docs, key = _io.named(docs)
    rows = docs.select(F.col(key).cast("long").alias("key"), "text", F.col("doc_id").alias("id"))
    prints = simhash.near_duplicates(rows.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), F.col("component_id").alias("u"))
    exact = jaccard.near_duplicates(rows.select("key", "text"), "key")
    least = exact.groupBy("root").agg(F.min("key").alias("v"))
    both = _io.stored(prints.join(exact.join(least, "root").select("key", "v"), "key"), "links")
    roots = components(both.where("u <> v").select("u", "v").distinct())
    found = both.join(roots.withColumnRenamed("node", "u"), "u", "left").select("key", F.coalesce("root", "u").alias("root")).join(rows.select("key", "id"), "key")
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("key")))["key"].alias("key")).select("key")
    return docs.join(kept, docs[key] == kept["key"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns if c != key or key == "doc_id"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.dedup_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut(docs))


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None  # fitted trees and packing are beyond SQL: tests/llm/test_pipeline.py holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _io.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = _io.stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
