"""Derived views over the tables: sequences, reads, parts and hits, on which the sequence operators run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators.ranges import running_start

CHUNK_BITS = 24  # chunks of about 2**24 bases


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table read in fewer tasks than there are cores (a small one in few files), dealt out evenly; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", S.letters_to_bases(F.col("text")).alias("seq"))


def raw_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", S.letters_to_raw(F.col("text")).alias("raw"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("len"))
    out = running_start(docs, "doc_id", "len", "pos")
    return out.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "pos", "len")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, chunk (from 1), shift (1-based start), seq."""
    return contig_chunks(seqs(spark, sf_dir), 1 << CHUNK_BITS)


def contig_chunks(df: DataFrame, target: int, overlap: int = 2, alone: bool = False) -> DataFrame:
    """Equal chunks of about `target` bases that overlap; the last one takes what is left, so no base is lost. alone: tells also which chunks are their contig's only ones."""
    bits = target.bit_length() - 1
    n = F.lit(1) + F.shiftright(F.length("seq") + overlap, bits)
    out = df.where("seq <> ''").withColumn("n", n).withColumn("size", F.floor((F.length("seq") + overlap * F.col("n")) / F.col("n")).cast("int"))
    out = out.select("doc_id", "seq", "n", "size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("chunk"))
    start = F.lit(1) + (F.col("chunk") - 1) * (F.col("size") - overlap)
    length = F.when(F.col("chunk") < F.col("n"), F.col("size")).otherwise(F.length("seq"))
    return out.select("doc_id", "chunk", start.cast("long").alias("shift"), F.substring(F.col("seq"), start, length).alias("seq"), *([(F.col("n") == 1).alias("alone")] if alone else []))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of 100 to 150 bases (where the sequence is as long) for each event, dealt over all documents; every seventh has one base changed."""
    n = table(spark, sf_dir, "documents").count()
    ev = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % n).alias("doc_id"))
    # a merge join: a broadcast of the events would derive a document's sequence again for each of its reads
    both = ev.join(seqs(spark, sf_dir).hint("merge"), "doc_id").where("length(seq) >= 100")
    want = F.least(100 + F.col("event_id") % 51, F.length("seq"))
    start = 1 + (F.col("event_id") * 37) % (F.length("seq") - want + 1)
    cut = both.select("event_id", "doc_id", start.alias("start"), F.substring(F.col("seq"), start.cast("int"), want.cast("int")).alias("seq"))
    at = (F.col("event_id") % 90 + 5).cast("int")
    edited = F.concat(F.substring(F.col("seq"), F.lit(1), at - 1), F.translate(F.substring(F.col("seq"), at, F.lit(1)), "ACGT", "CGTA"), F.substring(F.col("seq"), at + 1, F.length("seq")))
    return cut.select(F.col("event_id").alias("read_id"), "doc_id", "start", F.when(F.col("event_id") % 7 == 0, edited).otherwise(F.col("seq")).alias("seq"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed ends: key, window, p."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("w"), F.col("event_id").alias("p"))


#: The same views for DuckDB.
SQL = {
    "seqs": "SELECT doc_id, regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', '', 'g') AS seq FROM documents",
    "raws": "SELECT doc_id, regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'NCGTARYKMSWBDVACGTNACGTACG'), '[^A-Z]', '', 'g') AS raw FROM documents",
    "parts": "SELECT 'doc' || doc_id AS name, (sum(n_chars) OVER (ORDER BY doc_id) - n_chars)::BIGINT AS pos, n_chars AS len FROM documents",
    "chunks": f"""SELECT doc_id, c::INT AS chunk, (1 + (c - 1) * (size - 2))::BIGINT AS shift, substring(seq, 1 + (c - 1) * (size - 2), CASE WHEN c < n THEN size ELSE length(seq) END) AS seq
        FROM (SELECT *, unnest(generate_series(1, n)) AS c FROM (SELECT *, (length(seq) + 2 * n) // n AS size FROM (SELECT *, 1 + ((length(seq) + 2) >> {CHUNK_BITS}) AS n FROM seqs WHERE seq <> '')))""",
    "reads": """SELECT event_id AS read_id, doc_id, start, CASE WHEN event_id % 7 = 0 THEN substring(s, 1, event_id % 90 + 4) || translate(substring(s, event_id % 90 + 5, 1), 'ACGT', 'CGTA') || substring(s, event_id % 90 + 6)
        ELSE s END AS seq FROM (SELECT *, substring(seq, start, want) AS s FROM (SELECT *, 1 + (event_id * 37) % (length(seq) - want + 1) AS start FROM
        (SELECT event_id, doc_id, seq, least(100 + event_id % 51, length(seq)) AS want FROM (SELECT event_id, event_id % (SELECT count(*) FROM documents) AS doc_id FROM events) JOIN seqs USING (doc_id) WHERE length(seq) >= 100)))""",
    "hits": "SELECT user_id AS key, event_type AS w, event_id AS p FROM events",
}
NEEDS = {"chunks": ("seqs",), "reads": ("seqs",)}


def with_views(*names: str) -> str:
    """A WITH clause of the named views and those they need, open for more."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order)
