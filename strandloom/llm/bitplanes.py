"""Token-id files in bit planes.

Format. Documents in ascending id order are dealt to shards by ranges of doc_id; a shard is a list of chunks, a
chunk holds the ids of whole documents. Within a chunk the ids form fixed-size blocks (the last one is shorter). A
block of n ids is transposed: plane b holds bit b (mode "bit") or byte b (mode "byte") of each id, n values packed
in one go, and each plane is compressed with zstandard on its own. The chunk index stores the compressed length of
every plane of every block, so any block, or any plane of it, can be read alone. Chunks are rows of a Parquet
dataset, which is how executors get binary files into any store with retried tasks; `data` is the format above.

Defined cases: null text counts as empty; every document gets the end id, so an empty one has one id; null doc_id
sorts first; rows that share a doc_id are all kept, ordered by the crc32 and length of their ids; an empty table
gives no shard; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm import _io, tokens

BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 20
SHARD_BYTES = 8 << 20
TOGETHER = 6  # shards sorted in one task, so that tasks are of about one size
CHUNKS = "shard long, chunk long, n_ids long, width int, mode string, doc_ids array<long>, doc_lens array<long>, plane_lens array<long>, data binary"


def encode_block(ids: np.ndarray, width: int, mode: str, level: int = 3) -> list[bytes]:
    """The compressed planes of one block; ids: unsigned integers of `width` bytes."""
    rows = ids.astype(f"<u{width}").view(np.uint8).reshape(len(ids), width)
    if mode == "byte":
        planes = np.ascontiguousarray(rows.T)
    else:
        planes = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(p.tobytes()) for p in planes]


def decode_block(planes: list[bytes], n: int, width: int, mode: str) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(unpack.decompress(p), np.uint8) for p in planes]
    if mode == "byte":
        rows = np.ascontiguousarray(np.stack(raw, axis=1))
    else:
        bits = np.unpackbits(np.stack(raw), axis=1, bitorder="little")[:, :n]
        rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return rows.reshape(-1).view(f"<u{width}")[:n]


def encode_chunk(ids: np.ndarray, width: int, mode: str, block: int = BLOCK_IDS) -> tuple[list[int], bytes]:
    planes = [p for at in range(0, len(ids), block) for p in encode_block(ids[at : at + block], width, mode)]
    return [len(p) for p in planes], b"".join(planes)


def decode_chunk(n: int, width: int, mode: str, plane_lens, data: bytes, block: int = BLOCK_IDS) -> np.ndarray:
    each, at, out, planes = 8 * width if mode == "bit" else width, 0, [np.zeros(0, f"<u{width}")], []
    for length in plane_lens:
        planes.append(data[at : at + length])
        at += length
        if len(planes) == each:
            out.append(decode_block(planes, min(block, n - block * (len(out) - 1)), width, mode))
            planes = []
    return np.concatenate(out)


def shard_bounds(docs: DataFrame, shard_bytes: int) -> list[int]:
    """Ends of the ranges of doc_id, a number for each shard_bytes of text; from all rows, in one pass."""
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-n // shard_bytes))
    if shards == 1:
        return []
    got = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / shards) for k in range(1, shards)]), F.lit(max(10_000, 20 * shards)))).first()[0]
    return sorted(set(got or []))


def write_token_files(docs: DataFrame, path: str, *, vocabulary: str = tokens.WORD_FILE, tokenizer_path: str | None = None, end_id: int = 2, mode: str = "byte", width: int = 2, shard_bytes: int = SHARD_BYTES, chunk_ids: int = CHUNK_IDS) -> None:
    """Encode docs (doc_id, text) and write the chunk files below path. width: bytes of an id in the files."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = np.array(shard_bounds(docs, shard_bytes), np.int64)

    def ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = tokens.encoder(vocabulary, tokenizer_path), np.array([end_id], "<u4").tobytes()
        for f in frames:
            got = [np.frombuffer(x + end, "<u4") for x in encode(f.text)]
            if max(int(x.max()) for x in got) >> (8 * width) if got else False:
                raise ValueError(f"an id needs more than {width} bytes")
            shard = np.where(f.doc_id.isna(), 0, np.searchsorted(bounds, f.doc_id.fillna(0).to_numpy(np.int64), "left"))
            yield pd.DataFrame({"shard": shard, "doc_id": f.doc_id.astype("Int64"), "n": [len(x) for x in got], "ids": [x.astype(f"<u{width}").tobytes() for x in got]})
        encode.forget()

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, chunk, held, names, lens = None, 0, [], [], []

        def flush():
            all_ids = np.frombuffer(b"".join(held), f"<u{width}")
            plane_lens, data = encode_chunk(all_ids, width, mode)
            return pd.DataFrame({"shard": [shard], "chunk": [chunk], "n_ids": [len(all_ids)], "width": [width], "mode": [mode], "doc_ids": [list(names)], "doc_lens": [list(lens)], "plane_lens": [plane_lens], "data": [data]})

        for f in frames:
            for s, d, n, x in zip(f.shard, f.doc_id.astype(object), f.n, f.ids):
                if held and (s != shard or sum(lens) + n > chunk_ids):
                    yield flush()
                    chunk, held, names, lens = chunk + 1, [], [], []
                if s != shard:
                    shard, chunk = s, 0
                held.append(x)
                names.append(None if pd.isna(d) else int(d))
                lens.append(int(n))
        if held:
            yield flush()

    rows = docs.mapInPandas(ids, "shard long, doc_id long, n long, ids binary")
    rows = rows.repartition(-(-(len(bounds) + 1) // TOGETHER), "shard").sortWithinPartitions("shard", "doc_id", F.crc32("ids"), "n")
    with _io.small_batches(docs.sparkSession):
        rows.mapInPandas(pack, CHUNKS).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, *, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids (or with digest, ids_crc32)."""
    files = spark.read.schema(CHUNKS).parquet(path)
    per_chunk = files.select("shard", "chunk", "n_ids")
    before = per_chunk.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = before.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))  # a row for each shard
    inner = Window.partitionBy("shard").orderBy("chunk")
    starts = per_chunk.select("shard", "chunk", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("chunk_start")).join(before, "shard")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                ids = decode_chunk(r.n_ids, r.width, r.mode, r.plane_lens, r.data)
                ends = np.cumsum(np.asarray(r.doc_lens, np.int64))
                pieces = [ids[e - n : e] for e, n in zip(ends, r.doc_lens)]
                out = {"shard": r.shard, "chunk": r.chunk, "doc_id": pd.array([None if pd.isna(d) else int(d) for d in np.asarray(r.doc_ids, object)], "Int64"), "at": ends - np.asarray(r.doc_lens, np.int64), "n_tokens": np.asarray(r.doc_lens, np.int64)}
                yield pd.DataFrame(out | ({"ids_crc32": [zlib.crc32(p.astype("<u4").tobytes()) for p in pieces]} if digest else {"ids": [p.astype(np.int64) for p in pieces]}))

    last = "ids_crc32" if digest else "ids"
    docs = files.mapInPandas(unpack, f"shard long, chunk long, doc_id long, at long, n_tokens long, {last} {'long' if digest else 'array<long>'}")
    return docs.join(starts, ["shard", "chunk"]).select("doc_id", (F.col("shard_start") + F.col("chunk_start") + F.col("at")).alias("start"), "n_tokens", last)


def op2_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _io.new_path(spark, "token-files")
    write_token_files(_io.table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path, digest=True)
