"""Exact removal of long repeated byte strings, by blockwise suffix buckets over a difference-cover sample.

A byte goes if a string of `length` bytes that covers it starts anywhere else too, in its own or another document.
Two suffixes i, j are equal over `length` bytes only if some shift k < V brings both i+k and j+k into the difference
cover (a set of residues modulo V in which every difference occurs), where they then share length - V + 1 bytes.

1. Cover ranks. The cover positions (11 % of all) are ranked by the class of their next length - V + 1 bytes; what
   matters of the rank is whether the class has a second member. A suffix without such a position within its next V
   bytes can't repeat, so it never enters a bucket. These classes are settled once and bound everything after.
2. Suffix buckets. The suffixes left are sorted one range of buckets at a time, so only a fixed share of them is on
   disk or in memory at once; within a bucket, suffixes with an equal neighbour are marked. A suffix travels as 96
   bits of a hash of its first `length` bytes: order below `length` bytes decides nothing here, only equality does, so
   buckets are ranges of that hash rather than of the text (which also keeps hot prefixes from sharing a bucket).
3. Marks become spans, and spans are cut out of the texts.

Documents travel in compressed blocks of a few MB. A block sends each distinct suffix once, whatever number of
copies it holds, so a very common passage costs a bucket one entry for each block. The answer to a block is a bit for
each suffix it sent; the block computes the same list again to read it.

The same runs over words as well as bytes, in the same passes: a text's symbols are then hashes of its words (what white
space parts), the length counts words, and what lies between two neighbouring marked words goes with them. Passages of
over 50 words may be shorter than 400 bytes, so both kinds are looked for where texts are to be cleaned.

Defined cases: null text is empty; texts shorter than `length` lose nothing; documents never run into each other;
overlapping repeats count; repeated rows and doc_ids are documents of their own; an empty table gives none; other
columns are ignored, and passed on by dedup_texts. Where a cut would leave part of a character, the text drops that part.
"""

from __future__ import annotations

import functools
import hashlib
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import _io



@dataclass(frozen=True)
class Repeat:
    """What counts as a repeat: so many bytes, or so many words, that stand elsewhere too."""

    length: int
    words: bool = False


BYTES = Repeat(400)
PASSAGE = Repeat(51, words=True)  # passages of over 50 words
LONG_WORD = 4096  # bytes from which a word is hashed on its own
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Difference covers, modulus -> residues. Every difference modulo the modulus occurs.
COVERS = {
    1: (0,),
    7: (0, 1, 3),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
}
BLOCK_BYTES = 4 << 20
STEP = 1 << 16  # positions hashed at a time, few enough for a cache
PRIME = (1 << 31) - 1
BASES = (0x2545F491, 0x5851F42D, 0x4C957F2D, 0x14057B7E)
BUCKET_KEYS = 1 << 20
BLOCK = "block long, keys array<long>, lens array<long>, data binary, zones array<binary>"
DONE = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_cut long, text string"


def cover(length: int) -> tuple[int, np.ndarray]:
    v = max(m for m in COVERS if m == 1 or 2 * m <= length)
    return v, np.array(COVERS[v])


# --- hashes of windows


@functools.lru_cache(maxsize=8)
def _powers(n: int, which: int, lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo PRIME, and values of the 256 bytes."""
    base = BASES[2 * which + lane]

    def powers(x: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(x, len(out), PRIME)) % np.uint64(PRIME)])
        return out[:n]

    letters = np.random.Generator(np.random.PCG64(2 * which + lane)).integers(1, PRIME, 256, np.uint64)
    return powers(base), powers(pow(base, -1, PRIME)), letters


def folded(x: np.ndarray) -> np.ndarray:
    """A smaller number equal to x modulo PRIME: below 2**34 for any x, at most PRIME + 2 for x below 2**33."""
    high = x >> np.uint64(31)
    high += x & np.uint64(PRIME)
    return high


def window_hash(text: np.ndarray, at: np.ndarray, length: int | np.ndarray, which: int) -> np.ndarray:
    """64-bit hashes of the `length` symbols (one number, or one for each) from each position of `at` (ascending): two polynomials modulo a prime over random symbol values, mixed.

    Two different strings share a polynomial for at most `length` of the 2**31 bases, whatever their structure; modulo a power of two some do for every base."""
    most = length if isinstance(length, int) else int(length.max(initial=1))
    table = STEP + max(most, 1 << most.bit_length() if most > 512 else 512)
    out, lo = np.empty(len(at), np.uint64), 0
    for a in range(0, len(text), STEP):
        hi = int(np.searchsorted(at, a + STEP))
        if hi > lo:
            part = text[a : a + STEP + most]
            wide = part if part.dtype == np.uint8 else mixed(part)
            q = at[lo:hi] - a
            end = q + (length if isinstance(length, int) else length[lo:hi])
            lanes = []
            for lane in (0, 1):
                up, down, letters = _powers(table, which, lane)
                value = letters[part] if part.dtype == np.uint8 else (wide >> np.uint64(31 * lane)) & np.uint64(PRIME)
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(folded(value * up[: len(part)]), out=total[1:])  # below 2**32 each, so sums of a part fit
                x = folded(folded(folded(total[end] - total[q]) * down[q]))
                lanes.append(np.where(x >= PRIME, x - np.uint64(PRIME), x))
            out[lo:hi] = lanes[0] << np.uint64(31) | lanes[1]
        lo = hi
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_symbols(text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and 64-bit hash of each word; words do not run over the ends of documents."""
    inside = np.append(~SPACE[text], False)
    cut = np.zeros(len(text) + 1, bool)
    cut[end] = cut[0] = True
    before = np.append(False, inside[:-1])
    start = np.flatnonzero(inside & (~before | cut))
    stop = np.flatnonzero(before & (~inside | cut))
    size = stop - start
    value = np.empty(len(start), np.uint64)
    short = size < LONG_WORD
    value[short] = window_hash(text, start[short], size[short], 0) + size[short].astype(np.uint64)
    for i in np.flatnonzero(~short).tolist():
        value[i] = xxhash.xxh3_64_intdigest(text[start[i] : stop[i]].tobytes())
    return start, stop, value


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, numbered from 0."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


# --- blocks of documents


class View:
    """A block's texts as symbols: bytes, or words. text: the symbols; begin, end: those of each document."""

    def __init__(self, block: Block, words: bool):
        self.block, self.word = block, None
        self.text, self.begin, self.end = block.raw, block.begin, block.end
        if words:
            start, stop, self.text = word_symbols(block.raw, block.end)
            self.word = (start, stop)
            self.begin, self.end = np.searchsorted(start, block.begin), np.searchsorted(start, block.end)

    def in_bytes(self, mark: np.ndarray, i: int) -> np.ndarray:
        """The marked symbols of document i as marked bytes."""
        mark = mark[self.begin[i] : self.end[i]]
        if self.word is None:
            return mark
        block = self.block
        out = np.zeros(block.end[i] - block.begin[i] + 1, np.int8)
        edge = np.diff(mark.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1) + self.begin[i], np.flatnonzero(edge == -1) - 1 + self.begin[i]
        out[self.word[0][first] - block.begin[i]] = 1
        out[self.word[1][last] - block.begin[i]] -= 1
        return np.cumsum(out[:-1]) > 0

    def fits(self, at: np.ndarray, n: int) -> np.ndarray:
        """Those of the ascending positions whose next n symbols stay within their document."""
        return at[at + n <= self.end[np.minimum(np.searchsorted(self.end, at, "right"), len(self.end) - 1)]] if len(at) else at

    def cover_positions(self, length: int) -> np.ndarray:
        v, residues = cover(length)
        at = (np.arange(0, len(self.text), v)[:, None] + residues).ravel()
        return self.fits(at[at < len(self.text)], length - v + 1)

    def cover_keys(self, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions, and bucket << 32 | a 32-bit key, of the cover's windows."""
        v, _ = cover(length)
        at = self.cover_positions(length)
        h = window_hash(self.text, at, length - v + 1, 0)
        return at, bucket_of(h, buckets).astype(np.uint64) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


class Block:
    """Documents in one piece: their bytes, and where each begins and ends in them."""

    def __init__(self, lens, data: bytes):
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max(sum(lens), 1)), np.uint8)
        self.end = np.cumsum(np.asarray(lens, np.int64))
        self.begin = self.end - np.asarray(lens, np.int64)
        self.views: dict[bool, View] = {}

    def view(self, words: bool) -> View:
        if words not in self.views:
            self.views[words] = View(self, words)
        return self.views[words]

    def texts(self) -> Iterator[bytes]:
        return (self.raw[a:b].tobytes() for a, b in zip(self.begin, self.end))

    @staticmethod
    def pack(texts: list[bytes]) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(b"".join(texts))


def blocks(docs: DataFrame, key: str, block_bytes: int) -> DataFrame:
    kinds = pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size = [], [], 0

        def flush():
            return pa.RecordBatch.from_pydict({"block": [uuid.uuid4().int >> 65], "keys": [keys], "lens": [[len(t) for t in texts]], "data": [Block.pack(texts)]}, kinds)

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys.append(k)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= block_bytes or len(keys) >= 50_000:
                    yield flush()
                    keys, texts, size = [], [], 0
        if keys:
            yield flush()

    return docs.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "block long, keys array<long>, lens array<long>, data binary")


# --- keys to buckets, bits back to blocks


def answer(width: tuple[str, ...]):
    """For one bucket: which of the keys that blocks sent were sent by another block too. Each block sends a key once."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        n = [len(k) // sum(np.dtype(w).itemsize for w in width) for k in f["keys"]]
        columns = []
        for i, w in enumerate(width):
            skip = sum(np.dtype(x).itemsize for x in width[:i])
            columns.append(np.concatenate([np.frombuffer(k, w, m, skip * m) for k, m in zip(f["keys"], n)]))
        order = np.argsort(columns[0])
        one = columns[0][order]
        same = one[1:] == one[:-1]
        if len(width) > 1:
            two = columns[1][order]
            if (same & (two[1:] != two[:-1])).any():  # equal first words of different keys: sort on both
                order = np.lexsort(columns[::-1])
                one, two = columns[0][order], columns[1][order]
                same = one[1:] == one[:-1]
            same &= two[1:] == two[:-1]
        mark = np.zeros(len(one), bool)
        mark[1:] |= same
        mark[:-1] |= same
        back = np.empty(len(one), bool)
        back[order] = mark
        cuts = np.cumsum(n)[:-1]
        return pd.DataFrame({"block": f["block"].to_numpy(), "bucket": f["bucket"].to_numpy(), "bits": [np.packbits(x).tobytes() for x in np.split(back, cuts)]})

    return run


def asked(pairs: DataFrame, width: tuple[str, ...], name: str) -> DataFrame:
    return _io.stored(pairs.groupBy("bucket").applyInPandas(answer(width), "block long, bucket long, bits binary"), name)


def once(keys: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, first-of-its-kind flags in that order, and for each place its kind: sorting (keys, more) within a block."""
    order = np.argsort(keys)
    new = np.append(True, keys[order][1:] != keys[order][:-1]) if len(keys) else np.zeros(0, bool)
    if more is not None and len(keys):
        apart = more[order][1:] != more[order][:-1]
        if (~new[1:] & apart).any():
            order = np.lexsort([more, keys])
            new[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
    return order, new, np.cumsum(new) - 1


def read_bits(n: int, order, new, kind, buckets: np.ndarray, replies: dict[int, bytes]) -> np.ndarray:
    """For each of n keys: met twice here, or told so by its bucket."""
    if not n:
        return np.zeros(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    own = buckets[order[first]]
    yes = count > 1
    edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    for a, b in zip(edge, np.append(edge[1:], len(own))):
        yes[a:b] |= np.unpackbits(np.frombuffer(replies[int(own[a])], np.uint8), count=b - a).astype(bool)
    out = np.empty(n, bool)
    out[order] = yes[kind]
    return out


def runs_of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal values."""
    edge = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
    return edge, np.append(edge[1:], len(own))


@dataclass(frozen=True)
class Plan:
    """What to look for, and for each kind its first bucket and its number of buckets."""

    repeats: tuple[Repeat, ...]
    first: tuple[int, ...]
    buckets: tuple[int, ...]

    @staticmethod
    def of(repeats: Sequence[Repeat], buckets: Sequence[int]) -> Plan:
        return Plan(tuple(repeats), tuple(int(x) for x in np.cumsum([0, *buckets[:-1]])), tuple(buckets))

    def __iter__(self) -> Iterator[tuple[Repeat, int, int]]:
        return zip(self.repeats, self.first, self.buckets)


def cover_pairs(table: DataFrame, plan: Plan) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                b = Block(r.lens, r.data)
                for rep, first, buckets in plan:
                    keys = np.unique(b.view(rep.words).cover_keys(rep.length, buckets)[1])
                    own = (keys >> np.uint64(32)).astype(np.int64)
                    low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
                    lo, hi = runs_of(own)
                    yield pd.DataFrame({"bucket": own[lo] + first, "block": r.block, "keys": [low[x:y].tobytes() for x, y in zip(lo, hi)]})

    return table.mapInPandas(run, "bucket long, block long, keys binary")


def finished(key, text: bytes, marks: list[np.ndarray], with_text: str) -> tuple:
    """One result row; marks: for each kind of repeat, the bytes to remove. The counts and the digest are of the first kind, n_cut and text of all."""
    raw, held = np.frombuffer(text, np.uint8), [m for m in marks if m.any()]
    every = np.logical_or.reduce(held) if held else None
    n_cut = int(every.sum()) if held else 0
    out = None
    if with_text == "all" or with_text == "changed" and n_cut:
        out = (raw[~every].tobytes() if held else text).decode(errors="ignore")
    first = marks[0] if marks and marks[0].any() else None
    if first is None:
        return (key, len(text), 0, 0, hashlib.sha256(text).hexdigest(), n_cut, out)
    edge = np.diff(first.astype(np.int8), prepend=0, append=0)
    return (key, len(text), int(first.sum()), int((edge == 1).sum()), hashlib.sha256(raw[~first].tobytes()).hexdigest(), n_cut, out)


def result_frame(rows: list[tuple], block: dict | None = None) -> pd.DataFrame:
    names, held = [x.split()[0] for x in DONE.split(", ")], [x.split()[0] for x in BLOCK.split(", ")]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    out = pd.concat([out.assign(**dict.fromkeys(held)), *([pd.DataFrame([block], dtype=object)] if block else [])], ignore_index=True)
    whole = [x.split()[0] for x in f"{DONE}, {BLOCK}".split(", ") if x.endswith(" long")]
    return out.astype({c: "Int64" for c in whole})


def candidates(plan: Plan, with_text: str):
    """A block and the answers about its cover: rows of documents that keep everything, and a smaller block of the rest with the zones of possible starts, for each kind of repeat."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        r = left.iloc[0]
        b, replies = Block(r.lens, r.data), dict(zip(right.bucket, right.bits))
        starts, docs = [], []
        for rep, first, buckets in plan:
            v, _ = cover(rep.length)
            view = b.view(rep.words)
            at, keys = view.cover_keys(rep.length, buckets)
            order, new, kind = once(keys)
            yes = read_bits(len(keys), order, new, kind, (keys >> np.uint64(32)).astype(np.int64) + first, replies)
            may = np.zeros(len(view.text) + 1, np.int32)
            np.add.at(may, np.maximum(at[yes] - v + 1, 0), 1)
            np.add.at(may, at[yes] + 1, -1)
            starts.append(view.fits(np.flatnonzero(np.cumsum(may[:-1]) > 0), rep.length))
            docs.append(np.searchsorted(view.end, starts[-1], "right"))
        held = np.unique(np.concatenate(docs))
        keeps = np.ones(len(b.end), bool)
        keeps[held] = False
        names, texts = list(r["keys"]), list(b.texts())
        rows = [finished(names[i], texts[i], [], with_text) for i in np.flatnonzero(keeps)]
        if not len(held):
            return result_frame(rows)
        zones = []
        for (rep, _, _), may, doc in zip(plan, starts, docs):
            view = b.view(rep.words)
            lens = (view.end - view.begin)[held]
            moved = np.zeros(len(view.end), np.int64)
            moved[held] = view.begin[held] - (np.cumsum(lens) - lens)
            may = may - moved[doc]
            edge = np.flatnonzero(np.append(True, np.diff(may) != 1)) if len(may) else np.zeros(0, int)
            zones.append(np.stack([may[edge], may[np.append(edge[1:], len(may)) - 1] + 1] if len(may) else [edge, edge]).astype("<i8").tobytes())
        return result_frame(rows, {"block": int(r.block), "keys": [names[i] for i in held], "lens": (b.end - b.begin)[held].tolist(), "data": Block.pack([texts[i] for i in held]), "zones": zones})

    return run


def zone_positions(zones: bytes) -> np.ndarray:
    a, b = np.frombuffer(zones, "<i8").reshape(2, -1)
    n = b - a
    return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())


def suffix_pairs(table: DataFrame, plan: Plan, wave: int, waves: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                b = Block(r.lens, r.data)
                for (rep, first, buckets), zones in zip(plan, r.zones):
                    if rep.words and wave:  # words are few: all in the first wave
                        continue
                    keys = Suffixes(b.view(rep.words), zones, rep, buckets, 1 if rep.words else waves)
                    _, one, two, own = keys.of(wave)
                    order, new, _ = once(one, two)
                    at = order[new]
                    one, two, own = one[at].astype("<u8"), two[at].astype("<u4"), own[at]
                    lo, hi = runs_of(own)
                    yield pd.DataFrame({"bucket": own[lo] + first, "block": r.block, "keys": [one[x:y].tobytes() + two[x:y].tobytes() for x, y in zip(lo, hi)]})

    return table.mapInPandas(run, "bucket long, block long, keys binary")


class Suffixes:
    """The suffixes of a block's zones, by wave."""

    def __init__(self, view: View, zones: bytes, rep: Repeat, buckets: int, waves: int):
        self.view, self.length, self.waves = view, rep.length, waves
        self.at = zone_positions(zones)
        self.one = window_hash(view.text, self.at, rep.length, 0)
        self.bucket = bucket_of(self.one, buckets)
        self.wave = self.bucket * waves // buckets if waves > 1 else None

    def of(self, wave: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Position, 64 and 32 bits of key, bucket."""
        now = slice(None) if self.wave is None else self.wave == wave
        at = self.at[now]
        return at, self.one[now], (window_hash(self.view.text, at, self.length, 1) >> np.uint64(32)).astype(np.uint32), self.bucket[now]


def spans(plan: Plan, waves: int, with_text: str):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        r = left.iloc[0]
        b, replies, marks = Block(r.lens, r.data), dict(zip(right.bucket, right.bits)), []
        for (rep, first, buckets), zones in zip(plan, r.zones):
            view = b.view(rep.words)
            keys = Suffixes(view, zones, rep, buckets, 1 if rep.words else waves)
            depth = np.zeros(len(view.text) + 1, np.int32)
            for wave in range(keys.waves):
                at, one, two, own = keys.of(wave)
                order, new, kind = once(one, two)
                at = at[read_bits(len(at), order, new, kind, own + first, replies)]
                depth[at] += 1  # positions are distinct
                depth[at + rep.length] -= 1
            marks.append((view, np.cumsum(depth[:-1]) > 0))
        return result_frame([finished(k, t, [view.in_bytes(m, i) for view, m in marks], with_text) for i, (k, t) in enumerate(zip(r["keys"], b.texts()))])[[x.split()[0] for x in DONE.split(", ")]]

    return run


def repeated_spans(
    docs: DataFrame, key: str = "doc_id", *, repeats: Sequence[Repeat] = (BYTES,), with_text: str = "none", block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS, wave_share: float = 1.2, least_wave: int = 64 << 20
) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 (by the first of the repeats) and n_cut, text (by all of them) for every row of docs (key, text).

    with_text: "none", "changed" (null for documents that lose nothing) or "all". wave_share: bytes of suffix keys on
    disk at once, as a share of the text's; least_wave: bytes below which there is no point in several waves.
    """
    table = _io.stored(blocks(docs, key, block_bytes), "blocks", "uncompressed")
    n = table.select(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    share = [len(cover(r.length)[1]) / cover(r.length)[0] / (6 if r.words else 1) for r in repeats]  # cover positions a byte; words have about six
    plan = Plan.of(repeats, [max(4, math.ceil(n * x / (2 * bucket_keys))) for x in share])
    replies = asked(cover_pairs(table, plan), ("<u4",), "cover-ranks")
    mixed = table.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(candidates(plan, with_text), f"{DONE}, {BLOCK}")
    mixed = _io.stored(mixed, "candidates")
    _io.drop(table)
    _io.drop(replies)
    rest = mixed.where("block IS NOT NULL").select("block", "keys", "lens", "data", "zones")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([[int(np.diff(np.frombuffer(z, "<i8").reshape(2, -1), axis=0).sum()) for z in zones] for zones in f.zones], columns=[f"n{i}" for i in range(len(repeats))])

    sums = [f"n{i}" for i in range(len(repeats))]
    tests = [x or 0 for x in rest.select("zones").mapInPandas(count, ", ".join(f"{c} long" for c in sums)).agg(*[F.sum(c) for c in sums]).first()]
    waves = max(1, -(-12 * sum(tests) // max(least_wave, int(n * wave_share))))
    plan = Plan.of(repeats, [waves * max(1, math.ceil(x / waves / bucket_keys)) for x in tests])
    told = None
    for wave in range(waves):
        part = asked(suffix_pairs(rest, plan, wave, waves), ("<u8", "<u4"), "suffix-bits")
        told = part if told is None else told.unionAll(part)
    found = rest.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(spans(plan, waves, with_text), DONE)
    out = mixed.where("block IS NULL").select(found.columns).unionAll(found).withColumnRenamed("key", key)
    return out if with_text != "none" else out.drop("n_cut", "text")


def dedup_texts(docs: DataFrame, repeats: Sequence[Repeat] = (BYTES, PASSAGE), **options) -> DataFrame:
    """docs (doc_id, text, any others) without their repeated strings; n_chars, where there is one, follows the text."""
    docs, key = _io.named(docs)
    name, text = _io.fresh(docs, "_name"), _io.fresh(docs, "_kept")
    changed = repeated_spans(docs, key, repeats=repeats, with_text="changed", **options).where("n_cut > 0")
    changed = _io.stored(changed.select(F.col(key).alias(name), F.col("text").alias(text)), "changed-texts")
    out = docs.join(changed, F.col(key) == F.col(name), "left")
    new = F.col(name).isNotNull()
    cols = {"text": F.when(new, F.col(text)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(new, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[cols[c].alias(c) if c in cols else F.col(f"`{c}`") for c in docs.columns if c != key or key == "doc_id"])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns by 400 bytes; after them text, the document less its repeats of 400 bytes or of 51 words, and n_cut, the bytes that it lost by both."""
    return repeated_spans(_io.table(spark, sf_dir, "documents"), repeats=(BYTES, PASSAGE), with_text="all")
