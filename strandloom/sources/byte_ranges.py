"""Large FASTA and FASTQ files by byte ranges: each task opens the file at its own offset, so one file is read by many tasks.

fastq_ranges, in batches: a range gives the records whose header starts inside it. A task that starts in the middle of a
record finds the next header as a line with @ whose next but one starts with +: a quality line with @ in front is followed
by a header and then by bases, which never start with +.

fastq_ranges, as a stream: an offset says how far each file has been read. A batch takes at most batchbytes over all
files, in ranges of rangebytes; the driver only lists files, the tasks read them. Files must be complete when they
appear. The planned offset is also kept in the folder `progress`, because a restarted source is not told where it
stopped; the first offset after a restart is that one, so a batch is never planned twice or left out.

fasta_ranges: the bodies of a FASTA file's contigs in pieces, placed by an index file (name, pos, len). A filter on name is
pushed down to the index, so the bytes of other contigs are never read.

Defined cases: empty files give no rows; text before the first record is skipped; a last record without quality counts,
one without bases does not; \\r at line ends goes; a contig without bases gives no piece.
"""

from __future__ import annotations

import io
import json
import posixpath
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from strandloom.sources.text import scratch, stored

RANGE = 32 << 20
BATCH = 640 << 10  # about ten workloads of 200 reads: a stream's batch if nothing else is said
CORE = 8 << 20  # bytes of a batch for each core, where the batch follows the cluster
NOTE = "planned.json"
FASTQ = "name string, seq string, file string, pos long"
FASTA = "name string, part long, n long, bases string"
ROWS = 4096  # in an Arrow batch


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def listed(path: str) -> list[tuple[str, int]]:
    """Name and size of the file, or of the files in the folder; names that start with _ or . are not data."""
    store, root = place(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root))
    return sorted((x.path, x.size) for x in found if x.is_file and not x.base_name.startswith(("_", ".")))


@dataclass
class Range(InputPartition):
    """Bytes from start to stop of a file; for a contig, its name and the number of the piece."""

    file: str
    start: int
    stop: int
    name: str = ""
    part: int = 0


@dataclass
class Ranges(InputPartition):
    """Ranges of one file that one task reads."""

    ranges: list[Range]


def together(ranges: list[Range], most: int) -> Iterator[Ranges]:
    """Consecutive ranges of one file of at most so many bytes, or single ones."""
    held, size = [], 0
    for r in ranges:
        if held and (size + r.stop - r.start > most or r.file != held[0].file):
            yield Ranges(held)
            held, size = [], 0
        held.append(r)
        size += r.stop - r.start
    yield Ranges(held)


def cut(file: str, start: int, stop: int, step: int, name: str = "") -> Iterator[Range]:
    for part, a in enumerate(range(start, stop, step)):
        yield Range(file, a, min(a + step, stop), name, part)


# --- FASTQ


def records(store: fs.FileSystem, at: Range) -> Iterator[tuple[str, str, str, int]]:
    with store.open_input_file(at.file) as raw, io.BufferedReader(raw, 1 << 20) as f:
        f.seek(max(at.start - 1, 0))
        if at.start:
            f.readline()  # up to the first line that starts inside
        pos, ahead = f.tell(), [f.readline() for _ in range(3)]
        synced = not at.start
        while ahead[0] and pos < at.stop:
            one, two, three = ahead
            # the end of the file stands for the + of a last record that was cut short
            here = one.startswith(b"@") and (synced or three.startswith(b"+") or not three and two and not two.startswith(b"@"))
            if not here:
                pos += len(one)
                ahead = [two, three, f.readline()]
                continue
            synced = True
            if two:
                yield one[1:].rstrip(b"\r\n").decode(), two.rstrip(b"\r\n").decode(), at.file, pos
            pos += len(one) + len(two) + len(three) + len(f.readline())
            ahead = [f.readline() for _ in range(3)]


def arrow(rows: Iterator[tuple[str, str, str, int]]) -> Iterator[pa.RecordBatch]:
    schema, held = pa.schema([("name", pa.string()), ("seq", pa.string()), ("file", pa.string()), ("pos", pa.int64())]), []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"], int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[Range]:
        return [r for file, size in listed(self.path) for r in cut(file, 0, size, self.step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return arrow(records(place(self.path)[0], partition))


class FastqStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"], int(options.get("rangebytes", 64 << 10))
        self.most = int(options.get("batchbytes", BATCH))
        self.store, self.folder = place(options["progress"])
        self.at = planned(posixpath.dirname(options["progress"]))
        self.restored = bool(self.at)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if self.restored:
            self.restored = False
            return dict(self.at)
        left, new = self.most, dict(self.at)
        for file, size in listed(self.path):
            step = min(left, size - new.get(file, 0))
            if step > 0:
                new[file] = new.get(file, 0) + step
                left -= step
        if new != self.at:
            self.store.create_dir(self.folder, recursive=True)
            note = posixpath.join(self.folder, NOTE)
            with self.store.open_output_stream(note + ".new") as f:
                f.write(json.dumps(new).encode())
            self.store.move(note + ".new", note)
            self.at = new
        return dict(new)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for file, stop in sorted(end.items()) for r in cut(file, start.get(file, 0), stop, self.step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return arrow(records(place(self.path)[0], partition))

    def commit(self, end: dict) -> None:
        pass


class FastqRanges(DataSource):
    """Options: path, rangebytes; as a stream also batchbytes and progress, a folder named so beside the checkpoint."""

    @classmethod
    def name(cls) -> str:
        return "fastq_ranges"

    def schema(self) -> str:
        return FASTQ

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)

    def streamReader(self, schema) -> FastqStream:
        return FastqStream(self.options)


# --- FASTA


class FastaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.index = options["path"], options["index"]
        self.step, self.most = (int(options.get(x, RANGE)) for x in ("rangebytes", "taskbytes"))
        self.names: set[str] | None = None

    def pushFilters(self, filters):
        for x in filters:
            if isinstance(x, (EqualTo, In)) and x.attribute == ("name",):
                names = {x.value} if isinstance(x, EqualTo) else set(x.value)
                self.names = names if self.names is None else self.names & names
            else:
                yield x

    def partitions(self) -> list[Ranges]:
        files = listed(self.path)
        ends = list(accumulate(size for _, size in files))
        out, store = [], place(self.index)[0]
        for name, _ in listed(self.index):
            with store.open_input_file(name) as raw, io.BufferedReader(raw, 1 << 20) as f:
                for line in f:
                    contig, pos, n = line.decode().rsplit(maxsplit=2)
                    if self.names is None or contig in self.names:
                        if not int(n):
                            continue
                        at = bisect_right(ends, int(pos))  # the file that has this byte of all files joined
                        if at == len(ends) or int(pos) + int(n) > ends[at]:
                            raise ValueError(f"{contig} goes beyond the end of a file")
                        start = int(pos) - (ends[at] - files[at][1])
                        out += cut(files[at][0], start, start + int(n), self.step, contig)
        # an index need not be in order of place
        return list(together(sorted(out, key=lambda r: (r.file, r.start)) or [Range(files[0][0], 0, 0)], self.most))

    def read(self, partition: Ranges) -> Iterator[tuple]:
        with place(self.path)[0].open_input_file(partition.ranges[0].file) as f:
            for r in partition.ranges:
                f.seek(r.start)
                bases = f.read(r.stop - r.start).translate(None, b"\r\n").decode()
                if bases:
                    yield r.name, r.part, len(bases), bases


class FastaRanges(DataSource):
    """Options: path (a file, or a folder of files taken as joined in order of their names; a contig lies in one), index (lines of name, pos, len), rangebytes of a piece, taskbytes of a task's pieces."""

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return FASTA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


# --- as DataFrames


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FastqRanges, FastaRanges):
        spark.dataSource.register(source)


def fastq_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """name, seq, file, pos (byte offset of the header) of four-line records."""
    register(spark)
    return spark.read.format("fastq_ranges").option("path", path).option("rangebytes", range_bytes).load()


def fasta_pieces(spark: SparkSession, path: str, index: str, contigs: list[str] | None = None, range_bytes: int = RANGE) -> DataFrame:
    """name, start (bases of the contig before), bases: contigs in pieces of range_bytes; contigs: only these names. Pieces are
    written once; the starts are running sums of their lengths, without the bases."""
    register(spark)
    pieces = spark.read.format("fasta_ranges").option("path", path).option("index", index).option("rangebytes", range_bytes).load()
    if contigs is not None:
        pieces = pieces.where(F.col("name").isin(*contigs))
    pieces = stored(pieces, "pieces")
    before = F.sum("n").over(Window.partitionBy("name").orderBy("part")) - F.col("n")
    starts = pieces.select("name", "part", before.alias("start"))
    return pieces.join(starts, ["name", "part"]).select("name", "start", "bases")


def planned(state: str) -> dict[str, int]:
    """How far a stream's batches reach in each file."""
    store, folder = place(f"{state}/progress")
    note = posixpath.join(folder, NOTE)
    if not store.get_file_info(note).is_file:
        return {}
    with store.open_input_file(note) as f:
        return json.loads(f.read())


def stream_fastq(spark: SparkSession, path: str, write: Callable[[DataFrame, int], None], state: str, batch_bytes: int | None = None) -> None:
    """Gives write the FASTQ records below path, a micro-batch and its number at a time, until all that there is now has been read.
    A batch takes at most batch_bytes, or CORE for each core of the cluster: what a batch costs beside its records would else grow with the input.
    State (checkpoint and offsets) is kept in the folder `state`: called again, it goes on where it stopped, also after a
    failure. A batch may be tried again, so write should replace what it wrote under that number."""
    register(spark)
    cores = spark.sparkContext.defaultParallelism
    most = cores * CORE if batch_bytes is None else batch_bytes
    step = max(64 << 10, -(-most // (4 * cores)))
    stream = spark.readStream.format("fastq_ranges").option("path", path).option("batchbytes", most).option("rangebytes", step).option("progress", f"{state}/progress").load()
    size = dict(listed(path))
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/checkpoint").trigger(processingTime="0 seconds").start()
    try:
        whole = False
        while not whole:
            at = planned(state)
            whole = all(at.get(file, 0) >= n for file, n in size.items())
            query.processAllAvailable()  # raises what a batch raised
    finally:
        query.stop()


def stream_fastq_scan(spark: SparkSession, path: str) -> DataFrame:
    """name, seq of all FASTQ files below path, read as a stream into the shared folder."""
    out = scratch(spark, "streamed")
    spark.createDataFrame([], "name string, seq string").write.parquet(f"{out}/batch=-1")
    stream_fastq(spark, path, lambda df, number: df.select("name", "seq").write.mode("overwrite").parquet(f"{out}/batch={number}"), scratch(spark, "stream-state"))
    return spark.read.parquet(out).select("name", "seq")
