"""The report of a run: what was dispatched, what was aligned, how long it took; counted while the run itself works."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from strandloom.params import DEFAULT, Params
from strandloom.plans.align import Index, align_reads

REPORT = "reads_dispatched long, bases long, reads_aligned long, workers int, started timestamp, elapsed double"


def align_with_report(reads: DataFrame, contigs: DataFrame | Index, path: str, p: Params = DEFAULT) -> DataFrame:
    """Writes the best hits of reads to path and returns one row of REPORT: reads given out and their bases, reads with a
    reported hit, tasks at a time, start, seconds. The counts are observed in the run's own jobs, not by a second pass."""
    spark, began, clock = reads.sparkSession, time.time(), time.monotonic()
    given, found = Observation("given"), Observation("found")
    reads = reads.observe(given, F.count("*").alias("reads"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"))
    hits = align_reads(reads, contigs, p)
    hits.observe(found, F.count("*").alias("reads")).write.parquet(path)
    row = (given.get["reads"], given.get["bases"], found.get["reads"], spark.sparkContext.defaultParallelism, datetime.fromtimestamp(began), time.monotonic() - clock)
    return spark.createDataFrame([row], REPORT)


class BatchReports(StreamingQueryListener):
    """Keeps, for each micro-batch of a stream, its number, rows and seconds; add it with spark.streams.addListener."""

    def __init__(self):
        self.batches: list[tuple[int, int, float]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        x = event.progress
        self.batches.append((x.batchId, x.numInputRows, x.batchDuration / 1000))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
