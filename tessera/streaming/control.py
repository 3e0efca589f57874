"""Running streams: admission, draining, stopping, backlog, progress and faults on demand.

A stream of files is Spark's bounded queue: it admits so many files a batch in order of their time, never drops
or reorders them, and what waits stays in the folder. A stopped query loses nothing, for its checkpoint names
what was admitted.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

#: Files that a batch admits.
CAPACITY = 2
#: Least seconds between two reports.
REPORT_SECONDS = 1.0
log = logging.getLogger(__name__)


def admitted(spark: SparkSession, path: str, schema: str, capacity: int = CAPACITY) -> DataFrame:
    """A stream of the Parquet files of a folder, capacity files a batch at most."""
    if capacity < 1:
        raise ValueError(f"capacity of {capacity}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", capacity).parquet(path)


def drain(writer: DataStreamWriter, timeout_s: float | None = None) -> StreamingQuery:
    """Run until what was there at the start is done, in bounded batches, and end; an error of the stream is raised."""
    query = writer.trigger(availableNow=True).start()
    ended = query.awaitTermination(timeout_s) if timeout_s is not None else query.awaitTermination()
    if timeout_s is not None and not ended:
        query.stop()
        raise TimeoutError(f"stream not drained in {timeout_s} s")
    return query


def shut_down(*queries: StreamingQuery, finish: bool = False) -> None:
    """Stop all queries, with finish after what they were given; then raise the first one's error, in the given order.

    All are stopped whatever errors there are. Errors of others are logged.
    """
    errors = []
    for query in queries:
        try:
            if finish and query.isActive:
                query.processAllAvailable()
        except Exception:  # noqa: BLE001  the query keeps its error, which is taken below
            log.debug("query %s ended while finishing", query.name)
        query.stop()
    for query in queries:
        found = query.exception()
        if found is not None:
            errors.append(found)
    for later in errors[1:]:
        log.error("stream failed too: %s", later)
    if errors:
        raise errors[0]


def backlog(spark: SparkSession, path: str, checkpoint: str, capacity: int = CAPACITY) -> DataFrame:
    """One row: files that wait (depth), files admitted so far, capacity of a batch and batches that wait.

    Admitted files are those that the checkpoint's log of the first source names. Both sides are read as tables.
    """
    last = F.element_at(F.split("path", "/"), -1)
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(last.alias("name"))
    try:
        taken = spark.read.text(f"{checkpoint}/sources/0").select(F.get_json_object("value", "$.path").alias("path")).filter("path is not null").select(last.alias("name")).distinct()
    except AnalysisException:
        taken = there.limit(0)
    waits = there.join(taken, "name", "left_anti").agg(F.count("*").alias("depth"))
    return waits.join(F.broadcast(taken.agg(F.count("*").alias("admitted")))).select("depth", "admitted", F.lit(capacity).alias("capacity"), F.ceil(F.col("depth") / capacity).alias("batches"))


class Progress(StreamingQueryListener):
    """Reports the first progress, and then at most one every REPORT_SECONDS, to a function of a dictionary."""

    def __init__(self, report=None, seconds: float = REPORT_SECONDS, clock=time.monotonic):
        self.report = report or (lambda facts: log.info("progress %s", facts))
        self.seconds, self.clock, self.last = seconds, clock, None

    def seen(self, facts: dict) -> None:
        now = self.clock()
        if self.last is None or now - self.last >= self.seconds:
            self.last = now
            self.report(facts)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.seen({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_a_second": p.processedRowsPerSecond, "ms": dict(p.durationMs)})

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def failing(rows: DataFrame, stage: str, frame: int, index: str = "frame_index") -> DataFrame:
    """Rows that end in an error of the named stage at a frame: for tests."""
    error = F.raise_error(F.concat(F.lit(f"{stage} failed at frame "), F.col(index).cast("string"))).cast(dict(rows.dtypes)[index])
    return rows.withColumn(index, F.when(F.col(index) == frame, error).otherwise(F.col(index)))


def stalling(rows: DataFrame, frame: int, seconds: float, index: str = "frame_index") -> DataFrame:
    """The same rows, late: a batch that holds the frame waits so long first. For tests."""

    def wait(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if (pdf[index] == frame).any():
                time.sleep(seconds)
            yield pdf

    return rows.mapInPandas(wait, rows.schema)
