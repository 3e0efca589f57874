"""Readers and writers: frames, source corpora, golden queries, the index and the track dump."""

from __future__ import annotations

import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import fixed

#: Version of the index layout; an index of another version is not read.
INDEX_VERSION = 1
# The track dump's header and formats.
DUMP_COLUMNS = ("frame_index", "media_ms", "track_id", "class_id", "state", "x_min", "y_min", "x_max", "y_max", "confidence")
SOAK = "elapsed_seconds double, rss_kb long, frame_count long, live_track_count int, confirmed_track_count int, decode_ms double, preprocess_ms double, inference_ms double, tracking_ms double, render_ms double, decoded_depth string, prepared_depth string, detected_depth string, tracked_depth string"


class Index(NamedTuple):
    """Chunks with what is known of their making; files_changed counts files that a former index did not reflect."""

    chunks: DataFrame
    built_at: datetime.datetime
    chunk_count: int
    reindexed: bool
    files_changed: int


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder as frames in the order of their names within each subfolder, which is the source."""
    images = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    parts = F.split("image.origin", "/")
    rows = images.select(F.element_at(parts, -2).alias("source"), F.element_at(parts, -1).alias("name"), "image.height", "image.width", "image.data", (F.col("image.nChannels") == 3).alias("read_ok"), (F.col("image.height") <= 0).alias("is_empty"))
    from pyspark.sql import Window

    return rows.withColumn("frame_index", F.row_number().over(Window.partitionBy("source").orderBy("name")) - 1)


def read_corpus(spark: SparkSession, root: str, patterns: tuple[str, ...]) -> DataFrame:
    """path (below root), content and mtime of files that any glob pattern names, each once."""
    out = None
    for glob in patterns:
        rows = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{glob}").select("path", "content", "modificationTime")
        out = rows if out is None else out.unionByName(rows)
    below = F.regexp_replace(F.col("path"), f"^.*?{root.strip('/')}/", "")
    return out.dropDuplicates(["path"]).select(below.alias("path"), F.decode("content", "UTF-8").alias("content"), F.unix_micros("modificationTime").alias("mtime_us"))


def read_golden(spark: SparkSession, path: str, phase: int) -> DataFrame:
    """Golden queries of the given phase or before; a phase of 3 or more takes all."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.filter(F.col("phase") <= phase) if phase < 3 else rows


def write_index(chunks: DataFrame, files: DataFrame, path: str) -> None:
    """The chunk table, the files it was made of and a one-row description, each as Parquet."""
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    files.select("path", "mtime_us").write.mode("overwrite").parquet(f"{path}/files")
    built = spark.range(1).select(F.lit(INDEX_VERSION).alias("version"), F.current_timestamp().alias("built_at"))
    count = spark.read.parquet(f"{path}/chunks").agg(F.count("*").alias("chunk_count"))
    built.join(F.broadcast(count)).write.mode("overwrite").parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The chunk table, or None for a missing index or another version."""
    from pyspark.errors import AnalysisException

    try:
        meta = spark.read.parquet(f"{path}/meta").first()
        return spark.read.parquet(f"{path}/chunks") if meta and meta["version"] == INDEX_VERSION else None
    except AnalysisException:
        return None


def staleness(indexed: DataFrame, current: DataFrame, tolerance_us: int = 1) -> DataFrame:
    """path and change (added, removed, changed) of files that an index does not reflect."""
    a, b = indexed.select("path", F.col("mtime_us").alias("was")), current.select("path", F.col("mtime_us").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") > F.col("was") + tolerance_us, "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).filter("change is not null")


def load_index(spark: SparkSession, path: str, files: DataFrame, build, force: bool = False) -> Index:
    """The index at path, built anew from files if that is forced or the index is missing, stale or of another version."""
    found = None if force else read_index(spark, path)
    changed = staleness(spark.read.parquet(f"{path}/files"), files).count() if found is not None else 0
    anew = found is None or changed > 0
    if anew:
        write_index(build(files), files, path)
        found = read_index(spark, path)
    meta = spark.read.parquet(f"{path}/meta").first()
    return Index(found, meta["built_at"], meta["chunk_count"], anew, changed)


def refreshed(spark: SparkSession, path: str, files: DataFrame, build, force: bool = False) -> DataFrame:
    """The chunks of load_index."""
    return load_index(spark, path, files, build, force).chunks


def dump_lines(tracks: DataFrame) -> DataFrame:
    """source, frame_index, track_id and the dump line of each track. Numbers are rounded as exact binary values, half to even."""

    digits = {"media_ms": 3, "x_min": 3, "y_min": 3, "x_max": 3, "y_max": 3, "confidence": 4}
    shown = [fixed(F.col(c), digits[c]) if c in digits else F.col(c).cast("string") for c in DUMP_COLUMNS]
    return tracks.select("source", "frame_index", "track_id", F.concat(*[x for c in shown for x in (F.lit(","), c)][1:]).alias("line"))


def write_dump(tracks: DataFrame, path: str) -> None:
    """A CSV folder for each source in frame and track order; files of one source follow each other by range."""
    lines = dump_lines(tracks).repartitionByRange("source", "frame_index").sortWithinPartitions("source", "frame_index", "track_id")
    header = ",".join(DUMP_COLUMNS)
    lines.select("source", F.col("line").alias(header)).write.mode("overwrite").partitionBy("source").option("header", True).option("quote", "").csv(path)


def read_soak(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a sustained run."""
    return spark.read.schema(SOAK).option("header", True).csv(path)
