"""Frame time: stamps that never go back, replay, bounds and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import finite

#: Milliseconds between frames where no rate is known.
FALLBACK_MS = 1000.0 / 30.0


def usable_rate(fps: Column) -> Column:
    return F.when(finite(fps) & (fps > 0), fps)


def usable_time(ms: Column) -> Column:
    return F.when(finite(ms) & (ms >= 0), ms)


def stamp(frames: DataFrame, source: str = "source", index: str = "frame_index", reported: str = "reported_ms", fps: str = "fps") -> DataFrame:
    """Adds media_ms, time_source and adjusted.

    A usable reported time counts, else the index over a usable rate, else the index at 30 frames a
    second. A time before its predecessor's is held at that, and marked. Holding makes the last stamp a
    running maximum, so that a window gives it without state.
    """
    told, rate = usable_time(F.col(reported)), usable_rate(F.col(fps))
    raw = F.coalesce(told, F.col(index) / rate * 1000, F.col(index) * F.lit(FALLBACK_MS))
    kind = F.when(told.isNotNull(), "reported").when(rate.isNotNull(), "derived_from_frame_rate").otherwise("derived_from_index")
    order = Window.partitionBy(source).orderBy(index)
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    out = frames.withColumn("_raw", raw).withColumn("time_source", kind)
    return out.withColumns({"media_ms": F.max("_raw").over(upto), "adjusted": F.coalesce(F.col("_raw") < F.max("_raw").over(before), F.lit(False))}).drop("_raw")


def summary(stamped: DataFrame, source: str = "source", index: str = "frame_index") -> DataFrame:
    """Frames, last stamp, counts by provenance and adjustments of each source."""
    of = lambda kind: F.count_if(F.col("time_source") == kind)
    return stamped.groupBy(source).agg(
        F.count("*").alias("frame_count"),
        F.max_by("media_ms", index).alias("last_ms"),
        of("reported").alias("reported"),
        of("derived_from_frame_rate").alias("derived_from_frame_rate"),
        of("derived_from_index").alias("derived_from_index"),
        F.count_if("adjusted").alias("adjustments"),
    )


def classify_reads(frames: DataFrame, source: str = "source", index: str = "frame_index", ok: str = "read_ok", empty: str = "is_empty") -> DataFrame:
    """Frames up to the first bad read of each source; a bad first read is an error."""
    bad = ~F.col(ok) | F.col(empty)
    upto = Window.partitionBy(source).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy(source).orderBy(index)
    out = frames.withColumn("_bad", F.max(bad).over(upto)).withColumn("_first", F.row_number().over(first) == 1)
    failed = F.raise_error(F.concat(F.lit("source can't be decoded: "), F.col(source).cast("string"))).cast("boolean")
    return out.filter(F.when(F.col("_first") & bad, failed).otherwise(~F.col("_bad"))).drop("_bad", "_first")


def replay(stamped: DataFrame, passes: int, source: str = "source", index: str = "frame_index", interval_ms: float = FALLBACK_MS) -> DataFrame:
    """The frames of each source so many times over, with running indexes; pass k starts one interval after the last stamp of pass k - 1.

    Only the pass number is exploded; per source the length and the last stamp are joined, one row each.
    """
    ends = stamped.groupBy(source).agg(F.count("*").alias("_n"), F.max("media_ms").alias("_last"))
    out = stamped.join(ends, source).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    return out.withColumn(index, F.col(index) + F.col("pass") * F.col("_n")).withColumn("media_ms", F.col("media_ms") + F.col("pass") * (F.col("_last") + interval_ms)).drop("_n", "_last")


def bounded_time(stamped: DataFrame, loop_for_ms: float, source: str = "source") -> DataFrame:
    """Frames of the replays that begin a run no longer than loop_for_ms: those stamped before that time after the source's first frame."""
    first = F.min("media_ms").over(Window.partitionBy(source))
    return stamped.withColumn("_first", first).filter(F.col("media_ms") - F.col("_first") < loop_for_ms).drop("_first")


def bounded(frames: DataFrame, max_frames: int, index: str = "frame_index") -> DataFrame:
    """Frames before a limit, counted over replays."""
    return frames.filter(F.col(index) < max_frames)
