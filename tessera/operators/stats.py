"""Run statistics and acceptance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("decode", "preprocess", "inference", "tracking", "render")


def mean_or_zero(x) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def nearest_rank(x: str, share: float) -> Column:
    """The nearest-rank percentile of the numbers, 0 if there is none. NaN is no number."""
    return F.coalesce(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {x}) FILTER (WHERE NOT isnan({x}))").cast("double"), F.lit(0.0))


def stage_stats(frames: DataFrame, key: str = "source") -> DataFrame:
    """key, stage, mean_ms, p95_ms from one column <stage>_ms each."""
    pairs = ", ".join(f"'{s}', {s}_ms" for s in STAGES)
    long = frames.select(key, F.expr(f"stack({len(STAGES)}, {pairs}) AS (stage, ms)"))
    return long.groupBy(key, "stage").agg(mean_or_zero("ms").alias("mean_ms"), nearest_rank("ms", 0.95).alias("p95_ms"))


def slowest_stage(stats: DataFrame, key: str = "source") -> DataFrame:
    """The stage of the largest mean; of equal ones the last in pipeline order."""
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    return stats.groupBy(key).agg(F.max_by("stage", F.struct("mean_ms", place)).alias("slowest_stage"))


def queue_stats(frames: DataFrame, key: str = "source") -> DataFrame:
    """Mean and peak depth, and the share of frames at capacity."""
    at = F.when((F.col("capacity") > 0) & (F.col("depth") == F.col("capacity")), 1.0).otherwise(0.0)
    return frames.groupBy(key).agg(mean_or_zero("depth").alias("mean_depth"), mean_or_zero(at).alias("fraction_at_capacity"), F.max("depth").alias("peak_depth"))


def allocation_share(frames: DataFrame, key: str = "source") -> DataFrame:
    total = lambda *stages: F.sum(sum((F.col(f"{s}_ms") for s in stages[1:]), F.col(f"{stages[0]}_ms")))
    all_ = total("decode", "preprocess", "inference", "tracking")
    return frames.groupBy(key).agg(F.when(all_ > 0, 100 * total("decode", "preprocess") / F.when(all_ > 0, all_)).otherwise(0.0).alias("share_percent"))


def identity_churn(tracks: DataFrame, key: str = "source", frames_in_pass: DataFrame | None = None) -> DataFrame:
    """Confirmed ids for each 100 frames that have one; or of all frames, if these are given (key, frames)."""
    seen = tracks.filter("state = 'confirmed'").groupBy(key).agg(F.countDistinct("track_id").alias("ids"), F.countDistinct("frame_index").alias("frames"))
    if frames_in_pass is not None:
        seen = seen.drop("frames").join(frames_in_pass, key)
    return seen.withColumn("churn", 100.0 * F.col("ids") / F.col("frames"))


def confirmed_per_frame(frames: DataFrame, tracks: DataFrame, key=("source", "frame_index")) -> DataFrame:
    """Frames without tracks count 0."""
    n = tracks.groupBy(*key).agg(F.count_if(F.col("state") == "confirmed").alias("n"))
    return frames.select(*key).join(n, list(key), "left").select(*key, F.coalesce("n", F.lit(0)).alias("confirmed_tracks"))


def gap_sessions(events: DataFrame, key: str, at_ms: str, gap_ms: float = 1000.0) -> DataFrame:
    """Runs of rows without a gap above gap_ms: key, session, first and last time, rows. A gap of gap_ms itself doesn't end a run."""
    order = Window.partitionBy(key).orderBy(at_ms)
    new = F.when(F.col(at_ms) - F.lag(at_ms).over(order) > gap_ms, 1).otherwise(0)
    marked = events.select(key, at_ms, new.alias("new")).withColumn("session", F.sum("new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.min(at_ms).alias("first_ms"), F.max(at_ms).alias("last_ms"), F.count("*").alias("n"))


def rolling_fps(frames: DataFrame, key: str = "source", index: str = "frame_index", ms: str = "media_ms") -> DataFrame:
    """Rates over spans that end with the first frame a second or more after the span's start.

    Each span starts where the last ended, so the ends are found by a fold over a source's times.
    """
    times = frames.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(ms).cast("double").alias("t")))).alias("s"))
    empty = F.array().cast("array<struct<i:bigint,fps:double>>")
    start = F.struct(F.get("s", F.lit(0))["t"].alias("since"), F.lit(0).cast("long").alias("n"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        n, took = acc["n"] + 1, x["t"] - acc["since"]
        full = took >= 1000
        rate = F.struct(x["i"].cast("long").alias("i"), (n * 1000 / F.when(took > 0, took)).cast("double").alias("fps"))
        return F.struct(F.when(full, x["t"]).otherwise(acc["since"]).alias("since"), F.when(full, F.lit(0).cast("long")).otherwise(n).alias("n"), F.when(full, F.concat(acc["out"], F.array(rate))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), start, step, lambda acc: acc["out"])
    return times.select(key, F.explode(found).alias("r")).select(key, F.col("r.i").alias(index), F.col("r.fps").alias("fps"))


def run_summary(frames: DataFrame, key: str = "source") -> DataFrame:
    """One row per run: frames, mean and nearest-rank p95 of each stage, the slowest stage, queue figures and the allocation share."""
    stages = stage_stats(frames, key)
    wide = stages.groupBy(key).pivot("stage", list(STAGES)).agg(F.first("mean_ms").alias("mean_ms"), F.first("p95_ms").alias("p95_ms"))
    counts = frames.groupBy(key).agg(F.count("*").alias("frames"))
    return counts.join(wide, key).join(slowest_stage(stages, key), key).join(queue_stats(frames, key), key).join(allocation_share(frames, key), key)


def median_of_runs(runs: DataFrame, value: str, key: str = "source") -> DataFrame:
    """The middle run's value of each key, between the two middle ones for an even number; NaN and null runs don't count."""
    real = runs.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return real.groupBy(key).agg(F.count("*").alias("runs"), F.median(value).alias("median"))


def queue_depths(events: DataFrame, capacity: int, key: str = "source", index: str = "frame_index", change: str = "change") -> DataFrame:
    """The depth of a queue after each event: change is 1 for an arrival, -1 for a take.

    A take from an empty queue waits, so the depth is the running sum above its own lowest value so far. A depth
    above the capacity marks an arrival that a bounded queue would have held back.
    """
    upto = Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_sum", F.sum(change).over(upto))
    rows = rows.withColumn("depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto)))
    return rows.withColumn("held_back", F.col("depth") > capacity).drop("_sum")


def soak_verdict(samples: DataFrame, key: str = "run", every_s: float = 30.0) -> DataFrame:
    """Checks of a sampled run: gaps within 2 s of the period, bounded memory growth, no steady rise in the last five samples."""
    order = Window.partitionBy(key).orderBy("elapsed_s")
    back = Window.partitionBy(key).orderBy(F.desc("elapsed_s"))
    rows = samples.withColumns(
        {
            "gap_ok": F.coalesce(F.abs(F.col("elapsed_s") - F.lag("elapsed_s").over(order) - every_s) <= 2, F.lit(True)),
            "rss_up": F.col("rss_kb") > F.lag("rss_kb").over(order),
            "live_up": F.col("live") > F.lag("live").over(order),
            "k": F.row_number().over(back),
        }
    )
    last = F.col("k") <= 4
    first_rss, final_rss = F.min_by("rss_kb", "elapsed_s"), F.max_by("rss_kb", "elapsed_s")
    rise = lambda up: F.count_if(last & ~F.col(up)) == 0  # noqa: E731  of the last four steps, or as many as there are
    out = rows.groupBy(key).agg(
        F.count("*").alias("samples"),
        F.bool_and("gap_ok").alias("gaps_ok"),
        (final_rss <= first_rss + F.greatest(first_rss * 0.05, F.lit(10240.0))).alias("rss_ok"),
        (~rise("rss_up")).alias("rss_steady"),
        (~rise("live_up")).alias("live_steady"),
        F.min("live").alias("min_live"),
        F.max("live").alias("max_live"),
    )
    return out.withColumn("passed", F.col("gaps_ok") & F.col("rss_ok") & F.col("rss_steady") & F.col("live_steady"))


def dump_differences(left: DataFrame, right: DataFrame, line: str = "line_no", text: str = "line") -> DataFrame:
    """Lines that differ by number, with both texts; no row means parity."""
    a, b = left.select(line, F.col(text).alias("left_line")), right.select(line, F.col(text).alias("right_line"))
    return a.join(b, line, "full_outer").filter(~F.col("left_line").eqNullSafe(F.col("right_line")))


def hit_rate(expected: DataFrame, results: DataFrame, k: int, threshold: float = 0.8) -> DataFrame:
    """expected: query_id, path, symbol (null: any); results: query_id, rank, path, symbol. A query passes if all it expects is among its first k."""
    top = results.filter(F.col("rank") <= k).select("query_id", F.col("path").alias("r_path"), F.col("symbol").alias("r_symbol"))
    want = expected.withColumn("e", F.monotonically_increasing_id()) if "e" not in expected.columns else expected
    match = (want["query_id"] == top["query_id"]) & (want["path"] == top["r_path"]) & (want["symbol"].isNull() | (want["symbol"] == top["r_symbol"]))
    hits = want.join(top, match, "left_semi").select("e").withColumn("hit", F.lit(True))
    per = want.join(hits, "e", "left").groupBy("query_id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("passed"))
    return per.agg(F.count("*").alias("queries"), F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(1.0)).alias("rate")).withColumn("ok", F.col("rate") >= threshold)
