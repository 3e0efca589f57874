"""Command line: track the frames of a folder of images and write the track dump.

    python -m tessera.cli FRAMES --model MODEL.onnx [--track-dump PATH] [--max-frames N] [--loop-for-seconds N]
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import clock, detect, inference, tracking
from tessera.sources import files

# Fixed value: where the model is looked for.
DEFAULT_MODEL = "models/yolov8n.onnx"


def positive(text: str) -> int:
    """A whole number above zero in decimal digits."""
    if not (text.isascii() and text.isdigit() and int(text) > 0):
        raise argparse.ArgumentTypeError("expected positive integer")
    return int(text)


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser("tessera", description="Track objects in the frames of a source.", allow_abbrev=False)
    made.add_argument("video", metavar="<video>", help="folder of images, a subfolder a source")
    made.add_argument("--model", default=DEFAULT_MODEL, help="ONNX detector (default: %(default)s)")
    made.add_argument("--loop-for-seconds", type=positive, metavar="N", help="replay the input until so much media time has passed")
    made.add_argument("--track-dump", metavar="PATH", help="write track records here")
    made.add_argument("--max-frames", type=positive, metavar="N", help="stop after so many frames of a source")
    return made


def parse(argv: list[str]) -> argparse.Namespace:
    """The options; a wrong, unknown, missing or further argument ends with status 2, unless help is asked for anywhere."""
    if "-h" in argv or "--help" in argv:
        argv = ["--help"]
    return parser().parse_args(argv)


def check(options: argparse.Namespace) -> None:
    """The input is a folder that is there, the model a regular file; an error names the argument and the path."""
    if not os.path.isdir(options.video):
        raise ValueError(f"video path does not exist or is not a folder of frames: {options.video}")
    if not os.path.isfile(options.model):
        raise ValueError(f"model path does not exist or is not a regular file: {options.model}")


def tracked(frames: DataFrame, model, max_frames: int | None = None, loop_for_ms: float | None = None) -> DataFrame:
    """Tracks of read frames (as files.read_frames gives them): source is numbered by name, its name stays as source_name.

    Replays repeat the frames' detections, as the model gives the same ones again; the tracker goes on over them.
    """
    good = clock.classify_reads(frames)
    names = good.select("source").distinct().withColumn("number", F.row_number().over(Window.orderBy("source")).cast("long"))
    stamped = clock.stamp(good.withColumns({"reported_ms": F.lit(None).cast("double"), "fps": F.lit(None).cast("double")}))
    if loop_for_ms is None and max_frames is not None:
        stamped = clock.bounded(stamped, max_frames)
    found = detect.suppressed(inference.candidates_of(stamped, model)).select("source", F.col("frame_index").alias("of"), "det_idx", "class_id", F.col("confidence").cast("double").alias("confidence"), *[F.col(c).cast("double").alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])
    times = stamped.select("source", "frame_index", F.col("frame_index").alias("of"), "media_ms")
    if loop_for_ms is not None:
        shortest = times.groupBy("source").agg((F.max("media_ms") + clock.FALLBACK_MS).alias("ms")).agg(F.min("ms")).first()[0]
        times = clock.bounded_time(clock.replay(times, int(loop_for_ms // (shortest or loop_for_ms)) + 1), loop_for_ms)
        times = clock.bounded(times, max_frames) if max_frames is not None else times
    detections = times.drop("media_ms").join(found, ["source", "of"]).drop("of")
    numbered = lambda rows: rows.join(names, "source").drop("source").withColumnRenamed("number", "source")
    out = tracking.track(numbered(detections), numbered(times.drop("of")))
    return out.join(names.select(F.col("number").alias("source"), F.col("source").alias("source_name")), "source")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = parse(sys.argv[1:] if argv is None else argv)
    try:
        check(options)
        spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
        loop_ms = options.loop_for_seconds * 1000.0 if options.loop_for_seconds else None
        tracks = tracked(files.read_frames(spark, options.video), inference.onnx_model(options.model), options.max_frames, loop_ms)
        if options.track_dump:
            files.write_dump(tracks, options.track_dump)
        else:
            tracks.groupBy("source_name").agg(F.countDistinct("frame_index").alias("frames"), F.countDistinct("track_id").alias("tracks")).show()
    except Exception as e:  # noqa: BLE001  a user sees the reason, not a trace
        print(f"error: {str(e).strip().splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
