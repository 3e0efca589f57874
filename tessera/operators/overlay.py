"""What a viewer would draw, as tables: boxes, labels and the metrics panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions.labels import label_text
from tessera.functions.numeric import finite, fixed, units


def format_ms(x: Column) -> Column:
    return F.when(finite(x), fixed(x, 1)).otherwise("--")


def format_depth(depth: Column, capacity: Column) -> Column:
    return F.concat_ws("/", depth.cast("string"), capacity.cast("string"))


def draw_list(tracks: DataFrame, frame_w: int, frame_h: int) -> DataFrame:
    """Boxes to draw: rounded and clamped sides, colour, thickness and label; lost tracks and empty boxes are left out."""
    sides = [F.round(s).cast("int") for s in G.box()]
    top = {0: frame_w, 1: frame_h, 2: frame_w, 3: frame_h}
    inside = [F.greatest(F.lit(0), F.least(s, F.lit(top[k]))) for k, s in enumerate(sides)]
    b, g, r = G.track_color(F.col("track_id"))
    confirmed = F.col("state") == "confirmed"
    rows = tracks.filter("state <> 'lost'").select("source", "frame_index", "track_id", "state", *G.named(inside), b.alias("blue"), g.alias("green"), r.alias("red"), F.when(confirmed, 2).otherwise(1).alias("thickness"), confirmed.alias("label_filled"), label_text(F.col("state"), F.col("class_id"), F.col("track_id"), units(F.col("confidence"), 2)).alias("label"))
    return rows.filter("x_max > x_min and y_max > y_min")


def panel_lines(metrics: DataFrame) -> DataFrame:
    """The eleven lines of the metrics panel for each frame; what is unknown shows as --."""
    ms = [F.concat(F.lit(f"{name}: "), format_ms(F.col(f"{name}_ms"))) for name in ("decode", "preprocess", "inference", "tracking", "render")]
    depth = [F.concat(F.lit(f"{name}: "), format_depth(F.col(f"{name}_depth"), F.col(f"{name}_capacity"))) for name in ("decoded", "prepared", "detected", "tracked")]
    rest = [F.concat(F.lit("fps: "), format_ms(F.col("fps"))), F.concat(F.lit("tracks: "), F.col("confirmed_tracks").cast("string"))]
    return metrics.select("source", "frame_index", F.array(*ms, *depth, *rest).alias("lines"))
