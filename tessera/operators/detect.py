"""Candidates to detections: threshold, geometry, deterministic order, class-aware suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions.numeric import finite

LEAST_CONFIDENCE = 0.25
SUPPRESS_ABOVE = 0.70
KEY = ("source", "frame_index")


def best_class(scores: str) -> Column:
    """(class_id, confidence) of the highest score: the first of equal ones; NaN beats nothing but an opening one."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("class_id"), F.get(scores, F.lit(0)).alias("confidence"))

    def step(acc: Column, x: Column) -> Column:
        more = ~F.isnan(x) & ~F.isnan(acc["confidence"]) & (x > acc["confidence"])
        return F.struct((acc["at"] + 1).alias("at"), F.when(more, acc["at"]).otherwise(acc["class_id"]).alias("class_id"), F.when(more, x).otherwise(acc["confidence"]).alias("confidence"))

    return F.aggregate(scores, start, step, lambda acc: F.struct(acc["class_id"].alias("class_id"), acc["confidence"].alias("confidence")))


def candidates(rows: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Rows of cx, cy, w, h, confidence that can be detections, with their sides."""
    ok = (F.col("w") > 0) & (F.col("h") > 0) & (F.col("confidence") >= least)
    for c in ("cx", "cy", "w", "h", "confidence"):
        ok = ok & finite(F.col(c))
    return rows.filter(ok).select("*", *G.named(G.from_center(*(F.col(c) for c in ("cx", "cy", "w", "h")))))


def order() -> list[Column]:
    return [F.desc("confidence"), F.asc("class_id"), *[F.asc(s) for s in G.SIDES]]


def ranked(detections: DataFrame, key=KEY) -> DataFrame:
    """det_idx from 0 within each frame, in the deterministic order."""
    return detections.withColumn("det_idx", F.row_number().over(Window.partitionBy(*key).orderBy(*order())) - 1)


def suppressed(detections: DataFrame, above: float = SUPPRESS_ABOVE, key=KEY) -> DataFrame:
    """Greedy suppression within class and frame, as a fold over each group's sorted boxes.

    A group is the boxes of one class in one frame, bounded by the model's output.
    """
    fields = ("confidence", *G.SIDES)
    boxes = F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("k"), *[F.col(s) for s in G.SIDES])))
    groups = detections.groupBy(*key, "class_id").agg(boxes.alias("boxes"))
    sides = lambda b: tuple(b[s] for s in G.SIDES)
    kind = groups.schema["boxes"].dataType.simpleString()
    kept = F.aggregate(
        "boxes",
        F.array().cast(kind),
        lambda acc, x: F.when(F.exists(acc, lambda k: G.iou(sides(k), sides(x)) > above), acc).otherwise(F.concat(acc, F.array(x))),
    )
    out = groups.select(*key, "class_id", F.explode(kept).alias("b"))
    return ranked(out.select(*key, "class_id", (-F.col("b.k")).alias("confidence"), *[F.col(f"b.{s}").alias(s) for s in fields[1:]]), key)


def iou_pairs(a: DataFrame, b: DataFrame, gate: float, on) -> DataFrame:
    """Pairs of two box tables with equal keys and an overlap above the gate; b's columns get a suffix _b."""
    other = b.select(*on, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in on])
    right = tuple(F.col(f"{s}_b") for s in G.SIDES)
    return a.join(other, list(on)).withColumn("iou", G.iou(G.box(), right)).filter(F.col("iou") > gate)


def unmatched(a: DataFrame, b: DataFrame, gate: float, on, index: str = "det_idx") -> DataFrame:
    """Rows of either table without a partner above the gate: the key, the index and the side (track, detection)."""
    key = [*on, index]
    pairs = iou_pairs(a, b, gate, on)
    left = a.join(pairs, key, "left_anti").select(*key, F.lit("track").alias("side"))
    right = b.join(pairs.select(*on, F.col(f"{index}_b").alias(index)), key, "left_anti").select(*key, F.lit("detection").alias("side"))
    return left.unionByName(right)


def nearest_track(detections: DataFrame, tracks: DataFrame, on, index: str = "det_idx") -> DataFrame:
    """The track whose centre is nearest to each detection's, the first of equally near ones: key, index, nearest, distance."""
    centre = lambda rows, name: rows.select(*on, F.col(index).alias(name), *[c.alias(f"{name}_{x}") for c, x in zip(G.center(G.box()), "xy")])
    both = centre(detections, index).join(centre(tracks, "nearest"), list(on))
    square = sum(F.pow(F.col(f"{index}_{x}") - F.col(f"nearest_{x}"), 2) for x in "xy")
    best = both.groupBy(*on, index).agg(F.min(F.struct(square.alias("d"), F.col("nearest"))).alias("m"))
    return best.select(*on, index, F.col("m.nearest").alias("nearest"), F.sqrt("m.d").alias("distance"))


def association_cost(overlap: Column, gate: float = 0.30, pad: float = 2.0) -> Column:
    return F.when(finite(overlap) & (overlap > gate), 1 - overlap).otherwise(F.lit(pad))
