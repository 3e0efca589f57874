"""Boxes as Column expressions. A box is four columns x_min, y_min, x_max, y_max, with an optional prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.numeric import finite, ratio

#: Edge of the model's square input, in pixels.
INPUT_SIZE = 640
SIDES = ("x_min", "y_min", "x_max", "y_max")


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + s) for s in SIDES)


def named(sides, prefix: str = "") -> list[Column]:
    return [c.alias(prefix + s) for c, s in zip(sides, SIDES)]


def from_center(cx, cy, w, h):
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def width(b) -> Column:
    return b[2] - b[0]


def height(b) -> Column:
    return b[3] - b[1]


def area(b) -> Column:
    return width(b) * height(b)


def center(b) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def aspect(b) -> Column:
    return ratio(width(b), height(b))


def valid(b) -> Column:
    ok = (b[2] > b[0]) & (b[3] > b[1])
    for side in b:
        ok = finite(side) & ok
    return F.coalesce(ok, F.lit(False))


def clamped(b, w, h):
    """Sides within [0, w] and [0, h]."""
    inside = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    return inside(b[0], w), inside(b[1], h), inside(b[2], w), inside(b[3], h)


def clamped_or_null(b, w, h) -> Column:
    c = clamped(b, w, h)
    return F.when(valid(c), F.struct(*named(c)))


def iou(a, b) -> Column:
    """Intersection over union; 0 where either is not positive."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both / F.when(union > 0, union)).otherwise(F.lit(0.0))


def letterbox(w: Column, h: Column, size: int = INPUT_SIZE) -> dict[str, Column]:
    """scale (single precision), resized sides and left and top pads; the odd pixel goes right or below."""
    scale = F.least(F.lit(size).cast("float") / w.cast("float"), F.lit(size).cast("float") / h.cast("float")).cast("float")
    rw = F.round((w.cast("float") * scale).cast("float")).cast("int")
    rh = F.round((h.cast("float") * scale).cast("float")).cast("int")
    half = lambda r: F.floor((F.lit(size) - r) / 2).cast("int")
    return {"scale": scale, "resized_width": rw, "resized_height": rh, "pad_left": half(rw), "pad_top": half(rh)}


def restored(b, scale: Column, left: Column, top: Column, w: Column, h: Column):
    """From model input to source pixels, clamped to the source."""
    back = lambda v, pad: (v - pad) / scale
    return clamped((back(b[0], left), back(b[1], top), back(b[2], left), back(b[3], top)), w, h)


def track_color(track_id: Column) -> tuple[Column, Column, Column]:
    """b, g, r of a hue that steps by the golden ratio, at fixed saturation and value."""
    turn = track_id.cast("double") * 0.61803398875
    hue = (turn - F.floor(turn)) * 360
    chroma, value = 0.9 * 0.8, 0.9
    sextant = hue / 60
    part = F.lit(chroma) * (1 - F.abs(sextant - 2 * F.floor(sextant / 2) - 1))
    at = F.floor(sextant).cast("int")
    full, none = F.lit(chroma), F.lit(0.0)
    pick = lambda *six: F.element_at(F.array(*six), F.least(at, F.lit(5)) + 1)
    red, green, blue = pick(full, part, none, none, part, full), pick(part, full, full, part, none, none), pick(none, none, part, full, full, part)
    level = lambda c: (c + (value - chroma)) * 255
    return level(blue), level(green), level(red)


def label_origin(left: Column, top: Column, bottom: Column, w: Column, h: Column, frame_w: Column, frame_h: Column, panel: tuple[int, int] = (250, 280)) -> tuple[Column, Column]:
    """Left and top of a label of w by h: above its box, else below, kept inside the frame.

    A label that starts within the metrics panel goes below its box, as far as the frame allows.
    """
    zero = F.lit(0)
    inside = lambda v, room: F.greatest(F.least(v, room), zero)
    x = inside(left, frame_w - w)
    y = inside(F.when(top - h < 0, bottom).otherwise(top - h), frame_h - h)
    return x, F.when((x < panel[0]) & (y < panel[1]), inside(bottom, frame_h - h)).otherwise(y)
