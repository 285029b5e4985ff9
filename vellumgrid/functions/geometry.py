"""Box geometry as columns.  Every value is FLOAT (f32): literals and quotients are cast,
because a double threshold or quotient would move the boundary of a comparison.

A box is a struct (x0, y0, x1, y1).  Nothing here checks that x0 <= x1: clamping
a box that lies outside gives an inverted one, and its area keeps its sign.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x0:float,y0:float,x1:float,y1:float>"


def f32(x: "Column | float | int | str") -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("float")


def box(x0, y0, x1, y1) -> Column:
    return F.struct(f32(x0).alias("x0"), f32(y0).alias("y0"), f32(x1).alias("x1"), f32(y1).alias("y1"))


def from_min_size(x, y, w, h) -> Column:
    return box(x, y, f32(x) + f32(w), f32(y) + f32(h))


def from_center_size(cx, cy, w, h) -> Column:
    cx, cy, dx, dy = f32(cx), f32(cy), f32(w) * f32(0.5), f32(h) * f32(0.5)
    return box(cx - dx, cy - dy, cx + dx, cy + dy)


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) * f32(0.5)


def center_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) * f32(0.5)


def center(b: Column) -> Column:
    return F.struct(center_x(b).alias("x"), center_y(b).alias("y"))


def intersection(a: Column, b: Column) -> Column:
    """Area in common; touching boxes have none."""
    dx = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    dy = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((dx > f32(0)) & (dy > f32(0)), dx * dy).otherwise(f32(0))


def iou(a: Column, b: Column) -> Column:
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when(u > f32(0), f32(i / u)).otherwise(f32(0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Area in common over the smaller area."""
    m = F.least(area(a), area(b))
    return F.when(m > f32(0), f32(intersection(a, b) / m)).otherwise(f32(0))


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def contains(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def clamp(b: Column, x0, y0, x1, y1) -> Column:
    """The minimum corner is held from below, the maximum corner from above."""
    return box(F.greatest(b["x0"], f32(x0)), F.greatest(b["y0"], f32(y0)), F.least(b["x1"], f32(x1)), F.least(b["y1"], f32(y1)))


def scale(b: Column, s) -> Column:
    """About the origin."""
    s = f32(s)
    return box(b["x0"] * s, b["y0"] * s, b["x1"] * s, b["y1"] * s)


def translate(b: Column, dx, dy) -> Column:
    dx, dy = f32(dx), f32(dy)
    return box(b["x0"] + dx, b["y0"] + dy, b["x1"] + dx, b["y1"] + dy)


def to_cartesian(b: Column, page_height) -> Column:
    h = f32(page_height)
    return box(b["x0"], h - b["y1"], b["x1"], h - b["y0"])


def to_pdf_rect(b: Column, page_height) -> Column:
    """Bottom-left origin, as a PDF text lookup needs it."""
    h = f32(page_height)
    return F.struct((h - b["y1"]).alias("bottom"), b["x0"].alias("left"), (h - b["y0"]).alias("top"), b["x1"].alias("right"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean gap between two boxes, 0 where they overlap."""
    gap = lambda lo, hi: F.greatest(b[lo] - a[hi], a[lo] - b[hi], f32(0))
    dx, dy = gap("x0", "x1"), gap("y0", "y1")
    return f32(F.sqrt((dx * dx + dy * dy).cast("double")))


def fit(w, h, target_w, target_h) -> Column:
    """Scale that fits (w, h) into the target, and the size rounded half away from zero."""
    s = F.least(f32(f32(target_w) / f32(w)), f32(f32(target_h) / f32(h)))
    return F.struct(s.alias("scale"), f32(F.round(f32(w) * s)).alias("w"), f32(F.round(f32(h) * s)).alias("h"))


def fit_truncated(w, h, target_w, target_h) -> Column:
    """As fit, but the size is cut to integers, at least 0 (the detector's rule)."""
    s = F.least(f32(f32(target_w) / f32(w)), f32(f32(target_h) / f32(h)))
    return F.struct(s.alias("scale"), whole(f32(w) * s).alias("w"), whole(f32(h) * s).alias("h"))


def fit_height(w, h, target_h) -> Column:
    """Width of a line image brought to the recogniser's height."""
    return whole(f32(w) * f32(f32(target_h) / f32(h)))


def whole(x: Column, most: int = 2_147_483_000) -> Column:
    """Float to non-negative integer: truncated, saturated, NaN to 0."""
    return F.when(F.isnan(x), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(most), F.floor(F.greatest(f32(0), F.least(x, f32(most)))).cast("int"))))


def crop_rect(b: Column, image_w, image_h) -> Column:
    """Integer rectangle of a box on an image: clamped, truncated, at least one
    pixel wide and high, no more than is left of the image; blank where nothing is left."""
    iw, ih = f32(image_w), f32(image_h)
    held = clamp(b, 0, 0, iw, ih)
    x, y = whole(held["x0"]), whole(held["y0"])
    w = F.least(whole(F.greatest(width(held), f32(1))), F.greatest(whole(iw) - x, F.lit(0)))
    h = F.least(whole(F.greatest(height(held), f32(1))), F.greatest(whole(ih) - y, F.lit(0)))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), ((w <= 0) | (h <= 0)).alias("blank"))


def padded_bounds(min_x, min_y, max_x, max_y, orig_w, orig_h, resized_w, resized_h, padding) -> Column:
    """Bounds of a text region, brought back to the crop's pixels, padded and held inside it."""
    sx, sy, p = f32(f32(orig_w) / f32(resized_w)), f32(f32(orig_h) / f32(resized_h)), f32(padding)
    return box(
        F.greatest(f32(min_x) * sx - p, f32(0)), F.greatest(f32(min_y) * sy - p, f32(0)),
        F.least(f32(max_x) * sx + p, f32(orig_w)), F.least(f32(max_y) * sy + p, f32(orig_h)),
    )


def argmax_last(scores: Column) -> Column:
    """0-based index of the greatest score; of equal ones the last."""
    return F.size(scores) - F.array_position(F.reverse(scores), F.array_max(scores)).cast("int")
