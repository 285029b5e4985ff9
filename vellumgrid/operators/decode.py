"""Model output to page elements: class arg-max, score filter, boxes in PDF points, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumgrid.functions import geometry as G
from vellumgrid.operators.options import LayoutOptions


def class_of(df: DataFrame, scores: str = "scores") -> DataFrame:
    """df with label_id (the last of equal maxima) and proba."""
    return df.withColumns({"label_id": G.argmax_last(F.col(scores)), "proba": F.array_max(scores).cast("float")})


def score_filter(df: DataFrame, least: float, proba: str = "proba") -> DataFrame:
    """Rows whose score is not below the threshold; NaN stays."""
    return df.where(~(F.col(proba) < F.lit(least).cast("float")))


def numbered(df: DataFrame, page: list[str], order: str, out: str = "bbox_id") -> DataFrame:
    """A running number from 0 within the page."""
    return df.withColumn(out, (F.row_number().over(W.partitionBy(*page).orderBy(order)) - 1).cast("int"))


def decode(raw: DataFrame, page: list[str], options: LayoutOptions = LayoutOptions()) -> DataFrame:
    """raw(page..., anchor_idx, cx, cy, w, h, scores, scale, image_w, image_h) -> (page..., bbox_id, label_id, proba, bbox).

    Filter first, then geometry: the score test prunes most anchors before any box is made.
    The box is held inside the image before it is brought back to PDF points.
    """
    kept = score_filter(class_of(raw), options.least_score)
    held = G.clamp(G.from_center_size("cx", "cy", "w", "h"), 0, 0, F.col("image_w"), F.col("image_h"))
    back = G.f32(G.f32(1) / G.f32("scale"))
    return numbered(kept.withColumn("bbox", G.scale(held, back)), page, "anchor_idx").select(*page, "bbox_id", "label_id", "proba", "bbox")


def overlap_pairs(df: DataFrame, page: list[str], key: str, least: float, name: str | None = None) -> DataFrame:
    """(page..., a, b, overlap): pairs of a page, a before b by key, whose overlap ratio exceeds least; with name, a and b are its values."""
    if name:
        got = overlap_pairs(df.withColumn("_k", F.struct(F.col(key).alias("k"), F.col(name).alias("n"))), page, "_k", least)
        return got.withColumns({"a": F.col("a.n"), "b": F.col("b.n")})
    left = df.select(*page, F.col(key).alias("a"), F.col("bbox").alias("ba"))
    right = df.select(*page, F.col(key).alias("b"), F.col("bbox").alias("bb"))
    met = left.join(right, page).where("a < b").withColumn("overlap", G.overlap_ratio(F.col("ba"), F.col("bb")))
    return met.where(F.col("overlap") > F.lit(least).cast("float")).select(*page, "a", "b", "overlap")
