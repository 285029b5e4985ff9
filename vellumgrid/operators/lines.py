"""Text regions to lines: consecutive regions of about one height, ordered by x."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumgrid.functions import geometry as G
from vellumgrid.operators.merge import merge_lines


def with_lines(df: DataFrame, block: list[str], order: str = "contour_idx", tolerance: float = 10.0) -> DataFrame:
    """df(block..., contour_idx, bbox) with line_id and x_rank.

    A line goes on while the centre moves less than the tolerance from the
    region before, in contour order; within a line regions go by centre x.
    """
    w = W.partitionBy(*block).orderBy(order)
    df = df.withColumn("_cy", G.center_y(F.col("bbox")))
    step = F.abs(F.col("_cy") - F.lag("_cy").over(w))
    df = df.withColumn("_new", F.when(step >= G.f32(tolerance), 1).otherwise(0))
    df = df.withColumn("line_id", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    by_x = W.partitionBy(*block, "line_id").orderBy(G.center_x(F.col("bbox")), order)
    return df.withColumn("x_rank", (F.row_number().over(by_x) - 1).cast("int")).drop("_cy", "_new")


def merged_lines(df: DataFrame, block: list[str], order: str = "contour_idx", tolerance: float = 10.0, gap: float = 10.0) -> DataFrame:
    """(block..., det_ord, line_id, proba, bbox): lines merged and flattened in line order."""
    got = merge_lines(with_lines(df, block, order, tolerance), [*block, "line_id"], gap=gap)
    w = W.partitionBy(*block).orderBy("line_id", "x_rank")
    return got.withColumn("det_ord", (F.row_number().over(w) - 1).cast("int")).select(*block, "det_ord", "line_id", "proba", "bbox")
