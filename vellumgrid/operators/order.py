"""Reading order of a page: one column or two, and the order within each.

All of it is windows over the page: page-wide extremes and counts, a line number
from the gap to the box above, and a row number.  The default order opens a new
line where the vertical step exceeds the tolerance; it equals pairwise
comparison wherever a chain of close boxes lies within one tolerance, and is
deterministic where pairwise comparison would contradict itself.  mode
"pairwise" sorts by insertion with that comparison instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumgrid.functions import geometry as G
from vellumgrid.functions.labels import PAGE_FOOTER, PAGE_HEADER, TITLE


def with_columns(df: DataFrame, page: list[str]) -> DataFrame:
    """df(page..., label_id, bbox) with multi_column (bool) and col_id (0 left, 1 right)."""
    w = W.partitionBy(*page)
    cx = G.center_x(F.col("bbox"))
    lo, hi = F.min("_cx").over(w), F.max("_cx").over(w)
    df = df.withColumn("_cx", cx).withColumns({"_n": F.count("*").over(w), "_lo": lo, "_span": hi - lo, "_x0": F.min("bbox.x0").over(w), "_x1": F.max("bbox.x1").over(w)})
    middle = F.col("_lo") + G.f32(F.col("_span") / G.f32(2))
    df = df.withColumn("_left", F.sum(F.when(F.col("_cx") < middle, 1).otherwise(0)).over(w))
    quarter = F.floor(F.col("_n") / 4)
    many = (F.col("_n") >= 4) & ~(F.col("_span") < G.f32(100)) & (F.col("_left") >= quarter) & (F.col("_n") - F.col("_left") >= quarter)
    # half the used width, not shifted by its left edge
    mid = G.f32((F.col("_x1") - F.col("_x0")) / G.f32(2))
    third = G.f32(mid / G.f32(3))
    side = (
        F.when(F.col("label_id").isin(TITLE, PAGE_HEADER), 0).when(F.col("label_id") == PAGE_FOOTER, 1)
        .when((F.col("_cx") > mid - third) & (F.col("_cx") < mid + third), 0).when(F.col("_cx") < mid, 0).otherwise(1)
    )
    out = df.withColumn("multi_column", many)
    return out.withColumn("col_id", F.when(F.col("multi_column"), side).otherwise(0)).drop("_cx", "_n", "_lo", "_span", "_x0", "_x1", "_left")


def label_rank(label_id: Column) -> Column:
    return F.when(label_id == PAGE_HEADER, 0).when(label_id == TITLE, 1).when(label_id == PAGE_FOOTER, 3).otherwise(2)


def reading_order(df: DataFrame, page: list[str], prior: str = "rank", tolerance: float = 10.0, mode: str = "lines") -> DataFrame:
    """df(page..., bbox, label_id, prior) with order_idx, the place in the page from 0."""
    if mode == "pairwise":
        return _pairwise(df, page, prior, tolerance)
    if mode != "lines":
        raise ValueError(f"order mode {mode}")
    df = with_columns(df, page).withColumns({"_r": label_rank(F.col("label_id")), "_cx": G.center_x(F.col("bbox")), "_cy": G.center_y(F.col("bbox"))})
    column = W.partitionBy(*page, "col_id", "_r").orderBy("_cy", prior)
    step = F.col("_cy") - F.lag("_cy").over(column)
    df = df.withColumn("_new", F.when(F.col("_r") != 2, 1).when(step > G.f32(tolerance), 1).otherwise(0))
    df = df.withColumn("_line", F.sum("_new").over(column.rowsBetween(W.unboundedPreceding, 0)))
    key = F.when(F.col("_r") == 2, F.col("_cx")).otherwise(F.col("_cy"))
    place = F.row_number().over(W.partitionBy(*page).orderBy("col_id", "_r", "_line", key, prior)) - 1
    return df.withColumn("order_idx", place.cast("int")).drop("_r", "_cx", "_cy", "_new", "_line")


def _pairwise(df: DataFrame, page: list[str], prior: str, tolerance: float) -> DataFrame:
    """Stable insertion sort by pairwise comparison, page by page, over Arrow batches of whole pages."""
    df = with_columns(df, page)
    pages = df.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct(F.col("col_id").alias("c"), F.col(prior).alias("p"), label_rank(F.col("label_id")).alias("r"), G.center_x(F.col("bbox")).alias("x"), G.center_y(F.col("bbox")).alias("y")))).alias("a"))

    def after(a: dict, b: dict) -> bool:
        if a["r"] != b["r"]:
            return a["r"] > b["r"]
        if a["r"] != 2 or abs(np.float32(a["y"]) - np.float32(b["y"])) > np.float32(tolerance):  # steps are FLOAT, as all geometry
            return a["y"] > b["y"]
        return a["x"] > b["x"]

    @F.pandas_udf("array<struct<c:int,p:long,o:int>>")
    def sort(pages: pd.Series) -> pd.Series:
        out = []
        for items in pages:
            done: list[dict] = []
            for column in (0, 1):
                own: list[dict] = []
                for e in (x for x in items if x["c"] == column):
                    k = len(own)
                    while k and after(own[k - 1], e):
                        k -= 1
                    own.insert(k, e)
                done += own
            out.append([{"c": e["c"], "p": e["p"], "o": i} for i, e in enumerate(done)])
        return pd.Series(out)

    placed = pages.select(*page, F.explode(sort("a")).alias("e")).select(*page, F.col("e.p").alias(prior), F.col("e.o").alias("order_idx"))
    return df.join(placed.withColumn(prior, F.col(prior).cast(df.schema[prior].dataType)), [*page, prior])
