"""Pages as JSON rows: {"layouts": [...], "metadata": {...}}, vectors as pairs, labels by their JSON name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_json(elements: DataFrame, pages: DataFrame, page: list[str]) -> DataFrame:
    """elements(page..., order_idx, bbox, json_name, bbox_id, proba, is_ocr, text), pages(page..., pdf_w, pdf_h, image_w, image_h, scale) -> (page..., json).

    Null members are written as null; a page without elements has an empty list.
    """
    no = F.col(page[-1]).cast("int")
    item = F.struct(
        F.col("order_idx").alias("o"),
        F.struct(
            F.struct(F.array("bbox.x0", "bbox.y0").alias("min"), F.array("bbox.x1", "bbox.y1").alias("max")).alias("bbox"),
            F.col("json_name").alias("label"), no.alias("page_no"), "bbox_id", "proba", F.when(F.col("is_ocr").isNotNull(), F.struct("is_ocr")).alias("ocr"), "text",
        ).alias("e"),
    )
    lists = elements.groupBy(*page).agg(F.transform(F.array_sort(F.collect_list(item), lambda a, b: a["o"] - b["o"]), lambda x: x["e"]).alias("layouts"))
    meta = F.struct(F.array("pdf_w", "pdf_h").alias("pdf_size"), F.array("image_w", "image_h").alias("image_size"), "scale", no.alias("page"))
    met = pages.join(lists, page, "left").withColumn("metadata", meta)
    empty = F.array().cast(lists.schema["layouts"].dataType)
    return met.select(*page, F.to_json(F.struct(F.coalesce("layouts", empty).alias("layouts"), "metadata"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON document a line, in the order of the other columns: documents and their pages, over all files."""
    keys = [c for c in rows.columns if c != "json"]
    ordered = rows.orderBy(*keys) if keys else rows
    ordered.select(F.col("json").alias("value")).write.mode("overwrite").text(path)
