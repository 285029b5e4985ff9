"""Debug images as relations: what to draw on which page, and a writer for it."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions import geometry as G


def layout_commands(elements: DataFrame, page: list[str]) -> DataFrame:
    """elements(page..., order_idx, bbox, proba, scale, display_name, r, g, b) -> three nested rectangles and a caption each.

    Boxes of no whole pixel are skipped; the caption of a box that begins above the page is null.
    """
    b = F.col("_b")
    df = elements.withColumn("_b", G.scale(F.col("bbox"), F.col("scale")))
    df = df.withColumns({"_x": b["x0"].cast("int"), "_y": b["y0"].cast("int"), "_w": G.whole(G.width(b)), "_h": G.whole(G.height(b))}).where("_w > 0 AND _h > 0")
    caption = F.when(F.col("_y") >= 0, F.format_string("%s %.2f %d", "display_name", F.col("proba").cast("double"), "order_idx"))
    df = df.withColumns({"caption": caption, "text_x": F.greatest("_x", F.lit(5)), "text_y": F.col("_y")})
    k = F.col("offset")
    return df.withColumn("offset", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        *page, "order_idx", "offset", (F.col("_x") - k).alias("x"), (F.col("_y") - k).alias("y"), (F.col("_w") + k * 2).alias("w"), (F.col("_h") + k * 2).alias("h"), "r", "g", "b", "caption", "text_x", "text_y"
    )


def detections_by_page(regions: DataFrame, page: list[str]) -> DataFrame:
    """(page..., n, regions) for pages with at least one region, in the order of their elements."""
    got = regions.groupBy(*page).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("order_idx", "det_ord", "bbox", "proba"))).alias("regions"))
    return got.where("n > 0")


IMAGES = "png binary"


def page_images(pages: DataFrame, commands: DataFrame, page: list[str]) -> DataFrame:
    """(page..., png): pages(page..., img_w, img_h, image) with the rectangles of commands(page..., x, y, w, h, r, g, b) on them.

    Every page with an image comes out, also one without rectangles.  Captions
    stay in layout_commands(): no font is part of the engine.
    """
    kept = pages.where("image IS NOT NULL").select(*page, "img_w", "img_h", "image")
    schema = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in page) + ", " + IMAGES

    def draw(own: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        drawn = [(int(b.x), int(b.y), int(b.w), int(b.h), (int(b.r), int(b.g), int(b.b))) for b in boxes.itertuples(index=False)]
        rows = []
        for p in own.itertuples(index=False):
            image = np.frombuffer(p.image, dtype=np.uint8).reshape(int(p.img_h), int(p.img_w), 3)
            rows.append((*(getattr(p, c) for c in page), png(paint(image, drawn))))
        return pd.DataFrame(rows, columns=[*page, "png"])

    return kept.groupBy(*page).cogroup(commands.select(*page, "x", "y", "w", "h", "r", "g", "b").groupBy(*page)).applyInPandas(draw, schema)


def paint(image: np.ndarray, rectangles: list[tuple[int, int, int, int, tuple[int, int, int]]]) -> np.ndarray:
    """Hollow rectangles (x, y, w, h, colour) on a copy of an RGB image; parts outside are cut."""
    out = image.copy()
    h, w = out.shape[:2]
    for x, y, rw, rh, colour in rectangles:
        for yy in (y, y + rh - 1):
            if 0 <= yy < h:
                out[yy, max(0, x) : max(0, min(w, x + rw))] = colour
        for xx in (x, x + rw - 1):
            if 0 <= xx < w:
                out[max(0, y) : max(0, min(h, y + rh)), xx] = colour
    return out


def png(image: np.ndarray) -> bytes:
    """An RGB image as PNG."""
    h, w = image.shape[:2]
    raw = b"".join(b"\x00" + image[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
