"""Order-dependent merges of boxes: overlapping detections of a page, neighbours of a line.

Both are folds over a sorted array within one page or line: each survivor grows
over every later box that meets it, absorbed ones included, so no window or
gaps-and-islands form equals them.  The fold stays in the JVM as a higher-order
function; a page is one row, so skew is bounded by the boxes of a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = "struct<x0:float,y0:float,x1:float,y1:float>"
_GROWN = "named_struct('x0', least({a}.x0, {b}.x0), 'y0', least({a}.y0, {b}.y0), 'x1', greatest({a}.x1, {b}.x1), 'y1', greatest({a}.y1, {b}.y1))"


def _overlap(a: str, b: str) -> str:
    w, h = f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))", f"(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    small = f"least(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0), ({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0))"
    return f"if({small} > CAST(0 AS FLOAT) AND {w} > CAST(0 AS FLOAT) AND {h} > CAST(0 AS FLOAT), CAST({w} * {h} / {small} AS FLOAT), CAST(0 AS FLOAT))"


def fold(items: str, element: str, meets: str, absorb: str) -> str:
    """SQL of the merge over the array column `items`, whose elements hold bbox, tag and their place j.

    meets and absorb speak of t.cur, t.tag (the survivor so far), o (its element) and c (a later element).
    """
    inner = f"named_struct('cur', t.cur, 'tag', t.tag, 'gone', t.gone)"
    grown = _GROWN.format(a="t.cur", b="c.bbox")
    return f"""
    aggregate(
      sequence(0, size({items}) - 1),
      CAST(named_struct('gone', array(), 'out', array()) AS STRUCT<gone: ARRAY<INT>, out: ARRAY<{element}>>),
      (s, i) -> if(array_contains(s.gone, i), s,
        aggregate(
          slice({items}, i + 2, size({items})),
          CAST(named_struct('cur', {items}[i].bbox, 'tag', {items}[i].tag, 'gone', s.gone) AS STRUCT<cur: {BOX}, tag: INT, gone: ARRAY<INT>>),
          (t, p) -> transform(array(named_struct('o', {items}[i], 'c', p)), v -> if({meets},
            CAST(named_struct('cur', {grown.replace('c.bbox', 'v.c.bbox')}, 'tag', {absorb}, 'gone', array_append(t.gone, p.j)) AS STRUCT<cur: {BOX}, tag: INT, gone: ARRAY<INT>>),
            CAST({inner} AS STRUCT<cur: {BOX}, tag: INT, gone: ARRAY<INT>>)))[0],
          t -> CAST(named_struct('gone', t.gone, 'out', array_append(s.out, named_struct('id', {items}[i].id, 'bbox', t.cur, 'tag', t.tag, 'proba', {items}[i].proba))) AS STRUCT<gone: ARRAY<INT>, out: ARRAY<{element}>>))),
      s -> s.out)"""


def _placed(items: str) -> str:
    """The array with the place of each element in it: made once, not for every survivor."""
    return f"transform({items}, (x, j) -> named_struct('id', x.id, 'bbox', x.bbox, 'tag', x.tag, 'proba', x.proba, 'j', j)) AS {items}"


_ELEMENT = f"STRUCT<id: INT, bbox: {BOX}, tag: INT, proba: FLOAT>"


def merge_overlapping(df: DataFrame, page: list[str], least_overlap: float = 0.45) -> DataFrame:
    """df(page..., bbox_id, label_id, proba, bbox) -> the survivors of each page, in order of falling area.

    Boxes are taken by area, largest first (ties: bbox_id).  A survivor unites
    with every later box whose overlap ratio with it, as grown so far, exceeds
    least_overlap; the label of the last absorbed box of a higher score than
    its own original one wins; score and number stay.
    """
    size = (F.col("bbox.x1") - F.col("bbox.x0")) * (F.col("bbox.y1") - F.col("bbox.y0"))
    item = F.struct((-size).alias("k"), F.col("bbox_id").alias("id"), F.col("bbox"), F.col("label_id").alias("tag"), F.col("proba"))
    pages = df.groupBy(*page).agg(F.sort_array(F.collect_list(item)).alias("a"))
    # a page of one box has nothing to merge
    meets = f"{_overlap('t.cur', 'v.c.bbox')} > CAST({least_overlap!r}D AS FLOAT)"
    merged = pages.selectExpr(*page, _placed("a")).select(*page, F.expr(fold("a", _ELEMENT, meets, "if(v.c.proba > v.o.proba, v.c.tag, t.tag)")).alias("out"))
    rows = merged.select(*page, F.posexplode("out").alias("rank", "e"))
    return rows.select(*page, F.col("e.id").alias("bbox_id"), F.col("e.tag").alias("label_id"), F.col("e.proba").alias("proba"), F.col("e.bbox").alias("bbox"), "rank")


def merge_lines(df: DataFrame, line: list[str], order: str = "x_rank", gap: float = 10.0) -> DataFrame:
    """df(line..., x_rank, proba, bbox) -> merged boxes of each line.

    In order of x_rank a survivor unites with every later box that begins less
    than gap after its present right edge, wherever that box begins.
    """
    item = F.struct(F.col(order).cast("int").alias("id"), F.col("bbox"), F.lit(0).alias("tag"), F.col("proba"))
    lines = df.groupBy(*line).agg(F.sort_array(F.collect_list(item)).alias("a"))
    meets = f"v.c.bbox.x0 - t.cur.x1 < CAST({gap!r}D AS FLOAT)"
    merged = lines.selectExpr(*line, _placed("a")).select(*line, F.expr(fold("a", _ELEMENT, meets, "t.tag")).alias("out"))
    rows = merged.select(*line, F.posexplode("out").alias("rank", "e"))
    return rows.select(*line, F.col("e.id").alias(order), F.col("e.proba").alias("proba"), F.col("e.bbox").alias("bbox"))
