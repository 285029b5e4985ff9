"""Queries of the core operators over the test tables, each with independent DuckDB SQL.

Elements are taken once each (a redelivered row equals its first delivery), and
their labels in one spelling.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.functions import geometry as G
from vellumgrid.functions.labels import label_index, labels_dim, with_label
from vellumgrid.operators import decode, draw, lines, merge, order, textsource, tokens
from vellumgrid.plans import pipeline
from vellumgrid.runtime import load
from vellumgrid.sources import export, requests

PAGE = ["pdf_id", "page_no"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def elements(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "elements").dropDuplicates(["elem_id"])
    return e.select("elem_id", *PAGE, "bbox_id", "label", label_index(F.col("label")).alias("label_id"), "bbox", "proba", F.col("ocr.is_ocr").alias("is_ocr"), "text")


def tall(spark: SparkSession, d: str) -> DataFrame:
    """Elements with boxes 90 points taller, so that neighbours overlap."""
    b = F.col("bbox")
    return elements(spark, d).withColumn("bbox", G.box(b["x0"], b["y0"], b["x1"], b["y1"] + G.f32(90)))


E = """
    e0 AS (SELECT DISTINCT elem_id, pdf_id, page_no, bbox_id, replace(label, '-', '') AS json_name, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1, proba, ocr.is_ocr AS is_ocr, text FROM elements),
    e AS (SELECT e0.*, label_idx AS label_id FROM e0 JOIN labels_dim ON serde_name = json_name)"""
TALL = E + ",\n    t AS (SELECT * REPLACE (y1 + 90::FLOAT AS y1) FROM e)"


def _area(a: str) -> str:
    return f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


def _inter(a: str, b: str) -> str:
    w, h = f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))", f"(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    return f"(CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} ELSE 0::FLOAT END)"


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN least({_area(a)}, {_area(b)}) > 0 THEN ({_inter(a, b)} / least({_area(a)}, {_area(b)}))::FLOAT ELSE 0::FLOAT END)"


CX, CY = "((x0 + x1) * 0.5::FLOAT)", "((y0 + y1) * 0.5::FLOAT)"
PAIRS = f"WITH {TALL} SELECT a.elem_id AS a, b.elem_id AS b, %s FROM t a JOIN t b ON a.pdf_id = b.pdf_id AND a.page_no = b.page_no AND a.bbox_id < b.bbox_id"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    t = tall(spark, d)
    left = t.select(*PAGE, F.col("bbox_id").alias("ia"), F.col("elem_id").alias("a"), F.col("bbox").alias("ba"))
    right = t.select(*PAGE, F.col("bbox_id").alias("ib"), F.col("elem_id").alias("b"), F.col("bbox").alias("bb"))
    return left.join(right, PAGE).where("ia < ib")


@query(f"WITH {E} SELECT elem_id, {_area('e')} AS area FROM e")
def geom_area(spark, d):
    return elements(spark, d).select("elem_id", G.area(F.col("bbox")).alias("area"))


@query(f"WITH {E} SELECT elem_id, {CX} AS cx, {CY} AS cy FROM e")
def geom_center(spark, d):
    return elements(spark, d).select("elem_id", G.center_x(F.col("bbox")).alias("cx"), G.center_y(F.col("bbox")).alias("cy"))


@query(PAIRS % f"{_inter('a', 'b')} AS inter")
def geom_intersection(spark, d):
    return pairs(spark, d).select("a", "b", G.intersection(F.col("ba"), F.col("bb")).alias("inter"))


@query(PAIRS % f"(CASE WHEN {_area('a')} + {_area('b')} - {_inter('a', 'b')} > 0 THEN ({_inter('a', 'b')} / ({_area('a')} + {_area('b')} - {_inter('a', 'b')}))::FLOAT ELSE 0::FLOAT END) AS iou")
def geom_iou(spark, d):
    return pairs(spark, d).select("a", "b", G.iou(F.col("ba"), F.col("bb")).alias("iou"))


@query(PAIRS % f"{_ratio('a', 'b')} AS overlap")
def geom_overlap_ratio(spark, d):
    return pairs(spark, d).select("a", "b", G.overlap_ratio(F.col("ba"), F.col("bb")).alias("overlap"))


@query(PAIRS % "least(a.x0, b.x0) AS x0, least(a.y0, b.y0) AS y0, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1")
def geom_union(spark, d):
    return pairs(spark, d).select("a", "b", G.union(F.col("ba"), F.col("bb")).alias("u")).select("a", "b", "u.*")


@query(PAIRS % "(a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1) AS holds")
def geom_contains(spark, d):
    return pairs(spark, d).select("a", "b", G.contains(F.col("ba"), F.col("bb")).alias("holds"))


_DX = "(CASE WHEN a.x1 < b.x0 THEN b.x0 - a.x1 WHEN b.x1 < a.x0 THEN a.x0 - b.x1 ELSE 0::FLOAT END)"
_DY = "(CASE WHEN a.y1 < b.y0 THEN b.y0 - a.y1 WHEN b.y1 < a.y0 THEN a.y0 - b.y1 ELSE 0::FLOAT END)"


@query(PAIRS % f"sqrt(({_DX} * {_DX} + {_DY} * {_DY})::DOUBLE)::FLOAT AS gap")
def geom_distance(spark, d):
    return pairs(spark, d).select("a", "b", G.distance(F.col("ba"), F.col("bb")).alias("gap"))


def _flat(df: DataFrame, b) -> DataFrame:
    return df.select("elem_id", b.alias("b")).select("elem_id", "b.*")


@query(f"WITH {E} SELECT elem_id, greatest(x0, 100::FLOAT) AS x0, greatest(y0, 50::FLOAT) AS y0, least(x1, 500::FLOAT) AS x1, least(y1, 700::FLOAT) AS y1 FROM e")
def geom_clamp(spark, d):
    return _flat(elements(spark, d), G.clamp(F.col("bbox"), 100, 50, 500, 700))


@query(f"WITH {E} SELECT elem_id, x0 * 1.25::FLOAT + 10::FLOAT AS x0, y0 * 1.25::FLOAT + 5::FLOAT AS y0, x1 * 1.25::FLOAT + 10::FLOAT AS x1, y1 * 1.25::FLOAT + 5::FLOAT AS y1 FROM e")
def geom_scale_translate(spark, d):
    return _flat(elements(spark, d), G.translate(G.scale(F.col("bbox"), 1.25), 10, 5))


@query(f"WITH {E} SELECT elem_id, x0 - x1 * 0.5::FLOAT AS x0, y0 - y1 * 0.5::FLOAT AS y0, x0 + x1 * 0.5::FLOAT AS x1, y0 + y1 * 0.5::FLOAT AS y1 FROM e")
def geom_from_center_size(spark, d):
    b = F.col("bbox")
    return _flat(elements(spark, d), G.from_center_size(b["x0"], b["y0"], b["x1"], b["y1"]))


@query(f"WITH {E} SELECT elem_id, x0, y0, x0 + x1 AS x1, y0 + y1 AS y1 FROM e")
def geom_from_min_size(spark, d):
    b = F.col("bbox")
    return _flat(elements(spark, d), G.from_min_size(b["x0"], b["y0"], b["x1"], b["y1"]))


SIZES = "p AS (SELECT DISTINCT pdf_id, page_no, pdf_size.x AS pw, pdf_size.y AS ph, image_size.x AS iw, image_size.y AS ih, scale FROM page_meta)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "page_meta").select(*PAGE, F.col("pdf_size.x").alias("pw"), F.col("pdf_size.y").alias("ph"), F.col("image_size.x").alias("iw"), F.col("image_size.y").alias("ih"), "scale")
    return p.distinct()


@query(f"WITH {E}, {SIZES} SELECT elem_id, x0, ph - y1 AS y0, x1, ph - y0 AS y1 FROM e JOIN p USING (pdf_id, page_no)")
def geom_to_cartesian(spark, d):
    return _flat(elements(spark, d).join(pages(spark, d), PAGE), G.to_cartesian(F.col("bbox"), F.col("ph")))


@query(f'WITH {E}, {SIZES} SELECT elem_id, ph - y1 AS bottom, x0 AS "left", ph - y0 AS top, x1 AS "right" FROM e JOIN p USING (pdf_id, page_no)')
def geom_to_pdf_rect(spark, d):
    return _flat(elements(spark, d).join(pages(spark, d), PAGE), G.to_pdf_rect(F.col("bbox"), F.col("ph")))


@query(f"WITH {SIZES}, s AS (SELECT *, least((iw / pw)::FLOAT, (ih / ph)::FLOAT) AS s FROM p) SELECT pdf_id, page_no, s AS scale, round(pw * s)::FLOAT AS w, round(ph * s)::FLOAT AS h FROM s")
def fit_scale(spark, d):
    return pages(spark, d).select(*PAGE, G.fit("pw", "ph", "iw", "ih").alias("f")).select(*PAGE, "f.*")


@query(f"WITH {SIZES}, s AS (SELECT *, least((960::FLOAT / pw)::FLOAT, (960::FLOAT / ph)::FLOAT) AS s FROM p) SELECT pdf_id, page_no, s AS scale, floor(pw * s)::INTEGER AS w, floor(ph * s)::INTEGER AS h, floor(pw * (48::FLOAT / ph)::FLOAT)::INTEGER AS line_w FROM s")
def fit_detector(spark, d):
    return pages(spark, d).select(*PAGE, G.fit_truncated("pw", "ph", 960, 960).alias("f"), G.fit_height("pw", "ph", 48).alias("line_w")).select(*PAGE, "f.*", "line_w")


@query(f"""WITH {E}, {SIZES}, c AS (SELECT elem_id, greatest(x0 * scale - 60::FLOAT, 0::FLOAT) AS a, greatest(y0 * scale - 60::FLOAT, 0::FLOAT) AS b, least(x1 * scale - 60::FLOAT, 600::FLOAT) AS c, least(y1 * scale - 60::FLOAT, 700::FLOAT) AS d FROM e JOIN p USING (pdf_id, page_no)),
    r AS (SELECT elem_id, floor(a)::INTEGER AS x, floor(b)::INTEGER AS y, least(floor(greatest(c - a, 1::FLOAT))::INTEGER, greatest(600 - floor(a)::INTEGER, 0)) AS w, least(floor(greatest(d - b, 1::FLOAT))::INTEGER, greatest(700 - floor(b)::INTEGER, 0)) AS h FROM c)
    SELECT *, (w <= 0 OR h <= 0) AS blank FROM r""")
def crop_rect(spark, d):
    moved = G.translate(G.scale(F.col("bbox"), F.col("scale")), -60, -60)
    return _flat(elements(spark, d).join(pages(spark, d), PAGE), G.crop_rect(moved, 600, 700))


@query(f"WITH {E} SELECT elem_id, greatest(x0 * 1.5::FLOAT - 6::FLOAT, 0::FLOAT) AS x0, greatest(y0 * 0.75::FLOAT - 6::FLOAT, 0::FLOAT) AS y0, least(x1 * 1.5::FLOAT + 6::FLOAT, 720::FLOAT) AS x1, least(y1 * 0.75::FLOAT + 6::FLOAT, 540::FLOAT) AS y1 FROM e")
def padded_bounds(spark, d):
    b = F.col("bbox")
    return _flat(elements(spark, d), G.padded_bounds(b["x0"], b["y0"], b["x1"], b["y1"], 720, 540, 480, 720, 6))


SCORES = "s AS (SELECT vec_id, embedding[1:11] AS scores FROM embeddings), m AS (SELECT vec_id, scores, list_max(scores) AS proba, (11 - list_position(list_reverse(scores), list_max(scores)))::INTEGER AS label_id FROM s)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return decode.class_of(load(spark, d, "embeddings").select("vec_id", "embedding", F.slice("embedding", 1, 11).alias("scores")))


@query(f"WITH {SCORES} SELECT vec_id, label_id, proba FROM m")
def argmax_label(spark, d):
    return scored(spark, d).select("vec_id", "label_id", "proba")


@query(f"WITH {SCORES} SELECT vec_id, proba FROM m WHERE NOT (proba < 0.2::FLOAT)")
def score_filter(spark, d):
    return decode.score_filter(scored(spark, d), 0.2).select("vec_id", "proba")


@query(f"WITH {SCORES} SELECT vec_id, label_id, display_name, serde_name AS json_name FROM m JOIN labels_dim ON label_idx = label_id")
def label_join(spark, d):
    return with_label(scored(spark, d).select("vec_id", "label_id")).select("vec_id", "label_id", "display_name", "json_name")


@query("SELECT label_idx AS label_id, display_name, serde_name AS json_name FROM labels_dim")
def label_table(spark, d):
    return labels_dim(spark).select("label_id", "display_name", "json_name")


@query(f"""WITH {SCORES}, k AS (SELECT m.*, vec_id // 25 AS page, embedding AS v FROM m JOIN embeddings USING (vec_id) WHERE NOT (proba < 0.1::FLOAT)),
    b AS (SELECT vec_id, page, label_id, proba, 512::FLOAT + v[12] * 512::FLOAT AS cx, 512::FLOAT + v[13] * 512::FLOAT AS cy, v[14] * 512::FLOAT AS w, v[15] * 512::FLOAT AS h FROM k)
    SELECT page, (row_number() OVER (PARTITION BY page ORDER BY vec_id) - 1)::INTEGER AS bbox_id, label_id, proba,
    greatest(cx - w * 0.5::FLOAT, 0::FLOAT) * 0.8::FLOAT AS x0, greatest(cy - h * 0.5::FLOAT, 0::FLOAT) * 0.8::FLOAT AS y0, least(cx + w * 0.5::FLOAT, 1024::FLOAT) * 0.8::FLOAT AS x1, least(cy + h * 0.5::FLOAT, 1024::FLOAT) * 0.8::FLOAT AS y1 FROM b""")
def decode_boxes(spark, d):
    return decode.decode(raw_predictions(spark, d), ["page"]).select("page", "bbox_id", "label_id", "proba", "bbox.*")


def raw_predictions(spark: SparkSession, d: str) -> DataFrame:
    v, k = lambda i: F.get("embedding", F.lit(i - 1)), G.f32(512)
    return load(spark, d, "embeddings").select(
        F.expr("vec_id div 25").alias("page"), F.col("vec_id").alias("anchor_idx"), (k + v(12) * k).alias("cx"), (k + v(13) * k).alias("cy"), (v(14) * k).alias("w"), (v(15) * k).alias("h"),
        F.slice("embedding", 1, 11).alias("scores"), G.f32(1.25).alias("scale"), G.f32(1024).alias("image_w"), G.f32(1024).alias("image_h"),
    )


@query(PAIRS % f"{_ratio('a', 'b')} AS overlap" + f" WHERE {_ratio('a', 'b')} > 0.45::FLOAT")
def overlap_pairs(spark, d):
    return decode.overlap_pairs(tall(spark, d), PAGE, "bbox_id", 0.45, "elem_id").select("a", "b", "overlap")


def _merge_sql(rows: str, keys: str, order_by: str, meets: str, absorb: str) -> str:
    """The fold as a recursive query: one pair (i, j) a step."""
    box = "{'x0': least(cur.x0, a[j].x0), 'y0': least(cur.y0, a[j].y0), 'x1': greatest(cur.x1, a[j].x1), 'y1': greatest(cur.y1, a[j].y1)}"
    start = "{'x0': a[%s].x0, 'y0': a[%s].y0, 'x1': a[%s].x1, 'y1': a[%s].y1}"
    done = "{'id': a[i].id, 'x0': cur.x0, 'y0': cur.y0, 'x1': cur.x1, 'y1': cur.y1, 'tag': tag, 'proba': a[i].proba}"
    empty = "[]::STRUCT(id INTEGER, x0 FLOAT, y0 FLOAT, x1 FLOAT, y1 FLOAT, tag INTEGER, proba FLOAT)[]"
    at = lambda k: start % (k, k, k, k)
    return f"""
    g AS (SELECT {keys}, list({{'id': id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'tag': tag, 'proba': proba}} ORDER BY {order_by}) AS a FROM {rows} GROUP BY {keys}),
    f AS (
      SELECT {keys}, a, 1::BIGINT AS i, 2::BIGINT AS j, {at('1')} AS cur, a[1].tag AS tag, []::BIGINT[] AS gone, {empty} AS done FROM g
      UNION ALL
      SELECT {keys}, a,
        CASE WHEN j <= len(a) THEN i ELSE i + 1 END,
        CASE WHEN j <= len(a) THEN j + 1 ELSE i + 2 END,
        CASE WHEN j > len(a) THEN {at('least(i + 1, len(a))')} WHEN NOT list_contains(gone, i) AND ({meets}) THEN {box} ELSE cur END,
        CASE WHEN j > len(a) THEN a[least(i + 1, len(a))].tag WHEN NOT list_contains(gone, i) AND ({meets}) THEN {absorb} ELSE tag END,
        CASE WHEN j <= len(a) AND NOT list_contains(gone, i) AND ({meets}) THEN list_append(gone, j) ELSE gone END,
        CASE WHEN j > len(a) AND NOT list_contains(gone, i) THEN list_append(done, {done}) ELSE done END
      FROM f WHERE i <= len(a)),
    o AS (SELECT {keys}, unnest(done) AS r FROM f WHERE i > len(a))"""


_A = "a[j]"
_W, _H = "(least(cur.x1, a[j].x1) - greatest(cur.x0, a[j].x0))", "(least(cur.y1, a[j].y1) - greatest(cur.y0, a[j].y0))"
_SMALL = "least((cur.x1 - cur.x0) * (cur.y1 - cur.y0), (a[j].x1 - a[j].x0) * (a[j].y1 - a[j].y0))"
_MEETS = f"{_SMALL} > 0 AND {_W} > 0 AND {_H} > 0 AND ({_W} * {_H} / {_SMALL})::FLOAT > 0.45::FLOAT"
NMS = _merge_sql("(SELECT *, bbox_id AS id, label_id AS tag FROM t)", "pdf_id, page_no", "-((x1 - x0) * (y1 - y0)), id", _MEETS, "CASE WHEN a[j].proba > a[i].proba THEN a[j].tag ELSE tag END")


@query(f"WITH RECURSIVE {TALL}, {NMS} SELECT pdf_id, page_no, r.id AS bbox_id, r.tag AS label_id, r.proba AS proba, r.x0 AS x0, r.y0 AS y0, r.x1 AS x1, r.y1 AS y1 FROM o")
def nms_merge(spark, d):
    return merge.merge_overlapping(tall(spark, d), PAGE).select(*PAGE, "bbox_id", "label_id", "proba", "bbox.*")


COLUMNS = f"""
    c AS (SELECT *, {CX} AS cx, {CY} AS cy FROM %s),
    w AS (SELECT pdf_id, page_no, count(*) AS n, min(cx) AS lo, max(cx) - min(cx) AS span, ((max(x1) - min(x0)) / 2::FLOAT)::FLOAT AS mid FROM c GROUP BY ALL),
    l AS (SELECT pdf_id, page_no, count(*) FILTER (WHERE cx < lo + (span / 2::FLOAT)::FLOAT) AS lefts FROM c JOIN w USING (pdf_id, page_no) GROUP BY ALL),
    m AS (SELECT pdf_id, page_no, mid, (n >= 4 AND span >= 100 AND lefts >= n // 4 AND n - lefts >= n // 4) AS multi_column FROM w JOIN l USING (pdf_id, page_no)),
    k AS (SELECT c.*, multi_column, CASE WHEN NOT multi_column THEN 0 WHEN label_id IN (10, 5) THEN 0 WHEN label_id = 4 THEN 1 WHEN cx > mid - (mid / 3::FLOAT)::FLOAT AND cx < mid + (mid / 3::FLOAT)::FLOAT THEN 0 WHEN cx < mid THEN 0 ELSE 1 END AS col_id,
          CASE label_id WHEN 5 THEN 0 WHEN 10 THEN 1 WHEN 4 THEN 3 ELSE 2 END AS r FROM c JOIN m USING (pdf_id, page_no))"""


@query(f"WITH {E}, {COLUMNS % 'e'} SELECT DISTINCT pdf_id, page_no, multi_column FROM k")
def multi_column_flag(spark, d):
    return order.with_columns(elements(spark, d), PAGE).select(*PAGE, "multi_column").distinct()


@query(f"WITH {E}, {COLUMNS % 'e'} SELECT elem_id, col_id FROM k")
def column_assign(spark, d):
    return order.with_columns(elements(spark, d), PAGE).select("elem_id", "col_id")


ORDERED = """
    s AS (SELECT *, CASE WHEN r <> 2 THEN 1 WHEN cy - lag(cy) OVER z > %s::FLOAT THEN 1 ELSE 0 END AS fresh FROM k WINDOW z AS (PARTITION BY pdf_id, page_no, col_id, r ORDER BY cy, bbox_id)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY pdf_id, page_no, col_id, r ORDER BY cy, bbox_id) AS line FROM s),
    q AS (SELECT *, (row_number() OVER (PARTITION BY pdf_id, page_no ORDER BY col_id, r, line, CASE WHEN r = 2 THEN cx ELSE cy END, bbox_id) - 1)::INTEGER AS order_idx FROM n)"""


@query(f"WITH {E}, {COLUMNS % 'e'}, {ORDERED % 10} SELECT elem_id, order_idx FROM q")
def reading_order(spark, d):
    return order.reading_order(elements(spark, d), PAGE, "bbox_id").select("elem_id", "order_idx")


@query(f"WITH {E}, {COLUMNS % 'e'}, {ORDERED % 60} SELECT elem_id, order_idx FROM q")
def reading_order_wide(spark, d):
    return order.reading_order(elements(spark, d), PAGE, "bbox_id", tolerance=60.0).select("elem_id", "order_idx")


_AFTER = "CASE WHEN {a}.r <> {b}.r THEN {a}.r > {b}.r WHEN {a}.r <> 2 OR abs({a}.y - {b}.y) > 10::FLOAT THEN {a}.y > {b}.y ELSE {a}.x > {b}.x END"
_PAIRWISE = f"""
    g AS (SELECT pdf_id, page_no, col_id, list({{'id': elem_id, 'r': r, 'x': cx, 'y': cy}} ORDER BY bbox_id) AS a FROM k GROUP BY ALL),
    f AS (SELECT pdf_id, page_no, col_id, a, 1 AS i, a[1:1] AS own FROM g
          UNION ALL
          SELECT pdf_id, page_no, col_id, a, i + 1, list_concat(list_concat(own[1:p], a[i + 1:i + 1]), own[p + 1:])
          FROM (SELECT *, coalesce(list_max(list_filter(range(1, len(own) + 1), lambda j: NOT ({_AFTER.format(a='own[j]', b='a[i + 1]')}))), 0) AS p FROM f WHERE i < len(a))),
    o AS (SELECT pdf_id, page_no, col_id, unnest(own) AS e, unnest(range(1, len(own) + 1)) AS place FROM f WHERE i = len(a))"""


@query(f"WITH RECURSIVE {E}, {COLUMNS % 'e'}, {_PAIRWISE} SELECT e.id AS elem_id, (row_number() OVER (PARTITION BY pdf_id, page_no ORDER BY col_id, place) - 1)::INTEGER AS order_idx FROM o")
def reading_order_pairwise(spark, d):
    """The order by pairwise comparison, held against insertion sort as a recursive query."""
    return order.reading_order(elements(spark, d), PAGE, "bbox_id", mode="pairwise").select("elem_id", "order_idx")


LINES = f"""
    c AS (SELECT *, {CX} AS cx, {CY} AS cy FROM e),
    s AS (SELECT *, CASE WHEN abs(cy - lag(cy) OVER z) >= 60::FLOAT THEN 1 ELSE 0 END AS fresh FROM c WINDOW z AS (PARTITION BY pdf_id, page_no ORDER BY bbox_id)),
    n AS (SELECT *, (sum(fresh) OVER (PARTITION BY pdf_id, page_no ORDER BY bbox_id))::INTEGER AS line_id FROM s),
    x AS (SELECT *, (row_number() OVER (PARTITION BY pdf_id, page_no, line_id ORDER BY cx, bbox_id) - 1)::INTEGER AS x_rank FROM n)"""


@query(f"WITH {E}, {LINES} SELECT elem_id, line_id FROM x")
def line_chunk(spark, d):
    return lines.with_lines(elements(spark, d), PAGE, "bbox_id", 60.0).select("elem_id", "line_id")


@query(f"WITH {E}, {LINES} SELECT elem_id, x_rank FROM x")
def line_sort(spark, d):
    return lines.with_lines(elements(spark, d), PAGE, "bbox_id", 60.0).select("elem_id", "x_rank")


LINE_MERGE = _merge_sql("(SELECT *, x_rank AS id, 0 AS tag FROM x)", "pdf_id, page_no, line_id", "id", "a[j].x0 - cur.x1 < 10::FLOAT", "tag")


@query(f"WITH RECURSIVE {E}, {LINES}, {LINE_MERGE} SELECT pdf_id, page_no, line_id, (row_number() OVER (PARTITION BY pdf_id, page_no ORDER BY line_id, r.id) - 1)::INTEGER AS det_ord, r.proba AS proba, r.x0 AS x0, r.y0 AS y0, r.x1 AS x1, r.y1 AS y1 FROM o")
def line_merge(spark, d):
    return lines.merged_lines(elements(spark, d), PAGE, "bbox_id", 60.0).select(*PAGE, "line_id", "det_ord", "proba", "bbox.*")



@query(f"""WITH {E}, u AS (SELECT elem_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM e0 WHERE text <> ''),
    k AS (SELECT elem_id, i, ascii(ch) % 7 AS c, lag(ascii(ch) % 7) OVER (PARTITION BY elem_id ORDER BY i) AS before FROM u)
    SELECT elem_id, string_agg(CASE c WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' ELSE ' ' END, '' ORDER BY i) AS decoded FROM k WHERE c <> 0 AND c < 5 AND c IS DISTINCT FROM before GROUP BY elem_id""")
def ctc_decode(spark, d):
    e = elements(spark, d).where("text <> ''")
    classes = F.transform(F.split("text", ""), lambda c: F.ascii(c) % 7)
    got = e.select("elem_id", tokens.collapse(classes, F.array(*[F.lit(c) for c in ("#", "a", "b", "c", " ")])).alias("decoded"))
    return got.where("decoded <> ''")


_STEPS = f"""WITH {SCORES}, c AS (SELECT vec_id // 25 AS region, vec_id AS t, CASE WHEN proba > 0.15::FLOAT THEN label_id ELSE 0 END AS c FROM m),
    k AS (SELECT *, lag(c) OVER (PARTITION BY region ORDER BY t) AS before FROM c)
    SELECT region, coalesce(string_agg('abcdefgh '[c], '' ORDER BY t) FILTER (WHERE c <> 0 AND c < 10 AND c IS DISTINCT FROM before), '') AS decoded FROM k GROUP BY region"""


@query(_STEPS)
def decode_steps(spark, d):
    """Scores of the steps of a region to its text: confident classes, repeats, blanks, and a class beyond the dictionary."""
    steps = load(spark, d, "embeddings").select(F.expr("vec_id div 25").alias("region"), F.col("vec_id").alias("t"), F.slice("embedding", 1, 11).alias("probs"))
    return tokens.decode_steps(steps, ["region"], tokens.dictionary("\n".join("abcdefgh")), 0.15).select("region", F.col("text").alias("decoded"))


@query(f"WITH {E} SELECT elem_id, CASE WHEN trim(read) <> '' THEN trim(read) ELSE text END AS text FROM (SELECT elem_id, text, CASE bbox_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN '  line ' || bbox_id || ' ' END AS read FROM e)")
def trimmed_text(spark, d):
    """Regions read on their own: trimmed readings replace the text, blank and missing ones do not."""
    i = F.col("bbox_id")
    read = F.when(i % 3 == 0, "  ").when(i % 3 == 1, F.concat(F.lit("  line "), i.cast("string"), F.lit(" ")))
    return elements(spark, d).select("elem_id", tokens.trimmed(F.col("text"), read).alias("text"))


@query(f"WITH {SCORES} SELECT vec_id, CASE WHEN proba > 0.25::FLOAT THEN label_id ELSE 0 END AS token FROM m")
def token_confidence(spark, d):
    return load(spark, d, "embeddings").select("vec_id", tokens.token_class(F.slice("embedding", 1, 11), 0.25).alias("token"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """One character a box, at its centre: stands for a page's characters."""
    e = elements(spark, d)
    return e.select(*PAGE, F.col("bbox_id").alias("char_idx"), F.substring("label", 1, 1).alias("ch"), G.center_x(F.col("bbox")).alias("x"), G.center_y(F.col("bbox")).alias("y"))


INSIDE = f"""{TALL}, ch AS (SELECT pdf_id, page_no, bbox_id AS char_idx, json_name[1] AS ch, {CX} AS x, {CY} AS y FROM e),
    i AS (SELECT t.elem_id, coalesce(string_agg(ch, '' ORDER BY char_idx), '') AS pdf_text FROM t LEFT JOIN ch ON t.pdf_id = ch.pdf_id AND t.page_no = ch.page_no AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY t.elem_id)"""


@query(f"WITH {INSIDE} SELECT * FROM i")
def text_in_box(spark, d):
    t = tall(spark, d)
    return textsource.text_in_boxes(t, points(spark, d), PAGE, "bbox_id").join(t.select(*PAGE, "bbox_id", "elem_id"), [*PAGE, "bbox_id"]).select("elem_id", "pdf_text")


def moded(spark: SparkSession, d: str) -> DataFrame:
    """Elements in each of the three modes, their stored text standing for the PDF's."""
    e = elements(spark, d).withColumn("pdf_text", F.col("text")).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in textsource.MODES])))
    return textsource.first_pass(e, F.col("mode"))


MODED = f"""{E}, m AS (SELECT e.* EXCLUDE (text, is_ocr), mode, CASE WHEN mode = 'Ocr' THEN NULL ELSE coalesce(text, '') END AS text FROM e, (VALUES ('Auto'), ('Ocr'), ('Pdf')) v(mode)),
    f AS (SELECT *, mode <> 'Pdf' AND (label_id = 6 OR text IS NULL OR text = '') AS needs_ocr FROM m)"""


@query(f"WITH {MODED} SELECT elem_id, mode, needs_ocr FROM f")
def ocr_route(spark, d):
    return moded(spark, d).select("elem_id", "mode", "needs_ocr")


@query(f"""WITH {MODED}, r AS (SELECT elem_id, 'line ' || bbox_id || chr(10) AS ocr_text FROM e WHERE bbox_id % 3 <> 0)
    SELECT elem_id, mode, CASE WHEN needs_ocr AND ocr_text IS NOT NULL THEN ocr_text ELSE text END AS text, (needs_ocr AND ocr_text IS NOT NULL) AS is_ocr FROM f LEFT JOIN r USING (elem_id)""")
def text_source_case(spark, d):
    ocr = elements(spark, d).where("bbox_id % 3 <> 0").select("elem_id", F.concat(F.lit("line "), F.col("bbox_id").cast("string"), F.lit("\n")).alias("ocr_text"))
    return textsource.second_pass(moded(spark, d), ocr, ["elem_id"]).select("elem_id", "mode", "text", "is_ocr")


@query(f"WITH {E} SELECT pdf_id, page_no, string_agg(text || chr(10), '' ORDER BY bbox_id) AS ocr_text FROM e GROUP BY pdf_id, page_no HAVING count(text) > 0")
def ocr_text_fold(spark, d):
    got = tokens.fold_text(elements(spark, d), PAGE, "bbox_id")
    return got.where("ocr_text <> ''")


_NUM = "CASE WHEN regexp_full_match({p}, '\\+?[0-9]{{1,18}}') AND replace({p}, '+', '')::BIGINT <= 65535 THEN replace({p}, '+', '')::INTEGER ELSE {d} END"
RANGES = f"""r AS (SELECT request_id, pdf_id, string_split(page_spec, '..') AS p FROM requests),
    g AS (SELECT request_id, pdf_id, CASE WHEN len(p) = 2 THEN {_NUM.format(p='p[1]', d=0)} ELSE 0 END AS start, CASE WHEN len(p) = 2 THEN {_NUM.format(p='p[2]', d=65535)} WHEN len(p) = 1 THEN {_NUM.format(p='p[1]', d=65535)} ELSE 65535 END AS "end" FROM r)"""


def ranged(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "requests").select("request_id", "pdf_id", requests.page_range(F.col("page_spec")).alias("r")).select("request_id", "pdf_id", "r.*")


@query(f'WITH {RANGES} SELECT request_id, start, "end" FROM g')
def page_range_parse(spark, d):
    return ranged(spark, d).select("request_id", "start", "end")


@query(f'WITH {RANGES}, {SIZES} SELECT request_id, pdf_id, page_no FROM g JOIN p USING (pdf_id) WHERE page_no >= start AND page_no < "end"')
def page_slice(spark, d):
    return requests.page_slice(ranged(spark, d), pages(spark, d).select(*PAGE), ["pdf_id"]).select("request_id", *PAGE)


@query(f"""WITH {RANGES}, n AS (SELECT pdf_id, count(DISTINCT metadata.page) AS page_count FROM pdf_layouts GROUP BY pdf_id)
    SELECT request_id, 'start ' || start || ' beyond ' || coalesce(page_count, 0) || ' pages' AS error FROM g LEFT JOIN n USING (pdf_id) WHERE coalesce(page_count, 0) < start""")
def range_errors(spark, d):
    """Requests that begin beyond what is there of their document, here its exported pages."""
    counts = load(spark, d, "pdf_layouts").groupBy("pdf_id").agg(F.countDistinct("metadata.page").alias("page_count"))
    return requests.range_errors(ranged(spark, d), counts, ["pdf_id"]).select("request_id", "error")


@query("SELECT request_id, CASE lower(trim(extra_mode)) WHEN 'ocr' THEN 'Ocr' WHEN 'pdf' THEN 'Pdf' ELSE 'Auto' END AS mode, CASE lower(trim(extra_mode)) WHEN 'pdf' THEN false ELSE true END AS need_ocr, CASE lower(trim(extra_mode)) WHEN 'ocr' THEN false ELSE true END AS need_pdf FROM requests")
def request_modes(spark, d):
    m = load(spark, d, "requests").select("request_id", textsource.canonical_mode(F.col("extra_mode")).alias("mode"))
    return m.select("request_id", "mode", textsource.need_ocr(F.col("mode")).alias("need_ocr"), textsource.need_pdf(F.col("mode")).alias("need_pdf"))


@query(f"WITH {E} SELECT pdf_id, page_no, count(*) AS n, string_agg(bbox_id, ',' ORDER BY bbox_id) AS places, max(x1) AS furthest FROM e GROUP BY pdf_id, page_no")
def detections_by_page(spark, d):
    e = elements(spark, d).withColumnsRenamed({"bbox_id": "order_idx"}).withColumn("det_ord", F.lit(0))
    got = draw.detections_by_page(e, PAGE)
    return got.select(*PAGE, F.size("regions").cast("long").alias("n"), F.array_join(F.col("regions.order_idx").cast("array<string>"), ",").alias("places"), F.array_max("regions.bbox.x1").alias("furthest"))


# Fixed values of the check: red, green and blue by label_idx.
_COLOURS = "(0, 255, 0, 0), (1, 0, 255, 0), (2, 0, 0, 255), (3, 255, 255, 0), (4, 255, 0, 255), (5, 0, 255, 255), (6, 128, 0, 128), (7, 255, 165, 0), (8, 128, 128, 128), (9, 0, 128, 0), (10, 255, 20, 147)"


@query(f"""WITH {E}, {SIZES}, c(label_id, r, g, b) AS (VALUES {_COLOURS}), s AS (SELECT pdf_id, page_no, bbox_id AS order_idx, label_id, proba, trunc(x0 * scale)::INTEGER AS x, trunc(y0 * scale)::INTEGER AS y, greatest(trunc(x1 * scale - x0 * scale), 0)::INTEGER AS w, greatest(trunc(y1 * scale - y0 * scale), 0)::INTEGER AS h FROM e JOIN p USING (pdf_id, page_no))
    SELECT pdf_id, page_no, order_idx, "offset", x - "offset" AS x, y - "offset" AS y, w + 2 * "offset" AS w, h + 2 * "offset" AS h, greatest(x, 5) AS text_x, y AS text_y, r, g, b, CASE WHEN y >= 0 THEN display_name || ' ' || order_idx END AS caption FROM s JOIN c USING (label_id) JOIN labels_dim ON label_idx = label_id, (VALUES (0), (1), (2)) v("offset") WHERE w > 0 AND h > 0""")
def draw_commands(spark, d):
    """Rectangles with their colours and captions; the score in a caption, rounded by the JVM, is left to the tests."""
    e = with_label(elements(spark, d).join(pages(spark, d), PAGE).withColumnsRenamed({"bbox_id": "order_idx"}))
    caption = F.regexp_replace("caption", " [0-9]\\.[0-9]{2} ", " ").alias("caption")
    return draw.layout_commands(e, PAGE).select(*PAGE, "order_idx", "offset", "x", "y", "w", "h", "text_x", "text_y", "r", "g", "b", caption)


@query()
def json_elements(spark, d):
    e = with_label(elements(spark, d)).withColumn("order_idx", F.col("bbox_id"))
    p = pages(spark, d).withColumnsRenamed({"pw": "pdf_w", "ph": "pdf_h", "iw": "image_w", "ih": "image_h"})
    return export.page_json(e, p, PAGE)


@query(f"""WITH {E}, {SIZES}, n AS (SELECT *, (row_number() OVER (PARTITION BY pdf_id, page_no ORDER BY bbox_id) - 1)::INTEGER AS place FROM e)
    SELECT pdf_id, page_no, pw, ph, iw, ih, scale, page_no AS meta_page, place, json_name AS label, page_no AS own_page, bbox_id, x0, y0, x1, y1, proba, is_ocr, text FROM p LEFT JOIN n USING (pdf_id, page_no)""")
def json_rows(spark, d):
    """What a reader of the exported JSON gets: every member of every page and element, in place."""
    box = "STRUCT<min: ARRAY<FLOAT>, max: ARRAY<FLOAT>>"
    shape = f"STRUCT<layouts: ARRAY<STRUCT<bbox: {box}, label: STRING, page_no: INT, bbox_id: INT, proba: FLOAT, ocr: STRUCT<is_ocr: BOOLEAN>, text: STRING>>, metadata: STRUCT<pdf_size: ARRAY<FLOAT>, image_size: ARRAY<FLOAT>, scale: FLOAT, page: INT>>"
    got = json_elements(spark, d).select(*PAGE, F.from_json("json", shape).alias("j"))
    m, e = F.col("j.metadata"), F.col("e")
    flat = got.select(*PAGE, m["pdf_size"][0].alias("pw"), m["pdf_size"][1].alias("ph"), m["image_size"][0].alias("iw"), m["image_size"][1].alias("ih"), m["scale"].alias("scale"), m["page"].alias("meta_page"), F.posexplode_outer("j.layouts").alias("place", "e"))
    return flat.select(
        *PAGE, "pw", "ph", "iw", "ih", "scale", "meta_page", "place", e["label"].alias("label"), e["page_no"].alias("own_page"), e["bbox_id"].alias("bbox_id"),
        e["bbox"]["min"][0].alias("x0"), e["bbox"]["min"][1].alias("y0"), e["bbox"]["max"][0].alias("x1"), e["bbox"]["max"][1].alias("y1"), e["proba"].alias("proba"), e["ocr"]["is_ocr"].alias("is_ocr"), e["text"].alias("text"),
    )


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CLEAN = "regexp_replace(regexp_replace(text, '\\x1b\\[[0-9;]*[A-Za-z]', '', 'g'), '\\r\\n|\\r|\\x{2028}|\\x{2029}|\\x{85}', chr(10), 'g')"
_CLEAN = f"translate(regexp_replace({_CLEAN}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\x{{FEFF}}]', '', 'g'), {_quoted(textsource.QUOTES_FROM + _WIDE)}, {_quoted(textsource.QUOTES_TO + _PLAIN)})"
for _a, _b in textsource.LIGATURES:
    _CLEAN = f"replace({_CLEAN}, '{_a}', '{_b}')"


@query(f"WITH {E} SELECT elem_id, {_CLEAN} AS cleaned FROM e0 WHERE text IS NOT NULL")
def clean_text(spark, d):
    return elements(spark, d).where("text IS NOT NULL").select("elem_id", textsource.clean_text(F.col("text")).alias("cleaned"))


@query()
def fix_text(spark, d):
    """Every text as the pipeline would repair it."""
    return elements(spark, d).where("text IS NOT NULL").select("elem_id", textsource.fix_text(F.col("text")).alias("fixed"))


_ORDERED_MERGE = f"""v AS (SELECT pdf_id, page_no, row_number() OVER (PARTITION BY pdf_id, page_no ORDER BY k0) - 1 AS bbox_id, r.id AS id, r.tag AS label_id, r.proba AS proba, r.x0 AS x0, r.y0 AS y0, r.x1 AS x1, r.y1 AS y1
    FROM (SELECT pdf_id, page_no, done, unnest(done) AS r, unnest(generate_series(1, len(done))) AS k0 FROM f WHERE i > len(a)))"""


@query(f"WITH RECURSIVE {TALL}, {NMS}, {_ORDERED_MERGE}, {COLUMNS % 'v'}, {ORDERED % 10} SELECT pdf_id, page_no, order_idx, id AS bbox_id, label_id, proba, x0, y0, x1, y1 FROM q")
def page_layout(spark, d):
    """The flagship: merged elements of every page in reading order."""
    merged = merge.merge_overlapping(tall(spark, d), PAGE)
    return order.reading_order(merged, PAGE).select(*PAGE, "order_idx", "bbox_id", "label_id", "proba", "bbox.*")


_RAW = f"""t AS (WITH {SCORES}, k AS (SELECT m.*, vec_id // 25 AS page, embedding AS v FROM m JOIN embeddings USING (vec_id) WHERE NOT (proba < 0.1::FLOAT)),
    b AS (SELECT vec_id, page, label_id, proba, 512::FLOAT + v[12] * 512::FLOAT AS cx, 512::FLOAT + v[13] * 512::FLOAT AS cy, v[14] * 512::FLOAT AS w, v[15] * 512::FLOAT AS h FROM k)
    SELECT page AS pdf_id, 0 AS page_no, (row_number() OVER (PARTITION BY page ORDER BY vec_id) - 1)::INTEGER AS bbox_id, label_id, proba,
    greatest(cx - w * 0.5::FLOAT, 0::FLOAT) * 0.8::FLOAT AS x0, greatest(cy - h * 0.5::FLOAT, 0::FLOAT) * 0.8::FLOAT AS y0, least(cx + w * 0.5::FLOAT, 1024::FLOAT) * 0.8::FLOAT AS x1, least(cy + h * 0.5::FLOAT, 1024::FLOAT) * 0.8::FLOAT AS y1 FROM b)"""


@query(f"WITH RECURSIVE {_RAW}, {NMS}, {_ORDERED_MERGE}, {COLUMNS % 'v'}, {ORDERED % 10} SELECT pdf_id AS page, order_idx, id AS bbox_id, label_id, proba, x0, y0, x1, y1 FROM q")
def layout_pipeline(spark, d):
    """Raw predictions through decoding, merging and ordering."""
    return pipeline.layout(raw_predictions(spark, d), ["page"]).select("page", "order_idx", "bbox_id", "label_id", "proba", "bbox.*")


@query("SELECT DISTINCT elem_id, label, ocr.is_ocr AS is_ocr FROM elements")
def stream_once(spark, d):
    """The elements as a stream, each delivered once, drained into the shared folder.

    The path is a pattern, so that one file serves as well as a folder.  The watermark outlasts the data, so late rows are kept as the SQL keeps them.
    """
    from vellumgrid.runtime import workspace
    from vellumgrid.streaming import inbox

    schema = load(spark, d, "elements").schema
    at = f"{workspace(spark)}/stream-{uuid.uuid4().hex}"
    rows = inbox.once(inbox.element_stream(spark, f"{d}/elements.parque[t]", schema), delay="36500 days").select("elem_id", "label", F.col("ocr.is_ocr").alias("is_ocr"))
    rows.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")


@query("SELECT (epoch(seen_at)::BIGINT // 86400) * 86400 AS window_start, label, count(*) AS n, count(*) FILTER (WHERE ocr.is_ocr) AS n_ocr FROM elements GROUP BY ALL")
def stream_windows(spark, d):
    """Deliveries by day and label, counted as a stream; each trigger writes the whole table of windows anew."""
    from vellumgrid.runtime import workspace
    from vellumgrid.streaming import inbox

    at = f"{workspace(spark)}/stream-{uuid.uuid4().hex}"
    counts = inbox.by_window(inbox.element_stream(spark, f"{d}/elements.parque[t]", load(spark, d, "elements").schema), width="1 day")
    run = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    run.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{at}/rows")).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{at}/rows").withColumn("window_start", F.unix_timestamp("window_start"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
