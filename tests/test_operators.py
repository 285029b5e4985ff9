import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumgrid.functions.labels import LABELS, label_index, with_label
from vellumgrid.operators import decode, lines, merge, order, regions, textsource, tokens
from vellumgrid.operators.options import DetectOptions

SCHEMA = "p int, bbox_id int, label_id int, proba float, bbox struct<x0:float,y0:float,x1:float,y1:float>"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    small = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return w * h / small if w > 0 and h > 0 and small > 0 else 0.0


def grown(a, b):
    return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def merged_by_hand(boxes):
    boxes = sorted(boxes, key=lambda r: (-(r[4][2] - r[4][0]) * (r[4][3] - r[4][1]), r[1]))
    gone, out = set(), []
    for i, (p, n, lab, s, cur) in enumerate(boxes):
        if i in gone:
            continue
        for j in range(i + 1, len(boxes)):
            if overlap(cur, boxes[j][4]) > 0.45:
                cur = grown(cur, boxes[j][4])
                lab = boxes[j][2] if boxes[j][3] > s else lab
                gone.add(j)
        out.append((n, lab, cur))
    return out


def test_merge_equals_the_sequential_fold(spark):
    rng = random.Random(5)
    rows = []
    for p in range(40):
        for n in range(rng.randint(1, 14)):
            x, y = rng.randrange(0, 300), rng.randrange(0, 300)
            rows.append((p, n, rng.randrange(11), rng.randrange(1, 128) / 128, (float(x), float(y), float(x + rng.randrange(10, 160)), float(y + rng.randrange(10, 160)))))
    got: dict = {}
    for r in merge.merge_overlapping(frame(spark, rows), ["p"]).orderBy("p", "rank").collect():
        got.setdefault(r["p"], []).append((r["bbox_id"], r["label_id"], tuple(r["bbox"])))
    for p in range(40):
        assert got[p] == merged_by_hand([r for r in rows if r[0] == p])


def test_merge_keeps_score_and_takes_the_last_better_label(spark):
    rows = [(0, 0, 9, 0.5, (0.0, 0.0, 100.0, 100.0)), (0, 1, 10, 0.9, (10.0, 10.0, 40.0, 40.0)), (0, 2, 3, 0.6, (10.0, 10.0, 30.0, 30.0))]
    r = merge.merge_overlapping(frame(spark, rows), ["p"]).collect()
    assert [(x["bbox_id"], x["label_id"], x["proba"]) for x in r] == [(0, 3, 0.5)]
    assert merge.merge_overlapping(frame(spark, []), ["p"]).count() == 0


def test_line_merge_is_no_gaps_and_islands(spark):
    rows = [(0, n, 0, 1.0, (x0, 0.0, x1, 5.0)) for n, (x0, x1) in enumerate([(0.0, 50.0), (55.0, 80.0), (90.0, 120.0), (140.0, 150.0)])]
    got = merge.merge_lines(frame(spark, rows).withColumnRenamed("bbox_id", "x_rank"), ["p"]).orderBy("x_rank").collect()
    assert [(r["bbox"][0], r["bbox"][2]) for r in got] == [(0.0, 80.0), (90.0, 120.0), (140.0, 150.0)]


def test_line_chunk_compares_with_the_one_before(spark):
    rows = [(0, n, 0, 1.0, (float(-n), y - 1.0, float(-n) + 2, y + 1.0)) for n, y in enumerate([0.0, 9.0, 18.0, 28.0])]
    got = lines.with_lines(frame(spark, rows), ["p"], "bbox_id").orderBy("bbox_id").collect()
    assert [r["line_id"] for r in got] == [0, 0, 0, 1]
    assert [r["x_rank"] for r in got] == [2, 1, 0, 0]


def test_reading_order_example(spark):
    ids = {"Text": 9, "Title": 10, "PageHeader": 5, "PageFooter": 4}
    rows = [
        (0, 0, ids["Text"], 0.9, (100.0, 50.0, 200.0, 80.0)), (0, 1, ids["Title"], 0.95, (50.0, 30.0, 150.0, 60.0)), (0, 2, ids["PageHeader"], 0.98, (20.0, 10.0, 120.0, 40.0)),
        (0, 3, ids["PageFooter"], 0.85, (80.0, 200.0, 180.0, 230.0)), (0, 4, ids["Text"], 0.88, (150.0, 100.0, 250.0, 130.0)),
    ]
    for mode in ("lines", "pairwise"):
        got = order.reading_order(frame(spark, rows), ["p"], "bbox_id", mode=mode).orderBy("order_idx").collect()
        assert [r["bbox_id"] for r in got] == [2, 1, 0, 4, 3], mode
    with pytest.raises(ValueError):
        order.reading_order(frame(spark, rows), ["p"], "bbox_id", mode="other")


def test_orders_agree_where_the_comparison_is_sound(spark):
    rng = random.Random(9)
    rows = []
    for p in range(30):
        for n in range(rng.randint(1, 12)):
            x, y = rng.choice((30, 330)) + rng.randrange(20), rng.randrange(12) * 60 + rng.randrange(5)
            rows.append((p, n, rng.choice((9, 9, 9, 10, 5, 4, 8)), 0.5, (float(x), float(y), float(x + 200), float(y + 20))))
    a = {(r["p"], r["bbox_id"]): r["order_idx"] for r in order.reading_order(frame(spark, rows), ["p"], "bbox_id").collect()}
    c = {(r["p"], r["bbox_id"]): r["order_idx"] for r in order.reading_order(frame(spark, rows), ["p"], "bbox_id", mode="pairwise").collect()}
    assert a == c


def test_multi_column_needs_four_boxes_and_a_wide_span(spark):
    def page(p, xs):
        return [(p, n, 9, 0.5, (x - 5.0, n * 30.0, x + 5.0, n * 30.0 + 10)) for n, x in enumerate(xs)]

    rows = page(0, [0, 0, 200]) + page(1, [0, 10, 20, 99]) + page(2, [0, 0, 0, 200]) + page(3, [0, 0, 200, 200, 200, 200, 200, 200])
    got = {r["p"]: r["multi_column"] for r in order.with_columns(frame(spark, rows), ["p"]).select("p", "multi_column").distinct().collect()}
    assert got == {0: False, 1: False, 2: True, 3: True}


def test_score_filter_keeps_the_threshold_and_nan(spark):
    low = float(np.nextafter(np.float32(0.1), np.float32(0)))
    df = spark.createDataFrame([(1, 0.1), (2, low), (3, float("nan"))], "k int, proba float")
    assert sorted(r["k"] for r in decode.score_filter(df, 0.1).collect()) == [1, 3]


def test_labels(spark):
    df = spark.createDataFrame([(3,), (10,)], "label_id int")
    assert {r["json_name"] for r in with_label(df).collect()} == {"ListItem", "Title"}
    with pytest.raises(Exception, match="no label"):
        with_label(spark.createDataFrame([(11,)], "label_id int")).collect()
    names = spark.createDataFrame([("List-Item",), ("ListItem",), ("Nothing",), (None,)], "n string")
    assert [r["i"] for r in names.select(label_index(F.col("n")).alias("i")).collect()] == [3, 3, None, None]
    assert len(LABELS) == 11


def test_decode_clamps_before_it_unscales(spark):
    raw = spark.createDataFrame([(0, 0, 100.0, 100.0, 300.0, 50.0, [0.0, 0.9], 2.0, 120.0, 120.0), (0, 1, 5.0, 5.0, 2.0, 2.0, [0.05, 0.01], 2.0, 120.0, 120.0)],
                                "p int, anchor_idx int, cx float, cy float, w float, h float, scores array<float>, scale float, image_w float, image_h float")
    got = decode.decode(raw, ["p"]).collect()
    assert [(r["bbox_id"], r["label_id"], tuple(r["bbox"])) for r in got] == [(0, 1, (0.0, 37.5, 60.0, 60.0))]


def test_token_collapse(spark):
    chars = F.array(*[F.lit(c) for c in tokens.dictionary("a\nb\n")])
    for classes, text in (([1, 1, 0, 1, 2, 2, 9, 2, 0], "aabb"), ([1, 9, 1], "aa"), ([0, 0], ""), ([3], " ")):
        col = tokens.collapse(F.array(*[F.lit(c) for c in classes]), chars)
        assert spark.range(1).select(col.alias("t")).first()["t"] == text
    assert tokens.dictionary("") == ["#", " "]
    assert tokens.dictionary("x\r\ny") == ["#", "x", "y", " "]


def test_token_confidence_and_steps(spark):
    df = spark.createDataFrame([(0, 0, [0.1, 0.5]), (0, 1, [0.1, 0.6]), (0, 2, [0.7, 0.6]), (0, 3, [0.0, float("nan")])], "r int, t int, probs array<float>")
    got = {r["t"]: r["c"] for r in df.select("t", tokens.token_class(F.col("probs")).alias("c")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0}
    assert tokens.decode_steps(df, ["r"], ["#", "a"]).first()["text"] == "a"


def test_text_fold_ends_every_string(spark):
    df = spark.createDataFrame([(0, 2, "b"), (0, 0, "a"), (0, 1, ""), (1, 0, None)], "e int, det_ord int, text string")
    got = {r["e"]: r["ocr_text"] for r in tokens.fold_text(df, ["e"]).collect()}
    assert got == {0: "a\n\nb\n", 1: ""}


def test_text_source_truth_table(spark):
    rows = [(m, lab, t) for m in textsource.MODES for lab in (9, 6) for t in ("pdf", "", " ")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, mode string, label_id int, pdf_text string")
    first = textsource.first_pass(df, F.col("mode"))
    ocr = spark.createDataFrame([(i, "seen\n") for i in range(len(rows))], "k int, ocr_text string")
    got = {(r["mode"], r["label_id"], r["pdf_text"]): (r["text"], r["is_ocr"]) for r in textsource.second_pass(first, ocr, ["k"]).collect()}
    assert got[("Pdf", 6, "")] == ("", False) and got[("Pdf", 9, "pdf")] == ("pdf", False)
    assert got[("Auto", 9, "pdf")] == ("pdf", False) and got[("Auto", 9, " ")] == (" ", False)
    assert got[("Auto", 6, "pdf")] == ("seen\n", True) and got[("Auto", 9, "")] == ("seen\n", True)
    assert all(got[("Ocr", lab, t)] == ("seen\n", True) for lab in (9, 6) for t in ("pdf", "", " "))
    none = textsource.second_pass(first, ocr.where("false"), ["k"]).where("mode = 'Ocr'").first()
    assert (none["text"], none["is_ocr"]) == (None, False)


def test_text_in_boxes(spark):
    e = spark.createDataFrame([(0, 1, (0.0, 0.0, 10.0, 10.0)), (0, 2, (20.0, 20.0, 30.0, 30.0))], "p int, k int, bbox struct<x0:float,y0:float,x1:float,y1:float>")
    c = spark.createDataFrame([(0, 1, "b", 5.0, 5.0), (0, 0, "a", 10.0, 0.0), (0, 2, "c", 10.5, 5.0), (1, 0, "d", 5.0, 5.0)], "p int, char_idx int, ch string, x float, y float")
    assert {r["k"]: r["pdf_text"] for r in textsource.text_in_boxes(e, c, ["p"], "k").collect()} == {1: "ab", 2: ""}


def test_clean_text(spark):
    df = spark.createDataFrame([("a\r\nb\rc",), ("\x02x\x1b[31my\x7f",), ("“ﬁn” ‘Ａ’",), (None,), ("",)], "t string")
    assert [r["t"] for r in df.select(textsource.clean_text(F.col("t")).alias("t")).collect()] == ["a\nb\nc", "xy", "\"fin\" 'A'", None, ""]


def test_regions_of_a_probability_map():
    prob = np.zeros((60, 100), dtype=np.float32)
    prob[10:22, 10:60] = 0.9
    prob[40:42, 5:9] = 0.9  # too thin once cut back
    prob[40:50, 60:90] = 0.2  # below the byte threshold
    got = regions.postprocess(prob, (200, 120), (100, 60), DetectOptions(padding=0))
    assert len(got) == 1
    (x0, y0, x1, y1), score = got[0]
    assert (x0, y0, x1, y1) == (18.0, 18.0, 120.0, 44.0) and 0.6 < score < 0.9
    assert regions.postprocess(np.zeros((8, 8), dtype=np.float32), (8, 8), (8, 8)) == []
    assert regions.postprocess(np.full((8, 8), np.nan, dtype=np.float32), (8, 8), (8, 8)) == []


def test_holes_are_contours_too():
    mask = np.zeros((12, 12), dtype=bool)
    mask[1:11, 1:11] = True
    mask[4:8, 4:8] = False
    found = regions.borders(mask)
    assert len(found) == 2
    assert {tuple(found[0].min(0)), tuple(found[0].max(0))} == {(1, 1), (10, 10)}
    assert tuple(found[1].min(0)) == (3, 3) and tuple(found[1].max(0)) == (8, 8)
    single = np.zeros((5, 5), dtype=bool)
    single[2, 2] = True
    assert [b.tolist() for b in regions.borders(single)] == [[[2, 2]]]


def test_binarize_by_bytes():
    o = DetectOptions()
    p = np.array([[153 / 255, 154 / 255, 2.0, -1.0, np.nan]], dtype=np.float32)
    assert regions.binarize(p, o).tolist() == [[False, True, True, False, False]]


def test_fix_text(spark):
    from vellumgrid.operators import textsource

    cases = {
        "caf\u00c3\u00a9": "café", "\u00e2\u20ac\u0153x\u00e2\u20ac\u009d": '"x"', "\u00c3\u0192\u00c2\u00a9": "é", "a &amp; b &lt;c&gt; &#233;": "a & b <c> é", "<b>&amp;</b>": "<b>&amp;</b>",
        "e\u0301": "é", "\x93x\x94": '"x"', "plain": "plain", "Ã": "Ã", "naïve – Ä€": "naïve – Ā", "ﬁ\r\nx": "fi\nx", "": "", None: None, "&nosuchentity; &": "&nosuchentity; &", "Ð¿Ñ\u20ac": "пр",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["f"] for r in df.select("t", textsource.fix_text(F.col("t")).alias("f")).collect()}
    assert got == cases
    assert textsource.repair_characters("Ã" * 100_000) == "Ã" * 100_000
