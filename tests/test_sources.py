import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumgrid import runtime
from vellumgrid.operators import draw
from vellumgrid.operators.options import BackendMissing, ParserOptions
from vellumgrid.plans import pipeline
from vellumgrid.sources import backends, export, requests


def test_page_specs(spark):
    cases = {None: (0, 65535), "0..5": (0, 5), "1..": (1, 65535), "..5": (0, 5), "3": (0, 3), "x": (0, 65535), "a..b": (0, 65535), "1..2..3": (0, 65535), "0..=5": (0, 65535),
             "70000": (0, 65535), "+5": (0, 5), " 5": (0, 65535), "": (0, 65535), "..": (0, 65535), "99999999999999999999999..2": (0, 2)}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: (r["r"]["start"], r["r"]["end"]) for r in df.select("s", requests.page_range(F.col("s")).alias("r")).collect()}
    assert got == cases


def test_slices_and_range_errors(spark):
    req = spark.createDataFrame([("a", 1, 3), ("b", 5, 9), ("c", 2, 9)], "doc string, start int, end int")
    pages = spark.createDataFrame([(d, n) for d in "ab" for n in range(5)], "doc string, page_no int")
    got = sorted((r["doc"], r["page_no"]) for r in requests.page_slice(req, pages, ["doc"]).collect())
    assert got == [("a", 1), ("a", 2)]
    counts = spark.createDataFrame([("a", 5), ("b", 5)], "doc string, page_count int")
    assert [r["doc"] for r in requests.range_errors(req, counts, ["doc"]).collect()] == ["c"]


def test_page_json(spark):
    e = spark.createDataFrame([("d", 0, 1, (0.0, 1.0, 2.0, 3.0), "ListItem", 7, 0.5, False, "x"), ("d", 0, 0, (0.0, 1.0, 2.0, 3.0), "Text", 3, 0.25, None, None)],
                              "doc_id string, page_no int, order_idx int, bbox struct<x0:float,y0:float,x1:float,y1:float>, json_name string, bbox_id int, proba float, is_ocr boolean, text string")
    p = spark.createDataFrame([("d", 0, 612.0, 792.0, 1024.0, 1024.0, 1.5), ("d", 1, 612.0, 792.0, 1024.0, 1024.0, 1.5)], "doc_id string, page_no int, pdf_w float, pdf_h float, image_w float, image_h float, scale float")
    got = {r["page_no"]: json.loads(r["json"]) for r in export.page_json(e, p, ["doc_id", "page_no"]).collect()}
    assert got[1]["layouts"] == [] and got[1]["metadata"] == {"pdf_size": [612.0, 792.0], "image_size": [1024.0, 1024.0], "scale": 1.5, "page": 1}
    assert [x["bbox_id"] for x in got[0]["layouts"]] == [3, 7]
    assert got[0]["layouts"][0]["ocr"] is None and got[0]["layouts"][0]["text"] is None
    assert got[0]["layouts"][1] == {"bbox": {"min": [0.0, 1.0], "max": [2.0, 3.0]}, "label": "ListItem", "page_no": 0, "bbox_id": 7, "proba": 0.5, "ocr": {"is_ocr": False}, "text": "x"}


def test_draw_commands_and_png(spark):
    e = spark.createDataFrame([("d", 0, 0, (1.0, 2.0, 11.0, 12.0), 0.876, 2.0, "Text", 0, 128, 0), ("d", 0, 1, (5.0, -9.0, 9.0, 3.0), 0.5, 2.0, "Title", 1, 2, 3), ("d", 0, 2, (5.0, 5.0, 5.1, 9.0), 0.5, 2.0, "Text", 0, 0, 0)],
                              "doc_id string, page_no int, order_idx int, bbox struct<x0:float,y0:float,x1:float,y1:float>, proba float, scale float, display_name string, r int, g int, b int")
    got = draw.layout_commands(e, ["doc_id", "page_no"]).orderBy("order_idx", "offset").collect()
    assert [(r["order_idx"], r["offset"], r["x"], r["y"], r["w"], r["h"]) for r in got[:3]] == [(0, 0, 2, 4, 20, 20), (0, 1, 1, 3, 22, 22), (0, 2, 0, 2, 24, 24)]
    assert got[0]["caption"] == "Text 0.88 0" and got[0]["text_x"] == 5
    assert got[3]["caption"] is None and {r["order_idx"] for r in got} == {0, 1}
    image = draw.paint(np.zeros((8, 8, 3), dtype=np.uint8), [(1, 1, 4, 4, (255, 0, 0)), (-2, -2, 30, 30, (1, 1, 1))])
    assert image[1, 1].tolist() == [255, 0, 0] and image[2, 2].tolist() == [0, 0, 0]
    assert draw.png(image).startswith(b"\x89PNG")


def fakes():
    """Local classes: workers get them by value."""

    class Renderer:
        def page_count(self, content, password):
            if content == b"bad":
                raise ValueError("no document")
            return 2

        def render(self, content, password, page_no, size):
            if page_no == 1:
                raise ValueError("no page")
            return np.full((64, 64, 3), 255, dtype=np.uint8), 32.0, 32.0, 2.0

    class Layout:
        def run(self, x):
            out = np.zeros((1, 15, 4), dtype=np.float32)
            out[0, :4, 0] = (20, 20, 20, 20)
            out[0, 4 + 9, 0] = 0.9
            out[0, :4, 1] = (44, 44, 20, 20)
            out[0, 4 + 6, 1] = 0.8
            return out

    class Detector:
        def run(self, x):
            out = np.zeros((1, 1, 960, 960), dtype=np.float32)
            out[0, 0, 100:300, 100:800] = 0.95
            return out

    class Recognizer:
        def run(self, x):
            probs = np.zeros((1, 3, 4), dtype=np.float32)
            for t, c in enumerate((1, 0, 2)):
                probs[0, t, c] = 0.9
            return probs

    return Renderer(), Layout(), Detector(), Recognizer()


def test_analyze_end_to_end(spark):
    req = spark.createDataFrame([("d", bytearray(b"ok"), None, 0, 65535), ("e", bytearray(b"bad"), None, 0, 2)], "doc_id string, content binary, password string, start int, end int")
    chars = spark.createDataFrame([("d", 0, 0, "h", 10.0, 10.0), ("d", 0, 1, "i", 11.0, 10.0)], "doc_id string, page_no int, char_idx int, ch string, x float, y float")
    use = pipeline.Backends(*fakes(), ["#", "a", "b", " "])
    result = pipeline.analyze(req, use, chars)
    got = {r["json_name"]: (r["text"], r["is_ocr"]) for r in result.elements.collect()}
    assert got == {"Text": ("hi", False), "Picture": ("ab\n", True)}
    assert sorted((r["doc_id"], r["error"]) for r in result.errors.collect()) == [("d", "no page"), ("e", "no document")]


def test_command_line(spark, tmp_path):
    from vellumgrid.plans import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"ok")
    args = cli.arguments([str(tmp_path / "in"), str(tmp_path / "out"), "--page", "1", "--mode", "Pdf"])
    cli.run(spark, args, pipeline.Backends(*fakes()))
    got = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(got) == 1 and got[0]["metadata"] == {"pdf_size": [32.0, 32.0], "image_size": [1024.0, 1024.0], "scale": 2.0, "page": 0}
    assert [e["label"] for e in got[0]["layouts"]] == ["Text", "Picture"] and got[0]["layouts"][0]["text"] == ""
    with pytest.raises(BackendMissing):
        cli.run(spark, args)


def test_missing_backends_say_so(spark):
    empty = spark.createDataFrame([], "doc_id string, content binary, password string, start int, end int")
    with pytest.raises(BackendMissing):
        backends.render_pages(empty, None)
    with pytest.raises(BackendMissing):
        backends.infer_layout(empty, None)


def test_model_inputs():
    image = np.zeros((50, 200, 3), dtype=np.uint8)
    assert backends.recognizer_input(image).shape == (1, 3, 48, 192)
    assert backends.recognizer_input(np.zeros((100, 50, 3), dtype=np.uint8)).shape == (1, 3, 48, 96)
    x = backends.layout_input(np.full((792, 612, 3), 255, dtype=np.uint8))
    assert x.shape == (1, 3, 1024, 1024) and abs(x[0, 0, 0, 0] - 1) < 1e-6 and abs(x[0, 0, 0, 1023] - 144 / 255) < 1e-6
    x, fitted = backends.detector_input(np.full((800, 1000, 3), 255, dtype=np.uint8))
    assert fitted == (960, 768) and x[0, 0, 900, 0] == 0.5 and abs(x[0, 0, 0, 0] - 1) < 1e-6


def test_binary_scan(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    assert [(bytes(r["content"]), r["length"]) for r in backends.scan_documents(spark, str(tmp_path)).collect()] == [(b"one", 3)]


def test_stash_and_spread(spark):
    df = runtime.stash(spark.range(10).withColumnRenamed("id", "k"), "t")
    assert df.count() == 10
    runtime.clear(spark)
    with pytest.raises(Exception, match="."):
        df.count()
    df = spark.range(10)
    assert runtime.spread(df.coalesce(1)).rdd.getNumPartitions() >= runtime.parallelism(spark)


def test_streams(spark, tmp_path):
    from vellumgrid.streaming import inbox

    rows = [(1, "Text", "2026-01-01 00:10:00", True), (1, "Text", "2026-01-01 00:10:00", True), (2, "Text", "2026-01-01 00:20:00", False), (3, "Table", "2026-01-01 01:20:00", False)]
    df = spark.createDataFrame(rows, "elem_id long, label string, s string, o boolean").select("elem_id", "label", F.col("s").cast("timestamp").alias("seen_at"), F.struct(F.col("o").alias("is_ocr")).alias("ocr"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = inbox.once(inbox.element_stream(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName("once_").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["elem_id"] for r in spark.sql("SELECT * FROM once_").collect()) == [1, 2, 3]
    q = inbox.by_window(inbox.element_stream(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName("windows_").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["label"], r["n"], r["n_ocr"]) for r in spark.sql("SELECT * FROM windows_").collect()) == [("Table", 1, 0), ("Text", 3, 2)]


@pytest.mark.parametrize("mode", ["Ocr", "Auto"])
def test_no_detector_says_so(spark, mode):
    empty = spark.createDataFrame([], "doc_id string, content binary, password string, start int, end int")
    renderer, layout, _, recognizer = fakes()
    use = pipeline.Backends(renderer, layout, None, recognizer)
    with pytest.raises(BackendMissing):
        pipeline.analyze(empty, use, parser=ParserOptions(mode=mode))
    assert pipeline.analyze(empty, use, parser=ParserOptions(mode="Pdf")).elements.count() == 0


def test_start_beyond_the_pages_is_an_error(spark):
    rows = [(k, bytearray(b"ok"), None, start, 65535) for k, start in (("beyond", 3), ("at the end", 2), ("within", 0))]
    req = spark.createDataFrame(rows, "doc_id string, content binary, password string, start int, end int")
    got = backends.render_pages(req, fakes()[0]).where("error IS NOT NULL").select("doc_id", "page_no", "error").collect()
    assert sorted(tuple(r) for r in got) == [("beyond", None, "start 3 beyond 2 pages"), ("within", 1, "no page")]


def request(spark, *docs):
    return spark.createDataFrame([(d, bytearray(b"ok"), None, 0, 65535) for d in docs], "doc_id string, content binary, password string, start int, end int")


def test_characters_come_with_the_model_and_a_failing_crop_is_an_error(spark):
    """The list is read from the recogniser's metadata; one region fails, the others are read."""
    renderer, layout, detector, plain = fakes()

    class Model:
        runs = 0

        def metadata(self, key):
            return "a\nb\n" if key == "character" else None

        def run(self, x):
            self.runs += 1
            if self.runs == 2:
                raise ValueError("no reading")
            return plain.run(x)

    class ThreeBoxes:
        def run(self, x):
            out = layout.run(x)
            out[0, :4, 2] = (10, 50, 16, 16)
            out[0, 4 + 6, 2] = 0.7
            return out

    result = pipeline.analyze(request(spark, "d"), pipeline.Backends(renderer, ThreeBoxes(), detector, Model()))
    got = result.elements.select("text", "is_ocr").collect()
    assert sorted(r["text"] for r in got) == ["", "ab\n", "ab\n"] and all(r["is_ocr"] for r in got)
    assert sorted(r["error"] for r in result.errors.collect()) == ["no page", "no reading"]


def test_no_characters_say_so(spark):
    class Mute:
        def metadata(self, key):
            return ""

    for model in (Mute(), fakes()[3]):
        with pytest.raises(BackendMissing):
            backends.model_characters(model)
        with pytest.raises(BackendMissing):
            pipeline.analyze(request(spark, "d"), pipeline.Backends(*fakes()[:3], model))


def test_metadata_builds_the_session():
    """A fresh model knows its metadata before it has run."""
    model = backends.OnnxBackend("no such file.onnx")
    with pytest.raises(Exception, match="(?i)no such file"):
        model.metadata("character")


def test_detector_errors_are_rows(spark):
    class Broken:
        def run(self, x):
            raise ValueError("no detection")

    renderer, layout, _, recognizer = fakes()
    result = pipeline.analyze(request(spark, "d"), pipeline.Backends(renderer, layout, Broken(), recognizer, ["#", "a", "b", " "]))
    assert result.elements.count() == 2 and {r["error"] for r in result.errors.collect()} == {"no page", "no detection"}


def test_large_documents_are_rendered_in_blocks(spark):
    class Book:
        def page_count(self, content, password):
            return len(content)

        def render(self, content, password, page_no, size):
            if page_no == 5:
                raise ValueError("page five")
            return np.zeros((2, 2, 3), dtype=np.uint8), 1.0, 1.0, 1.0

    rows = [("book", bytearray(b"x" * 11), None, 1, 65535), ("sheet", bytearray(b"x"), None, 0, 65535), ("none", bytearray(b""), None, 0, 5), ("late", bytearray(b"x"), None, 3, 5)]
    req = spark.createDataFrame(rows, "doc_id string, content binary, password string, start int, end int")
    got = backends.render_pages(req, Book(), block=3).select("doc_id", "page_no", "error").collect()
    assert sorted((r["doc_id"], r["page_no"]) for r in got if r["error"] is None) == [("book", n) for n in range(1, 11) if n != 5] + [("sheet", 0)]
    assert sorted((r["doc_id"], r["error"]) for r in got if r["error"]) == [("book", "page five"), ("late", "start 3 beyond 1 pages")]


def test_characters_of_failing_pages_are_rows(spark):
    class Reader:
        def page_count(self, content, password):
            if content == b"bad":
                raise ValueError("no document")
            return 2

        def chars(self, content, password, page_no):
            if page_no:
                raise ValueError("no text")
            return [("a", 1.0, 2.0)]

    rows = [("d", bytearray(b"ok"), None, 0, 9), ("e", bytearray(b"bad"), None, 0, 9)]
    req = spark.createDataFrame(rows, "doc_id string, content binary, password string, start int, end int")
    got = {(r["doc_id"], r["page_no"], r["ch"], r["error"]) for r in backends.page_chars(req, Reader()).collect()}
    assert got == {("d", 0, "a", None), ("d", 1, None, "no text"), ("e", None, None, "no document")}


def test_pages_leave_in_order_and_errors_beside_them(spark, tmp_path):
    from vellumgrid.plans import cli

    rows = spark.createDataFrame([(d, n, f"{d}{n}") for n in (3, 0, 2, 1) for d in "ba"], "doc_id string, page_no int, json string").repartition(5)
    export.write_json(rows, str(tmp_path / "json"))
    files = sorted((tmp_path / "json").glob("part-*"))
    assert "".join(f.read_text() for f in files).split() == [f"{d}{n}" for d in "ab" for n in range(4)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"ok")
    (tmp_path / "in" / "b.pdf").write_bytes(b"bad")
    cli.run(spark, cli.arguments([str(tmp_path / "in"), str(tmp_path / "out"), "--mode", "Pdf"]), pipeline.Backends(*fakes()))
    assert sorted(json.loads(r["value"])["error"] for r in spark.read.text(str(tmp_path / "out.errors")).collect()) == ["no document", "no page"]


def test_debug_images(spark, tmp_path):
    from vellumgrid.plans import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"ok")
    cli.run(spark, cli.arguments([str(tmp_path / "in"), str(tmp_path / "out"), "--mode", "Pdf", "--debug"]), pipeline.Backends(*fakes()))
    rows = spark.read.parquet(str(tmp_path / "out.debug")).collect()
    assert [r["page_no"] for r in rows] == [0] and bytes(rows[0]["png"]).startswith(b"\x89PNG")
    blank = draw.png(np.full((64, 64, 3), 255, dtype=np.uint8))
    assert bytes(rows[0]["png"]) != blank
    pages = spark.createDataFrame([("d", 0, 2, 2, bytearray(12))], "doc_id string, page_no int, img_w int, img_h int, image binary")
    none = spark.createDataFrame([], "doc_id string, page_no int, x int, y int, w int, h int, r int, g int, b int")
    assert bytes(draw.page_images(pages, none, ["doc_id", "page_no"]).first()["png"]) == draw.png(np.zeros((2, 2, 3), dtype=np.uint8))
