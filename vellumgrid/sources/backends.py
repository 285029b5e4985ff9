"""Pluggable renderers and models.  None is part of the engine: a stage without its backend says so.

The work around a model is here: image fitting, normalisation, session caching
by worker, and the Arrow maps that feed it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.operators.options import BackendMissing, DetectOptions, LayoutOptions, RecognizeOptions


class RenderBackend(Protocol):
    """Opens a document and gives its pages; must be picklable."""

    def page_count(self, content: bytes, password: str | None) -> int: ...

    def render(self, content: bytes, password: str | None, page_no: int, size: int) -> tuple[np.ndarray, float, float, float]:
        """(RGB image, page width, page height, scale)."""
        ...


class InferBackend(Protocol):
    """input array -> output array; must be picklable."""

    def run(self, x: np.ndarray) -> np.ndarray: ...


class OnnxBackend:
    """An ONNX model by path; the session is built once in each worker."""

    _sessions: dict = {}

    def __init__(self, path: str, threads: int = 1, providers: "tuple[str, ...]" = ("CPUExecutionProvider",), optimize: bool = True) -> None:
        """threads: within one operation; a task has one core, so more only helps where tasks have more."""
        self.path, self.threads, self.providers, self.optimize = path, threads, providers, optimize

    def session(self):
        if self.path not in self._sessions:
            import onnxruntime as ort

            o = ort.SessionOptions()
            o.intra_op_num_threads = self.threads
            o.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL if self.optimize else ort.GraphOptimizationLevel.ORT_ENABLE_BASIC
            self._sessions[self.path] = ort.InferenceSession(self.path, o, providers=list(self.providers))
        return self._sessions[self.path]

    def run(self, x: np.ndarray) -> np.ndarray:
        s = self.session()
        return s.run(None, {s.get_inputs()[0].name: x})[0]

    def metadata(self, key: str) -> str | None:
        return self.session().get_modelmeta().custom_metadata_map.get(key)


def model_characters(model: InferBackend) -> list[str]:
    """The character list of a recogniser, read once, on the driver, from the metadata it brings along."""
    from vellumgrid.operators.tokens import dictionary

    text = model.metadata("character") if hasattr(model, "metadata") else None
    if not text:
        raise BackendMissing("the recogniser brings no character list: give Backends.characters")
    return dictionary(text)


def _cubic(x: np.ndarray) -> np.ndarray:
    """Catmull-Rom kernel."""
    x = np.abs(x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))


def _axis(n: int, m: int) -> np.ndarray:
    """m x n matrix that resamples n points to m; wider support when shrinking."""
    ratio = n / m
    stretch = max(ratio, 1.0)
    centre = (np.arange(m) + 0.5) * ratio - 0.5
    weights = _cubic((np.arange(n)[None, :] - centre[:, None]) / stretch)
    return weights / weights.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Separable cubic resampling of an H x W x C image."""
    width, height = max(1, int(width)), max(1, int(height))
    out = np.einsum("yh,hwc->ywc", _axis(image.shape[0], height), image.astype(np.float64))
    return np.clip(np.einsum("xw,ywc->yxc", _axis(image.shape[1], width), out), 0, 255)


def layout_input(image: np.ndarray, options: LayoutOptions = LayoutOptions()) -> np.ndarray:
    """1 x 3 x N x N in 0..1: fitted with rounded sizes to the top left, grey elsewhere."""
    n = options.input_size
    s = np.float32(min(np.float32(n) / np.float32(image.shape[1]), np.float32(n) / np.float32(image.shape[0])))
    w, h = int(np.floor(image.shape[1] * s + 0.5)), int(np.floor(image.shape[0] * s + 0.5))
    out = np.full((1, 3, n, n), options.background / 255, dtype=np.float32)
    out[0, :, :h, :w] = (resize(image, w, h) / 255).transpose(2, 0, 1)[:, :n, :n]
    return out


def detector_input(image: np.ndarray, options: DetectOptions = DetectOptions()) -> tuple[np.ndarray, tuple[int, int]]:
    """(1 x 3 x N x N in -1..1, (w, h) after fitting); sizes are cut, the rest is 0.5."""
    n = options.input_size
    s = np.float32(min(np.float32(n) / np.float32(image.shape[1]), np.float32(n) / np.float32(image.shape[0])))
    w, h = max(1, int(image.shape[1] * s)), max(1, int(image.shape[0] * s))
    out = np.full((1, 3, n, n), 0.5, dtype=np.float32)
    out[0, :, :h, :w] = (resize(image, w, h) / 127.5 - 1).transpose(2, 0, 1)
    return out, (w, h)


def recognizer_input(image: np.ndarray, options: RecognizeOptions = RecognizeOptions()) -> np.ndarray:
    """1 x 3 x H x W in -1..1; tall images are turned a quarter clockwise first."""
    if options.rotate_above > 0 and image.shape[0] / image.shape[1] > options.rotate_above:
        image = np.rot90(image, -1)
    w = max(1, int(image.shape[1] * np.float32(np.float32(options.input_height) / np.float32(image.shape[0]))))
    return ((resize(image, w, options.input_height) / 127.5 - 1).transpose(2, 0, 1)[None]).astype(np.float32)


def scan_documents(spark, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content, length, modified): one row a file; content is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content", "length", F.col("modificationTime").alias("modified"))


PAGES = "doc_id string, page_no int, pdf_w float, pdf_h float, scale float, img_w int, img_h int, image binary, error string"


#: pages of a document that one task renders
PAGES_A_TASK = 256


def render_pages(requests: DataFrame, renderer: RenderBackend | None, size: int = 1024, block: int = PAGES_A_TASK) -> DataFrame:
    """requests(doc_id, content, password, start, end) -> PAGES; a page that fails carries its error instead of an image,
    a document that fails or has fewer pages than where the range starts is one such row.

    The first block of pages of a document is rendered where its file was read.
    Only files of more pages travel, one copy a further block, so that no task
    renders a whole large file.
    """
    if renderer is None:
        raise BackendMissing("rendering needs a RenderBackend")

    def pages(r) -> tuple[int, int]:
        count = renderer.page_count(r.content, r.password)
        if count < r.start:  # as many is no error
            raise ValueError(f"start {r.start} beyond {count} pages")
        return r.start, min(r.end, count)

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                try:
                    first, last = pages(r)
                except Exception:  # noqa: BLE001, S112  (reported with the first block)
                    continue
                for n in range(first + block, last, block):
                    yield pd.DataFrame([(r.doc_id, r.content, r.password, n, min(last, n + block))], columns=["doc_id", "content", "password", "start", "end"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PAGES.split(", ")]
        for b in batches:
            for r in b.itertuples(index=False):
                try:
                    first, last = pages(r)
                except Exception as e:  # noqa: BLE001  (any fault of the file fails the document, not the job)
                    yield pd.DataFrame([(r.doc_id, None, None, None, None, None, None, None, str(e))], columns=names)
                    continue
                for n in range(first, min(last, first + block)):
                    try:
                        image, w, h, s = renderer.render(r.content, r.password, n, size)
                        row = (r.doc_id, n, w, h, s, image.shape[1], image.shape[0], np.ascontiguousarray(image, dtype=np.uint8).tobytes(), None)
                    except Exception as e:  # noqa: BLE001
                        row = (r.doc_id, n, None, None, None, None, None, None, str(e))
                    yield pd.DataFrame([row], columns=names)

    asked = requests.select("doc_id", "content", "password", "start", "end")
    rest = asked.mapInPandas(further, "doc_id string, content binary, password string, start int, end int").repartition("doc_id", "start")
    return asked.mapInPandas(run, PAGES).unionByName(rest.mapInPandas(run, PAGES))


CHARS = "doc_id string, page_no int, char_idx int, ch string, x float, y float, error string"


def page_chars(requests: DataFrame, reader: "RenderBackend | None") -> DataFrame:
    """requests(doc_id, content, password, start, end) -> CHARS, by the backend's optional method
    chars(content, password, page_no) -> [(character, x, y)], in points from the top left.
    A document or page that fails is a row of its error, without a character."""
    if reader is None or not hasattr(reader, "chars"):
        raise BackendMissing("embedded text needs a backend with chars()")

    def failed(doc: str, page: int | None, e: Exception) -> pd.DataFrame:
        return pd.DataFrame([(doc, page, None, None, None, None, str(e))], columns=[c.split()[0] for c in CHARS.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                try:
                    last = min(r.end, reader.page_count(r.content, r.password))
                except Exception as e:  # noqa: BLE001
                    yield failed(r.doc_id, None, e)
                    continue
                for n in range(r.start, last):
                    try:
                        got = reader.chars(r.content, r.password, n)
                    except Exception as e:  # noqa: BLE001
                        yield failed(r.doc_id, n, e)
                        continue
                    if got:
                        yield pd.DataFrame({"doc_id": r.doc_id, "page_no": n, "char_idx": range(len(got)), "ch": [g[0] for g in got], "x": [g[1] for g in got], "y": [g[2] for g in got], "error": None})

    return requests.select("doc_id", "content", "password", "start", "end").mapInPandas(run, CHARS)


def whole_pages(pages: DataFrame) -> DataFrame:
    """One crop a page, the page itself: text detection without a layout."""
    return pages.where("error IS NULL").select("doc_id", "page_no", F.lit(0).alias("order_idx"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("img_w").alias("w"), F.col("img_h").alias("h"))


RAW = "doc_id string, page_no int, anchor_idx int, cx float, cy float, w float, h float, scores array<float>, scale float, image_w float, image_h float, error string"


def infer_layout(pages: DataFrame, model: InferBackend | None, options: LayoutOptions = LayoutOptions()) -> DataFrame:
    """PAGES -> raw predictions; anchors below the score threshold do not leave the worker."""
    if model is None:
        raise BackendMissing("layout analysis needs an InferBackend")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RAW.split(", ")]
        for b in batches:
            for r in b.itertuples(index=False):
                try:
                    image = np.frombuffer(r.image, dtype=np.uint8).reshape(int(r.img_h), int(r.img_w), 3)
                    out = np.asarray(model.run(layout_input(image, options)), dtype=np.float32).reshape(4 + options.classes, -1)
                    keep = np.flatnonzero(~(out[4:].max(axis=0) < np.float32(options.least_score)))
                    if not len(keep):  # an empty frame has no types
                        continue
                    yield pd.DataFrame({
                        "doc_id": r.doc_id, "page_no": r.page_no, "anchor_idx": keep, "cx": out[0, keep], "cy": out[1, keep], "w": out[2, keep], "h": out[3, keep],
                        "scores": list(out[4:, keep].T), "scale": r.scale, "image_w": float(options.input_size), "image_h": float(options.input_size), "error": None,
                    })
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame([(r.doc_id, r.page_no, *[None] * 9, str(e))], columns=names)

    return pages.where("error IS NULL").select("doc_id", "page_no", "scale", "img_w", "img_h", "image").mapInPandas(run, RAW)


def detect_regions(pages: DataFrame, crops: DataFrame, model: InferBackend | None, options: DetectOptions = DetectOptions()) -> DataFrame:
    """crops(doc_id, page_no, order_idx, x, y, w, h) on PAGES -> text regions in page pixels.

    Pages and their crops meet by cogroup, so each image travels once.  A crop
    that fails is a row of its error; the others of the page go on.
    """
    from vellumgrid.operators.regions import postprocess

    if model is None:
        raise BackendMissing("text detection needs an InferBackend")
    schema = "doc_id string, page_no int, order_idx int, contour_idx int, x0 float, y0 float, x1 float, y1 float, proba float, error string"

    def run(page: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for p in page.itertuples(index=False):
            image = np.frombuffer(p.image, dtype=np.uint8).reshape(int(p.img_h), int(p.img_w), 3)
            for c in own.itertuples(index=False):
                part = image[c.y : c.y + c.h, c.x : c.x + c.w]
                if not part.size:
                    continue
                try:
                    x, fitted = detector_input(part, options)
                    got = postprocess(np.asarray(model.run(x), dtype=np.float32).reshape(options.input_size, options.input_size), (part.shape[1], part.shape[0]), fitted, options)
                except Exception as e:  # noqa: BLE001
                    rows.append((c.doc_id, c.page_no, c.order_idx, *[None] * 6, str(e)))
                    continue
                rows += [(c.doc_id, c.page_no, c.order_idx, k, b[0] + c.x, b[1] + c.y, b[2] + c.x, b[3] + c.y, s, None) for k, (b, s) in enumerate(got)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    left = pages.where("error IS NULL").select("doc_id", "page_no", "img_w", "img_h", "image").groupBy("doc_id", "page_no")
    return left.cogroup(crops.groupBy("doc_id", "page_no")).applyInPandas(run, schema)


def recognize_regions(pages: DataFrame, regions: DataFrame, model: InferBackend | None, options: RecognizeOptions = RecognizeOptions()) -> DataFrame:
    """regions(doc_id, page_no, order_idx, det_ord, x, y, w, h) on PAGES -> token scores (…, t, probs, error); a region that fails is a row of its error."""
    if model is None:
        raise BackendMissing("text recognition needs an InferBackend")
    schema = "doc_id string, page_no int, order_idx int, det_ord int, t int, probs array<float>, error string"

    def run(page: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for p in page.itertuples(index=False):
            image = np.frombuffer(p.image, dtype=np.uint8).reshape(int(p.img_h), int(p.img_w), 3)
            for c in own.itertuples(index=False):
                part = image[c.y : c.y + c.h, c.x : c.x + c.w]
                if not part.size:
                    continue
                try:
                    out = np.asarray(model.run(recognizer_input(part, options)), dtype=np.float32)
                    rows += [(c.doc_id, c.page_no, c.order_idx, c.det_ord, t, step, None) for t, step in enumerate(out.reshape(out.shape[-2], out.shape[-1]))]
                except Exception as e:  # noqa: BLE001
                    rows.append((c.doc_id, c.page_no, c.order_idx, c.det_ord, None, None, str(e)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    left = pages.where("error IS NULL").select("doc_id", "page_no", "img_w", "img_h", "image").groupBy("doc_id", "page_no")
    return left.cogroup(regions.groupBy("doc_id", "page_no")).applyInPandas(run, schema)
