"""The whole way from raw predictions to ordered, text-bearing elements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions import geometry as G
from vellumgrid.functions.labels import with_label
from vellumgrid.operators import decode, draw, lines, merge, order, textsource, tokens
from vellumgrid.operators.options import BackendMissing, DetectOptions, LayoutOptions, ParserOptions, RecognizeOptions
from vellumgrid.sources import backends

PAGE = ["doc_id", "page_no"]


def layout(raw: DataFrame, page: list[str] = PAGE, options: LayoutOptions = LayoutOptions(), mode: str = "lines") -> DataFrame:
    """Raw predictions to merged elements in reading order."""
    kept = merge.merge_overlapping(decode.decode(raw, page, options), page, options.merge_overlap)
    return order.reading_order(kept, page, "rank", options.line_tolerance, mode)


def texts(elements: DataFrame, chars: DataFrame, page: list[str] = PAGE, options: ParserOptions = ParserOptions()) -> DataFrame:
    """Elements with the PDF's own text, and whether recognition is needed."""
    pdf = textsource.text_in_boxes(elements, chars, page, "order_idx")
    if options.clean_text:
        pdf = pdf.withColumn("pdf_text", textsource.fix_text(F.col("pdf_text")))
    return textsource.first_pass(elements.join(pdf, [*page, "order_idx"]), F.lit(options.mode))


def recognized(elements: DataFrame, token_scores: DataFrame, characters: list[str], page: list[str] = PAGE, options: ParserOptions = ParserOptions(), rec: RecognizeOptions = RecognizeOptions()) -> DataFrame:
    """Elements after recognition; token_scores(page..., order_idx, det_ord, t, probs, error).

    A region that failed adds nothing, but its element counts as recognised all the same.
    """
    key = [*page, "order_idx"]
    words = tokens.decode_steps(token_scores.where("error IS NULL"), [*key, "det_ord"], characters, rec.least_token_score)
    words = words.unionByName(token_scores.where("error IS NOT NULL").select(*key, "det_ord", F.lit(None).cast("string").alias("text")))
    ocr = tokens.fold_text(words, key)
    if options.clean_text:
        ocr = ocr.withColumn("ocr_text", textsource.fix_text(F.col("ocr_text")))
    return textsource.second_pass(elements, ocr, key)


@dataclass
class Backends:
    renderer: "backends.RenderBackend | None" = None
    layout: "backends.InferBackend | None" = None
    detector: "backends.InferBackend | None" = None
    recognizer: "backends.InferBackend | None" = None
    characters: "list[str] | None" = None


@dataclass
class Result:
    """elements with labels; errors by document or page; the sizes of the pages that were rendered; their images, PAGES."""

    elements: DataFrame
    errors: DataFrame
    pages: DataFrame
    images: DataFrame


def analyze(requests: DataFrame, use: Backends, chars: DataFrame | None = None, parser: ParserOptions = ParserOptions(), lay: LayoutOptions = LayoutOptions(), det: DetectOptions = DetectOptions(), rec: RecognizeOptions = RecognizeOptions()) -> Result:
    """requests(doc_id, content, password, start, end) -> Result.

    What fails, a document, page, crop or region, is a row of errors; the rest goes on.
    """
    from vellumgrid.runtime import stash

    characters = use.characters
    if parser.mode != "Pdf" and use.detector is not None and use.recognizer is not None and characters is None:
        characters = backends.model_characters(use.recognizer)

    if parser.mode != "Pdf" and use.detector is None:
        raise BackendMissing(f"mode {parser.mode} needs an InferBackend for text detection")
    pages = stash(backends.render_pages(requests, use.renderer, lay.input_size), "pages")
    raw = stash(backends.infer_layout(pages, use.layout, lay), "raw")
    errors = pages.where("error IS NOT NULL").select(*PAGE, "error").unionByName(raw.where("error IS NOT NULL").select(*PAGE, "error"))
    spark = requests.sparkSession
    chars = spark.createDataFrame([], backends.CHARS) if chars is None else chars
    if "error" in chars.columns:
        chars = stash(chars, "chars")
        errors = errors.unionByName(chars.where("error IS NOT NULL").select(*PAGE, "error"))
        chars = chars.where("error IS NULL")
    elements = stash(texts(layout(raw.where("error IS NULL"), PAGE, lay), chars, PAGE, parser), "elements")
    if parser.mode != "Pdf":
        wanted = elements.where("needs_ocr").join(pages.select(*PAGE, "scale", "img_w", "img_h"), PAGE)
        rect = wanted.withColumn("c", G.crop_rect(G.scale(F.col("bbox"), F.col("scale")), F.col("img_w"), F.col("img_h"))).select(*PAGE, "order_idx", "c.x", "c.y", "c.w", "c.h")
        found = stash(backends.detect_regions(pages, rect, use.detector, det), "regions")
        errors = errors.unionByName(found.where("error IS NOT NULL").select(*PAGE, "error"))
        boxes = found.where("error IS NULL").select(*PAGE, "order_idx", "contour_idx", "proba", F.struct("x0", "y0", "x1", "y1").alias("bbox"))
        merged = lines.merged_lines(boxes, [*PAGE, "order_idx"], tolerance=det.line_tolerance, gap=det.merge_gap)
        sized = merged.join(pages.select(*PAGE, "img_w", "img_h"), PAGE).withColumn("c", G.crop_rect(F.col("bbox"), F.col("img_w"), F.col("img_h")))
        scores = stash(backends.recognize_regions(pages, sized.select(*PAGE, "order_idx", "det_ord", "c.x", "c.y", "c.w", "c.h"), use.recognizer, rec), "scores")
        errors = errors.unionByName(scores.where("error IS NOT NULL").select(*PAGE, "error"))
        elements = recognized(elements, scores, characters, PAGE, parser, rec)
    size = F.lit(float(lay.input_size)).cast("float")
    sizes = pages.where("error IS NULL").select(*PAGE, "pdf_w", "pdf_h", size.alias("image_w"), size.alias("image_h"), "scale")
    return Result(with_label(elements), errors, sizes, pages)


def debug_images(result: Result) -> DataFrame:
    """(doc_id, page_no, png): the pages with their elements drawn on them."""
    boxes = draw.layout_commands(result.elements.join(result.pages.select(*PAGE, "scale"), PAGE), PAGE)
    return draw.page_images(result.images, boxes, PAGE)
