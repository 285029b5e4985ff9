"""Where an element's text comes from: the PDF inside its box, or recognition."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions import geometry as G
from vellumgrid.functions.labels import PICTURE

MODES = ("Auto", "Ocr", "Pdf")
# Typographic marks and ligatures with their plain forms.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
QUOTES_FROM, QUOTES_TO = "‘’‚‛“”„‟", "''''\"\"\"\""


def need_ocr(mode: Column) -> Column:
    return mode.isin("Ocr", "Auto")


def need_pdf(mode: Column) -> Column:
    return mode.isin("Pdf", "Auto")


def canonical_mode(mode: Column) -> Column:
    """Auto, Ocr or Pdf in any case, padded or not; anything else is Auto."""
    m = F.initcap(F.lower(F.trim(mode)))
    return F.when(m.isin(*MODES), m).otherwise("Auto")


def text_in_boxes(elements: DataFrame, chars: DataFrame, page: list[str], key: str) -> DataFrame:
    """elements(page..., key, bbox) and chars(page..., char_idx, ch, x, y) -> (page..., key, pdf_text).

    An equi-join on the page with a range residual; elements without a character get ''.
    """
    b = F.col("bbox")
    inside = (F.col("x") >= b["x0"]) & (F.col("x") <= b["x1"]) & (F.col("y") >= b["y0"]) & (F.col("y") <= b["y1"])
    met = elements.select(*page, key, "bbox").join(chars.select(*page, "char_idx", "ch", "x", "y"), page).where(inside)
    got = met.groupBy(*page, key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_idx", "ch"))), lambda c: c["ch"]), "").alias("_t"))
    return elements.select(*page, key).join(got, [*page, key], "left").select(*page, key, F.coalesce("_t", F.lit("")).alias("pdf_text"))


def first_pass(df: DataFrame, mode: Column) -> DataFrame:
    """df(label_id, pdf_text) with text, is_ocr = false and needs_ocr.  Text of white space only is text."""
    text = F.when(need_pdf(mode), F.coalesce("pdf_text", F.lit("")))
    df = df.withColumn("text", text).withColumn("is_ocr", F.lit(False))
    lacks = (F.col("label_id") == PICTURE) | F.col("text").isNull() | (F.col("text") == "")
    return df.withColumn("needs_ocr", need_ocr(mode) & lacks)


def second_pass(df: DataFrame, ocr: DataFrame, key: list[str]) -> DataFrame:
    """df after recognition: ocr(key..., ocr_text) holds elements with at least one detection;
    their text is replaced even by an empty one."""
    met = df.join(ocr.select(*key, F.coalesce("ocr_text", F.lit("")).alias("_o")), key, "left")
    use = F.col("needs_ocr") & F.col("_o").isNotNull()
    return met.withColumn("text", F.when(use, F.col("_o")).otherwise(F.col("text"))).withColumn("is_ocr", use | F.col("is_ocr")).drop("_o")


def clean_text(text: Column) -> Column:
    """A documented subset of text repair: line breaks to LF, controls dropped, quotes
    straightened, Latin ligatures opened, full-width ASCII narrowed, terminal colours removed."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    out = F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")
    out = F.regexp_replace(out, "\r\n|\r| | |\u0085", "\n")
    out = F.regexp_replace(out, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f﻿]", "")
    out = F.translate(out, QUOTES_FROM + wide, QUOTES_TO + "".join(chr(ord(c) - 0xFEE0) for c in wide))
    for a, b in LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


#: what UTF-8 bytes read as Latin-1 or Windows-1252 look like: a lead byte's letter, then characters of continuation bytes
_MISREAD = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013\u2014\u2018-\u201a\u201c-\u201e\u2020-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]{1,3}")
_ENTITY = re.compile("&#?[0-9A-Za-z]{1,31};")
_C1 = re.compile("[\u0080-\u0084\u0086-\u009f]")


def _byte(c: str) -> int | None:
    if c <= "\xff":
        return ord(c)
    try:
        return c.encode("cp1252")[0]
    except UnicodeEncodeError:
        return None


def _reread(m: "re.Match[str]") -> str:
    """The character whose UTF-8 bytes a sequence shows, and what follows it; the sequence itself if its bytes are no UTF-8."""
    raw = [_byte(c) for c in m.group()]
    lead = raw[0] or 0
    size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    if None in raw or len(raw) < size:
        return m.group()
    try:
        return bytes(raw[:size]).decode("utf-8") + m.group()[size:]
    except UnicodeDecodeError:
        return m.group()


def repair_characters(text: str) -> str:
    """What needs more than replacing single characters: entities of a text without tags, UTF-8 read as an 8-bit
    encoding (once or again), controls that stand for Windows-1252 marks, and composed letters (NFC)."""
    if "<" not in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    while not text.isascii():
        better = _MISREAD.sub(_reread, text)  # every pass that changes a text makes it shorter
        if better == text:
            break
        text = better
    text = _C1.sub(lambda m: bytes([ord(m.group())]).decode("cp1252", "ignore") or m.group(), text)
    return unicodedata.normalize("NFC", text)


def fix_text(text: Column) -> Column:
    """Text repair: repair_characters() on texts that hold an entity or a character beyond ASCII, then clean_text()."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else repair_characters(t))

    need = F.when((F.octet_length(text) > F.length(text)) | text.contains("&"), text)
    return clean_text(F.coalesce(run(need), text))
