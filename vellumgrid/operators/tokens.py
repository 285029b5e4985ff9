"""Recogniser output to text: confident class of each step, repeats and blanks removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions.geometry import argmax_last


def token_class(probs: Column, least: float = 0.5) -> Column:
    """Class of a step: the last of equal maxima if its score exceeds least, else 0, the blank; NaN is a blank."""
    top = F.array_max(probs)
    return F.when((top > F.lit(least).cast("float")) & ~F.isnan(top), argmax_last(probs)).otherwise(F.lit(0))


def collapse(classes: Column, characters: Column) -> Column:
    """Text of an array of classes.

    A class is written if it is no blank, differs from the step before and is in
    the dictionary; a class outside the dictionary still counts as the step before.
    """
    # zipped with itself moved on by one: looking back by index would build the array anew for every step
    before = F.array_insert(classes, 1, F.lit(-1))
    steps = F.filter(F.zip_with(classes, before, lambda c, b: F.struct(c.alias("c"), b.alias("b"))), lambda s: s["c"].isNotNull())
    kept = F.filter(steps, lambda s: (s["c"] != 0) & (s["c"] < F.size(characters)) & (s["c"] != s["b"]))
    return F.array_join(F.transform(kept, lambda s: F.get(characters, s["c"])), "")


def decode_steps(df: DataFrame, region: list[str], characters: list[str], least: float = 0.5) -> DataFrame:
    """df(region..., t, probs) -> (region..., text)."""
    steps = df.select(*region, F.struct("t", token_class(F.col("probs"), least).alias("c")).alias("s"))
    ordered = steps.groupBy(*region).agg(F.array_sort(F.collect_list("s")).alias("s"))
    words = F.array(*[F.lit(c) for c in characters])
    return ordered.select(*region, collapse(F.col("s.c"), words).alias("text"))


def dictionary(metadata: str) -> list[str]:
    """The character list of a recogniser: the blank's mark, the metadata's lines, a space."""
    lines = metadata.replace("\r\n", "\n").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return ["#", *lines, " "]


def trimmed(text: Column, read: Column) -> Column:
    """The text of a region read on its own: without outer white space; a blank reading leaves the text as it is."""
    bare = F.regexp_replace(F.regexp_replace(read, "^[\\s\\u0085\\p{Z}]+", ""), "[\\s\\u0085\\p{Z}]+$", "")
    return F.when(bare != "", bare).otherwise(text)


def fold_text(df: DataFrame, element: list[str], order: str = "det_ord", text: str = "text") -> DataFrame:
    """(element..., ocr_text): the strings of an element in order, each followed by a line break; null strings are skipped."""
    one = F.when(F.col(text).isNotNull(), F.concat(text, F.lit("\n")))
    got = df.groupBy(*element).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("t")))).alias("s"))
    return got.select(*element, F.array_join(F.filter(F.col("s.t"), lambda t: t.isNotNull()), "").alias("ocr_text"))
