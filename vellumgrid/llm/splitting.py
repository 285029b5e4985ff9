"""Problem 5: items above a size limit cut into overlapping pieces at natural boundaries.

The least number of pieces gives equal-length targets; each target snaps to the
strongest boundary nearby (part, paragraph, line, sentence, clause, word), and a
piece is added when no choice keeps every piece within the limit at a boundary.

Defined cases: null parts count as empty; items within the limit, empty ones
included, stay whole as one piece; an item of a null id keeps it; repeated rows
give repeated pieces; a text without any boundary is cut at the targets; limit
must be positive and above the overlap, else ValueError; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "item_kind string, item_id long, piece_no int, n_pieces int, start int, end int, piece string"
# Boundaries by strength: a match ends where a cut may be made.
BOUNDARIES = (
    (6, re.compile(r"\n[ \t]*\n\s*")),
    (5, re.compile(r"\n")),
    (4, re.compile(r"[.!?…。．！？][\"'”»)\]]*\s+|[.!?…。．！？][\"'”»)\]]*(?=[^\s\w.!?\"'”»)\],;:])")),
    (3, re.compile(r"[;:,，；：]\s+")),
    (2, re.compile(r"\s+")),
    (1, re.compile(r"[-‐–—/]")),
)
PART, SENTENCE = 7, 4


def boundaries(text: str, parts: list[int]) -> dict[int, int]:
    """position -> strength of the strongest boundary there; parts: ends of the item's own parts."""
    found: dict[int, int] = {}
    for strength, pattern in reversed(BOUNDARIES):
        for m in pattern.finditer(text):
            found[m.end()] = strength
    for p in parts:
        found[p] = PART
    found.pop(0, None)
    found.pop(len(text), None)
    return found


def cuts(length: int, found: dict[int, int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece: every end - start <= limit, each start = the last end - overlap.

    The least number of pieces is placed; where a cut has no boundary within its
    bounds a piece is added from there on.  One more piece in all is tried if a
    cut fell short of the end of a sentence.  Both are forward passes, so the
    work is in proportion to the boundaries and pieces.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and below the limit")
    if length <= limit:
        return [(0, length)]
    least = -(-(length - overlap) // (limit - overlap))
    places = sorted(found)
    got, weakest = _place(length, places, found, limit, overlap, least)
    if 0 < weakest < SENTENCE or (weakest == 0 and places):
        other, best = _place(length, places, found, limit, overlap, least + 1)
        if best > weakest:
            return other
    return got


def _place(length: int, places: list[int], found: dict[int, int], limit: int, overlap: int, n: int) -> tuple[list[tuple[int, int]], int]:
    """At least n pieces, and the strength of the weakest cut, a sentence end at most; 0 for a cut at no boundary."""
    pieces, start, weakest, left = [], 0, SENTENCE, n
    while length - start > limit:
        low, high = max(start + overlap + 1, length - _reach(left - 1, limit, overlap) + overlap), min(start + limit, length - 1)
        target = start + (length - start + (left - 1) * overlap) / left
        end = _snap(places, found, low, high, target, (target - start) / 3)
        if end is None and low > start + overlap + 1:  # no boundary there: one piece more gives this cut all the room there is
            wider = start + (length - start + left * overlap) / (left + 1)
            end = _snap(places, found, start + overlap + 1, high, wider, (wider - start) / 3)
            left += end is not None
        if end is None:
            weakest, end = 0, max(low, min(high, round(target)))
        else:
            weakest = min(weakest, found[end])
        pieces.append((start, end))
        start, left = end - overlap, max(left - 1, -(-(length - end) // (limit - overlap)))
    pieces.append((start, length))
    return pieces, weakest


def _reach(n: int, limit: int, overlap: int) -> int:
    """Characters that n pieces cover at most."""
    return n * limit - (n - 1) * overlap


def _snap(places: list[int], found: dict[int, int], low: float, high: int, target: float, near: float) -> int | None:
    """The strongest boundary near the target, else the strongest allowed; ties go to the nearest, then the first."""
    a, b = bisect_left(places, max(low, target - near)), bisect_right(places, min(high, target + near))
    if a >= b:
        a, b = bisect_left(places, low), bisect_right(places, high)
    return min(places[a:b], key=lambda p: (-found[p], abs(p - target), p)) if a < b else None


def split_items(items: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """items(item_kind, item_id, parts array<string>) -> PIECES.

    limits: item_kind -> (max_chars, overlap_chars); kinds without a limit stay
    whole.  Items within their limit never leave the JVM.
    """
    for kind, (most, overlap) in limits.items():
        if most <= 0 or not 0 <= overlap < most:
            raise ValueError(f"limit {most} and overlap {overlap} of {kind}")
    limit_of = F.lit(None).cast("int")
    for kind, (most, _) in sorted(limits.items()):
        limit_of = F.when(F.col("item_kind") == kind, most).otherwise(limit_of)
    items = items.select("item_kind", F.col("item_id").cast("long").alias("item_id"), F.transform(F.coalesce("parts", F.array()), lambda p: F.coalesce(p, F.lit(""))).alias("parts"))
    size = F.aggregate("parts", F.lit(0), lambda a, p: a + F.length(p))
    sized = items.withColumn("size", size)
    whole = sized.where(~F.coalesce(F.col("size") > limit_of, F.lit(False))).select(
        "item_kind", "item_id", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.col("size").alias("end"), F.array_join("parts", "").alias("piece")
    )
    return oversized_pieces(sized.where(F.col("size") > limit_of), limits).unionByName(whole)


def oversized_pieces(items: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Pieces of items(item_kind, item_id, parts) that exceed their limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for kind, key, parts in zip(b["item_kind"], b["item_id"], b["parts"]):
                most, overlap = limits[kind]
                own = [p or "" for p in parts]
                text, ends = "".join(own), []
                for p in own[:-1]:
                    ends.append((ends[-1] if ends else 0) + len(p))
                got = cuts(len(text), boundaries(text, ends), most, overlap)
                rows += [(kind, key, k + 1, len(got), a, e, text[a:e]) for k, (a, e) in enumerate(got)]
            if rows:
                yield pd.DataFrame(rows, columns=["item_kind", "item_id", "piece_no", "n_pieces", "start", "end", "piece"])

    return items.select("item_kind", "item_id", "parts").mapInPandas(run, PIECES)
