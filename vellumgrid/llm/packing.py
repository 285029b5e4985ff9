"""Problem 7: texts put into containers of fixed capacity with little space left over.

Sizes are tokens of a public tokenizer.  Texts longer than the capacity are cut
into full pieces and a rest.  All sizes together are a histogram of at most
`capacity` counts, whatever the number of texts: minimum bin slack works on the
histogram.  For each container the largest size left opens it; a bitset
subset-sum dynamic program over a window of sizes, and over all sizes where the
window leaves slack, picks the multiset that fills the rest closest to capacity;
the pattern repeats as often as the counts allow.
Item numbers within a size, counted in parallel, then meet their slots in a join.

Defined cases: null ids and null texts are no items; an empty text has no tokens
and takes no room, it joins no container; repeated rows of an id count once;
ties go by id; extra columns are ignored; an empty table gives an empty result;
a capacity below 1 is a ValueError.
"""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumgrid.runtime import stash

#: vocabulary of a public byte-level tokenizer; a parameter, never part of the repository
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODINGS: dict = {}


def encoding(path: str = VOCABULARY):
    """The tokenizer, read once in each process."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("vellumgrid", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    """Tokens of the whole text, never cut: the tokenizer merges even one endless piece in about linear time."""
    return len(encoding(path).encode_ordinary(text))


def with_tokens(df: DataFrame, text: str, out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """df with the number of tokens of its text column (null for null).

    path is the driver's; the file is sent to the executors, which need no copy of their own.
    """
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        seen: dict[str, int] = {}
        got = []
        for t in texts:
            if t is None:
                got.append(None)
            else:
                if t not in seen:
                    seen[t] = count_tokens(t, SparkFiles.get(name))
                got.append(seen[t])
        return pd.Series(got, dtype="Int64")

    return df.withColumn(out, run(F.col(text)))


def fill(counts: dict[int, int], capacity: int, window: int = 64) -> list[tuple[int, dict[int, int]]]:
    """Minimum bin slack on a histogram: (containers of this pattern, {size: items in each}).

    The largest size left opens a container; over the sizes that fit beside it
    a bitset of reachable sums finds the fullest filling, and backtracking finds
    its multiset.  The `window` most plentiful and evenly spaced sizes are tried
    first, all sizes where those leave slack.
    """
    left = {s: n for s, n in counts.items() if n > 0 and s > 0}
    if any(s > capacity for s in left):
        raise ValueError("an item exceeds the capacity")
    out: list[tuple[int, dict[int, int]]] = []
    while left:
        first = max(left)
        pattern = {first: 1}
        left[first] -= 1
        room = capacity - first
        for s, n in _best_subset(left, room, window).items():
            pattern[s] = pattern.get(s, 0) + n
        left[first] += 1
        times = min(left[s] // n for s, n in pattern.items())
        for s, n in pattern.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        out.append((times, pattern))
    return out


def _best_subset(left: dict[int, int], room: int, window: int) -> dict[int, int]:
    """The multiset of available sizes whose sum is closest to room from below."""
    fit = [s for s, n in left.items() if n and s <= room]
    if len(fit) > window:
        common = sorted(fit, key=lambda s: (-left[s], -s))[: window // 2]
        rest = sorted(set(fit) - set(common), reverse=True)
        step = max(1, len(rest) // (window - len(common)))
        chosen = _subset(left, room, common + rest[::step][: window - len(common)])
        if sum(s * n for s, n in chosen.items()) == room:
            return chosen
    return _subset(left, room, fit)


def _subset(left: dict[int, int], room: int, fit: list[int]) -> dict[int, int]:
    """The multiset of the sizes fit whose sum is closest to room from below."""
    fit = sorted(fit, reverse=True)
    mask = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for s in fit:
        # binary splitting of the count: 1, 2, 4, ... items at once
        n, k = min(left[s], room // s), 1
        while n > 0:
            k = min(k, n)
            trail.append((s, k, reach))
            reach |= (reach << (s * k)) & mask
            n -= k
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for s, k, before in reversed(trail):
        if not before >> total & 1:
            chosen[s] = chosen.get(s, 0) + k
            total -= s * k
    return chosen


def pack(items: DataFrame, capacity: int, key: str, size: str, window: int = 64) -> DataFrame:
    """(id, piece_no, n_pieces, size, container): every piece of every item in one container."""
    return pack_kinds(items, {"": capacity}, key, size, window).drop("kind")


def pack_kinds(items: DataFrame, capacities: dict[str, int], key: str, size: str, window: int = 64) -> DataFrame:
    """(kind, id, piece_no, n_pieces, size, container): all items in containers of each kind.

    The kinds are cut, counted and joined together, so their number adds no stage.
    Only the histograms (at most as many rows as the capacities together) reach
    the driver; slots are written back as ranges, at most as many as there are
    patterns times sizes.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("the capacity must be at least 1")
    spark = items.sparkSession
    rows = items.select(F.col(key).alias("id"), F.col(size).cast("long").alias("n")).where("id IS NOT NULL AND n > 0").groupBy("id").agg(F.max("n").alias("n"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("long").alias("capacity")) for k, c in sorted(capacities.items())])) if capacities else F.explode(F.array().cast("array<struct<kind:string,capacity:bigint>>"))
    each = rows.select("id", "n", kinds.alias("k")).select("id", "n", "k.*").withColumn("n_pieces", (F.floor((F.col("n") - 1) / F.col("capacity")) + 1).cast("int"))
    sizes = F.transform(F.sequence(F.lit(1), F.col("n_pieces")), lambda i: F.when(i < F.col("n_pieces"), F.col("capacity")).otherwise(F.col("n") - (F.col("n_pieces") - 1) * F.col("capacity")).cast("int"))
    cut = each.select("kind", "id", "n_pieces", F.posexplode(sizes).alias("piece_no", "size"))
    parts = max(8, int(each.agg(F.sum("n_pieces")).first()[0] or 0) // PART_ROWS)
    pieces = stash(numbered(cut, parts), "pieces")
    counts: dict[str, dict[int, int]] = {}
    for r in pieces.groupBy("kind", "size").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["kind"], {})[r["size"]] = r["n"]
    slots = []
    for kind, own in sorted(counts.items()):
        at, used = 0, {}
        for times, pattern in fill(own, capacities[kind], window):
            for s, n in pattern.items():
                a = used.get(s, 0)
                slots.append((kind, s, a, a + n * times, n, at))
                used[s] = a + n * times
            at += times
    ranges = spark.createDataFrame(slots, "kind string, size int, a long, b long, per int, first long")
    # numbers meet their range by the block of the size they fall into
    by = pieces.withColumn("block", (F.col("number") / BLOCK).cast("long"))
    spans = ranges.withColumn("block", F.explode(F.sequence((F.col("a") / BLOCK).cast("long"), ((F.col("b") - 1) / BLOCK).cast("long"))))
    met = by.join(spans, ["kind", "size", "block"]).where("number >= a AND number < b")
    return met.select("kind", "id", (F.col("piece_no") + 1).alias("piece_no"), "n_pieces", "size", (F.col("first") + ((F.col("number") - F.col("a")) / F.col("per")).cast("long")).alias("container"))


BLOCK = 4096
#: rows of one part of a size, about; a part is what one task sorts
PART_ROWS = 50_000


def numbered(pieces: DataFrame, parts: int) -> DataFrame:
    """pieces with number: 0, 1, 2 ... within a kind and size, by hash part, id and piece.

    A size may be that of a third of all rows: numbers are counted within
    (size, part of the id's hash) and shifted by the parts before, so that no
    task ever sorts a whole size.
    """
    own = ["kind", "size"]
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("id", "piece_no"), F.lit(parts)).cast("int"))
    dealt = dealt.withColumn("rank", F.row_number().over(W.partitionBy(*own, "part").orderBy("id", "piece_no")) - 1)
    totals = dealt.groupBy(*own, "part").agg(F.count("*").alias("c"))
    before = totals.withColumn("shift", F.coalesce(F.sum("c").over(W.partitionBy(*own).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(*own, "part", "shift")
    return dealt.join(before, [*own, "part"]).select("kind", "id", "piece_no", "n_pieces", "size", (F.col("rank") + F.col("shift")).alias("number"))
