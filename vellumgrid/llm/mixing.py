"""Problem 8: records of several sources combined to target shares of the total size.

The total is the largest at which no source needs more than its tokens times its
repeats.  A low-discrepancy schedule orders the mix: slot k carries the source
into whose stretch of the cumulative weights the k-th golden-ratio point falls;
the slots of a source are ranked, and its shuffled records, repeats pass by
pass, are joined in blocks of equal tokens, one block a slot.  The share of each
source is right over every stretch of the schedule, not only over the whole.

Defined cases: records of a null id, of a source without a target or of no
tokens are left out; repeated rows of an id count once; a target of 0 takes
nothing; a targeted source without records is an empty share, and the others
keep their proportions; extra columns are ignored; an empty table gives an
empty result; negative targets or repeats below 1 are a ValueError.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumgrid.runtime import stash

#: the fractional part of the golden ratio, scaled to 2 ** 53 (a fixed value): exact integer arithmetic
GOLDEN = 5566755282872655
ONE = 1 << 53
#: rows of one part of a source, about; a part is what one task sorts
PART_ROWS = 50_000
#: slots a mix; a block then holds 1 / SLOTS of the whole
SLOTS = 4096


def golden(k: int) -> float:
    return (k * GOLDEN % ONE) / ONE


def schedule(weights: list[tuple[str, float]], slots: int) -> dict[str, list[int]]:
    """Source -> its slots in order."""
    total = sum(w for _, w in weights)
    out: dict[str, list[int]] = {s: [] for s, _ in weights}
    for k in range(slots if total > 0 else 0):
        x, last = golden(k) * total, None
        for s, w in weights:
            if w <= 0:
                continue
            last = s
            if x < w:
                break
            x -= w
        out[last].append(k)
    return out


def budget(sizes: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, int]:
    """Tokens to take of each source: the largest mix of the target shares within the repeats."""
    there = {s: t for s, (t, _) in targets.items() if t > 0 and sizes.get(s, 0) > 0}
    if not there:
        return {}
    whole = sum(there.values())
    total = min(sizes[s] * targets[s][1] / (t / whole) for s, t in there.items())
    return {s: int(total * t / whole) for s, t in there.items()}


def mix(records: DataFrame, key: str, source: str, size: str, targets: dict[str, tuple[float, int]], seed: int = 17, slots: int = SLOTS) -> DataFrame:
    """(id, source, use_no, n_tokens, slot): every use of a record and its place in the schedule.

    targets: source -> (share, most uses of one record).  A running sum over a
    whole source would put it into one task, so records are dealt by hash to
    parts of about PART_ROWS of each source and pass; sums of parts shift the sums within.
    """
    for s, (share, repeats) in targets.items():
        if share < 0 or repeats < 1:
            raise ValueError(f"target {share} with {repeats} uses of {s}")
    rows = records.select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(size).cast("long").alias("n_tokens")).where("id IS NOT NULL AND n_tokens > 0").where(F.col("source").isin(list(targets)))
    # of rows of one id that differ the least counts, whatever their order
    rows = stash(rows.groupBy("id").agg(F.min(F.struct("source", "n_tokens")).alias("r")).select("id", "r.*"), "mix")
    known = rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()  # one row a targeted source
    sizes = {r["source"]: r["t"] for r in known}
    bits = max(4, (max([r["n"] for r in known], default=1) // PART_ROWS).bit_length())
    want = budget(sizes, targets)
    spark = rows.sparkSession
    plan = schedule(sorted((s, float(t)) for s, t in want.items()), slots)
    quota = spark.createDataFrame([(s, want[s], -(-want[s] // sizes[s]), max(1, len(plan[s]))) for s in want], "source string, want long, passes int, own long")
    # a fixed, small table: one row a source
    uses = rows.join(F.broadcast(quota), "source").withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    uses = uses.withColumn("h", F.xxhash64(F.lit(seed), "use_no", "id")).withColumn("part", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    within = W.partitionBy("source", "use_no", "part").orderBy("h", "id")
    dealt = uses.withColumn("upto", F.sum("n_tokens").over(within.rowsBetween(W.unboundedPreceding, 0)))
    totals = uses.groupBy("source", "use_no", "part").agg(F.sum("n_tokens").alias("t"))
    order = W.partitionBy("source").orderBy("use_no", "part").rowsBetween(W.unboundedPreceding, -1)
    shift = totals.withColumn("shift", F.coalesce(F.sum("t").over(order), F.lit(0))).drop("t")
    placed = dealt.join(shift, ["source", "use_no", "part"]).withColumn("from", F.col("shift") + F.col("upto") - F.col("n_tokens"))
    # a record is in while its middle lies within the source's share
    taken = placed.where(F.col("from") * 2 + F.col("n_tokens") <= F.col("want") * 2)
    ranked = taken.withColumn("rank", F.least((F.col("from") * F.col("own") / F.col("want")).cast("long"), F.col("own") - 1))
    places = spark.createDataFrame([(s, r, k) for s in want for r, k in enumerate(plan[s])], "source string, rank long, slot int")
    return ranked.join(F.broadcast(places), ["source", "rank"], "left").select("id", "source", "use_no", "n_tokens", "slot")


def shares(mixed: DataFrame, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """(source, records, uses, tokens, share, target_share) of a mix; one row a targeted source."""
    spark = mixed.sparkSession
    goal = spark.createDataFrame([(s, float(t)) for s, (t, _) in sorted(targets.items())], "source string, target_share double")
    per_id = mixed.groupBy("source", "id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("tokens"))
    by = per_id.groupBy("source").agg(F.count("*").alias("records"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum("tokens").alias("tokens"))
    whole = F.sum("tokens").over(W.partitionBy())
    return goal.join(by, "source", "left").na.fill(0, ["records", "uses", "most_uses", "tokens"]).withColumn("share", F.col("tokens") / whole).select("source", "records", "uses", "most_uses", "tokens", "share", "target_share")
