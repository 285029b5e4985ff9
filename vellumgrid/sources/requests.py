"""Requests: which pages of which document, in which mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 65535


def _number(part: Column, default: int) -> Column:
    """An unsigned 16-bit number, a plus sign allowed; anything else is the default."""
    good = part.rlike("^\\+?[0-9]{1,18}$")
    value = F.when(good, F.replace(part, F.lit("+"), F.lit("")).cast("long"))
    return F.when(value <= MOST, value).otherwise(F.lit(default)).cast("int")


def page_range(spec: Column) -> Column:
    """struct(start, end), half open.  'a..b', 'a..', '..b'; a single n means the first n pages; all else is every page."""
    parts = F.split(spec, "\\.\\.")
    two, one = F.size(parts) == 2, F.size(parts) == 1
    start = F.when(spec.isNotNull() & two, _number(F.get(parts, F.lit(0)), 0)).otherwise(0)
    end = F.when(spec.isNull(), MOST).when(two, _number(F.get(parts, F.lit(1)), MOST)).when(one, _number(F.get(parts, F.lit(0)), MOST)).otherwise(MOST)
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def page_slice(requests: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """requests(key..., start, end) joined with the pages(key..., page_no) of their range; applied before any rendering."""
    return requests.join(pages, key).where("page_no >= start AND page_no < end")


def range_errors(requests: DataFrame, page_counts: DataFrame, key: list[str]) -> DataFrame:
    """Requests that fail: their document has fewer pages than where the range starts (as many is no error)."""
    return requests.join(page_counts, key, "left").where(F.coalesce("page_count", F.lit(0)) < F.col("start")).withColumn("error", F.format_string("start %d beyond %d pages", "start", F.coalesce("page_count", F.lit(0))))
