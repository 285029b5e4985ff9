"""Elements as a stream: redelivered ones dropped, late ones held to a watermark, pages counted by window.

Every page operator is stateless by page; what needs state is only the
deduplication of deliveries and the windowed counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def element_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of elements as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def document_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """PDF files as they arrive in a folder."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_trigger).load(path)


def once(stream: DataFrame, key: str = "elem_id", time: str = "seen_at", delay: str = "1 day") -> DataFrame:
    """Each key once; state is kept for the delay only."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def by_window(stream: DataFrame, time: str = "seen_at", width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """(window_start, label, n, n_ocr): elements by window of time and label."""
    w = F.window(time, width)
    got = stream.withWatermark(time, delay).groupBy(w, "label").agg(F.count("*").alias("n"), F.count_if(F.col("ocr.is_ocr")).alias("n_ocr"))
    return got.select(F.col("window.start").alias("window_start"), "label", "n", "n_ocr")
