"""The closed set of eleven element labels: index, display name, JSON name, colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The labels in order of their index, with RGB colours.
LABELS = [
    (0, "Caption", "Caption", (255, 0, 0)),
    (1, "Footnote", "Footnote", (0, 255, 0)),
    (2, "Formula", "Formula", (0, 0, 255)),
    (3, "List-Item", "ListItem", (255, 255, 0)),
    (4, "Page-Footer", "PageFooter", (255, 0, 255)),
    (5, "Page-Header", "PageHeader", (0, 255, 255)),
    (6, "Picture", "Picture", (128, 0, 128)),
    (7, "Section-Header", "SectionHeader", (255, 165, 0)),
    (8, "Table", "Table", (128, 128, 128)),
    (9, "Text", "Text", (0, 128, 0)),
    (10, "Title", "Title", (255, 20, 147)),
]
TITLE, PAGE_HEADER, PAGE_FOOTER, PICTURE = 10, 5, 4, 6


def labels_dim(spark: SparkSession) -> DataFrame:
    """(label_id, display_name, json_name, r, g, b): eleven rows, always small enough to broadcast."""
    return spark.createDataFrame([(i, d, s, *rgb) for i, d, s, rgb in LABELS], "label_id int, display_name string, json_name string, r int, g int, b int")


def with_label(df: DataFrame, label_id: str = "label_id", strict: bool = True) -> DataFrame:
    """df joined with the names and colour of its label.  strict: an index outside 0..10 is an error, else the row is lost."""
    if strict:
        message = F.concat(F.lit("no label of index "), F.col(label_id).cast("string"))
        df = df.withColumn(label_id, F.when(F.col(label_id).between(0, len(LABELS) - 1), F.col(label_id)).otherwise(F.raise_error(message).cast("int")))
    return df.join(F.broadcast(labels_dim(df.sparkSession).withColumnRenamed("label_id", label_id)), label_id)


def label_index(name: Column) -> Column:
    """Index of a display or JSON name, in any of the two spellings; null for an unknown one."""
    m = F.create_map(*[F.lit(x) for i, _, s, _ in LABELS for x in (s, i)])
    return F.element_at(m, F.replace(name, F.lit("-"), F.lit("")))
