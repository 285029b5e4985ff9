"""vellumgrid: a Spark engine for page-layout relations.

Detections, page text and recogniser outputs come in as DataFrames; ordered,
labelled, text-bearing page elements come out.  Everything relational is a
Catalyst plan; Arrow maps appear only where pixels or tensors are involved.
"""
