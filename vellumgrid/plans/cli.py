"""Command line: the pages of PDF files as JSON lines.

    python -m vellumgrid.plans.cli FOLDER_OR_FILE OUT --page 0..5 --mode Auto --backends my_module:make

What failed is written beside OUT, as OUT.errors; the commonest errors are logged too.

`my_module:make` names a function that returns vellumgrid.plans.pipeline.Backends;
rendering and models are never part of this engine.
"""

from __future__ import annotations

import argparse
import importlib
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellumgrid.operators.options import BackendMissing, ParserOptions
from vellumgrid.plans import pipeline
from vellumgrid.sources import backends, export, requests

log = logging.getLogger("vellumgrid")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="vellumgrid", description=__doc__.splitlines()[0])
    p.add_argument("path")
    p.add_argument("out")
    p.add_argument("--page", help="'a..b', 'a..', '..b' half open and from 0, or n for the first n pages; default all")
    p.add_argument("--password")
    p.add_argument("--mode", default="Auto", choices=["Auto", "Ocr", "Pdf"])
    p.add_argument("--debug", action="store_true", help="also write OUT.debug: the pages as PNG with their elements drawn on them")
    p.add_argument("--keep-text-as-is", action="store_true", help="no text cleaning")
    p.add_argument("--backends", help="module:function that returns the backends")
    return p.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace, use: "pipeline.Backends | None" = None) -> None:
    if use is None:
        if not args.backends:
            raise BackendMissing("--backends module:function is needed")
        module, _, name = args.backends.partition(":")
        use = getattr(importlib.import_module(module), name or "make")()
    files = backends.scan_documents(spark, args.path)
    wanted = files.select(F.col("path").alias("doc_id"), "content", F.lit(args.password).cast("string").alias("password"), requests.page_range(F.lit(args.page).cast("string")).alias("r"))
    parser = ParserOptions(clean_text=not args.keep_text_as_is, mode=args.mode)
    asked = wanted.select("doc_id", "content", "password", "r.*")
    chars = backends.page_chars(asked, use.renderer) if args.mode != "Ocr" and hasattr(use.renderer, "chars") else None
    got = pipeline.analyze(asked, use, chars, parser)
    export.write_json(export.page_json(got.elements, got.pages, ["doc_id", "page_no"]), args.out)
    if args.debug:
        pipeline.debug_images(got).write.mode("overwrite").parquet(f"{args.out.rstrip('/')}.debug")
    errors = f"{args.out.rstrip('/')}.errors"
    got.errors.orderBy("doc_id", "page_no").write.mode("overwrite").json(errors)
    for r in spark.read.schema(got.errors.schema).json(errors).groupBy("error").count().orderBy(F.desc("count")).limit(20).collect():
        log.warning("%d pages or documents failed: %s", r["count"], r["error"])


def main() -> None:
    logging.basicConfig(level=logging.INFO)
    run(SparkSession.builder.appName("vellumgrid").getOrCreate(), arguments())


if __name__ == "__main__":
    main()
