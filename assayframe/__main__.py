"""Batch command: ``python -m assayframe INPUT --out FOLDER [--fhir] [--sex M|F] [--reader MODULE:FUNCTION]``.

INPUT is a folder of ``.txt`` reports, or of PDF files if ``--reader`` names a function from bytes to
``{"text", "tables", "pages"}``. No model is asked.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import report
from .sources import reports


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="assayframe")
    p.add_argument("input")
    p.add_argument("--out", required=True)
    p.add_argument("--fhir", action="store_true")
    p.add_argument("--sex", choices=["M", "F"])
    p.add_argument("--reader")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("assayframe").getOrCreate()
    if a.reader:
        module, name = a.reader.split(":")
        got = report.analyze_files(spark, a.input, getattr(importlib.import_module(module), name), sex=a.sex)
    else:
        texts = spark.read.text(a.input, wholetext=True).select(F.input_file_name().alias("report_id"), F.col("value").alias("text"))
        got = report.analyze(texts.withColumn("tables", F.lit(None).cast("array<array<array<string>>>")), sex=a.sex)
    reports.write_csv(got.summary, f"{a.out}/summary")
    reports.write_csv(reports.safe_findings(got.findings), f"{a.out}/findings")
    reports.write_csv(got.unmatched, f"{a.out}/unmatched")
    reports.write_csv(got.errors, f"{a.out}/errors")
    if a.fhir:
        got.bundles().write.mode("overwrite").json(f"{a.out}/fhir")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
