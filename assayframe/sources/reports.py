"""Files in and out: report folders, catalogues, exports, cached results, run tables."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

FINDING = ["report_id", "item", "display", "value_text", "unit", "status", "direction", "ref_low", "ref_high", "range_source"]


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of the PDF files of a folder, any case of the ending, not below it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "content")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def fingerprint(*parts: Column) -> Column:
    """One hash of all parts; nulls differ from empty texts."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"}), 256)


def cache_key(content: Column, config: Column) -> Column:
    return F.concat_ws("_", F.substring(F.sha2(content, 256), 1, 32), F.substring(F.sha2(config.cast("binary"), 256), 1, 16))


def uncached(work: DataFrame, done: DataFrame, key: str = "cache_key") -> DataFrame:
    """Work whose result is not there yet; failed results don't count."""
    return work.join(done.where("error is null").select(key).distinct(), key, "left_anti")


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").partitionBy("day").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs, older files without newer columns included."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def safe_findings(findings: DataFrame) -> DataFrame:
    """The columns that may be kept: no raw names, no text of the report; rows without an item go."""
    return findings.where("item is not null").select(*[c for c in FINDING if c in findings.columns])


def export_rows(tags: DataFrame, findings: DataFrame) -> DataFrame:
    """Tags and findings as one long table of text cells that no spreadsheet takes for formulas."""
    t = tags.select("report_id", "category", "text", "src", F.col("conf").cast("string").alias("conf"), F.lit(None).cast("string").alias("status"))
    f = findings.select("report_id", F.lit("finding").alias("category"), F.concat_ws(" ", "display", "value_text", "unit").alias("text"), F.lit("report").alias("src"), F.lit("1.0").alias("conf"), "status")
    x = t.unionByName(f)
    return x.select(*[T.csv_cell(F.col(c)).alias(c) for c in x.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def one_csv(df: DataFrame, most: int = 1_000_000) -> bytes:
    """One file's bytes, with byte-order mark; for results that a person opens. They are held on the driver, so ``most`` rows are checked."""
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(df.columns)
    for n, r in enumerate(df.toLocalIterator()):
        if n >= most:
            raise ValueError(f"over {most} rows; use write_csv")
        w.writerow(r)
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def web_query(name: Column, direction: Column) -> Column:
    """What may leave the house: the catalogue's name and a direction word, nothing of the report."""
    return F.concat_ws(" ", name, F.when(direction == "high", "偏高").when(direction == "low", "偏低"), F.lit("衛教"))
