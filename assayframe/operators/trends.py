"""Runs over time: indicators of a patient, series, recent runs, pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def pseudonym(label: Column, salt: str) -> Column:
    """First 16 hex digits of the salted HMAC of a trimmed label; null for none."""
    return F.when(F.trim(label) != "", F.substring(T.hmac_sha256(salt, F.trim(label)), 1, 16))


def indicators(findings: DataFrame) -> DataFrame:
    """Per patient and item: first name, first unit that is given, number of points, in order of day and place."""
    at = F.struct("day", "pos")
    x = findings.where(F.col("value_num").isNotNull())
    out = x.groupBy("patient", "item").agg(
        F.min_by("display", at).alias("display"), F.min_by("unit", F.when(F.col("unit") != "", at)).alias("unit"),
        F.countDistinct("report_id").cast("long").alias("points"),
    )
    return out


def series(findings: DataFrame) -> DataFrame:
    """First numeric finding per patient, item and run; one row per point."""
    first = Window.partitionBy("patient", "item", "report_id").orderBy("pos")
    x = findings.where(F.col("value_num").isNotNull()).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return x.select("patient", "item", "report_id", "day", "value_num", "status")


def recent(runs: DataFrame, n: int) -> DataFrame:
    """The ``n`` latest runs; a top-k, not a sort of all."""
    return runs.orderBy(F.desc("day"), F.desc("report_id")).limit(n)


def in_date_order(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("0000")), "report_id")


def forget(runs: DataFrame, patients: DataFrame) -> DataFrame:
    """``runs`` without the patients that asked for it."""
    return runs.join(patients.select("patient").distinct(), "patient", "left_anti")


def summary(findings: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per report: counts and joined labels."""
    counts = findings.groupBy("report_id").agg(
        F.count("*").alias("n_findings"), F.count_if(F.col("direction").isin("high", "low")).alias("n_abnormal"),
        F.count_if(F.col("range_conflict")).alias("n_conflicts"), F.count_if(F.col("status") == "unknown").alias("n_unknown"),
    )
    ordered = lambda kind: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("category") == kind, F.struct("pos", "text")))), lambda s: s["text"]), "、")
    labels = tags.groupBy("report_id").agg(ordered("condition").alias("conditions"), ordered("risk").alias("risks"))
    return counts.join(labels, "report_id", "left").na.fill("", ["conditions", "risks"])
