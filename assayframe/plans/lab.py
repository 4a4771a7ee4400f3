"""The lab view: records derived, by fixed rules, from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, findings

ITEM = "case event_type when 'view' then 'ldl' when 'click' then 'tg' when 'error' then 'hb' when 'purchase' then 'glucose_ac' else 'uric_acid' end"
NAME = "case item when 'ldl' then '低密度脂蛋白' when 'tg' then '三酸甘油脂' when 'hb' then '血紅素' when 'glucose_ac' then '空腹血糖' else '尿酸' end"
RANGE = "case g when 0 then '10~60' when 1 then '(<50 mg/dL)' when 2 then '＞20' when 3 then '男:20-90 女:10-80 mg/dL' when 4 then '陰性' else '' end"
VALUE = "case f when 0 then '陰性' when 1 then '2+' when 2 then '<' || s when 3 then '> ' || s when 4 then s || ' H' else s end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per event; patient is the user, a report a user's day, sex the user's parity or unknown."""
    x = table(spark, sf_dir, "events").selectExpr(
        "event_id as pos", "user_id as patient", "ts", "cast(ts as date) as day", "value", "cast(value as string) as s", f"{ITEM} as item",
        "event_id % 20 as f", "(event_id div 20) % 6 as g", "(event_id div 120) % 5 as u",
        "case when user_id % 3 = 2 then null when user_id % 2 = 0 then 'M' else 'F' end as sex",
    )
    return x.selectExpr(
        "pos", "patient", "ts", "day", "value", "item", "f", "g", "u", "sex", "concat(patient, '-', day) as report_id", f"{NAME} as display",
        f"{VALUE} as value_text", f"{RANGE} as ref_text", "case u when 0 then 'mmol/L' when 1 then 'U/L' else 'mg/dL' end as unit",
        "if(pos % 2 = 0, 'table', 'text') as source",
    )


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.parsed(records(spark, sf_dir))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = findings.classify(parsed(spark, sf_dir))
    return x.withColumn("value_num", F.when(F.col("v.kind") == "num", F.col("v.v")))


__all__ = ["catalog", "classified", "parsed", "records", "table"]
