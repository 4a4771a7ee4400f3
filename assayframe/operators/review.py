"""After the model: a rewrite round for unsupported advice, a reviewer's removals, and advice without a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .prose import ADVICE

MOST_CHARS = 16
# Advice for a condition where no model is asked.
CANNED = {
    "血脂異常": (("food", "高纖蔬果"), ("avoid", "油炸食物"), ("exercise", "中等強度有氧運動")),
    "貧血": (("food", "富含鐵質食物"), ("supplements", "鐵劑需經醫師評估")),
    "小球性貧血": (("food", "紅肉與深綠色蔬菜"),),
    "慢性腎臟病": (("avoid", "高鹽飲食"), ("lifestyle", "定期追蹤腎功能")),
    "肝功能異常": (("avoid", "飲酒"), ("lifestyle", "控制體重")),
    "糖尿病前期": (("food", "全穀類取代精緻澱粉"), ("avoid", "含糖飲料")),
    "糖尿病": (("food", "全穀類取代精緻澱粉"), ("avoid", "含糖飲料")),
    "血壓偏高": (("avoid", "高鈉加工食品"), ("lifestyle", "居家量測血壓")),
    "高血壓": (("avoid", "高鈉加工食品"), ("lifestyle", "居家量測血壓")),
    "高尿酸血症": (("avoid", "高普林食物"), ("lifestyle", "多喝水")),
    "代謝症候群": (("exercise", "每週150分鐘運動"), ("lifestyle", "減少腰圍")),
    "肥胖": (("exercise", "每週150分鐘運動"),),
    "過重": (("lifestyle", "控制體重"),),
}
GENERAL = (("lifestyle", "規律作息"), ("exercise", "規律運動"), ("food", "均衡飲食"))


def canned(reports: DataFrame, conditions: DataFrame) -> DataFrame:
    """``(report_id, category, text, src)``: advice from the conditions that rules found, general advice where there are none."""
    spark: SparkSession = reports.sparkSession
    table = spark.createDataFrame([(c, i, *a) for c, xs in CANNED.items() for i, a in enumerate(xs)], "condition string, place int, category string, text string")
    picked = conditions.where("category = 'condition'").select("report_id", F.col("text").alias("condition")).join(table, "condition").select("report_id", "category", "text")
    rest = reports.select("report_id").distinct().join(picked.select("report_id").distinct(), "report_id", "left_anti")
    general = rest.select("report_id", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(t).alias("text")) for c, t in GENERAL])).alias("a")).select("report_id", "a.*")
    return picked.unionByName(general).distinct().withColumn("src", F.lit("inferred"))


def removals(rule_tags: DataFrame, asked: DataFrame) -> DataFrame:
    """What a reviewer may remove: of the texts that were asked for, those that rules did derive."""
    keys = ["report_id", "category", "text"]
    return asked.select(*keys).distinct().join(rule_tags.select(*keys), keys, "left_semi")


def reviewed(tags: DataFrame, rule_tags: DataFrame, asked: DataFrame) -> DataFrame:
    """``tags`` of rules and model without the reviewer's removals, which bind the model's tags too."""
    return tags.join(removals(rule_tags, asked), ["report_id", "category", "text"], "left_anti")


def waiting(reports: DataFrame, rule_tags: DataFrame, decided: DataFrame) -> DataFrame:
    """Reports that pause for a review: rules found something, and no decision is stored yet."""
    return reports.join(rule_tags.select("report_id").distinct(), "report_id", "left_semi").join(decided.select("report_id").distinct(), "report_id", "left_anti")


def rewritten(tags: DataFrame, answers: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One rewrite round: ``tags`` after it, and its log with an action for each unsupported piece of advice.

    ``tags(report_id, category, pos, text, src, conf, verdict)``; ``answers(report_id, pos, action, text, src)`` of a
    rewriter, the first of a tag counts; ``allowed(report_id, src)``: what may be cited. A revision stays if it is short,
    cites what is allowed, and neither repeats the tag nor another of its category; everything else is dropped.
    """
    target = F.col("category").isin(*ADVICE) & F.coalesce(~F.col("verdict"), F.lit(False))
    first = answers.withColumn("__n", F.row_number().over(Window.partitionBy("report_id", "pos").orderBy("action", "text"))).where("__n = 1")
    first = first.select("report_id", "pos", "action", F.trim("text").alias("new_text"), F.col("src").alias("new_src"))
    may = allowed.select("report_id", F.col("src").alias("new_src")).distinct().withColumn("__may", F.lit(True))
    others = tags.groupBy("report_id", "category").agg(F.collect_list(F.struct("pos", "text")).alias("__others"))
    x = tags.where(target).join(first, ["report_id", "pos"], "left").join(may, ["report_id", "new_src"], "left").join(others, ["report_id", "category"])
    echo = (F.col("new_text") == F.col("text")) & (F.col("new_src") == F.col("src"))
    taken = F.exists("__others", lambda o: (o["pos"] != F.col("pos")) & (o["text"] == F.col("new_text")))
    fits = F.length("new_text").between(1, MOST_CHARS) & F.coalesce("__may", F.lit(False)) & ~taken
    action = (
        F.when(F.col("action").isNull(), "no_answer").when(F.col("action") != "revise", F.col("action"))
        .when(echo, "unchanged").when(F.coalesce(fits, F.lit(False)), "revise").otherwise("invalid_revision")
    )
    log = x.select("report_id", "category", "pos", F.col("text").alias("original"), action.alias("action"), F.when(action == "revise", F.col("new_text")).alias("revised"), "new_src", "conf")
    new = log.where("action = 'revise'").select("report_id", "category", "pos", F.col("revised").alias("text"), F.col("new_src").alias("src"), "conf", F.lit(None).cast("boolean").alias("verdict"))
    kept = tags.where(~target).select("report_id", "category", "pos", "text", "src", "conf", "verdict")
    return kept.unionByName(new), log.drop("new_src", "conf")


def rewrite_loop(tags: DataFrame, ask: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame], allowed: DataFrame, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """At most ``rounds`` passes: the rewriter is asked for unsupported advice, revisions are verified again, what stays unsupported goes."""
    log = None
    for i in range(rounds):
        wanted = tags.where(F.col("category").isin(*ADVICE) & ~F.col("verdict"))
        tags, entry = rewritten(tags, ask(wanted), allowed)
        entry = entry.withColumn("round", F.lit(i + 1))
        log = entry if log is None else log.unionByName(entry)
        tags = tags.where(F.col("verdict").isNotNull()).unionByName(check(tags.where(F.col("verdict").isNull())).select(*tags.columns))
    return tags.where(F.coalesce("verdict", F.lit(True))), log


def outcomes(log: DataFrame) -> DataFrame:
    """Counts of the log's actions."""
    return log.groupBy("action").agg(F.count("*").alias("n"))
