"""Claims against their sources: support, verdicts, caps, and the seams of model calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FILLER = ["建議", "可能", "應", "請", "需要", "注意"]


def verify(tags: DataFrame, passages: DataFrame, reports: DataFrame, least: float = 0.5, report_least: float = 0.75) -> DataFrame:
    """``tags(report_id, category, pos, text, src, conf)`` with verdict, support and revised source.

    A claim about the report must stand in it, or it becomes an inference at 0.6 of its confidence. A
    citation must be a known passage that supports it; null verdict: a judge has to decide.
    """
    x = tags.withColumn("passage_id", F.when(F.col("src").startswith("kb:"), F.substring("src", 4, 200)))
    x = x.join(passages.select(F.col("id").alias("passage_id"), F.col("text").alias("passage")), "passage_id", "left")
    x = x.join(reports.select("report_id", F.col("text").alias("report")), "report_id", "left")
    in_report = T.support(F.col("text"), F.coalesce("report", F.lit("")))
    in_passage = T.support(F.col("text"), F.coalesce("passage", F.lit("")), FILLER)
    kind = F.when(F.col("src") == "report", "report").when(F.col("passage_id").isNotNull(), "kb").otherwise("other")
    x = x.withColumn("support", F.round(F.when(kind == "report", in_report).when(kind == "kb", in_passage), 6))
    lost = (kind == "report") & (F.col("support") < report_least)
    verdict = F.when(kind == "report", ~lost).when((kind == "kb") & F.col("passage").isNull(), False).when((kind == "kb") & (F.col("support") >= least), True)
    return x.select(
        "report_id", "category", "pos", "text", F.when(lost, "inferred").otherwise(F.col("src")).alias("src"),
        F.round(F.when(lost, F.col("conf") * 0.6).otherwise(F.col("conf")), 6).alias("conf"), "support", verdict.alias("verdict"),
        F.when(lost, F.col("src")).alias("revised_from"),
    )


def cap_inferred(tags: DataFrame, share: float = 0.25) -> DataFrame:
    """At most a share of a report's tags may be inferences; those of least confidence go first."""
    by = Window.partitionBy("report_id")
    inferred = F.col("src") == "inferred"
    x = tags.withColumn("__allowed", F.floor(share * F.greatest(F.count("*").over(by), F.lit(1))))
    x = x.withColumn("__n", F.row_number().over(Window.partitionBy("report_id", inferred).orderBy(F.desc("conf"), "pos")))
    return x.where(~inferred | (F.col("__n") <= F.col("__allowed"))).drop("__n", "__allowed")


def stats(tags: DataFrame) -> DataFrame:
    """Counts of verdicts per report and the rate of supported ones."""
    x = tags.groupBy("report_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("verdict")).alias("supported"), F.count_if(~F.col("verdict")).alias("unsupported"),
        F.count_if(F.col("verdict").isNull()).alias("open"), F.count_if(F.col("revised_from").isNotNull()).alias("downgraded"),
    )
    judged = F.col("supported") + F.col("unsupported")
    return x.withColumn("support_rate", F.when(judged > 0, F.round(F.col("supported") / judged, 6)))


def prior(tags: DataFrame, base: float = 0.8, limit: int = 4) -> DataFrame:
    """Trimmed, distinct tags per category, the first ``limit``; confidence falls by 0.02 a place, to 0.3 at least."""
    x = tags.withColumn("text", F.trim("text")).where("text <> ''")
    first = Window.partitionBy("report_id", "category", "text").orderBy("pos")
    x = x.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    x = x.withColumn("place", F.row_number().over(Window.partitionBy("report_id", "category").orderBy("pos"))).where(F.col("place") <= limit)
    return x.withColumn("conf", F.round(F.greatest(F.lit(0.3), base - 0.02 * (F.col("place") - 1)), 6)).drop("__n")


def pack(pairs: DataFrame, most: int = 8, chars: int = 5000) -> DataFrame:
    """``pairs(report_id, pos, text)`` with ``batch``: greedy packing in order under both limits.

    Each batch depends on the one before, so a report is one group; a report's claims are few.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        batch, n, size, out = 0, 0, 0, []
        for t in g.text:
            if n and (n >= most or size + len(t) > chars):
                batch, n, size = batch + 1, 0, 0
            n, size = n + 1, size + len(t)
            out.append(batch)
        return g.assign(batch=out)

    return pairs.select("report_id", "pos", "text").groupBy("report_id").applyInPandas(run, "report_id string, pos int, text string, batch int")


def with_model(rows: DataFrame, call: Callable[[list[str]], list[str | None]], column: str = "prompt", out: str = "answer", size: int = 32) -> DataFrame:
    """The seam of any model: ``call`` gets prompts in batches and gives as many answers; a failing batch is halved, a failing row is null."""

    def safe(xs: list[str]) -> list[str | None]:
        try:
            return list(call(xs))
        except Exception:
            return [None] if len(xs) == 1 else safe(xs[: len(xs) // 2]) + safe(xs[len(xs) // 2 :])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            xs = b[column].tolist()
            yield b.assign(**{out: [a for i in range(0, len(xs), size) for a in safe(xs[i : i + size])]})

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {out} string")


def allowed(src: Column, passages: Column) -> Column:
    """Whether a source may be cited: the report, an inference, a rule, or a passage that was shown."""
    return src.isin("report", "inferred", "rule") | (src.startswith("kb:") & F.array_contains(passages, F.substring(src, 4, 200)))
