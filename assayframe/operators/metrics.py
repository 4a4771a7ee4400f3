"""Quality of results against gold rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def prf(counts: DataFrame, by: str = "category") -> DataFrame:
    """``counts(category, tp, fp, fn)`` summed per category and over all (null category), with precision, recall and F1."""
    x = counts.rollup(by).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return x.select(by, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion(pred: DataFrame, gold: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Counts of pairs in both, in ``pred`` only and in ``gold`` only, per ``by``, from one full join."""
    p, g = pred.select(*keys, by).distinct().withColumn("p", F.lit(1)), gold.select(*keys, by).distinct().withColumn("g", F.lit(1))
    x = p.join(g, [*keys, by], "full")
    return x.groupBy(by).agg(F.count_if(F.expr("p = 1 and g = 1")).alias("tp"), F.count_if(F.expr("g is null")).alias("fp"), F.count_if(F.expr("p is null")).alias("fn"))


def greedy_match(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One-to-one matches of texts per (sample_id, category), in order: equal, then one within the other, then a synonym.

    A match depends on those before it, so a sample's category is one group; such a group is a few tags.
    """

    def run(key: tuple, p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        free, out = list(g.sort_values("pos").itertuples()), []
        for a in p.sort_values("pos").itertuples():
            tests = (lambda b: a.text == b.text, lambda b: a.text in b.text or b.text in a.text, lambda b: a.text in list(b.synonyms if b.synonyms is not None else []))
            hit = next((b for t in tests for b in free if t(b)), None)
            if hit is not None:
                free.remove(hit)
            out.append((*key, a.text, hit.text if hit is not None else None))
        out += [(*key, None, b.text) for b in free]
        return pd.DataFrame(out, columns=["sample_id", "category", "pred", "gold"])

    keys = ("sample_id", "category")
    return pred.groupBy(*keys).cogroup(gold.groupBy(*keys)).applyInPandas(run, "sample_id string, category string, pred string, gold string")


def ranking(judged: DataFrame, k: int = 5) -> DataFrame:
    """``judged(query_id, rank, grade)`` (ranks from 1) to nDCG@k, P@k and reciprocal rank per query."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank"))
    x = judged.withColumn("ideal", ideal)
    dcg = F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1.0)))
    best = F.sum(F.when(F.col("ideal") <= k, gain / F.log2(F.col("ideal") + 1.0)))
    relevant = F.col("grade") > 0
    return x.groupBy("query_id").agg(
        F.when(best > 0, F.round(dcg / best, 6)).otherwise(0.0).alias("ndcg"),
        F.round(F.count_if(relevant & (F.col("rank") <= k)) / k, 6).alias("precision"),
        F.round(F.coalesce(1.0 / F.min(F.when(relevant, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"),
    )


def coverage(chunks: DataFrame, kinds: list[str]) -> DataFrame:
    """``(token, one count per kind)`` of the chunks' tags."""
    x = chunks.select(F.explode("applies_to").alias("token"), "kind")
    return x.groupBy("token").pivot("kind", kinds).count().na.fill(0, kinds)


def missing(required: DataFrame, chunks: DataFrame) -> DataFrame:
    """Required ``(token, kind)`` pairs that no chunk has."""
    return required.join(chunks.select(F.explode("applies_to").alias("token"), "kind").distinct(), ["token", "kind"], "left_anti")


def spread(rows: DataFrame, n: int, order: str) -> DataFrame:
    """``n`` rows evenly spread over the order; all of them if there are no more.

    Rows are dealt to ranges of the order and counted there, so no task holds more than a range.
    """
    x = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id())
    sizes = x.groupBy("__p").agg(F.count("*").alias("k"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.__p") <= F.col("a.__p")).groupBy("a.__p").agg((F.sum("b.k") - F.first("a.k")).alias("__before"))
    w = Window.partitionBy("__p").orderBy(order)
    x = x.withColumn("__r", F.row_number().over(w) - 1).join(before, "__p").withColumn("__i", F.col("__before") + F.col("__r"))
    x = x.withColumn("__total", sizes.agg(F.greatest(F.sum("k"), F.lit(1))).scalar())
    return x.where(F.floor((F.col("__i") + 1) * n / F.col("__total")) > F.floor(F.col("__i") * n / F.col("__total"))).select(*rows.columns)


def timings(rows: DataFrame) -> DataFrame:
    """Seconds of each stage, summed over a run's passes and branches."""
    return rows.groupBy("report_id", "stage").agg(F.round(F.sum("seconds"), 3).alias("seconds"))


def dataset_stats(samples: DataFrame, by: str) -> DataFrame:
    """Counts, spread of values and prevalence of abnormal results, per ``by``."""
    abnormal = F.col("status").isin("high", "low", "positive")
    return samples.groupBy(by).agg(
        F.count("*").alias("n"), F.countDistinct("report_id").alias("reports"), F.min("value_num").alias("least"), F.max("value_num").alias("most"),
        F.round(F.avg("value_num"), 6).alias("mean"), F.round(F.count_if(abnormal) / F.count("*"), 6).alias("prevalence"),
    )


def scan_summary(text_run: DataFrame, scan_run: DataFrame, pages: DataFrame) -> DataFrame:
    """Recognised scans against the text layer, per level: ``(report_id, item, value)`` and ``(level, report_id, item, value)``.

    ``pages(level, report_id, seconds, pages)`` has a row for each scanned report; one without a scan row lost all its items.
    """
    want = pages.select("level", "report_id").join(text_run.select("report_id", "item", F.col("value").alias("want")), "report_id")
    x = want.join(scan_run, ["level", "report_id", "item"], "left")
    misread = F.col("value").isNotNull() & (F.col("value") != F.col("want"))
    read = x.groupBy("level").agg(
        F.count("*").alias("items"), F.count_if(F.col("value") == F.col("want")).alias("exact"), F.count_if(misread).alias("misread"), F.count_if(F.col("value").isNull()).alias("missing")
    )
    paced = pages.groupBy("level").agg(F.count("*").alias("reports"), F.round(F.median(F.col("seconds") / F.col("pages")), 6).alias("seconds_a_page"))
    return paced.join(read, "level", "left").withColumn("value_accuracy", F.round(F.col("exact") / F.greatest(F.col("items"), F.lit(1)), 6))


def most_misread(text_run: DataFrame, scan_run: DataFrame, n: int = 8) -> DataFrame:
    """The items that scans misread most, per level."""
    x = scan_run.join(text_run.select("report_id", "item", F.col("value").alias("want")), ["report_id", "item"]).where("value <> want")
    counted = x.groupBy("level", "item").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("level").orderBy(F.desc("n"), "item"))).where(F.col("rank") <= n)


def set_cover(facets: DataFrame, must: list[str], k: int = 10, most: int = 10_000) -> tuple[list[str], list[str]]:
    """``k`` samples that cover facets of ``facets(sample_id, facet)`` greedily, required ones ten times as dear; and the required ones left open.

    Each choice depends on the last, so the table is collected; ``most`` is its stated bound and is checked.
    """
    rows = facets.groupBy("sample_id").agg(F.sort_array(F.collect_set("facet")).alias("f")).orderBy("sample_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} samples; choose among fewer")
    held, needed, covered, chosen = {r.sample_id: set(r.f) for r in rows}, set(must), set(), []
    while len(chosen) < min(k, len(held)):
        best = max((s for s in held if s not in chosen), key=lambda s: 10 * len((held[s] & needed) - covered) + len(held[s] - covered))
        chosen.append(best)
        covered |= held[best]
    return sorted(chosen), sorted(needed - covered)


def same_value(pred: Column, gold: Column, pred_text: Column, gold_text: Column) -> Column:
    """Whether two results agree: as numbers within a millionth, else as texts without blanks and case."""
    plain = lambda c: F.lower(F.regexp_replace(T.fold(c), r"\s+", ""))
    return F.coalesce(F.abs(pred - gold) <= 1e-6, plain(pred_text) == plain(gold_text), F.lit(False))


def faults(items: DataFrame) -> DataFrame:
    """``(item, fault)`` of a catalogue ``(item, zh, unit, lo, hi)``: repeated keys, no name, bounds the wrong way round."""
    twice = items.groupBy("item").count().where("count > 1").select("item", F.lit("repeated key").alias("fault"))
    tests = [(F.coalesce(F.trim("zh"), F.lit("")) == "", "no name"), (F.col("lo") > F.col("hi"), "bounds the wrong way round"), ((F.col("lo").isNotNull() | F.col("hi").isNotNull()) & (F.coalesce("unit", F.lit("")) == ""), "range without unit")]
    each = items.select("item", F.explode(F.array_compact(F.array(*[F.when(c, t) for c, t in tests]))).alias("fault"))
    return twice.unionByName(each)


def leaked(texts: DataFrame, denied: DataFrame) -> DataFrame:
    """``(id, term)``: denied terms that stand in texts that are to leave the house, case and width aside."""
    terms = denied.select(F.lower(T.fold(F.col("term"))).alias("term")).where("term <> ''").distinct()
    words = texts.select("id", F.lower(T.fold(F.col("text"))).alias("t")).select("id", F.explode(F.array_distinct(F.split("t", r"[^\p{L}\p{N}_@.+-]+"))).alias("term"))
    return words.join(terms, "term").select("id", "term").distinct()
