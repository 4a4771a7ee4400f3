"""One entry from files to results: extraction, findings, rules, passages, prompts and a compact view."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, extract, fhir, findings, metrics, passages, prose, rules, search, trends, verify
from ..settings import Settings
from ..sources import reports as files


@dataclass
class Result:
    """The tables of a run, one row set per stage over all reports."""

    reports: DataFrame
    findings: DataFrame
    unmatched: DataFrame
    tags: DataFrame
    summary: DataFrame
    errors: DataFrame
    context: DataFrame | None = None
    answers: DataFrame | None = None
    stages: list[str] = field(default_factory=list)

    def bundles(self) -> DataFrame:
        """FHIR documents of all reports."""
        items = catalog.item_table(self.findings.sparkSession).select("item", "item_unit")
        return fhir.bundles(fhir.observations(self.findings.join(F.broadcast(items), "item")), self.reports.select("report_id", "sex", "day"))


def catalogue_sheets(spark: SparkSession) -> DataFrame:
    """Fact sheets of the catalogue's items."""
    shown = lambda s: F.when(F.col(s).isNotNull() & (F.col(f"{s}.kind") != "qual_neg"), F.concat(F.coalesce(T.number_text(F.col(f"{s}.lo")), F.lit("")), F.lit("~"), F.coalesce(T.number_text(F.col(f"{s}.hi")), F.lit("")), F.lit(" "), f"{s}.unit"))
    x = catalog.item_table(spark).join(catalog.range_table(spark), "item", "left")
    x = x.withColumns({"__m": shown("m"), "__f": shown("f")})
    none = F.lit(None).cast("string")
    return passages.fact_sheets(x.select(
        "item", "zh", "en", "item_unit", F.when(F.col("by_sex"), F.col("__m")).alias("range_m"), F.when(F.col("by_sex"), F.col("__f")).alias("range_f"),
        F.when(~F.col("by_sex"), F.col("__m")).alias("range_text"), F.when(F.col("expect_negative"), "陰性").alias("qualitative"), none.alias("note"), none.alias("source"),
    ))


def analyze(
    texts: DataFrame, settings: Settings | None = None, sex: str | None = None, chunks: DataFrame | None = None,
    generate: Callable[[list[str]], list[str | None]] | None = None, on_stage: Callable[[str], None] | None = None,
) -> Result:
    """``texts(report_id, text, tables[, error])`` to every stage's table, for any number of reports at once.

    ``chunks(id, text, kind, applies_to)`` are passages to cite; ``generate`` answers prompts in batches (none: rules only).
    ``on_stage`` hears each stage's name as its plan is made.
    """
    s, spark, stages = settings or Settings.load(), texts.sparkSession, []

    def stage(name: str) -> None:
        stages.append(name)
        if on_stage:
            on_stage(name)

    stage("extract")
    errors = texts.where("error is not null").select("report_id", "error") if "error" in texts.columns else spark.createDataFrame([], "report_id string, error string")
    raw = extract.records(texts)
    header = texts.select("report_id", F.coalesce(F.lit(sex), T.sex_of(F.col("text"))).alias("sex"), T.exam_date(F.col("text")).alias("day"), "text")
    stage("findings")
    found, unmatched = findings.evaluate(raw, header.where("sex is not null").select("report_id", "sex"))
    names = catalog.item_table(spark).select("item", F.col("zh").alias("display"))
    found = found.withColumnRenamed("name", "raw_name").join(F.broadcast(names), "item").withColumn("value_num", F.when(F.col("v.kind") == "num", F.col("v.v")))
    stage("rules")
    tags = rules.derive(found) if s.rules else rules.derive(found.limit(0))
    summary = trends.summary(found, tags)
    out = Result(header, found, unmatched, tags, summary, errors, stages=stages)
    if chunks is not None:
        stage("retrieve")
        sheets = catalogue_sheets(spark)
        abnormal = found.where(F.col("direction").isin("high", "low"))
        facts = abnormal.join(sheets, "item").select("report_id", F.col("pos").alias("finding_pos"), F.lit(1).alias("rank"), "id", "kind")
        routed = search.routed(abnormal, chunks, tags.where("category = 'condition'").withColumn("item", F.lit(None).cast("string")))
        hits = routed.join(abnormal.select("report_id", "item", F.col("pos").alias("finding_pos")), ["report_id", "item"]).join(chunks.select("id", "kind"), "id")
        ranked = prose.ranked_per(hits, ["report_id", "finding_pos"], ["id"], 2).withColumn("rank", F.lit(1)).select("report_id", "finding_pos", "rank", "id", "kind")
        order = search.round_robin(facts.unionByName(ranked))
        every = sheets.select("id", "text").unionByName(chunks.select("id", "text"))
        out.context = search.within_budget(order.join(every, "id"), s.context_chars)
    if generate is not None:
        stage("model")
        cut = prose.without_results(header.select("report_id", "text"), found)
        shown = prose.finding_lines(found)
        base = cut.join(shown, "report_id", "left")
        if out.context is not None:
            block = F.sort_array(F.collect_list(F.struct("pos", F.concat(F.lit("["), "id", F.lit("] "), "text").alias("t"))))
            base = base.join(out.context.groupBy("report_id").agg(F.array_join(F.transform(block, lambda b: b["t"]), "\n").alias("context")), "report_id", "left")
        else:
            base = base.withColumn("context", F.lit(None).cast("string"))
        asked = prose.prompts(base, s.report_chars, s.context_chars).select("report_id", "prompt")
        out.answers = verify.prior(prose.partial(verify.with_model(asked, generate)).where("category <> 'summary'"), limit=s.tags_a_category)
    return out


def analyze_files(spark: SparkSession, path: str, read: Callable[[bytes], dict], **options) -> Result:
    """A folder of PDF files through an injected reader to results; a file that can't be read is an error row."""
    return analyze(extract.extracted(files.read_pdfs(spark, path), read), **options)


def public(rows: DataFrame) -> DataFrame:
    """A table without its internal columns."""
    return rows.select(*[c for c in rows.columns if not c.startswith("_")])


def compact(result: Result) -> DataFrame:
    """``(report_id, view)``: a JSON view of each report without its text: counts, abnormal findings, conditions and risks."""
    shown = F.struct("pos", "item", "display", "value_text", "unit", "status", "range_source", F.when(F.col("range_source") == "report", F.col("ref_text")).alias("reference_range"))
    abnormal = F.col("direction").isin("high", "low")
    f = result.findings.groupBy("report_id").agg(F.count("*").alias("n_items_parsed"), F.sort_array(F.collect_list(F.when(abnormal, shown))).alias("abnormal_findings"))
    tag = F.struct("pos", "text", "src", "conf", "evidence")
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("category") == kind, tag)))
    t = result.tags.groupBy("report_id").agg(of("condition").alias("conditions"), of("risk").alias("risks"))
    x = f.join(t, "report_id", "left")
    return x.select("report_id", F.to_json(F.struct(*[c for c in x.columns if c != "report_id"])).alias("view"))


def lookup_range(spark: SparkSession, names: list[str], sex: str | None = None) -> DataFrame:
    """The reference range that each name leads to; null where the name means no item, or several."""
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, name string")
    x = catalog.resolve(asked).join(F.broadcast(catalog.item_table(spark)), "item", "left").join(F.broadcast(catalog.range_table(spark)), "item", "left")
    side = F.col("f") if sex == "F" else F.col("m")
    return x.select("pos", "name", "item", "zh", "item_unit", side["lo"].alias("lo"), side["hi"].alias("hi"))


def documents(result: Result, chunks: DataFrame | None = None) -> DataFrame:
    """``(report_id, id, text, metadata)``: findings, and passages if given, in the shape that retrieval chains take."""
    meta = F.create_map(F.lit("kind"), F.lit("finding"), F.lit("item"), F.col("item"), F.lit("status"), F.col("status"))
    text = F.concat_ws(" ", "display", "value_text", "unit", F.concat(F.lit("["), "status", F.lit("]")))
    out = result.findings.select("report_id", F.concat_ws(":", "report_id", "pos").alias("id"), text.alias("text"), meta.alias("metadata"))
    if chunks is not None:
        none = F.lit(None).cast("string")
        out = out.unionByName(chunks.select(none.alias("report_id"), "id", "text", F.create_map(F.lit("kind"), F.col("kind")).alias("metadata")))
    return out


__all__ = ["Result", "analyze", "analyze_files", "catalogue_sheets", "compact", "documents", "lookup_range", "metrics", "public"]
