"""Registered queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import more_queries
from .functions import text as T
from .operators import catalog, extract, fhir, findings, metrics, rules, search, trends, verify
from .plans import lab
from .sources import reports
from .streaming import trends as streaming

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def parse_value(spark: SparkSession, d: str) -> DataFrame:
    return lab.parsed(spark, d).select("pos", "v.kind", "v.v", "v.op", "v.grade", "v.flag")


@query
def parse_ref(spark, d):
    x = lab.parsed(spark, d)
    return x.select("pos", "r.kind", F.col("r.m.lo").alias("m_lo"), F.col("r.m.hi").alias("m_hi"), F.col("r.f.lo").alias("f_lo"), F.col("r.f.hi").alias("f_hi"), F.col("r.m.unit").alias("unit"))


def _printed(spark, d):
    x = lab.parsed(spark, d)
    return x.withColumn("status", findings.by_sex(F.col("v"), F.col("r.m"), F.col("r.f"), F.col("sex"), cut=F.col("r.qual_neg")))


@query
def classify_printed(spark, d):
    x = _printed(spark, d)
    return x.select("pos", "status", findings.direction(F.col("status")).alias("direction"))


@query
def classify_sex_unknown(spark, d):
    return _printed(spark, d).where("g = 3 and sex is null").groupBy("item", "status").agg(F.count("*").alias("n"))


@query
def classify_censored(spark, d):
    return _printed(spark, d).where("f in (2, 3)").groupBy("f", F.col("g").alias("r"), "status").agg(F.count("*").alias("n"))


@query
def unit_convert(spark, d):
    x = catalog.unit_factor(lab.records(spark, d))
    return x.select("pos", "factor", F.round(F.col("value") * F.col("factor"), 6).alias("converted"))


@query
def unit_keys(spark, d):
    shown = F.expr("case pos % 6 when 0 then '( MG/dL )' when 1 then 'x10^3/uL' when 2 then '10*6/µL' when 3 then 'IU/L' when 4 then 'mm-Hg' else 'mg%' end")
    return lab.records(spark, d).select("pos", T.unit_key(shown).alias("k"))


@query
def name_keys(spark, d):
    shown = F.expr("case pos % 4 when 0 then '(Ｕric-Acid)' when 1 then '鹼性磷酸脢' when 2 then ' LDL－C : ' else 'A/G [ratio]' end")
    return lab.records(spark, d).select("pos", T.name_key(shown).alias("k"))


NOISY = {"ldl": ("LDL-C", "低密度脂蛋白膽固醇 LDL", "LDL (直接法)"), "tg": ("ＴＧ", "三酸甘油酯", "三酸甘油脂 Triglyceride"), "hb": ("Hemoglobin", "血色素Hb", "HGB"),
         "glucose_ac": ("AC sugar", "飯前血糖", "Glucose AC"), "uric_acid": ("Uric  Acid", "尿酸 UA", "U.A")}


@query
def resolve_alias(spark, d):
    noisy = "case " + " ".join(f"when item = '{k}' and pos % 5 = {i} then '{n}'" for k, ns in NOISY.items() for i, n in enumerate(ns)) + " when pos % 5 = 3 then '檢驗師' else 'Specimen clotted' end"
    x = lab.records(spark, d).selectExpr("pos", f"{noisy} as name")
    return catalog.resolve(x).select("pos", "item")


@query
def unmatched_names(spark, d):
    x = lab.records(spark, d).selectExpr("pos", "case when pos % 3 = 0 then display else 'note ' || pos % 10 end as name")
    return catalog.resolve(x).where("item is null").groupBy("name").agg(F.count("*").alias("n"))


@query
def classify_findings(spark, d):
    return lab.classified(spark, d).select("pos", "report_status", "kb_status", "status", "direction", "range_source", "range_conflict", "sex_unknown")


@query
def abnormal_only(spark, d):
    x = lab.classified(spark, d)
    return x.where(findings.is_abnormal(F.col("direction"))).groupBy("item", "direction").agg(F.count("*").alias("n"))


@query
def range_conflicts(spark, d):
    return lab.classified(spark, d).groupBy("item").agg(F.count_if("range_conflict").alias("conflicts"), F.count("*").alias("n"))


@query
def dedupe_findings(spark, d):
    return findings.dedupe(lab.parsed(spark, d)).select("report_id", "item", "pos", F.col("n_values").cast("long").alias("n_values"), "duplicate")


@query
def merge_numeric_and_qualitative(spark, d):
    x = findings.merge_readings(findings.dedupe(lab.classified(spark, d)))
    return x.select("report_id", "item", "pos", "status", "qualitative_result")


@query
def sex_vote(spark, d):
    shown = F.expr("case when item = 'hb' then if(patient % 2 = 0, '13.5~17.5', '12~16') when item = 'uric_acid' then if(patient % 2 = 0, '3.4-7.1', '2.5-6.1') else '10~60' end")
    x = findings.parsed(lab.records(spark, d).withColumn("ref_text", shown))
    return findings.sex_votes(x).select("report_id", F.col("votes_m").cast("long").alias("votes_m"), F.col("votes_f").cast("long").alias("votes_f"), "sex_inferred")


@query
def derive_conditions(spark, d):
    return rules.derive(lab.classified(spark, d)).select("report_id", "category", "text", "conf", "evidence")


@query
def metabolic_score(spark, d):
    x = rules.metabolic(rules.pivot(lab.classified(spark, d)))
    return x.select("report_id", F.col("ms_count").cast("long").alias("ms_count"), "ms_evidence")


@query
def metric_tags(spark, d):
    return rules.metric_tags(lab.classified(spark, d)).select("report_id", "pos", "text")


@query
def merge_rule_and_model_tags(spark, d):
    tags = rules.derive(lab.classified(spark, d)).where("category = 'risk'")
    mine = tags.groupBy("report_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("own"))
    other = "transform(array('血管疾病', '骨質疏鬆', '心血管疾病風險', '貧血'), (t, i) -> named_struct('pos', 100 + i, 'text', t))"
    x = mine.withColumn("all", rules.merge_tags(F.col("own"), F.expr(other)))
    return x.select("report_id", F.array_join(F.transform("all", lambda s: s["text"]), "、").alias("merged"))


@query
def batch_summary(spark, d):
    x = lab.classified(spark, d)
    out = trends.summary(x, rules.derive(x))
    return out.select("report_id", *[F.col(c).cast("long").alias(c) for c in ("n_findings", "n_abnormal", "n_conflicts", "n_unknown")], "conditions", "risks")


@query
def trend_indicators(spark, d):
    return trends.indicators(lab.classified(spark, d))


@query
def trend_series(spark, d):
    return trends.series(lab.classified(spark, d))


def _runs(spark, d):
    return lab.records(spark, d).groupBy("report_id", "patient", "day").agg(F.count("*").alias("n_findings"))


@query
def recent_runs(spark, d):
    return trends.recent(_runs(spark, d), 50)


@query
def forget_patients(spark, d):
    return trends.forget(_runs(spark, d), lab.table(spark, d, "events").where("event_type = 'signup' and value > 400").selectExpr("user_id as patient")).groupBy("patient").agg(F.count("*").alias("runs"))


@query
def pseudonyms(spark, d):
    return lab.table(spark, d, "customer").select("c_custkey", trends.pseudonym(F.col("c_name"), "salt-1").alias("patient"))


@query
def daily_trend(spark, d):
    return streaming.daily(lab.classified(spark, d))


@query
def chunk_fixed(spark, d):
    return search.fixed_chunks(lab.table(spark, d, "documents")).select("doc_id", F.col("n").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("chunk"))


@query
def chunk_sentences(spark, d):
    return search.sentence_chunks(lab.table(spark, d, "documents"))


@query
def clean_text(spark, d):
    return lab.table(spark, d, "documents").select("doc_id", F.length(search.clean(F.col("text"), r"(?m)^.*the the.*$")).cast("long").alias("n"))


@query
def off_topic(spark, d):
    tags = F.split(F.concat_ws(",", "lang", "source"), ",")
    return lab.table(spark, d, "documents").where(~search.off_topic(tags, ["src3", "es"])).groupBy("lang").agg(F.count("*").alias("n"))


def _bm25(spark, d):
    return search.bm25(lab.table(spark, d, "documents"), lab.table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"), 5)


@query
def bm25_topk(spark, d):
    return _bm25(spark, d).select("query_id", "doc_id", F.round("score", 4).alias("score"))


def _dense(spark, d, k=10):
    v = lab.table(spark, d, "embeddings")
    return search.dense(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


@query
def dense_topk(spark, d):
    return _dense(spark, d).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 4).alias("distance"))


@query
def rrf_fuse(spark, d):
    v = lab.table(spark, d, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    other = search.closest(v, asked, 10).select("query_id", "id", "rank")
    both = _dense(spark, d).select("query_id", F.col("vec_id").alias("id"), "rank").unionByName(other)
    return search.fuse(both, 10).select("query_id", "id", "score")


def _hits(spark, d):
    return lab.records(spark, d).selectExpr("report_id", "pos % 3 as finding_pos", "pos % 2 + 1 as rank", "pos % 7 as id", "if(pos % 11 = 0, 'fact', 'kb') as kind").distinct()


@query
def round_robin(spark, d):
    return search.round_robin(_hits(spark, d)).select("report_id", "id", F.col("pos").cast("long").alias("pos"), "kind")


@query
def context_budget(spark, d):
    x = search.fixed_chunks(lab.table(spark, d, "documents")).selectExpr("doc_id as report_id", "n as pos", "text")
    return search.within_budget(x, 3500).groupBy("report_id").agg(F.count("*").alias("blocks"), F.max("used").alias("used"))


@query
def tag_routing(spark, d):
    x = lab.classified(spark, d).select("report_id", "item", "status")
    chunks = spark.createDataFrame([("c1", ["ldl:high", "tg"]), ("c2", ["hb:low"]), ("c3", ["cond:痛風", "uric_acid:high"])], "id string, applies_to array<string>")
    return search.routed(x, chunks).groupBy("id", "item").agg(F.count("*").alias("n"))


@query
def lexical_support(spark, d):
    x = lab.table(spark, d, "conversations")
    after = x.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("passage"))
    return x.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.support(F.col("text"), F.col("passage")), 6).alias("support"))


def _tags(spark, d):
    return lab.records(spark, d).selectExpr("report_id", "pos", "if(pos % 3 = 0, 'inferred', 'report') as src", "round(value / 500, 4) as conf")


@query
def inferred_cap(spark, d):
    return verify.cap_inferred(_tags(spark, d)).select("report_id", "pos", "src")


@query
def verify_claims(spark, d):
    x = lab.table(spark, d, "conversations").selectExpr("cast(conv_id as string) as report_id", "role as category", "cast(turn as int) as pos", "text", "if(turn % 2 = 0, 'report', concat('kb:', turn % 4)) as src", "0.8D as conf")
    passages = lab.table(spark, d, "benchmark").selectExpr("cast(item_id as string) as id", "text")
    said = x.groupBy("report_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("category") == "assistant", F.struct("pos", "text")))), lambda s: s["text"]), "\n").alias("text"))
    return verify.verify(x, passages, said)


@query
def leak_overlap(spark, d):
    return search.overlap_share(lab.table(spark, d, "documents"), lab.table(spark, d, "benchmark")).where("hits > 0")


@query
def strip_markup(spark, d):
    return lab.table(spark, d, "pages").select("page_id", F.md5(T.strip_markup(F.col("html")).cast("binary")).alias("plain"))


@query
def page_urls(spark, d):
    return lab.table(spark, d, "pages").select("page_id", T.first_url(F.col("html")).alias("url"))


@query
def exam_dates(spark, d):
    x = lab.records(spark, d)
    label = F.expr("case pos % 3 when 0 then concat('出生日期: 070/01/02 檢查日期： ', year(day) - 1911, '/', month(day), '/', dayofmonth(day)) when 1 then concat('報告日期:', day) else '檢查日期: 113/13/40' end")
    return x.select("pos", T.exam_date(label).alias("d"))


@query
def sex_header(spark, d):
    label = F.expr("case pos % 4 when 0 then '姓名 ○○ 性別：男' when 1 then 'Gender: Female' when 2 then 'sex: M ' else 'no label' end")
    return lab.records(spark, d).select("pos", T.sex_of(label).alias("sex"))


@query
def csv_cells(spark, d):
    shown = F.expr("case pos % 4 when 0 then '=' || value_text when 1 then '-' || value_text when 2 then '@x' else value_text end")
    return lab.records(spark, d).select("pos", T.csv_cell(shown).alias("cell"))


@query
def number_texts(spark, d):
    return lab.table(spark, d, "part").select("p_partkey", T.number_text(F.col("p_retailprice")).alias("shown"))


@query
def eval_prf(spark, d):
    labels, docs = lab.table(spark, d, "labels"), lab.table(spark, d, "documents")
    x = labels.join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
    pred, gold = x.where("n_chars > 500").selectExpr("doc_id", "lang as category"), x.where("quality = 1").selectExpr("doc_id", "lang as category")
    return metrics.prf(metrics.confusion(pred, gold, ["doc_id"], "category")).select(F.coalesce("category", F.lit("all")).alias("category"), "tp", "fp", "fn", "precision", "recall", "f1")


@query
def ndcg5(spark, d):
    v = lab.table(spark, d, "embeddings").select("vec_id", "label")
    x = _dense(spark, d).join(v, "vec_id").join(v.selectExpr("vec_id as query_id", "label as ql"), "query_id")
    return metrics.ranking(x.selectExpr("query_id", "rank", "if(label = ql, 2, 0) + if(vec_id = query_id, 1, 0) as grade"))


@query
def coverage(spark, d):
    chunks = lab.table(spark, d, "events").selectExpr("array(event_type, 'user' || user_id % 5) as applies_to", "case event_id % 3 when 0 then 'diet' when 1 then 'cause' else 'care' end as kind")
    return metrics.coverage(chunks, ["diet", "cause", "care"])


@query
def coverage_gaps(spark, d):
    chunks = lab.table(spark, d, "events").where("value > 300").selectExpr("array('user' || user_id) as applies_to", "event_type as kind")
    need = lab.table(spark, d, "events").selectExpr("'user' || user_id as token", "event_type as kind").distinct()
    return metrics.missing(need, chunks)


@query
def even_sample(spark, d):
    return metrics.spread(lab.table(spark, d, "customer").select("c_custkey"), 12, "c_custkey")


@query
def cache_fingerprint(spark, d):
    return lab.table(spark, d, "documents").select("doc_id", reports.cache_key(F.col("text").cast("binary"), F.lit("v1")).alias("k"))


@query
def uncached_work(spark, d):
    x = lab.table(spark, d, "documents").select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("cache_key"))
    done = x.where("doc_id % 3 = 0").select("cache_key", F.expr("if(doc_id % 2 = 0, null, 'error')").alias("error"))
    return reports.uncached(x, done).groupBy("lang").agg(F.count("*").alias("n"))


@query
def fhir_observations(spark, d):
    items = catalog.item_table(spark).select("item", "item_unit")
    x = lab.classified(spark, d).drop("unit").join(lab.records(spark, d).select("pos", "unit"), "pos").join(F.broadcast(items), "item")
    return fhir.observations(x).select("pos", "code", "value", "comparator", "value_string", "unit", "interpretation")


@query
def fhir_bundles(spark, d):
    items = catalog.item_table(spark).select("item", "item_unit")
    return fhir.bundles(fhir.observations(lab.classified(spark, d).join(F.broadcast(items), "item")))


@query
def export_table(spark, d):
    x = lab.classified(spark, d)
    return reports.export_rows(rules.derive(x), x)


@query
def web_queries(spark, d):
    x = lab.classified(spark, d).where("direction in ('high', 'low')")
    return x.select(reports.web_query(F.col("display"), F.col("direction")).alias("q")).groupBy("q").agg(F.count("*").alias("n"))


@query
def prior_confidence(spark, d):
    x = lab.records(spark, d).selectExpr("report_id", "item as category", "pos", "concat(' ', value_text, ' ') as text")
    return verify.prior(x).select("report_id", "category", "pos", "conf")


@query
def verdict_stats(spark, d):
    x = lab.records(spark, d).selectExpr("report_id", "case pos % 3 when 0 then true when 1 then false end as verdict", "if(pos % 5 = 0, 'report', null) as revised_from")
    out = verify.stats(x)
    return out.select("report_id", *[F.col(c).cast("long").alias(c) for c in ("total", "supported", "unsupported", "open", "downgraded")], "support_rate")


@query
def nfkc_names(spark, d):
    return lab.table(spark, d, "part").select("p_partkey", T.nfkc(F.concat(F.lit("Ｐ　"), F.col("p_name"))).alias("name"))


@query
def top_findings(spark, d):
    w = Window.partitionBy("report_id").orderBy(F.desc("value"), "pos")
    return lab.records(spark, d).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 8").select("report_id", "pos", "rank")


QUERIES |= more_queries.QUERIES


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Records to findings to conditions to one line per report."""
    return batch_summary(spark, d)
