"""Registered queries of the rules' whole panel, prose, passages, review, evaluation and bundles, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import fhir, findings, metrics, passages, prose, review, rules
from .oracles import LAB, STATUS
from .plans import lab

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# ---- every rule: one panel a customer, values from the key by fixed arithmetic --------------------

#: item -> (value as SQL over the key ``k``, status as SQL over the value ``v``)
_UP = lambda cut: f"case when v > {cut} then 'high' else 'normal' end"
_DOWN = lambda cut: f"case when v < {cut} then 'low' else 'normal' end"
_POSITIVE = "case when v > 0 then 'positive' else 'negative' end"
PANEL = {
    "ldl": ("60 + k * 7 % 140", _UP(130)), "tg": ("40 + k * 11 % 220", _UP(150)), "chol": ("120 + k * 13 % 150", _UP(200)), "hdl": ("25 + k * 3 % 60", _DOWN(40)),
    "sbp": ("100 + k * 17 % 70", _UP(130)), "dbp": ("60 + k * 19 % 45", _UP(85)), "glucose_ac": ("70 + k * 23 % 90", _UP(100)), "hba1c": ("4 + k * 29 % 40 / 10", _UP("5.6")),
    "waist": ("65 + k * 31 % 50", _UP(90)), "bmi": ("17 + k * 37 % 16", _UP(24)), "uric_acid": ("3 + k * 41 % 7", _UP(7)), "alt": ("10 + k * 43 % 60", _UP(50)),
    "ast": ("10 + k * 47 % 50", _UP(45)), "ggt": ("10 + k * 53 % 80", _UP(70)), "bil_total": ("k * 59 % 20 / 10", _UP("1.2")), "hbsag": ("k * 61 % 5 % 2", _POSITIVE),
    "egfr": ("30 + k * 67 % 90", _DOWN(60)), "creatinine": ("k * 71 % 25 / 10", _UP("1.3")), "urine_protein": ("k * 73 % 7 % 2", _POSITIVE), "urine_glucose": ("k * 79 % 3 % 2", _POSITIVE),
    "urine_ob": ("k * 83 % 9 % 2", _POSITIVE), "hb": ("9 + k * 89 % 9", _DOWN(12)), "mcv": ("65 + k * 97 % 40", _DOWN(80)), "tsh": ("k * 101 % 70 / 10", "case when v > 4 then 'high' when v < 1 then 'low' else 'normal' end"),
    "free_t4": ("k * 103 % 30 / 10", _DOWN("0.8")), "afp": ("k * 107 % 40", _UP(30)), "cea": ("k * 109 % 40", _UP(35)), "psa": ("k * 113 % 40", _UP(36)), "hs_crp": ("k * 127 % 20", _UP(15)), "homocysteine": ("k * 131 % 20", _UP(16)),
}
_SEX = "case k % 3 when 0 then 'M' when 1 then 'F' end"
_H = lambda *ks: " or ".join(f"{k}_s = 'high'" for k in ks)
_CRITERIA = "((waist >= case when sex = 'F' then 80 else 90 end)::int + (sbp >= 130 or dbp >= 85)::int + (glucose_ac >= 100)::int + (tg >= 150)::int + (hdl < case when sex = 'F' then 50 else 40 end)::int)"
#: category, text, confidence, condition; of equal texts the first that holds gives the confidence
_EXPECTED = [
    ("condition", "血脂異常", 0.9, _H("ldl", "tg", "chol") + " or hdl_s = 'low'"), ("risk", "動脈粥狀硬化", 0.7, _H("ldl", "tg", "chol") + " or hdl_s = 'low'"),
    ("risk", "心血管疾病", 0.7, _H("ldl", "tg", "chol", "sbp", "dbp", "hs_crp", "homocysteine") + " or hdl_s = 'low' or sbp >= 140 or dbp >= 90 or glucose_ac >= 126 or hba1c >= 6.5 or ms >= 3"),
    ("condition", "高血壓", 0.75, "sbp >= 140 or dbp >= 90"), ("condition", "血壓偏高", 0.8, "sbp < 140 and dbp < 90 and (" + _H("sbp", "dbp") + ")"),
    ("risk", "腦中風", 0.7, "sbp >= 140 or dbp >= 90 or " + _H("sbp", "dbp")), ("condition", "糖尿病", 0.75, "glucose_ac >= 126 or hba1c >= 6.5"), ("risk", "糖尿病併發症", 0.7, "glucose_ac >= 126 or hba1c >= 6.5"),
    ("condition", "糖尿病前期", 0.85, "glucose_ac < 126 and hba1c < 6.5 and (glucose_ac >= 100 or hba1c >= 5.7)"),
    ("risk", "第二型糖尿病", 0.7, "(glucose_ac < 126 and hba1c < 6.5 and (glucose_ac >= 100 or hba1c >= 5.7)) or ms >= 3"), ("condition", "代謝症候群", 0.9, "ms >= 3"),
    ("risk", "代謝症候群", 0.6, "ms = 2"), ("risk", "代謝症候群", 0.7, "ms <> 2 and bmi >= 27"), ("condition", "肥胖", 0.9, "bmi >= 27"), ("condition", "過重", 0.85, "bmi >= 24 and bmi < 27"),
    ("condition", "高尿酸血症", 0.9, _H("uric_acid")), ("risk", "痛風", 0.7, _H("uric_acid")), ("condition", "肝功能異常", 0.85, _H("alt", "ast", "ggt")), ("risk", "脂肪肝", 0.55, _H("alt", "ast", "ggt")),
    ("condition", "膽紅素偏高", 0.85, _H("bil_total")), ("condition", "B型肝炎帶原", 0.9, "hbsag_s = 'positive'"), ("risk", "肝臟疾病", 0.7, "hbsag_s = 'positive'"), ("condition", "慢性腎臟病", 0.8, "egfr < 60"),
    ("risk", "腎衰竭", 0.6, "egfr < 60"), ("risk", "慢性腎臟病", 0.6, "(egfr >= 60 and creatinine_s = 'high') or urine_protein_s = 'positive'"), ("condition", "蛋白尿", 0.85, "urine_protein_s = 'positive'"),
    ("condition", "尿糖陽性", 0.85, "urine_glucose_s = 'positive'"), ("condition", "尿潛血", 0.8, "urine_ob_s = 'positive'"), ("condition", "小球性貧血", 0.9, "hb_s = 'low' and mcv_s = 'low'"), ("risk", "缺鐵性貧血", 0.6, "hb_s = 'low' and mcv_s = 'low'"),
    ("condition", "貧血", 0.9, "hb_s = 'low'"), ("condition", "甲狀腺功能低下", 0.8, "tsh_s = 'high' and free_t4_s = 'low'"), ("condition", "亞臨床甲狀腺功能低下", 0.75, "tsh_s = 'high' and free_t4_s <> 'low'"),
    ("risk", "甲狀腺功能低下", 0.6, "tsh_s = 'high' and free_t4_s <> 'low'"), ("condition", "甲狀腺功能亢進", 0.7, "tsh_s = 'low'"), ("condition", "腫瘤標記偏高", 0.8, _H("afp", "cea", "psa")),
]
_WIDE = "select k, sex, " + ", ".join(f"{i}, {s.replace('v ', i + ' ')} as {i}_s" for i, (_, s) in PANEL.items()) + f" from (select c_custkey as k, {_SEX.replace('k %', 'c_custkey %')} as sex, " + ", ".join(
    f"({v.replace('k ', 'c_custkey ')})::double as {i}" for i, (v, _) in PANEL.items()
) + " from customer)"


@query(
    f"with w as ({_WIDE}), m as (select *, {_CRITERIA} as ms from w) "
    + " union all ".join(f"select 'p' || k as report_id, '{c}' as category, '{t}' as text, {conf}::double as conf from m where {when}" for c, t, conf, when in _EXPECTED)
)
def screening_panel(spark, d):
    """All rules over a panel of 30 items a customer."""
    cells = [f"named_struct('pos', {n}, 'item', '{i}', 'v', cast({v.replace('k ', 'c_custkey ')} as double))" for n, (i, (v, _)) in enumerate(PANEL.items())]
    sex = _SEX.replace("k %", "c_custkey %")
    x = lab.table(spark, d, "customer").selectExpr("concat('p', c_custkey) as report_id", f"{sex} as sex", f"inline(array({', '.join(cells)}))")
    status = "case item " + " ".join(f"when '{i}' then {s}" for i, (_, s) in PANEL.items()) + " end"
    x = x.selectExpr("*", "v as value_num", f"{status} as status", "item as display", "cast(v as string) as value_text", "'u' as unit").withColumn("direction", findings.direction(F.col("status")))
    return rules.derive(x).select("report_id", "category", "text", "conf")


# ---- rows that the lab view gives ------------------------------------------------------------------


@query(f"""with {STATUS}, t as (select *, case f when 2 then '<' when 3 then '>' end as op from st),
 b as (select report_id, count(*) as n_observations, count(value_num) as n_quantities, count(op) filter (value_num is not null) as n_comparators, count(*) filter (f in (0, 1)) as n_strings,
  count(*) filter (status in ('high', 'low', 'normal', 'positive', 'negative')) as n_interpreted, any_value(sex) as s from t group by report_id)
 select report_id, n_observations, n_quantities, n_comparators, n_strings, n_interpreted, case s when 'M' then 'male' when 'F' then 'female' else 'unknown' end as gender, 'DiagnosticReport' as second from b""")
def fhir_bundle_parts(spark, d):
    """Bundles read back: what each document holds."""
    from .operators import catalog

    items = catalog.item_table(spark).select("item", "item_unit")
    x = lab.classified(spark, d)
    who = x.select("report_id", "sex", "day").distinct()
    b = fhir.bundles(fhir.observations(x.join(F.broadcast(items), "item")), who)
    kind = "struct<entry:array<struct<resource:struct<resourceType:string,gender:string,valueQuantity:struct<value:double,comparator:string>,valueString:string,interpretation:array<struct<coding:array<struct<code:string>>>>>>>>"
    x = b.select("report_id", F.from_json("bundle", kind).alias("b")).select("report_id", F.expr("transform(b.entry, e -> e.resource)").alias("e"))
    n = lambda test: F.expr(f"cast(size(filter(e, x -> {test})) as bigint)")
    return x.select(
        "report_id", n("x.resourceType = 'Observation'").alias("n_observations"), n("x.valueQuantity.value is not null").alias("n_quantities"), n("x.valueQuantity.comparator is not null").alias("n_comparators"),
        n("x.valueString is not null").alias("n_strings"), n("x.interpretation is not null").alias("n_interpreted"), F.expr("e[0].gender").alias("gender"), F.expr("e[1].resourceType").alias("second"),
    )


@query(f"""with {LAB}, x as (select report_id, pos, display as name, trim(value_text) as value_text, case r when 0 then '(10~60)' when 1 then '((<50 mg/dL))' when 2 then '(>20)' when 3 then '(男:20-90 女:10-80 mg/dL)' when 4 then '(陰性)' else '' end as ref_text from lab),
 y as (select *, row_number() over (partition by report_id, name, value_text order by pos) as k from x)
 select report_id, cast(row_number() over (partition by report_id order by pos) - 1 as integer) as pos, name, value_text, '' as unit, ref_text, 'text' as source from y where k = 1""")
def extract_records(spark, d):
    """Reports rendered as text from the lab view, and read back by the line scanner."""
    from .operators import extract

    line = F.expr("concat(display, ' ', value_text, if(ref_text = '', '', concat(' (', ref_text, ')')))")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))), lambda s: s["l"])
    x = lab.records(spark, d).groupBy("report_id").agg(F.array_join(lines, "\n").alias("text"))
    return extract.records(x.withColumn("tables", F.lit(None).cast("array<array<array<string>>>")))


@query(f"""with {STATUS}, a as (select report_id, item, status, pos, value_num, value_text from st)
 select item, count(*) as n, count(distinct report_id) as reports, min(value_num) as least, max(value_num) as most, round(avg(value_num), 6) as mean,
 round(count(*) filter (status in ('high', 'low', 'positive')) / cast(count(*) as double), 6) as prevalence from a group by all""")
def dataset_stats(spark, d):
    return metrics.dataset_stats(lab.classified(spark, d), "item")


@query(f"""with {STATUS} select display || ' ' || case direction when 'high' then '偏高' else '偏低' end || ' 原因 風險 飲食 運動 生活習慣 改善' as query, count(*) as n from st where direction in ('high', 'low') group by all""")
def prefetch_queries(spark, d):
    return prose.questions(lab.classified(spark, d))


@query(f"""with {STATUS}, l as (select report_id, pos, '- ' || display || ' = ' || value_text || ' ' || unit || ' [' || case status when 'high' then '↑ HIGH' when 'low' then '↓ LOW' when 'positive' then '陽性 POSITIVE' else '?' end || ']' || case when range_conflict then '；注意：報告與公開參考範圍判定不同' else '' end as line from st where direction in ('high', 'low'))
 select report_id, string_agg(line, chr(10) order by pos) as findings_text from l group by report_id""")
def finding_lines(spark, d):
    return prose.finding_lines(lab.classified(spark, d).withColumn("ref_text", F.lit("")))


# ---- prose ---------------------------------------------------------------------------------------


@query("""select 'r' || c_custkey as report_id, case c_custkey % 3 when 0 then 0 else 1 end::integer + case when c_custkey % 2 = 0 then 1 else 0 end::integer as n_dropped,
 case when c_custkey % 3 = 0 then '血紅素 1' || c_custkey || ' g/dL' || chr(10) else '' end || '醫師建議三個月後複查血紅素 ' || c_nationkey as prose from customer""")
def strip_results(spark, d):
    """Lines that print a parsed result go, header lines too; a report's prose stays."""
    x = lab.table(spark, d, "customer").selectExpr(
        "concat('r', c_custkey) as report_id", "c_custkey as k",
        "concat(if(c_custkey % 2 = 0, '項目 結果 單位\n', ''), '血紅素 1', c_custkey, ' g/dL\n', '醫師建議三個月後複查血紅素 ', c_nationkey) as text",
    )
    found = x.selectExpr("report_id", "0 as pos", "'血紅素' as display", "'血紅素' as raw_name", "if(k % 3 = 0, 'none', concat('1', k)) as value_text", "'g/dL' as unit", "'' as ref_text")
    return prose.without_results(x.select("report_id", "text"), found).select("report_id", "n_dropped", "prose")


@query(r"""select doc_id, cast(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '(?i)超音波|X\s*光|攝影|心電圖|理學|結論|診斷|發現|內視鏡|胃鏡|大腸鏡|骨密度|眼底|聽力|視力|斷層|CT|MRI|檢查結果|醫師|印象|Impression'))) as bigint) as n from documents""")
def narrative_lines(spark, d):
    return lab.table(spark, d, "documents").select("doc_id", F.size(prose.narrative(F.col("text"))).cast("long").alias("n"))


@query("""select p_partkey, coalesce(case p_partkey % 4 when 0 then false when 1 then length(p_name) between 2 and 40 and p_size > 25 when 2 then length(p_name) between 2 and 40 else false end, false) as candidate from part""")
def item_candidates(spark, d):
    x = lab.table(spark, d, "part").selectExpr("p_partkey", "case p_partkey % 4 when 0 then concat('電話 ', p_name) when 3 then cast(p_size as string) else p_name end as name", "p_size > 25 as num", "p_partkey % 4 = 2 as ref")
    return x.select("p_partkey", prose.item_candidate(F.col("name"), F.col("num"), F.col("ref")).alias("candidate"))


# ---- passages ------------------------------------------------------------------------------------


@query(f"""select 'fact_' || p_partkey as id, concat_ws(chr(10), '【檢查項目】' || p_name || case when p_partkey % 2 = 0 then '（' || p_brand || '）' else '' end,
 case when p_partkey % 3 <> 2 then '【一般參考範圍】' || concat_ws('；', case when p_partkey % 3 = 0 then '男性 ' || p_size || '~99' end, case when p_partkey % 3 = 0 then '女性 1~' || p_size end, case when p_partkey % 3 = 1 then '<' || p_size end) || '（成人篩檢參考，非診斷標準）' end,
 case when p_partkey % 5 = 0 then '【說明】' || p_type end, '【提醒】{passages.REMINDER}') as text from part""")
def fact_sheets(spark, d):
    x = lab.table(spark, d, "part").selectExpr(
        "cast(p_partkey as string) as item", "p_name as zh", "if(p_partkey % 2 = 0, p_brand, p_name) as en", "'u' as item_unit", "if(p_partkey % 3 = 0, concat(p_size, '~99'), null) as range_m",
        "if(p_partkey % 3 = 0, concat('1~', p_size), '') as range_f", "if(p_partkey % 3 = 2, null, concat('<', p_size)) as range_text", "'' as qualitative", "if(p_partkey % 5 = 0, p_type, null) as note", "cast(null as string) as source",
    )
    return passages.fact_sheets(x).select("id", "text")


@query("""with x as (select s_suppkey as n, case when s_suppkey % 4 = 3 then null else 'T' || s_suppkey % 7 end as name from supplier), y as (select name, min(n) as n from x where name is not null group by name)
 select n, name as zh, 'E' || n as en, '<' || n as ref_text, case when name in ('T1', 'T2') then 'known' || name else 'kb_' || n end as item, name in ('T1', 'T2') as is_known from y""")
def legacy_catalogue(spark, d):
    x = lab.table(spark, d, "supplier").selectExpr("s_suppkey as n", "if(s_suppkey % 4 = 3, 'nothing', concat('【檢查項目】T', s_suppkey % 7, '（E', s_suppkey, '）\n【正常參考範圍】<', s_suppkey)) as content")
    known = spark.createDataFrame([("T1", "knownT1"), ("T2", "knownT2")], "name string, item string")
    # one name a T, whatever its English: the older catalogue's entries repeat
    x = x.withColumn("content", F.col("content"))
    out = passages.legacy_items(x, known)
    first = out.groupBy("zh").agg(F.min("n").alias("n"))
    return out.join(first, ["zh", "n"]).select("n", "zh", "en", "ref_text", "item", "is_known")


@query("""with c as (select user_id % 50 as report_id, event_id as pos, 'c' || event_id as id, case event_type when 'view' then 'fact' else 'care' end as kind from events where event_type in ('view', 'click')),
 w as (select user_id % 50 as report_id, min(event_id) as pos, 'w' || min(event_id) as id, 'web' as kind from events where event_type = 'error' group by user_id % 50, user_id % 7),
 x as (select * from c union all select * from w) select report_id, id, row_number() over (partition by report_id order by case kind when 'fact' then 0 when 'web' then 1 else 2 end, pos, id) as pos from x""")
def web_passages(spark, d):
    e = lab.table(spark, d, "events")
    c = e.where("event_type in ('view', 'click')").selectExpr("user_id % 50 as report_id", "event_id as pos", "concat('c', event_id) as id", "if(event_type = 'view', 'fact', 'care') as kind")
    w = e.where("event_type = 'error'").selectExpr("user_id % 50 as report_id", "event_id as pos", "concat('w', event_id) as id", "user_id % 7 as for_finding")
    return passages.with_web(c, w).select("report_id", "id", F.col("pos").cast("long").alias("pos"))


@query(r"select c_custkey, substr(trim(regexp_replace(lower(c_name || '/' || c_mktsegment || ':v' || c_custkey || '-'), '[^a-z0-9]+', '_', 'g'), '_'), 1, 60) as name from customer")
def collection_names(spark, d):
    x = lab.table(spark, d, "customer").withColumn("m", F.expr("concat(c_name, '/', c_mktsegment, ':v', c_custkey, '-')"))
    return x.select("c_custkey", passages.collection_name(F.col("m")).alias("name"))


# ---- review --------------------------------------------------------------------------------------

_TAGS = ("user_id as report_id", "if(event_id % 2 = 0, 'condition', 'risk') as category", "event_type as text")


@query("""with t as (select distinct user_id as report_id, case event_id % 2 when 0 then 'condition' else 'risk' end as category, event_type as text from events),
 r as (select distinct user_id as report_id, case event_id % 2 when 0 then 'condition' else 'risk' end as category, event_type as text from events where value > 50),
 a as (select distinct user_id as report_id, case event_id % 2 when 0 then 'condition' else 'risk' end as category, event_type as text from events where value > 200)
 select category, text, count(*) as n from t where not exists (select 1 from a join r using (report_id, category, text) where a.report_id = t.report_id and a.category = t.category and a.text = t.text) group by all""")
def review_removals(spark, d):
    e = lab.table(spark, d, "events")
    tags, rule, asked = (e.where(w).selectExpr(*_TAGS).distinct() for w in ("true", "value > 50", "value > 200"))
    return review.reviewed(tags, rule, asked).groupBy("category", "text").agg(F.count("*").alias("n"))


@query("""select user_id as report_id, event_id as pos, case event_id % 5 when 0 then 'no_answer' when 1 then 'drop' when 2 then 'unchanged' when 3 then 'invalid_revision' else 'revise' end as action from events where event_type = 'click'""")
def rewrite_log(spark, d):
    """One rewrite round of unsupported advice: what became of each tag."""
    x = lab.table(spark, d, "events").selectExpr(
        "user_id as report_id", "case event_type when 'click' then 'food' when 'view' then 'avoid' else 'condition' end as category", "event_id as pos", "concat('t', event_id) as text", "'kb:a' as src", "0.8D as conf", "event_type = 'view' as verdict",
    )
    a = x.where("pos % 5 > 0").selectExpr("report_id", "pos", "if(pos % 5 = 1, 'drop', 'revise') as action", "case pos % 5 when 2 then text when 3 then concat(text, ' and a sentence too long') else concat('n', pos) end as text", "if(pos % 5 = 2, 'kb:a', 'kb:b') as src")
    allowed = x.select("report_id").distinct().select("report_id", F.lit("kb:b").alias("src"))
    return review.rewritten(x, a, allowed)[1].select("report_id", "pos", "action")


@query(
    "with c(condition, category, text) as (values " + ", ".join(f"('{c}', '{a}', '{t}')" for c, xs in review.CANNED.items() for a, t in xs) + "), g(category, text) as (values " + ", ".join(f"('{a}', '{t}')" for a, t in review.GENERAL) + """),
 e as (select distinct user_id as report_id, case event_type when 'click' then '貧血' when 'error' then '糖尿病' when 'purchase' then '高血壓' else '別的' end as condition from events where value > 20),
 p as (select distinct report_id, c.category, c.text from e join c using (condition)), r as (select distinct user_id as report_id from events)
 select * from p union all select report_id, g.category, g.text from r cross join g where report_id not in (select report_id from p)"""
)
def canned_advice(spark, d):
    e = lab.table(spark, d, "events")
    c = e.where("value > 20").selectExpr("user_id as report_id", "'condition' as category", "case event_type when 'click' then '貧血' when 'error' then '糖尿病' when 'purchase' then '高血壓' else '別的' end as text")
    return review.canned(e.selectExpr("user_id as report_id"), c).drop("src")


# ---- evaluation ----------------------------------------------------------------------------------


@query("""with t as (select user_id as report_id, event_type as item, min(value) as want from events group by all), p as (select distinct user_id as report_id, case user_id % 2 when 0 then 'clean' else 'heavy' end as level, cast(user_id % 9 + 1 as double) as seconds, user_id % 3 + 1 as pages from events),
 s as (select report_id, item, case when report_id % 5 = 0 and item = 'click' then want + 1 else want end as value from t where not (report_id % 7 = 0 and item = 'error')),
 x as (select level, want, value from p join t using (report_id) left join s using (report_id, item)), r as (select level, count(*) as items, count(*) filter (value = want) as exact, count(*) filter (value <> want) as misread, count(*) filter (value is null) as missing from x group by all),
 q as (select level, count(*) as reports, round(median(seconds / pages), 6) as seconds_a_page from p group by all) select *, round(exact / cast(items as double), 6) as value_accuracy from q join r using (level)""")
def scan_summary(spark, d):
    e = lab.table(spark, d, "events")
    t = e.groupBy(F.col("user_id").alias("report_id"), F.col("event_type").alias("item")).agg(F.min("value").alias("value"))
    p = e.selectExpr("user_id as report_id", "if(user_id % 2 = 0, 'clean', 'heavy') as level", "cast(user_id % 9 + 1 as double) as seconds", "user_id % 3 + 1 as pages").distinct()
    s = t.where("not (report_id % 7 = 0 and item = 'error')").join(p.select("report_id", "level"), "report_id").withColumn("value", F.expr("if(report_id % 5 = 0 and item = 'click', value + 1, value)"))
    return metrics.scan_summary(t, s, p)


@query("select user_id as report_id, event_type as stage, round(sum(round(value, 2)), 3) as seconds from events group by all")
def stage_seconds(spark, d):
    return metrics.timings(lab.table(spark, d, "events").selectExpr("user_id as report_id", "event_type as stage", "round(value, 2) as seconds"))


@query("""with x as (select event_id, user_id % 97 as item, case event_id % 11 when 0 then '' else event_type end as zh, case event_id % 5 when 0 then null else 'u' end as unit, value as lo, case event_id % 3 when 0 then value - 1 when 1 then value + 1 end as hi from events),
 r as (select item, 'repeated key' as fault from x group by item having count(*) > 1)
 select fault, count(*) as n from (select fault from r union all select 'no name' from x where zh = '' union all select 'bounds the wrong way round' from x where lo > hi union all select 'range without unit' from x where unit is null) group by all""")
def catalogue_faults(spark, d):
    x = lab.table(spark, d, "events").selectExpr("user_id % 97 as item", "if(event_id % 11 = 0, '', event_type) as zh", "if(event_id % 5 = 0, null, 'u') as unit", "value as lo", "case event_id % 3 when 0 then value - 1 when 1 then value + 1 end as hi")
    return metrics.faults(x).groupBy("fault").agg(F.count("*").alias("n"))


@query("""with w as (select p_partkey as id, unnest(list_distinct(string_split(lower(p_name), ' '))) as term from part), d as (select distinct lower(split_part(p_name, ' ', 1)) as term from part where p_partkey % 10 = 0)
 select distinct id, term from w semi join d using (term)""")
def egress_leaks(spark, d):
    x = lab.table(spark, d, "part").selectExpr("p_partkey as id", "p_name as text")
    return metrics.leaked(x, lab.table(spark, d, "part").where("p_partkey % 10 = 0").select(F.upper(F.split("p_name", " ")[0]).alias("term")))


@query("select event_id, case event_id % 4 when 0 then true when 1 then false when 2 then true else event_type = 'view' end as same from events")
def same_results(spark, d):
    x = lab.table(spark, d, "events").selectExpr(
        "event_id", "case event_id % 4 when 0 then value when 1 then value end as p", "case event_id % 4 when 0 then value + 0.0000001 when 1 then value + 1 end as g",
        "if(event_id % 4 = 2, ' NEG', 'view') as pt", "if(event_id % 4 = 2, 'n eg ', event_type) as gt",
    )
    return x.select("event_id", metrics.same_value(F.col("p"), F.col("g"), F.col("pt"), F.col("gt")).alias("same"))
