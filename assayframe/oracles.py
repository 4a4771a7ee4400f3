"""SQL for the registered queries, written apart from them: numbers instead of parsed texts where it can."""

from __future__ import annotations

LAB = """lab as (select *, case f when 0 then '陰性' when 1 then '2+' when 2 then '<' || s when 3 then '> ' || s when 4 then s || ' H' else s end as value_text,
 case item when 'ldl' then '低密度脂蛋白' when 'tg' then '三酸甘油脂' when 'hb' then '血紅素' when 'glucose_ac' then '空腹血糖' else '尿酸' end as display,
 case u when 0 then 'mmol/L' when 1 then 'U/L' else 'mg/dL' end as unit
 from (select event_id as pos, user_id as patient, ts, cast(ts as date) as day, value as v, cast(value as varchar) as s,
 case event_type when 'view' then 'ldl' when 'click' then 'tg' when 'error' then 'hb' when 'purchase' then 'glucose_ac' else 'uric_acid' end as item,
 event_id % 20 as f, (event_id // 20) % 6 as r, (event_id // 120) % 5 as u,
 case when user_id % 3 = 2 then null when user_id % 2 = 0 then 'M' else 'F' end as sex,
 user_id || '-' || strftime(ts, '%Y-%m-%d') as report_id from events))"""


def judged(x: str, lo: str | None, hi: str | None, strict: bool = False) -> str:
    """Status of the number ``x`` printed in form ``f`` against bounds."""
    low = f"{x} {'<=' if strict else '<'} {lo}" if lo else "false"
    high = f"{x} {'>=' if strict else '>'} {hi}" if hi else "false"
    under = (f"when {x} <= {lo} then 'low' " if lo else "") + (f"when {x} <= {hi} then 'normal' " if hi else "")
    over = f"when {x} >= {hi} then 'high' " if hi else f"when {x} >= {lo} then 'normal' "
    neg = "'negative'" if not lo else "null"
    return f"case when f = 0 then {neg} when f = 1 then null when f = 2 then case {under} end when f = 3 then case {over} end when {low} then 'low' when {high} then 'high' else 'normal' end"


def sexed(m: str, f: str) -> str:
    both = f"case when ({m}) is not distinct from ({f}) then ({m}) when ({m}) is null or ({f}) is null then null when ({m}) = 'normal' or ({f}) = 'normal' then 'normal' end"
    return f"case sex when 'M' then ({m}) when 'F' then ({f}) else {both} end"


DIRECTION = "case when {0} in ('high', 'positive') then 'high' when {0} = 'low' then 'low' when {0} in ('normal', 'negative') then 'normal' else 'unknown' end"
BY_SEX = sexed(judged("v", "20", "90"), judged("v", "10", "80"))
PRINTED = (
    f"case r when 0 then {judged('v', '10', '60')} when 1 then {judged('v', None, '50', True)} when 2 then {judged('v', '20', None, True)} "
    f"when 3 then {BY_SEX} when 4 then case f when 0 then 'negative' when 1 then 'positive' when 2 then 'normal' else 'high' end end"
)
# against the reference range; factor null: unit of another kind
FACTOR = "case u when 0 then case item when 'ldl' then 38.67 when 'tg' then 88.57 when 'glucose_ac' then 18.0 end when 1 then null else case item when 'hb' then null else 1.0 end end"
X = "(v * factor)"
KNOWN = (
    f"case when f <> 0 and factor is null then null else case item when 'ldl' then {judged(X, None, '130')} when 'tg' then {judged(X, None, '150')} "
    f"when 'glucose_ac' then {judged(X, '70', '100')} when 'hb' then {sexed(judged(X, '13.5', '17.5'), judged(X, '12', '16'))} else {sexed(judged(X, '3.5', '7.2'), judged(X, '2.6', '6'))} end end"
)
STATUS = f"""{LAB}, fac as (select *, {FACTOR} as factor from lab),
 two as (select *, case when r = 5 or (r = 4 and f > 1) then null else {PRINTED} end as report_status, {KNOWN} as kb_status from fac),
 three as (select *, coalesce(report_status, kb_status, case when f = 4 then 'high' end, 'unknown') as status from two),
 st as (select *, {DIRECTION.format('status')} as direction, case when report_status is not null then 'report' when kb_status is not null then 'reference' when f = 4 then 'report_flag' end as range_source,
  report_status is not null and kb_status is not null and {DIRECTION.format('report_status')} <> {DIRECTION.format('kb_status')} as range_conflict,
  sex is null and case when report_status is not null then r = 3 else item in ('hb', 'uric_acid') end as sex_unknown, case when f not in (0, 1) then v end as value_num from three)"""
# last finding of each item in a report
WIDE = f"""{STATUS}, wide as (select report_id, sex, {', '.join(f"arg_max(struct_pack(v := value_num, s := status, t := display || ' ' || value_text || ' ' || unit), pos) filter (item = '{k}') as {k}" for k in ('ldl', 'tg', 'hb', 'glucose_ac', 'uric_acid'))} from st group by report_id, sex),
 ms as (select *, coalesce(glucose_ac.v >= 100, false) as mg, coalesce(tg.v >= 150, false) as mt from wide),
 mse as (select *, mg::int + mt::int as ms_count, concat_ws('、', case when mg then glucose_ac.t end, case when mt then tg.t end) as ms_evidence from ms)"""
RULES = [
    ("condition", 0, "血脂異常", "ldl.s = 'high' or tg.s = 'high'", "concat_ws('、', case when ldl.s = 'high' then ldl.t end, case when tg.s = 'high' then tg.t end)", 0.9),
    ("risk", 1, "心血管疾病", "ldl.s = 'high' or tg.s = 'high'", "'血脂異常'", 0.7),
    ("risk", 2, "動脈粥狀硬化", "ldl.s = 'high' or tg.s = 'high'", "'血脂異常'", 0.7),
    ("condition", 7, "糖尿病", "glucose_ac.v >= 126", "glucose_ac.t", 0.75),
    ("risk", 8, "糖尿病併發症", "glucose_ac.v >= 126", "'血糖過高'", 0.7),
    ("risk", 9, "心血管疾病", "glucose_ac.v >= 126", "'血糖過高'", 0.7),
    ("condition", 10, "糖尿病前期", "glucose_ac.v >= 100 and glucose_ac.v < 126", "glucose_ac.t", 0.85),
    ("risk", 11, "第二型糖尿病", "glucose_ac.v >= 100 and glucose_ac.v < 126", "'血糖偏高'", 0.7),
    ("risk", 15, "代謝症候群", "ms_count = 2", "'已符合 2/5 項：' || ms_evidence", 0.6),
    ("condition", 19, "高尿酸血症", "uric_acid.s = 'high'", "uric_acid.t", 0.9),
    ("risk", 20, "痛風", "uric_acid.s = 'high'", "'尿酸偏高'", 0.7),
    ("condition", 35, "貧血", "hb.s = 'low'", "hb.t", 0.9),
]
DERIVED = f"""{WIDE}, fired as ({' union all '.join(f"select report_id, '{c}' as category, {i} as pos, '{t}' as text, cast({conf} as double) as conf, {ev} as evidence from mse where {when}" for c, i, t, when, ev, conf in RULES)}),
 tags as (select * from fired qualify row_number() over (partition by report_id, category, text order by pos) = 1)"""
RUNS = f"{LAB}, runs as (select report_id, patient, day, count(*) as n_findings from lab group by all)"
WORDS = r"regexp_extract_all(lower({0}), '[a-z0-9À-ɏ]+')"
COS = "round(1 - list_cosine_similarity(cast(v.embedding as double[]), cast(q.embedding as double[])), 6)"
DENSE = f"""near as (select q.vec_id as query_id, v.vec_id, {COS} as distance from embeddings v, embeddings q where q.vec_id % 100 = 0),
 top as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from near qualify rank <= 10)"""
CHUNKS = """cut as (select doc_id, text, unnest(range(0, cast(greatest(0, ceil((length(text) - 80) / 420.0) - 1) as bigint) + 1)) as n from documents where length(text) > 0),
 chunks as (select doc_id, n, substr(text, n * 420 + 1, 500) as chunk from cut)"""
PAGE = r"regexp_replace(html, '(?is)<(script|style|table)\b.*?</(script|style|table)>', ' ', 'g')"
PAGE = rf"regexp_replace({PAGE}, '(?s)<[^>]*>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    PAGE = f"replace({PAGE}, '{_a}', '{_b}')"
_BI = "case when length({0}) < 2 then [] else list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) end"
_FLAT = r"regexp_replace(lower({0}), '\s+', '', 'g')"
_RATIO = "case when {1} > 0 then round(cast({0} as double) / {1}, 6) else 0.0 end"

ORACLES = {
    "parse_value": f"""with {LAB} select pos, case f when 0 then 'neg' when 1 then 'pos' else 'num' end as kind, case when f > 1 then v end as v,
 case f when 2 then '<' when 3 then '>' else '' end as op, case f when 1 then '2+' end as grade, case f when 4 then 'H' else '' end as flag from lab""",
    "parse_ref": f"""with {LAB} select pos, case r when 0 then 'range' when 1 then 'upper' when 2 then 'lower' when 3 then 'sex' when 4 then 'qual_neg' else 'none' end as kind,
 cast(case r when 0 then 10 when 2 then 20 when 3 then 20 end as double) as m_lo, cast(case r when 0 then 60 when 1 then 50 when 3 then 90 end as double) as m_hi,
 cast(case r when 0 then 10 when 2 then 20 when 3 then 10 end as double) as f_lo, cast(case r when 0 then 60 when 1 then 50 when 3 then 80 end as double) as f_hi,
 case when r in (1, 3) then 'mg/dL' else '' end as unit from lab""",
    "classify_printed": f"with {LAB}, x as (select pos, {PRINTED} as status from lab) select pos, status, {DIRECTION.format('status')} as direction from x",
    "classify_sex_unknown": f"with {LAB}, x as (select item, {PRINTED} as status from lab where r = 3 and sex is null) select item, status, count(*) as n from x group by all",
    "classify_censored": f"with {LAB}, x as (select f, r, {PRINTED} as status from lab where f in (2, 3)) select f, r, status, count(*) as n from x group by all",
    "unit_convert": f"with {LAB}, x as (select pos, v, {FACTOR} as factor from lab) select pos, cast(factor as double) as factor, round(v * cast(factor as double), 6) as converted from x",
    "unit_keys": "select event_id as pos, case event_id % 6 when 0 then 'mg/dl' when 1 then '10^3/ul' when 2 then '10^6/ul' when 3 then 'u/l' when 4 then 'mmhg' else 'mg/dl' end as k from events",
    "name_keys": "select event_id as pos, case event_id % 4 when 0 then 'uricacid' when 1 then '鹼性磷酸酶' when 2 then 'ldlc' else 'a/g(ratio)' end as k from events",
    "resolve_alias": f"with {LAB} select pos, case when pos % 5 < 3 then item end as item from lab",
    "unmatched_names": "select 'note ' || event_id % 10 as name, count(*) as n from events where event_id % 3 <> 0 group by all",
    "classify_findings": f"with {STATUS} select pos, report_status, kb_status, status, direction, range_source, range_conflict, sex_unknown from st",
    "abnormal_only": f"with {STATUS} select item, direction, count(*) as n from st where direction in ('high', 'low') group by all",
    "range_conflicts": f"with {STATUS} select item, count(*) filter (range_conflict) as conflicts, count(*) as n from st group by all",
    "dedupe_findings": f"""with {LAB}, x as (select report_id, item, pos, row_number() over (partition by report_id, item, case f when 0 then 'neg' when 1 then 'pos' when 2 then '<' || round(v, 6) when 3 then '>' || round(v, 6) else '' || round(v, 6) end order by pos % 2, pos) as k from lab)
 select report_id, item, pos, count(*) over (partition by report_id, item) as n_values, count(*) over (partition by report_id, item) > 1 as duplicate from x where k = 1""",
    "sex_vote": f"""with {LAB}, x as (select report_id, case when patient % 2 = 0 then 1 else 0 end as m from lab where item in ('hb', 'uric_acid')), y as (select report_id, sum(m)::bigint as votes_m, sum(1 - m)::bigint as votes_f from x group by all)
 select *, case when votes_m >= 2 and votes_f = 0 then 'M' when votes_f >= 2 and votes_m = 0 then 'F' end as sex_inferred from y""",
    "derive_conditions": f"with {DERIVED} select report_id, category, text, conf, evidence from tags",
    "metabolic_score": f"with {WIDE} select report_id, ms_count::bigint as ms_count, ms_evidence from mse",
    "metric_tags": f"with {STATUS} select report_id, pos, display || ' ' || value_text || ' ' || unit || ' ' || case direction when 'high' then '↑' else '↓' end as text from st where direction in ('high', 'low')",
    "batch_summary": f"""with {DERIVED}, a as (select report_id, count(*) as n_findings, count(*) filter (direction in ('high', 'low')) as n_abnormal, count(*) filter (range_conflict) as n_conflicts, count(*) filter (status = 'unknown') as n_unknown from st group by all),
 b as (select report_id, string_agg(text, '、' order by pos) filter (category = 'condition') as conditions, string_agg(text, '、' order by pos) filter (category = 'risk') as risks from tags group by all)
 select a.*, coalesce(conditions, '') as conditions, coalesce(risks, '') as risks from a left join b using (report_id)""",
    "trend_indicators": f"with {STATUS} select patient, item, any_value(display) as display, arg_min(unit, (day, pos)) as unit, count(distinct report_id) as points from st where value_num is not null group by patient, item",
    "trend_series": f"with {STATUS} select patient, item, report_id, day, value_num, status from st where value_num is not null qualify row_number() over (partition by patient, item, report_id order by pos) = 1",
    "recent_runs": f"with {RUNS} select report_id, patient, day, n_findings from runs order by day desc, report_id desc limit 50",
    "forget_patients": f"with {RUNS} select patient, count(*) as runs from runs where patient not in (select user_id from events where event_type = 'signup' and value > 400) group by all",
    "pseudonyms": f"select c_custkey, substr(sha256(unhex('{bytes(b ^ 0x5C for b in b'salt-1'.ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in b'salt-1'.ljust(64, bytes(1))).hex()}') || encode(trim(c_name))))), 1, 16) as patient from customer",
    "daily_trend": f"with {STATUS} select patient, item, day, count(*) as points, min(value_num) as low, max(value_num) as high from st group by all",
    "chunk_fixed": f"with {CHUNKS} select doc_id, n, md5(chunk) as chunk from chunks",
    "clean_text": r"""select doc_id, length(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^.*the the.*$', '', 'g'), 'https?://[^\s]+', '', 'g'), '\n{3,}', E'\n\n', 'g'), ' '), 'x^', '')) as n from documents""",
    "off_topic": "select lang, count(*) as n from documents where lang <> 'es' and source <> 'src3' group by all",
    "bm25_topk": f"""with asked as (select distinct item_id as query_id, unnest({WORDS.format('text')}) as term from benchmark), terms as (select distinct term from asked),
 tok as (select doc_id, {WORDS.format('text')} as w from documents), sizes as (select doc_id, len(w) as l from tok), stat as (select count(*) as n, avg(l) as a from sizes),
 tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from tok) semi join terms using (term) group by all), df as (select term, count(*) as df from tf group by all),
 part as (select doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a)) as p from tf join df using (term) join sizes using (doc_id), stat),
 sc as (select query_id, doc_id, round(sum(p), 6) as score from part join asked using (term) group by all)
 select query_id, doc_id, round(score, 4) as score from sc where score > 0 qualify row_number() over (partition by query_id order by score desc, doc_id) <= 5""",
    "dense_topk": f"with {DENSE} select query_id, vec_id, rank, round(distance, 4) as distance from top",
    "rrf_fuse": f"""with {DENSE}, o as (select q.vec_id as query_id, v.vec_id as id, row_number() over (partition by q.vec_id order by abs(v.vec_id - q.vec_id), v.vec_id) as rank from embeddings v join embeddings q on v.label = q.label where q.vec_id % 100 = 0 qualify rank <= 10),
 u as (select query_id, vec_id as id, rank from top union all select * from o), s as (select query_id, id, round(sum(1.0 / cast(60 + rank as double)), 5) as score, min(rank) as best from u group by all)
 select query_id, id, score from s qualify row_number() over (partition by query_id order by score desc, best, id) <= 10""",
    "round_robin": f"""with {LAB}, h as (select distinct report_id, pos % 3 as fp, pos % 2 + 1 as rk, pos % 7 as id, case when pos % 11 = 0 then 'fact' else 'kb' end as kind from lab),
 one as (select * from h qualify row_number() over (partition by report_id, id order by case kind when 'fact' then 0 else 1 end, rk, fp) = 1)
 select report_id, id, row_number() over (partition by report_id order by case kind when 'fact' then 0 else 1 end, rk, fp, id) as pos, kind from one""",
    "context_budget": f"with {CHUNKS}, x as (select doc_id, sum(length(chunk)) over (partition by doc_id order by n) as used from chunks) select doc_id as report_id, count(*) as blocks, max(used)::bigint as used from x where used <= 3500 group by all",
    "tag_routing": f"with {STATUS} select case when item in ('ldl', 'tg') then 'c1' when item = 'hb' then 'c2' else 'c3' end as id, item, count(distinct report_id) as n from st where item = 'tg' or (item = 'ldl' and status = 'high') or (item = 'hb' and status = 'low') or (item = 'uric_acid' and status = 'high') group by all",
    "lexical_support": f"""with x as (select a.conv_id, a.turn, {_FLAT.format('a.text')} as c, {_FLAT.format('b.text')} as p from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1), y as (select *, {_BI.format('c')} as g from x)
 select conv_id, turn, case when len(g) > 0 then round(len(list_filter(g, lambda z: contains(p, z))) / cast(len(g) as double), 6) when contains(p, c) then 1.0 else 0.0 end as support from y""",
    "inferred_cap": f"""with {LAB}, x as (select report_id, pos, case when pos % 3 = 0 then 'inferred' else 'report' end as src, round(v / 500, 4) as conf from lab),
 y as (select *, floor(0.25 * count(*) over (partition by report_id)) as allowed, row_number() over (partition by report_id, src order by conf desc, pos) as k from x) select report_id, pos, src from y where src <> 'inferred' or k <= allowed""",
    "leak_overlap": r"""with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-zÀ-ɏ]+'), lambda x: x <> '') as w from documents), b as (select list_filter(regexp_split_to_array(lower(text), '[^a-zÀ-ɏ]+'), lambda x: x <> '') as w from benchmark),
 own as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) as run from d where len(w) >= 3), known as (select distinct unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) as run from b where len(w) >= 3),
 s as (select doc_id, count(k.run) as hits, count(*) as total from own left join known k using (run) group by all) select doc_id, hits, total, round(hits / cast(total as double), 6) as share from s where hits > 0""",
    "strip_markup": rf"select page_id, md5(trim(regexp_replace({PAGE}, '\s+', ' ', 'g'))) as plain from pages",
    "page_urls": r"""select page_id, nullif(regexp_extract(html, '(https?://[^\s"''<>)]+)', 1), '') as url from pages""",
    "exam_dates": "select event_id as pos, case when event_id % 3 < 2 then cast(ts as date) end as d from events",
    "sex_header": "select event_id as pos, case event_id % 4 when 0 then 'M' when 1 then 'F' when 2 then 'M' end as sex from events",
    "csv_cells": f"with {LAB} select pos, case pos % 4 when 0 then '''=' || value_text when 1 then '''-' || value_text when 2 then '''@x' else value_text end as cell from lab",
    "number_texts": "select p_partkey, regexp_replace(regexp_replace(printf('%.6f', p_retailprice), '0+$', ''), '\\.$', '') as shown from part",
    "eval_prf": f"""with x as (select lang, count(*) filter (n_chars > 500 and quality = 1) as tp, count(*) filter (n_chars > 500 and quality <> 1) as fp, count(*) filter (n_chars <= 500 and quality = 1) as fn from labels join documents using (doc_id) group by all),
 y as (select coalesce(lang, 'all') as category, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from x group by rollup (lang))
 select *, {_RATIO.format('tp', '(tp + fp)')} as precision, {_RATIO.format('tp', '(tp + fn)')} as recall, {_RATIO.format('2 * tp', '(2 * tp + fp + fn)')} as f1 from y""",
    "ndcg5": f"""with {DENSE}, g as (select query_id, rank, case when a.label = b.label then 2 else 0 end + case when t.vec_id = query_id then 1 else 0 end as grade from top t join embeddings a on a.vec_id = t.vec_id join embeddings b on b.vec_id = query_id),
 i as (select *, row_number() over (partition by query_id order by grade desc, rank) as ideal from g), s as (select query_id, sum(case when rank <= 5 then (2 ** grade - 1) / log2(rank + 1) end) as dcg, sum(case when ideal <= 5 then (2 ** grade - 1) / log2(ideal + 1) end) as best,
 count(*) filter (grade > 0 and rank <= 5) as p, min(rank) filter (grade > 0) as f from i group by all) select query_id, case when best > 0 then round(dcg / best, 6) else 0.0 end as ndcg, round(p / 5.0, 6) as precision, round(coalesce(1.0 / f, 0), 6) as mrr from s""",
    "coverage": "with x as (select unnest([event_type, 'user' || user_id % 5]) as token, event_id % 3 as k from events) select token, count(*) filter (k = 0) as diet, count(*) filter (k = 1) as cause, count(*) filter (k = 2) as care from x group by all",
    "coverage_gaps": "select distinct 'user' || user_id as token, event_type as kind from events e where not exists (select 1 from events h where h.value > 300 and h.user_id = e.user_id and h.event_type = e.event_type)",
    "even_sample": "with x as (select c_custkey, row_number() over (order by c_custkey) - 1 as i, count(*) over () as t from customer) select c_custkey from x where (i + 1) * 12 // t > i * 12 // t",
    "cache_fingerprint": "select doc_id, substr(sha256(text), 1, 32) || '_' || substr(sha256('v1'), 1, 16) as k from documents",
    "uncached_work": "with x as (select *, sha256(text) as k from documents) select lang, count(*) as n from x where k not in (select k from x where doc_id % 3 = 0 and doc_id % 2 = 0) group by all",
    "fhir_observations": f"""with {STATUS} select pos, case when not (u = 0 or u = 1 or item = 'hb' and false) then case item when 'ldl' then '2089-1' when 'tg' then '2571-8' when 'hb' then '718-7' when 'glucose_ac' then '1558-6' else '3084-1' end end as code,
 value_num as value, case f when 2 then '<' when 3 then '>' end as comparator, case f when 0 then '陰性' when 1 then '2+' end as value_string, unit, case status when 'high' then 'H' when 'low' then 'L' when 'normal' then 'N' when 'positive' then 'POS' when 'negative' then 'NEG' end as interpretation from st""",
    "web_queries": f"with {STATUS} select display || ' ' || case direction when 'high' then '偏高' else '偏低' end || ' 衛教' as q, count(*) as n from st where direction in ('high', 'low') group by all",
    "prior_confidence": f"""with {LAB}, x as (select report_id, item as category, pos from lab qualify row_number() over (partition by report_id, item, value_text order by pos) = 1), y as (select *, row_number() over (partition by report_id, category order by pos) as k from x)
 select report_id, category, pos, round(greatest(0.3, 0.8 - 0.02 * (k - 1))::double, 6) as conf from y where k <= 4""",
    "verdict_stats": f"""with {LAB}, x as (select report_id, count(*) as total, count(*) filter (pos % 3 = 0) as supported, count(*) filter (pos % 3 = 1) as unsupported, count(*) filter (pos % 3 = 2) as open, count(*) filter (pos % 5 = 0) as downgraded from lab group by all)
 select *, case when supported + unsupported > 0 then round(supported / cast(supported + unsupported as double), 6) end as support_rate from x""",
    "nfkc_names": "select p_partkey, 'P ' || trim(regexp_replace(p_name, ' +', ' ', 'g')) as name from part",
    "top_findings": f"with {LAB} select report_id, pos, row_number() over (partition by report_id order by v desc, pos) as rank from lab qualify rank <= 8",
}
