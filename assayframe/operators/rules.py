"""Screening conditions and risks from findings, as one pivot and a declared list of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

KEYS = (
    "ldl tg chol hdl sbp dbp glucose_ac hba1c waist bmi uric_acid alt ast ggt bil_total hbsag egfr creatinine urine_protein urine_glucose urine_ob "
    "hb mcv tsh free_t4 t4 afp cea ca199 ca125 ca153 psa cyfra nse hs_crp homocysteine"
).split()
MARKERS = "afp cea ca199 ca125 ca153 psa cyfra nse".split()


def pivot(findings: DataFrame) -> DataFrame:
    """One row per report: for each known item the struct of its last finding (null without one)."""
    cell = F.struct("pos", F.col("value_num").cast("double").alias("v"), F.coalesce("status", "direction").alias("s"), "display", "value_text", "unit")
    wide = findings.where(F.col("item").isin(KEYS)).groupBy("report_id", "sex").pivot("item", KEYS)
    return wide.agg(F.max_by(cell, "pos"))


def _v(k: str) -> Column:
    return F.col(f"`{k}`.v")


def _is(k: str, *s: str) -> Column:
    return F.coalesce(F.col(f"`{k}`.s").isin(*s), F.lit(False))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _shown(k: str, when: Column | None = None) -> Column:
    c = F.col(f"`{k}`")
    unit = F.when(F.coalesce(c["unit"], F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), c["unit"]))
    text = F.concat(c["display"], F.lit(" "), c["value_text"], unit)
    return F.when(c.isNotNull() & (F.lit(True) if when is None else when), text)


def _join(parts: list[Column]) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), "、")


def metabolic(wide: DataFrame) -> DataFrame:
    """``wide`` with the five criteria as booleans, their number and their evidence. Unknown sex has the male limits."""
    female = F.col("sex").eqNullSafe("F")
    bp = [("sbp", 130), ("dbp", 85)]
    tests = {
        "ms_waist": _v("waist") >= F.when(female, 80).otherwise(90),
        "ms_bp": _yes(_v("sbp") >= 130) | _yes(_v("dbp") >= 85),
        "ms_glucose": _v("glucose_ac") >= 100,
        "ms_tg": _v("tg") >= 150,
        "ms_hdl": _v("hdl") < F.when(female, 50).otherwise(40),
    }
    x = wide.withColumns({k: _yes(c) for k, c in tests.items()})
    shown = [_shown("waist", F.col("ms_waist")), *(_shown(k, _yes(_v(k) >= cut)) for k, cut in bp)]
    shown += [_shown(k, F.col(f"ms_{m}")) for k, m in (("glucose_ac", "glucose"), ("tg", "tg"), ("hdl", "hdl"))]
    return x.withColumn("ms_count", sum((F.col(k).cast("int") for k in tests), F.lit(0))).withColumn("ms_evidence", _join(shown))


def _rules() -> list[tuple]:
    """(kind, text, when, evidence, confidence) in order of declaration; the first of a text wins."""
    lipid = [("ldl", "high"), ("tg", "high"), ("chol", "high"), ("hdl", "low")]
    any_lipid = _is("ldl", "high") | _is("tg", "high") | _is("chol", "high") | _is("hdl", "low")
    # a value of zero is no blood pressure and no glucose
    high_bp = _yes(_v("sbp") >= 140) | _yes(_v("dbp") >= 90)
    some_bp = ~high_bp & (_is("sbp", "high") | _is("dbp", "high"))
    diabetes = _yes(_v("glucose_ac") >= 126) | _yes(_v("hba1c") >= 6.5)
    before = ~diabetes & (_yes(_v("glucose_ac") >= 100) | _yes(_v("hba1c") >= 5.7))
    obese, heavy = _yes(_v("bmi") >= 27), _yes((_v("bmi") >= 24) & (_v("bmi") < 27))
    liver = _is("alt", "high") | _is("ast", "high") | _is("ggt", "high")
    hbv = _is("hbsag", "positive", "high")
    ckd = _yes(_v("egfr") < 60)
    protein = _is("urine_protein", "positive", "high")
    anaemia, small = _is("hb", "low"), _is("hb", "low") & _is("mcv", "low")
    ft4 = F.coalesce(F.col("free_t4"), F.col("t4"))
    tsh_up, t4_low = _is("tsh", "high"), _yes(ft4["s"] == "low")
    t4_shown = F.coalesce(_shown("free_t4"), _shown("t4"))
    ms = F.col("ms_count")
    bp = _join([_shown("sbp"), _shown("dbp")])
    sugar = _join([_shown("glucose_ac"), _shown("hba1c")])
    marker = [_is(k, "high", "positive") for k in MARKERS]
    some_marker = marker[0]
    for m in marker[1:]:
        some_marker = some_marker | m
    c, r, lit = "condition", "risk", F.lit
    return [
        (c, "血脂異常", any_lipid, _join([_shown(k, _is(k, s)) for k, s in lipid]), 0.9),
        (r, "心血管疾病", any_lipid, lit("血脂異常"), 0.7),
        (r, "動脈粥狀硬化", any_lipid, lit("血脂異常"), 0.7),
        (c, "高血壓", high_bp, bp, 0.75),
        (c, "血壓偏高", some_bp, bp, 0.8),
        (r, "心血管疾病", high_bp | some_bp, lit("血壓偏高"), 0.7),
        (r, "腦中風", high_bp | some_bp, lit("血壓偏高"), 0.7),
        (c, "糖尿病", diabetes, sugar, 0.75),
        (r, "糖尿病併發症", diabetes, lit("血糖過高"), 0.7),
        (r, "心血管疾病", diabetes, lit("血糖過高"), 0.7),
        (c, "糖尿病前期", before, sugar, 0.85),
        (r, "第二型糖尿病", before, lit("血糖偏高"), 0.7),
        (c, "代謝症候群", ms >= 3, F.concat(lit("符合 "), ms.cast("string"), lit("/5 項："), F.col("ms_evidence")), 0.9),
        (r, "心血管疾病", ms >= 3, lit("代謝症候群"), 0.7),
        (r, "第二型糖尿病", ms >= 3, lit("代謝症候群"), 0.7),
        (r, "代謝症候群", ms == 2, F.concat(lit("已符合 2/5 項："), F.col("ms_evidence")), 0.6),
        (c, "肥胖", obese, _join([_shown("bmi")]), 0.9),
        (r, "代謝症候群", obese, lit("肥胖"), 0.7),
        (c, "過重", heavy, _join([_shown("bmi")]), 0.85),
        (c, "高尿酸血症", _is("uric_acid", "high"), _join([_shown("uric_acid")]), 0.9),
        (r, "痛風", _is("uric_acid", "high"), lit("尿酸偏高"), 0.7),
        (c, "肝功能異常", liver, _join([_shown(k, _is(k, "high")) for k in ("alt", "ast", "ggt")]), 0.85),
        (r, "脂肪肝", liver, lit("肝指數偏高"), 0.55),
        (c, "膽紅素偏高", _is("bil_total", "high"), _join([_shown("bil_total")]), 0.85),
        (c, "B型肝炎帶原", hbv, _join([_shown("hbsag")]), 0.9),
        (r, "肝臟疾病", hbv, lit("B型肝炎帶原"), 0.7),
        (c, "慢性腎臟病", ckd, _join([_shown("egfr")]), 0.8),
        (r, "腎衰竭", ckd, lit("腎絲球過濾率下降"), 0.6),
        (r, "慢性腎臟病", ~ckd & _is("creatinine", "high"), lit("肌酸酐偏高"), 0.6),
        (c, "蛋白尿", protein, _join([_shown("urine_protein")]), 0.85),
        (r, "慢性腎臟病", protein, lit("蛋白尿"), 0.6),
        (c, "尿糖陽性", _is("urine_glucose", "positive", "high"), _join([_shown("urine_glucose")]), 0.85),
        (c, "尿潛血", _is("urine_ob", "positive", "high"), _join([_shown("urine_ob")]), 0.8),
        (c, "小球性貧血", small, _join([_shown("hb"), _shown("mcv")]), 0.9),
        (r, "缺鐵性貧血", small, lit("小球性貧血"), 0.6),
        (c, "貧血", anaemia, _join([_shown("hb")]), 0.9),
        (c, "甲狀腺功能低下", tsh_up & t4_low, _join([_shown("tsh"), t4_shown]), 0.8),
        (c, "亞臨床甲狀腺功能低下", tsh_up & ~t4_low, _join([_shown("tsh")]), 0.75),
        (r, "甲狀腺功能低下", tsh_up & ~t4_low, lit("甲狀腺刺激素偏高"), 0.6),
        (c, "甲狀腺功能亢進", _is("tsh", "low"), _join([_shown("tsh"), t4_shown]), 0.7),
        (c, "腫瘤標記偏高", some_marker, _join([_shown(k, m) for k, m in zip(MARKERS, marker)]), 0.8),
        (r, "心血管疾病", _is("hs_crp", "high") | _is("homocysteine", "high"), lit("發炎指數或同半胱胺酸偏高"), 0.7),
    ]


def derive(findings: DataFrame) -> DataFrame:
    """``(report_id, category, pos, text, src, conf, evidence)``: one row per condition or risk of a report."""
    wide = metabolic(pivot(findings))
    fired = [
        F.when(when, F.struct(F.lit(kind).alias("category"), F.lit(i).alias("pos"), F.lit(text).alias("text"), F.lit("rule").alias("src"), F.lit(conf).alias("conf"), ev.alias("evidence")))
        for i, (kind, text, when, ev, conf) in enumerate(_rules())
    ]
    tags = wide.select("report_id", F.explode(F.array_compact(F.array(*fired))).alias("t")).select("report_id", "t.*")
    first = Window.partitionBy("report_id", "category", "text").orderBy("pos")
    return tags.where("category = 'risk' or evidence <> ''").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def merge_tags(rule_tags: Column, other_tags: Column, limit: int = 8) -> Column:
    """Rule tags first, then the others that neither hold nor are held by a kept text; an ordered fold."""
    clash = lambda kept, t: F.exists(kept, lambda k: F.contains(k["text"], t["text"]) | F.contains(t["text"], k["text"]))
    merged = F.aggregate(other_tags, rule_tags, lambda kept, t: F.when(clash(kept, t), kept).otherwise(F.concat(kept, F.array(t))))
    return F.slice(merged, 1, limit)


def metric_tags(findings: DataFrame) -> DataFrame:
    """One tag per abnormal finding: name, value, unit and an arrow."""
    arrow = F.when(F.col("direction") == "high", "↑").otherwise("↓")
    text = F.concat(F.concat_ws(" ", "display", "value_text", F.nullif(F.col("unit"), F.lit(""))), F.lit(" "), arrow)
    x = findings.where(F.col("direction").isin("high", "low"))
    return x.select("report_id", F.lit("metric").alias("category"), "pos", text.alias("text"), F.lit("report").alias("src"), F.lit(1.0).alias("conf"))
