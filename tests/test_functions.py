"""Printed values, ranges, names and units: table-driven, nulls and odd texts included."""

import hashlib
import hmac
import unicodedata

import pytest
from pyspark.sql import functions as F

from assayframe.functions import text as T
from assayframe.operators import catalog, extract, findings

def ranges():
    """(value, reference, sex, expected direction), built from the rules that printed ranges follow."""
    out = []
    for bound in (6, 84, 210):
        for sign, strict in (("<", True), ("≦", False)):
            ref = f"({sign}{bound} IU/L)"
            out += [(f"{bound - 0.5}", ref, None, "normal"), (f"{bound}", ref, None, "high" if strict else "normal"), (f"{bound + 0.5}", ref, None, "high")]
        for sign, strict in ((">", True), ("≧", False)):
            ref = f"({sign}{bound}ug/dL)"
            out += [(f"{bound + 1}", ref, None, "normal"), (f"{bound}", ref, None, "low" if strict else "normal"), (f"{bound - 1}", ref, None, "low")]
    for lo, hi, dash in ((2.5, 6.5, "~"), (11, 19, "～"), (30, 45, "-"), (-3, 2, "～"), (105, 180, " - ")):
        ref = f"({lo}{dash}{hi} mmol/L)" if lo >= 0 else f"({lo}{dash}{hi} )"
        out += [(f"{lo - 0.5}", ref, None, "low"), (f"{lo}", ref, None, "normal"), (f"{hi}", ref, None, "normal"), (f"{hi + 0.25}", ref, None, "high")]
    for m, f in (((45, 95), (30, 70)), ((8, 12), (6, 10))):
        for ref in (f"男:{m[0]}-{m[1]} 女:{f[0]}-{f[1]} U/L", f"男 {m[0]}~{m[1]} / 女 {f[0]}~{f[1]} U/L"):
            mid = (f[1] + m[1]) / 2  # high for a woman only
            out += [(f"{mid}", ref, "F", "high"), (f"{mid}", ref, "M", "normal"), (f"{mid}", ref, None, "normal"), (f"{m[1] + 1}", ref, None, "high"), (f"{f[0] - 1}", ref, None, "low")]
    for ref in ("陰性", "(-)", "Negative", "(neg)"):
        out += [("陰性", ref, None, "normal"), ("negative", ref, None, "normal"), ("-", ref, None, "normal"), ("陽性", ref, None, "high"), ("2+", ref, None, "high"), ("+", ref, None, "high"), ("trace", ref, None, "normal")]
    out += [("12", "(neg)", None, "high"), (">=250(2+)", "(g/L)", None, "high"), ("±", "(-～- (+/-))", None, "normal")]
    # a censored value has a direction only if all that it stands for has it
    out += [("<0.2", "(1.5～4 pg/mL)", None, "low"), ("<3", "(0～9 pg/mL)", None, "normal"), (">60", "20~75", None, "unknown"), (">80", "20~75", None, "high")]
    out += [("０.６", "０．２～０．９", None, "normal"), ("n/a", "20~75", None, "unknown"), (None, "20~75", None, "unknown"), ("31", None, None, "unknown"), ("31", "9 - 4", None, "unknown")]
    return out


RANGES = ranges()


def test_ranges(spark):
    rows = [(i, v, r, s) for i, (v, r, s, _) in enumerate(RANGES)]
    x = findings.parsed(spark.createDataFrame(rows, "i int, value_text string, ref_text string, sex string"))
    got = x.select("i", findings.direction(findings.by_sex(F.col("v"), F.col("r.m"), F.col("r.f"), F.col("sex"), cut=F.col("r.qual_neg"))).alias("d")).collect()
    wrong = [(RANGES[r.i], r.d) for r in got if r.d != RANGES[r.i][3]]
    assert not wrong


VALUES = [
    ("225 H", "num", 225.0, "H"), ("1.2↑", "num", 1.2, "H"), ("* 7.5 L *", "num", 7.5, "*"), ("1,234.5", "num", 1234.5, ""), ("5%", "num", 5.0, ""), ("nonreactive", "neg", None, ""),
    ("Calcium Oxalate 2+", "pos", None, ""), ("HH", "text", None, ""), ("", "text", None, ""), ("０．３", "num", 0.3, ""), ("≦5", "num", 5.0, ""),
]


def test_values(spark):
    x = spark.createDataFrame([(i, v[0]) for i, v in enumerate(VALUES)], "i int, s string").select("i", T.value(F.col("s")).alias("v")).collect()
    assert [(VALUES[r.i][0], r.v.kind, r.v.v, r.v.flag) for r in sorted(x)] == VALUES


def one(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", column(F.col("s")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_scalars(spark):
    assert one(spark, T.unit_key, "MG/dL", "x10^3/uL", "10*6/µL", "IU/L", "mm-Hg", "mg%", None) == ["mg/dl", "10^3/ul", "10^6/ul", "u/l", "mmhg", "mg/dl", ""]
    assert one(spark, T.name_key, "(Ｕric-Acid)", "鹼性磷酸脢", "A/G [ratio]") == ["uricacid", "鹼性磷酸酶", "a/g(ratio)"]
    assert one(spark, T.sex_of, "性別：男", "Gender: Female", "none", None) == ["M", "F", None, None]
    assert [str(x) for x in one(spark, T.exam_date, "出生日期 070/01/02 檢查日期：113/01/05", "報告日期:2024-03-01", "檢查日期: 113/13/40")] == ["2024-01-05", "2024-03-01", "None"]
    assert one(spark, T.csv_cell, "=1", "-1", "ok", None) == ["'=1", "'-1", "ok", None]
    assert one(spark, T.nfkc, "Ａ　１µ", None) == [unicodedata.normalize("NFKC", "A 1µ"), None]
    assert one(spark, T.markup_rows, "<table><tr><th>項目</th><td> 5 </td></tr></table>\n| a | b |\n|---|---|\n| 1 | 2 |") == [[["項目", "5"], ["a", "b"], ["1", "2"]]]
    assert one(spark, lambda c: T.hmac_sha256("salt", c), "x", "病人") == [hmac.new(b"salt", t.encode(), hashlib.sha256).hexdigest() for t in ("x", "病人")]
    assert one(spark, extract.clean_ocr, "7 · 4", "5·6", "a &lt; 3", None) == ["7.4", "5.6", "a < 3", None]


def test_number_text(spark):
    got = spark.createDataFrame([(5.8,), (10.0,), (0.3,), (None,)], "x double").select(T.number_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == ["5.8", "10", "0.3", None]


NAMES = [
    ("LDL低密度脂蛋白", "ldl"), ("HDL-C", "hdl"), ("總膽固醇Cholesterol", "chol"), ("Uric Acid尿酸", "uric_acid"), ("T-BILI總膽紅素", "bil_total"), ("AC sugar飯前血糖", "glucose_ac"),
    ("BUN 尿素氮", "bun"), ("Creatinine 肌酸酐", "creatinine"), ("AST(GOT)", "ast"), ("血紅素 (Hb)", "hb"), ("鉀", "potassium"), ("HS-CRP高敏感度C反應蛋白", "hs_crp"),
    ("檢查日期", None), ("姓名", None), (None, None), ("", None), ("LDL HDL", None),
]


def test_resolve(spark):
    x = catalog.resolve(spark.createDataFrame([(i, n[0]) for i, n in enumerate(NAMES)], "pos int, name string")).collect()
    assert {NAMES[r.pos][0]: r.item for r in x} == dict(NAMES) and len(x) == len(NAMES)
    assert catalog.alias_collisions(spark).count() == 0


LINES = [
    ("HDL高密度脂蛋白 33 (>45mg/dL)", [("HDL高密度脂蛋白", "33", "(>45mg/dL)")]), ("PC sugar飯後血糖： 161 正常值 (80～140 mg/dL)", [("PC sugar飯後血糖", "161", "(80~140 mg/dL)")]),
    ("＊D-BILI直接膽紅素： 0.6↑ 參考值 (0.0～0.4 mg/dL)", [("D-BILI直接膽紅素", "0.6 ↑", "(0.0~0.4 mg/dL)")]), ("BP: 117/74", [("收縮壓", "117", ""), ("舒張壓", "74", "")]),
    ("Sodium 139 mmol/L", [("Sodium", "139", "")]), ("血球容積比 Hct： 51.2 % 參考值 38～49", [("血球容積比 Hct", "51.2", "38~49")]), ("列印日期 2023-11-30", []), ("y" * 500, []),
]


@pytest.mark.parametrize("line, want", LINES)
def test_lines(line, want):
    assert [(n, v, r) for n, v, _, r in extract.from_line(line)] == want


def test_tables():
    head = [["編號", "檢驗項目", "檢驗結果", "單位", "參考範圍"], ["7", "GGT", "83", "IU/L", "9-48"]]
    assert extract.from_table(head) == [("GGT", "83", "IU/L", "9-48")]
    assert extract.from_table([["item", "result", "item", "result"], ["LDH", "201", "CK", "64"]]) == [("LDH", "201", "", ""), ("CK", "64", "", "")]
    assert extract.from_table([["尿膽素原", "2(2+)", "(EU/dL)"]]) == [("尿膽素原", "2(2+)", "", "(EU/dL)")]
    assert extract.from_table([["Phosphorus 磷", "5.1", "mg/dL", "2.4～4.7"]]) == [("Phosphorus 磷", "5.1", "mg/dL", "2.4~4.7")]
    assert extract.from_table([]) == [] and extract.from_table([[None, ""]]) == []


def test_protective_antibody_is_not_abnormal(spark):
    x = spark.createDataFrame([(0, "anti_hbs", "88.0", "(<12 IU/L)", "IU/L"), (1, "ldl", "188.0", "(<120 mg/dL)", "mg/dL")], "pos int, item string, value_text string, ref_text string, unit string").withColumn("sex", F.lit(None).cast("string"))
    assert {r.item: r.status for r in findings.classify(findings.parsed(x)).collect()} == {"anti_hbs": "normal", "ldl": "high"}
