"""The laboratory catalogue as dimension tables, and name resolution as tiered equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values, one item a line: key | names | unit | low~high, or M low~high F low~high, or neg | unit=factor ... | marks
# An open side is left empty. The first two names are the Chinese and the English one.
ITEMS = """
glucose_ac | 空腹血糖, Fasting glucose, AC sugar, Glucose AC, 飯前血糖, Glucose, 血糖 | mg/dL | 70~100 | mmol/L=18 |
hba1c | 醣化血色素, HbA1c, 糖化血色素, Hemoglobin A1c | % | 4~5.6 | |
ldl | 低密度脂蛋白, LDL, LDL-C, 低密度脂蛋白膽固醇, LDL-Cholesterol | mg/dL | ~130 | mmol/L=38.67 | over chol
hdl | 高密度脂蛋白, HDL, HDL-C, 高密度脂蛋白膽固醇, HDL-Cholesterol | mg/dL | 40~ | mmol/L=38.67 | over chol
chol | 總膽固醇, Total cholesterol, Cholesterol, 膽固醇, T-CHO | mg/dL | ~200 | mmol/L=38.67 |
tg | 三酸甘油脂, Triglyceride, TG, 三酸甘油酯, 中性脂肪 | mg/dL | ~150 | mmol/L=88.57 |
hb | 血紅素, Hemoglobin, Hb, HGB, 血色素 | g/dL | M 13.5~17.5 F 12~16 | g/L=0.1 |
hct | 血球容積比, Hematocrit, Hct | % | M 40~52 F 36~48 | |
rbc | 紅血球, RBC, 紅血球數, Red blood cell | 10^6/uL | M 4.5~5.9 F 4~5.2 | |
wbc | 白血球, WBC, 白血球數, White blood cell | 10^3/uL | 4~11 | |
platelet | 血小板, Platelet, PLT, 血小板數 | 10^3/uL | 150~400 | |
mcv | 平均紅血球容積, MCV | fL | 80~100 | |
mch | 平均紅血球血紅素, MCH | pg | 26~34 | |
uric_acid | 尿酸, Uric acid, UA | mg/dL | M 3.5~7.2 F 2.6~6 | umol/L=0.0168 |
bun | 尿素氮, BUN, 血中尿素氮 | mg/dL | 7~25 | mmol/L=2.8 |
creatinine | 肌酸酐, Creatinine, Crea, CRE | mg/dL | M 0.7~1.3 F 0.6~1.1 | umol/L=0.0113 |
egfr | 腎絲球過濾率, eGFR, 估算腎絲球過濾率 | mL/min/1.73m2 | 60~ | |
ast | 麩草酸轉氨酶, AST, GOT, SGOT, AST(GOT) | U/L | ~40 | |
alt | 麩丙酮酸轉氨酶, ALT, GPT, SGPT, ALT(GPT) | U/L | ~41 | |
ggt | 丙麩氨轉肽酶, GGT, r-GT, γ-GT | U/L | M ~60 F ~40 | |
alp | 鹼性磷酸酶, ALP, Alk-P | U/L | 34~104 | |
ldh | 乳酸脫氫酶, LDH | U/L | 140~271 | |
bil_total | 總膽紅素, Total bilirubin, T-BIL, T-BILI, 膽紅素 | mg/dL | 0.3~1.2 | umol/L=0.0585 |
albumin | 白蛋白, Albumin, ALB | g/dL | 3.5~5.2 | g/L=0.1 |
total_protein | 總蛋白, Total protein, TP | g/dL | 6.4~8.3 | g/L=0.1 |
sodium | 鈉, Sodium, Na | mEq/L | 136~145 | mmol/L=1 |
potassium | 鉀, Potassium, K | mEq/L | 3.5~5.1 | mmol/L=1 |
calcium | 鈣, Calcium, Ca | mg/dL | 8.6~10.3 | mmol/L=4.008 |
tsh | 甲狀腺刺激素, TSH, 促甲狀腺激素 | uIU/mL | 0.4~4 | mIU/L=1 |
free_t4 | 游離甲狀腺素, Free T4, FT4 | ng/dL | 0.7~1.8 | pmol/L=0.0777 |
t4 | 甲狀腺素, T4 | ug/dL | 5~12 | | under free_t4
afp | 甲型胎兒蛋白, AFP, α-Fetoprotein | ng/mL | ~9 | |
cea | 癌胚抗原, CEA | ng/mL | ~5 | |
ca199 | 醣類抗原199, CA19-9, CA199 | U/mL | ~35 | |
ca125 | 醣類抗原125, CA125, CA-125 | U/mL | ~35 | |
ca153 | 醣類抗原153, CA15-3, CA153 | U/mL | ~25 | |
psa | 攝護腺特異抗原, PSA | ng/mL | ~4 | |
hs_crp | 高敏感度C反應蛋白, hs-CRP, HS-CRP | mg/dL | ~0.3 | mg/L=0.1 |
homocysteine | 同半胱氨酸, Homocysteine | umol/L | 5~15 | |
sbp | 收縮壓, Systolic BP, SBP, Systolic B.P. | mmHg | 90~120 | |
dbp | 舒張壓, Diastolic BP, DBP, Diastolic B.P. | mmHg | 60~80 | |
bmi | 身體質量指數, BMI | kg/m2 | 18.5~24 | |
waist | 腰圍, Waist | cm | M ~90 F ~80 | |
hbsag | B型肝炎表面抗原, HBsAg | COI | neg | |
anti_hbs | B型肝炎表面抗體, Anti-HBs | IU/L | ~10 | mIU/mL=1 | protective
urine_protein | 尿蛋白, Urine protein | | neg | |
urine_glucose | 尿糖, Urine glucose | | neg | |
urine_ob | 尿潛血, Urine occult blood | | neg | |
"""


def rows() -> list[dict]:
    """The catalogue as plain rows."""
    out = []
    for line in ITEMS.strip().splitlines():
        key, names, unit, ranges, factors, marks = (x.strip() for x in line.split("|"))
        names = [n.strip() for n in names.split(",")]
        words = ranges.split()
        both = {w: words[words.index(w) + 1] for w in "MF" if w in words} or ({"M": ranges, "F": ranges} if "~" in ranges else {})
        bound = lambda s, i: float(x) if (x := both[s].split("~")[i]) else None
        out.append(
            {
                "key": key, "zh": names[0], "en": names[1], "names": names, "unit": unit, "by_sex": "M" in words,
                "ranges": [(s, bound(s, 0), bound(s, 1)) for s in both], "negative": ranges == "neg",
                "factors": [(u, float(f)) for u, f in (x.split("=") for x in factors.split())],
                "over": marks.split()[1:] if marks.startswith("over") else [], "protective": marks == "protective",
            }
        )
    return out


def item_table(spark: SparkSession) -> DataFrame:
    data = [(r["key"], r["zh"], r["en"], r["unit"], r["by_sex"], r["negative"], r["protective"]) for r in rows()]
    return spark.createDataFrame(data, "item string, zh string, en string, item_unit string, by_sex boolean, expect_negative boolean, protective boolean")


def alias_table(spark: SparkSession) -> DataFrame:
    """``(alias_key, item)``: every name and the key itself; an alias may lead to several items."""
    data = [(n, r["key"]) for r in rows() for n in [*r["names"], r["key"]]]
    return spark.createDataFrame(data, "name string, item string").select(T.name_key(F.col("name")).alias("alias_key"), "item").distinct()


def alias_collisions(spark: SparkSession) -> DataFrame:
    found = alias_table(spark).groupBy("alias_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return found.where(F.size("items") > 1)


def unit_table(spark: SparkSession) -> DataFrame:
    """``(item, unit_key, factor)``: the item's own unit has factor 1."""
    data = [(r["key"], u, f) for r in rows() for u, f in [(r["unit"], 1.0), *r["factors"]] if u]
    return spark.createDataFrame(data, "item string, unit string, factor double").select("item", T.unit_key(F.col("unit")).alias("unit_key"), "factor").distinct()


def range_table(spark: SparkSession) -> DataFrame:
    """``(item, m, f)``: the reference range of either sex in the shape of printed ones."""
    kind = "struct<kind:string,lo:double,hi:double,lo_strict:boolean,hi_strict:boolean,unit:string>"
    data = []
    for r in rows():
        if r["ranges"]:
            spec = {s: ("range" if lo is not None and hi is not None else "upper" if lo is None else "lower", lo, hi, False, False, r["unit"]) for s, lo, hi in r["ranges"]}
            data.append((r["key"], spec["M"], spec["F"]))
        elif r["negative"]:
            spec = ("qual_neg", None, None, False, False, "")
            data.append((r["key"], spec, spec))
    return spark.createDataFrame(data, f"item string, m {kind}, f {kind}")


def over_table(spark: SparkSession) -> DataFrame:
    data = [(r["key"], o) for r in rows() for o in r["over"]]
    return spark.createDataFrame(data, "item string, dominated string")


def candidates(name: Column) -> Column:
    """``array<struct<tier, alias_key>>``: the whole name, then without brackets, then its scripts and words, then bracket content."""
    s = T.fold(name)
    outer = F.trim(F.regexp_replace(s, r"\([^()]*\)", " "))
    inner = F.regexp_extract_all(s, F.lit(r"\(([^()]+)\)"), 1)
    cjk = F.regexp_extract_all(outer, F.lit(r"([A-Za-z]?[㐀-鿿]+)"), 1)
    latin = F.regexp_extract_all(outer, F.lit(r"([A-Za-zα-ω][A-Za-z0-9α-ω .\-]*)"), 1)
    words = F.filter(F.split(outer, r"[\s:/]+"), lambda x: F.length(x) > 1)
    tier = lambda n, xs: F.transform(xs, lambda x: F.struct(F.lit(n).alias("tier"), T.name_key(x).alias("alias_key")))
    every = F.concat(tier(0, F.array(s)), tier(1, F.array(outer)), tier(2, F.concat(cjk, latin)), tier(3, F.concat(words, inner)))
    return F.array_distinct(F.filter(every, lambda x: x["alias_key"] != ""))


def resolve(records: DataFrame, name: str = "name", key: str = "pos") -> DataFrame:
    """``records`` with ``item``: null where no item, or more than one, is meant; never a guess.

    The first tier with a hit decides. Items that a more specific one dominates step back.
    """
    spark = records.sparkSession
    names = records.select(F.col(name).alias("__name")).distinct()
    tried = names.select("__name", F.explode(candidates(F.col("__name"))).alias("c")).select("__name", "c.tier", "c.alias_key")
    hits = tried.join(F.broadcast(alias_table(spark)), "alias_key").select("__name", "tier", "item").distinct()
    best = hits.groupBy("__name").agg(F.min_by("item", "tier").alias("any"), F.min("tier").alias("tier"))
    top = hits.join(best.select("__name", "tier"), ["__name", "tier"])
    beaten = top.join(F.broadcast(over_table(spark)), "item").select("__name", F.col("dominated").alias("item"))
    left = top.join(beaten, ["__name", "item"], "left_anti")
    sure = left.groupBy("__name").agg(F.collect_set("item").alias("items")).where(F.size("items") == 1).select("__name", F.get("items", F.lit(0)).alias("item"))
    return records.join(sure, records[name].eqNullSafe(sure["__name"]), "left").drop("__name")


def unit_factor(records: DataFrame, item: str = "item", unit: str = "unit") -> DataFrame:
    """``records`` with ``factor``: 1 for the item's or no unit, the conversion for a known one, null for another."""
    units = unit_table(records.sparkSession).select(F.col("item").alias("__item"), "unit_key", F.col("factor").alias("__factor"))
    keyed = records.withColumn("__key", T.unit_key(F.col(unit)))
    joined = keyed.join(F.broadcast(units), (keyed[item] == units["__item"]) & (keyed["__key"] == units["unit_key"]), "left")
    return joined.withColumn("factor", F.when(F.col("__key") == "", 1.0).otherwise(F.col("__factor"))).drop("__key", "__item", "unit_key", "__factor")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
