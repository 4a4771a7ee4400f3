"""Records to findings: status by range, sex, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import catalog

EPS = 1e-9


def status(v: Column, r: Column, factor: Column | None = None, cut_is_negative: Column | None = None) -> Column:
    """Status of a parsed value ``v`` against one range ``r``; null where the range can't judge it.

    A censored value (``<x``, ``>x``) has a status only if every value it stands for has the same one.
    """
    below, above, ranged = v["op"].isin("<", "<="), v["op"].isin(">", ">="), r["kind"].isin("range", "upper", "lower")
    x = v["v"] * (F.lit(1.0) if factor is None else factor)
    # a number printed with a grade is judged as plain
    below, above = below & (v["kind"] == "num"), above & (v["kind"] == "num")
    lo, hi = r["lo"], r["hi"]
    is_low = (r["kind"] != "upper") & F.when(r["lo_strict"], x <= lo + EPS).otherwise(x < lo - EPS)
    is_high = (r["kind"] != "lower") & F.when(r["hi_strict"], x >= hi - EPS).otherwise(x > hi + EPS)
    numeric = (
        F.when(~ranged, F.lit(None).cast("string"))
        .when(below & (r["kind"] == "range"), F.when((x <= lo + EPS) & (lo > 0), "low").when(x <= hi + EPS, "normal"))
        .when(below & (r["kind"] == "upper"), F.when(x <= hi + EPS, "normal"))
        .when(below, F.when(x <= lo + EPS, "low"))
        .when(above & (r["kind"] == "lower"), F.when(x >= lo - EPS, "normal"))
        .when(above, F.when(x >= hi - EPS, "high"))
        .when(is_low, "low")
        .when(is_high, "high")
        .otherwise("normal")
    )
    against_negative = F.when(below, "normal").when((x > EPS) | above, "high").otherwise("normal")
    expected = r["kind"].isin("qual_neg", "unit_only")
    negative = F.lit(False) if cut_is_negative is None else cut_is_negative
    return (
        F.when(r["kind"].isNull() | (r["kind"] == "none"), F.lit(None).cast("string"))
        .when((v["kind"] == "num") & (r["kind"] == "qual_neg"), against_negative)
        .when((v["kind"] == "num") | ((v["kind"] == "pos") & v["v"].isNotNull() & ranged), numeric)
        .when(v["kind"] == "pos", F.when(expected | negative, "positive"))
        .when(v["kind"].isin("neg", "trace") & (expected | (r["kind"] == "upper") | ((r["kind"] == "range") & (lo <= 0))), "negative")
    )


def combine(m: Column, f: Column) -> Column:
    """Sex unknown: abnormal only outside both ranges, and then only if both say the same."""
    return F.when(m.eqNullSafe(f), m).when(m.isNull() | f.isNull(), None).when((m == "normal") | (f == "normal"), "normal")


def by_sex(v: Column, m: Column, f: Column, sex: Column, factor: Column | None = None, cut: Column | None = None) -> Column:
    both = F.struct(status(v, m, factor, cut).alias("m"), status(v, f, factor, cut).alias("f"))
    return T.let(both, lambda x: F.when(sex == "M", x["m"]).when(sex == "F", x["f"]).otherwise(combine(x["m"], x["f"])))


def direction(s: Column) -> Column:
    return F.when(s.isin("high", "positive"), "high").when(s == "low", "low").when(s.isin("normal", "negative"), "normal").otherwise("unknown")


def is_abnormal(d: Column) -> Column:
    return d.isin("high", "low")


def parsed(records: DataFrame, value: str = "value_text", ref: str = "ref_text") -> DataFrame:
    """``records`` with ``v`` and ``r``: the printed value and range as structs."""
    v = T.made_once(f"value {value}", lambda: T.value(F.col(value)))
    r = T.made_once(f"reference {ref}", lambda: T.reference(F.col(ref)))
    return records.withColumns({"v": v, "r": r})


def classify(records: DataFrame) -> DataFrame:
    """Status of each record ``(v, r, sex, unit, item)``: printed range, then reference range, then printed flag.

    Adds status, direction, range_source, report_status, kb_status, range_conflict, unit_ok and sex_unknown.
    """
    spark = records.sparkSession
    known = catalog.range_table(spark).withColumnsRenamed({"m": "kb_m", "f": "kb_f"})
    items = catalog.item_table(spark).select("item", "item_unit", "by_sex", "expect_negative", "protective")
    x = records.join(F.broadcast(items), "item", "left").join(F.broadcast(known), "item", "left")
    x = x.withColumn("unit", F.coalesce(F.nullif(F.col("unit"), F.lit("")), F.nullif(F.col("v.unit"), F.lit("")), F.col("r.m.unit")))
    x = catalog.unit_factor(x)
    for step in T.made_once("classify", _judgements):
        x = x.withColumns(step)
    return x.drop("kb_m", "kb_f", "item_unit", "by_sex", "expect_negative", "protective")


def _judgements() -> list[dict[str, Column]]:
    """The columns that classify adds, in steps that build on each other."""
    v, r, sex = F.col("v"), F.col("r"), F.col("sex")
    quality = v["kind"].isin("pos", "neg", "trace")
    numeric_kb = F.coalesce(F.col("kb_m.kind").isin("range", "upper", "lower"), F.lit(False))
    usable = (r["kind"] != "none") & ((r["kind"] != "unit_only") | quality)
    # a bare "negative" beside a number is the lab's reading of it, not a limit, where the item has limits
    usable = usable & ~((r["kind"] == "qual_neg") & (v["kind"] == "num") & numeric_kb)
    report = F.when(usable, by_sex(v, r["m"], r["f"], sex, cut=r["qual_neg"]))
    factor = F.when(v["kind"].isin("num", "pos"), F.col("factor")).otherwise(1.0)
    ranged = by_sex(v, F.col("kb_m"), F.col("kb_f"), sex, factor)
    expected = F.when(v["kind"] == "pos", "positive").otherwise("negative")
    kb = F.when(quality & F.col("expect_negative"), expected).when((F.col("kb_m.kind") == "qual_neg") & ~quality, None).when(factor.isNotNull(), ranged)
    flag = F.when((v["kind"] == "num") & v["flag"].isin("H", "L"), F.when(v["flag"] == "H", "high").otherwise("low"))
    mild = lambda s: F.when(F.coalesce(F.col("protective"), F.lit(False)) & s.isin("high", "positive"), "normal").otherwise(s)
    source = F.when(F.col("report_status").isNotNull(), "report").when(F.col("kb_status").isNotNull(), "reference").when(flag.isNotNull(), "report_flag")
    both = F.col("report_status").isNotNull() & F.col("kb_status").isNotNull()
    split = F.when(F.col("report_status").isNotNull(), r["kind"] == "sex").otherwise(F.coalesce("by_sex", F.lit(False)))
    return [
        {"report_status": report, "kb_status": kb},
        {"status": mild(F.coalesce("report_status", "kb_status", flag, F.lit("unknown"))), "kb_status": mild(F.col("kb_status")), "range_source": source},
        {
            "direction": direction(F.col("status")),
            "range_conflict": both & (direction(F.col("report_status")) != direction(F.col("kb_status"))),
            "unit_ok": F.col("factor").isNotNull(),
            "sex_unknown": sex.isNull() & split,
        },
    ]


def signature(v: Column) -> Column:
    """Equal for values that are the same result."""
    return F.when(v["kind"] == "num", F.concat(F.lit("n"), v["op"], T.number_text(F.round(v["v"], 6)))).otherwise(F.concat(v["kind"], F.coalesce(v["grade"], F.lit(""))))


def dedupe(findings: DataFrame) -> DataFrame:
    """One row per distinct value of an item in a report: tables before text, then in order; ``duplicate`` marks items that keep several."""
    x = findings.withColumn("sig", signature(F.col("v")))
    group = Window.partitionBy("report_id", "item")
    first = Window.partitionBy("report_id", "item", "sig").orderBy(F.when(F.col("source") == "table", 0).otherwise(1), "pos")
    x = x.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return x.withColumn("n_values", F.count("*").over(group)).withColumn("duplicate", F.col("n_values") > 1)


def merge_readings(findings: DataFrame) -> DataFrame:
    """One numeric result and a qualitative one that does not contradict it become one row with ``qualitative_result``."""
    key = ["report_id", "item"]
    kind = F.col("v.kind")
    per = findings.groupBy(*key).agg(
        F.count_if(kind == "num").alias("nums"), F.max(F.when(kind == "num", F.col("direction"))).alias("num_dir"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kind.isin("pos", "neg", "trace"), F.struct("pos", F.col("v.text").alias("t"))))), lambda s: s["t"]), ", ").alias("said"),
        F.bool_and(F.when(kind.isin("pos", "neg", "trace"), (kind == "pos") == (F.col("direction") == "high"))).alias("sane"),
        F.max(F.when(kind.isin("pos", "neg", "trace"), F.col("direction"))).alias("said_dir"),
    )
    merge = (F.col("nums") == 1) & (F.col("said") != "") & (F.col("num_dir") == F.col("said_dir"))
    x = findings.join(per.select(*key, merge.alias("__merge"), "said"), key)
    x = x.where(~F.col("__merge") | (F.col("v.kind") == "num"))
    return x.withColumn("qualitative_result", F.when(F.col("__merge"), F.col("said"))).drop("__merge", "said")


def sex_votes(records: DataFrame) -> DataFrame:
    """``(report_id, votes_m, votes_f, sex_inferred)``: printed ranges of items with a range per sex vote for the nearer one.

    A bound votes if it is nearer to one sex and within a quarter of it; all differing bounds must agree.
    Two votes and none against decide.
    """
    spark = records.sparkSession
    split = catalog.range_table(spark).join(catalog.item_table(spark).where("by_sex").select("item"), "item")
    x = records.join(F.broadcast(split.withColumnsRenamed({"m": "km", "f": "kf"})), "item").where(F.col("r.kind").isin("range", "upper", "lower"))

    def side(b: str) -> Column:
        p, m, f = F.col(f"r.m.{b}"), F.col(f"km.{b}"), F.col(f"kf.{b}")
        dm, df = F.abs(p - m), F.abs(p - f)
        vote = F.when((dm < df) & (dm <= 0.25 * F.abs(m)), 1).when((df < dm) & (df <= 0.25 * F.abs(f)), -1).otherwise(9)
        return F.when(p.isNull() | m.isNull() | f.isNull() | (m == f), 0).otherwise(vote)

    lo, hi = side("lo"), side("hi")
    vote = F.when((lo == 9) | (hi == 9) | (lo * hi == -1), 0).otherwise(F.signum((lo + hi).cast("double")).cast("int"))
    votes = x.select("report_id", vote.alias("vote")).groupBy("report_id").agg(F.count_if(F.col("vote") == 1).alias("votes_m"), F.count_if(F.col("vote") == -1).alias("votes_f"))
    got = F.when((F.col("votes_m") >= 2) & (F.col("votes_f") == 0), "M").when((F.col("votes_f") >= 2) & (F.col("votes_m") == 0), "F")
    return votes.withColumn("sex_inferred", got)


def evaluate(records: DataFrame, header_sex: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Records ``(report_id, pos, name, value_text, unit, ref_text, source[, sex])`` to findings, and the names that met no item."""
    x = parsed(catalog.resolve(records))
    unmatched = x.where("item is null").select("report_id", "pos", "name")
    x = x.where("item is not null")
    votes = sex_votes(x).select("report_id", "sex_inferred")
    given = F.col("sex") if "sex" in records.columns else F.lit(None).cast("string")
    if header_sex is not None:
        x = x.join(header_sex.select("report_id", F.col("sex").alias("__header")), "report_id", "left")
    header = F.col("__header") if header_sex is not None else F.lit(None).cast("string")
    x = x.join(votes, "report_id", "left")
    source = F.when(given.isNotNull(), "given").when(header.isNotNull(), "header").when(F.col("sex_inferred").isNotNull(), "ranges").otherwise("unknown")
    x = x.withColumn("sex_source", source).withColumn("sex", F.coalesce(given, header, F.col("sex_inferred")))
    return merge_readings(dedupe(classify(x.drop("__header", "sex_inferred")))), unmatched
