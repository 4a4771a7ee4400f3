"""Findings as FHIR observations and bundles."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

# LOINC codes of common items (public code system).
LOINC = {
    "glucose_ac": "1558-6", "hba1c": "4548-4", "ldl": "2089-1", "hdl": "2085-9", "chol": "2093-3", "tg": "2571-8", "hb": "718-7",
    "hct": "4544-3", "wbc": "6690-2", "platelet": "777-3", "uric_acid": "3084-1", "bun": "3094-0", "creatinine": "2160-0", "ast": "1920-8",
    "alt": "1742-6", "tsh": "3016-3", "sodium": "2951-2", "potassium": "2823-3", "sbp": "8480-6", "dbp": "8462-4", "bmi": "39156-5",
}
MASS = ("mg/dl", "g/dl", "ng/ml", "pg/ml", "ug/dl", "ng/dl", "g/l")
AMOUNT = ("mmol/l", "umol/l", "meq/l", "pmol/l")


@F.pandas_udf(StringType())
def stable_uuid(s: pd.Series) -> pd.Series:
    """Name-based UUID (no built-in makes one)."""
    return s.map(lambda x: None if x is None else "urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, x)))


def unit_class(unit: Column) -> Column:
    k = T.unit_key(unit)
    return F.when(k.isin(*MASS), "mass").when(k.isin(*AMOUNT), "amount").when(k == "%", "share").when(k.isin("u/l", "iu/ml", "u/ml"), "activity").otherwise("other")


# Code systems and codes of the standard, and items by kind of observation.
SYSTEMS = {
    "loinc": "http://loinc.org", "ucum": "http://unitsofmeasure.org", "category": "http://terminology.hl7.org/CodeSystem/observation-category",
    "report": "http://terminology.hl7.org/CodeSystem/v2-0074", "interpretation": "http://terminology.hl7.org/CodeSystem/v3-ObservationInterpretation",
    "absent": "http://terminology.hl7.org/CodeSystem/data-absent-reason",
}
VITAL = ("height", "weight", "bmi", "waist", "sbp", "dbp", "pulse", "temperature")
EXAM = ("body_fat_pct", "bone_mass", "bmr", "visceral_fat", "body_water", "ideal_weight", "muscle_mass", "bmd", "va_naked_right", "va_naked_left", "va_corr_right", "va_corr_left", "iop_right", "iop_left")
MARKS = {"high": ("H", "High"), "low": ("L", "Low"), "normal": ("N", "Normal"), "positive": ("POS", "Positive"), "negative": ("NEG", "Negative")}
UCUM = {
    "mg/dl": "mg/dL", "g/dl": "g/dL", "u/l": "U/L", "iu/l": "[IU]/L", "mmol/l": "mmol/L", "umol/l": "umol/L", "ng/ml": "ng/mL", "pg/ml": "pg/mL", "ug/dl": "ug/dL",
    "meq/l": "meq/L", "mmhg": "mm[Hg]", "cm": "cm", "kg": "kg", "fl": "fL", "pg": "pg", "%": "%", "10^3/ul": "10*3/uL", "10^6/ul": "10*6/uL", "kg/m2": "kg/m2",
    "ml/min/1.73m2": "mL/min/{1.73_m2}", "miu/l": "m[IU]/L", "ng/dl": "ng/dL", "iu/ml": "[IU]/mL", "u/ml": "U/mL", "mm/hr": "mm/h",
}
PUBLIC_RANGE = "public reference range"


def _look(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def category(item: Column) -> Column:
    return F.when(item.isin(*VITAL), "vital-signs").when(item.isin(*EXAM), "exam").otherwise("laboratory")


def observations(findings: DataFrame) -> DataFrame:
    """Flat observations: code (dropped, with a note, where the unit is of another kind than the code's), value, interpretation, ranges.

    Optional columns: ``display``, ``ref_text``, ``ref_low``, ``ref_high``, ``range_source``, ``kb_range``, ``range_conflict``, ``qualitative_result``.
    """
    have = lambda c, kind="string": F.col(c) if c in findings.columns else F.lit(None).cast(kind)
    fits = F.col("unit").isNull() | (F.col("unit") == "") | (unit_class(F.col("unit")) == unit_class(F.col("item_unit")))
    number, code = F.col("v.kind") == "num", _look(LOINC, F.col("item"))
    notes = F.array_compact(F.array(
        F.when(F.coalesce(have("range_conflict", "boolean"), F.lit(False)), "printed and public reference range disagree"),
        F.when(code.isNotNull() & ~fits, F.concat(F.lit("LOINC "), code, F.lit(" omitted: unit "), "unit", F.lit(" is of another kind"))),
        F.when(have("qualitative_result").isNotNull(), F.concat(F.lit("報告判讀："), have("qualitative_result"))),
    ))
    return findings.select(
        "report_id", "pos", F.sha2(F.concat_ws("|", "report_id", "item", F.col("pos").cast("string")), 256).alias("id"),
        F.when(fits, code).alias("code"), F.col("item").alias("text"), F.coalesce(have("display"), F.col("item")).alias("display"), category(F.col("item")).alias("category"),
        F.when(number, F.col("v.v")).alias("value"), F.when(number, F.nullif(F.col("v.op"), F.lit(""))).alias("comparator"),
        F.when(~number, F.nullif(F.col("v.text"), F.lit(""))).alias("value_string"),
        F.when(~number & (F.col("v.text") == ""), "unknown").alias("absent_reason"), F.nullif(F.col("unit"), F.lit("")).alias("unit"),
        _look(UCUM, T.unit_key(F.col("unit"))).alias("ucum"), _look({k: v[0] for k, v in MARKS.items()}, F.col("status")).alias("interpretation"),
        F.nullif(have("ref_text"), F.lit("")).alias("report_range"), F.nullif(have("kb_range"), F.lit("")).alias("kb_range"), have("range_source").alias("range_source"),
        have("ref_low", "double").alias("ref_low"), have("ref_high", "double").alias("ref_high"), notes.alias("notes"),
    )


def _coding(system: str, code: Column, display: Column | None = None) -> Column:
    parts = [F.lit(SYSTEMS[system]).alias("system"), code.alias("code")]
    return F.array(F.struct(*parts, *([display.alias("display")] if display is not None else [])))


def _quantity(value: Column, comparator: Column | None = None) -> Column:
    first = [value.alias("value")] + ([comparator.alias("comparator")] if comparator is not None else [])
    return F.when(value.isNotNull(), F.struct(*first, "unit", F.when(F.col("ucum").isNotNull(), SYSTEMS["ucum"]).alias("system"), F.col("ucum").alias("code")))


def reference_ranges() -> Column:
    """The printed range and the public one, each where it is given; bounds stand on the one that was judged by."""
    here = lambda *sources: [F.when(F.col("range_source").isin(*sources), _quantity(F.col(c))) for c in ("ref_low", "ref_high")]

    def one(text: str, kind: Column, low: Column, high: Column) -> Column:
        return F.when(F.col(text).isNotNull(), F.struct(low.alias("low"), high.alias("high"), kind.alias("type"), F.col(text).alias("text")))

    none = F.lit(None).cast("struct<text:string>")
    both = F.array_compact(F.array(one("report_range", none, *here("report")), one("kb_range", F.struct(F.lit(PUBLIC_RANGE).alias("text")), *here("reference"))))
    return F.when(F.size(both) > 0, both)


def bundles(obs: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """``(report_id, bundle)``: one JSON document per report: patient, diagnostic report, observations in order; absent fields left out.

    ``reports(report_id, sex, day)`` may give gender and date. Ids and addresses follow from the report's id alone.
    """
    given = obs.select("report_id").distinct()
    if reports is not None:
        given = given.join(reports.select("report_id", "sex", F.col("day").cast("string").alias("day")), "report_id", "left")
    else:
        given = given.select("report_id", F.lit(None).cast("string").alias("sex"), F.lit(None).cast("string").alias("day"))
    given = given.withColumn("tag", F.substring(F.sha2(F.concat(F.lit("report_id|"), "report_id"), 256), 1, 16)).withColumn("day", partial_date(F.col("day")))
    url = lambda kind, i: stable_uuid(F.concat_ws("/", F.col("tag"), F.lit(kind), i))
    x = obs.join(given, "report_id").withColumn("patient", url("Patient", F.col("tag")))
    subject = F.struct(F.col("patient").alias("reference"))
    marked = F.when(F.col("interpretation").isNotNull(), F.array(F.struct(_coding("interpretation", F.col("interpretation"), _look({v[0]: v[1] for v in MARKS.values()}, F.col("interpretation"))).alias("coding"))))
    resource = F.struct(
        F.lit("Observation").alias("resourceType"), F.substring("id", 1, 32).alias("id"), F.lit("final").alias("status"),
        F.array(F.struct(_coding("category", F.col("category"), F.initcap(F.replace("category", F.lit("-"), F.lit(" ")))).alias("coding"))).alias("category"),
        F.struct(F.when(F.col("code").isNotNull(), _coding("loinc", F.col("code"))).alias("coding"), F.col("display").alias("text")).alias("code"),
        subject.alias("subject"), F.col("day").alias("effectiveDateTime"), _quantity(F.col("value"), F.col("comparator")).alias("valueQuantity"), F.col("value_string").alias("valueString"),
        F.when(F.col("absent_reason").isNotNull(), F.struct(_coding("absent", F.col("absent_reason"), F.lit("Unknown")).alias("coding"))).alias("dataAbsentReason"),
        marked.alias("interpretation"), F.when(F.size("notes") > 0, F.transform("notes", lambda n: F.struct(n.alias("text")))).alias("note"), reference_ranges().alias("referenceRange"),
    )
    x = x.withColumn("fullUrl", url("Observation", F.col("id")))
    entries = F.sort_array(F.collect_list(F.struct("pos", F.col("fullUrl"), F.to_json(resource).alias("resource"))))
    grouped = x.groupBy("report_id", "tag", "patient", "sex", "day").agg(entries.alias("e")).withColumn("report", url("DiagnosticReport", F.col("tag")))
    who = F.to_json(F.struct(F.lit("Patient").alias("resourceType"), F.concat(F.lit("patient-"), "tag").alias("id"), F.when(F.col("sex") == "M", "male").when(F.col("sex") == "F", "female").otherwise("unknown").alias("gender")))
    told = F.to_json(F.struct(
        F.lit("DiagnosticReport").alias("resourceType"), F.concat(F.lit("report-"), "tag").alias("id"), F.lit("final").alias("status"),
        F.array(F.struct(_coding("report", F.lit("LAB"), F.lit("Laboratory")).alias("coding"))).alias("category"), F.struct(F.lit("Health check-up report").alias("text")).alias("code"),
        subject.alias("subject"), F.col("day").alias("effectiveDateTime"), F.transform("e", lambda r: F.struct(r["fullUrl"].alias("reference"))).alias("result"),
    ))
    entry = lambda u, r: F.concat(F.lit('{"fullUrl":"'), u, F.lit('","resource":'), r, F.lit("}"))
    every = F.concat(F.array(entry(F.col("patient"), who), entry(F.col("report"), told)), F.transform("e", lambda r: entry(r["fullUrl"], r["resource"])))
    whole = F.concat(F.lit('{"resourceType":"Bundle","id":"bundle-'), "tag", F.lit('","type":"collection","entry":['), F.array_join(every, ","), F.lit("]}"))
    return grouped.select("report_id", whole.alias("bundle"))


def partial_date(c: Column) -> Column:
    """A year, month or day as FHIR writes it; null for anything else."""
    return F.when(c.rlike(r"^[0-9]{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01]))?)?$"), c)
