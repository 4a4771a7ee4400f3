"""Scalar column functions: normalisation, printed values, printed ranges, units, dates.

All but :func:`nfkc` are built-in expressions and stay inside code generation. Patterns avoid
look-behind, so that the same ones can be read by other engines.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters and words of printed reports.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　 µ"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + "  μ"
VARIANT, COMMON = "脢侫胺醣酯沈佈[〈【]〉】", "酶酶氨糖脂沉布((()))"
NEGATIVE = ["-", "neg", "negative", "陰性", "(-)", "無", "nonreactive", "non-reactive", "notdetected", "未檢出", "normal", "正常", "陰性(-)"]
TRACE = ["+/-", "±", "trace", "微量", "+-", "tr", "(+/-)", "(±)"]
UNITS = [
    "mg/dl", "g/dl", "u/l", "iu/l", "mmol/l", "umol/l", "ng/ml", "pg/ml", "ug/dl", "meq/l", "mmhg", "cm", "kg", "fl", "pg", "%", "coi", "s/co",
    "10^3/ul", "10^6/ul", "kg/m2", "ml/min/1.73m2", "/hpf", "miu/l", "ng/dl", "db", "iu/ml", "u/ml", "mm/hr",
]
NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?"
SEP = r"[~\-–—到至]"
OP = r"(<=|>=|≦|≧|≤|≥|<|>)"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, private-use glyphs to spaces, runs of blanks to one (no built-in does NFKC)."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x)).str.replace("[-]", " ", regex=True).str.replace(r"[ \t\r\f\v]+", " ", regex=True).str.strip()


def fold(c: Column) -> Column:
    """The full-width subset of NFKC as a built-in: digits, letters, signs and blanks."""
    return F.trim(F.regexp_replace(F.translate(c, WIDE, NARROW), "[ \t\r\f]+", " "))


_MADE: dict[tuple, object] = {}


def made_once(key: str, build):
    """What ``build`` gives, kept per JVM: long expressions over fixed column names cost thousands of calls to build."""
    at = id(SparkContext._gateway), key
    if at not in _MADE:
        _MADE[at] = build()
    return _MADE[at]


def let(c: Column, f) -> Column:
    """``f`` of ``c`` with ``c`` evaluated once, however often ``f`` names it: keeps expressions small."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def name_key(c: Column) -> Column:
    """Lookup key of a printed item name."""
    s = F.translate(F.lower(fold(c)), VARIANT, COMMON)
    s = F.regexp_replace(s, r"[\s.\-_·'’*:,;=]", "")
    for _ in range(2):
        s = F.regexp_replace(s, r"^\(([^()]*)\)$", "$1")
    return s


def unit_key(c: Column) -> Column:
    """Comparison key of a unit; empty for none."""
    s = F.regexp_replace(F.translate(F.lower(fold(F.coalesce(c, F.lit("")))), "μ", "u"), "[ ()]", "")
    s = F.regexp_replace(s, "mm[~-]hg", "mmhg")
    for a, b in (("公分", "cm"), ("公斤", "kg"), ("次/min", "次/分"), ("²", "2")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(F.regexp_replace(s, "^x?10[*^]?([0-9])", "10^$1"), r"^\^([0-9])", "10^$1")
    return F.when(s == "iu/l", "u/l").when(s == "mg%", "mg/dl").otherwise(s)


def number_text(c: Column) -> Column:
    """A number as people print it: no trailing zeros, no exponent below 1e15."""
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c.cast("double")), "0+$", ""), r"\.$", "")
    return F.when(c.isNotNull(), fixed)


def op_text(c: Column) -> Column:
    return F.when(c.isin("≦", "≤"), "<=").when(c.isin("≧", "≥"), ">=").otherwise(c)


def _num(c: Column) -> Column:
    return c.try_cast("double")


def value(c: Column) -> Column:
    """``struct(kind, v, op, grade, text, flag, unit)`` of a printed result.

    kind is num, pos, neg, trace or text; trailing H, L, HH, LL, A, arrows and stars are its flag.
    """
    return let(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"^\*+ *", ""), _value)


def _value(s: Column) -> Column:
    tail = r"( +(HH|LL|H|L|A)| *([↑↓]+|\*+)) *$"
    raw = F.regexp_extract(s, r"^.+?" + tail, 1)
    sign = F.trim(raw)
    flag = F.when(sign.startswith("↑"), "H").when(sign.startswith("↓"), "L").when(sign.startswith("*"), "*").otherwise(sign)
    bare = s
    for _ in range(2):
        bare = F.regexp_replace(bare, r"^(.+?)" + tail, "$1")
    return let(F.struct(bare.alias("s"), flag.alias("f")), lambda x: _valued(x["s"], x["f"]))


def _valued(s: Column, flag: Column) -> Column:
    low = F.replace(F.lower(s), F.lit(" "), F.lit(""))
    graded, grade = rf"^{OP}? *({NUMBER}) *\( *([1-4]\+|\+{{1,4}}) *\)$", r"^\(? *([1-4]\+|\+{1,4}) *\)?$"
    plain, inner = rf"^{OP}? *({NUMBER}) *(%?)$", r"([1-4]) *\+"
    bare = F.regexp_replace(s, r"([0-9]),([0-9]{3})", "$1$2")

    def made(kind, v=None, op=None, grade=None, unit=None):
        lit = lambda x, t: F.lit(x).cast(t) if x is None or isinstance(x, str) else x
        return F.struct(
            F.lit(kind).alias("kind"), lit(v, "double").alias("v"), lit(op or "", "string").alias("op") if not isinstance(op, Column) else op.alias("op"),
            lit(grade, "string").alias("grade"), s.alias("text"), flag.alias("flag"), (unit if unit is not None else F.lit("")).alias("unit"),
        )

    return (
        F.when(low == "", made("text"))
        .when(low.isin(NEGATIVE), made("neg"))
        .when(low.isin(TRACE), made("trace"))
        .when(s.rlike(graded), made("pos", _num(F.regexp_extract(s, graded, 2)), op_text(F.regexp_extract(s, graded, 1)), F.regexp_extract(s, graded, 3)))
        .when(s.rlike(grade), made("pos", grade=F.regexp_extract(s, grade, 1)))
        .when(low.rlike("陽性|positive|reactive") & ~low.startswith("non"), made("pos", grade="+"))
        .when(bare.rlike(plain), made("num", _num(F.regexp_extract(bare, plain, 2)), op_text(F.regexp_extract(bare, plain, 1)), unit=F.regexp_extract(bare, plain, 3)))
        .when(s.rlike(inner) & ~s.rlike(r"[0-9] *[~\-] *[0-9]"), made("pos", grade=F.concat(F.regexp_extract(s, inner, 1), F.lit("+"))))
        .otherwise(made("text"))
    )


def _unit_of(c: Column) -> Column:
    s = F.trim(F.regexp_replace(F.trim(c), r"^\(+|\)+$", ""))
    return F.when(s.rlike("[A-Za-zμ%°/]|次|公分|公斤"), s).otherwise("")


def bare_range(c: Column) -> Column:
    """A printed range without its label and redundant outer brackets."""
    s = F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "(?i)^(參考值|參考範圍|參考區間|正常值|正常範圍|reference|ref) *:? *", "")
    for _ in range(3):
        s = let(s, _peeled)
    return s


def _peeled(s: Column) -> Column:
    n = F.length(F.translate(s, ")", "")) - F.length(F.translate(s, "(", ""))
    whole = s.rlike(r"^\((?:[^()]|\([^()]*\))*\)$")
    inner = F.regexp_replace(s, r"^\((.*)\)$", "$1")
    opened, closed = (n > 0) & s.startswith("("), (n < 0) & s.endswith(")")
    return F.trim(F.when(whole, inner).when(opened, F.regexp_replace(s, r"^\(", "")).when(closed, F.regexp_replace(s, r"\)$", "")).otherwise(s))


def _range(s: Column) -> Column:
    """``struct(kind, lo, hi, lo_strict, hi_strict, unit)`` of one range that does not depend on sex."""
    return let(s, _ranged)


def _ranged(s: Column) -> Column:
    upper, lower = rf"^(<=|≦|≤|<) *({NUMBER})(.*)$", rf"^(>=|≧|≥|>) *({NUMBER})(.*)$"
    worded, between = rf"^({NUMBER}) *([A-Za-zμ%/.0-9\-^]*) *(以下|以上)$", rf"^({NUMBER}) *{SEP} *({NUMBER})(.*)$"
    low = F.replace(F.lower(s), F.lit(" "), F.lit(""))
    none = F.lit(None).cast("double")

    def made(kind, lo=none, hi=none, strict=F.lit(False), unit=F.lit("")):
        lo_strict, hi_strict = (strict, F.lit(False)) if kind == "lower" else (F.lit(False), strict)
        return F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), lo_strict.alias("lo_strict"), hi_strict.alias("hi_strict"), unit.alias("unit"))

    got = lambda p, i: F.regexp_extract(s, p, i)
    a, b = _num(got(between, 1)), _num(got(between, 2))
    bare_unit = low.rlike(r"^[a-zμ%°/.^\-]*[a-zμ%°/][a-zμ%°/.^0-9\-]*$") & (low.rlike("[/%]") | unit_key(s).isin(UNITS))
    return (
        F.when(s == "", made("none"))
        .when(low.isin(NEGATIVE) | low.startswith("-~-") | low.startswith("陰性"), made("qual_neg"))
        .when(s.rlike(upper), made("upper", hi=_num(got(upper, 2)), strict=got(upper, 1) == "<", unit=_unit_of(got(upper, 3))))
        .when(s.rlike(lower), made("lower", lo=_num(got(lower, 2)), strict=got(lower, 1) == ">", unit=_unit_of(got(lower, 3))))
        .when(s.rlike(worded) & (got(worded, 3) == "以下"), made("upper", hi=_num(got(worded, 1)), unit=_unit_of(got(worded, 2))))
        .when(s.rlike(worded), made("lower", lo=_num(got(worded, 1)), unit=_unit_of(got(worded, 2))))
        .when(s.rlike(between) & (a <= b), made("range", a, b, unit=_unit_of(got(between, 3))))
        .when(s.rlike(between), made("none"))
        .when(bare_unit, made("unit_only", unit=F.trim(s)))
        .otherwise(made("none"))
    )


def reference(c: Column) -> Column:
    """``struct(kind, m, f, qual_neg, text)`` of a printed reference.

    ``m`` and ``f`` are the ranges for either sex; they are equal unless kind is sex.
    """
    return let(F.struct(bare_range(c).alias("s"), fold(F.coalesce(c, F.lit(""))).alias("t")), lambda x: _referred(x["s"], x["t"]))


def _referred(s: Column, text: Column) -> Column:
    one = rf"((?:<=|>=|≦|≧|≤|≥|<|>) *{NUMBER}|{NUMBER} *{SEP} *{NUMBER})"
    male = rf"(?i)(?:男性?|\bmale|\bM *:) *:? *{one}"
    female = rf"(?i)(?:女性?|female|\bF *:) *:? *{one}"
    tail = _unit_of(F.regexp_replace(F.regexp_extract(s, rf"(?i)^.*(?:男性?|女性?|male|\b[MF] *:) *:? *{one}(.*)$", 2), "^[ /,;、]+", ""))
    m, f = (F.trim(F.concat_ws(" ", F.regexp_extract(s, p, 1), tail)) for p in (male, female))
    cut = r"(?i)^(?:陰性|negative|neg|non-?reactive|\(-\)|-) *\(? *((?:<=|≦|≤|<) *[^()]*?) *\)?$"

    def made(m, f, kind, qual):
        return F.struct(kind.alias("kind"), m.alias("m"), f.alias("f"), qual.alias("qual_neg"), text.alias("text"))

    plain = let(_range(s), lambda r: made(r, r, r["kind"], r["kind"] == "qual_neg"))
    limit = let(_range(F.regexp_extract(s, cut, 1)), lambda r: F.when(r["kind"] == "upper", made(r, r, r["kind"], F.lit(True))))
    return F.when(s.rlike(male) & s.rlike(female), made(_range(m), _range(f), F.lit("sex"), F.lit(False))).when(s.rlike(cut), F.coalesce(limit, plain)).otherwise(plain)


def sex_of(c: Column) -> Column:
    """M or F from the first sex label of a report's header; null if there is none."""
    got = F.upper(F.regexp_extract(fold(c), r"(?i)(?:性別|sex|gender) *[:：]? *(男|女|male|female|m\b|f\b)", 1))
    return F.when(got.isin("男", "MALE", "M"), "M").when(got.isin("女", "FEMALE", "F"), "F")


def exam_date(c: Column) -> Column:
    """Date after the first examination label, Gregorian or Republic-of-China year; never the birth date."""
    p = r"(?:檢查日期|健檢日期|採檢日期|報告日期|檢驗日期|exam date|report date) *:? *([0-9]{2,4})[年./-] *([0-9]{1,2})[月./-] *([0-9]{1,2})"
    y, m, d = (F.regexp_extract(F.lower(fold(c)), p, i).try_cast("int") for i in (1, 2, 3))
    y = F.when(y < 1000, y + 1911).otherwise(y)
    return F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")


def clean_name(c: Column) -> Column:
    """Item name without bullets, numbering and a trailing range label; null if it is no name."""
    s = F.regexp_replace(fold(c), r"^[*●•◎○■□◆#]+ *|^[0-9]+[.、)] *", "")
    s = F.trim(F.regexp_replace(s, "[:：]? *(參考值|參考範圍)? *:?$", ""))
    return F.when((F.length(s) <= 80) & s.rlike(r"[A-Za-z㐀-鿿]"), s)


def csv_cell(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading quote."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def first_url(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(https?://[^\s\"'<>)]+)", 1), F.lit(""))


def strip_markup(c: Column) -> Column:
    """Visible text of a page: scripts, styles, tables, tags and entities gone, blanks collapsed."""
    s = F.regexp_replace(c, r"(?is)<(script|style|table)\b.*?</(script|style|table)>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def markup_rows(c: Column) -> Column:
    """Rows of cells from HTML tables and from pipe tables; empty rows and rulers dropped."""
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda x: strip_markup(x))
    html = F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), cells)
    lines = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$") & ~x.rlike(r"^[\s|:\-]+$"))
    pipes = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda y: F.trim(y)))
    return F.filter(F.concat(html, pipes), lambda row: F.exists(row, lambda x: x != ""))


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    return F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2)))))


def support(claim: Column, passage: Column, filler: list[str] | None = None) -> Column:
    """Share of the claim's character pairs that the passage holds; filler words do not count."""
    plain = lambda x: F.regexp_replace(F.lower(fold(x)), r"\s+", "")
    core = F.lower(fold(claim))
    for w in filler or []:
        core = F.replace(core, F.lit(w), F.lit(""))
    once = F.struct(plain(core).alias("c"), plain(passage).alias("p"))

    def share(x: Column) -> Column:
        hits = lambda pairs: F.size(F.filter(pairs, lambda p: F.contains(x["p"], p))) / F.size(pairs)
        whole = F.when(F.contains(x["p"], x["c"]), 1.0).otherwise(0.0)
        return F.when(F.length(x["c"]) > 1, let(bigrams(x["c"]), hits)).otherwise(whole)

    return let(once, share)


def hmac_sha256(key: str, c: Column) -> Column:
    """HMAC-SHA256 in hex, by its two hash passes (there is no built-in)."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(c, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)
