"""What goes into a model's prompt, and what may be believed of its answer: report prose, candidates, prompts, partial output."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Words of report prose, of administrative fields, and of the prompt.
NARRATIVE = r"(?i)超音波|X\s*光|攝影|心電圖|理學|結論|診斷|發現|內視鏡|胃鏡|大腸鏡|骨密度|眼底|聽力|視力|斷層|CT|MRI|檢查結果|醫師|印象|Impression"
ADMINISTRATIVE = (
    r"(?i)日期|年齡|電話|手機|姓名|地址|編號|身分|身份|生日|出生|病歷|頁|報告|受檢|性別|時間|醫師|病史|症狀|問診|習慣|理學|外觀|顏色|辨色|理想"
    r"|\bdate\b|\bage\b|phone|\btel\b|\bname\b|\bid\b|address|ideal"
)
HEADER_LINE = r"^\s*(?:項目|檢查項目|檢驗項目)\s+(?:結果|檢驗結果|數值)(?:\s+\S+){0,3}\s*$"
RESULT_WORDS = r"男|女|性|正常|陰性|陽性|參考|範圍|單位|次/分|異常|偏高|偏低"
ARROWS = {"high": "↑ HIGH", "low": "↓ LOW", "positive": "陽性 POSITIVE", "negative": "陰性", "normal": "ok"}
ADVICE = ("lifestyle", "food", "exercise", "supplements", "avoid")
_NOT_PROSE = r"[\s0-9.,:;/\\()\[\]<>≦≧≤≥=+~↑↓*%|A-Za-zµμγαβ^-]+"


def item_candidate(name: Column, is_number: Column, has_range: Column) -> Column:
    """Whether an unmatched row may be shown to a model as a test: a plausible name, not administrative, with a number or a range."""
    named = F.length(name).between(2, 40) & name.rlike("[A-Za-z㐀-鿿]") & ~name.rlike(ADMINISTRATIVE)
    return F.coalesce(named & (is_number | has_range), F.lit(False))


def narrative(text: Column) -> Column:
    """The lines of a report that state findings in words."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(NARRATIVE))


def _lower(c: Column) -> Column:
    return F.lower(T.fold(F.coalesce(c, F.lit(""))))


def without_results(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """``reports(report_id, text)`` with ``prose`` and ``n_dropped``: lines that only print a parsed result, and header lines, go.

    A line goes if it holds a finding's name and value and at most four characters of prose beside them, its
    unit, its range and the words of results. Reports without findings stay as they are.
    """
    mine = F.struct(
        F.col("pos"), _lower(F.coalesce("raw_name", "display")).alias("name"), F.get(F.split(_lower(F.col("value_text")), " "), F.lit(0)).alias("value"),
        _lower(F.col("unit")).alias("unit"), _lower(F.col("ref_text")).alias("ref"),
    )
    keys = findings.groupBy("report_id").agg(F.sort_array(F.collect_list(mine)).alias("keys"))
    x = reports.join(keys, "report_id", "left")

    def kept(line: Column) -> Column:
        s = _lower(line)
        hit = F.get(F.filter("keys", lambda k: (k["name"] != "") & (k["value"] != "") & F.contains(s, k["name"]) & F.contains(s, k["value"])), F.lit(0))

        def rest(k: Column) -> Column:
            out = s
            for part in ("name", "value", "unit", "ref"):
                out = F.when(k[part] == "", out).otherwise(F.replace(out, k[part], F.lit(" ")))
            return F.regexp_replace(F.regexp_replace(out, RESULT_WORDS, " "), _NOT_PROSE, "")

        return ~s.rlike(HEADER_LINE) & F.coalesce(F.length(rest(hit)) > 4, F.lit(True))

    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    left = F.when(F.col("keys").isNull(), lines).otherwise(F.filter(lines, kept))
    x = x.withColumn("__left", left)
    return x.select(*reports.columns, F.array_join("__left", "\n").alias("prose"), (F.size(lines) - F.size("__left")).alias("n_dropped"))


def stated(conditions: DataFrame, prose: DataFrame, names: DataFrame, least: float = 0.75) -> DataFrame:
    """``conditions(report_id, text)`` that a report's prose supports and that name none of its items.

    ``names(report_id, names)`` are all names of a report's findings.
    """
    x = conditions.join(prose.select("report_id", "prose"), "report_id", "left").join(names, "report_id", "left")
    said = _lower(F.col("text"))
    core = F.regexp_replace(said, r"[0-9.]+\s*(?:cm|mm|公分|毫米)?|[(][^)]*[)]", "")
    named = F.coalesce(F.exists("names", lambda n: (F.length(n) >= 2) & F.contains(said, _lower(n))), F.lit(False))
    held = T.support(core, _lower(F.col("prose"))) >= least
    return x.where(~named & (T.fold(core) != "") & F.coalesce(held, F.lit(False))).select(*conditions.columns)


def finding_names(findings: DataFrame) -> DataFrame:
    """``(report_id, names)``: every name of two letters or more that a report's findings go by."""
    cols = [c for c in ("display", "matched_name", "raw_name", "name") if c in findings.columns]
    every = findings.select("report_id", F.explode(F.array(*[T.fold(F.col(c)) for c in cols])).alias("n")).where(F.length("n") >= 2)
    return every.groupBy("report_id").agg(F.sort_array(F.collect_set("n")).alias("names"))


def finding_lines(findings: DataFrame, only_abnormal: bool = True) -> DataFrame:
    """``(report_id, findings_text)``: a list of findings as a prompt shows it, in order."""
    arrow = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ARROWS.items() for x in kv]), F.col("status")), F.lit("?"))
    unit = F.when(F.coalesce("unit", F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), "unit"))
    ref = F.when(F.coalesce("ref_text", F.lit("")) == "", "").otherwise(F.concat(F.lit(" (ref "), "ref_text", F.lit(")")))
    note = F.when(F.coalesce("range_conflict", F.lit(False)), "；注意：報告與公開參考範圍判定不同").otherwise("")
    line = F.concat(F.lit("- "), "display", F.lit(" = "), "value_text", unit, F.lit(" ["), arrow, F.lit("]"), ref, note)
    x = findings.where(F.col("direction").isin("high", "low")) if only_abnormal else findings
    rows = F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))
    return x.groupBy("report_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("findings_text"))


def prompts(reports: DataFrame, report_chars: int = 6000, context_chars: int = 3500) -> DataFrame:
    """``reports(report_id, prose, n_dropped, findings_text, context)`` with ``prompt``: the parts of the user's message.

    The budgets are the model's window and bound the rendering only; a cut is written into the prompt.
    """
    cut = F.when(F.length("prose") > report_chars, F.concat(F.lit("\n[…報告其餘內容已截斷（原長 "), F.length("prose").cast("string"), F.lit(" 字）]"))).otherwise("")
    gone = F.when(F.col("n_dropped") > 0, F.concat(F.lit("\n[已移除 "), F.col("n_dropped").cast("string"), F.lit(" 行檢驗數值]"))).otherwise("")
    told = F.array_join(narrative(F.col("prose")), "\n")
    none = lambda c, word: F.when(F.coalesce(c, F.lit("")) == "", word).otherwise(c)
    parts = [
        F.concat(F.lit("# 健檢報告\n\n"), F.substring("prose", 1, report_chars), cut, gone),
        F.concat(F.lit("# 報告中的文字結論段落\n"), none(told, "（無）")),
        F.concat(F.lit("# 異常檢驗值\n"), none(F.col("findings_text"), "（無異常值）")),
        F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit("# 參考資料片段\n\n"), F.substring("context", 1, context_chars))),
        F.lit("請輸出 JSON。"),
    ]
    return reports.withColumn("prompt", F.array_join(F.array_compact(F.array(*parts)), "\n\n---\n"))


def answer_schema(passages: list[str], categories: tuple[str, ...] = ADVICE, most: int = 4) -> dict:
    """JSON schema of a model's answer: tags per category, each with a text and a source that may be cited."""
    tag = {"type": "object", "properties": {"text": {"type": "string", "maxLength": 24}, "src": {"enum": ["report", "inferred", *(f"kb:{p}" for p in passages)]}}, "required": ["text", "src"]}
    props = {"summary": {"type": "string"}, **{c: {"type": "array", "items": tag, "maxItems": most} for c in ("text_conditions", *categories)}}
    return {"type": "object", "properties": props, "required": list(props)}


def _objects(raw: str) -> Iterator[dict]:
    for m in re.finditer(r"\{[^{}\[\]]*\}", raw):
        try:
            got = json.loads(m[0])
        except ValueError:
            continue
        if str(got.get("text", "")).strip():
            yield got


def partial(answers: DataFrame, categories: tuple[str, ...] = ("text_conditions", *ADVICE)) -> DataFrame:
    """``answers(report_id, answer)``, complete or cut off anywhere, to ``(report_id, category, pos, text, src)``; the summary is a row too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, raw in zip(b.report_id, b.answer):
                raw = raw or ""
                m = re.search(r'"summary"\s*:\s*"((?:[^"\\]|\\.)*)', raw)
                if m:
                    rows.append((rid, "summary", 0, m[1].encode().decode("unicode_escape") if "\\u" in m[1] else m[1].replace('\\"', '"').replace("\\n", "\n"), None))
                at = sorted((m.start(), m.end(), c) for c in categories for m in [re.search(rf'"{c}"\s*:\s*\[', raw)] if m)
                for (_, a, c), nxt in zip(at, [*at[1:], (len(raw), 0, "")]):
                    rows += [(rid, c, i, str(o["text"]).strip(), str(o.get("src", "report"))) for i, o in enumerate(_objects(raw[a : nxt[0]]))]
            yield pd.DataFrame(rows, columns=["report_id", "category", "pos", "text", "src"]).astype({"pos": "int32"})

    return answers.select("report_id", "answer").mapInPandas(run, "report_id string, category string, pos int, text string, src string")


def questions(findings: DataFrame) -> DataFrame:
    """``(query, n)``: the distinct search texts of abnormal findings, so that each is embedded once whatever the reports."""
    word = F.when(F.col("direction") == "high", "偏高").otherwise("偏低")
    x = findings.where(F.col("direction").isin("high", "low")).select(F.concat_ws(" ", "display", word, F.lit("原因 風險 飲食 運動 生活習慣 改善")).alias("query"))
    return x.groupBy("query").agg(F.count("*").alias("n"))


def ranked_per(rows: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
