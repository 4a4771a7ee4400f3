"""Report text and tables to raw records; the state machines run per report in Arrow batches."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

SCHEMA = "report_id string, pos int, name string, value_text string, unit string, ref_text string, source string"
# Header words of report tables, by role.
ROLES = {
    "name": ("項目", "檢驗項目", "檢查項目", "名稱", "item", "test", "test name", "name"),
    "value": ("結果", "檢驗值", "測定值", "檢查值", "檢驗結果", "檢查結果", "數值", "本次結果", "result", "value", "results"),
    "unit": ("單位", "unit", "units"),
    "ref": ("參考值", "參考範圍", "正常值", "參考區間", "參考標準", "標準值", "正常範圍", "ref", "reference", "reference range", "range", "normal"),
    "flag": ("異常", "備註", "標記", "判讀", "異常標記", "結果判定", "判定", "註記", "flag", "h/l"),
    "index": ("序號", "no", "no.", "編號"),
    "category": ("類別", "分類", "category"),
}
_ROLE = {w: r for r, ws in ROLES.items() for w in ws}
_NUMBER = r"[-+]?\d+(?:,\d{3})*(?:\.\d+)?"
_GRADE = r"\(\s*[1-4]\+\s*\)"
_SIGN = r"(?:<=|>=|≦|≧|≤|≥|<|>)"
_WORDS = r"陰性|陽性|微量|negative|positive|trace|non-?reactive|reactive|neg\b|pos\b"
_VALUE = rf"{_SIGN}?\s*{_NUMBER}\s*{_GRADE}|[1-4]\+(?![\d+])|{_SIGN}?\s*{_NUMBER}|{_WORDS}|\+/-|±|{_GRADE}|\+{{1,4}}|\(-\)|-(?=\s|$|\()"
_CELL_VALUE = re.compile(rf"^\**\s*(?:{_VALUE})\s*%?\s*(?:H|L|HH|LL|↑|↓|\*)?$", re.I)
_FLAG = r"\s*(?:[↑↓]+|\*+)|\s+(?:HH|LL|H|L)(?![A-Za-z0-9])"
_UNIT = r"\s*(?:(?:x?10\^?\d+|\^\d+)\s*/\s*[uμm]?l|[a-zμ%°/][a-zμ%°/.^\d\-]*|次/分|公分|公斤)"
# one result: what may stand before a value, the value, and after it flags, unit and range
_RESULT = re.compile(rf"(?:^|(?<=[ =])|(?<=[^\d]:))(?P<value>{_VALUE})(?![~/\-:]\d)(?P<flag>{_FLAG})?", re.I)
_REST = re.compile(rf"(?P<unit>{_UNIT})(?P<flag>{_FLAG})?", re.I)
_LABEL = re.compile(r"\s*(?P<label>參考值|參考範圍|正常值)?\s*[:：]?\s*")
_RANGE = re.compile(rf"{_SIGN}\s*{_NUMBER}|{_NUMBER}\s*[~\-–—]\s*{_NUMBER}|-~-\s*(?:\(\+/-\))?")
_PRESSURE = re.compile(r"(?:血壓|b\.?\s*p\.?|blood\s*pressure|收縮壓\s*/\s*舒張壓|sbp\s*/\s*dbp)\s*:?\s*(?:\([^)]*\))?\s*:?\s*(\d{2,3})\s*/\s*(\d{2,3})(?!\d)(?:\s*(mm[-~]?Hg))?", re.I)
_BEFORE_NAME = re.compile(r"^[\s*•·※\-–>)\]●◎]*(?:\(?\d{1,2}[.、)]\s*(?=\D))?")
_AFTER_NAME = re.compile(r"[\s:=]*(?:參考值|參考範圍)?[\s:=]*$")
_UNITS = frozenset(T.UNITS) | {"次/分", "公分", "公斤"}


def _plain(s: object) -> str:
    return re.sub(r"[ \t]+", " ", unicodedata.normalize("NFKC", str(s or ""))).strip()


def is_unit(s: str) -> bool:
    """A known unit, or one that is built like a concentration or a count."""
    k = s.strip().lower().replace("μ", "u").replace("µ", "u").replace(" ", "")
    return k in _UNITS or bool(re.fullmatch(r"(?:x?10)?\^\d+/[um]?l", k) or re.fullmatch(r"[a-z%]{1,5}(?:/[a-z\d.]{1,6})+", k))


def _range_at(s: str, at: int) -> tuple[str, int]:
    """The range that begins at ``at``, with an own unit, and its end: a bracket with all that it holds, or bare bounds."""
    if s[at : at + 1] == "(":
        depth = 0
        for i in range(at, len(s)):
            depth += {"(": 1, ")": -1}.get(s[i], 0)
            if not depth:
                return s[at : i + 1], i + 1
        return s[at:], len(s)
    m = _RANGE.match(s, at)
    if not m:
        return "", at
    unit = re.compile(_UNIT, re.I).match(s, m.end())
    return (f"{m[0]} {unit[0].strip()}", unit.end()) if unit and is_unit(unit[0]) else (m[0], m.end())


def item_name(raw: str) -> str:
    """A printed name without list marks, numbering and labels; empty if it is no name."""
    name = _AFTER_NAME.sub("", _BEFORE_NAME.sub("", _plain(raw))).strip(" :=")
    return name if len(name) <= 80 and re.search(r"[A-Za-z㐀-鿿]", name) else ""


def from_line(line: str) -> list[tuple[str, str, str, str]]:
    """``(name, value, unit, range)`` of one line of text, left to right; blood pressure gives two.

    A name is what stands between the result before it and its own value. Lines of over 400 characters are
    prose, not results.
    """
    s, out = _plain(line), []
    if len(s) > 400:
        return out
    for m in list(_PRESSURE.finditer(s)):
        out += [("收縮壓", m[1], m[3] or "mmHg", ""), ("舒張壓", m[2], m[3] or "mmHg", "")]
        s = s[: m.start()] + " " * len(m[0]) + s[m.end() :]
    done = at = 0
    while m := _RESULT.search(s, at):
        end, flag, unit = m.end(), (m["flag"] or "").strip(), ""
        rest = _REST.match(s, end)
        if rest and is_unit(rest["unit"]):
            unit, end = rest["unit"].strip(), rest.end("unit")
            if rest["flag"] and not flag:
                flag, end = rest["flag"].strip(), rest.end()
        if end == m.end("value") and s[end : end + 1] not in ("", " ", "(", "（"):
            at = m.start() + 1
            continue
        label = _LABEL.match(s, end)
        ref, to = _range_at(s, label.end())
        name = item_name(s[done : m.start()])
        if name:
            out.append((name, m["value"].strip() + (f" {flag}" if flag else ""), unit, ref))
        done = at = max(to if ref else label.end() if label["label"] else end, m.start() + 1)
    return out


def _role(cell: str) -> str | None:
    """By the whole word, else by a part of a short one."""
    if cell in _ROLE or not cell:
        return _ROLE.get(cell)
    if "結果" in cell and len(cell) <= 12:
        return "value"
    return "ref" if ("參考" in cell or "正常值" in cell) and len(cell) <= 8 else None


def joined(cell: object, name: bool = False) -> str:
    """A cell of several lines as one: what a column border cut from a word, or a grade from its number, is put back."""
    parts = [p.strip() for p in str(cell or "").split("\n") if p.strip()]
    if not name:
        return _plain(("" if any(re.fullmatch(r"[+)(\d]+\)?\s*[HL]?", p) for p in parts[1:]) else " ").join(parts))
    out = ""
    for p in parts:
        tight = not out or (len(p) <= 2 and out[-1].isalpha() and p[0].isalpha())
        out += p if tight else " " + p
    return _plain(out)


def roles(cells: list[str]) -> list[str | None] | None:
    """The columns' roles, if this row is a header: two roles or more, one of them the name, no number."""
    got = [_role(re.sub(r"\s+", " ", c).strip().lower()) for c in cells]
    known = [r for r in got if r]
    return got if len(known) >= 2 and "name" in known and not any(re.fullmatch(r"[-+]?\d+(?:\.\d+)?", c) for c in cells) else None


def from_table(table: list[list[str]]) -> list[tuple[str, str, str, str]]:
    """Records of one table. A header's roles hold until the next; items side by side start at each name."""
    out, now = [], None
    for row in table:
        first = next((i for i, c in enumerate(row) if re.search(r"[A-Za-z㐀-鿿]", str(c or ""))), 0)
        cells = [joined(c, now[i] == "name" if now and i < len(now) else i == first) for i, c in enumerate(row)]
        if not any(cells):
            continue
        head = roles(cells)
        if head:
            now = head
            continue
        if now and len(now) >= len(cells):
            starts = [i for i, r in enumerate(now) if r == "name"]
            for a, b in zip(starts, [*starts[1:], len(cells)]):
                part = {r: c for r, c in zip(now[a:b], cells[a:b]) if r}
                if part.get("name") and part.get("value"):
                    unit, ref = _rejoin(part.get("unit", ""), part.get("ref", ""))
                    out.append((part["name"], (part["value"] + " " + part.get("flag", "")).strip(), unit, ref))
            continue
        name = value = unit = ref = None
        for c in cells:
            if name is None:
                name = c if re.search(r"[A-Za-z㐀-鿿]", c) and not _CELL_VALUE.match(c) else None
            elif value is None:
                value = c if _CELL_VALUE.match(c) else None
                if value is None and re.search(r"[㐀-鿿A-Za-z]{2}", c):
                    name = f"{name} {c}".strip()
            elif re.search(r"\d\s*[~～\-]\s*\d|[<>≦≧]\s*\d|陰性|\(-\)|neg|^\(.*\)$", c, re.I):
                ref = ref or c
            elif c:
                unit = unit or c
        if name and value:
            out.append((name, value, unit or "", ref or ""))
    return out


def _rejoin(unit: str, ref: str) -> tuple[str, str]:
    """A range that a column border cut in two becomes one again."""
    m = re.match(r"^(.*?)\s*([-\d.]+\s*[~\-])$", unit)
    if m and re.match(r"^[\d.]+", ref):
        return m[1], m[2] + ref
    return unit, ref


def records(reports: DataFrame) -> DataFrame:
    """``reports(report_id, text, tables)`` to raw records: tables first, then lines; repeats of (name, value, source) once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, text, tables in zip(b.report_id, b.text, b.tables):
                seen, pos = set(), 0
                found = [(*r, "table") for t in (tables if tables is not None else []) for r in from_table([list(x) for x in t])]
                found += [(*r, "text") for line in (text or "").split("\n") for r in from_line(line)]
                for name, value, unit, ref, source in found:
                    key = (re.sub(r"\s", "", name.lower()), value, source)
                    if key not in seen:
                        seen.add(key)
                        out.append((rid, pos, name, value, unit, ref, source))
                        pos += 1
            yield pd.DataFrame(out, columns=["report_id", "pos", "name", "value_text", "unit", "ref_text", "source"]).astype({"pos": "int32"})

    return reports.select("report_id", "text", "tables").mapInPandas(run, SCHEMA)


def is_scanned(text: Column, least: int = 50) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def is_double(rows: Column) -> Column:
    """Two tables side by side: a row with the item header twice or more."""
    return F.exists(rows, lambda r: F.size(F.filter(r, lambda c: F.trim(c).isin("項目", "檢驗項目"))) >= 2)


# Simplified characters of recognised reports, each followed by the traditional one.
SIMPLIFIED = (
    "参參 检檢 项項 结結 单單 红紅 验驗 围圍 标標 记記 类類 组組 别別 总總 压壓 缩縮 体體 岁歲 质質 细細 数數 计計 胆膽 肾腎 离離 转轉 碱鹼 钙鈣 钾鉀 钠鈉 铁鐵 镁鎂 维維 杂雜 "
    "范範 尿尿 脂脂"
).split()
_TRADITIONAL = str.maketrans({pair[0]: pair[1] for pair in SIMPLIFIED})
_DOT = r"[·•・‧∙]"
_SPACED = re.compile(r"(?<![\w.])\d(?: [\d.·•・‧∙])+(?![\w.])")


def ocr_text(s: str) -> str:
    """Recognised text put right: entities, simplified characters, digits that stand one by one, middle dots between digits."""
    s = _SPACED.sub(lambda m: m[0].replace(" ", ""), html.unescape(s).translate(_TRADITIONAL))
    return re.sub(rf"(?<=\d)\s*{_DOT}\s*(?=\d)", ".", s)


@F.pandas_udf(StringType())
def clean_ocr(s: pd.Series) -> pd.Series:
    """:func:`ocr_text` of a column (a replacement that looks into its match is no built-in)."""
    return s.map(lambda x: None if x is None else ocr_text(x))


def outside_tables(c: Column) -> Column:
    """Text without HTML tables and pipe rows, tags stripped line by line."""
    s = F.regexp_replace(F.regexp_replace(c, r"(?is)<table\b.*?</table>", "\n"), r"<[^>]+>", "")
    return F.array_join(F.filter(F.split(s, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*\|")), "\n")


def as_markdown(rows: Column, most: int = 60) -> Column:
    """Rows as pipe lines, the first as header; a note where rows were left out of the rendering."""
    lines = F.transform(F.slice(rows, 1, most), lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(rows, F.lit(0)))))
    more = F.when(F.size(rows) > most, F.concat(F.lit("\n… "), (F.size(rows) - most).cast("string"), F.lit(" more rows"))).otherwise("")
    return F.when(F.size(rows) > 0, F.concat(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, most)), "\n"), more)).otherwise("")


def extracted(files: DataFrame, read: Callable[[bytes], dict]) -> DataFrame:
    """``files(path, content)`` to ``(report_id, text, tables, pages, error)`` by an injected reader; an error is a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, raw in zip(b.path, b.content):
                try:
                    got = read(raw)
                    out.append((path, got.get("text", ""), got.get("tables", []), got.get("pages", 0), None))
                except Exception as e:  # one bad file must not stop the others
                    out.append((path, "", [], 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["report_id", "text", "tables", "pages", "error"]).astype({"pages": "int32"})

    return files.select("path", "content").mapInPandas(run, "report_id string, text string, tables array<array<array<string>>>, pages int, error string")
