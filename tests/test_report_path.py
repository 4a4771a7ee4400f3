"""From report text to results, and the operators around a model's answer, on literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from assayframe.__main__ import main
from assayframe.operators import extract, metrics, passages, prose, review
from assayframe.plans import report
from assayframe.settings import Settings

TEXT = "性別：女\n檢查日期：2024-03-01\n血紅素 10.4 g/dL (12~16)\nLDL低密度脂蛋白 171 mg/dL (<130)\n腹部超音波：輕度脂肪肝\n姓名 王某 72\n"
TABLES = "array<array<array<string>>>"


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([("r1", TEXT, None), ("r2", "", None), ("r3", None, None)], f"report_id string, text string, tables {TABLES}")


@pytest.mark.parametrize(
    "line, want",
    [
        ("T-BIL 總膽紅素 0.8 mg/dL 0.2~1.2", [("T-BIL 總膽紅素", "0.8", "mg/dL", "0.2~1.2")]),
        ("＊AST(GOT) 麩草酸轉胺酶： 61↑ U/L 參考值 <38", [("AST(GOT) 麩草酸轉胺酶", "61 ↑", "U/L", "<38")]),
        ("RBC紅血球 4.4 ^6/μL 3.9~5.3 7", [("RBC紅血球", "4.4", "^6/μL", "3.9~5.3")]),
        ("裸視[左眼] 0.7 L (0.9～2.0 ) (二頻)左耳聽力2K HZ 35 H (0～25 dB)", [("裸視[左眼]", "0.7 L", "", "(0.9~2.0 )"), ("(二頻)左耳聽力2K HZ", "35 H", "", "(0~25 dB)")]),
        ("PLT 212 MCV 88.5", [("PLT", "212", "", ""), ("MCV", "88.5", "", "")]),
        ("報到時間 09:45 2024/05/06", []),
    ],
)
def test_lines_with_bare_ranges_and_neighbours(line, want):
    assert extract.from_line(line) == want


@pytest.mark.parametrize("raw, clean", [("2 0 7 · 5", "207.5"), ("3 · 5 ~ 5 · 1", "3.5 ~ 5.1"), ("Glucose 92 70-100", "Glucose 92 70-100"), ("钠 钾 钙 肾", "鈉 鉀 鈣 腎"), ("&gt;60", ">60"), ("6.1 10^3/uL", "6.1 10^3/uL")])
def test_recognised_text(raw, clean):
    assert extract.ocr_text(raw) == clean


def test_cells_of_several_lines():
    assert extract.from_table([["項目", "結果", "參考標準"], ["尿蛋白", "300(3\n+) H", "(-)"], ["游離甲狀腺素fre\ne", "1.1", "0.8~1.9"]]) == [("尿蛋白", "300(3+) H", "", "(-)"), ("游離甲狀腺素free", "1.1", "", "0.8~1.9")]


def test_analyze(spark, texts):
    heard = []
    chunks = spark.createDataFrame([("k1", "低密度脂蛋白偏高時少吃油炸。", "care", ["ldl:high"])], "id string, text string, kind string, applies_to array<string>")
    got = report.analyze(texts, chunks=chunks, generate=lambda xs: ['{"summary": "ok", "food": [{"text": "少油", "src": "kb:k1"}, {"text": "cut'] * len(xs), on_stage=heard.append)
    found = {r.item: (r.status, r.sex) for r in got.findings.collect()}
    assert found == {"hb": ("low", "F"), "ldl": ("high", "F")} and heard == ["extract", "findings", "rules", "retrieve", "model"]
    assert {r.text for r in got.tags.where("category = 'condition'").collect()} == {"血脂異常", "貧血"}
    shown = got.context.orderBy("pos").collect()
    assert [r.id for r in shown] == ["fact_hb", "fact_ldl", "k1"] and "【檢查項目】" in shown[0].text and "女性 12~16" in shown[0].text
    assert {(r.report_id, r.category, r.text, r.conf) for r in got.answers.collect()} == {(r, "food", "少油", 0.8) for r in ("r1", "r2", "r3")}
    view = json.loads(report.compact(got).first().view)
    assert view["n_items_parsed"] == 2 and [f["item"] for f in view["abnormal_findings"]] == ["hb", "ldl"] and "超音波" not in json.dumps(view, ensure_ascii=False)
    assert report.documents(got, chunks).count() == 3
    assert [(r.item, r.lo, r.hi) for r in report.lookup_range(spark, ["血紅素", "no such"], "F").orderBy("pos").collect()] == [("hb", 12.0, 16.0), (None, None, None)]


def test_bundle(texts):
    rows = report.analyze(texts).bundles().collect()
    assert len(rows) == 1
    b = json.loads(rows[0].bundle)
    patient, diagnostic, *obs = (e["resource"] for e in b["entry"])
    assert (patient["gender"], diagnostic["effectiveDateTime"]) == ("female", "2024-03-01")
    assert [r["reference"] for r in diagnostic["result"]] == [e["fullUrl"] for e in b["entry"][2:]]
    hb = obs[0]
    assert hb["subject"]["reference"] == b["entry"][0]["fullUrl"] and hb["interpretation"][0]["coding"][0]["code"] == "L" and hb["category"][0]["coding"][0]["code"] == "laboratory"
    assert hb["valueQuantity"] == {"value": 10.4, "unit": "g/dL", "system": "http://unitsofmeasure.org", "code": "g/dL"} and hb["referenceRange"][0]["text"] == "(12~16)"
    assert rows == report.analyze(texts).bundles().collect()  # ids follow from the report alone


def test_batch_command(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(TEXT)
    assert main([f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--fhir"], spark) == 0
    assert spark.read.csv(f"{tmp_path}/out/findings", header=True).count() == 2 and spark.read.json(f"{tmp_path}/out/fhir").count() == 1


def test_prose(spark, texts):
    got = report.analyze(texts)
    cut = {r.report_id: r for r in prose.without_results(texts.select("report_id", "text"), got.findings).collect()}
    assert cut["r1"].n_dropped == 2 and "超音波" in cut["r1"].prose and "171" not in cut["r1"].prose and cut["r2"].n_dropped == 0 and cut["r3"].prose == ""
    said = spark.createDataFrame([("r1", "脂肪肝"), ("r1", "膽結石"), ("r1", "血紅素 偏低")], "report_id string, text string")
    body = prose.without_results(texts.select("report_id", "text"), got.findings)
    assert [r.text for r in prose.stated(said, body, prose.finding_names(got.findings)).collect()] == ["脂肪肝"]
    rows = spark.createDataFrame([("姓名", True, False), ("某酵素", False, True), ("x", True, True), ("某酵素", False, False), (None, True, True)], "n string, a boolean, b boolean")
    assert [r.k for r in rows.select(prose.item_candidate(F.col("n"), F.col("a"), F.col("b")).alias("k")).collect()] == [False, True, False, False, False]


def test_partial_answers(spark):
    raw = '{"summary": "短\\"句", "text_conditions": [{"text": " 脂肪肝 "}], "food": [{"text": "魚", "src": "kb:a"}, {"text": ""}, {"te'
    x = spark.createDataFrame([("r", raw), ("s", None), ("t", "not json")], "report_id string, answer string")
    assert [(r.category, r.pos, r.text, r.src) for r in prose.partial(x).collect()] == [("summary", 0, '短"句', None), ("text_conditions", 0, "脂肪肝", "report"), ("food", 0, "魚", "kb:a")]


def test_rewrite_round(spark):
    tags = [("r", "food", 0, "多吃肉", "kb:a", 0.8, False), ("r", "food", 1, "多喝水", "kb:a", 0.8, True), ("r", "avoid", 2, "熬夜", "kb:a", 0.8, False), ("r", "condition", 3, "貧血", "kb:a", 0.8, False), ("r", "avoid", 4, "酒", "kb:b", 0.8, False)]
    tags = spark.createDataFrame(tags, "report_id string, category string, pos int, text string, src string, conf double, verdict boolean")
    answers = spark.createDataFrame([("r", 0, "revise", " 吃豆類 ", "kb:b"), ("r", 2, "revise", "熬夜", "kb:a"), ("r", 4, "revise", "x" * 40, "kb:b")], "report_id string, pos int, action string, text string, src string")
    allowed = spark.createDataFrame([("r", "kb:a"), ("r", "kb:b")], "report_id string, src string")
    after, log = review.rewrite_loop(tags, lambda wanted: answers, lambda new: new.withColumn("verdict", F.lit(True)), allowed)
    assert {(r.pos, r.text) for r in after.collect()} == {(0, "吃豆類"), (1, "多喝水")}
    assert {(r.pos, r.action) for r in log.collect()} == {(0, "revise"), (2, "unchanged"), (4, "invalid_revision")}


def test_review_and_canned(spark):
    rule = spark.createDataFrame([("r", "condition", "貧血"), ("r", "risk", "痛風")], "report_id string, category string, text string")
    asked = spark.createDataFrame([("r", "risk", "痛風"), ("r", "risk", "別的")], "report_id string, category string, text string")
    tags = rule.unionByName(spark.createDataFrame([("r", "risk", "別的")], rule.schema))
    assert {r.text for r in review.reviewed(tags, rule, asked).collect()} == {"貧血", "別的"}
    both = spark.createDataFrame([("r",), ("s",)], "report_id string")
    assert [r.report_id for r in review.waiting(both, rule, rule.limit(0)).collect()] == ["r"]
    got = {(r.report_id, r.text) for r in review.canned(both, rule).collect()}
    assert ("r", "富含鐵質食物") in got and ("s", "均衡飲食") in got and ("r", "均衡飲食") not in got


def test_passages(spark):
    rows = [(0, "標題", "內容。" * 60, ["血脂", "通用"], "u", [" ldl:high ", ""]), (1, "x", "短", [], "u", []), (2, "y", "長" * 200, ["美容"], "u", None)]
    chunks, counts = passages.prepared(spark.createDataFrame(rows, "n int, title string, content string, tags array<string>, url string, applies_to array<string>"), ["美容"], ["通用"])
    got = chunks.collect()
    assert [r.id for r in got] == ["kb_0_0"] and got[0].text.startswith("【標題】標題\n【主題】血脂\n") and got[0].applies_to == ["ldl:high"]
    assert tuple(counts.first()) == (3, 1, 1)
    old = spark.createDataFrame([(0, "【檢查項目】血紅素（Hb）\n【正常參考範圍】12~16"), (1, "【檢查項目】某酵素（EnzX）\n【正常參考範圍】<9"), (2, "nothing")], "n int, content string")
    known = spark.createDataFrame([("血紅素", "hb")], "name string, item string")
    assert {(r.item, r.zh, r.en, r.ref_text, r.is_known) for r in passages.legacy_items(old, known).collect()} == {("hb", "血紅素", "Hb", "12~16", True), ("kb_1", "某酵素", "EnzX", "<9", False)}
    c = spark.createDataFrame([("r", 1, "f", "fact"), ("r", 2, "k", "care")], "report_id string, pos int, id string, kind string")
    web = spark.createDataFrame([("r", 1, "w1", "hb"), ("r", 2, "w2", "hb")], "report_id string, pos int, id string, for_finding string")
    assert [r.id for r in passages.with_web(c, web).orderBy("pos").collect()] == ["f", "w1", "k"]


def test_evaluation(spark):
    facets = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", "x")], "sample_id string, facet string")
    assert metrics.set_cover(facets, ["z", "q"], 2) == (["a", "b"], ["q"])
    text = spark.createDataFrame([("r", "hb", "10"), ("r", "ldl", "99")], "report_id string, item string, value string")
    scan = spark.createDataFrame([("heavy", "r", "hb", "16")], "level string, report_id string, item string, value string")
    pages = spark.createDataFrame([("heavy", "r", 9.0, 3)], "level string, report_id string, seconds double, pages int")
    r = metrics.scan_summary(text, scan, pages).first()
    assert (r.items, r.exact, r.misread, r.missing, r.seconds_a_page, r.value_accuracy) == (2, 0, 1, 1, 3.0, 0.0)
    assert [(r.item, r.n) for r in metrics.most_misread(text, scan).collect()] == [("hb", 1)]
    spread = metrics.spread(spark.range(100).withColumnRenamed("id", "k"), 4, "k").collect()
    assert len(spread) == 4 and metrics.spread(spark.range(3).withColumnRenamed("id", "k"), 9, "k").count() == 3
    faulty = spark.createDataFrame([("a", "名", "u", 2.0, 1.0), ("b", "", "", 1.0, None), ("b", "名", "u", None, None)], "item string, zh string, unit string, lo double, hi double")
    assert {tuple(r) for r in metrics.faults(faulty).collect()} == {("a", "bounds the wrong way round"), ("b", "no name"), ("b", "range without unit"), ("b", "repeated key")}
    out = spark.createDataFrame([("t", "call ＡＢＣ now")], "id string, text string")
    assert [tuple(r) for r in metrics.leaked(out, spark.createDataFrame([("abc",), ("zzz",)], "term string")).collect()] == [("t", "abc")]


def test_settings():
    got = Settings.load({"ASSAYFRAME_REPORT_CHARS": "10", "ASSAYFRAME_VERIFY_REWRITE": "no", "ASSAYFRAME_RULES": "1"})
    assert (got.report_chars, got.verify_rewrite, got.rules, got.context_chars) == (10, False, True, 3500)
