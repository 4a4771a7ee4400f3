"""Operators on small literal inputs."""

import json

from pyspark.sql import functions as F

from assayframe.operators import extract, fhir, findings, metrics, rules, search, trends, verify
from assayframe.sources import reports


def test_report_to_findings(spark):
    text = "性別：女\n血紅素 11.0 g/dL\nLDL低密度脂蛋白 309 (<130mg/dL)\nGlucose 5.8 mmol/L\nAnti-HBs 125.0 (<10 IU/L)\n尿酸 7.2 (男:4.4-7.6 女:2.3-6.6 mg/dL)\n備註 正常"
    raw = spark.createDataFrame([("r1", text, [[["尿蛋白", "2+", "(-)"]]])], "report_id string, text string, tables array<array<array<string>>>")
    sex = spark.createDataFrame([("r1", "F")], "report_id string, sex string")
    found, unmatched = findings.evaluate(extract.records(raw), sex)
    got = {r.item: (r.status, r.range_source) for r in found.collect()}
    assert got["hb"] == ("low", "reference") and got["ldl"] == ("high", "report") and got["glucose_ac"] == ("high", "reference")
    assert got["anti_hbs"][0] == "normal" and got["uric_acid"] == ("high", "report") and got["urine_protein"] == ("positive", "report")
    assert {r.sex_source for r in found.collect()} == {"header"}


def rule_rows(spark, values, sex=None):
    rows = [("r", sex, i, k, k.upper(), str(v), float(v) if not isinstance(v, str) else None, s, "u") for i, (k, v, s) in enumerate(values)]
    return spark.createDataFrame(rows, "report_id string, sex string, pos int, item string, display string, value_text string, value_num double, status string, unit string").withColumn("direction", F.col("status"))


def derived(spark, values, sex=None):
    return {(r.category, r.text): r for r in rules.derive(rule_rows(spark, values, sex)).collect()}


def test_rules(spark):
    got = derived(spark, [("waist", 85, "normal"), ("sbp", 131, "high"), ("glucose_ac", 101, "high"), ("tg", 151, "high"), ("hdl", 45, "low"), ("bmi", 27, "high")], "F")
    assert ("condition", "代謝症候群") in got and got["condition", "代謝症候群"].evidence.startswith("符合 5/5")
    assert ("condition", "糖尿病前期") in got and ("condition", "血壓偏高") in got and ("condition", "肥胖") in got
    assert got["risk", "心血管疾病"].evidence == "血脂異常"
    male = derived(spark, [("waist", 85, "normal"), ("hdl", 45, "low"), ("glucose_ac", 0, "low")], None)
    assert ("condition", "代謝症候群") not in male
    thyroid = derived(spark, [("tsh", 9, "high"), ("t4", 2, "low")])
    assert ("condition", "甲狀腺功能低下") in thyroid
    last = derived(spark, [("ldl", 200, "high"), ("ldl", 90, "normal")])
    assert not last
    assert ("condition", "B型肝炎帶原") in derived(spark, [("hbsag", "陽性", "positive")])


def test_merge_tags(spark):
    x = spark.createDataFrame([([("a高血壓",)], [("高血壓",), ("貧血",), ("貧血症",)])], "o array<struct<text:string>>, l array<struct<text:string>>")
    assert [s.text for s in x.select(rules.merge_tags(F.col("o"), F.col("l")).alias("m")).first().m] == ["a高血壓", "貧血"]


def test_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, ""), (4, None)], "doc_id bigint, text string")
    q = spark.createDataFrame([(7, "beta"), (8, "zzz")], "query_id bigint, text string")
    assert [(r.query_id, r.doc_id) for r in search.bm25(docs, q).collect()] == [(7, 1)]
    text = "First sentence here. " * 60
    parts = search.sentence_chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")).collect()
    assert len(parts) > 1 and all(len(p.text) <= 500 for p in parts) and all(p.text.endswith(".") for p in parts)
    cjk = spark.createDataFrame([("高血壓 LDL",)], "t string").select(search.words(F.col("t")).alias("w")).first().w
    assert cjk == ["ldl", "高血", "血壓"]


def test_verification(spark):
    tags = spark.createDataFrame([("r", "advice", 0, "少吃鹽", "kb:p1", 0.8), ("r", "advice", 1, "多運動", "kb:zz", 0.8), ("r", "condition", 2, "肝硬化", "report", 0.8)], "report_id string, category string, pos int, text string, src string, conf double")
    passages = spark.createDataFrame([("p1", "高血壓患者應少吃鹽。")], "id string, text string")
    said = spark.createDataFrame([("r", "血壓偏高")], "report_id string, text string")
    got = {r.pos: r for r in verify.verify(tags, passages, said).collect()}
    assert got[0].verdict is True and got[1].verdict is False and got[2].src == "inferred" and abs(got[2].conf - 0.48) < 1e-9
    packed = verify.pack(spark.createDataFrame([("r", i, "x" * 2000) for i in range(5)], "report_id string, pos int, text string")).collect()
    assert [r.batch for r in sorted(packed, key=lambda r: r.pos)] == [0, 0, 1, 1, 2]

    def call(xs):
        if any("bad" in x for x in xs):
            raise ValueError
        return [x.upper() for x in xs]

    out = verify.with_model(spark.createDataFrame([("a",), ("bad",), ("c",)], "prompt string").coalesce(1), call).collect()
    assert [r.answer for r in out] == ["A", None, "C"]


def test_greedy_match(spark):
    pred = spark.createDataFrame([("s", "c", 0, "高血壓"), ("s", "c", 1, "糖尿病前期"), ("s", "c", 2, "x")], "sample_id string, category string, pos int, text string")
    gold = spark.createDataFrame([("s", "c", 0, "糖尿病", []), ("s", "c", 1, "高血壓", []), ("s", "c", 2, "貧血", ["y"])], "sample_id string, category string, pos int, text string, synonyms array<string>")
    got = {(r.pred, r.gold) for r in metrics.greedy_match(pred, gold).collect()}
    assert got == {("高血壓", "高血壓"), ("糖尿病前期", "糖尿病"), ("x", None), (None, "貧血")}


def test_bundle_and_sinks(spark, tmp_path):
    x = findings.parsed(spark.createDataFrame([("r", 1, "ldl", "<5", "", "mg/dL", "normal", "mg/dL"), ("r", 0, "hb", "陰性", "", "g/L", "unknown", "g/dL")], "report_id string, pos int, item string, value_text string, ref_text string, unit string, status string, item_unit string"))
    b = json.loads(fhir.bundles(fhir.observations(x)).first().bundle)
    patient, diagnostic, first, second = (e["resource"] for e in b["entry"])
    assert (patient["resourceType"], patient["gender"], diagnostic["resourceType"]) == ("Patient", "unknown", "DiagnosticReport")
    assert first["valueString"] == "陰性" and "valueQuantity" not in first and "coding" not in first["code"] or first["code"]["text"] == "hb"
    assert second["valueQuantity"] == {"value": 5.0, "comparator": "<", "unit": "mg/dL", "system": "http://unitsofmeasure.org", "code": "mg/dL"}
    assert reports.one_csv(spark.createDataFrame([(1, "a")], "x int, y string")) == b"\xef\xbb\xbfx,y\r\n1,a\r\n"
    (tmp_path / "a.PDF").write_bytes(b"%PDF one")
    (tmp_path / "b.txt").write_bytes(b"no")
    files = reports.read_pdfs(spark, str(tmp_path))

    def read(raw):
        raise ValueError("broken")

    got = extract.extracted(files, read).collect()
    assert len(got) == 1 and got[0].error == "ValueError: broken"
    runs = spark.createDataFrame([("r1", "p1", "2024-01-01")], "report_id string, patient string, day string")
    reports.append_runs(runs, f"{tmp_path}/runs")
    reports.append_runs(runs.withColumn("model", F.lit("m")), f"{tmp_path}/runs")
    assert "model" in reports.read_runs(spark, f"{tmp_path}/runs").columns
    assert trends.forget(runs, runs).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from assayframe.streaming import trends as streaming

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("user_id as patient", "event_type as item", "cast(ts as timestamp) as ts", "value as value_num")
    src.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    q = streaming.daily(stream).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, streaming.daily(src).collect()))
    assert sorted(map(tuple, spark.table("daily").collect())) == want and want


def test_dense_holds_queries_against_all_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((400, 8)), 3)
    x[100:160] = x[7]  # copies of one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 8), (402, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    queries = vectors.where("vec_id % 20 = 0 or vec_id = 7").selectExpr("vec_id as query_id", "embedding")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for block in (20_000, 5):
        got = {}
        for r in search.dense(vectors, queries, 5, block).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.distance)
        assert len(got) == 22
        for q in [*range(0, 400, 20), 7]:
            d = np.round(1 - unit @ unit[q], 6)
            best = sorted((v, i) for i, v in enumerate(d.tolist()))[:5]
            assert [got[q][k + 1][0] for k in range(5)] == [i for _, i in best]
            assert np.allclose([got[q][k + 1][1] for k in range(5)], [v for v, _ in best], atol=1.1e-6)
        assert [got[400][k + 1] for k in range(5)] == [(i, None) for i in range(5)]
    few = vectors.where("vec_id >= 398")
    assert [r.vec_id for r in search.dense(few, few.where("vec_id = 398").selectExpr("vec_id as query_id", "embedding")).orderBy("rank").collect()][2:] == [400, 401, 402]


def test_closest_ids_of_a_label(spark):
    rows = [(3 * i + i % 2, i % 4 if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int")
    asked = df.where("vec_id % 10 = 0").selectExpr("vec_id as query_id", "label")
    want = sorted((q, k + 1, i, abs(i - q)) for q, ql in rows if q % 10 == 0 and ql is not None for k, i in enumerate(sorted((i for i, x in rows if x == ql), key=lambda i: (abs(i - q), i))[:6]))
    for block in (20_000, 4):
        assert sorted((r.query_id, r.rank, r.id, r.gap) for r in search.closest(df, asked, 6, block).collect()) == want
