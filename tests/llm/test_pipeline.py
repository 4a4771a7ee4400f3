"""The pipeline on a small folder: order of stages, what goes and what stays."""

import random

import corpus_pipeline
from assayframe.llm import common, near_copies
from test_llm_operators import DOCS, prose


def folder(spark, tmp_path):
    r = random.Random(1)
    texts, quality = [], []
    for i in range(240):
        t = prose(i, r.randint(60, 140))
        junk = i % 8 == 0
        texts.append(" ".join(w + "###" for w in t.split()) if junk else t)
        quality.append(int(not junk))
    items = [prose(800 + i, 40) for i in range(6)]
    texts += [texts[1], texts[2], prose(500, 60) + " " + items[2] + " " + prose(501, 60), prose(502, 70) + " mail me at jo.do@mail.example.org now " + prose(503, 30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([*enumerate(items)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return quality


def test_run(spark, tmp_path):
    quality = folder(spark, tmp_path)
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    good = [i for i, q in enumerate(quality) if q]
    assert len(set(good) - set(rows)) <= 2 and sum(i in rows for i, q in enumerate(quality) if not q) <= 2
    assert 240 not in rows and 241 not in rows and 242 not in rows and 243 in rows
    assert "[EMAIL]" in rows[243].text and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows.values())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_dedup_finds_every_pair_of_similarity(spark):
    texts, r = [], random.Random(9)
    for i in range(60):
        w = prose(1000 + i, 200).split()
        texts.append(" ".join(w))
        for at in r.sample(range(10, 190, 12), 1 + i % 8):
            w[at] = f"other{at}"
        texts.append(" ".join(w))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, prose(2000, 60), "en", "s", 1), (None, prose(2001, 60), "en", "s", 1)]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    for i in range(0, 120, 2):
        a, b = shingles(texts[i]), shingles(texts[i + 1])
        assert i in kept and (i + 1 in kept) == (len(a & b) < 0.8 * len(a | b)), i


def test_near_dedup_brings_few_unlike_texts_together(spark, monkeypatch):
    """Texts of similarity 0.24 meet in few buckets: such meetings grow with the square of the texts, and carry shingle sets."""
    same = prose(3000, 60)
    rows = [(i, same + " " + prose(3001 + i, 90), "en", "s", 1) for i in range(200)]
    stored, store = {}, common.store
    monkeypatch.setattr(common, "store", lambda df, name: stored.setdefault(name, store(df, name)))
    groups = near_copies.groups(spark.createDataFrame(rows, DOCS))
    assert groups.select("root").distinct().count() == 200
    assert stored["met"].count() < 100


def test_near_dedup_with_texts_of_few_words(spark):
    texts = ["", None, " \n ", "one", "One ", "one two", "a b c d e", "A b\nc d e", prose(4000, 300_000), prose(4000, 300_000) + " more"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert kept == {0, 3, 5, 6, 8}
