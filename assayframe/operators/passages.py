"""The passage index: articles to chunks, fact sheets, an older catalogue's text, hybrid search, web passages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import search

# Words of fact sheets.
REMINDER = "參考範圍會因檢驗單位、儀器、方法與族群而不同，請以報告印製的參考值為準；結果超出範圍時，請諮詢醫療專業人員進一步評估。"


def prepared(articles: DataFrame, denied: list[str], generic: list[str] = (), least: int = 80, size: int = 500, overlap: int = 80) -> tuple[DataFrame, DataFrame]:
    """``articles(n, title, content, tags, url, applies_to)`` to chunks with title and topics before them, and one row of counts.

    Articles off the topic, and short ones once cleaned, are dropped and counted.
    """
    x = articles.withColumn("off", F.coalesce(search.off_topic(F.col("tags"), denied), F.lit(False))).withColumn("body", search.clean(F.coalesce("content", F.lit(""))))
    x = x.withColumn("short", ~F.col("off") & (F.length("body") < least))
    counts = x.agg(F.count("*").alias("articles"), F.count_if("off").alias("offtopic_dropped"), F.count_if("short").alias("empty_dropped"))
    title = F.trim(F.replace(search.clean(F.coalesce("title", F.lit(""))), F.lit("\n"), F.lit(" ")))
    topics = F.slice(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: ~t.isin(*generic) if generic else F.lit(True)), 1, 6)
    good = x.where(~F.col("off") & ~F.col("short")).select("n", title.alias("title"), topics.alias("tags"), "url", "applies_to", "body")
    cut = search.sentence_chunks(good.select(F.col("n").cast("long").alias("doc_id"), F.col("body").alias("text")), size, overlap)
    cut = cut.select(F.col("doc_id").alias("n"), F.col("n").alias("place"), "text")
    prefix = F.concat(F.when(F.col("title") != "", F.concat(F.lit("【標題】"), "title", F.lit("\n"))).otherwise(""), F.when(F.size("tags") > 0, F.concat(F.lit("【主題】"), F.array_join("tags", "、"), F.lit("\n"))).otherwise(""))
    marks = F.filter(F.transform(F.coalesce("applies_to", F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
    chunks = good.drop("body").join(cut, "n").select(F.concat_ws("_", F.lit("kb"), "n", "place").alias("id"), F.concat(prefix, "text").alias("text"), "n", "title", F.array_join("tags", ",").alias("tags"), "url", marks.alias("applies_to"))
    return chunks, counts


def fact_sheets(items: DataFrame) -> DataFrame:
    """``items(item, zh, en, item_unit, range_m, range_f, range_text, qualitative, note, source)`` to ``(id, text, kind)``; the male range comes first."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    name = F.concat("zh", F.when(given("en") & (F.col("en") != F.col("zh")), F.concat(F.lit("（"), "en", F.lit("）"))).otherwise(""))
    split = given("range_m") | given("range_f")
    ranges = F.array_compact(F.array(
        F.when(given("range_m"), F.concat(F.lit("男性 "), "range_m")), F.when(given("range_f"), F.concat(F.lit("女性 "), "range_f")),
        F.when(~split & given("range_text"), F.col("range_text")), F.when(given("qualitative"), F.concat(F.lit("定性結果以「"), "qualitative", F.lit("」為正常"))),
    ))
    lines = F.array_compact(F.array(
        F.concat(F.lit("【檢查項目】"), name),
        F.when(F.size(ranges) > 0, F.concat(F.lit("【一般參考範圍】"), F.array_join(ranges, "；"), F.lit("（成人篩檢參考，非診斷標準）"))),
        F.when(given("note"), F.concat(F.lit("【說明】"), "note")), F.lit("【提醒】" + REMINDER), F.when(given("source"), F.concat(F.lit("【資料來源】"), "source")),
    ))
    return items.select(F.concat(F.lit("fact_"), "item").alias("id"), "item", F.array_join(lines, "\n").alias("text"), F.lit("fact").alias("kind"))


def legacy_items(entries: DataFrame, known: DataFrame) -> DataFrame:
    """``entries(n, content)`` of an older catalogue: named items with their printed range; those that ``known(name, item)`` lacks get a key of their own.

    The first entry of a name counts.
    """
    name = F.trim(F.regexp_extract("content", r"【檢查項目】\s*([^\n【]+)", 1))
    ref = F.trim(F.regexp_extract("content", r"【正常參考範圍】\s*([^\n【]+)", 1))
    x = entries.select("n", name.alias("name"), ref.alias("ref_text")).where("name <> ''")
    x = x.withColumn("__n", F.row_number().over(Window.partitionBy("name").orderBy("n"))).where("__n = 1").drop("__n")
    zh = F.trim(F.get(F.split("name", "（"), F.lit(0)))
    x = x.withColumns({"zh": zh, "en": F.trim(F.regexp_extract("name", r"（([^）]*)）", 1)), "key": T.name_key(zh)})
    have = known.select(T.name_key(F.col("name")).alias("key"), "item").distinct()
    got = x.join(have.groupBy("key").agg(F.min("item").alias("item")), "key", "left")
    return got.select("n", "name", "zh", "en", "ref_text", F.coalesce("item", F.concat(F.lit("kb_"), "n")).alias("item"), F.col("item").isNotNull().alias("is_known"))


def sheet_of(names: DataFrame, sheets: DataFrame) -> DataFrame:
    """``names(name)`` with the fact sheet of that name: by lower-cased name, the first sheet that has it."""
    first = Window.partitionBy("key").orderBy("place")
    table = sheets.select(F.lower(F.trim("alias")).alias("key"), "place", "id").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "place")
    return names.withColumn("key", F.lower(F.trim("name"))).join(table, "key", "left").drop("key")


def hybrid(docs: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, asked: DataFrame | None = None, mode: str = "hybrid", k: int = 10, deep: int = 50) -> DataFrame:
    """``(query_id, rank, id, score)``: keyword search, vector search, or both fused; without vectors keywords alone serve.

    ``docs(doc_id, text)``, ``queries(query_id, text)``, ``vectors(vec_id, embedding)``, ``asked(query_id, embedding)``.
    Each ranking is cut to ``deep`` per query before they meet.
    """
    mode = mode if vectors is not None and asked is not None else "bm25"
    words = lambda n: search.bm25(docs, queries, n).select("query_id", F.col("doc_id").alias("id"), "rank", "score")
    near = lambda n: search.dense(vectors, asked, n).select("query_id", F.col("vec_id").alias("id"), "rank", (1 - F.col("distance")).alias("score"))
    if mode != "hybrid":
        return words(k) if mode == "bm25" else near(k)
    return search.fuse(words(deep).unionByName(near(deep)), k)


def reranked(hits: DataFrame, score: Callable[[DataFrame], DataFrame], k: int = 5) -> DataFrame:
    """The seam of a reranker: ``score`` adds ``relevance`` to ``hits(query_id, id, ...)``; its top ``k`` per query."""
    return search.top(score(hits).drop("rank"), "query_id", [F.desc("relevance"), "id"], k)


def with_web(chunks: DataFrame, web: DataFrame) -> DataFrame:
    """``chunks(report_id, pos, id, kind)`` with one web passage a finding, after the fact sheets and before the rest; ``pos`` anew."""
    first = Window.partitionBy("report_id", "for_finding").orderBy("pos")
    one = web.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("report_id", "pos", "id", F.lit("web").alias("kind"))
    x = chunks.select("report_id", "pos", "id", "kind").unionByName(one)
    order = F.when(F.col("kind") == "fact", 0).when(F.col("kind") == "web", 1).otherwise(2)
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("report_id").orderBy(order, "pos", "id")))


def collection_name(model: Column) -> Column:
    """A model's name as the name of its index."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(model), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 60)
