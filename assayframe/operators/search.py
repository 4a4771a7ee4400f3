"""Passages: chunks, keyword and vector search, fusion, assembly, budget."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def clean(c: Column, drop_lines: str = r"(?m)^.*(?:延伸閱讀|版權所有|All rights reserved).*$") -> Column:
    """Text without boilerplate lines and URLs, blank lines collapsed."""
    s = F.regexp_replace(F.regexp_replace(c, drop_lines, ""), r"https?://[^\s]+", "")
    return F.trim(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def fixed_chunks(docs: DataFrame, size: int = 500, overlap: int = 80) -> DataFrame:
    """``(doc_id, n, text)``: windows of fixed stride over whole texts, no shuffle."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - overlap) / step) - 1).cast("int")
    return docs.where(F.length("text") > 0).select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substr("text", i * step + 1, F.lit(size)))).alias("n", "text"))


def _sentence_cuts(text: str, size: int, overlap: int, least: int) -> list[str]:
    if len(text) <= size:
        return [text] if text else []
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            for stop in ("\n\n", "\n", "。", ". ", "；", "，", " "):
                found = text.rfind(stop, at + size // 2, end)
                if found >= 0:
                    end = found + len(stop)
                    break
        part = text[at:end].strip()
        if len(part) > least:
            out.append(part)
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def sentence_chunks(docs: DataFrame, size: int = 500, overlap: int = 80, least: int = 40) -> DataFrame:
    """``(doc_id, n, text)``: windows that end at a paragraph, sentence or word where the second half has one.

    Each start depends on the end before, so this runs per document in Arrow batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, c) for d, t in zip(b.doc_id, b.text) if t for i, c in enumerate(_sentence_cuts(t, size, overlap, least))]
            yield pd.DataFrame(rows, columns=["doc_id", "n", "text"]).astype({"n": "int32"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, n int, text string")


def words(c: Column) -> Column:
    """Terms of a text: lower-cased runs of letters and digits, and pairs of neighbouring CJK characters."""
    latin = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9À-ɏ]+)"), 1)
    cjk = F.regexp_extract_all(c, F.lit(r"([㐀-鿿]+)"), 1)
    pairs = F.flatten(F.transform(cjk, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))))
    return F.concat(latin, pairs)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: top ``k`` documents per query, scores above zero.

    Only the queries' terms are counted; statistics are those of the whole corpus. Documents' terms
    are reduced to the queries' before the shuffle where these are few enough to be broadcast, which Spark
    decides by their size; counts and scores share one exchange of the terms.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    terms = asked.select("term").distinct()
    tokens = docs.select("doc_id", words(F.col("text")).alias("w"))
    sized = tokens.select("doc_id", F.size("w").alias("len"), "w")
    total = sized.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    tf = sized.select("doc_id", "len", F.explode("w").alias("term")).join(terms, "term").groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n, avg = F.col("n"), F.col("avg_len")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg))
    scored = tf.join(df, "term").withColumn("n", total.select("n").scalar()).withColumn("avg_len", total.select("avg_len").scalar())
    scored = scored.select("term", "doc_id", part.alias("part")).join(asked, "term")
    scored = scored.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")
    return top(scored, "query_id", [F.desc("score"), "doc_id"], k)


def top(scored: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """Top ``k`` rows of each group with their ``rank``; Spark limits each group before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


class _Kept:
    """The ``k`` best of each query so far, by key and then id; rows that can't be among them are turned away by ``bound``."""

    def __init__(self, n: int, k: int):
        self.k, self.bound, self.rows = k, np.full(n, np.inf), None

    def add(self, query: np.ndarray, key: np.ndarray, ids: pa.Array) -> None:
        if not len(query):
            return
        new = pa.table({"q": query.astype(np.int64), "d": key.astype(float), "id": ids})
        rows = new if self.rows is None else pa.concat_tables([self.rows, new])
        rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("d", "ascending"), ("id", "ascending")])).combine_chunks()
        q, d = rows["q"].to_numpy(), rows["d"].to_numpy()
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        full = place == self.k - 1
        self.bound[q[full]] = d[full]
        self.rows = rows.filter(pa.array(place < self.k))

    def out(self, names: pa.Array) -> pa.RecordBatch:
        r = self.rows.combine_chunks()
        return pa.RecordBatch.from_arrays([names.take(_one(r["q"])), _one(r["id"]), _one(r["d"])], names=["query_id", "vec_id", "distance"])


def _one(c: pa.ChunkedArray) -> pa.Array:
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)


def _first(ids: pa.Array, k: int) -> pa.Array:
    return ids.take(pc.sort_indices(ids)[:k])


class _Cosine:
    """Queries of one block, held against batches of vectors; rows without a cosine come last, with none."""

    def __init__(self, names: pa.Array, x: pa.Array, k: int):
        self.dim = int(pc.max(pc.list_value_length(x)).as_py() or 0)
        self.names, self.k, self.kept = names, k, _Kept(len(names), k)
        self.good, self.x = self.units(x)
        self.bad = np.setdiff1d(np.arange(len(names)), self.good)
        self.odd, self.all = None, None  # lowest ids of the vectors that meet no query, and of all vectors

    def units(self, x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have a direction, and their unit vectors."""
        good = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(x), self.dim), False).to_numpy(zero_copy_only=False)) if self.dim else np.zeros(0, int)
        y = pc.list_flatten(x.take(pa.array(good))).to_numpy(zero_copy_only=False).astype(float).reshape(len(good), self.dim)
        size = np.sqrt(np.einsum("ij,ij->i", y, y))
        fine = np.isfinite(size) & (size > 0)
        return good[fine], y[fine] / size[fine, None]

    def see(self, ids: pa.Array, x: pa.Array) -> None:
        good, y = self.units(x)
        if len(self.bad):
            self.all = _first(ids if self.all is None else pa.concat_arrays([self.all, ids]), self.k)
        if len(good) < len(ids):
            odd = ids.take(pa.array(np.setdiff1d(np.arange(len(ids)), good)))
            self.odd = _first(odd if self.odd is None else pa.concat_arrays([self.odd, odd]), self.k)
        if not len(good) or not len(self.good):
            return
        ids = ids.take(pa.array(good))
        # of equal vectors the k lowest ids are enough
        row = np.ascontiguousarray(y).view(np.dtype((np.void, y.shape[1] * 8))).ravel()
        _, first, same = np.unique(row, return_index=True, return_inverse=True)
        if len(first) < len(y):
            lower = np.empty(len(y), int)
            lower[pc.sort_indices(ids).to_numpy()] = np.arange(len(y))
            order = np.lexsort((lower, same))
            start = np.searchsorted(same[order], np.arange(len(first)))
            order = order[np.arange(len(y)) - start[same[order]] < self.k]
            ids, y = ids.take(pa.array(order)), y[order]
        step = max(1, (1 << 21) // len(y))
        for at in range(0, len(self.good), step):
            query = self.good[at : at + step]
            d = 1 - self.x[at : at + step] @ y.T
            bound = self.kept.bound[query]
            if len(y) > self.k and np.isinf(bound).any():
                bound = np.minimum(bound, np.partition(d, self.k - 1, 1)[:, self.k - 1])
            i, j = np.nonzero(d <= (bound + 1e-6)[:, None])
            d = np.floor(np.abs(d[i, j]) * 1e6 + 0.5) * np.sign(d[i, j]) / 1e6 + 0.0
            self.kept.add(query[i], d, ids.take(pa.array(j)))

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.kept.rows is not None:
            yield self.kept.out(self.names)
        short = self.good[np.isinf(self.kept.bound[self.good])]
        for queries, ids in ((short, self.odd), (self.bad, self.all)):
            if len(queries) and ids is not None:
                none = pa.nulls(len(queries) * len(ids), pa.float64())
                yield pa.RecordBatch.from_arrays([self.names.take(pa.array(np.repeat(queries, len(ids)))), pa.concat_arrays([ids] * len(queries)), none], names=["query_id", "vec_id", "distance"])


class _Closest:
    """Queries of one block, and the ids nearest to theirs with the same label."""

    def __init__(self, names: pa.Array, x: pa.Array, k: int):
        self.names, self.k, self.kept = names, k, _Kept(len(names), k)
        self.q, self.labels = names.to_numpy(), x.to_numpy(zero_copy_only=False)

    def see(self, ids: pa.Array, x: pa.Array) -> None:
        v, labels, out = ids.to_numpy(), x.to_numpy(zero_copy_only=False), []
        for label in np.unique(labels).tolist():
            query, some = np.flatnonzero(self.labels == label), np.sort(v[labels == label])
            at = np.searchsorted(some, self.q[query])[:, None] + np.arange(-self.k, self.k)
            i, j = np.nonzero((at >= 0) & (at < len(some)))
            got, query = some[at[i, j]], query[i]
            gap = np.abs(got - self.q[query])
            near = gap <= self.kept.bound[query]
            out.append((query[near], gap[near], got[near]))
        if out:
            query, gap, got = (np.concatenate(c) for c in zip(*out))
            self.kept.add(query, gap, pa.array(got, ids.type))

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.kept.rows is not None:
            yield self.kept.out(self.names)


def _against(vectors: DataFrame, queries: DataFrame, make, k: int, block: int, piece: int = 500_000) -> DataFrame:
    """``(query_id, vec_id, distance)``: the best ``k`` of each query in each cell.

    Queries ``(query_id, x)`` are dealt to blocks of about ``block`` rows and vectors ``(vec_id, x)`` to slices of
    ``piece`` at most. A cell is one block against one slice: it holds its queries, and vectors stream past them.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    blocks = max(1, -(-queries.count() // block))
    slices = max(1, -(-n // piece), min(spark.sparkContext.defaultParallelism, -(-n // 10_000)))
    types = {c: t for df in (queries, vectors) for c, t in df.dtypes}
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    none = lambda c: F.lit(None).cast(types[c]).alias(c)
    asked = queries.select(F.lit(0).alias("kind"), "query_id", none("vec_id"), "x", deal("query_id", blocks).alias("b"), every(slices).alias("s"))
    held = vectors.select(F.lit(1).alias("kind"), none("query_id"), "vec_id", "x", every(blocks).alias("b"), deal("vec_id", slices).alias("s"))
    cells = asked.unionByName(held).repartitionById(blocks * slices, F.col("b") * slices + F.col("s")).sortWithinPartitions("kind").drop("b", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, state = [], [], None
        for batch in batches:
            cut = batch.num_rows - int(pc.sum(batch.column("kind")).as_py() or 0)  # queries come first
            if cut:
                names.append(batch.column("query_id").slice(0, cut))
                parts.append(batch.column("x").slice(0, cut))
            if cut < batch.num_rows and names:
                state = state or make(pa.concat_arrays(names), pa.concat_arrays(parts), k)
                state.see(batch.column("vec_id").slice(cut), batch.column("x").slice(cut))
        if state:
            yield from state.out()

    return cells.mapInArrow(run, f"query_id {types['query_id']}, vec_id {types['vec_id']}, distance double")


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 20_000) -> DataFrame:
    """``(query_id, rank, vec_id, distance)``: exact cosine top ``k`` of a stated query set, held against all rows in blocks.

    Distances have six digits; ties go to the lower id. A vector that is null, zero, of another length or not
    finite has no distance, and comes last.
    """
    kind = "array<float>" if {vectors.schema["embedding"].dataType.simpleString(), queries.schema["embedding"].dataType.simpleString()} == {"array<float>"} else "array<double>"
    v, q = (df.select(c, F.col("embedding").cast(kind).alias("x")) for df, c in ((vectors, "vec_id"), (queries, "query_id")))
    order = [F.col("distance").asc_nulls_last(), F.col("vec_id").asc_nulls_last()]
    return top(_against(v, q, _Cosine, k, block), "query_id", order, k)


def closest(rows: DataFrame, queries: DataFrame, k: int = 10, block: int = 20_000) -> DataFrame:
    """``(query_id, rank, id, gap)``: of ``rows(vec_id, label)`` with a query's label, the ``k`` whose ids are nearest to ``query_id``; ids and labels are whole numbers."""
    x = F.col("label").cast("bigint").alias("x")
    v = rows.where("vec_id is not null and label is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), x)
    q = queries.where("query_id is not null and label is not null").select(F.col("query_id").cast("bigint").alias("query_id"), x)
    near = _against(v, q, _Closest, k, block).select("query_id", F.col("vec_id").alias("id"), F.col("distance").cast("bigint").alias("gap"))
    return top(near, "query_id", ["gap", "id"], k)


def fuse(rankings: DataFrame, k: int = 10, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ``(query_id, id, rank)`` rows of any number of rankings; ranks start at 1."""
    x = rankings.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 5).alias("score"), F.min("rank").alias("best"))
    return top(x, "query_id", [F.desc("score"), "best", "id"], k).drop("best")


def routed(findings: DataFrame, chunks: DataFrame, conditions: DataFrame | None = None) -> DataFrame:
    """``(report_id, item, id)``: chunks whose tags name the finding's item and status, or a condition it leads to."""
    tags = chunks.select("id", F.explode("applies_to").alias("token"))
    tokens = findings.select("report_id", "item", F.explode(F.array("item", F.concat_ws(":", "item", "status"))).alias("token"))
    if conditions is not None:
        tokens = tokens.unionByName(conditions.select("report_id", "item", F.concat(F.lit("cond:"), "text").alias("token")))
    return tokens.join(tags, "token").select("report_id", "item", "id").distinct()


def round_robin(hits: DataFrame) -> DataFrame:
    """``(report_id, finding_pos, rank, id, kind)`` merged: fact sheets, then every finding's first hit, then second hits; first of an id wins."""
    order = [F.when(F.col("kind") == "fact", 0).otherwise(1), "rank", "finding_pos", "id"]
    first = Window.partitionBy("report_id", "id").orderBy(*order)
    x = hits.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("report_id").orderBy(*order)))


def within_budget(blocks: DataFrame, budget: int = 3500) -> DataFrame:
    """The longest prefix of each report's blocks whose lengths sum to the budget or less."""
    run = Window.partitionBy("report_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("used", F.sum(F.length("text").cast("long")).over(run)).where(F.col("used") <= budget)


def off_topic(tags: Column, denied: list[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*[F.lit(t) for t in denied]))


def overlap_share(reports: DataFrame, corpus: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, hits, total, share)``: share of a text's word runs whose hash the corpus holds too."""

    def runs(df: DataFrame, key: list[str]) -> DataFrame:
        w = df.select(*key, F.filter(F.split(F.lower("text"), r"[^a-zÀ-ɏ]+"), lambda x: x != "").alias("w")).where(F.size("w") >= size)
        return w.select(*key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.array_join(F.slice("w", i + 1, size), " ")))).alias("run"))

    own = runs(reports, ["doc_id"])
    known = runs(corpus, []).distinct().withColumn("hit", F.lit(1))
    x = own.join(known, "run", "left").groupBy("doc_id").agg(F.count("hit").alias("hits"), F.count("*").alias("total"))
    return x.withColumn("share", F.round(F.col("hits") / F.col("total"), 6))


def dictionary_words(text: str, terms: list[str]) -> list[str]:
    """Longest-match segmentation by a term list, for callers with their own dictionary."""
    return re.findall("|".join(map(re.escape, sorted(terms, key=len, reverse=True))) + r"|\w+", text) if terms else re.findall(r"\w+", text)
