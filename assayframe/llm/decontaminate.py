"""Benchmark decontamination by latent semantic retrieval, then alignment.

Documents are cut into passages of two neighbouring blocks of ``block`` words, one starting in each
block. Passages and benchmark items become TF-IDF vectors over the items' terms (a passage's other
terms meet no item), with document frequencies counted over all documents. A randomised SVD gives the
latent space: executors multiply their part of the passage matrix with a random test matrix and with
its own transpose, and only the sums of (terms x rank) numbers come back. Every passage of every
document is then held against all items, in blocks, by cosine; that is a stated query set, not a join
of the corpus with itself. Candidates are verified on the words around the passage: longest common
subsequence with the item, and the presence of its answer, the item's most telling terms, so
that paraphrases count and texts on the same subject do not. As no pair passes without its answer,
answers are counted first, for all passages at once, and cosines are taken of the pairs that have one.

The space is fitted on all passages of all documents and on the items, in one pass over whole texts;
a large corpus weighs no more against the items than ``worth`` documents would.
The benchmark is the one table collected; ``most_items`` is its stated bound and is checked.

Null texts count as empty and match nothing; null ids, repeated rows and empty tables are fine;
items without words match nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shards import slices, trim

#: Power of the inverse document frequency in vectors: words that all texts share hardly count.
POWER = 3.0
_PAGE = 4096  # terms whose sums travel in one row
_PLAIN = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    text = text or b""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode("utf-8", "replace")
    return text.translate(_PLAIN).split()


def lcs(item: list[bytes], passage: list[bytes]) -> int:
    """Length of the longest common subsequence of words, bit-parallel."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in passage:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class Matcher:
    """The verification of one candidate."""

    def __init__(self, items: list[list[bytes]], idf: dict[bytes, float], share: float, short: int, short_share: float, answer_share: float):
        self.items, self.share, self.short, self.short_share, self.answer_share = items, share, short, short_share, answer_share
        rare = [sorted(set(w), key=lambda x: (-idf.get(x, 0.0), x)) for w in items]
        self.answers = [frozenset(r[: max(1, len(r) // 4)]) for r in rare]

    def check(self, doc: list[bytes], at: int, span: int, k: int) -> tuple[float, float] | None:
        """Best (aligned share, answer share) near ``at``, or None if the text does not hold the item."""
        item = self.items[k]
        need = self.share if len(item) >= self.short else self.short_share
        around = doc[max(0, at - len(item)) : at + span + len(item)]
        answer = self.answers[k]
        if len(answer.intersection(around)) < self.answer_share * len(answer) or lcs(item, around) < need * len(item):
            return None
        width, best = len(item) + len(item) // 2 + 2, (0.0, 0.0)
        for s in range(0, max(1, len(around) - width + 1 + len(item) // 8), max(1, len(item) // 8)):
            part = around[s : s + width]
            got = lcs(item, part) / len(item), len(self.answers[k].intersection(part)) / len(self.answers[k])
            best = max(best, got)
        return best if best[0] >= need and best[1] >= self.answer_share else None


class Space:
    """Terms, weights and the latent basis; ``items`` are unit rows."""

    def __init__(self, terms: dict[bytes, int], basis: np.ndarray, items: np.ndarray, block: int):
        self.terms, self.basis, self.items, self.block = terms, basis, items, block
        self.of: np.ndarray | None = None  # made from the first matcher: which items' answers a term is part of

    def blocks(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Term numbers and the block each stands in; each document's first block; all blocks."""
        get, ids, sizes = self.terms.get, [], []
        for w in docs:
            ids += [get(x, -1) for x in w]
            sizes.append(len(w))
        sizes = np.array(sizes, np.int64)
        per = -(-sizes // self.block)
        first = np.cumsum(np.append(0, per))[:-1]
        inner = np.arange(len(ids)) - np.repeat(np.cumsum(np.append(0, sizes))[:-1], sizes)
        where = np.repeat(first, sizes) + inner // self.block
        ids = np.array(ids, np.int64)
        known = ids >= 0
        return ids[known], where[known], first, int(per.sum())

    def possible(self, ids: np.ndarray, where: np.ndarray, first: np.ndarray, n: int, match: Matcher) -> tuple[np.ndarray, np.ndarray]:
        """Blocks and items where the words around a passage hold the item's answer: all pairs that verification can accept."""
        if self.of is None:
            held = [[self.terms[w] for w in a if w in self.terms] for a in match.answers]
            pairs = sorted((t, k) for k, ts in enumerate(held) for t in ts)
            self.ptr = np.searchsorted([t for t, _ in pairs], np.arange(len(self.terms) + 1)).astype(np.int64)
            self.of = np.array([k for _, k in pairs], np.int64)
            self.need = np.array([max(1, np.ceil(match.answer_share * len(a))) for a in match.answers], np.int64)
            self.long = np.array([len(x) for x in match.items], np.int64)
        times = self.ptr[ids + 1] - self.ptr[ids]
        item = self.of[np.repeat(self.ptr[ids] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        block, term = np.repeat(where, times), np.repeat(ids, times)
        k, t = len(self.need), len(self.terms)
        seen = np.unique((block * k + item) * t + term)
        block, item, term = seen // (t * k), seen // t % k, seen % t
        begin = np.searchsorted(first, np.arange(n), "right")  # a number for each document
        back, on = 2 + (self.long[item] - 1) // self.block, -(-self.long[item] // self.block)
        around = [np.zeros(0, np.int64)]
        for s in range(-int(back.max(initial=0)), int(on.max(initial=0)) + 1):
            to = block + s
            ok = (s >= -back) & (s <= on) & (to >= 0) & (to < n)
            ok[ok] = begin[to[ok]] == begin[block[ok]]
            around.append((to[ok] * k + item[ok]) * t + term[ok])
        pair, held = np.unique(np.unique(np.concatenate(around)) // t, return_counts=True)
        pair = pair[held >= self.need[pair % k]]
        return pair // k, pair % k

    def search(self, docs: list[list[bytes]], cosine: float, match: Matcher | None = None) -> list[tuple[int, int, int, float]]:
        """``(document, word, item, cosine)`` of the passages at or above ``cosine``; with ``match``, of those that it could accept."""
        ids, where, first, n = self.blocks(docs)
        if not len(ids):
            return []
        last = np.zeros(n + 1, bool)
        last[np.append(first[1:], n)[np.diff(np.append(first, n)) > 0] - 1] = True
        if match is None:
            at, items = np.divmod(np.arange(n * len(self.items)), len(self.items))
        else:
            at, items = self.possible(ids, where, first, n, match)
        if not len(at):
            return []
        need = np.zeros(n + 1, bool)
        need[at] = True
        need[at[~last[at]] + 1] = True
        spot = np.cumsum(need) - 1
        ids, where = ids[need[where]], spot[where[need[where]]]
        rows = np.zeros((spot[-1] + 2, self.basis.shape[1]), np.float32)
        if len(ids):
            start = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            rows[where[start]] = np.add.reduceat(self.basis[ids], start, axis=0)
        out = []
        for i in range(0, len(at), 1 << 18):  # the pairs' cosines, in blocks
            b, k = at[i : i + (1 << 18)], items[i : i + (1 << 18)]
            z = rows[spot[b]] + np.where(last[b], 0, 1)[:, None] * rows[spot[b] + 1]
            sim = np.einsum("ij,ij->i", z, self.items[k]) / (np.linalg.norm(z, axis=1) + 1e-12)
            good = np.flatnonzero(sim >= cosine)
            b, k = b[good], k[good]
            doc = np.searchsorted(first, b, "right") - 1
            out += zip(doc.tolist(), ((b - first[doc]) * self.block).tolist(), k.tolist(), sim[good].tolist())
        return out


def _chunks(texts: list, size: int = 200_000):
    part, n = [], 0
    for i, t in enumerate(texts):
        part.append((i, words(t)))
        n += len(part[-1][1])
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def fit(docs: DataFrame, items: list[list[bytes]], rank: int, block: int, worth: int) -> tuple[Space, dict[bytes, float]]:
    terms = {w: i for i, w in enumerate(sorted({w for x in items for w in x}))}
    space = Space(terms, np.zeros((len(terms), 1)), np.zeros((0, 1)), block)

    def count(cols: dict, texts: list) -> dict:
        df, total = np.zeros(len(terms) + 1, np.int64), 0
        for part in _chunks(texts):
            ids, where, _, n = space.blocks([w for _, w in part])
            df += np.bincount(np.unique(where * (len(terms) + 1) + ids) % (len(terms) + 1), minlength=len(terms) + 1)
            total += n
        df[-1] = total
        found = np.flatnonzero(df)
        return {"term": found.tolist(), "n": df[found].tolist()}

    df = np.zeros(len(terms) + 1)
    for r in common.map_text(docs, [], count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term] = r.n
    total, df = df[-1], df[:-1]
    weight = np.log((2 + total) / (1 + df)) ** POWER
    idf = {w: float(weight[i]) for w, i in terms.items()}
    rank = min(rank, len(terms))
    test = np.random.default_rng(7).standard_normal((len(terms), min(len(terms), rank + 16)))
    basis = Space(terms, np.zeros((len(terms), 1)), np.zeros((0, 1)), block)

    def sketch(texts: list[list[bytes]]) -> np.ndarray:
        """Aᵀ(A Ω) of the passages, one per block, with unit TF-IDF rows."""
        ids, where, _, n = basis.blocks(texts)
        if not len(ids):
            return np.zeros_like(test)
        start = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        w = weight[ids]
        norm = np.sqrt(np.add.reduceat(w * w, start))
        w = w / np.repeat(norm, np.diff(np.append(start, len(ids))))
        y = np.add.reduceat(w[:, None] * test[ids], start, axis=0)
        row = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(ids))))
        order = np.argsort(ids, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
        out = np.zeros_like(test)
        out[ids[order][cut]] = np.add.reduceat(w[order, None] * y[row[order]], cut, axis=0)
        return out

    def part(batches):
        out, n = np.zeros_like(test), 0
        for batch in batches:
            n += batch.num_rows
            for some in slices(batch, "t"):
                for few in _chunks(some.column("t").to_pylist(), 20_000):
                    out += sketch([w for _, w in few])
        at = range(0, len(out), _PAGE)
        yield pa.RecordBatch.from_pydict(
            {"page": pa.array([-1, *at], pa.int64()), "m": pa.array([np.int64(n).tobytes(), *(out[i : i + _PAGE].tobytes() for i in at)], pa.binary())}
        )
        trim()

    def summed(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, m in zip(batch.column("page").to_pylist(), batch.column("m").to_pylist()):
                m = np.frombuffer(m, np.int64 if page < 0 else np.float64)
                sums[page] = sums[page] + m if page in sums else m
        yield pa.RecordBatch.from_pydict({"page": pa.array(list(sums), pa.int64()), "m": pa.array([m.tobytes() for m in sums.values()], pa.binary())})

    parts = docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(part, "page bigint, m binary")
    n, corpus = 0, np.zeros_like(test)
    for r in parts.repartition("page").sortWithinPartitions("page", "m").mapInArrow(summed, "page bigint, m binary").toLocalIterator():
        if r.page < 0:
            n = int(np.frombuffer(r.m, np.int64)[0])
        else:
            corpus[r.page : r.page + _PAGE] = np.frombuffer(r.m, np.float64).reshape(-1, test.shape[1])
    # the items shape the space, as they are what is looked for: a large corpus weighs no more against them than ``worth`` documents
    total_sketch = sketch(items) * 10 + corpus * min(1.0, worth / max(n, 1))
    # Nystrom: C ~ B (Ωᵀ B)⁻¹ Bᵀ from the one pass, then its leading eigenvectors
    shift = 1e-6 * np.linalg.norm(total_sketch)
    b = total_sketch + shift * test
    core = test.T @ b
    chol = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * np.trace(core) / len(core) * np.eye(len(core)))
    u, s, _ = np.linalg.svd(np.linalg.solve(chol, b.T).T, full_matrices=False)
    basis = (weight[:, None] * u[:, :rank]).astype(np.float32)
    rows = np.zeros((len(items), rank), np.float32)
    for i, item in enumerate(items):
        known = [terms[w] for w in item if w in terms]
        if known:
            rows[i] = basis[known].sum(0)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True) + 1e-12
    return Space(terms, basis, rows, block), idf


def leaks(
    docs: DataFrame, benchmark: DataFrame, rank: int = 64, block: int = 32, cosine: float = 0.1, worth: int = 10_000,
    share: float = 0.5, short: int = 16, short_share: float = 0.8, answer_share: float = 0.5, most_items: int = 50_000,
) -> DataFrame:
    """``(doc_id, key, item_id, cosine, aligned, answer)``: one row per document and item it holds.

    ``key`` is the text's hash, for documents whose doc_id repeats.
    """
    schema = "doc_id bigint, key bigint, item_id bigint, cosine double, aligned double, answer double"
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("t")).limit(most_items + 1).collect()
    if len(rows) > most_items:
        raise ValueError(f"benchmark has over {most_items} items; split it")
    rows = sorted({(r.item_id, bytes(r.t or b"")) for r in rows if r.item_id is not None})
    rows = [(i, w) for i, t in rows if (w := words(t))]
    if not rows:
        return docs.sparkSession.createDataFrame([], schema)
    names, items = [i for i, _ in rows], [w for _, w in rows]
    space, idf = fit(docs, items, rank, block, worth)
    match = Matcher(items, idf, share, short, short_share, answer_share)

    def run(cols: dict, texts: list) -> dict:
        out: dict[str, list] = {x.split(" ")[0]: [] for x in schema.split(", ")}
        for part in _chunks(texts, 100_000):
            best: dict[tuple, tuple] = {}
            for d, at, k, c in space.search([w for _, w in part], cosine, match):
                got = match.check(part[d][1], at, 2 * block, k)
                if got and got > best.get((d, k), ((0.0, 0.0), 0.0))[0]:
                    best[d, k] = got, c
            for (d, k), (got, c) in best.items():
                i = part[d][0]
                for n, v in zip(out, (cols["doc_id"][i], cols["key"][i], names[k], c, *got)):
                    out[n].append(v)
        return out

    return common.map_text(docs.withColumn("key", F.xxhash64("text")), ["doc_id", "key"], run, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    found = common.store(leaks(docs, benchmark, **options).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct(), "leaks")
    same = docs.doc_id.eqNullSafe(found["__id"]) & (F.xxhash64(docs.text) == found["__key"])
    return docs.join(found, same, "left_anti")
