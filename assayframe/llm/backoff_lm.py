"""Language-model scores by a weighted backoff automaton.

Training counts cover all training documents, and every word, pair and triple that occurs at least
``least`` times there (words: once) is the model's, so the model grows with the input. A state is an
n-gram context, an arc a word with its probability, and each state has one failure arc, to its
longest proper suffix, weighted with the mass that absolute discounting left over. At the root a word
has its add-one probability (c + 1) / (N + V + 1).

States and arcs are a table, not an object in memory. Which state a walk is in follows from the last
two words, so its sum of log10 probabilities is a sum over the text's n-grams, each with one value:

- word: its probability at the root, and the failure weight of the state it is;
- pair: its arc less that failure path, and the failure weight of the state it is;
- triple: its arc less that failure path.

N-grams that the model lacks add nothing. So texts' n-grams look up ``(key, v, base)`` by a 64-bit key
and are summed. Counts and look-ups run in shards of the keys: a chunk of text sends each shard its distinct
keys in order, with the rows they stand in, and gets back a sum a row. N-grams that hold 1/``size`` of
all tokens, of which there can be only ``size`` of an order, are broadcast as a cache, and a bitmap of
fixed size spares the shards n-grams that are not the model's; neither changes a result.
:class:`Automaton` is the same model of a small corpus in one process.

A null text counts as empty: its only token is the end. A null doc_id counts as training. Each
input row has one output row, repeated rows too; further columns are ignored; with no training rows
N and V are zero and every token has probability one.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .classifiers import held_out
from .simhash import LOWER
from .shards import Bitmap, dealt_by, mixed, pack, parts_of, runs, shard_count, shard_of, slices, tally, trim, unpack

END = b"\n"  # no word holds a line break
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def tokens(text: bytes | None) -> list[bytes]:
    words = (text or b"").translate(LOWER).split()
    words.append(END)
    return words


def _counted(docs: DataFrame, f, schema: str, flush: int = 200_000) -> DataFrame:
    """Counters filled over a task's rows and emptied whenever they grow past ``flush`` keys."""
    kind = pa.binary() if schema.startswith("token") else pa.int64()
    name = schema.split(" ")[0]

    def run(batches):
        c: Counter = Counter()
        for batch in batches:
            for t in batch.column("__text").to_pylist():
                f(c, tokens(t))
                if len(c) > flush:
                    yield out(c)
                    c = Counter()
        if c:
            yield out(c)

    def out(c):
        return pa.RecordBatch.from_pydict({name: pa.array(list(c), kind), "n": pa.array(list(c.values()), pa.int64())})

    return docs.select(F.col("text").cast("binary").alias("__text")).mapInArrow(run, schema)


class Automaton:
    """``words`` in order of their number, with counts; ``pairs`` and ``triples``: packed word numbers with counts."""

    def __init__(self, words, counts, pairs, triples, total: int, distinct: int, starts: int, discount: float = 0.75):
        self.args = (words, counts, pairs, triples, total, distinct, starts, discount)
        self.id = {w: i for i, w in enumerate(words)}
        n, log = len(words), np.log10
        self.n = max(n, 1)
        norm = log(total + distinct + 1)
        self.root = (log(np.array(counts, float) + 1) - norm).tolist() if n else []
        self.counts, self.norm = counts, float(norm)
        p_word = 10 ** np.array(self.root) if n else np.zeros(0)
        begin = self.id.get(END, 0)
        # contexts of one word: END stands for the beginning too, where it was seen `starts` times
        arcs, fail, weight = {}, [0], [0.0]
        state1: dict[int, int] = {}
        p2: dict[int, float] = {}
        left: dict[int, float] = {}
        for key, c in pairs:
            h = key // n
            left[h] = left.get(h, 0.0) + (c - discount) / (starts if h == begin else counts[h])
        for h in left:
            state1[h] = len(fail)
            fail.append(0)
            weight.append(float(log(max(1 - left[h], 1e-12))))
        for key, c in pairs:
            h, w = divmod(key, n)
            p2[key] = (c - discount) / (starts if h == begin else counts[h]) + max(1 - left[h], 1e-12) * p_word[w]
        pair_count = dict(pairs)
        state2: dict[int, int] = {}
        left2: dict[int, float] = {}
        for key, c in triples:
            g = key // n
            left2[g] = left2.get(g, 0.0) + (c - discount) / pair_count[g]
        for g in left2:
            state2[g] = len(fail)
            fail.append(state1.get(g % n, 0))
            weight.append(float(log(max(1 - left2[g], 1e-12))))
        self.after = [state1.get(i, 0) for i in range(n)]  # state after a word at the root
        for key, p in p2.items():
            h, w = divmod(key, n)
            arcs[state1[h] * self.n + w] = (float(log(p)), state2.get(key, state1.get(w, 0)))
        for key, c in triples:
            g, w = divmod(key, n)
            h = g % n
            lower = p2.get(h * n + w)
            lower = lower if lower is not None else (max(1 - left[h], 1e-12) if h in left else 1.0) * p_word[w]
            p = (c - discount) / pair_count[g] + max(1 - left2[g], 1e-12) * lower
            arcs[state2[g] * self.n + w] = (float(log(p)), state2.get(h * n + w, state1.get(w, 0)))
        self.arcs, self.fail, self.weight = arcs, fail, weight
        self.start = state1.get(begin, 0)

    def __reduce__(self):
        return Automaton, self.args

    def walk(self, words: list[bytes]) -> tuple[float, list[bytes]]:
        """log10 probability but for log10(c + 1) of the words below the bound, and those words."""
        get, arcs, fail, weight, n = self.id.get, self.arcs.get, self.fail, self.weight, self.n
        root, after = self.root, self.after
        total, s, rare = 0.0, self.start, []
        for word in words:
            w = get(word)
            if w is None:
                while s:
                    total += weight[s]
                    s = fail[s]
                rare.append(word)
                continue
            while s:
                arc = arcs(s * n + w)
                if arc is not None:
                    total += arc[0]
                    s = arc[1]
                    break
                total += weight[s]
                s = fail[s]
            else:
                total += root[w]
                s = after[w]
        return total - len(rare) * self.norm, rare


def fit(docs: DataFrame, size: int = 200_000) -> tuple[Automaton, DataFrame]:
    """The automaton, and the table ``(h, c)`` of every training word's count by its hash."""
    train = docs.where(~held_out(7, 2))
    one = _counted(train, lambda c, words: c.update(words), "token binary, n bigint")
    uni = common.store(one.groupBy("token").agg(F.sum("n").alias("c")), "words")
    total, distinct = uni.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    starts = train.count()
    least = max(2, -(-total // size))
    rows = uni.where((F.col("c") >= least) | (F.col("token") == END)).orderBy(F.desc("c"), "token").collect()
    words, counts = [bytes(r.token) for r in rows], [r.c for r in rows]
    ids, n = {w: i for i, w in enumerate(words)}, len(words)
    begin = ids.get(END)

    def numbers(words: list[bytes]) -> np.ndarray:
        return np.array([begin, *(ids.get(w, -1) for w in words)], np.int64)

    def pair(c: Counter, words: list[bytes]) -> None:
        a = numbers(words)
        keys = (a[:-1] * n + a[1:])[(a[:-1] >= 0) & (a[1:] >= 0)]
        c.update(keys.tolist())

    def often(counted: DataFrame) -> list[tuple[int, int]]:
        return [(r.k, r.n) for r in counted.groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy("k").collect()]

    pairs = often(_counted(train, pair, "k bigint, n bigint")) if n else []
    known = np.array([k for k, _ in pairs], np.int64)

    def triple(c: Counter, words: list[bytes]) -> None:
        a = numbers(words)
        keys = a[:-1] * n + a[1:]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        ok = (a[:-1] >= 0) & (a[1:] >= 0) & (known[at] == keys)
        both = ok[:-1] & ok[1:]
        c.update((keys[:-1][both] * n + a[2:][both]).tolist())

    triples = often(_counted(train, triple, "k bigint, n bigint")) if pairs and n**3 < 1 << 62 else []
    return Automaton(words, counts, pairs, triples, int(total), int(distinct), starts), uni.select(F.xxhash64("token").alias("h"), "c")


def _long(x: np.ndarray, seed) -> np.ndarray:
    h = x * _P[1]
    h = seed + _P[4] + np.uint64(8) ^ (h << np.uint64(31) | h >> np.uint64(33)) * _P[0]
    h = (h << np.uint64(27) | h >> np.uint64(37)) * _P[0] + _P[3]
    h = (h ^ h >> np.uint64(33)) * _P[1]
    h = (h ^ h >> np.uint64(29)) * _P[2]
    return h ^ h >> np.uint64(32)


def _key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``F.xxhash64(x, y)`` of two longs."""
    return _long(y, _long(x, np.uint64(42)))


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 512
_END = _long(np.frombuffer(END.ljust(8, b"\0"), "<u8"), np.uint64(len(END)))[0]


def _hashed(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and all words' hashes: eight bytes of all words at a time, seeded with the length; words of over ``_LONG`` bytes one by one."""
    size = np.array([len(t or b"") for t in texts], np.int64) + 1
    data = b" " + b" ".join([t or b"" for t in texts]).translate(LOWER) + b" " * 8
    word = ~_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, width = edge[::2], edge[1::2] - edge[::2]
    first = np.searchsorted(start, np.cumsum(size) - size + 1)
    at = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = _long(at[start] & _MASK[np.minimum(width, 8)], width.astype(np.uint64))
    done, more = 8, np.flatnonzero((width > 8) & (width <= _LONG))
    while len(more):
        h[more] = _long(at[start[more] + done] & _MASK[np.minimum(width[more] - done, 8)], h[more])
        done += 8
        more = more[width[more] > done]
    for i in np.flatnonzero(width > _LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + width[i]], 42)
    return np.diff(first, append=len(start)), h


def _grams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' words, each text after a mark of its beginning: text, place in it, hash, key of the pair that ends there."""
    words, h = _hashed(texts)
    size, text = words + 2, np.arange(len(texts))
    a = np.full(len(h) + 2 * len(texts), _END)
    a[np.arange(len(h)) + 2 * np.repeat(text, words) + 1] = h
    row = np.repeat(text, size)
    place = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
    pair = np.zeros(len(a), np.uint64)
    pair[1:] = _key(a[:-1], a[1:])
    return row, place, a, pair


def table(docs: DataFrame, least: int = 2, discount: float = 0.75, parts: int | None = None) -> tuple[DataFrame, int, float]:
    """States and arcs of the whole model as ``(key, v, base, n)``, all tokens, and the root's norm; ``base`` only of words."""
    train = docs.where(~held_out(7, 2)).select(F.col("text").cast("binary").alias("__text"))

    def low(batch):
        _, place, a, _ = _grams(batch.column("__text").to_pylist())
        at = np.flatnonzero(place > 0)
        return (1, [a[at]]), (2, [a[at - 1], a[at]])

    counted = common.store(tally(train, low, least, 2_000_000, add=mixed, parts=parts), "counts")
    common.release(docs.sparkSession)
    words = counted.where("o = 1").select(F.col("x").alias("h"), F.col("n").alias("c"))
    pairs = counted.where("o = 2").select(F.xxhash64("x", "y").alias("key"), "x", "y", "n")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    norm = float(np.log10(total + distinct + 1))
    seen = Bitmap(pairs, "key", 27)

    def high(batch):
        _, place, _, pair = _grams(batch.column("__text").to_pylist())
        has = seen.has(pair)
        at = np.flatnonzero(place > 1)
        at = at[has[at] & has[at - 1]]
        return ((3, [pair[at - 1], pair[at]]),)

    triples = common.store(tally(train, high, least, 2_000_000, add=mixed, parts=parts).drop("o"), "triples")
    common.release(docs.sparkSession)

    def step(df: DataFrame, *done: DataFrame) -> DataFrame:
        """``df`` stored; ``done`` are stored tables that nothing reads after it."""
        out = common.store(df, "states")
        for x in done:
            common.drop(x)
        common.release(docs.sparkSession)
        return out

    left = lambda given, of: F.greatest(1 - F.coalesce(given, F.lit(0.0)) / F.col(of), F.lit(1e-12))
    given = pairs.groupBy(F.col("x").alias("h")).agg(F.sum(F.col("n") - discount).alias("m"))
    words = words.join(given, "h", "left").select("h", "c", (F.log10(F.col("c") + 1.0)).alias("base"), left("m", "c").alias("fail"))
    words = common.store(words, "states")
    context = words.select(F.col("h").alias("x"), "c", "fail")
    word = words.select(F.col("h").alias("y"), F.pow(F.lit(10.0), F.col("base") - norm).alias("p1"))
    given = triples.groupBy(F.col("x").alias("key")).agg(F.sum(F.col("n") - discount).alias("m"))
    # one join a step, as each step's shuffle can go before the next one's
    beside = step(pairs.join(context, "x").select("key", "y", "n", ((F.col("n") - discount) / F.col("c")).alias("own"), F.col("fail").alias("f")), counted)
    p = F.col("own") + F.col("f") * F.col("p1")
    arcs = step(beside.join(word, "y").select("key", "n", p.alias("p"), (F.log10(p) - F.log10("p1") - F.log10("f")).alias("v")), beside)
    arcs = step(arcs.join(given, "key", "left").select("key", "n", "p", "v", left("m", "n").alias("fail")), arcs)
    g = arcs.select(F.col("key").alias("x"), F.col("n").alias("c"), "fail")
    lower = arcs.select(F.col("key").alias("y"), F.col("p").alias("p1"))
    beside = step(triples.join(g, "x").select("x", "y", "n", ((F.col("n") - discount) / F.col("c")).alias("own"), F.col("fail").alias("f")), triples)
    more = step(beside.join(lower, "y").select(F.xxhash64("x", "y").alias("key"), (F.log10(p) - F.log10("p1") - F.log10("f")).alias("v"), "n"), beside)
    none = F.lit(None).cast("double").alias("base")
    whole = words.select(F.col("h").alias("key"), (F.col("base") + F.log10("fail")).alias("v"), "base", F.col("c").alias("n"))
    whole = whole.unionByName(arcs.select("key", (F.col("v") + F.log10("fail")).alias("v"), none, "n")).unionByName(more.select("key", "v", none, "n"))
    return step(whole, words, arcs, more), int(total), norm


_KINDS = pa.schema([("s", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_SHARDED = "s int, kind int, chunk bigint, a binary, b binary, c binary"
_MODEL, _ASK, _ROWS, _SUM = range(4)
_MOST_ROWS = 1 << 16


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_KINDS)], schema=_KINDS)


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _back(data: bytes, kind) -> np.ndarray:
    """What :func:`_planes` was given, to write to: a single value's bytes would else be a view of ``data``."""
    return np.array(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T, order="C").view(kind).ravel()


def _packed(model: DataFrame, shards: int) -> DataFrame:
    """The model's rows, dealt to shards: keys, values, and words' counts."""

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            parts.append(tuple(batch.column(n).to_numpy(zero_copy_only=False).copy() for n in ("key", "v", "c")))
            size += batch.num_rows
            if size > 500_000:
                yield dealt(parts)
                parts, size = [], 0
        if size:
            yield dealt(parts)
        trim()

    def dealt(parts):
        key, v, c = (np.concatenate(x) for x in zip(*parts))
        key = key.astype(np.int64).view(np.uint64)
        order = np.argsort(key)
        key, v, c = key[order], v[order], c[order].astype(np.int64)
        cut = np.searchsorted(shard_of(key, shards), np.arange(shards + 1)).tolist()
        return _batch([(s, _MODEL, -1, pack(key[i:j]), _planes(v[i:j]), _planes(c[i:j])) for s, (i, j) in enumerate(zip(cut, cut[1:])) if j > i])

    return model.select("key", "v", F.when(F.col("base").isNull(), 0).otherwise(F.col("n")).alias("c")).mapInArrow(run, _SHARDED)


def _asked(docs: DataFrame, cache: tuple, seen: Bitmap, shards: int, flush: int = 1_000_000) -> DataFrame:
    """For each chunk of texts: what the cache knows of its rows, and the keys it asks the shards for, with the rows they stand in."""
    key, v, base = cache

    def run(batches):
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        rows, keys, where, n, held = [], [], [], 0, 0
        for batch in batches:
            for some in slices(batch, "__text"):
                ids = some.column("doc_id")
                for at in range(0, some.num_rows, _MOST_ROWS // 4):
                    part = some.slice(at, _MOST_ROWS // 4)
                    if n + part.num_rows > _MOST_ROWS or held > flush:
                        yield from sent(chunk, rows, keys, where)
                        chunk, rows, keys, where, n, held = chunk + 1, [], [], [], 0, 0
                    known, rest, row = look(part.column("__text").to_pylist())
                    own = ids.slice(at, part.num_rows)
                    rows.append((own.fill_null(0).to_numpy(zero_copy_only=False), own.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), *known))
                    keys.append(rest)
                    where.append((row + n).astype(np.uint16))
                    n += part.num_rows
                    held += len(rest)
        if n:
            yield from sent(chunk, rows, keys, where)
        trim()

    def look(texts: list):
        row, place, a, pair = _grams(texts)
        one, three = np.flatnonzero(place > 0), np.flatnonzero(place > 1)
        keys = np.concatenate([a[one], pair[one], _key(pair[three - 1], pair[three])])
        rows, n = np.concatenate([row[one], row[one], row[three]]), len(texts)
        at = np.minimum(np.searchsorted(key, keys), max(len(key) - 1, 0))
        hit = key[at] == keys if len(key) else np.zeros(len(keys), bool)
        found, inside = at[hit], rows[hit]
        word = ~np.isnan(base[found])
        known = (
            np.bincount(row[one], minlength=n), np.bincount(inside[word], minlength=n),
            np.bincount(inside[word], base[found][word], n), np.bincount(inside, v[found], n),
        )
        rest = np.flatnonzero(~hit & seen.has(keys))
        return known, keys[rest], rows[rest]

    def sent(chunk, rows, keys, where):
        keys, where = np.concatenate(keys), np.concatenate(where)
        order = np.argsort(keys, kind="stable")
        keys, where = keys[order], where[order]
        new = np.append(runs(keys), len(keys))
        cut = np.searchsorted(shard_of(keys[new[:-1]], shards), np.arange(shards + 1)).tolist()
        of = b"".join(_planes(np.concatenate(c).astype(k)) for c, k in zip(zip(*rows), ("i8", "i8", "i8", "i8", "f8", "f8")))
        out = [(hash(chunk) % shards, _ROWS, chunk, of, None, None)]
        for s, (i, j) in enumerate(zip(cut, cut[1:])):
            if j > i:
                out.append((s, _ASK, chunk, pack(keys[new[i:j]]), _planes(np.diff(new[i : j + 1]).astype(np.uint16 if len(keys) < 1 << 16 else np.uint32)), _planes(where[new[i] : new[j]])))
        yield _batch(out)

    return docs.select("doc_id", F.col("text").cast("binary").alias("__text")).mapInArrow(run, _SHARDED)


def _answered(dealt: DataFrame, number: int) -> DataFrame:
    """A partition's part of the model answers its chunks in turn, with a sum for each row."""

    def run(batches):
        model, parts, chunk, sums = None, [], None, None
        for batch in batches:
            for kind, c, a, b, w in zip(*(batch.column(n).to_pylist() for n in ("kind", "chunk", "a", "b", "c"))):
                if kind == _MODEL:
                    parts.append((unpack(a), _back(b, "f8"), _back(w, "i8")))
                elif kind == _ROWS:
                    yield _batch([(0, _ROWS, c, a, None, None)])
                elif parts or model is not None:
                    if model is None:
                        model, parts = joined(parts), []
                    if c != chunk:
                        if chunk is not None:
                            yield told(chunk, sums)
                        chunk, sums = c, (np.zeros(_MOST_ROWS), np.zeros(_MOST_ROWS), np.zeros(_MOST_ROWS, np.int64))
                    add(sums, model, unpack(a), b, _back(w, "u2"))
        if chunk is not None:
            yield told(chunk, sums)
        trim()

    def joined(parts):
        key, v, c = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key)
        return key[order], v[order], c[order]

    def add(sums, model, keys, times, rows):
        key, v, c = model
        times = _back(times, "u2" if len(times) == 2 * len(keys) else "u4").astype(np.int64)
        at = np.minimum(np.searchsorted(key, keys), len(key) - 1)
        hit = np.repeat(key[at] == keys, times)
        at, rows = np.repeat(at, times)[hit], rows[hit]
        sums[0][:] += np.bincount(rows, v[at], _MOST_ROWS)
        word = c[at] > 0
        sums[1][:] += np.bincount(rows[word], np.log10(c[at][word] + 1.0), _MOST_ROWS)
        sums[2][:] += np.bincount(rows[word], minlength=_MOST_ROWS)

    def told(chunk, sums):
        one, two = np.flatnonzero(sums[0]), np.flatnonzero(sums[2])
        first = _planes(one.astype(np.uint16)) + _planes(sums[0][one])
        known = sums[2][two]
        known = known.astype(np.uint32 if known.max(initial=0) >> 16 else np.uint16)
        return _batch([(0, _SUM, chunk, first, _planes(two.astype(np.uint16)) + _planes(sums[1][two]), _planes(known))])

    return dealt_by(dealt, number, "s").sortWithinPartitions("kind", "chunk").mapInArrow(run, _SHARDED)


def _summed(answers: DataFrame, number: int) -> DataFrame:
    """One row for each text of a chunk."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("v", pa.float64())])

    def run(batches):
        now, own, sums = None, None, []
        for batch in batches:
            for kind, chunk, a, b, c in zip(*(batch.column(n).to_pylist() for n in ("kind", "chunk", "a", "b", "c"))):
                if chunk != now:
                    if own is not None:
                        yield out(own, sums)
                    now, own, sums = chunk, None, []
                if kind == _ROWS:
                    own = a
                else:
                    sums.append((a, b, c))
        if own is not None:
            yield out(own, sums)

    def out(own, sums):
        n = len(own) // 48
        ids, valid, size, known, base, v = (_back(own[8 * n * k : 8 * n * (k + 1)], t) for k, t in enumerate(("i8", "i8", "i8", "i8", "f8", "f8")))
        for a, b, c in sums:
            k = len(a) // 10
            v[_back(a[: 2 * k], "u2")] += _back(a[2 * k :], "f8")
            k = len(b) // 10
            rows = _back(b[: 2 * k], "u2")
            base[rows] += _back(b[2 * k :], "f8")
            known[rows] += _back(c, "u2" if len(c) == 2 * k else "u4")
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), *map(pa.array, (size, known, base, v))], schema=schema)

    return dealt_by(answers, number, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base double, v double")


def score(docs: DataFrame, size: int = 200_000, least: int = 2, waves: int = 3) -> DataFrame:
    """The contract's columns, one row per input row.

    Texts look up the model in ``waves`` parts, by a hash of id and text, one after the other: the disk holds the look-ups of one part.
    """
    number = parts_of(docs)
    whole, total, norm = table(docs, least, parts=number)
    often, shards = max(1, -(-total // size)), shard_count(number)
    cache = whole.where(F.col("n") >= often).select("key", "v", "base").toArrow()
    key = cache.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    held = key[order], cache.column("v").to_numpy()[order], cache.column("base").to_numpy()[order].astype(float)
    model = whole.where(F.col("n") < often)
    seen = Bitmap(model.select("key"), "key", 27)
    common.release(docs.sparkSession)
    parts = []
    for wave in range(waves):
        some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(waves)) == wave)
        parts.append(common.store(_summed(_answered(_packed(model, shards).unionByName(_asked(some, held, seen, shards)), number), number), "scored"))
        common.release(docs.sparkSession)
    common.drop(whole)
    scored = reduce(DataFrame.unionByName, parts)
    less = F.col("n_tokens") * norm
    return scored.select(
        "doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - less).alias("base_score"), (F.col("v") - less).alias("score"),
    )
