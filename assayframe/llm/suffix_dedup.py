"""Exact removal of repeated byte strings, by a run-length compressed Burrows-Wheeler index.

A byte goes if some string of ``length`` bytes that covers it also starts earlier: in a document of
smaller doc_id, or earlier in the same one. Matches never cross documents and are judged on the
input, not on what is left.

Equal strings of that length share their anchors, the grams of lowest hash in a window, at the same
place. So anchors route the work, with no pair of documents ever formed:

1. Texts are cut into segments of some anchors, with all bytes that a string around those could reach.
   Every occurrence of the same segment but the first goes whole, and its anchors are done with.
2. Hashes of the other anchors, with some bytes on either side, are counted in shards. Repeated ones carry a hash of their own
   surroundings; again every occurrence but the first goes whole. What the scan has to know of earlier
   steps are bitmaps of fixed size; what they let through by mistake costs work, not correctness.
3. The first occurrences of different surroundings around one anchor meet, in blocks of whole
   anchors. A block is indexed by its Burrows-Wheeler transform in runs (:class:`RunIndex`), and its
   texts are streamed over that index from their ends: each backward step gives the row of the next
   string, and the sampled runs of its class tell whether it starts earlier elsewhere.
4. An anchor with more than ``hot`` different surroundings is not gathered in a task: each of its
   strings of ``length`` bytes is a key of its own, and keys meet in an aggregate.

A document is a doc_id with its text: rows that share a doc_id but not the text are documents of
their own, in order of the text's hash; rows equal in both are one document, each returned. A null
text counts as empty; a null doc_id sorts before all others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shards import Bitmap, runs, slices, tally, trim

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_BYTE = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64)
_NONE = np.zeros(0, np.int64), np.zeros(0, np.uint64)
_FIRST = -(1 << 63)


def gram(length: int) -> int:
    """Bytes of an anchor: a power of two, so long that chance hardly repeats it."""
    return 1 << int(np.log2(max(1, 7 * length // 10)))


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every window of ``width`` values, by doubling."""
    step = 1
    while 2 * step <= width:
        x, step = f(x[:-step], x[step:]), 2 * step
    return f(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are lowest in some window of ``length`` bytes."""
    return _anchors(text, length)[:2]


def _anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors, and hashes of each with bytes on its left and on its right (zero: there are none).

    A string of ``length`` around an anchor reaches at least half of the bytes beyond it on one side, so
    it repeats only if the anchor does with ``side`` bytes there.
    """
    if len(text) < length:
        return *_NONE, np.zeros((2, 0), np.uint64)
    h, step, size = _BYTE[np.frombuffer(text, np.uint8)], 1, gram(length)
    half = (length - size) // 2
    side, beside = (1 << half.bit_length() - 1 if half else 0), h
    for m in _MIX[: size.bit_length() - 1]:
        h, step = h[:-step] * m + h[step:], 2 * step
        if step == side:
            beside = h
    h ^= h >> np.uint64(29)
    h *= _MIX[0]
    h ^= h >> np.uint64(32)
    width = length - size + 1
    pad = np.zeros(width - 1, np.uint64)
    low = _slide(h, width, np.minimum)
    at = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), width, np.maximum) == h)
    h = h[at]
    if not side:
        return at, h, np.stack([h, h])
    both = np.zeros((2, len(at)), np.uint64)
    for k, (place, ok) in enumerate(((at - side, at >= side), (at + size, at + size + side <= len(text)))):
        x = (beside[place[ok]] + _MIX[k + 1]) * _MIX[k + 4] ^ h[ok]
        x = (x ^ x >> np.uint64(32)) * _MIX[0]
        both[k, ok] = x ^ x >> np.uint64(29)
    return at, h, both


def _place(h: np.ndarray, o: np.ndarray, u: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash of an anchor and its place."""
    x = h ^ ((o * _MIX[1] ^ u) * _MIX[4] + at.view(np.uint64)) * _MIX[2]
    x ^= x >> np.uint64(31)
    x *= _MIX[3]
    return x ^ (x >> np.uint64(29))


def _over(docs: DataFrame, f, schema: str, most: int = 4 << 20) -> DataFrame:
    """``f(document's key columns, text)`` gives columns; rows go out in batches of about ``most`` bytes."""
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = [common._ARROW[x.split(" ")[1]] for x in schema.split(", ")]
    keys = [c for c in docs.columns if c != "t"]

    def out(parts):
        cols = [np.concatenate(c) if isinstance(c[0], np.ndarray) else [y for x in c for y in x] for c in zip(*parts)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches):
        for batch in batches:
            for some in slices(batch, "t"):
                parts, size = [], 0
                for *key, t in zip(*(some.column(k).to_pylist() for k in keys), some.column("t").to_pylist()):
                    got = f(*key, t or b"")
                    if len(got[0]):
                        parts.append(got)
                        size += sum(c.nbytes if isinstance(c, np.ndarray) else sum(map(_bytes, c)) for c in got)
                    if size > most:
                        yield out(parts)
                        parts, size = [], 0
                if parts:
                    yield out(parts)
        trim()

    return docs.mapInArrow(run, schema)


def _bytes(x) -> int:
    return 8 if x is None else x.nbytes if isinstance(x, np.ndarray) else len(x)


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks from 1."""
    order = np.argsort(key)
    s = key[order]
    rank = np.empty(len(key), np.int32)
    rank[order] = np.cumsum(np.concatenate([[1], s[1:] != s[:-1]]), dtype=np.int32)
    return rank


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of a block of texts, each with an end mark of its own.

    ``heads`` are the runs' bytes, ``starts`` their first rows, ``back`` the rows that a backward step
    takes those to, and ``samples`` the text positions of the runs' first rows. Runs are cut where the
    first ``length`` bytes of the rows change (a class of equal strings is whole runs) and at
    each class's earliest row, so the samples hold the earliest position of every class. Of the
    suffix order that the construction sorts nothing else is kept. ``place`` orders text positions.
    """

    def __init__(self, texts: list[bytes], place: np.ndarray, length: int):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(self.sizes + 1) - 1
        t = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + 1
        t[ends] = 0
        n = len(t)
        end = np.repeat(ends, self.sizes + 1).astype(np.int32)
        here = np.arange(n, dtype=np.int32)

        def after(x: np.ndarray, k: int) -> np.ndarray:
            """``x`` at ``k`` positions on, or zero beyond the text's end."""
            out = np.zeros(n, x.dtype)
            out[: n - k] = x[k:]
            out[here + k > end] = 0
            return out

        key = np.zeros(n, np.int64)
        for k in range(min(7, n)):
            key = key << 9 | after(t, k)
        width = int(n).bit_length()
        ways = 3 if 3 * width < 64 else 2  # ranks that one key can hold

        def joined(rank: np.ndarray, at: list[int]) -> np.ndarray:
            out = rank.astype(np.int64)
            for k in at:
                out = out << width | after(rank, k)
            return out

        span, most, strings = 7, max(int(self.sizes.max()) + 1, length), None
        while strings is None or span < most:
            rank = _ranks(key)
            if strings is None and length <= ways * span:
                strings = joined(rank, sorted({min(span, max(length - span, 0)), max(length - span, 0)})[: ways - 1] if length > span else [])
            key = joined(rank, [span * k for k in range(1, ways)])
            span *= ways
        order = np.argsort(key, kind="stable")  # equal suffixes in order of their texts
        strings = strings[order]
        new = np.concatenate([[True], strings[1:] != strings[:-1]])
        del key, strings, rank
        bwt = np.where(order > 0, t[order - 1], 0)
        classes = np.flatnonzero(new)
        at = place[order]
        new |= at == np.repeat(np.minimum.reduceat(at, classes), np.diff(np.append(classes, n)))
        new[1:] |= bwt[1:] != bwt[:-1]
        self.starts = np.flatnonzero(new)
        self.heads = bwt[self.starts]
        self.samples = order[self.starts]
        sizes = np.diff(np.append(self.starts, n))
        by = np.argsort(self.heads, kind="stable")
        self.back = np.empty(len(by), np.int64)
        self.back[by] = np.cumsum(sizes[by]) - sizes[by]
        first = np.searchsorted(self.starts, classes)
        self.earliest = np.repeat(np.minimum.reduceat(place[self.samples], first), np.diff(np.append(first, len(self.starts))))
        self.length = length

    def stream(self):
        """Of all texts at once, from their ends: ``(text, position, earliest place of the string there)`` for whole strings."""
        row, texts = np.arange(len(self.sizes)), np.arange(len(self.sizes))
        run = np.searchsorted(self.starts, row, "right") - 1
        for step in range(1, int(self.sizes.max(initial=0)) + 1):
            go = self.sizes[texts] >= step
            texts, row, run = texts[go], row[go], run[go]
            row = self.back[run] + row - self.starts[run]
            run = np.searchsorted(self.starts, row, "right") - 1
            if step >= self.length:
                yield texts, self.sizes[texts] - step, self.earliest[run]


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by strings of ``length`` at the sorted ``starts``."""
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + length


def segments(h: np.ndarray, wide: int = 8) -> np.ndarray:
    """First anchors of a text's segments: those of lowest hash among ``wide`` neighbours on both sides, and the first of all."""
    if len(h) < 2:
        return np.zeros(min(len(h), 1), np.int64)
    pad = np.full(wide, ~np.uint64(0))
    first = _slide(np.concatenate([pad, h, pad]), 2 * wide + 1, np.minimum) == h
    first[0] = True
    return np.flatnonzero(first)


_MARKS = "o bigint, u bigint, a bigint, b bigint"


def _block(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Marks of one block of whole anchors; rows are (o, u, start, text)."""
    order = {k: i for i, k in enumerate(sorted({r[:2] for r in rows}))}
    first = np.array([(order[r[:2]] << 36) + r[2] for r in rows], np.int64)
    sizes = np.fromiter((len(r[3]) + 1 for r in rows), np.int64, len(rows))
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    index = RunIndex([r[3] for r in rows], np.repeat(first, sizes) + inner, length)
    who, at = [], []
    for texts, position, earliest in index.stream():
        late = earliest < first[texts] + position
        who.append(texts[late])
        at.append(position[late])
    out: dict[str, list] = {"o": [], "u": [], "a": [], "b": []}
    who, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, at))
    by = np.lexsort((at, who))
    who, at = who[by], at[by]
    for k in np.split(np.arange(len(who)), runs(who)[1:]) if len(who) else []:
        o, u, start, _ = rows[who[k[0]]]
        a, b = _spans(start + at[k], length)
        out["o"] += [o] * len(a)
        out["u"] += [u] * len(a)
        out["a"] += a.tolist()
        out["b"] += b.tolist()
    return pa.RecordBatch.from_pydict(out, schema=pa.schema([(n, pa.int64()) for n in out]))


def _copies(rows: DataFrame) -> DataFrame:
    """``rows(h, x, o, u, p, a, b)`` of one content (h, x), in order of place: ``h`` stays with the first; the others, which go whole, have none.

    ``x``, ``fo``, ``fu``, ``fp``, ``fa`` and ``fb`` tell the others what they repeat.
    """
    names = ["h", "x", "o", "u", "p", "a", "b"]

    def run(batches):
        before = None
        for batch in batches:
            h, x, o, u, p, a, b = (batch.column(n).to_numpy(zero_copy_only=False) for n in names)
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
            of = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))  # where the row's group begins
            first = [c[of] for c in (o, u, p, a, b)]
            if before is not None and (h[0], x[0]) == before[:2]:
                new[0] = False
                for c, v in zip(first, before[2:]):
                    c[of == 0] = v
            before = h[-1], x[-1], *(c[-1] for c in first)
            keep = new | (o != first[0]) | (u != first[1]) | (p != first[2])  # a repeated row is its first again
            cols = pa.array(h, pa.int64(), mask=~new), *map(pa.array, (o, u, p, a, b)), *(pa.array(c, pa.int64(), mask=new) for c in (x, *first))
            yield pa.RecordBatch.from_arrays(list(cols), names=out).filter(pa.array(keep))

    out = ["h", "o", "u", "p", "a", "b", "x", "fo", "fu", "fp", "fa", "fb"]
    sorted_ = rows.repartition("h", "x").sortWithinPartitions("h", "x", "o", "u", "p")
    return sorted_.mapInArrow(run, ", ".join(f"{n} bigint" for n in out))


def _sharing(group: list[tuple], size: int, half: int) -> list[tuple]:
    """Rows of one anchor that share it and ``half`` bytes on one side with another row: any longer match needs that."""
    seen: dict[bytes, int] = {}
    sides = []
    for _, _, a, p, t in group:
        at = p - a
        own = [b"r" + t[at : at + size + half]] + ([b"l" + t[at - half : at + size]] if at >= half else [])
        sides.append(own)
        for s in own:
            seen[s] = seen.get(s, 0) + 1
    return [r for r, own in zip(group, sides) if any(seen[s] > 1 for s in own)]


def _apart(meet: DataFrame, length: int) -> DataFrame:
    """Marks of anchors too hot for one task: every string of ``length`` is a key, and its earliest place an aggregate."""
    names = ["k", "l", "o", "u", "a"]

    def strings(batches):
        for batch in batches:
            for some in slices(batch, "t", 1 << 19):
                out: dict[str, list] = {n: [] for n in names}
                for o, u, a, t in zip(*(some.column(n).to_pylist() for n in ("o", "u", "a", "t"))):
                    for i in range(len(t) - length + 1):
                        both = xxhash.xxh3_128_digest(t[i : i + length])
                        for n, v in zip(names, (int.from_bytes(both[:8], "big", signed=True), int.from_bytes(both[8:], "big", signed=True), o, u, a + i)):
                            out[n].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(n, pa.int64()) for n in names]))

    keyed = meet.mapInArrow(strings, ", ".join(f"{n} bigint" for n in names))
    place = F.struct("o", "u", "a")
    first = keyed.groupBy("k", "l").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(first, ["k", "l"]).where(place > F.col("first")).select("o", "u", "a", (F.col("a") + length).alias("b"))


def marks(docs: DataFrame, length: int = 100, bits: int = 27, block: int = 1 << 19, hot: int = 50_000) -> DataFrame:
    """``(o, u, m)``, stored: each document's byte ranges to remove; they may overlap. ``docs`` is ``(o, u, t)``."""
    spark, size = docs.sparkSession, gram(length)
    reach = length - size
    schema = "h bigint, x bigint, o bigint, u bigint, p bigint, a bigint, b bigint"

    def whole(o, u, t):
        at, h = anchors(t, length)
        cut = segments(h)
        a, b = np.maximum(at[cut] - reach, 0), np.minimum(at[np.append(cut[1:], len(at)) - 1] + length, len(t)) if len(at) else cut
        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t[i:j]) for i, j in zip(a.tolist(), b.tolist())]), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1], np.full(len(a), o, np.int64), np.full(len(a), u, np.int64), at[cut], a, b

    cuts = common.store(_copies(_over(docs, whole, schema)).select("h", "o", "u", "p", "a", "b"), "segments")
    common.release(spark)
    open_ = Bitmap(cuts.where("h is not null").select("h", "o", "u", "p"), _spot(None), bits)

    def left(o, u, t):
        """Anchors of the segments that did not go whole, as :func:`_anchors` gives them."""
        at, h, both = _anchors(t, length)
        cut = segments(h)
        place = _place(np.zeros(len(cut), np.uint64), np.full(len(cut), o, np.int64).view(np.uint64), np.full(len(cut), u, np.int64).view(np.uint64), at[cut])
        keep = np.repeat(open_.has(place), np.diff(np.append(cut, len(at))))
        return at[keep], h[keep], both[:, keep]

    def hashes(batch):
        rows = zip(*(batch.column(n).to_pylist() for n in ("o", "u", "__text")))
        x = np.concatenate([left(o, u, t or b"")[2].ravel() for o, u, t in rows])
        yield 2, [x[x > 0]]

    seen = Bitmap(tally(docs.withColumnRenamed("t", "__text"), hashes, least=2).select("x"), "x", bits)
    common.release(spark)

    def surroundings(o, u, t):
        at, h, both = left(o, u, t)
        a, b = np.maximum(at - reach, 0), np.minimum(at + length, len(t))
        keep = (seen.has(both) & (both > 0)).any(0) & (b - a >= length)  # shorter surroundings hold no string
        at, h, a, b = at[keep], h[keep], a[keep], b[keep]
        x, name = np.empty(len(at), np.uint64), xxhash.xxh3_64_intdigest
        for i, (p, q) in enumerate(zip(a.tolist(), b.tolist())):
            x[i] = name(t[p:q])
        return h.view(np.int64), x.view(np.int64), np.full(len(at), o, np.int64), np.full(len(at), u, np.int64), at, a, b

    found = common.store(_copies(_over(docs, surroundings, schema)).select("h", "o", "u", "p", "a", "b"), "anchors")
    common.release(spark)
    first = found.where("h is not null").select("h", "o", "u", "p")
    sizes = common.store(first.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "sizes")
    several = Bitmap(sizes, "h", bits)
    wanted = Bitmap(first, _spot(several), bits)
    common.release(spark)

    def texts(o, u, t):
        at, h, _ = left(o, u, t)
        keep = several.has(h)
        at, h = at[keep], h[keep]
        os, us = np.full(len(at), o, np.int64), np.full(len(at), u, np.int64)
        keep = wanted.has(_place(h, os.view(np.uint64), us.view(np.uint64), at))
        at, h, os, us = at[keep], h[keep], os[keep], us[keep]
        a = np.maximum(at - reach, 0)
        return h.view(np.int64), os, us, a, at, [t[i : p + length] for i, p in zip(a.tolist(), at.tolist())]

    meet = _over(docs, texts, "h bigint, o bigint, u bigint, a bigint, p bigint, t binary")

    def walk(batches):
        rows, held, anchor, group = [], 0, None, []

        def taken():
            """The group's rows that can match join the block."""
            more = _sharing(group, size, reach - reach // 2) if len(group) > 1 else []
            rows.extend((o, u, a, t) for o, u, a, _, t in more)
            return sum(len(r[4]) + 1 for r in more)

        for batch in batches:
            for h, *row in zip(*(batch.column(n).to_pylist() for n in ("h", "o", "u", "a", "p", "t"))):
                if h != anchor:
                    held += taken()
                    anchor, group = h, []
                    if held > block:
                        yield _block(rows, length)
                        rows, held = [], 0
                group.append(tuple(row))
        held += taken()
        if rows:
            yield _block(rows, length)
        trim()

    parts = [x.where("h is null").select("o", "u", "a", "b") for x in (cuts, found)]
    large = sizes.where(F.col("k") > hot).select("h")
    if not large.isEmpty():
        meet = common.store(meet, "meet")
        parts.append(_apart(meet.join(large, "h", "left_semi").select("o", "u", "a", "t").distinct(), length))
        meet = meet.join(large, "h", "left_anti")
    parts.append(meet.repartition("h").sortWithinPartitions("h", "o", "u", "p").mapInArrow(walk, _MARKS))
    every = reduce(DataFrame.unionByName, parts)
    out = common.store(every.groupBy("o", "u").agg(F.collect_set(F.struct("a", "b")).alias("m")), "marks")
    del every, parts
    for x in (cuts, found, sizes, meet):
        common.drop(x)
    common.release(spark)
    return out


def _spot(several: Bitmap | None):
    """The hash of a row's anchor (none: of its segment) and place; of repeated anchors only."""

    def f(batch):
        h, o, u, p = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("h", "o", "u", "p"))
        keep = np.ones(len(h), bool) if several is None else several.has(h.view(np.uint64))
        h = h * 0 if several is None else h
        return _place(h[keep].view(np.uint64), o[keep].view(np.uint64), u[keep].view(np.uint64), p[keep])

    return f


def merged(pairs: list) -> tuple[list[tuple[int, int]], int]:
    """Maximal ranges of the union, and the bytes they hold."""
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out], sum(b - a for a, b in out)


def removed(docs: DataFrame, length: int = 100, **options) -> DataFrame:
    """The contract's columns and ``kept``, the bytes left of each text."""
    text = F.col("text").cast("binary")
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit(_FIRST)).alias("o"), F.xxhash64(text, F.col("doc_id").isNull()).alias("u"), text.alias("t"))
    found = marks(base.select("o", "u", "t"), length, **options)
    # documents without marks need not move; the others meet theirs
    marked = Bitmap(found.select(F.xxhash64("o", "u").alias("y")), "y", 23)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            for some in slices(batch, "t"):
                out: dict[str, list] = {"doc_id": some.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "kept_sha256": []}
                for t, m in zip(some.column("t").to_pylist(), some.column("m").to_pylist()):
                    t = t or b""
                    spans, n = merged([(x["a"], x["b"]) for x in m or []])
                    cut = [0, *(x for s in spans for x in s), len(t)]
                    kept = b"".join(t[a:b] for a, b in zip(cut[::2], cut[1::2]))
                    for k, v in (("n_bytes", len(t)), ("n_removed", n), ("n_spans", len(spans)), ("kept", kept), ("kept_sha256", hashlib.sha256(kept).hexdigest())):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=kinds)

    def apart(want: bool) -> DataFrame:
        def pick(batches):
            for batch in batches:
                y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                yield batch.filter(pa.array(marked.has(y) == want)).drop_columns(["y"])

        return base.withColumn("y", F.xxhash64("o", "u")).mapInArrow(pick, "doc_id bigint, o bigint, u bigint, t binary")

    still = apart(False).withColumn("m", F.lit(None).cast("array<struct<a:bigint,b:bigint>>"))
    moved = apart(True).join(found, ["o", "u"], "left")
    return still.select("doc_id", "t", "m").unionByName(moved.select("doc_id", "t", "m")).mapInArrow(run, schema)
