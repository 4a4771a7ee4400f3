"""SimHash near-duplicate detection by pigeonhole blocks.

A fingerprint has 64 bits. Cut into ``blocks`` parts, two fingerprints that differ in at most
``distance`` bits agree on at least ``blocks - distance`` whole parts, so each fingerprint is dealt
to one bucket for every choice of that many parts and compared only inside its buckets.

Copies never multiply: equal fingerprints collapse to one row before blocking, and a bucket emits
a spanning forest of its links, fewer rows than it has members, never its pairs. A bucket above
``limit`` fingerprints is dealt again, exactly, by choices of finer parts of its remaining bits.

Nulls: a null text is an empty one; an empty text has fingerprint zero and is linked like any
other; a null doc_id is kept, and never is a component's name unless it has no other row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_STEP = 1 << 16


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if set in over half of the shingles' XXH64."""
    w = (text or b"").translate(LOWER).split()
    if not w:
        return 0
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(w) > words:
        starts, ends = starts[: len(w) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h, ones = xxhash.xxh64_intdigest, np.zeros((8, 8), np.int64)
    for at in range(0, len(starts), _STEP):
        some = [h(line[s:e], seed) for s, e in zip(starts[at : at + _STEP].tolist(), ends[at : at + _STEP].tolist())]
        octets = np.array(some, "<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        ones += np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * ones > len(starts)).ravel(), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long; one row per input row."""

    def run(cols: dict, texts: list) -> dict:
        fps = np.array([fingerprint(x, words) for x in texts], np.uint64).view(np.int64)
        return {"doc_id": cols["doc_id"], "fp": fps.tolist()}

    return common.map_text(docs, ["doc_id"], run, "doc_id bigint, fp bigint")


def with_keys(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, key, fp)``: the fingerprints with the text's XXH64, which tells rows of one doc_id apart."""

    def run(cols: dict, texts: list) -> dict:
        fps = np.array([fingerprint(x, words) for x in texts], np.uint64).view(np.int64)
        keys = np.array([xxhash.xxh64_intdigest(x or b"", 42) for x in texts], np.uint64).view(np.int64)
        return {"doc_id": cols["doc_id"], "key": keys.tolist(), "fp": fps.tolist()}

    return common.map_text(docs, ["doc_id"], run, "doc_id bigint, key bigint, fp bigint")


def _masks(bits: int, blocks: int, distance: int) -> list[int]:
    """Masks over the bits set in ``bits``, one for every choice of blocks - distance of its parts."""
    at = [i for i in range(64) if bits >> i & 1]
    parts = [sum(1 << int(i) for i in p) for p in np.array_split(np.array(at), blocks)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints, by breadth-first search."""
    out, left = [], fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~near]
    return out


def _links(blocked: DataFrame, distance: int) -> DataFrame:
    """Spanning links in each bucket ``(c, k)``; rows stream through in bucket order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("c", "k", "fp")])
            rows = rows if kept is None else np.concatenate([kept, rows], 1)
            new = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(0)) + 1
            last = new[-1] if len(new) else 0
            kept = rows[:, last:]
            yield from done(rows[:, :last])
        if kept is not None:
            yield from done(kept)

    def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        starts = np.concatenate(([0], np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(0)) + 1, [rows.shape[1]]))
        sizes, out = np.diff(starts), []
        two = starts[:-1][sizes == 2]
        fps = rows[2].view(np.uint64)
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance
        out += list(zip(fps[two][near].tolist(), fps[two + 1][near].tolist()))
        for i in np.flatnonzero(sizes > 2):
            out += forest(fps[starts[i] : starts[i + 1]], distance)
        if out:
            ab = np.array(out, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": pa.array(ab[:, 0]), "b": pa.array(ab[:, 1])})

    sorted_ = blocked.repartition("c", "k").sortWithinPartitions("c", "k", "fp")
    return sorted_.mapInArrow(run, "a bigint, b bigint")


def links(nodes: DataFrame, distance: int = 3, blocks: int = 6, limit: int = 4096) -> DataFrame:
    """Links ``(a, b)`` among distinct fingerprints ``nodes(fp)`` that span all pairs within ``distance``."""
    everything = (1 << 64) - 1
    masks = _masks(everything, blocks, distance)
    deal = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)]))
    blocked = nodes.select("fp", deal.alias("x")).select("x.c", "x.k", "fp")
    hot = common.store(blocked.groupBy("c", "k").count().where(F.col("count") > limit).select("c", "k"), "hot")
    if hot.isEmpty():
        return _links(blocked, distance)
    cool = _links(blocked.join(hot, ["c", "k"], "left_anti"), distance)
    finer = []
    for i, m in enumerate(masks):
        # what the bucket leaves open, in eight parts: 52 or more bits agree, so 4096 members at most
        finer += [(i, j, m | n) for j, n in enumerate(_masks(everything ^ m, 5 + distance, distance))]
    table = nodes.sparkSession.createDataFrame([(i, i * 1000 + j, _signed(m)) for i, j, m in finer], "c int, d int, mask bigint")
    again = blocked.join(hot, ["c", "k"], "left_semi").join(F.broadcast(table), "c")
    again = again.select(F.col("d").alias("c"), F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp")
    return cool.unionByName(_links(again, distance))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, blocks: int = 6, limit: int = 4096) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    component_id is the smallest doc_id reachable over links of at most ``distance`` differing bits.
    """
    fps = common.store(with_fingerprints(docs, words), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = common.components(links(nodes.select("fp"), distance, blocks, limit))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(named, "fp").select("doc_id", hexed, "component_id")


def keep_first(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of each group of ``grouped(doc_id, key, root)``: of the smallest doc_id, null last, and then the smallest key.

    A row is known by doc_id and its text's hash ``key``; rows that share both are one document.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = grouped.groupBy("root").agg(F.min(order).alias("x"), F.count("*").alias("n")).select("x.doc_id", "x.key", "n")
    first = common.store(first, "first")
    key = F.xxhash64(F.coalesce(docs.text, F.lit("")))
    kept = docs.join(first, docs.doc_id.eqNullSafe(first.doc_id) & (key == first.key), "left_semi")
    big = first.where("n > 1").select(F.col("doc_id").alias("d"), F.col("key").alias("k"))
    same = grouped.join(big, grouped.doc_id.eqNullSafe(big.d) & (grouped.key == big.k), "left_semi")
    if same.groupBy("doc_id", "key").count().where("count > 1").limit(1).isEmpty():
        return kept
    kept = kept.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return kept.dropDuplicates(["doc_id", "__key"]).drop("__key")


def keep_one(docs: DataFrame, words: int = 3, distance: int = 3, blocks: int = 6, limit: int = 4096) -> DataFrame:
    """One row of each group of near-duplicates stays, whatever doc_ids are null or repeat."""
    fps = common.store(with_keys(docs, words), "simhash")
    roots = common.components(links(fps.select("fp").distinct(), distance, blocks, limit))
    return keep_first(docs, fps.join(roots, fps.fp == roots.node, "left").select("doc_id", "key", F.coalesce("root", "fp").alias("root")))
