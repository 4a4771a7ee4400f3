"""Near-copies of whole documents: 5-word shingles, exact Jaccard similarity of at least ``share``.

SimHash comes first: texts whose fingerprints over the same shingles differ in at most ``distance`` bits are
linked by :func:`simhash.links`. At that similarity the fingerprints of most pairs differ in more bits than
blocks can be selective for, so further candidates come from MinHash bands:

1. Each text has ``bands`` keys of ``rows`` MinHash values. Equal word sequences are one content.
2. Contents that share a key meet; one text of each of those gets its shingle set, in a second scan. Buckets of
   the same members count once.
3. A link is a pair whose exact similarity is at least ``share``; buckets emit spanning forests.

A pair of similarity s is missed with probability (1 - s^rows)^bands, 1 in 100,000 at 0.8 and less above. ``rows`` is
what keeps unlike texts apart: their meetings grow with the square of the texts, and each brings a shingle set along.
A null text is an empty one, and all empty texts are one content; a null doc_id is kept like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .backoff_lm import _hashed as hashed
from .simhash import keep_first, links
from .substring_dedup import Cutter, similar, _M, _mix
from .shards import Bitmap

_PART = 1 << 18  # bytes of text that are sketched at a time: what fits a core's cache
_TWO = np.uint64((1 << 32) + 1)


def parts(texts: list) -> Iterator[tuple[int, int]]:
    """Where parts of some length begin and end."""
    ends, at = np.cumsum([len(t or b"") + 1 for t in texts]), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PART, "right")))
        yield at, to
        at = to


def contents(n: np.ndarray, h: np.ndarray) -> list[int]:
    """One hash for each sequence of words, ``n`` of them a text."""
    ends = 8 * np.cumsum(n)
    words = h.tobytes()
    return [xxhash.xxh3_64_intdigest(words[a:b]) for a, b in zip((ends - 8 * n).tolist(), ends.tolist())]


class Sketches:
    """Fingerprints and band keys of many texts at once; MinHash orders are odd multiples of mixed hashes, modulo 2^32."""

    def __init__(self, bands: int, rows: int, shingle: int):
        self.cut, self.bands, self.rows = Cutter(bands, rows, 0, shingle), bands, rows
        order = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _M[4])
        self.odd = (order >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def __call__(self, n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Fingerprint and band keys of texts of ``n`` words; without words they are zero and none."""
        fps, keys = np.zeros(len(n), np.uint64), [np.zeros(0, np.int64)] * len(n)
        full = np.flatnonzero(n)
        if len(full):
            fps[full], got = self.some(np.concatenate([[0], np.cumsum(n[full])]), h)
            for i, k in zip(full.tolist(), got.view(np.int64)):
                keys[i] = k
        return fps, keys

    def some(self, cuts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, first = self.cut.shingles(cuts, h)
        at, n = first[:-1], np.diff(first).astype(np.uint64)
        fps = np.zeros(len(n), np.uint64)
        for i in range(32):  # two bits at a time, counted in the halves of a word
            both = np.add.reduceat(x >> np.uint64(i) & _TWO, at)
            fps |= (np.uint64(2) * (both & np.uint64(0xFFFFFFFF)) > n).astype(np.uint64) << np.uint64(i)
            fps |= (np.uint64(2) * (both >> np.uint64(32)) > n).astype(np.uint64) << np.uint64(i + 32)
        low = (x >> np.uint64(32)).astype(np.uint32)
        keys = np.empty((len(n), self.bands), np.uint64)
        for b in range(self.bands):
            key = np.full(len(n), b, np.uint64)
            for odd in self.odd[b * self.rows : (b + 1) * self.rows]:
                key = _mix(key * _M[5] + np.minimum.reduceat(low * odd, at))
            keys[:, b] = key
        return fps, keys


def groups(docs: DataFrame, share: float = 0.8, shingle: int = 5, bands: int = 29, rows: int = 5, limit: int = 4096, distance: int = 3, blocks: int = 6) -> DataFrame:
    """``(doc_id, key, root)``, one row per input row; ``key`` is the text's hash."""
    sketch = Sketches(bands, rows, shingle)
    cut = sketch.cut

    def keys(cols: dict, texts: list) -> dict:
        out: dict[str, list] = {"c": [], "fp": [], "k": []}
        for a, b in parts(texts):
            n, h = hashed(texts[a:b])
            fps, k = sketch(n, h)
            out["c"] += contents(n, h)
            out["fp"] += fps.tolist()
            out["k"] += k
        out["key"] = [xxhash.xxh64_intdigest(t or b"", 42) for t in texts]
        return {"doc_id": cols["doc_id"], "k": out["k"]} | {n: np.array(out[n], np.uint64).view(np.int64) for n in ("key", "c", "fp")}

    found = common.store(common.map_text(docs, ["doc_id"], keys, "doc_id bigint, key bigint, c bigint, fp bigint, k array<bigint>"), "contents")
    one = found.groupBy("c").agg(F.min(F.struct("key", "k")).alias("x"))
    dealt = common.store(one.select(F.explode("x.k").alias("k"), "c", "x.key"), "dealt")
    sizes = dealt.groupBy("k").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c")).alias("mark")).where("n > 1")
    sizes = common.store(sizes.groupBy("n", "mark").agg(F.min("k").alias("k")).drop("mark"), "sizes")
    met = common.store(dealt.join(sizes, "k").select("k", "c", "key", "n"), "met")
    seen = Bitmap(met.select("key").distinct(), "key", 27)
    met = met.drop("key")
    told: set[int] = set()

    def sets(cols: dict, texts: list) -> dict:
        out: dict[str, list] = {"c": [], "s": []}
        hit = seen.has(np.array([xxhash.xxh64_intdigest(t or b"", 42) for t in texts], np.uint64))
        some = [texts[i] for i in np.flatnonzero(hit).tolist()]
        for a, b in parts(some):
            n, h = hashed(some[a:b])
            for c, words in zip(contents(n, h), np.split(h, np.cumsum(n)[:-1])):
                if len(words) and c not in told:
                    told.add(c)
                    out["c"].append(c)
                    out["s"].append(np.unique(cut.shingles(np.array([0, len(words)]), words)[0]).view(np.int64))
        if len(told) > 500_000:
            told.clear()
        return out | {"c": np.array(out["c"], np.uint64).view(np.int64)}

    shingles = common.map_text(docs, [], sets, "c bigint, s array<bigint>").groupBy("c").agg(F.first("s").alias("s"))
    shingles = common.store(shingles, "shingles")
    prints = common.store(found.groupBy("fp").agg(F.min("c").alias("c")), "prints")
    same = found.select("fp", F.col("c").alias("a")).distinct().join(prints.select("fp", F.col("c").alias("b")), "fp").select("a", "b")
    near = links(prints.select("fp"), distance, blocks, limit)
    ends = [prints.select(F.col("fp").alias(n), F.col("c").alias(f"c{n}")) for n in ("a", "b")]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = common.components(similar(met.join(shingles, "c"), sizes, share, limit).unionByName(same).unionByName(near))
    out = found.join(roots, found.c == roots.node, "left")
    return out.select("doc_id", "key", F.coalesce("root", "c").alias("root"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near-copies."""
    return keep_first(docs, common.store(groups(docs, **options), "groups"))
