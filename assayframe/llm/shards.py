"""Sorted 64-bit keys by the million: packed, dealt to shards by their top bits, and counted there.

Executors send one row per chunk of text and shard, which holds the chunk's distinct keys in order,
byte by byte of the keys (so that the shuffle's compression sees their common beginnings). A shard is
a range of keys, so hot keys cost a shard one entry a chunk. Nothing here reaches the driver but
:class:`Bitmap`, whose size is fixed.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAGE = 19  # bits of a place in one page of a bitmap
_TEXT = 32 << 20  # bytes of text whose keys one partition takes


def pack(keys: np.ndarray) -> bytes:
    """64-bit values, one byte plane after another."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def parts_of(docs: DataFrame, column: str = "text") -> int:
    """Partitions for the keys of ``docs``: the session's number, or more where one would take over ``_TEXT`` bytes of text."""
    size = docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(_session(docs.sparkSession), -(-size // _TEXT))


def _session(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt_by(df: DataFrame, parts: int, *columns: str) -> DataFrame:
    """``df`` dealt by ``columns``, to ``parts`` partitions if the session would make fewer."""
    return df.repartition(parts, *columns) if parts > _session(df.sparkSession) else df.repartition(*columns)


def shard_count(parts: int) -> int:
    return 4 * parts


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """A shard's keys are a range, so that keys in order are shards in order."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each, whatever number of rows that is."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)) + 1
        yield batch.slice(at, to - at)
        at = to


def trim() -> None:
    """Give freed memory back: Spark keeps idle Python workers, and they keep what their last task took."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(lib := ctypes.CDLL(libc), "malloc_trim"):
        lib.malloc_trim(0)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files made inside go when it ends, on all executors; Spark itself waits for its driver's garbage collection.

    For work whose result is kept elsewhere. Nothing goes while other jobs run, as shuffles may be theirs; should
    anything still read one later, Spark makes it again.
    """
    jobs = spark.sparkContext.statusTracker().getActiveJobsIds
    before = None if jobs() else _shuffles(spark)
    yield
    if before is not None and not jobs():
        cleaner = spark._jsc.sc().cleaner()
        for i in _shuffles(spark) - before if cleaner.isDefined() else ():
            cleaner.get().doCleanupShuffle(i, True)


def _shuffles(spark: SparkSession) -> set[int]:
    ids = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keysIterator()
    return {int(x) for x in ids.mkString(",").split(",") if x}


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row of the sorted columns differs from the row above."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def added(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns`` in order, with the sum of ``n``."""
    order = np.argsort(columns[0], kind="stable") if len(columns) == 1 else np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    at = runs(*columns)
    return [c[at] for c in columns], np.add.reduceat(n, at) if len(at) else n


_HIGH, _ODD = np.uint64(0xFFFFFFFF00000000), [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def mixed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """As :func:`added`, by one sort: upper half of the first column (as shards are cut), then a mix of both columns."""
    x, half = columns[0], np.uint64(32)
    z = x if len(columns) == 1 else x & _HIGH | (x * _ODD[0] + columns[1]) * _ODD[1] >> half
    order = np.argsort(z)
    cols = [c[order] for c in columns]
    at = runs(*cols)
    if len(at) > len(runs(z[order])):  # different rows mix alike and may stand in turns
        return added(columns, n)
    return [c[at] for c in cols], np.add.reduceat(n[order], at) if len(at) else n


def tally(docs: DataFrame, f: Callable, least: int = 1, flush: int = 1_000_000, keep: Callable | None = None, add: Callable = added, parts: int | None = None) -> DataFrame:
    """``(o, x, y, n)``: rows that occur at least ``least`` times, those of kind 1 always; or what ``keep(o, columns, n)`` says of a shard's rows.

    ``docs`` has the text as ``__text``, in bytes. ``f(batch)`` gives ``(o, columns)`` pairs: kind, and one or two
    arrays of 64-bit keys. ``add`` merges equal rows; ``keep`` sees them in its order. ``parts`` is what :func:`parts_of`
    says, without it the session's number: a shard's keys are in memory at once, so shards have to grow with the texts.
    """
    parts = parts or _session(docs.sparkSession)
    shards = shard_count(parts)

    def dealt(held: dict) -> Iterator[pa.RecordBatch]:
        for o, some in held.items():
            cols, n = add([np.concatenate(c) for c in zip(*some)], np.ones(sum(len(x[0]) for x in some), np.int64))
            cut = np.searchsorted(shard_of(cols[0], shards), np.arange(shards + 1))
            rows = [(s, pack(cols[0][a:b]), pack(cols[1][a:b]) if len(cols) > 1 else None, pack(n[a:b])) for s, a, b in zip(range(shards), cut[:-1].tolist(), cut[1:].tolist()) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o] * len(rows), pa.int32()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary())))],
                names=["o", "s", "x", "y", "n"],
            )

    def send(batches):
        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            for some in slices(batch, "__text"):
                for o, cols in f(some):
                    held.setdefault(o, []).append(cols)
                    size += len(cols[0])
                if size > flush:
                    yield from dealt(held)
                    held, size = {}, 0
        if size:
            yield from dealt(held)
        trim()

    def merge(rows: list, o: int) -> pa.RecordBatch:
        cols = [np.concatenate([unpack(r[k]) for r in rows]) for k in (0, 1)[: 1 if rows[0][1] is None else 2]]
        cols, n = add(cols, np.concatenate([unpack(r[2]).view(np.int64) for r in rows]))
        some = np.flatnonzero(keep(o, cols, n) if keep else n >= (1 if o == 1 else least))
        x, y = cols[0][some].view(np.int64), cols[-1][some].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), o, np.int32)), pa.array(x), pa.array(y), pa.array(n[some])], names=["o", "x", "y", "n"])

    def gather(batches):
        now, rows = None, []
        for batch in batches:
            for o, s, x, y, n in zip(*(batch.column(c).to_pylist() for c in ("o", "s", "x", "y", "n"))):
                if (o, s) != now:
                    if rows:
                        yield merge(rows, now[0])
                    now, rows = (o, s), []
                rows.append((x, y, n))
        if rows:
            yield merge(rows, now[0])
        trim()

    sent = docs.mapInArrow(send, "o int, s int, x binary, y binary, n binary")
    return dealt_by(sent, parts, "o", "s").sortWithinPartitions("o", "s").mapInArrow(gather, "o int, x bigint, y bigint, n bigint")


class Bitmap:
    """A set of 64-bit hashes, as a bitmap of fixed size; may say yes to some others.

    The hashes are a column of ``rows``, or what ``column(batch)`` makes of a batch.
    """

    def __init__(self, rows: DataFrame, column: str | Callable, bits: int):
        self.shift, page = np.uint64(64 - bits), min(_PAGE, bits - 6)

        def hashes(batch):
            return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) if isinstance(column, str) else column(batch)

        def send(batches):
            for batch in batches:
                slot = np.unique(hashes(batch) >> np.uint64(64 - bits)).astype(np.int64)
                at = runs(slot >> page)
                cut = [*at.tolist(), len(slot)]
                place = (slot & ((1 << page) - 1)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(slot[at] >> page), pa.array([place[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["page", "some"])

        def gather(batches):
            now, bitmap = None, None
            for batch in batches:
                for p, some in zip(batch.column("page").to_pylist(), batch.column("some").to_pylist()):
                    if p != now:
                        if now is not None:
                            yield one(now, bitmap)
                        now, bitmap = p, np.zeros(1 << page, bool)
                    bitmap[np.frombuffer(some, np.uint32)] = True
            if now is not None:
                yield one(now, bitmap)

        def one(p, bitmap):
            return pa.RecordBatch.from_pydict({"page": pa.array([p], pa.int64()), "some": pa.array([np.packbits(bitmap, bitorder="little").tobytes()], pa.binary())})

        self.words = np.zeros(1 << (bits - 6), np.uint64)
        schema, octets = "page bigint, some binary", self.words.view(np.uint8)
        sent = (rows.select(column) if isinstance(column, str) else rows).mapInArrow(send, schema)
        with swept(rows.sparkSession):
            for r in sent.repartition("page").sortWithinPartitions("page").mapInArrow(gather, schema).toLocalIterator():
                octets[r.page << (page - 3) : (r.page + 1) << (page - 3)] = np.frombuffer(r.some, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h >> self.shift
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
