"""Shared pieces: durable intermediate tables, connected components, row plumbing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shards import slices, swept, trim


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset, as in
    local tests, a temporary folder is made and remembered in the session.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="assayframe-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage durably. Its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table made by :func:`store` that nothing will read again."""
    spark, path = df.sparkSession, getattr(df, "_stored_at", None)
    if path:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_text(docs: DataFrame, keep: list[str], f: Callable, schema: str, text: str = "text") -> DataFrame:
    """Apply ``f(columns: dict of lists, texts: list[bytes | None]) -> dict of lists`` per part of an Arrow batch, some megabytes of text each.

    Only ``keep`` and the text column are read; texts arrive as UTF-8 bytes, whole.
    """
    out = pa.schema([(n, _ARROW[t]) for n, t in (x.split(" ", 1) for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "__text", 8 << 20):
                cols = {n: some.column(n).to_pylist() for n in keep}
                got = f(cols, some.column("__text").to_pylist())
                yield pa.RecordBatch.from_pydict({n: got[n] for n in out.names}, schema=out)
        trim()

    return docs.select(*keep, F.col(text).cast("binary").alias("__text")).mapInArrow(run, schema)


def release(spark: SparkSession) -> None:
    """Let go of finished stages' shuffle files now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


_ARROW = {
    "bigint": pa.int64(),
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` per node, root the smallest node.

    Alternating large-star and small-star steps; every step is a grouped minimum and an
    equi-join, so no neighbour list is gathered anywhere. Each round is written to the shared
    folder. Nothing but a count and a checksum reaches the driver. Null or equal ends are no links.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = store(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours move to the smallest neighbour
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself move to the smallest
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        moved = big.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = store(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        drop(e)
        e = new
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )
