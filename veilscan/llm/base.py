"""Helpers that the operators share: tables, staged results, text slices and connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at once inside a task.
SLICE_BYTES = 8 << 20
#: Tables that this Python worker remembers from one task to the next, by name.
worker_tables: dict[str, object] = {}


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers, which may run where it is not installed."""
    context = spark.sparkContext
    if getattr(context, "_veilscan_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="veilscan-")) / "veilscan.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    context._veilscan_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = f"{scratch(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in consecutive slices of about ``limit`` bytes of ``column``, at least one row each."""
    texts = batch.column(column)
    if len(texts) == 0:
        return
    sizes = np.nan_to_num(np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype="f8"))
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0.0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def release_tables() -> None:
    """Lets go of this worker's tables: workers outlive a stage, and the next stage does not use them."""
    worker_tables.clear()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc_mod(column: str, modulus: int):
    """crc32 of the id written in decimal, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, least: int = 1000) -> DataFrame:
    """``rows`` left-joined to ``groups`` (one row per ``key``, ``size`` = its number of rows).

    Groups of at least ``least`` rows and a thousandth of all rows are at most a thousand, so they are broadcast
    and their rows never meet in one task; all others are joined by a shuffle in which no key is hot.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) >= max(least, total // 1000 + 1)
    heads, rest = groups.where(hot), groups.where(~hot)
    if total < least or heads.isEmpty():
        return rows.join(rest, key, "left")
    known = F.broadcast(heads.select(key))
    return rows.join(F.broadcast(heads), key).unionByName(rows.join(known, key, "left_anti").join(rest, key, "left"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Alternates large-star and small-star steps until no edge changes: each step is one grouped minimum
    and one join on the node, so a hub's edges are never gathered in one row, and partial aggregation
    and skew handling of the engine apply. Every round is staged, so a lost executor costs one round.
    Nulls and loops are ignored.
    """
    edges = staged(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:
        # Large star: every neighbour above a node goes to the node's smallest neighbour (or itself).
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = staged(small, name)
        # Done once every node points straight at one that points nowhere; the sum of the targets then rests.
        state = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")),
                          F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
