"""Helpers that the operators of this subpackage share: scratch tables, word patterns, connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and the white space between words, as Java patterns (only these six ASCII characters separate).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. There is no other to fall back to: what executors write to
    their own disks, others can't read."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root


#: Spark's setting that a statement's shuffle files go when it ends. Else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table to the shared scratch folder and reads it again: cuts lineage, survives the loss of executors. What was shuffled
    for it leaves the disks."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _give_back() -> None:
    """Hands freed memory back to the system: a Python worker stays for later tasks, and what it once needed isn't theirs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other C libraries do without
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives its memory back when it is through."""

    @wraps(run)
    def f(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return f


def lean_group(run: Callable) -> Callable:
    """A function of a group's rows that gives its memory back."""

    def f(frame):
        try:
            return run(frame)
        finally:
            _give_back()

    return f


#: Bits of an id filter: 2**25 are 4 MB, whatever the number of ids.
FILTER_BITS = 1 << 25


def id_filter(ids: DataFrame, id_col: str) -> DataFrame:
    """A bitmap of the hashes of ids, as at most 1024 rows of 4 KB: small enough to broadcast at any size of the table."""
    return materialize(
        ids.select(F.pmod(F.xxhash64(id_col), F.lit(FILTER_BITS)).alias("at"))
        .groupBy(F.bitmap_bucket_number("at").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    )


def _passes(df: DataFrame, id_col: str, filter_table: DataFrame) -> tuple[DataFrame, F.Column]:
    at = f"pmod(xxhash64(`{id_col}`), {FILTER_BITS}L)"
    joined = df.join(F.broadcast(filter_table), F.expr(f"bitmap_bucket_number({at})") == F.col("__part"), "left")
    byte = f"cast(conv(hex(substring(__bits, cast(bitmap_bit_position({at}) div 8 as int) + 1, 1)), 16, 10) as long)"
    return joined, F.expr(f"coalesce(shiftright({byte}, cast(bitmap_bit_position({at}) % 8 as int)) % 2 = 1, false)")


def maybe_in(df: DataFrame, id_col: str, filter_table: DataFrame) -> DataFrame:
    """Rows whose id may be in the filter: all that are, and a few others. Keeps most rows out of the shuffle of a join."""
    joined, hit = _passes(df, id_col, filter_table)
    return joined.where(hit).select(*[df[f"`{c}`"] for c in df.columns])


def not_in(df: DataFrame, id_col: str, filter_table: DataFrame) -> DataFrame:
    """The other rows, of which none has an id in the filter (rows without an id are among them)."""
    joined, hit = _passes(df, id_col, filter_table)
    return joined.where(~hit | F.col(id_col).isNull()).select(*[df[f"`{c}`"] for c in df.columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(col) -> F.Column:
    """Words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as rows (a, b) of long node ids.

    Alternates large-star and small-star steps: each hooks the neighbours of a node to the least node seen next to it, so
    the edges become stars round each component's least node in a logarithmic number of rounds. Nothing is collected;
    the least neighbour is written before it is joined back, so that a hub's edges are an ordinary skewed join which
    adaptive execution can split. Returns (node, root) for every node with an edge, roots included.
    """
    e = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = _mark(e)
    while seen[0]:
        near = materialize(
            e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            .groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
        )
        large = materialize(
            e.join(near, e.v == near.hub).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        )
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "hub"))
        e = materialize(
            large.join(least, large.u == least.hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select(F.col("hub").alias("u"), F.col("m").alias("v"))).distinct()
        )
        now = _mark(e)
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    """A row count and an order-free digest, to see whether a round changed anything."""
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
