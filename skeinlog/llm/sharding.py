"""Operator 12: sharding by weighted rendezvous hashing. DataFrame functions only.

Every shard draws a number for every key: digest bits u in (0, 1), scored -weight / ln(u), and the shard with the highest score
takes the key. Key and weights alone decide, so reruns and other layouts agree, rows of one key meet in one shard, and a shard
that is added takes rows from the others without moving any between them: it takes those that it scores highest for, a share by
its weight.

Places in a shard are gapless: rows are dealt by ranges of (shard, digest of the key, key, text), so that a shard of any size lies in
many tasks, each range counts its rows by shard, and running sums over ranges say where each begins. A key that
holds many rows is cut by row numbers at the end of that order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, shuffle_partitions


def _bits(*parts: F.Column) -> F.Column:
    """48 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long")


def _key(id_col: F.Column) -> F.Column:
    return F.coalesce(id_col.cast("string"), F.lit("null"))


def scores(key: F.Column, weights: Sequence[float], seed: str = "shard") -> F.Column:
    """The score of each shard for a key, in an array; of weight 0: never the highest."""
    drawn = [(_bits(F.lit(f"{seed}:{s}"), key) + 0.5) / F.lit(float(1 << 48)) for s in range(len(weights))]
    return F.array(*[F.lit(float(-w)) / F.ln(u) if w > 0 else F.lit(-1.0) for w, u in zip(weights, drawn, strict=True)])


def highest(scored: F.Column, n: int) -> F.Column:
    """Which of the first n shards takes the key; of equal scores, the first."""
    first = F.slice(scored, 1, n)
    return (F.array_position(first, F.array_max(first)) - 1).cast("int")


def _checked(weights: Sequence[float]) -> list[float]:
    if not any(w > 0 for w in weights):
        raise ValueError("some weight must be above 0")
    return list(weights)


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1,) * 8, grown: float = 1, id_col: str = "doc_id", text_col: str = "text", seed: str = "shard") -> DataFrame:
    """The shard of each row of docs: (doc_id, size, text_crc32, shard, slot, grown_shard).

    size is the UTF-8 bytes of the text plus 1, text_crc32 its checksum (null: as of an empty text); slot numbers the rows of
    a shard from 0 without gaps, in the order of a digest of the id, id and checksum; grown_shard is the shard if one of weight
    grown is added. Rows with one id go to one shard; a null id is a key of its own, the text 'null'. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    text = docs[f"`{text_col}`"]
    rows = docs.select(
        docs[f"`{id_col}`"].alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        _key(docs[f"`{id_col}`"]).alias("key"),
    ).select("*", scores(F.col("key"), [*_checked(weights), grown], seed).alias("scored"), _bits(F.lit(f"{seed}:slot"), F.col("key")).alias("place"))
    n = len(weights)
    rows = materialize(
        rows.select("doc_id", "size", "text_crc32", "key", "place", highest(F.col("scored"), n).alias("shard"), highest(F.col("scored"), n + 1).alias("grown_shard"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    order = ["shard", "place", "key", "text_crc32", "size", "row"]
    ranged = materialize(
        rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
        .select("doc_id", "size", "text_crc32", "shard", "grown_shard", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    )
    heads = ranged.groupBy("shard", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(F.col("shard").alias("s"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"))
    return (
        ranged.join(heads, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1,) * 8, id_col: str = "doc_id", seed: str = "shard", files: int | None = None) -> None:
    """Writes docs as Parquet, a folder for each shard, its rows in the order of a digest of their ids; all columns stay, but one called shard is
    replaced. Rows are dealt by ranges, in so many files as files says (or spark.sql.shuffle.partitions)."""
    key = _key(docs[f"`{id_col}`"])
    placed = docs.drop("shard").withColumn("shard", highest(scores(key, _checked(weights), seed), len(weights))).withColumn("__place", _bits(F.lit(f"{seed}:slot"), key))
    order = ["shard", "__place"]
    dealt = placed.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(files or shuffle_partitions(docs.sparkSession), *order, "__row")
    dealt.sortWithinPartitions(*order).drop("__place", "__row").write.partitionBy("shard").parquet(path)
