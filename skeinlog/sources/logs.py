"""Reading logs as text or from archives, and writing sessions back."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import sessions as S


def read_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text files as (log_id, seq, text): log_id is the file, seq grows with the place of the line in it.

    seq puts the split's place before the id that Spark gives rows within a split, so it needs no shuffle and no second pass.
    Files of up to 1 TB and splits of up to 2^23 rows keep it exact.
    """
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text")
    )
    row = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return raw.select("log_id", (F.shiftleft(F.col("_at"), 23) + row).alias("seq"), "text")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out over all cores where a source has fewer splits than those (a small or unsplittable file), as decoding needs far
    more time than reading; else df as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


#: Lines of an archive that are handed on together.
_LINES = 20_000


def _members(archive: IO[bytes], path: str) -> Iterator[pd.DataFrame]:
    """The lines of an archive's first text member, as it is unpacked: nothing is held but some lines."""
    with zipfile.ZipFile(archive) as z:
        name = next((n for n in z.namelist() if n.lower().endswith(".txt")), None)
        if name is None:
            return
        with z.open(name) as member:
            at = 0
            while rows := [line.decode("utf-8", "replace").rstrip("\r\n") for line in itertools.islice(member, _LINES)]:
                yield pd.DataFrame({"log_id": path, "seq": range(at, at + len(rows)), "text": rows})
                at += len(rows)


def read_zipped_logs(spark: SparkSession, paths: str | list[str], stream: bool = True) -> DataFrame:
    """The first text member of each archive as (log_id, seq, text). One archive is read by one task, a line at a time.

    Archives are opened where they lie and read as they are unpacked, so that neither they nor their members need fit into memory;
    that takes a store that pyarrow knows (files, HDFS, S3, GCS). With stream=False Spark reads them, from any store that it
    knows, whole and of 2 GB at most.
    """

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for f in frames:
            for path in f.path:
                store, place = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                with store.open_input_file(place) as archive:
                    yield from _members(archive, path)

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f.path, f.content, strict=True):
                yield from _members(io.BytesIO(content), path)

    files = spark.read.format("binaryFile").load(paths)
    if stream:
        # only names are read here, which pack into few splits: each archive is to have a task to itself
        return files.select("path").repartition(max(1, spark.sparkContext.defaultParallelism * 4), "path").mapInPandas(opened, "log_id string, seq long, text string")
    return files.select("path", "content").mapInPandas(held, "log_id string, seq long, text string")


def zone_for_name(name: Column) -> Column:
    """Session name without its qualifier, of letters, digits, - and _."""
    base = F.trim(F.split(F.regexp_replace(name, "( Full Clear)+$", ""), r" \(")[0])
    return F.regexp_replace(base, r"[^\p{L}\p{N}_-]", "")


def export_names(sessions: DataFrame) -> DataFrame:
    """Adds export_name: players, zone and date; a repeat within a log, without regard to case, gets -2, -3 and so on. Where several logs
    come to one name, again without regard to case, a digest of the log follows, so that no two sessions share a name."""
    players = F.when(F.size("you_players") > 0, F.array_join("you_players", "-")).otherwise(F.lit("Unknown"))
    zone = zone_for_name(F.col("name"))
    stem = F.concat_ws("-", players, F.when(zone != "", zone).otherwise(F.lit("Export")), S.date_text(F.col("start_time"), F.coalesce("start_year", F.year(F.current_date()))), F.lit("export"))
    n = F.row_number().over(W.partitionBy("log_id", F.lower("_stem")).orderBy("start_time", "session_no"))
    named = sessions.withColumn("_stem", stem).withColumn("_n", n)
    named = named.withColumn("_name", F.when(F.col("_n") == 1, F.col("_stem")).otherwise(F.concat_ws("-", "_stem", F.col("_n").cast("string"))))
    shared = named.groupBy(F.lower("_name").alias("_low")).agg((F.min("log_id") != F.max("log_id")).alias("_shared"))
    told = named.join(shared, F.lower("_name") == F.col("_low")).withColumn("export_name", F.when(F.col("_shared"), F.concat_ws("-", "_name", F.substring(F.md5("log_id"), 1, 16))).otherwise(F.col("_name")))
    return told.drop("_stem", "_n", "_name", "_low", "_shared")


#: Line numbers of a part of an export, as a power of two: 64 MB of a log, see read_logs.
PART_BITS = 49


def export_sessions(lines: DataFrame, sessions: DataFrame, path: str, part_bits: int = PART_BITS) -> None:
    """Writes the lines (log_id, session_id, seq, text) of raid sessions as gzipped text, a folder for each export name and in it one for
    each part of the log, numbered in their order; in each the lines are in order. A part is written by one task, so a session of any
    length is spread. _manifest in the same folder lists the parts: (export_name, part, log_id, session_id, lines, first_seq, last_seq).
    """
    named = export_names(sessions.where("is_raid")).select("log_id", F.col("session_no").alias("session_id"), "export_name")
    out = lines.join(named, ["log_id", "session_id"]).withColumn("part", F.lpad(F.shiftright("seq", part_bits).cast("string"), 8, "0"))
    out.repartition("export_name", "part").sortWithinPartitions("export_name", "part", "seq").select("text", "export_name", "part").write.partitionBy("export_name", "part").option("compression", "gzip").text(path)
    parts = out.groupBy("export_name", "part", "log_id", "session_id").agg(F.count("*").alias("lines"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    parts.write.json(f"{path}/_manifest")


def read_export(spark: SparkSession, path: str, name: str) -> DataFrame:
    """An exported session, (part, seq, text): seq grows within a part, and parts are in order."""
    rows = spark.read.text(f"{path}/export_name={name}").select("part", F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    return rows.select(F.col("part").cast("long").alias("part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("seq"), "text")


def stored(df: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Writes a table and reads it again. Decoded lines and entries feed every query: store them once, sorted by log and line within
    files, so that later plans begin at a scan, read only the columns they need, and skip what their logs aren't in.

    Lines are dealt by ranges of log and line number, so a log of any size is spread over files, and a file holds few logs.
    """
    order = [c for c in ("log_id", "session_id", "seq") if c in df.columns]
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
