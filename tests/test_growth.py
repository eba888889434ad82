"""Steps whose work must grow no faster than their input."""

import glob
import os
import re
import time

from minilog import at, lines, npcs, roster
from pyspark.sql import functions as F

from skeinlog.functions import decode
from skeinlog.operators import entries, kernels, sessions
from skeinlog.sources import scratch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_family_has_a_generator(spark):
    """The JVM interprets methods of more than 8,000 bytes, so no generator may hold the patterns of all families."""
    most = max(node.count("regexp_replace(") for node in re.findall(r"Generate explode.*", plan(decode.decode(lines(spark, at(0, "Ann hits Bog for 1."))))))
    assert most <= 30


def test_marks_cut_lines_once(spark):
    aliases = spark.createDataFrame([("the bog", "Bog Keep")], "alias string, canonical string")
    l = lines(spark, at(0, roster("Ann", you=True)), at(2, "ZONE_INFO: 1&The Bog&0"), at(10, "PLAYER_REGEN_DISABLED"), at(21, "UNIT_DIED:Mire Lord:0xF13")).drop("session_id")  # noqa: E741
    m = sessions.markers(l, npcs(spark), aliases)
    # times, and the field of names, each in one place
    assert plan(m).count(r"regexp_extract(text#") <= 8 and "transform(" not in plan(m)
    assert [(r.type, r["name"]) for r in m.orderBy("seq", "type").collect()] == [("full_player", "Ann"), ("player", "Ann"), ("zone", "bog keep"), ("combat_start", ""), ("boss_kill", "Mire Lord")]


def test_lines_meet_few_marks(spark):
    """A line is held against all marks of its block: with a mark at every other line, the pairs stay near the lines."""
    df = spark.range(100_000).select(F.lit("a").alias("k"), F.col("id").alias("seq"))
    marks = df.where("seq % 2 = 0").withColumn("last", F.col("seq"))
    spans = kernels.stretches(marks, df, ["k"], ["last"])
    assert spans.groupBy("k", "_block").count().agg(F.max("count")).first()[0] <= 513
    assert kernels.along(df, spans, ["k"]).where("last is null or seq - last not in (0, 1)").count() == 0


def test_blocks_hold_names_of_their_rows(spark):
    """A large roster isn't listed for each block, only the names that the block's rows say."""
    players = spark.range(5000).select(F.lit("a").alias("log_id"), F.lit(0).alias("session_id"), F.concat(F.lit("P"), "id").alias("name"), F.col("id").alias("first_seen_seq"))
    rows = spark.range(20_000).select(F.lit("a").alias("log_id"), F.lit(0).alias("session_id"), F.col("id").alias("seq"), F.concat(F.lit("P"), F.expr("(id div 2000) * 700")).alias("name"))
    told = entries.block_names(rows, players, ["name"])
    assert told.agg(F.max(F.size("_names"))).first()[0] <= 2
    flags = entries.met(rows, players, {"name": "now"}).join(entries.met(rows, players, {"name": "ever"}, None).select("seq", "ever"), "seq")
    assert flags.where("now <> (seq div 2000 * 700 < least(seq, 5000)) or ever <> (seq div 2000 * 700 < 5000)").count() == 0


def test_lines_are_decoded_once(spark):
    """Queries that read decoded lines several times store them before."""
    from skeinlog.plans import lines as queries

    for name in ("heals_by_rank", "gated_by_roster", "avoided_by_roster"):
        assert "regexp_extract" not in plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_cut_tables_leave_no_shuffle_files(spark):
    top = spark.sparkContext._jvm.java.lang.System.getProperty("java.io.tmpdir")
    kept = lambda: sum(os.path.getsize(os.path.join(at, f)) for b in glob.glob(f"{top}/blockmgr-*") for at, _, fs in os.walk(b) for f in fs if f.startswith("shuffle_"))
    before = kept()
    out = scratch.cut(spark.range(200_000).selectExpr("id", "hash(id) as h").repartition(4, "h"))
    for _ in range(50):
        if kept() - before < 100_000:
            break
        time.sleep(0.1)
    assert out.count() == 200_000 and kept() - before < 100_000


def test_gates_deal_lines_once(spark):
    """Entries meet combat marks and names in a window in their block, not by a join with all marks."""
    d = scratch.cut(decode.decode(lines(spark, at(0, roster("Ann")), at(1, "PLAYER_REGEN_DISABLED"), at(2, "Ann hits Bog for 1."), at(9, "PLAYER_REGEN_ENABLED"))))
    p = plan(entries.gated_entries(d, entries.roster(d)))
    assert "_from" not in p and "_to" not in p
