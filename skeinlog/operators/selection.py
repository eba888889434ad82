"""Selections of encounters, and what is recomputed for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import aggregates
from . import kernels as K
from .entries import KEY, met

# Seconds and rows of an opener.
OPENER_SECONDS, OPENER_ROWS = 10.0, 8


def selected(encounters: DataFrame, which: str | int = "all") -> DataFrame:
    """Encounters of a filter: all, kills, wipes, trash, or one by its number."""
    tests = {"all": F.lit(True), "kills": F.expr("is_boss and is_kill"), "wipes": F.expr("is_boss and not is_kill"), "trash": F.expr("not is_boss")}
    return encounters.where(tests[which] if isinstance(which, str) else F.col("enc_idx") == which)


def merged_windows(windows: DataFrame, keys: Sequence[str], width: float, start: str = "start", end: str = "end") -> DataFrame:
    """Union of the windows as intervals that don't overlap in a bucket of time: (keys, _bucket, start, end), listed under each
    bucket touched. However many windows there are, long ones leave at most a few dozen intervals for a bucket.

    Starts in one cell, a small part of the width, lie closer than long windows last, so those overlap and a plain minimum and
    maximum unites them before the sort by bucket.
    """
    cell = width / 32
    long = F.col(end) - F.col(start) >= 2 * cell
    cells = windows.where(F.col(end) >= F.col(start)).groupBy(
        *keys, F.when(long, F.floor(F.col(start) / cell)).alias("_cell"), F.when(~long, F.col(start)).alias("_own")
    ).agg(F.min(start).alias(start), F.max(end).alias(end))
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    listed = cells.select(*keys, start, end, F.explode(F.sequence(bucket(start), bucket(end))).alias("_bucket"))
    return K.interval_islands(listed, [*keys, "_bucket"], start, end).drop("island")


def in_windows(rows: DataFrame, windows: DataFrame, keys: Sequence[str] = KEY, width: float = 600.0, at: str = "ts") -> DataFrame:
    """Rows inside any window (both ends included), each once: a bucketed semi join with the union of the windows."""
    spans = windows.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("start").alias("_lo"), F.col("end").alias("_hi"))
    spans = merged_windows(spans, [f"_k_{k}" for k in keys], width, "_lo", "_hi")
    spots = rows.withColumn("_spot", F.floor(F.col(at) / width).cast("long"))
    on = (F.col("_spot") == F.col("_bucket")) & F.col(at).between(F.col("_lo"), F.col("_hi"))
    for k in keys:
        on &= spots[k].eqNullSafe(F.col(f"_k_{k}"))
    return spots.join(spans, on, "left_semi").drop("_spot")


def in_selection(rows: DataFrame, encounters: DataFrame, which: str | int = "all") -> DataFrame:
    """Rows of the selection; the filter all keeps the whole session."""
    return rows if which == "all" else in_windows(rows, selected(encounters, which))


def duration(encounters: DataFrame, which: str | int = "all") -> DataFrame:
    """Seconds of the selected encounters, also for all."""
    return selected(encounters, which).groupBy(*KEY).agg(F.sum(F.col("end") - F.col("start")).alias("duration"))


def filtered_stats(entries: DataFrame, encounters: DataFrame, players: DataFrame, which: str | int = "all") -> dict[str, DataFrame]:
    """Statistics of a selection: done, taken, healed (see aggregates) and totals.

    For all, those of the whole session, where healing counts for players known as of its line; for any other filter they are
    counted anew over the selection, by the final roster.
    """
    rows = in_selection(entries, encounters, which)
    if which != "all":
        rows = met(rows.drop("target_known"), players, {"target": "target_known"}, None)
    done, taken, healed = aggregates.damage_done(rows), aggregates.damage_taken(rows), aggregates.healing_done(rows)
    return {"done": done, "taken": taken, "healed": healed, "totals": aggregates.player_totals(done, taken, healed)}


def opener(rows: DataFrame, keys: Sequence[str], at: str, seq: str, seconds: float = OPENER_SECONDS, most: int = OPENER_ROWS) -> DataFrame:
    """The first rows of each key within some time of its first, with their delay and number rn."""
    w = W.partitionBy(*keys)
    out = rows.withColumn("delay", F.col(at) - F.min(at).over(w)).withColumn("rn", F.row_number().over(w.orderBy(at, seq)))
    return out.where((F.col("delay") <= seconds) & (F.col("rn") <= most))


def with_class(rows: DataFrame, players: DataFrame, name: str) -> DataFrame:
    """Adds class of a player, UNKNOWN for others."""
    p = players.select(*KEY, F.col("name").alias(name), "class")
    return rows.join(p, [*KEY, name], "left").withColumn("class", F.coalesce("class", F.lit("UNKNOWN")))


def catalogue(encounters: DataFrame) -> DataFrame:
    """Counts and durations by category, and one label for each boss encounter: (keys, category, enc_idx, n, duration, label)."""
    category = F.when(~F.col("is_boss"), "trash").when(F.col("is_kill"), "kills").otherwise("wipes")
    e = encounters.withColumn("category", category).withColumn("d", F.col("end") - F.col("start"))
    whole = e.withColumn("category", F.lit("all")).unionByName(e).groupBy(*KEY, "category").agg(F.count("*").alias("n"), F.sum("d").alias("duration"))
    label = F.concat(F.coalesce("name", F.lit("Unknown")), F.when(F.col("is_kill"), " (Kill)").otherwise(F.concat(F.lit(" (Wipe "), F.coalesce("attempt", F.lit(1)).cast("string"), F.lit(")"))))
    single = e.where("is_boss").select(*KEY, F.lit("single").alias("category"), "enc_idx", F.lit(1).cast("long").alias("n"), F.col("d").alias("duration"), label.alias("label"))
    return whole.unionByName(single, allowMissingColumns=True)


def text_matches(column: str, needle: str) -> Column:
    return F.lower(column).contains(needle.lower())


def of_kinds(rows: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Entries of the kinds asked for: Death also covers Resurrect; auras never pass."""
    wanted = set(kinds) | ({"Resurrect"} if "Death" in kinds else set())
    return rows.where(F.col("kind").isin(*wanted) & ~F.col("kind").isin("AuraGain", "AuraFade"))


def about_player(rows: DataFrame, player: str) -> DataFrame:
    return rows.where((F.col("source") == player) | (F.col("target") == player))
