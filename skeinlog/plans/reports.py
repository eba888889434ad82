"""Report queries: meters, breakdowns, logs and tables over the facts, for many logs and sessions at once.

Results aren't sorted, as most are aggregated further or shown for one session; shown() sorts one for display, ties by name, so
that what is shown is stable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import kernels as K
from ..operators import selection
from ..operators.entries import KEY

# The longest bar's share, row limits of the browser and the event log, seconds of death windows.
BAR, BROWSER_ROWS, LOG_ROWS, DEATH_WINDOWS = 0.75, 500, 5000, (10, 15, 20, 30)


def ranked(totals: DataFrame, value: str, keys: Sequence[str] = (), name: str = "player", scale: Column | None = None) -> DataFrame:
    """Drops zeros and adds rank, pct (of the total) and bar (share of the longest, which fills BAR).

    One row a player: the windows run over totals, never over events.
    """
    w = W.partitionBy(*keys)
    top = scale if scale is not None else F.max(value).over(w) / BAR
    return (
        totals.where(F.col(value) > 0)
        .withColumn("rank", F.rank().over(w.orderBy(F.desc(value))))
        .withColumn("pct", 100 * F.try_divide(F.col(value).cast("double"), F.sum(value).over(w).cast("double")))
        .withColumn("bar", F.try_divide(F.col(value).cast("double"), top.cast("double")))
    )


def top(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


#: How each report is shown, within a session.
ORDERS = {
    "meter": ("rank", "player"), "counts": ("-n", "player"), "avoidance": ("-total", "player"), "abilities": ("player", "is_pet", "-total", "ability"),
    "healing": ("player", "-effective", "ability"), "taken": ("player", "-source_total", "source", "-total", "ability"), "lines": ("seq",), "entries": ("seq", "sub"),
    "buffs": ("player", "-uptime", "-gains", "aura"), "consumables": ("player", "category", "-n", "consumable"), "loot": ("pos",),
}


def shown(report: DataFrame, kind: str) -> DataFrame:
    """A report in the order in which it is shown, session by session."""
    return report.orderBy(*KEY, *[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in ORDERS[kind]])


def last_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = BROWSER_ROWS) -> DataFrame:
    """The last n rows of each key."""
    return top(rows, keys, [F.desc(c) for c in order], n)


def with_averages(abilities: DataFrame, keys: Sequence[str], value: str = "total") -> DataFrame:
    """Adds avg_hit (without crits), avg_crit, crit_pct and pct of the key's total; whole numbers, null where nothing counts."""
    normal = F.col("hits") - F.col("crits")
    return (
        abilities.withColumn("avg_hit", F.when(normal > 0, F.expr(f"greatest({value} - crit_total, 0) div (hits - crits)")))
        .withColumn("avg_crit", F.when(F.col("crits") > 0, F.expr("crit_total div crits")))
        .withColumn("crit_pct", 100 * F.try_divide(F.col("crits").cast("double"), F.col("hits").cast("double")))
        .withColumn("pct", 100 * F.try_divide(F.col(value).cast("double"), F.sum(value).over(W.partitionBy(*keys)).cast("double")))
    )


def damage_meter(totals: DataFrame, active: DataFrame, duration: DataFrame, mode: str = "total") -> DataFrame:
    """Players by damage: mode total, personal (without pets) or taken; with per_second over the selected time."""
    value = {"total": F.col("damage"), "personal": F.greatest(F.col("damage") - F.col("pet_damage"), F.lit(0)), "taken": F.col("damage_taken")}[mode]
    return _meter(totals, active, duration, value)


def healing_meter(totals: DataFrame, active: DataFrame, duration: DataFrame, mode: str = "effective") -> DataFrame:
    """Players by effective, raw or over-healing."""
    return _meter(totals, active, duration, {"effective": F.col("effective"), "raw": F.col("healing"), "overheal": F.col("overheal")}[mode])


def healing_combined(totals: DataFrame, active: DataFrame, duration: DataFrame) -> DataFrame:
    """Effective healing with overheal behind it, both on one scale."""
    m = totals.join(active.select(*KEY, F.col("name").alias("player")), [*KEY, "player"], "left_semi").withColumn("value", F.col("effective"))
    w = W.partitionBy(*KEY)
    m = m.withColumn("_scale", F.greatest(F.max("effective").over(w) / BAR, F.max(F.col("effective") + F.col("overheal")).over(w).cast("double")))
    out = ranked(m, "value", KEY, scale=F.col("_scale")).withColumn("over_bar", F.col("overheal") / F.col("_scale"))
    out = out.withColumn("overheal_pct", 100 * F.try_divide(F.col("overheal").cast("double"), (F.col("effective") + F.col("overheal")).cast("double")))
    return _per_second(out.drop("_scale"), duration)


def _meter(totals: DataFrame, active: DataFrame, duration: DataFrame, value: Column) -> DataFrame:
    m = totals.join(active.select(*KEY, F.col("name").alias("player")), [*KEY, "player"], "left_semi")
    return _per_second(ranked(m.select(*KEY, "player", value.alias("value")), "value", KEY), duration)


def _per_second(m: DataFrame, duration: DataFrame) -> DataFrame:
    return m.join(duration, KEY, "left").withColumn("per_second", F.coalesce(F.try_divide(F.col("value").cast("double"), F.col("duration")), F.lit(0.0))).drop("duration")


def counts_by(rows: DataFrame, kind: str, who: str = "source") -> DataFrame:
    """Dispels, interrupts, resurrections or deaths per player."""
    return rows.where(F.col("kind") == kind).groupBy(*KEY, F.col(who).alias("player")).agg(F.count("*").alias("n"))


def avoidance_totals(avoidance: DataFrame) -> DataFrame:
    """Attacks avoided: dodged, parried, blocked and missed."""
    return avoidance.withColumn("total", F.col("dodges") + F.col("parries") + F.col("blocks") + F.col("missed_by")).where("total > 0")


def avoidance_detail(avoidance: DataFrame) -> DataFrame:
    """One row for each way of avoiding, with full mitigation."""
    kinds = ["dodges", "parries", "blocks", "missed_by", "misses", "full_resists", "full_absorbs", "full_blocks"]
    return avoidance.unpivot([*KEY, "player"], kinds, "way", "n").where("n > 0")


def distinct_buffs(buffs: DataFrame) -> DataFrame:
    """Different buffs per player, and per session over all (player null)."""
    mine = buffs.groupBy(*KEY, "player").agg(F.count_distinct("buff").alias("n"))
    return mine.unionByName(buffs.groupBy(*KEY).agg(F.count_distinct("buff").alias("n")), allowMissingColumns=True)


def abilities(done: DataFrame) -> DataFrame:
    """A player's abilities with averages; pets' show their name."""
    out = with_averages(done, [*KEY, "player"])
    return out.withColumn("shown", F.when(F.col("is_pet"), F.concat("ability", F.lit(" (Pet)"))).otherwise(F.col("ability")))


def healing_abilities(healed: DataFrame) -> DataFrame:
    """A player's healing abilities; averages are of effective healing, crits sharing in it as in the total."""
    crit = F.floor(F.col("crit_total") * F.coalesce(F.try_divide(F.col("effective").cast("double"), F.col("total").cast("double")), F.lit(0.0)))
    out = with_averages(healed.withColumn("crit_total", crit), [*KEY, "player"], "effective")
    return out.withColumn("overheal_pct", 100 * F.try_divide(F.col("overheal").cast("double"), F.col("total").cast("double")))


def taken_by_source(taken: DataFrame) -> DataFrame:
    """Damage taken by source, then ability: totals of the source beside each ability's."""
    by_source = W.partitionBy(*KEY, "player", "source")
    out = taken.withColumn("source_total", F.sum("total").over(by_source)).withColumn("mitigated", F.col("absorbed") + F.col("resisted") + F.col("blocked"))
    return out


def cast_detail(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """A player's dispels or interrupts by spell, and the five targets met most often."""
    r = rows.where(F.col("kind") == kind).withColumnRenamed("source", "player")
    spells = r.groupBy(*KEY, "player", "spell").agg(F.count("*").alias("n"))
    targets = r.groupBy(*KEY, "player", "target").agg(F.count("*").alias("n"))
    return spells, top(targets, [*KEY, "player"], [F.desc("n"), F.asc("target")], 5)


def resurrect_detail(rows: DataFrame) -> DataFrame:
    """Resurrections in order: time, caster, target and spell."""
    r = rows.where("kind = 'Resurrect'")
    return r.select(*KEY, "seq", text.clock(F.col("ts")).alias("time"), F.col("source").alias("player"), "target", "spell")


def death_detail(deaths: DataFrame, player: str) -> DataFrame:
    """A player's deaths in order, with the killing blow."""
    d = deaths.where(F.col("player") == player)
    return d.select(*KEY, "seq", text.clock(F.col("ts")).alias("time"), "killer", "killing_blow", "damage_amount")


def buff_detail(uptimes: DataFrame) -> DataFrame:
    """Uptimes as percent, see timeline.buff_uptime."""
    return uptimes.withColumn("uptime_pct", 100 * F.col("uptime"))


def consumables_of(uses: DataFrame) -> DataFrame:
    """A player's consumables by category, then item, with the category's total."""
    items = uses.groupBy(*KEY, "player", "category", "label", "consumable").agg(F.count("*").alias("n"))
    return items.withColumn("category_total", F.sum("n").over(W.partitionBy(*KEY, "player", "category")))


def consumables_overview(uses: DataFrame) -> DataFrame:
    """Uses of each session by player, category and item, with subtotals: level 0 items, 1 categories, 2 players, 3 the session.

    Columns above a row's level are null; a category may be null at level 0 and 1 too (items of no category).
    """
    by = ["player", "category", "consumable"]
    levels = [[*KEY, *by[:k]] for k in (3, 2, 1, 0)]
    told = uses.groupingSets([[F.col(c) for c in g] for g in levels], *KEY, *by).agg(F.count("*").alias("n"), F.grouping_id().alias("_id"))
    level = F.when(F.col("_id") == 0, 0).when(F.col("_id") == 1, 1).when(F.col("_id") == 3, 2).otherwise(3)
    return told.withColumn("level", level).drop("_id")


def consumable_uses_by_player(uses: DataFrame) -> DataFrame:
    """Uses of each player of a session."""
    return uses.groupBy(*KEY, "player").agg(F.count("*").alias("n"))


def consumable_matrix(uses: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Players by category; columns without any use are left out."""
    m = uses.groupBy(*KEY, "player").pivot("label", list(labels)).count()
    used = uses.select("label").distinct().where(F.col("label").isin(*labels)).collect()  # at most as many as labels
    return m.select(*KEY, "player", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in labels if c in {r[0] for r in used}])


def player_card(players: DataFrame) -> DataFrame:
    filled = F.size(F.filter("gear", lambda g: g.isNotNull()))
    return players.select(*KEY, "name", "class", "race", "guild", "talents", F.when(F.col("gear").isNull(), 0).otherwise(filled).alias("gear_slots"))


def death_log(deaths: DataFrame, encounters: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """Deaths with the first encounter that holds them; with players, only theirs."""
    d = deaths if players is None else deaths.join(players.select(*KEY, F.col("name").alias("player")), [*KEY, "player"], "left_semi")
    spans = encounters.select(*KEY, "enc_idx", F.col("name").alias("_name"), F.col("start").alias("_lo"), F.col("end").alias("_hi"))
    within = K.range_attach(d, spans, KEY, "ts", "_lo", "_hi", 600.0).groupBy(*KEY, "seq").agg(F.min_by(F.coalesce("_name", F.lit("Trash")), "enc_idx").alias("encounter"))
    return d.join(within, [*KEY, "seq"], "left").withColumn("time", text.clock(F.col("ts")))


def event_browser(entries: DataFrame, encounters: DataFrame, which: str | int = "all", player: str | None = None) -> DataFrame:
    """The last BROWSER_ROWS rows of each session's selection, as text."""
    rows = selection.in_selection(entries, encounters, which)
    rows = rows if player is None else selection.about_player(rows, player)
    return last_rows(rows, KEY, ["seq", "sub"]).withColumn("text", text.event_line())


#: What the event log shows.
MODES = ("all", "key", "deaths")


def event_log(entries: DataFrame, encounters: DataFrame, which: str | int = "all", mode: str = "all", deaths: DataFrame | None = None, big_hit: int = 2000, seconds: float = DEATH_WINDOWS[0]) -> DataFrame:
    """The first LOG_ROWS rows of each session's selection: all events; key ones (deaths, dispels, resurrections, interrupts, big hits
    on players); or what led to each of deaths, by the first death window that holds it."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}; there are {', '.join(MODES)}")
    rows = selection.in_selection(entries, encounters, which)
    if mode == "key":
        rows = rows.where(f"kind in ('Death', 'Dispel', 'Resurrect', 'Interrupt') or (kind = 'Damage' and amount >= {big_hit} and target_known)")
    if mode == "deaths":
        if deaths is None:
            raise ValueError("the mode deaths needs the deaths")
        rows = death_replay(rows, deaths, encounters, seconds)
    return top(rows, KEY, [F.asc("seq"), F.asc("sub")], LOG_ROWS).withColumn("text", text.event_line(short=mode == "key"))


def death_replay(entries: DataFrame, deaths: DataFrame, encounters: DataFrame | None = None, seconds: float = 10) -> DataFrame:
    """Events about a player who is about to die, by the first death window that holds them, cut at the pull."""
    d = deaths.select(*KEY, F.col("seq").alias("death"), "ts", "player")
    if encounters is None:
        d = d.withColumn("_s", F.lit(None).cast("double"))
    else:
        d = K.range_attach(d, encounters.select(*KEY, F.col("start").alias("_s"), F.col("end").alias("_e")), KEY, "ts", "_s", "_e", 600.0, "left")
    d = d.groupBy(*KEY, "death", "player").agg(F.first("ts").alias("death_ts"), F.min("_s").alias("_s"))
    d = d.withColumn("_lo", F.greatest(F.col("death_ts") - seconds, F.coalesce("_s", F.col("death_ts") - seconds)))
    who = entries.select("*", F.explode(F.array_distinct(F.array_compact(F.array("source", "target")))).alias("player"))
    hit = K.range_attach(who, d.withColumnRenamed("_s", "_pull"), [*KEY, "player"], "ts", "_lo", "death_ts", seconds)
    first = hit.groupBy(*KEY, "seq", "sub").agg(F.min(F.struct("death_ts", "death", "player")).alias("f"))
    return entries.join(first, [*KEY, "seq", "sub"]).withColumn("victim", F.col("f.player")).withColumn("death", F.col("f.death")).withColumn("to_death", F.col("f.death_ts") - F.col("ts")).drop("f")


def loot_by_boss(loot: DataFrame, encounters: DataFrame | None = None, notable: bool = True) -> DataFrame:
    """Loot with its place pos in a session's list: bosses in the order they were first looted; best quality first, then name. With
    encounters: of their bosses only."""
    out = loot.where("quality >= 2") if notable else loot
    if encounters is not None:
        out = out.join(encounters.select(*KEY, F.col("name").alias("boss")), [*KEY, "boss"], "left_semi")
    firsts = out.groupBy(*KEY, "boss").agg(F.min("seq").alias("_first"))
    placed = K.attach(out, firsts, [*KEY, "boss"]).withColumn("_less", F.coalesce(-F.col("quality").cast("long"), F.lit(2**62)))
    return K.ranked_within(placed, KEY, ["_first", "_less", "item_name", "seq"], "pos").drop("_first", "_less", "_part")


def session_report(sessions: DataFrame, encounters: DataFrame, gap: float = 1800.0) -> DataFrame:
    """Sessions with kills, wipes, the gap to the one before, and whether they should have been one."""
    e = encounters.where("is_boss").groupBy(*KEY).agg(F.count_if("is_kill").alias("kills"), F.count_if(~F.col("is_kill")).alias("wipes"))
    order = W.partitionBy("log_id").orderBy("start_time")
    out = sessions.join(e, KEY, "left").na.fill(0, ["kills", "wipes"]).withColumn("gap_before", F.col("start_time") - F.lag("end_time").over(order))
    return out.withColumn("should_merge", F.coalesce((F.col("gap_before") <= gap) & (F.lag("zone").over(order) == F.col("zone")), F.lit(False)))
