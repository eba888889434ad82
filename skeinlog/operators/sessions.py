"""Sessions: a log is cut at long pauses, at other raids' zones and at bosses of other instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import decode as D
from . import kernels as K
from . import lookups

# Fixed value: seconds.
GAP = 1800.0


def markers(lines: DataFrame, npcs: DataFrame, aliases: DataFrame) -> DataFrame:
    """What tells sessions apart: (log_id, seq, ts, type, name, instance), from lines (log_id, seq, text).

    Types: zone (canonical name), player, full_player, combat_start, combat_end, boss_kill (with instance), npc_zone.
    """
    t = F.trim("text")
    d = lines.where(D.has(F.col("text"), "ZONE_INFO:", "COMBATANT_INFO:", "PLAYER_REGEN_", "UNIT_DIED:")).select("log_id", "seq", t.alias("text"))
    t = F.col("text")
    # each part is cut out of a line once
    d = D.held(d, _clock=D.clock_parts(t), p=D.roster_parts(t), u=D.died_parts(t)).where("_clock is not null")
    d = D.held(d, ts=D.seconds(F.col("_clock")), z=D.zone(t), r=D.roster_name(F.col("p")), me=D.recorder(t), c=D.combat_state(t)).where("ts is not null")
    kind = lambda test, name, of: F.when(test, F.struct(F.lit(name).alias("type"), of.alias("name")))
    kinds = F.array(
        kind(F.col("z").isNotNull(), "zone", F.col("z")), kind(F.col("r").isNotNull(), "player", F.col("r")), kind(F.col("r").isNotNull() & F.col("me").isNotNull(), "full_player", F.col("me")),
        kind(F.col("c") == "start", "combat_start", F.lit("")), kind(F.col("c") == "end", "combat_end", F.lit("")), kind(F.col("u").isNotNull(), "died", F.col("u")[0]),
    )
    m = d.select("log_id", "seq", "ts", F.explode(kinds).alias("k")).where("k is not null").select("log_id", "seq", "ts", "k.*")
    m = lookups.npc_facts(m.withColumn("_dead", F.when(F.col("type") == "died", F.col("name"))), "_dead", npcs)
    m = m.withColumn("type", F.when(F.col("type") != "died", F.col("type")).when(F.col("is_boss"), "boss_kill").when(F.col("instance").isNotNull(), "npc_zone")).where("type is not null")
    m = lookups.normalize_zone(m, "name", aliases)
    name = F.when(F.col("type") == "zone", F.col("zone")).when(F.col("type") == "npc_zone", F.col("instance")).otherwise(F.col("name"))
    return m.select("log_id", "seq", "ts", "type", name.alias("name"), F.when(F.col("type") == "boss_kill", F.col("instance")).alias("instance"))


def number_sessions(marks: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds session_no to markers, in order of time.

    A pause longer than GAP splits. Within such a segment the state is (zone, instance): a raid zone other than the state's
    zone splits; a boss splits if it is of another instance than the bosses so far or, without any, than the zone. Only zone
    and boss markers that can change the state take part in the fold, with repeats left out, so its arrays are short.
    """
    order = ["ts", "seq", "type"]
    m = lookups.zone_facts(marks.withColumn("_z", F.when(F.col("type") == "zone", F.col("name"))), "_z", zones)
    m = K.gap_sessions(m, ["log_id"], "ts", order, GAP, "segment").drop("is_dungeon", "is_overworld", "encounter_count")
    seg = W.partitionBy("log_id", "segment").orderBy(*order)
    m = m.withColumn("_k", F.when(F.col("is_raid_zone"), F.concat(F.lit("z:"), "name")).when(F.col("instance").isNotNull(), F.concat(F.lit("b:"), "instance")))
    m = m.withColumn("_rn", F.row_number().over(seg))
    steps = m.where("_k is not null").withColumn("_same", F.coalesce(F.lag("_k").over(seg) == F.col("_k"), F.lit(False))).where("not _same")
    arrays = steps.groupBy("log_id", "segment").agg(F.array_sort(F.collect_list(F.struct(F.col("_rn").alias("rn"), F.substring("_k", 1, 1).alias("t"), F.expr("substring(_k, 3)").alias("v")))).alias("s"))
    split = "(if(x.t = 'z', not (coalesce(a.z, '') = x.v), if(a.i is not null, a.i <> x.v, a.z is not null and a.z <> x.v)) and x.rn > 1)"
    fold = f"""aggregate(s, struct(cast(null as string) as z, cast(null as string) as i, cast(array() as array<int>) as cuts), (a, x) -> struct(
        if(x.t = 'z', x.v, if({split}, cast(null as string), a.z)) as z,
        if(x.t = 'b', x.v, if({split}, cast(null as string), a.i)) as i,
        if({split}, concat(a.cuts, array(x.rn)), a.cuts) as cuts)).cuts"""
    cuts = arrays.select("log_id", "segment", F.explode(F.expr(fold)).alias("_rn")).withColumn("_cut", F.lit(1))
    m = m.join(cuts, ["log_id", "segment", "_rn"], "left").withColumn("_new", (F.coalesce("_cut", F.lit(0)) == 1) | (F.col("_rn") == 1))
    return K.islands(m, ["log_id"], order, F.col("_new"), "session_no").drop("_z", "_k", "_rn", "_cut", "_new", "segment")


def sessions(numbered: DataFrame, zones: DataFrame, year: DataFrame | None = None, twins: tuple[str, ...] = ("lower karazhan", "upper karazhan")) -> DataFrame:
    """Sessions with at least one combat: (log_id, session_no, zone, name, is_raid, start_time, end_time, duration, combat_count,
    kill_count, you_players, min_seq, max_seq, start_year).

    zone is the one instance of the kills, else the last raid zone (else the last zone, else unknown). Twin zones, which logs
    can't tell apart, go by the NPCs that died there if no kill decides.
    """
    by = ["log_id", "session_no"]
    spot = F.struct("ts", "seq")
    zone_row = F.col("type") == "zone"
    s = numbered.groupBy(*by).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count_if(F.col("type") == "combat_start").alias("combat_count"),
        F.count_if(F.col("type") == "boss_kill").alias("kill_count"), lookups.single_instance("instance").alias("kill_zone"),
        F.max_by("name", F.when(zone_row & F.col("is_raid_zone"), spot)).alias("raid_zone"), F.max_by("name", F.when(zone_row, spot)).alias("any_zone"),
        F.collect_set(F.when(F.col("type") == "npc_zone", F.col("name"))).alias("npc_zones"), F.sort_array(F.collect_set(F.when(F.col("type") == "full_player", F.col("name")))).alias("you_players"),
        F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
    ).where("combat_count > 0")
    told = F.coalesce("raid_zone", "any_zone", F.lit("unknown"))
    by_npc = F.lit(None).cast("string")
    for z in reversed(twins):
        by_npc = F.when(F.array_contains("npc_zones", z), F.lit(z)).otherwise(by_npc)
    zone = F.coalesce("kill_zone", F.when(told.isin(*twins), F.coalesce(by_npc, told)).otherwise(told))
    s = lookups.zone_facts(s.withColumn("zone", zone), "zone", zones)
    shown = lookups.title_case(F.col("zone"))
    kills, total = F.col("kill_count"), F.coalesce("encounter_count", F.lit(0))
    label = (
        F.when(~F.col("is_raid_zone"), shown).when((total > 0) & (kills > 0) & (kills >= total), F.concat(shown, F.lit(" Full Clear")))
        .when((total > 0) & (kills > 0), F.format_string("%s (%d/%d)", shown, kills, total)).when((kills == 0) & ~F.col("is_dungeon"), F.concat(shown, F.lit(" (wipes)"))).otherwise(shown)
    )
    s = s.withColumn("name", label).withColumnRenamed("is_raid_zone", "is_raid").withColumn("duration", F.col("end_time") - F.col("start_time"))
    s = s.drop("kill_zone", "raid_zone", "any_zone", "npc_zones", "is_dungeon", "is_overworld", "encounter_count")
    return s.withColumn("start_year", F.lit(None).cast("int")) if year is None else s.join(year.select("log_id", F.col("year").alias("start_year")), "log_id", "left")


def log_years(lines: DataFrame) -> DataFrame:
    """Year of each log's first roster line: (log_id, year)."""
    y = lines.where(F.col("text").contains("COMBATANT_INFO:")).select("log_id", "seq", D.year(F.trim("text")).alias("year")).where("year is not null")
    return y.groupBy("log_id").agg(F.min_by("year", "seq").alias("year"))


def line_ranges(sessions: DataFrame) -> DataFrame:
    """Adds first_line, last_line (generous bounds) and t_lo, t_hi (midpoints to the neighbours; null: no bound)."""
    w = W.partitionBy("log_id").orderBy("start_time")
    return (
        sessions.withColumn("first_line", F.col("min_seq"))
        .withColumn("last_line", F.when(F.lead("min_seq").over(w).isNotNull(), F.greatest(F.col("max_seq"), F.lead("min_seq").over(w))))
        .withColumn("t_lo", (F.lag("end_time").over(w) + F.col("start_time")) / 2)
        .withColumn("t_hi", (F.lead("start_time").over(w) + F.col("end_time")) / 2)
    )


def assign_lines(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """Lines of each session, with session_id: inside its line bounds and times; lines without a time stay."""
    s = line_ranges(sessions).select(F.col("log_id").alias("_log"), F.col("session_no").alias("session_id"), "first_line", "last_line", "t_lo", "t_hi")
    timed = D.held(lines.where(F.trim("text") != ""), _clock=D.clock_parts(F.trim("text"))).withColumn("_ts", D.seconds(F.col("_clock"))).drop("_clock")
    inside = (F.col("seq") >= F.col("first_line")) & (F.col("last_line").isNull() | (F.col("seq") <= F.col("last_line")))
    when = F.col("_ts").isNull() | (((F.col("t_lo").isNull()) | (F.col("_ts") >= F.col("t_lo"))) & ((F.col("t_hi").isNull()) | (F.col("_ts") <= F.col("t_hi"))))
    # tested inside the join, so no line is listed once for each session of its log
    return timed.join(s, (F.col("log_id") == F.col("_log")) & inside & when).drop("_ts", "_log", "first_line", "last_line", "t_lo", "t_hi")


def whole_log(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """Logs without a raid session are one session (number 0)."""
    return lines.join(sessions.where("is_raid").select("log_id").distinct(), "log_id", "left_anti").withColumn("session_id", F.lit(0).cast("long"))


def date_text(ts: Column, year: Column, day_first: bool = False) -> Column:
    """YYYY-MM-DD or DD/MM/YYYY of the log's clock."""
    day = F.floor(ts / 86400).cast("int")
    month = F.floor((day - 1) / 31).cast("int")
    d = day - month * 31
    return F.format_string("%02d/%02d/%04d", d, month, year) if day_first else F.format_string("%04d-%02d-%02d", year, month, d)


def display(sessions: DataFrame) -> DataFrame:
    """Adds shown: name, day and length of a session."""
    from ..functions import text

    return sessions.withColumn("shown", F.concat_ws(" - ", "name", date_text(F.col("start_time"), F.col("start_year"), day_first=True), text.spoken(F.col("duration"))))
