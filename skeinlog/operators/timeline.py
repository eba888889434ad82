"""Timelines, intervals and series over the selected encounters, put one after another on one axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from . import lookups
from .entries import KEY

# Seconds before the first pull, and the least damage of a big hit.
PRE_PULL, BIG_HIT = 300.0, 2000
# The preset of auras that players bring from outside.
WORLD_BUFFS = (
    "Rallying Cry of the Dragonslayer", "Spirit of Zandalar", "Songflower Serenade", "Warchief's Blessing",
    "Mol'dar's Moxie", "Fengus' Ferocity", "Slip'kik's Savvy",
)


def on_axis(encounters: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Adds base: the summed durations of the selected encounters before each."""
    order = W.partitionBy(*keys).orderBy("enc_idx").rowsBetween(W.unboundedPreceding, -1)
    length = F.col("end") - F.col("start")
    return encounters.withColumn("base", F.coalesce(F.sum(length).over(order), F.lit(0)))


def concatenated_offset(rows: DataFrame, encounters: DataFrame, keys: Sequence[str] = KEY, width: float = 600.0) -> DataFrame:
    """Rows inside encounters with enc_idx and offset on the axis; a row in two windows counts twice."""
    spans = on_axis(encounters, keys).select(*keys, "enc_idx", F.col("start").alias("_lo"), F.col("end").alias("_hi"), "base")
    hit = K.range_attach(rows, spans, keys, "ts", "_lo", "_hi", width)
    return hit.withColumn("offset", F.col("ts") - F.col("_lo") + F.col("base")).drop("_lo", "_hi", "base")


def _players(entries: DataFrame, active: DataFrame) -> DataFrame:
    """Adds s and t: whether source and target are active players, and pet: whether the target is an active player's pet."""
    p = active.select(*KEY, F.col("name").alias("_n"), F.lit(True).alias("_hit"))
    out = entries
    for c, flag in (("source", "s"), ("target", "t")):
        out = out.join(p.withColumnRenamed("_n", c).withColumnRenamed("_hit", flag), [*KEY, c], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    pets = active.where("pet_name is not null").select(*KEY, F.concat("pet_name", F.lit(" ("), "name", F.lit(")")).alias("target"), F.lit(True).alias("pet"))
    return out.join(pets, [*KEY, "target"], "left").withColumn("pet", F.coalesce("pet", F.lit(False)))


def buckets(entries: DataFrame, encounters: DataFrame, active: DataFrame) -> DataFrame:
    """One row a second of the axis: damage, damage_taken, healing, boss_healing and alive."""
    e = _players(concatenated_offset(entries, encounters), active).withColumn("second", F.floor("offset"))
    amount = lambda test, value: F.coalesce(F.sum(F.when(F.expr(test), F.col(value))), F.lit(0)).cast("long")
    sums = {
        "damage": amount("kind = 'Damage' and s", "amount"), "damage_taken": amount("kind = 'Damage' and t", "amount"),
        "healing": amount("kind = 'Healing' and s and t", "effective_heal"), "boss_healing": amount("kind = 'Healing' and s and not t and not pet", "effective_heal"),
    }
    length = encounters.groupBy(*KEY).agg(F.sum(F.col("end") - F.col("start")).alias("_d")).where("_d > 0")
    axis = length.select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil("_d"))).alias("second"))
    dense = K.dense_buckets(e, KEY, "second", sums, axis).na.fill(0, list(sums))
    dense = dense.join(alive(e, encounters, active), [*KEY, "second"], "left")
    raid = active.groupBy(*KEY).agg(F.count("*").alias("_raid"))
    idle = (F.coalesce("alive", F.lit(0)) == 0) & (F.col("damage") == 0) & (F.col("healing") == 0) & (F.col("damage_taken") == 0)
    dense = dense.withColumn("_set", F.when(~idle, F.coalesce("alive", F.lit(0))))
    filled = K.asof_last(dense, KEY, ["second"], F.col("_set"), "_alive").join(raid, KEY, "left")
    return filled.withColumn("alive", F.coalesce("_alive", "_raid", F.lit(0))).drop("_set", "_alive", "_raid")


def alive(placed: DataFrame, encounters: DataFrame, active: DataFrame) -> DataFrame:
    """Players alive at the end of each second that has a row: the roster's size at each pull, less deaths, plus resurrections."""
    raid = active.groupBy(*KEY).agg(F.count("*").alias("raid"))
    first = on_axis(encounters).select(*KEY, "enc_idx", F.col("base").alias("offset"), F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("step"))
    step = F.expr("case when kind = 'Death' and s then -1 when kind = 'Resurrect' and t then 1 else 0 end")
    steps = first.unionByName(placed.select(*KEY, "enc_idx", "offset", "seq", step.alias("step"))).join(raid, KEY)
    levels = K.clamped_fold(steps.where("step <> 0 or seq = -1"), [*KEY, "enc_idx"], ["seq"], "step", 0, "raid", "raid")
    at = K.asof_last(steps.join(levels, [*KEY, "enc_idx", "seq"], "left"), [*KEY, "enc_idx"], ["seq"], F.col("level"), "alive")
    return at.groupBy(*KEY, F.floor("offset").alias("second")).agg(F.max_by("alive", F.struct("enc_idx", "seq")).alias("alive"))


def peaks(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy(*KEY).agg(*[F.max(c).alias(f"max_{n}") for c, n in (("damage", "dps"), ("damage_taken", "dtps"), ("healing", "hps"), ("boss_healing", "boss_hps"))])


def point_events(entries: DataFrame, encounters: DataFrame, active: DataFrame, big_hit: int = BIG_HIT) -> DataFrame:
    """Deaths, big hits on players, dispels, resurrections and interrupts with a label: (keys, offset, seq, kind, label)."""
    e = _players(concatenated_offset(entries, encounters), active)
    label = F.expr(f"""case
        when kind = 'Death' and s then concat(source, ' died')
        when kind = 'Damage' and t and amount >= {big_hit} then concat(target, ' takes ', amount, ' from ', source, "'s ", spell)
        when kind = 'Dispel' then concat(source, ' dispels ', spell, ' on ', target)
        when kind = 'Resurrect' and t then concat(source, ' resurrects ', target)
        when kind = 'Interrupt' then concat(source, ' interrupts ', target, ' with ', spell) end""")
    kind = F.when(F.col("kind") == "Damage", "BigHit").otherwise(F.col("kind"))
    return e.select(*KEY, "offset", "seq", kind.alias("kind"), label.alias("label")).where("label is not null")


def dispel_casters(entries: DataFrame, encounters: DataFrame) -> DataFrame:
    """Casters of dispels, with their number."""
    d = concatenated_offset(entries.where("kind = 'Dispel'"), encounters)
    return d.groupBy(*KEY, F.col("source").alias("caster")).count()


def aura_intervals(entries: DataFrame, encounters: DataFrame, persistent: DataFrame | None = None) -> DataFrame:
    """Intervals of auras on the axis: (keys, player, aura, enc_idx, start, end).

    In each encounter a fade closes the newest open gain. An aura whose last event before the pull is a gain is open from the
    pull. What is still open ends with the player's first death, or with the encounter if the aura outlasts death
    (persistent: (buff, death_persistent)); it is kept if that is after its start.
    """
    marks = entries.where("kind in ('AuraGain', 'AuraFade')").select(*KEY, "seq", "ts", "kind", F.col("source").alias("player"), F.col("spell").alias("aura"))
    axis = on_axis(encounters)
    inside = concatenated_offset(marks, encounters).select(*KEY, "enc_idx", "player", "aura", "seq", "offset", (F.col("kind") == "AuraGain").alias("gain"))

    # the state before each pull: pulls and aura events in one order, per player and aura
    pairs = marks.select(*KEY, "player", "aura").distinct()
    pulls = axis.select(*KEY, "enc_idx", F.col("start").alias("ts"), "base").join(pairs, KEY)
    both = marks.select(*KEY, "player", "aura", "ts", "seq", F.lit(1).alias("side"), F.col("kind").alias("k")).unionByName(
        pulls.select(*KEY, "player", "aura", "ts", "enc_idx", "base", F.lit(0).alias("side")), allowMissingColumns=True
    )
    state = K.asof_last(both, [*KEY, "player", "aura"], ["ts", "side", "seq"], F.col("k"), "state").where("side = 0 and state = 'AuraGain'")
    opened = state.select(*KEY, "enc_idx", "player", "aura", F.lit(-1).cast("long").alias("seq"), F.col("base").alias("offset"), F.lit(True).alias("gain"))

    spans = K.lifo_pairs(inside.unionByName(opened), [*KEY, "enc_idx", "player", "aura"], ["offset", "seq"], F.col("gain"), "offset")
    died = concatenated_offset(entries.where("kind = 'Death'"), encounters).groupBy(*KEY, "enc_idx", F.col("source").alias("player")).agg(F.min_by("offset", "seq").alias("died"))
    stop = axis.select(*KEY, "enc_idx", (F.col("base") + F.col("end") - F.col("start")).alias("stop"))
    spans = spans.join(died, [*KEY, "enc_idx", "player"], "left").join(stop, [*KEY, "enc_idx"])
    if persistent is None:
        spans = spans.withColumn("death_persistent", F.lit(False))
    else:
        spans = lookups.classify_buffs(spans, "aura", persistent)
    last = F.when(F.col("death_persistent"), F.col("stop")).otherwise(F.least(F.coalesce("died", "stop"), "stop"))
    return (
        spans.withColumn("_open", F.col("end").isNull()).withColumn("end", F.coalesce("end", last)).where("not _open or end > start")
        .select(*KEY, "player", "aura", "enc_idx", "start", "end")
    )


def buff_uptime(entries: DataFrame, encounters: DataFrame, persistent: DataFrame | None = None) -> DataFrame:
    """(keys, player, aura): uptime (share of the selected time, at most 1), seconds, gains and fades inside the encounters."""
    by = [*KEY, "player", "aura"]
    covered = K.covered_length(aura_intervals(entries, encounters, persistent), by, name="seconds")
    inside = concatenated_offset(entries.where("kind in ('AuraGain', 'AuraFade')"), encounters)
    counts = inside.groupBy(*KEY, F.col("source").alias("player"), F.col("spell").alias("aura")).agg(
        F.count_if(F.col("kind") == "AuraGain").alias("gains"), F.count_if(F.col("kind") == "AuraFade").alias("fades")
    )
    total = encounters.groupBy(*KEY).agg(F.sum(F.col("end") - F.col("start")).alias("_d")).where("_d > 0")
    out = covered.join(counts, by, "full_outer").join(total, KEY).na.fill(0, ["seconds", "gains", "fades"])
    return out.withColumn("uptime", F.least(F.col("seconds") / F.col("_d"), F.lit(1.0))).drop("_d")


def available_auras(entries: DataFrame, encounters: DataFrame) -> DataFrame:
    """Names of auras met."""
    i = aura_intervals(entries, encounters).select(*KEY, "aura")
    j = concatenated_offset(entries.where("kind in ('AuraGain', 'AuraFade')"), encounters).select(*KEY, F.col("spell").alias("aura"))
    return i.unionByName(j).distinct()


def consume_window(encounters: DataFrame, facts: DataFrame) -> DataFrame:
    """The consumable axis: from PRE_PULL before the first pull, not before the session, to the last end."""
    e = encounters.groupBy(*KEY).agg(F.min("start").alias("first"), F.max("end").alias("last"))
    lo = F.greatest(F.coalesce(F.col("first") - PRE_PULL, "start_time"), F.col("start_time"))
    return facts.join(e, KEY, "left").select(*KEY, lo.alias("t_start"), F.coalesce("last", "end_time").alias("t_end"))


def consume_marks(uses: DataFrame, window: DataFrame) -> DataFrame:
    """Consumable uses on that axis."""
    return uses.join(window, KEY).where("ts between t_start and t_end").withColumn("offset", F.col("ts") - F.col("t_start")).drop("t_start", "t_end")


def aura_categories(marks: DataFrame, auras: DataFrame, buffs: DataFrame) -> DataFrame:
    """Category of an aura: that of the item of its name, if one was used; else by the buff names."""
    used = marks.groupBy(*KEY, F.col("consumable").alias("aura")).agg(F.min_by("category", "seq").alias("category"))
    rest = lookups.classify_buffs(auras.join(used, [*KEY, "aura"], "left_anti"), "aura", buffs).where("category is not null")
    return used.unionByName(rest.select(*KEY, "aura", "category"))


def encounter_bounds(encounters: DataFrame, window: DataFrame, everything: bool) -> DataFrame:
    """Encounters on the consumable axis; with the filter all, only bosses."""
    e = encounters.where("is_boss") if everything else encounters
    return e.join(window, KEY).select(*KEY, "enc_idx", (F.col("start") - F.col("t_start")).alias("lo"), (F.col("end") - F.col("t_start")).alias("hi"), F.coalesce("name", F.lit("Trash")).alias("name"), "is_kill")


def axis_segments(encounters: DataFrame, window: DataFrame) -> DataFrame:
    """Where each stretch of the encounter axis lies on the consumable axis: (keys, enc_idx, lo, hi, at)."""
    e = on_axis(encounters).join(window, KEY)
    return e.select(*KEY, "enc_idx", F.col("base").alias("lo"), (F.col("base") + F.col("end") - F.col("start")).alias("hi"), (F.col("start") - F.col("t_start")).alias("at"))


def translate(rows: DataFrame, segments: DataFrame, id_col: str, offset: str = "offset") -> DataFrame:
    """Offsets on the consumable axis: by the first segment that holds them, else unchanged."""
    own = segments.select(*KEY, F.col("enc_idx").alias("_seg"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("at").alias("_at"))
    hit = K.range_attach(rows, own, KEY, offset, "_lo", "_hi", 600.0).groupBy(id_col).agg(F.min_by(F.col(offset) - F.col("_lo") + F.col("_at"), "_seg").alias("_to"))
    return rows.join(hit, id_col, "left").withColumn("translated", F.coalesce("_to", offset)).drop("_to")


def zoom(rows: DataFrame, lo: float, hi: float, at: str = "offset") -> DataFrame:
    """Rows in a window of at least two seconds; a narrower one is ignored."""
    return rows.where(F.col(at).between(lo, hi)) if hi - lo >= 2 else rows


#: Bits of a level of the pyramid, and its levels: 16, 256, 4096 and 65536 seconds beside the single ones.
PYRAMID_BITS, PYRAMID_LEVELS = 4, 5


def pyramid(seconds: DataFrame, values: Sequence[str], keys: Sequence[str] = KEY, at: str = "second") -> DataFrame:
    """Sums of a dense axis by stretches of 16^level seconds: (keys, level, bucket, values), a fifteenth more rows than the axis has. Store it
    once: any window is then a few dozen of its rows (see zoomed)."""
    level = seconds.select(*keys, F.lit(0).alias("level"), F.col(at).cast("long").alias("bucket"), *values)
    out = level
    for k in range(1, PYRAMID_LEVELS):
        level = level.groupBy(*keys, F.shiftright("bucket", PYRAMID_BITS).alias("bucket")).agg(*[F.sum(v).alias(v) for v in values]).select(*keys, F.lit(k).alias("level"), "bucket", *values)
        out = out.unionByName(level)
    return out


def stretches_of(lo: int, hi: int) -> list[tuple[int, int]]:
    """The least (level, bucket) that make up the seconds from lo to hi, both included."""
    out: list[tuple[int, int]] = []
    end = hi + 1
    for level in range(PYRAMID_LEVELS):
        last = level == PYRAMID_LEVELS - 1
        while lo < end and (last or lo & ((1 << PYRAMID_BITS) - 1)):
            out.append((level, lo))
            lo += 1
        while lo < end and end & ((1 << PYRAMID_BITS) - 1):
            end -= 1
            out.append((level, end))
        lo, end = lo >> PYRAMID_BITS, end >> PYRAMID_BITS
    return out


def zoomed(levels: DataFrame, values: Sequence[str], lo: int | None = None, hi: int | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """Sums of a window of whole seconds, both ends included; one of less than two seconds, or none, means the whole axis."""
    if lo is None or hi is None or hi - lo < 2:
        rows = levels.where(F.col("level") == PYRAMID_LEVELS - 1)
    else:
        by_level: dict[int, list[int]] = {}
        for level, bucket in stretches_of(max(lo, 0), hi):
            by_level.setdefault(level, []).append(bucket)
        inside = F.lit(False)
        for level, wanted in by_level.items():
            inside |= (F.col("level") == level) & F.col("bucket").isin(wanted)
        rows = levels.where(inside)
    return rows.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def lanes(intervals: DataFrame, tracked: Sequence[str]) -> DataFrame:
    """Players of each tracked aura, sorted."""
    return intervals.where(F.col("aura").isin(*tracked)).groupBy(*KEY, "aura").agg(F.sort_array(F.collect_set("player")).alias("players"))


def dispel_lanes(entries: DataFrame, encounters: DataFrame) -> DataFrame:
    """Dispels on the axis, a lane for each caster: (keys, caster, marks), marks by time."""
    d = concatenated_offset(entries.where("kind = 'Dispel'"), encounters)
    return d.groupBy(*KEY, F.col("source").alias("caster")).agg(F.array_sort(F.collect_list(F.struct("offset", "seq", "spell", "target"))).alias("marks"))


def category_lanes(intervals: DataFrame, marks: DataFrame, categories: DataFrame) -> DataFrame:
    """Lanes of the consumable chart: (keys, category, players, bars). A category has bars if any of its auras has an interval.

    categories: (keys, aura, category), see aura_categories.
    """
    bars = intervals.join(categories, [*KEY, "aura"]).select(*KEY, "category", "player", F.lit(True).alias("bar"))
    uses = marks.select(*KEY, "category", "player", F.lit(False).alias("bar"))
    return bars.unionByName(uses).groupBy(*KEY, "category").agg(F.sort_array(F.collect_set("player")).alias("players"), F.bool_or("bar").alias("bars"))


def active_at(intervals: DataFrame, marks: DataFrame, second: float, span: float) -> DataFrame:
    """What each player has at a second: auras that cover it, and uses near it (half a percent of the span, 5 to 30 s)."""
    near = min(max(span * 0.005, 5.0), 30.0)
    a = intervals.where(F.lit(second).between(F.col("start"), F.col("end"))).select(*KEY, "player", F.col("aura").alias("what"))
    u = marks.where(F.abs(F.col("offset") - second) <= near).select(*KEY, "player", F.col("consumable").alias("what"))
    return a.unionByName(u).groupBy(*KEY, "player").agg(F.sort_array(F.collect_set("what")).alias("active"))
