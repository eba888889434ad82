"""Base aggregations: flat facts per player and ability, from which all totals roll up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .entries import KEY

_DOT = " (dot)"


#: Up to how many spells of players with lines to split a tiny table is sent to all tasks.
SPLITS = 20_000


def damage_done(entries: DataFrame) -> DataFrame:
    """(keys, player, ability): total, hits, crits, crit_total, pet_total, is_pet.

    A hit tagged as a pet's counts as one, and so do the periodic ticks of a spell whose own hits are tagged at any time: ticks
    before the tag move over, unless a tagged tick came before it, in which case the earlier ones stay personal.

    Entries are summed before anything is shuffled, tags are looked for among the sums, and only for spells of the last kind (few, if any)
    the ticks after the tag are summed once more.
    """
    by = [*KEY, "player", "ability"]
    d = entries.where("kind = 'Damage'").withColumn("player", F.col("source")).withColumn("ability", F.col("spell"))
    sums = cut(
        d.groupBy(*by)
        .agg(
            F.sum("amount").alias("total"), F.count("*").alias("hits"), F.count_if("is_crit").alias("crits"),
            F.coalesce(F.sum(F.when(F.col("is_crit"), F.col("amount"))), F.lit(0)).alias("crit_total"),
            F.coalesce(F.sum(F.when(F.col("is_pet_spell"), F.col("amount"))), F.lit(0)).alias("_own"), F.min(F.when(F.col("is_pet_spell"), F.col("seq"))).alias("_tag"),
        )
    )
    hits = sums.where(f"not endswith(ability, '{_DOT}') and _tag is not null").select(*KEY, "player", F.concat("ability", F.lit(_DOT)).alias("ability"), F.col("_tag").alias("_base"))
    sums = sums.join(hits, by, "left")
    late = cut(sums.where("_tag <= _base").select(*by, "_base"))
    n = late.count()
    told = sums.withColumn("_late", F.lit(0).cast("long"))
    if n:
        few = F.broadcast(late) if n <= SPLITS else late
        after = d.where("not coalesce(is_pet_spell, false)").join(few, by).where("seq > _base").groupBy(*by).agg(F.sum("amount").alias("_late"))
        told = sums.join(after, by, "left")
    moved = F.col("_base").isNotNull() & (F.col("_tag").isNull() | (F.col("_tag") > F.col("_base")))
    return told.select(
        *by, "total", "hits", "crits", "crit_total", F.when(moved, F.coalesce("total", F.lit(0))).otherwise(F.col("_own") + F.coalesce("_late", F.lit(0))).alias("pet_total"),
        (F.col("_tag").isNotNull() | moved).alias("is_pet"),
    )


def damage_taken(entries: DataFrame) -> DataFrame:
    """(keys, player, source, ability): total, hits, crits, absorbed, resisted, blocked, crushing, glancing."""
    return (
        entries.where("kind = 'Damage'").groupBy(*KEY, F.col("target").alias("player"), "source", F.col("spell").alias("ability"))
        .agg(
            F.sum("amount").alias("total"), F.count("*").alias("hits"), F.count_if("is_crit").alias("crits"), F.sum("absorbed").alias("absorbed"),
            F.sum("resisted").alias("resisted"), F.sum("blocked").alias("blocked"), F.count_if("is_crushing").alias("crushing"), F.count_if("is_glancing").alias("glancing"),
        )
    )


def healing_done(entries: DataFrame, gate: str = "target_known") -> DataFrame:
    """(keys, player, ability): total, effective, overheal, hits, crits, crit_total; heals of players only, by the gate column."""
    return (
        entries.where(F.col("kind") == "Healing").where(F.col(gate)).groupBy(*KEY, F.col("source").alias("player"), F.col("spell").alias("ability"))
        .agg(
            F.sum("amount").alias("total"), F.sum("effective_heal").alias("effective"), F.sum("overheal").alias("overheal"), F.count("*").alias("hits"),
            F.count_if("is_crit").alias("crits"), F.coalesce(F.sum(F.when(F.col("is_crit"), F.col("amount"))), F.lit(0)).alias("crit_total"),
        )
    )


def player_totals(done: DataFrame, taken: DataFrame, healed: DataFrame) -> DataFrame:
    """(keys, player): damage, pet_damage, damage_taken, healing, effective, overheal, rolled up from the facts."""
    by = [*KEY, "player"]
    parts = (
        done.groupBy(*by).agg(F.sum("total").alias("damage"), F.sum("pet_total").alias("pet_damage")),
        taken.groupBy(*by).agg(F.sum("total").alias("damage_taken")),
        healed.groupBy(*by).agg(F.sum("total").alias("healing"), F.sum("effective").alias("effective"), F.sum("overheal").alias("overheal")),
    )
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    values = ["damage", "pet_damage", "damage_taken", "healing", "effective", "overheal"]
    return out.groupBy(*by).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])


def absorbs(entries: DataFrame) -> DataFrame:
    """Damage absorbed by known players."""
    return entries.where("kind = 'Damage' and target_known and absorbed > 0").groupBy(*KEY, F.col("target").alias("player")).agg(F.sum("absorbed").alias("absorbed"))


def avoidance(events: DataFrame, entries: DataFrame) -> DataFrame:
    """(keys, player): dodges, parries, missed_by, misses, full_resists, full_absorbs, full_blocks and blocks (never counted)."""
    kinds = {"dodge": "dodges", "parry": "parries", "missed_by": "missed_by", "misses": "misses"}
    a = events.groupBy(*KEY, "player").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in kinds.items()])
    full = entries.where("kind = 'Damage' and target_known and (is_fully_resisted or is_fully_absorbed or is_fully_blocked)").groupBy(*KEY, F.col("target").alias("player")).agg(
        F.count_if("is_fully_resisted").alias("full_resists"), F.count_if("is_fully_absorbed").alias("full_absorbs"), F.count_if("is_fully_blocked").alias("full_blocks")
    )
    out = a.join(full, [*KEY, "player"], "full_outer").na.fill(0, [*kinds.values(), "full_resists", "full_absorbs", "full_blocks"])
    return out.withColumn("blocks", F.lit(0).cast("long"))


def buff_stats(entries: DataFrame) -> DataFrame:
    """(keys, player, buff): gains, fades, first_gain, last_fade."""
    gain, fade = F.col("kind") == "AuraGain", F.col("kind") == "AuraFade"
    return entries.where(gain | fade).groupBy(*KEY, F.col("source").alias("player"), F.col("spell").alias("buff")).agg(
        F.count_if(gain).alias("gains"), F.count_if(fade).alias("fades"), F.min_by("ts", F.when(gain, F.col("seq"))).alias("first_gain"), F.max_by("ts", F.when(fade, F.col("seq"))).alias("last_fade")
    )
