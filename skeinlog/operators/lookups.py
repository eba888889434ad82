"""Lookups in the dimension tables: items, buffs, zones, NPCs. The tables are parameters (see sources.dims)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify_items(df: DataFrame, item_col: str, items: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Adds category and label of an item: by exact name, else by the longest prefix that is listed as one, else those of the last of
    categories, Other (null without categories).

    Rows whose item is listed as ignored are dropped. items: (item, category, label, prefix, ignored), a small fixed list.
    """
    exact = F.broadcast(items.where("not prefix and not ignored").select(F.col("item").alias("_item"), F.col("category").alias("_c"), F.col("label").alias("_l")))
    ignored = F.broadcast(items.where("ignored").select(F.col("item").alias("_ignored")))
    prefixes = [(r.item, r.category, r.label) for r in items.where("prefix").collect()]  # a handful
    kept = df.join(ignored, df[item_col] == F.col("_ignored"), "left_anti").join(exact, df[item_col] == F.col("_item"), "left")
    category, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    if categories is not None:
        last = categories.orderBy(F.desc("category")).first()
        category, label = F.lit(last.category), F.lit(last.label)
    for item, c, name in sorted(prefixes, key=lambda p: len(p[0])):
        hit = F.col(item_col).startswith(item)
        category, label = F.when(hit, F.lit(c)).otherwise(category), F.when(hit, F.lit(name)).otherwise(label)
    return kept.withColumn("category", F.coalesce("_c", category)).withColumn("label", F.coalesce("_l", label)).drop("_item", "_c", "_l")


def classify_buffs(df: DataFrame, buff_col: str, buffs: DataFrame) -> DataFrame:
    """Adds category of a buff whose name differs from its item's. buffs: (buff, category, death_persistent)."""
    b = F.broadcast(buffs.select(F.col("buff").alias("_buff"), F.col("category"), F.col("death_persistent")))
    return df.join(b, df[buff_col] == F.col("_buff"), "left").drop("_buff").withColumn("death_persistent", F.coalesce("death_persistent", F.lit(False)))


def normalize_zone(df: DataFrame, zone_col: str, aliases: DataFrame) -> DataFrame:
    """Adds zone: the alias's canonical name in lower case, else the zone itself in lower case."""
    a = F.broadcast(aliases.select(F.lower("alias").alias("_alias"), F.lower("canonical").alias("_canonical")))
    return df.join(a, F.lower(df[zone_col]) == F.col("_alias"), "left").withColumn("zone", F.coalesce("_canonical", F.lower(F.col(zone_col)))).drop("_alias", "_canonical")


def npc_facts(df: DataFrame, name_col: str, npcs: DataFrame) -> DataFrame:
    """Adds instance, is_boss and group_name of an NPC, by lower-cased name of at most 128 bytes."""
    n = F.broadcast(npcs.select(F.col("npc").alias("_npc"), "instance", "is_boss", "group_name"))
    name = F.when(F.octet_length(F.col(name_col)) <= 128, F.lower(F.col(name_col)))
    return df.join(n, name == F.col("_npc"), "left").drop("_npc").withColumn("is_boss", F.coalesce("is_boss", F.lit(False)))


def zone_facts(df: DataFrame, zone_col: str, zones: DataFrame) -> DataFrame:
    """Adds is_raid_zone (raids and dungeons), is_dungeon, is_overworld and encounter_count of a canonical zone."""
    z = F.broadcast(zones.select(F.lower("zone").alias("_zone"), "is_instance", "is_dungeon", "is_overworld", "encounter_count"))
    flags = {"is_raid_zone": "is_instance", "is_dungeon": "is_dungeon", "is_overworld": "is_overworld"}
    out = df.join(z, F.lower(df[zone_col]) == F.col("_zone"), "left")
    return out.select(*df.columns, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()], "encounter_count")


def single_instance(instance: str) -> Column:
    """Aggregate: the one instance of a session's boss kills; null if they are of several."""
    return F.when(F.count_distinct(instance) == 1, F.min(instance))


def contains_word(text: Column, word: Column) -> Column:
    """Whether word stands in text with no letter or digit right beside it."""
    at = F.instr(text, word)
    return (at > 0) & F.rlike(text, F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), word, F.lit(r"\E(?![A-Za-z0-9])")))


def title_case(text: Column) -> Column:
    """First letter of each word in upper case, the rest as it is."""
    up = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))
    return F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), up), " ")
