"""Dimension tables from two small TOML files: instances with their NPCs and zones, and consumables."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _load(spark: SparkSession, path: str) -> dict:
    """The file, read by Spark, so that any store will do."""
    return tomllib.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def load_instances(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """npcs (npc, instance, is_boss, group_name), zones (zone, is_instance, is_dungeon, is_overworld, encounter_count) and aliases
    (alias, canonical). An NPC of several instances belongs to the first by name. Names are in lower case.

    The file has tables [[raid]] (name, bosses, trash, encounter_count, dungeon, encounter_groups), [zone_aliases] and [overworld].
    """
    db = _load(spark, path)
    raids = db.get("raid", [])
    npcs = [(n.lower(), r["name"].lower(), kind == "bosses") for r in raids for kind in ("bosses", "trash") for n in r.get(kind, [])]
    groups = [(b.lower(), g["name"]) for r in raids for g in r.get("encounter_groups", []) for b in g["bosses"]]
    n = spark.createDataFrame(npcs or [], "npc string, instance string, is_boss boolean").groupBy("npc").agg(F.min("instance").alias("instance"), F.bool_or("is_boss").alias("is_boss"))
    g = spark.createDataFrame(groups or [], "npc string, group_name string")
    zones = [(r["name"].lower(), True, bool(r.get("dungeon", False)), False, int(r.get("encounter_count", 0))) for r in raids]
    zones += [(z.lower(), False, False, True, None) for z in db.get("overworld", {}).get("zones", [])]
    return {
        "npcs": n.join(F.broadcast(g), "npc", "left"),
        "zones": spark.createDataFrame(zones or [], "zone string, is_instance boolean, is_dungeon boolean, is_overworld boolean, encounter_count int"),
        "aliases": spark.createDataFrame([(a.lower(), c.lower()) for a, c in db.get("zone_aliases", {}).items()] or [], "alias string, canonical string"),
    }


def load_consumables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """items (item, category, label, prefix, ignored), buffs (buff, category, death_persistent) and categories (category, name, label),
    in file order, with Other as the last.

    The file has [[category]] (name, display, items, prefix, buff_names, death_persistent) and [ignored] items. Buffs list the
    items' own names too, as most buffs are called like their item.
    """
    db = _load(spark, path)
    items, buffs = [(i, None, None, False, True) for i in db.get("ignored", {}).get("items", [])], []
    for k, c in enumerate(db.get("category", [])):
        items += [(i, k, c["display"], False, False) for i in c.get("items", [])]
        if c.get("prefix"):
            items.append((c["prefix"], k, c["display"], True, False))
        lasting = bool(c.get("death_persistent", False))
        own = set(c.get("buff_names", []))
        buffs += [(b, k, lasting) for b in sorted(own)]
        buffs += [(i, None, True) for i in c.get("items", []) if lasting and i not in own]
    return {
        "items": spark.createDataFrame(items or [], "item string, category int, label string, prefix boolean, ignored boolean"),
        "categories": spark.createDataFrame([*[(k, c["name"], c["display"]) for k, c in enumerate(db.get("category", []))], (len(db.get("category", [])), "Other", "Other")], "category int, name string, label string"),
        "buffs": spark.createDataFrame(buffs or [], "buff string, category int, death_persistent boolean"),
    }
