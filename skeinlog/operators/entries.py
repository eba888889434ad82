"""Decoded lines to the table of entries, with what depends on the state of the log: roster as of a line, combat windows,
spell ranks and effective healing.

KEY names the columns that separate logs and sessions. Lines of one session stay together only where a running value needs it,
and then on the marker lines alone or per player.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import cut
from . import kernels as K

KEY = ["log_id", "session_id"]
#: Order of the entries of one line.
CAST, DAMAGE, HEAL, AURA = 0, 1, 2, 3

ENTRY = {
    "kind": "string", "source": "string", "target": "string", "spell": "string", "amount": "long", "absorbed": "long", "resisted": "long", "blocked": "long",
    "is_crit": "boolean", "is_glancing": "boolean", "is_crushing": "boolean", "school": "string", "is_pet_spell": "boolean",
    "is_fully_resisted": "boolean", "is_fully_absorbed": "boolean", "is_fully_blocked": "boolean", "is_tick": "boolean", "stacks": "int",
}


def roster_sightings(decoded: DataFrame) -> DataFrame:
    return decoded.where("roster is not null").select(*KEY, "seq", "roster.*")


def roster(decoded: DataFrame) -> DataFrame:
    """Each player once: the last sighting's fields, and the line of the first."""
    s = roster_sightings(decoded)
    fields = [c for c in s.columns if c not in [*KEY, "seq", "name"]]
    return s.groupBy(*KEY, "name").agg(F.min("seq").alias("first_seen_seq"), F.max_by(F.struct(*fields), "seq").alias("last")).select(*KEY, "name", "first_seen_seq", "last.*")


def known(df: DataFrame, players: DataFrame, name: str, flag: str, at: str | None = "seq") -> DataFrame:
    """Adds whether a name is on the roster: as of the row's line, or (at=None) in the end. A join by name, for rosters of any size; see
    met for those of a raid."""
    p = players.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("name").alias("_name"), F.col("first_seen_seq").alias("_first"))
    on = F.col(name) == F.col("_name")
    for k in KEY:
        on &= df[k] == F.col(f"_{k}")
    hit = F.col("_first").isNotNull() if at is None else F.coalesce(F.col("_first") < F.col(at), F.lit(False))
    return df.join(p, on, "left").withColumn(flag, hit).drop(*[f"_{k}" for k in KEY], "_name", "_first")


def dictionary(players: DataFrame) -> DataFrame:
    """The roster of each session as a map, (keys, _names): name to the line of the first sighting. A session's roster is a raid's."""
    first = players.where("name is not null").groupBy(*KEY, "name").agg(F.min("first_seen_seq").alias("first_seen_seq"))
    return first.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("name", "first_seen_seq"))).alias("_names"))


def on_roster(name: str | Column, at: str | None = "seq") -> Column:
    """Whether a name is in the row's _names: as of the row's line, or (at=None) at all."""
    first = F.try_element_at(F.col("_names"), F.col(name) if isinstance(name, str) else name)
    return first.isNotNull() if at is None else F.coalesce(first < F.col(at), F.lit(False))


def block_names(rows: DataFrame, players: DataFrame, names: Iterable[str]) -> DataFrame:
    """For each block of lines, those of its rows' names that are on the roster, as a map (keys, _block, _names). A block has few
    lines, so maps are short and all of them together no longer than rows, however large rosters are."""
    first = players.where("name is not null").groupBy(*KEY, "name").agg(F.min("first_seen_seq").alias("first_seen_seq"))
    said = rows.select(*KEY, F.shiftright(F.col("seq"), K.BLOCK_BITS).alias("_block"), F.explode(F.array(*names)).alias("name")).where("name is not null").distinct()
    return said.join(first, [*KEY, "name"]).groupBy(*KEY, "_block").agg(F.map_from_entries(F.collect_list(F.struct("name", "first_seen_seq"))).alias("_names"))


def met(rows: DataFrame, players: DataFrame, flags: dict[str, str], at: str | None = "seq") -> DataFrame:
    """Adds flags, by name of a column: whether its name is on the roster. Rows, which are read twice, meet the names of their block of
    lines, so no name draws rows together and a long log is spread."""
    out = rows.withColumn("_block", F.shiftright(F.col("seq"), K.BLOCK_BITS)).join(block_names(rows, players, flags), [*KEY, "_block"], "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[on_roster(n, at).alias(flag) for n, flag in flags.items()])


def _entry(**given: Column) -> Column:
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in ENTRY.items()])


def _from(struct: str, **more: Column) -> Column:
    """An entry from the fields of a decoded struct that have an entry's names."""
    fields = {
        "damage": [c for c in ENTRY if c not in ("kind", "is_tick", "stacks")],
        "heal": ["source", "target", "spell", "amount", "is_crit", "is_tick"],
        "cast": ["kind", "source", "target", "spell"],
        "aura": ["kind", "source", "spell", "stacks"],
    }[struct]
    return _entry(**{c: F.col(f"{struct}.{c}") for c in fields}, **more)


def raw_entries(decoded: DataFrame) -> DataFrame:
    """All entries of all lines before gates, one pass: (keys, seq, sub, ts, ENTRY). Deaths are those of players.

    Only families that were decoded give entries (see decode).
    """
    parts = {
        "cast": (CAST, F.col("cast").isNotNull(), lambda: _from("cast")),
        "damage": (DAMAGE, F.col("damage").isNotNull(), lambda: _from("damage", kind=F.lit("Damage"))),
        "heal": (HEAL, F.col("heal").isNotNull(), lambda: _from("heal", kind=F.lit("Healing"))),
        "aura": (AURA, F.col("aura").isNotNull(), lambda: _from("aura")),
        "died": (CAST, F.coalesce(F.col("died.kind") == "player", F.lit(False)), lambda: _entry(kind=F.lit("Death"), source=F.col("died.name"))),
    }
    own = [parts[n] for n in parts if n in decoded.columns]
    listed = F.array(*[F.when(test, F.struct(F.lit(sub).alias("sub"), e().alias("e"))) for sub, test, e in own])
    return decoded.select(*KEY, "seq", "ts", F.explode(listed).alias("x")).where("x is not null").select(*KEY, "seq", "ts", "x.sub", "x.e.*")


def gated_entries(decoded: DataFrame, players: DataFrame) -> DataFrame:
    """Entries after the gates: interrupts by a known player on someone else, auras on known players; with player flags and the
    combat state of the line.

    source_known and target_known say whether the names were on the roster as of the line. decoded is read several times: store it
    before.
    """
    raw = raw_entries(decoded)
    names = block_names(raw, players, ["source", "target"])
    e = K.last_said(raw, combat_marks(decoded), decoded, KEY, RESETS, facts=names).na.fill({"combat_id": 0, "reset_id": 0, "in_combat": False})
    e = e.withColumn("source_known", on_roster("source")).withColumn("target_known", on_roster("target")).drop("_names")
    return e.where(
        "(kind not in ('Interrupt', 'AuraGain', 'AuraFade')) or (kind = 'Interrupt' and source_known and not target_known)"
        " or (kind in ('AuraGain', 'AuraFade') and source_known)"
    )


#: What a combat mark says of the lines after it.
RESETS = ["combat_id", "reset_id", "in_combat"]


def combat_marks(decoded: DataFrame) -> DataFrame:
    """Combat state lines with reset_id, combat_id and in_combat, as they are from that line on.

    An end counts if the mark before it is a start. combat_id counts such ends, reset_id these and starts.
    """
    order = W.partitionBy(*KEY).orderBy("seq")
    m = decoded.where("combat is not null").select(*KEY, "seq", "ts", "combat").withColumn("before", F.lag("combat").over(order))
    m = m.withColumn("ends", (F.col("combat") == "end") & F.coalesce(F.col("before") == "start", F.lit(False)))
    return (
        m.withColumn("combat_id", F.sum(F.col("ends").cast("long")).over(order))
        .withColumn("reset_id", F.sum((F.col("ends") | (F.col("combat") == "start")).cast("long")).over(order))
        .withColumn("in_combat", F.col("combat") == "start")
    )


def with_resets(rows: DataFrame, marks: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Adds combat_id, reset_id and in_combat of the last mark at or before each row's line (0, 0 and false before the first).

    of: where the rows' lines come from, if that is cheaper to read than rows.
    """
    return K.last_said(rows, marks, rows if of is None else of, KEY, RESETS).na.fill({"combat_id": 0, "reset_id": 0, "in_combat": False})


def with_ranks(entries: DataFrame, decoded: DataFrame) -> DataFrame:
    """Healing spells get the rank of their caster's last cast line, before the suffix of periodic ones."""
    ranks = decoded.where("rank is not null").select(*KEY, "seq", F.col("rank.source").alias("source"), F.col("rank.spell").alias("spell"), F.col("rank.rank").alias("rank"))
    heals, others = entries.where("kind = 'Healing'"), entries.where("kind <> 'Healing'")
    both = heals.withColumn("rank", F.lit(None).cast("int")).unionByName(ranks.withColumn("sub", F.lit(CAST)), allowMissingColumns=True)
    named = K.asof_last(both, [*KEY, "source", "spell"], ["seq", "sub"], F.col("rank"), "_rank").where("kind = 'Healing'")
    suffix = F.concat(
        F.when(F.col("_rank").isNotNull(), F.format_string(" (Rank %d)", F.col("_rank"))).otherwise(""), F.when(F.col("is_tick"), " (hot)").otherwise("")
    )
    return others.unionByName(named.withColumn("spell", F.concat("spell", suffix)).drop("rank", "_rank"))


def with_effective_healing(entries: DataFrame) -> DataFrame:
    """Adds effective_heal and overheal: healing beyond the damage its target took since the last combat mark is overheal."""
    touched, others = entries.where("kind in ('Damage', 'Healing')"), entries.where("kind not in ('Damage', 'Healing')")
    delta = F.when(F.col("kind") == "Damage", F.col("amount")).otherwise(-F.col("amount"))
    d = K.clamped_balance(touched, [*KEY, "target", "reset_id"], ["seq", "sub"], delta, "overheal")
    healed = F.col("kind") == "Healing"
    d = d.withColumn("overheal", F.when(healed, F.col("overheal"))).withColumn("effective_heal", F.when(healed, F.col("amount") - F.col("overheal")))
    return d.unionByName(others, allowMissingColumns=True)


def entries(decoded: DataFrame, players: DataFrame) -> DataFrame:
    """The finished table of entries. Gated ones are written in between, as they are read several times."""
    return with_effective_healing(with_ranks(cut(gated_entries(decoded, players)), decoded))


def deaths(entries: DataFrame) -> DataFrame:
    """Deaths of players with the killing blow: the last damage to the player since the last combat end and own last death.

    Damage counts from when its target was on the roster.
    """
    own = F.when(F.col("kind") == "Death", F.col("source")).otherwise(F.col("target"))
    about = entries.where("kind = 'Death' or (kind = 'Damage' and target_known)").withColumn("player", own)
    order = ["seq", "sub"]
    died = F.sum((F.col("kind") == "Death").cast("long")).over(W.partitionBy(*KEY, "player").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    about = about.withColumn("_died", F.coalesce(died, F.lit(0)))
    blow = F.when(F.col("kind") == "Damage", F.struct("source", "spell", "amount"))
    hit = K.asof_last(about, [*KEY, "player", "combat_id", "_died"], order, blow, "_blow").where("kind = 'Death'")
    return hit.select(*KEY, "seq", "ts", "player", F.col("_blow.source").alias("killer"), F.col("_blow.spell").alias("killing_blow"), F.col("_blow.amount").alias("damage_amount"))


def avoidance_events(decoded: DataFrame, players: DataFrame) -> DataFrame:
    """Dodges and parries of known players; misses, split by which side is known: (keys, seq, ts, player, kind)."""
    a = decoded.where("avoidance is not null").select(*KEY, "seq", "ts", "avoidance.*")
    a = met(a, players, {"attacker": "a_known", "defender": "d_known"})
    kind = F.when(F.col("kind").isin("dodge", "parry") & F.col("d_known"), F.col("kind")).when(
        (F.col("kind") == "miss") & F.col("d_known") & ~F.col("a_known"), "missed_by").when((F.col("kind") == "miss") & F.col("a_known") & ~F.col("d_known"), "misses")
    player = F.when(kind == "misses", F.col("attacker")).otherwise(F.col("defender"))
    return a.select(*KEY, "seq", "ts", player.alias("player"), kind.alias("kind")).where("kind is not null")


def consumable_uses(decoded: DataFrame, players: DataFrame, items: DataFrame) -> DataFrame:
    """Uses of consumables by known players, classified; ignored items drop out."""
    from . import lookups

    c = decoded.where("consumable is not null").select(*KEY, "seq", "ts", F.col("consumable.source").alias("player"), F.col("consumable.item").alias("consumable"))
    return lookups.classify_items(met(c, players, {"player": "_known"}).where("_known").drop("_known"), "consumable", items)


def pet_owners(decoded: DataFrame, players: DataFrame) -> DataFrame:
    """Owner of each pet seen as 'Pet (Owner)': owner known, pet not; the last sighting wins."""
    p = decoded.where("pet is not null").select(*KEY, "seq", "pet.*")
    p = met(p, players, {"owner": "_o", "pet": "_p"}).where("_o and not _p")
    return p.groupBy(*KEY, "pet").agg(F.max_by("owner", "seq").alias("owner"))


def loot_events(decoded: DataFrame) -> DataFrame:
    return decoded.where("loot is not null").select(*KEY, "seq", "ts", "loot.*")


def trade_events(decoded: DataFrame) -> DataFrame:
    return decoded.where("trade is not null").select(*KEY, "seq", "ts", "trade.*")


def session_facts(decoded: DataFrame) -> DataFrame:
    """Bounds (times of the first and last line), last zone and last raid size of each session."""
    return decoded.groupBy(*KEY).agg(
        F.min_by("ts", "seq").alias("start_time"), F.max_by("ts", "seq").alias("end_time"),
        F.max_by("zone", F.when(F.col("zone").isNotNull(), F.col("seq"))).alias("zone"),
        F.max_by("raid_size", F.when(F.col("raid_size").isNotNull(), F.col("seq"))).alias("raid_size"),
    )
