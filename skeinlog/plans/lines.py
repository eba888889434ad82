"""Queries from text to typed events: lines in the log's grammar are rendered from the given tables, decoded by the production
operators and held against what went in. DuckDB SQL says what each must return.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import decode as D
from ..operators import encounters, lookups, normalise
from ..operators import entries as N
from ..sources import logs, scratch
from .bindings import E, ORACLES, QUERIES, events, logged, query, table  # noqa: F401

#: Names are letters only: digits of ids become letters. The same expressions in Spark and DuckDB.
_U = "'U' || translate(CAST(user_id AS {s}), '0123456789', 'abcdefghij')"
_V = "'V' || translate(CAST(seq % 50 AS {s}), '0123456789', 'abcdefghij')"
U, V = _U.format(s="VARCHAR"), _V.format(s="VARCHAR")
CLOCK = "1/27 20:30:05.250  "


def rendered(spark: SparkSession, sf_dir: str, forms: list[str], days: int = 0) -> DataFrame:
    """events as lines, the form by the event's number: {u}, {v} are names, {n} an amount, {k} a small number; a null form gives no line."""
    e = events(spark, sf_dir)
    parts = {"{u}": F.expr(_U.format(s="string")), "{v}": F.expr(_V.format(s="string")), "{n}": F.col("amt").cast("string"), "{k}": (F.col("seq") % 40 + 1).cast("string")}

    def made(form: str) -> Column:
        text = F.lit(CLOCK + form)
        for mark, value in parts.items():
            if mark in form:
                text = F.replace(text, F.lit(mark), value)
        return text

    text = F.element_at(F.array(*[made(f) for f in forms]), (F.col("seq") % len(forms) + 1).cast("int"))
    log = F.concat(F.lit("d"), (F.col("user_id") % days).cast("string")) if days else F.lit("all")
    return e.select(log.alias("log_id"), F.lit(0).alias("session_id"), "seq", text.alias("text"))


def decoded(spark: SparkSession, sf_dir: str, forms: list[str], *families: str) -> DataFrame:
    return D.decode(logs.spread(rendered(spark, sf_dir, forms)), families or None)


def _case(values: list, n: int | None = None) -> str:
    """SQL for the value by the event's number."""
    n = n or len(values)
    return "CASE seq % " + str(n) + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_HITS = [
    "{u} 's Slam hits Bog Ogre for {n} Fire damage. ({k} absorbed) (5 resisted)", "{u} crits Bog Ogre for {n}. (glancing)", "Bog Ogre suffers {n} Shadow damage from {u} 's Rot.",
    "Bog Ogre hits {u} for 0. ({k} blocked)", "{u} hits Bog Ogre for {n} Fire damage.", "{u} 's (pet) Bite crits Bog Ogre for {n}. (crushing)", "{u} 's Zap hits Bog Ogre for 0. ({k} resisted)", "{v} says hits for nothing.",
]
_IS = lambda *at: f"seq % 8 IN ({', '.join(map(str, at))})"


@query(f"""{E} SELECT seq, CASE WHEN {_IS(3)} THEN 'Bog Ogre' ELSE {U} END AS source, CASE WHEN {_IS(3)} THEN {U} ELSE 'Bog Ogre' END AS target, {_case(["'Slam'", "'Auto Attack'", "'Rot (dot)'", "'Auto Attack'", "''", "'Bite'", "'Zap'", "''"])} AS spell,
CASE WHEN {_IS(3, 6)} THEN 0 ELSE amt END AS amount, CASE WHEN {_IS(0)} THEN seq % 40 + 1 ELSE 0 END AS absorbed, CASE WHEN {_IS(0)} THEN 5 WHEN {_IS(6)} THEN seq % 40 + 1 ELSE 0 END AS resisted, CASE WHEN {_IS(3)} THEN seq % 40 + 1 ELSE 0 END AS blocked,
{_IS(1, 5)} AS is_crit, {_IS(1)} AS is_glancing, {_IS(5)} AS is_crushing, {_case(["'Fire'", "NULL", "'Shadow'", "NULL", "NULL", "NULL", "NULL", "NULL"])} AS school, {_IS(5)} AS is_pet_spell, {_IS(6)} OR {_IS(0)} AND amt = 0 AS full_resist, {_IS(3)} AS full_block, {_IS(0)} AND amt = 0 AS full_absorb
FROM e WHERE seq % 8 NOT IN (4, 7)""")
def decoded_hits(spark, sf_dir):
    """Damage in all its forms, with mitigation; a hit of a school without a spell isn't an event."""
    d = decoded(spark, sf_dir, _HITS, "damage").where("damage is not null").select("seq", "damage.*")
    return d.select(
        "seq", "source", "target", "spell", "amount", "absorbed", "resisted", "blocked", "is_crit", "is_glancing", "is_crushing", "school", "is_pet_spell",
        F.col("is_fully_resisted").alias("full_resist"), F.col("is_fully_blocked").alias("full_block"), F.col("is_fully_absorbed").alias("full_absorb"),
    )


_HEALS = ["{u} 's Mend critically heals {v} for {n}.", "{v} gains {n} health from {u} 's Renew.", "{u} 's Mending Light heals {v} (Cat) for {n}.", "{u} gains Might (1)."]


@query(f"""{E} SELECT seq, {U} AS source, {V} || CASE WHEN seq % 4 = 2 THEN ' (Cat)' ELSE '' END AS target, {_case(["'Mend'", "'Renew'", "'Mending Light'"], 4)} AS spell, amt AS amount, seq % 4 = 0 AS is_crit, seq % 4 = 1 AS is_tick FROM e WHERE seq % 4 < 3""")
def decoded_heals(spark, sf_dir):
    return decoded(spark, sf_dir, _HEALS, "heal").where("heal is not null").select("seq", "heal.*")


_CASTS = ["{u} casts Cleanse on {v}.", "{u} casts Rebirth on {v}.", "{u} casts Kick on Bog Ogre.", "{u} begins to cast Rebirth on {v}.", "CAST: {u} casts Mend(12)(Rank 4) on {v}.", "{u} casts Zap on {v}.", "CAST: {u} begins to cast Mending Light(7)(3)(Rank 11) on {v}.", "{u} fails casting Revive on {v}."]


@query(f"""{E} SELECT seq, {_case(["'Dispel'", "'Resurrect'", "'Interrupt'"], 8)} AS kind, {U} AS source, {_case(["'Cleanse'", "'Rebirth'", "'Kick'", "NULL", "'Mend'", "NULL", "'Mending Light'"], 8)} AS spell, CASE seq % 8 WHEN 2 THEN 'Bog Ogre' WHEN 0 THEN {V} WHEN 1 THEN {V} END AS target, CAST({_case(["NULL", "NULL", "NULL", "NULL", "4", "NULL", "11"], 8)} AS INT) AS rank
FROM e WHERE seq % 8 IN (0, 1, 2, 4, 6)""")
def decoded_casts(spark, sf_dir):
    """Dispels, resurrections and interrupts, and ranks of spells."""
    d = decoded(spark, sf_dir, _CASTS, "cast", "rank").where("cast is not null or rank is not null")
    return d.select("seq", "cast.kind", F.coalesce("cast.source", "rank.source").alias("source"), F.coalesce("cast.spell", "rank.spell").alias("spell"), "cast.target", "rank.rank")


_AURAS = ["{u} gains Power Word: Might (2).", "Power Word: Might fades from {u}.", "{u} is afflicted by Rot.", "{u} is afflicted by Rot ({k}).", "{u} gains 5 health from {v} 's Mend."]


@query(f"""{E} SELECT seq, CASE seq % 5 WHEN 1 THEN 'AuraFade' ELSE 'AuraGain' END AS kind, {U} AS source, CASE WHEN seq % 5 < 2 THEN 'Power Word: Might' ELSE 'Rot' END AS spell, CAST({_case(["2", "NULL", "1", "seq % 40 + 1"], 5)} AS INT) AS stacks FROM e WHERE seq % 5 < 4""")
def decoded_auras(spark, sf_dir):
    return decoded(spark, sf_dir, _AURAS, "aura").where("aura is not null").select("seq", "aura.*")


_LOOT = [f"LOOT: 27.01.26 20:00:00&{{u}} receives {w}: |cff{c}|Hitem:{{k}}:0:0:0|h[Bog Blade]|h|r{x}." for w, c, x in (("loot", "9d9d9d", "x2"), ("item", "ffffff", "x1"), ("loot", "1eff00", "3"), ("loot", "0070dd", "x1"), ("loot", "a335ee", "x12"), ("loot", "ff8000", "x1"), ("loot", "abcdef", "x1"))] + ["LOOT_TRADE: 27.01.26 20:00:00&{u} trades item Bog Blade of Might to {v}."]


@query(f"""{E} SELECT seq, {U} AS player, CASE WHEN seq % 8 < 7 THEN seq % 40 + 1 END AS item_id, CASE WHEN seq % 8 < 7 THEN 'Bog Blade' ELSE 'Bog Blade of Might' END AS item_name, CAST({_case([0, 1, 2, 3, 4, 5, 1], 8)} AS INT) AS quality, {_case(["'Poor'", "'Common'", "'Uncommon'", "'Rare'", "'Epic'", "'Legendary'", "'Common'"], 8)} AS label,
CAST({_case([2, 1, 3, 1, 12, 1, 1], 8)} AS BIGINT) AS quantity, CASE WHEN seq % 8 = 7 THEN {V} END AS to_player FROM e""")
def decoded_loot(spark, sf_dir):
    """Loot of all qualities, and trades."""
    d = decoded(spark, sf_dir, _LOOT, "loot", "trade")
    both = lambda a, b: F.coalesce(a, b).alias(a.split(".")[1])
    return d.select("seq", both("loot.player", "trade.from_player"), "loot.item_id", both("loot.item_name", "trade.item_name"), "loot.quality", F.when(F.col("loot").isNotNull(), D.quality_label(F.col("loot.quality"))).alias("label"), "loot.quantity", "trade.to_player")


_GEAR = "&".join(["{k}:15:0:0", "nil", "0:0:0:0", "77:1:2:3", *["nil"] * 15])
_META = [
    f"COMBATANT_INFO: 27.01.26 20:00:00&{{u}}&MAGE&Human&2&Cat&Guild&Rank&1&{_GEAR}&123}}45}}6&0x0000000000000007&nil", "COMBATANT_INFO: 27.01.95 20:00:00&{u}&MAGE", "COMBATANT_INFO: 27.01.26 20:00:00&Unknown&MAGE", "ZONE_INFO: 27.01.26 20:00:00&Bog Keep&{k}", "ZONE_INFO: 1",
    f"COMBATANT_INFO: 27.01.26 20:00:00&{{u}}&ROGUE&Gnome&2&nil&nil&nil&1&{_GEAR}&nil&0x0&nil", "PLAYERS_IN_COMBAT: {k}/40",
]


@query(f"""{E} SELECT seq, CASE WHEN seq % 7 IN (0, 1, 5) THEN {U} END AS name, {_case(["'MAGE'", "'MAGE'", "NULL", "NULL", "NULL", "'ROGUE'"], 7)} AS class, {_case(["'Human'", "NULL", "NULL", "NULL", "NULL", "'Gnome'"], 7)} AS race, {_case(["'Guild'"], 7)} AS guild, {_case(["'Cat'"], 7)} AS pet, {_case(["'6/9/6'"], 7)} AS talents, {_case(["'0x0000000000000007'"], 7)} AS guid,
CASE WHEN seq % 7 IN (0, 5) THEN (seq % 40 + 1) || ':15,77:1' END AS gear, CAST(CASE WHEN seq % 7 = 1 THEN 1995 WHEN seq % 7 IN (0, 2, 5) THEN 2026 END AS INT) AS year, {_case(["NULL", "NULL", "NULL", "'Bog Keep'"], 7)} AS zone, CASE WHEN seq % 7 = 6 THEN (seq % 40 + 1) || '/40' END AS raid_size, CASE WHEN seq % 7 = 0 THEN {U} END AS recorder FROM e""")
def decoded_metadata(spark, sf_dir):
    """Roster lines, whole and short, zones and raid sizes."""
    d = decoded(spark, sf_dir, _META, "zone", "roster", "year", "recorder", "raid_size")
    gear = "array_join(transform(filter(roster.gear, g -> g is not null), g -> concat(g.item_id, ':', g.enchant_id)), ',')"
    return d.select("seq", "roster.name", "roster.class", "roster.race", "roster.guild", F.col("roster.pet_name").alias("pet"), "roster.talents", "roster.guid", F.expr(f"if(roster.gear is null, null, {gear})").alias("gear"), "year", "zone", F.concat_ws("/", "raid_size.active", "raid_size.total").alias("rs"), "recorder").select(
        "seq", "name", "class", "race", "guild", "pet", "talents", "guid", "gear", "year", "zone", F.nullif("rs", F.lit("")).alias("raid_size"), "recorder"
    )


_DIED = ["UNIT_DIED:{u}:0x0000000000000{k}", "UNIT_DIED:Bog Ogre:0xF130003{k}", "UNIT_DIED:Cat:0xF140003{k}", "UNIT_DIED: gone", "{u} dies."]


@query(f"""{E} SELECT seq, {_case([U, "'Bog Ogre'", "'Cat'"], 5)} AS name, {_case(["'0x0000000000000'", "'0xF130003'", "'0xF140003'"], 5)} || (seq % 40 + 1) AS guid, {_case(["'player'", "'npc'", "'pet'"], 5)} AS kind FROM e WHERE seq % 5 < 3""")
def decoded_deaths(spark, sf_dir):
    return decoded(spark, sf_dir, _DIED, "died").where("died is not null").select("seq", "died.*")


_AVOIDED = ["Bog Ogre attacks. {u} dodges.", "Bog Ogre attacks. {u} parries.", "Bog Ogre misses {u}.", "{u} uses Flask of Might on {v}.", "{u} uses Juju.", "CAST: {u} uses Juju.", "Cat ({u}) growls."]


@query(f"""{E} SELECT seq, {_case(["'dodge'", "'parry'", "'miss'"], 7)} AS kind, CASE WHEN seq % 7 < 3 THEN 'Bog Ogre' END AS attacker, CASE WHEN seq % 7 < 3 THEN {U} END AS defender, {_case(["NULL", "NULL", "NULL", "'Flask of Might'", "'Juju'"], 7)} AS item, {_case(["NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "'Cat'"], 7)} AS pet, CASE WHEN seq % 7 IN (3, 4, 6) THEN {U} END AS who FROM e WHERE seq % 7 <> 5""")
def decoded_others(spark, sf_dir):
    """Dodges, parries and misses, uses of items, and owners of pets."""
    d = decoded(spark, sf_dir, _AVOIDED, "avoidance", "consumable", "pet").where("coalesce(avoidance.kind, consumable.item, pet.pet) is not null")
    return d.select("seq", "avoidance.kind", "avoidance.attacker", "avoidance.defender", "consumable.item", "pet.pet", F.coalesce("consumable.source", "pet.owner").alias("who"))


_MIXED = ["LOOT: hits ZONE_INFO: 1&a&b", "LOOT: PLAYER_REGEN_ENABLED", "PLAYER_REGEN_DISABLED UNIT_DIED:a:b", "UNIT_DIED:{u}:0x1", "{u} hits {v} for {n}.", "PLAYERS_IN_COMBAT: 1/2", "nothing at all", "LOOT_TRADE: x", "PLAYER_REGEN_ENABLED"]


@query(f"""{E} SELECT seq, {_case(["'metadata'", "'loot'", "'combat'", "'died'", "'event'", "'metadata'", "'event'", "'loot'", "'combat'"])} AS class, {_case(["NULL", "NULL", "'start'", "NULL", "NULL", "NULL", "NULL", "NULL", "'end'"])} AS combat FROM e""")
def classes_of_lines(spark, sf_dir):
    """Lines go to one class, in a fixed order of keywords."""
    return decoded(spark, sf_dir, _MIXED).select("seq", "class", "combat")


_GATED = ["COMBATANT_INFO: 27.01.26 20:00:00&{u}&MAGE", "{u} casts Kick on {v}.", "{u} casts Kick on Bog Ogre.", "{u} gains Might (2).", "{u} 's Slam hits {v} for {n}.", "Might fades from {u}.", "Bog Ogre attacks. {u} dodges.", "{u} misses {v}.", "{u} uses Juju.", "Cat ({u}) growls.", "{u} misses Ogre.", "COMBATANT_INFO: 27.01.26 20:00:00&{v}&ROGUE"]
_ROSTER = f"""x AS (SELECT *, 'd' || (user_id % 5) AS log, seq % 12 AS f, {U} AS u, {V} AS v FROM e), ro AS (SELECT log, name, min(seq) AS first FROM (SELECT log, seq, u AS name FROM x WHERE f = 0 UNION ALL SELECT log, seq, v FROM x WHERE f = 11) GROUP BY 1, 2),
k AS (SELECT x.*, coalesce(a.first < seq, FALSE) AS ku, coalesce(b.first < seq, FALSE) AS kv FROM x LEFT JOIN ro a ON x.log = a.log AND u = a.name LEFT JOIN ro b ON x.log = b.log AND v = b.name)"""


def _gated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = scratch.cut(D.decode(logs.spread(rendered(spark, sf_dir, _GATED, 5))))  # stored, as it is read several times
    return d, N.roster(d)


@query(f"""{E}, {_ROSTER} SELECT log, seq, CASE f WHEN 1 THEN 'Interrupt' WHEN 2 THEN 'Interrupt' WHEN 3 THEN 'AuraGain' WHEN 4 THEN 'Damage' ELSE 'AuraFade' END AS kind, ku AS source_known, f IN (1, 4) AND kv AS target_known FROM k WHERE f = 1 AND ku AND NOT kv OR f = 2 AND ku OR f IN (3, 5) AND ku OR f = 4""")
def gated_by_roster(spark, sf_dir):
    """Interrupts and auras count for players that the roster knows by then, interrupts on others only."""
    d, players = _gated(spark, sf_dir)
    return N.gated_entries(d, players).select(F.col("log_id").alias("log"), "seq", "kind", "source_known", "target_known")


@query(f"""{E}, {_ROSTER} SELECT log, seq, CASE WHEN f = 6 THEN 'dodge' WHEN f = 7 AND kv THEN 'missed_by' ELSE 'misses' END AS kind, CASE WHEN f = 7 AND kv THEN v ELSE u END AS player FROM k WHERE f = 6 AND ku OR f = 7 AND ku <> kv OR f = 10 AND ku""")
def avoided_by_roster(spark, sf_dir):
    d, players = _gated(spark, sf_dir)
    return N.avoidance_events(d, players).select(F.col("log_id").alias("log"), "seq", "kind", "player")


@query(f"""{E}, {_ROSTER} SELECT log, seq, u AS player, 'Juju' AS consumable, 'Jujus' AS label FROM k WHERE f = 8 AND ku""")
def uses_by_roster(spark, sf_dir):
    d, players = _gated(spark, sf_dir)
    items = spark.createDataFrame([("Juju", 1, "Jujus", False, False), ("Toy", None, None, False, True)], "item string, category int, label string, prefix boolean, ignored boolean")
    return N.consumable_uses(d, players, items).select(F.col("log_id").alias("log"), "seq", "player", "consumable", "label")


@query(f"""{E}, {_ROSTER} SELECT log, 'Cat' AS pet, arg_max(u, seq) AS owner FROM k WHERE f = 9 AND ku GROUP BY 1""")
def owners_by_roster(spark, sf_dir):
    d, players = _gated(spark, sf_dir)
    return N.pet_owners(d, players).select(F.col("log_id").alias("log"), "pet", "owner")


_FACTS = ["ZONE_INFO: 1&Bog Keep&0", "{u} hits {v} for {n}.", "PLAYERS_IN_COMBAT: {k}/40", "ZONE_INFO: 1&Twin Hall&0", "nothing", "ZONE_INFO: 1"]


@query(f"""{E}, x AS (SELECT *, 'd' || (user_id % 5) AS log, seq % 6 AS f FROM e) SELECT log, arg_max(CASE f WHEN 0 THEN 'Bog Keep' ELSE 'Twin Hall' END, seq) FILTER (WHERE f IN (0, 3)) AS zone, arg_max(seq % 40 + 1, seq) FILTER (WHERE f = 2) AS active, CAST(40 AS BIGINT) AS total FROM x GROUP BY 1""")
def facts_of_sessions(spark, sf_dir):
    """Last zone and raid size of each session."""
    d = D.decode(logs.spread(rendered(spark, sf_dir, _FACTS, 5)))
    return N.session_facts(d).select(F.col("log_id").alias("log"), "zone", "raid_size.active", "raid_size.total")


_RANKED = ["CAST: {u} casts Mend(12)(Rank {k}) on Ann.", "{u} 's Mend heals Ann for {n}.", "Ann gains {n} health from {u} 's Mend.", "Bog Ogre hits Ann for {n}.", "{u} 's Other heals Ann for {n}.", "PLAYER_REGEN_DISABLED", "PLAYER_REGEN_ENABLED"]


@query(f"""{E}, x AS (SELECT *, 'd' || (user_id % 5) AS log, seq % 7 AS f, {U} AS u FROM e),
r AS (SELECT *, last_value(CASE WHEN f = 0 THEN seq % 40 + 1 END IGNORE NULLS) OVER (PARTITION BY log, u ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank,
  lag(CASE f WHEN 5 THEN 's' ELSE 'e' END) OVER (PARTITION BY log, f IN (5, 6) ORDER BY seq) AS pm FROM x),
z AS (SELECT *, sum(CASE WHEN f = 5 OR f = 6 AND pm = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY log ORDER BY seq) AS reset FROM r),
d AS (SELECT *, CASE WHEN f = 3 THEN amt ELSE -amt END AS delta FROM z WHERE f IN (1, 2, 3, 4)),
s AS (SELECT *, sum(delta) OVER w AS cs FROM d WINDOW w AS (PARTITION BY log, reset ORDER BY seq)),
m AS (SELECT *, least(0, min(cs) OVER w) AS low FROM s WINDOW w AS (PARTITION BY log, reset ORDER BY seq)),
o AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY log, reset ORDER BY seq), 0) - low AS over FROM m)
SELECT log, seq, CASE f WHEN 4 THEN 'Other' ELSE 'Mend' || coalesce(' (Rank ' || rank || ')', '') END || CASE f WHEN 2 THEN ' (hot)' ELSE '' END AS spell, CAST(amt - over AS BIGINT) AS effective, CAST(over AS BIGINT) AS overheal FROM o WHERE f <> 3""")
def heals_by_rank(spark, sf_dir):
    """From lines to entries: ranks of the last cast, and what healing beyond the damage since the last combat mark is worth."""
    d = scratch.cut(D.decode(logs.spread(rendered(spark, sf_dir, _RANKED, 5))))  # stored, as it is read several times
    players = spark.createDataFrame([], "log_id string, session_id int, name string, first_seen_seq long")
    return N.entries(d, players).where("kind = 'Healing'").select(F.col("log_id").alias("log"), "seq", "spell", F.col("effective_heal").alias("effective"), "overheal")


_BOSSES = (("bogling", "bog keep", False), ("mire", "bog keep", True), ("mire lord", "bog keep", True), ("lord of c'thun", "bog keep", True), ("left twin", "twin hall", True), ("twin", "twin hall", True))
_TALK = ["{u} hits Mire Lord for {n}.", "Mire hits Lord of C'Thun.", "the Admire Lords hit", "{u} hits Left Twin, Mire Lord", "LEFT TWIN", "nothing said", "mire lord of c'thun", "x-twin."]


@query(f"""{E}, x AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 'bog keep' WHEN 1 THEN 'twin hall' END AS zone, seq % 8 AS f FROM e)
SELECT seq, CASE f WHEN 0 THEN CASE WHEN zone = 'twin hall' THEN NULL ELSE 'mire lord' END WHEN 1 THEN CASE WHEN zone = 'twin hall' THEN NULL ELSE 'lord of c''thun' END WHEN 3 THEN CASE WHEN zone = 'bog keep' THEN 'mire lord' ELSE 'left twin' END
WHEN 4 THEN CASE WHEN zone = 'bog keep' THEN NULL ELSE 'left twin' END WHEN 6 THEN CASE WHEN zone = 'twin hall' THEN NULL ELSE 'lord of c''thun' END WHEN 7 THEN CASE WHEN zone = 'bog keep' THEN NULL ELSE 'twin' END END AS boss FROM x""")
def bosses_in_text(spark, sf_dir):
    """The first boss of the zone (or of all) that a line names, as whole words; names may overlap."""
    npcs = spark.createDataFrame(_BOSSES, "npc string, instance string, is_boss boolean")
    lines = rendered(spark, sf_dir, _TALK).join(events(spark, sf_dir).select("seq", F.expr("case user_id % 3 when 0 then 'bog keep' when 1 then 'twin hall' end").alias("zone")), "seq")
    # of "mire" and "mire lord" at one place the shorter is first; where it is a word of its own, it is what is found
    return lines.select("seq", encounters.first_boss(F.lower("text"), F.col("zone"), npcs.where("npc <> 'mire'")).alias("boss"))


def _nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fights, a log for each customer: (log_id, session_id, seq, text)."""
    order = "row_number() over (partition by o_custkey order by o_orderkey)"
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey as key", "o_orderstatus as st", f"{order} * 1000 as base", "element_at(array('Mire Lord', 'Left Twin', 'Right Twin'), cast(o_orderkey % 3 + 1 as int)) as boss")
    died = "concat('UNIT_DIED:', boss, ':0xF130000000000001')"
    steps = (
        (0, "'PLAYER_REGEN_DISABLED'"), (5, "concat('Ann ''s Slam hits ', boss, ' for 50.')"), (6, "concat(boss, ' hits Bob for 9.')"), (10, "if(key % 4 = 0, 'UNIT_DIED:Ann:0x0000000000000001', null)"),
        (20, f"if(st = 'F', {died}, null)"), (30, "'PLAYER_REGEN_ENABLED'"), (45, "if(key % 5 = 0, concat('Bob ''s Slam hits ', boss, ' for 5.'), null)"), (100, f"if(st = 'P', {died}, null)"),
    )
    listed = ", ".join(f"struct({at} as at, {k} as k, {text} as text)" for k, (at, text) in enumerate(steps))
    fights = o.selectExpr("o_custkey", "key", "base", f"explode(array({listed})) as x").selectExpr("o_custkey", "key * 16 + x.k as seq", "base + x.at as s", "x.text").where("text is not null")
    roster = [f"'COMBATANT_INFO: 27.01.26 20:00:00&{n}&MAGE'" for n in ("Ann", "Bob", "Cid")] + ["'ZONE_INFO: 1&Bog Keep&0'"]
    heads = o.select("o_custkey").distinct().selectExpr("o_custkey", f"posexplode(array({', '.join(roster)})) as (seq, text)").selectExpr("o_custkey", "cast(seq as long) as seq", "cast(0 as bigint) as s", "text")
    clock = "concat('1/27 ', cast(s div 3600 as string), ':', cast(s % 3600 div 60 as string), ':', cast(s % 60 as string), '.0  ')"
    return logged(fights.unionByName(heads), F.col("o_custkey")).selectExpr("log_id", "session_id", "seq", f"concat({clock}, text) as text")


@query("""WITH o AS (SELECT o_custkey, o_orderkey AS key, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
f AS (SELECT *, CASE key % 3 WHEN 0 THEN 'Mire Lord' ELSE 'The Twins' END AS name, st IN ('F', 'P') AS is_kill, CASE WHEN st = 'P' THEN 100 WHEN st = 'O' AND key % 5 = 0 THEN 45 ELSE 30 END AS len, CASE WHEN key % 4 = 0 THEN 1 ELSE 0 END AS deaths FROM o),
b AS (SELECT *, is_kill OR deaths = 1 AS is_boss FROM f)
SELECT CAST(o_custkey AS VARCHAR) AS log, CAST(k AS INT) AS enc_idx, name, 'bog keep' AS zone, len::DOUBLE AS duration, is_boss, is_kill, CAST(deaths AS INT) AS player_deaths, CAST(2 AS INT) AS active_players,
CASE WHEN is_boss THEN CAST(row_number() OVER (PARTITION BY o_custkey, name, is_boss ORDER BY k) AS INT) END AS attempt FROM b""")
def fights_from_lines(spark, sf_dir):
    """From lines to finished encounters: names, kills in combat and late ones, wipes that go on after combat, groups, resets and attempts."""
    cut = scratch.cut
    d = cut(D.decode(logs.spread(_nights(spark, sf_dir))))
    players = cut(N.roster(d))
    npcs = spark.createDataFrame([("mire lord", "bog keep", True, None), ("left twin", "twin hall", True, "The Twins"), ("right twin", "twin hall", True, "The Twins")], "npc string, instance string, is_boss boolean, group_name string")
    zones = spark.createDataFrame([("bog keep", True, False, False, 1), ("twin hall", True, False, False, 1)], "zone string, is_instance boolean, is_dungeon boolean, is_overworld boolean, encounter_count int")
    enc = encounters.encounters(d, cut(N.entries(d, players)), N.combat_marks(d), players, npcs, zones)
    return enc.select(F.col("log_id").alias("log"), "enc_idx", "name", "zone", "duration", "is_boss", "is_kill", "player_deaths", "active_players", F.col("attempt").cast("int").alias("attempt"))


_SPELLS = """WITH o AS (SELECT o_custkey, o_orderkey AS key, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
g AS (SELECT *, CASE WHEN key % 6 = 0 AND k > 1 THEN 5000 ELSE 1000 END AS gap FROM o), b AS (SELECT *, sum(gap) OVER (PARTITION BY o_custkey ORDER BY k) AS base, sum(CASE WHEN gap > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY k) AS part FROM g),
s AS (SELECT o_custkey, part, min(base) AS first, max(base) AS last, count(*) AS combats, count(*) FILTER (WHERE st <> 'O') AS kills, sum(3 + CASE WHEN st <> 'O' THEN 1 ELSE 0 END) AS lines FROM b GROUP BY 1, 2),
e AS (SELECT *, CASE WHEN part = 0 OR kills > 0 THEN 'bog keep' ELSE 'unknown' END AS zone FROM s)"""


def _evenings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as short fights, a log for each customer, with long pauses before some: (log_id, seq, text)."""
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey as key", "o_orderstatus as st", "row_number() over (partition by o_custkey order by o_orderkey) as k")
    o = o.selectExpr("*", "sum(if(key % 6 = 0 and k > 1, 5000, 1000)) over (partition by o_custkey order by k) as base")
    steps = ((0, "'PLAYER_REGEN_DISABLED'"), (5, "'Ann hits Ogre for 5.'"), (20, "if(st <> 'O', 'UNIT_DIED:Mire Lord:0xF130000000000001', null)"), (30, "'PLAYER_REGEN_ENABLED'"))
    listed = ", ".join(f"struct({at} as at, {k} as k, {text} as text)" for k, (at, text) in enumerate(steps))
    fights = o.selectExpr("o_custkey", "key", "base", f"explode(array({listed})) as x").selectExpr("o_custkey", "key * 8 + x.k as seq", "base + x.at as s", "x.text").where("text is not null")
    gear = "&".join(["nil"] * 19)
    heads = ("'ZONE_INFO: 1&The Bog&0'", f"'COMBATANT_INFO: 27.01.26 20:00:00&Ann&MAGE&Human&2&nil&nil&nil&1&{gear}&1}}2}}3&0x1&nil'", "''")
    first = o.select("o_custkey").distinct().selectExpr("o_custkey", f"posexplode(array({', '.join(heads)})) as (seq, text)").selectExpr("o_custkey", "cast(seq as long) as seq", "cast(0 as bigint) as s", "text")
    clock = "concat('1/', cast(27 + s div 86400 as string), ' ', cast(s % 86400 div 3600 as string), ':', cast(s % 3600 div 60 as string), ':', cast(s % 60 as string), '.0  ')"
    return fights.unionByName(first).selectExpr("cast(o_custkey as string) as log_id", "seq", f"if(text = '', '   ', concat({clock}, text)) as text")


def _found_sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..operators import sessions

    cut = scratch.cut
    lines = cut(_evenings(spark, sf_dir))
    npcs = spark.createDataFrame([("mire lord", "bog keep", True, None)], "npc string, instance string, is_boss boolean, group_name string")
    zones = spark.createDataFrame([("bog keep", True, False, False, 2)], "zone string, is_instance boolean, is_dungeon boolean, is_overworld boolean, encounter_count int")
    aliases = spark.createDataFrame([("the bog", "Bog Keep")], "alias string, canonical string")
    marks = cut(sessions.markers(lines, npcs, aliases))  # read twice below
    return lines, cut(sessions.sessions(sessions.number_sessions(marks, zones), zones, sessions.log_years(lines)))


@query(f"""{_SPELLS}, n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY part) AS no FROM e)
SELECT CAST(o_custkey AS VARCHAR) AS log, CAST(no AS BIGINT) AS session_no, zone, zone <> 'unknown' AS is_raid, combats, kills, CASE WHEN zone = 'unknown' THEN 'Unknown' WHEN kills >= 2 THEN 'Bog Keep Full Clear' WHEN kills = 1 THEN 'Bog Keep (1/2)' ELSE 'Bog Keep (wipes)' END AS name,
CASE WHEN part = 0 THEN 'Ann' ELSE '' END AS you, CAST(2026 AS INT) AS year, CAST(last + 30 - CASE WHEN part = 0 THEN 0 ELSE first END AS BIGINT) AS seconds FROM n""")
def sessions_from_lines(spark, sf_dir):
    """From lines to sessions: markers, pauses, zones by alias and by kills, names."""
    _, s = _found_sessions(spark, sf_dir)
    return s.select(
        F.col("log_id").alias("log"), "session_no", "zone", "is_raid", F.col("combat_count").alias("combats"), F.col("kill_count").alias("kills"), "name", F.array_join("you_players", ",").alias("you"),
        F.col("start_year").alias("year"), F.round("duration").cast("long").alias("seconds"),
    )


@query(f"""{_SPELLS}, n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY part) AS no FROM e)
SELECT CAST(o_custkey AS VARCHAR) AS log, CAST(no AS BIGINT) AS session_no, CAST(lines + CASE WHEN part = 0 THEN 2 ELSE 0 END AS BIGINT) AS n, CASE WHEN part = 0 THEN 'Ann' ELSE 'Unknown' END || CASE WHEN zone = 'unknown' THEN '-Unknown' ELSE '-BogKeep' END || '-2026-' || strftime(TIMESTAMP '2026-01-27' + to_seconds(CAST(CASE WHEN part = 0 THEN 0 ELSE first END AS BIGINT)), '%m-%d') || '-export' AS stem FROM n""")
def lines_of_sessions(spark, sf_dir):
    """Lines of each session, and the names under which sessions are exported, without what tells repeats apart."""
    from ..operators import sessions

    lines, s = _found_sessions(spark, sf_dir)
    n = sessions.assign_lines(lines, s).groupBy("log_id", "session_id").agg(F.count("*").alias("n"))
    named = logs.export_names(s).select("log_id", F.col("session_no").alias("session_id"), F.regexp_extract("export_name", "^.*-export", 0).alias("stem"))
    return n.join(named, ["log_id", "session_id"]).select(F.col("log_id").alias("log"), F.col("session_id").alias("session_no"), "n", "stem")


#: What rewriting makes of lines, in a log whose recorder is Ann, where Hun has the pet Rex.
_REWRITTEN = (
    ("You suffer {n} damage from your Burn.", "Ann suffers {n} damage from Ann (self damage) 's Burn."), ("Your Slam hits you for {n}.", "Ann (self damage) 's Slam hits Ann for {n}."), ("Your Slam is parried by Bob.", "Ann 's Slam was parried by Bob."),
    ("Your Slam hits Ogre for {n}.", "Ann 's Slam hits Ogre for {n}."), ("You gain {n} Mana from Bob's Gift.", "Ann gains {n} Mana from Bob 's Gift."), ("You gain {n} Rage from Charge.", "Ann gains {n} Rage from Ann 's Charge."), ("You gain Might (1).", "Ann gains Might (1)."),
    ("You hit Ogre for {n}.", "Ann hits Ogre for {n}."), ("You crit Ogre for {n}.", "Ann crits Ogre for {n}."), ("You are afflicted by Rot (1).", "Ann is afflicted by Rot (1)."), ("You suffer {n} damage from Ogre 's Rot.", "Ann suffers {n} damage from Ogre 's Rot."),
    ("You lose {n} health.", "Ann loses {n} health."), ("You die.", "Ann dies."), ("You cast Zap on Ogre.", "Ann casts Zap on Ogre."), ("You create Bread.", "Ann creates Bread."), ("You perform Dance.", "Ann performs Dance."), ("You interrupt Ogre.", "Ann interrupts Ogre."),
    ("You miss Ogre.", "Ann misses Ogre."), ("You attack. Ogre dodges.", "Ann attacks. Ogre dodges."), ("Ogre attacks. You block.", "Ogre attacks. Ann blocks."), ("Ogre attacks. You parry.", "Ogre attacks. Ann parries."), ("Ogre attacks. You dodge.", "Ogre attacks. Ann dodges."),
    ("Ogre attacks. You resist.", "Ogre attacks. Ann resists."), ("Ogre attacks. You absorb all.", "Ogre attacks. Ann absorbs all."), ("You reflect {n} damage.", "Ann reflects {n} damage."), ("You receive loot.", "Ann receives loot."), ("Ogre attacks. You deflect.", "Ogre attacks. Ann deflects."),
    ("Bob 's Slam was dodged.", "Bob 's Slam was dodged by Ann."), ("Ogre causes you {n} harm.", "Ogre causes Ann {n} harm."), ("Bob 's Mend heals you for {n}.", "Bob 's Mend heals Ann for {n}."), ("Ogre hits you for {n}.", "Ogre hits Ann for {n}."), ("Ogre crits you for {n}.", "Ogre crits Ann for {n}."),
    ("You have slain Ogre!", "Ogre is slain by Ann."), ("Ogre glares at you.", "Ogre glares at Ann."), ("You fall and lose {n} health.", "Ann falls and loses {n} health."), ("Rex (Hun) hits Ogre for {n}.", "Hun 's (pet) Auto Attack hits Ogre for {n}."), ("Rex (Hun)'s Bite hits Ogre for {n}.", "Hun 's (pet) Bite hits Ogre for {n}."),
    ("Bob's Mend heals Cid for {n}.", "Bob 's Mend heals Cid for {n}."), ("Ogre suffers {n} Fire damage from Bob's Burn.", "Ogre suffers {n} Fire damage from Bob 's Burn."), ("Onyxia's Elite Guard hits Bob for {n}.", "Onyxia's Elite Guard hits Bob for {n}."),
    ("LOOT: x&Bob receives loot: |cffa335ee|Hitem:7:0|h[Blade]|h|r.", "LOOT: x&Bob receives loot: |cffa335ee|Hitem:7:0|h[Blade]|h|rx1."), ("Searing Totem IV (Sham)'s Attack hits Ogre for {n}.", "Sham 's Attack hits Ogre for {n}."), ("Cid's Zap hits Cid for {n}.", "Cid (self damage) 's Zap hits Cid for {n}."),
    ("Bob's Lightning Strike was resisted by Ogre.", "Bob 's Lightning Strike (nature) was resisted by Ogre."), ("Cid suffers {n} Fire damage from Cid's Burn.", "Cid suffers {n} Fire damage from Cid (self damage) 's Burn."), ("Ogre is immune to Bob's Slam.", "Ogre is immune to Bob 's Slam."),
    ("Sam (Sam) hits Ogre for {n}.", "Sam 's (pet) Auto Attack hits Ogre for {n}."), ("Rex's Might fades from Bob.", "Rex's Might fades from Bob."), ("Bob gains Warchief's Blessing (1).", "Bob gains Warchief's Blessing (1)."), ("Cid suffers {n} damage from Bob 's Power Overwhelming.", "Cid suffers {n} damage from Bob (self damage) 's Power Overwhelming."),
)


@query(f"""{E} SELECT seq, replace(list_extract([{", ".join("'" + b.replace("'", "''") + "'" for _, b in _REWRITTEN)}], CAST(seq % {len(_REWRITTEN)} AS INT) + 1), '{{n}}', CAST(amt AS VARCHAR)) AS line FROM e""")
def rewritten_lines(spark, sf_dir):
    """Lines of every rule of rewriting: first and second person, pets and their spells, possessives, renamings, harm to oneself."""
    lines = rendered(spark, sf_dir, [a for a, _ in _REWRITTEN], 5)
    gear = "&".join(["nil"] * 19)
    heads = [f"COMBATANT_INFO: 27.01.26 20:00:00&ann&MAGE&Human&2&nil&nil&nil&1&{gear}&1}}2}}3&0x1&nil", f"COMBATANT_INFO: 27.01.26 20:00:00&Hun&HUNTER&Human&2&Rex&nil&nil&1&{gear}&nil&0x1&nil", f"COMBATANT_INFO: 27.01.26 20:00:00&Sam&HUNTER&Human&2&Sam&nil&nil&1&{gear}&nil&0x1&nil", "CAST: Rex casts Bite(17261)(Rank 8) on Ogre."]
    first = lines.select("log_id", "session_id").distinct().select("log_id", "session_id", F.posexplode(F.array(*[F.lit(CLOCK + h) for h in heads])).alias("seq", "text"))
    told = normalise.normalise(logs.spread(lines.unionByName(first.withColumn("seq", F.col("seq").cast("long") - len(heads)))))
    return told.where("seq >= 0").select("seq", F.expr(f"substring(text, {len(CLOCK) + 1})").alias("line"))


@query("""SELECT p_partkey, CASE WHEN contains(' ' || p_name || ' ', ' ring ') THEN TRUE ELSE FALSE END AS has_ring, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part""")
def words_of_names(spark, sf_dir):
    """Whole words in names, and names in title case."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.coalesce(lookups.contains_word(F.col("p_name"), F.lit("ring")), F.lit(False)).alias("has_ring"), lookups.title_case(F.col("p_name")).alias("title"))


_PETS = ["COMBATANT_INFO: 1&{u}&MAGE&Human&2&nil&x", "COMBATANT_INFO: 1&{u}&MAGE&Human&2&{u}&x", "COMBATANT_INFO: 1&{u}&MAGE&Human&2&Rex&x", "COMBATANT_INFO: 1&{u}&MAGE&Human&2&Deathknight Understudy (3)&x", "COMBATANT_INFO: 1&{u}", "{u}  's Slam", "LOOT: x|h|r."]


@query(f"""{E} SELECT seq, '{CLOCK}' || CASE seq % 7 WHEN 4 THEN 'COMBATANT_INFO: 1&' || {U} WHEN 5 THEN {U} || '''s Slam' WHEN 6 THEN 'LOOT: x|h|rx1.' ELSE 'COMBATANT_INFO: 1&' || {U} || '&MAGE&Human&2&' || {_case(["'nil'", U + " || 'Pet'", "'Rex'", "'nil'"], 7)} || '&x' END AS line FROM e""")
def cleaned_lines(spark, sf_dir):
    """The first pass over lines: pets of roster lines, possessives, loot without a quantity."""
    return normalise.first_pass(rendered(spark, sf_dir, _PETS)).select("seq", F.col("text").alias("line"))


_CLOCKED = "'1/27 ' || CAST(7 + us % 6 AS {s}) || ':' || CAST(seq % 4 AS {s}) || ':5.5'"


@query(f"""{E}, l AS (SELECT seq, 'd' || (user_id % 5) AS log, {_CLOCKED.format(s="VARCHAR")} AS clock, CASE WHEN event_type = 'signup' THEN {U} END AS me FROM e),
m AS (SELECT log, clock, arg_max(me, seq) AS me FROM l WHERE me IS NOT NULL GROUP BY 1, 2), c AS (SELECT DISTINCT log, clock FROM l), f AS (SELECT log, arg_min(me, seq) AS first FROM l WHERE me IS NOT NULL GROUP BY 1),
a AS (SELECT c.log, c.clock, arg_max(m.me, m.clock) AS last FROM c LEFT JOIN m ON m.log = c.log AND m.clock <= c.clock GROUP BY 1, 2)
SELECT seq, l.log, coalesce(last, first) AS me FROM l JOIN a ON l.log = a.log AND l.clock = a.clock LEFT JOIN f ON l.log = f.log""")
def recorders_by_text_of_times(spark, sf_dir):
    """Who records a line, with times compared as text."""
    e = events(spark, sf_dir)
    head = F.concat(F.lit("  COMBATANT_INFO: 1.1.24&"), F.expr(_U.format(s="string")), F.lit("&MAGE&1}2}3"))
    text = F.concat(F.expr(_CLOCKED.format(s="string")), F.when(F.col("event_type") == "signup", head).otherwise(F.lit("  You rest.")))
    lines = e.select(F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string")).alias("log_id"), F.lit(0).alias("session_id"), "seq", text.alias("text"))
    return normalise.recording_player(lines, strict=True).select("seq", F.col("log_id").alias("log"), "me")


@query(f"""{_SPELLS}, t AS (SELECT o_custkey, sum(lines) + 3 AS n, sum(kills) AS k FROM e GROUP BY 1) SELECT CAST(o_custkey AS VARCHAR) AS log, CAST(n AS BIGINT) AS n FROM t WHERE k = 0""")
def logs_without_raids(spark, sf_dir):
    """Logs without a session that counts are one session, all lines of them: here logs without a kill."""
    from ..operators import sessions

    lines, s = _found_sessions(spark, sf_dir)
    return sessions.whole_log(lines, s.withColumn("is_raid", F.col("kill_count") > 0)).groupBy(F.col("log_id").alias("log")).agg(F.count("*").alias("n"))


@query(f"""{E} SELECT 'd' || (user_id % 5) AS log, row_number() OVER (PARTITION BY user_id % 5 ORDER BY seq) AS pos, '{CLOCK}' || CASE seq % 3 WHEN 0 THEN {U} || ' rests.' WHEN 1 THEN '' ELSE {V} || ' hits for ' || amt || '.' END AS line FROM e""")
def logs_read_back(spark, sf_dir):
    """Logs written as text and read by the reader: each file is a log, and lines keep their order."""
    path = f"{scratch.root(spark)}/logs-{uuid.uuid4().hex}"
    rows = rendered(spark, sf_dir, ["{u} rests.", "", "{v} hits for {n}."], 5)
    rows.repartition("log_id").sortWithinPartitions("log_id", "seq").select("text", F.col("log_id").alias("log")).write.partitionBy("log").text(path)
    back = logs.read_logs(spark, f"{path}/*/*.txt")
    order = W.partitionBy("log_id").orderBy("seq")
    return back.select(F.regexp_extract("log_id", "log=(d[0-9])", 1).alias("log"), F.row_number().over(order).cast("long").alias("pos"), F.col("text").alias("line"))


@query(f"""{E} SELECT 'Ann-BogKeep-2026-01-27-export-' || md5('d' || (user_id % 5))[:16] AS name, CAST(seq // 1024 AS BIGINT) AS part, count(*) AS n, md5(string_agg('{CLOCK}' || {U} || ' rests.', chr(10) ORDER BY seq)) AS digest FROM e WHERE user_id % 5 < 4 GROUP BY 1, 2""")
def exports_read_back(spark, sf_dir):
    """Sessions of four logs that come to one name, exported in parts and read back in order; a fifth has no raid."""
    path = f"{scratch.root(spark)}/exports-{uuid.uuid4().hex}"
    lines = rendered(spark, sf_dir, ["{u} rests."], 5)
    s = lines.select("log_id").distinct().select(
        "log_id", F.lit(0).alias("session_no"), F.lit("Bog Keep (1/2)").alias("name"), (F.col("log_id") != "d4").alias("is_raid"), F.lit(5015520.0).alias("start_time"), F.lit(2026).alias("start_year"), F.array(F.lit("Ann")).alias("you_players")
    )
    logs.export_sessions(lines, s, path, part_bits=10)
    back = spark.read.text(path).select(F.col("export_name").alias("name"), F.col("part").cast("long").alias("part"), F.monotonically_increasing_id().alias("i"), "value")
    # a part has 1024 lines at most
    return back.groupBy("name", "part").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x.value), "\n")).alias("digest"))
