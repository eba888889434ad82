"""Decoding of log lines: text to typed columns, in one pass and without Python per row.

Each event family has a keyword test (a regular expression that doesn't match costs far more than one that does) and one
pattern for each form. A pattern runs once on the line; its groups are cut out of the short match. Names are letters only, as in
the game's log grammar.

A family is cut into groups and then built: decode() puts all groups that are asked for in one column of arrays, behind a
generator, so that Spark works them out once, in compiled code, and builds only the fields that are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The log's grammar and the game's spell names.
DISPELS = (
    "Dispel Magic", "Remove Curse", "Cleanse", "Purify", "Abolish Disease",
    "Abolish Poison", "Cure Disease", "Cure Poison", "Remove Lesser Curse", "Purge",
)
RESURRECTS = ("Resurrection", "Redemption", "Ancestral Spirit", "Rebirth", "Soulstone Resurrection", "Revive")
INTERRUPTS = ("Kick", "Pummel", "Earth Shock", "Counterspell", "Shield Bash", "Feral Charge", "Bash", "Spell Lock")
SCHOOLS = ("Fire", "Nature", "Frost", "Shadow", "Arcane", "Holy", "Physical")
QUALITIES = (
    ("9d9d9d", 0, "Poor"), ("ffffff", 1, "Common"), ("1eff00", 2, "Uncommon"),
    ("0070dd", 3, "Rare"), ("a335ee", 4, "Epic"), ("ff8000", 5, "Legendary"),
)
#: Where a run of words begins, and a name in front of what no letter can begin: taken whole, as Java matches repeated groups that
#: may give back by recursion, which a long line would drive over the stack.
_RUN = r"(?<![A-Za-z])(?<![A-Za-z]\s)"
_NAME = r"([A-Za-z]++(?:\s[A-Za-z]+)*+(?:\s*\([^)]+\))?)"
#: A name in front of a verb, from which words must be given back: letters and white space. Where the line has a wider gap between
#: words (GAP), which a name doesn't cross, the exact form with recursion is used.
_LOOSE = r"[A-Za-z][A-Za-z\s]*(?<=[A-Za-z])"
_EXACT = r"[A-Za-z]+(?:\s[A-Za-z]+)*"
GAP = r"[A-Za-z]\s\s+[A-Za-z]"
#: Characters up to which a line may have such a gap: half as many words stay well within the stack.
GAP_CHARS = 2_000
CAST = r"(?<![A-Za-z])(?:CAST:\s*)?([A-Za-z]+)\s+casts\s+([A-Za-z\s]+?)(?:\(\d+\))?(?:\(Rank \d+\))?\s+on\s+([A-Za-z\s]+)"
CAST_RANK = r"CAST:\s*({who})\s+(?:casts|begins to cast)\s+([A-Za-z][A-Za-z '\-]+?)(?:\(\d+\))++\(Rank (\d+)\)"
DAMAGE_SPELL = _RUN + _NAME + r" 's (?:\(pet\) )?([A-Za-z\s']+) (?:hits|crits) ([A-Za-z\s']+) for (\d+)"
DAMAGE_MELEE = _RUN + r"({who}) (?:hits|crits) ([A-Za-z\s']+) for (\d+)\."
DAMAGE_TICK = r"(?<![A-Za-z\s'])([A-Za-z\s']+) suffers (\d+) (?:\w+ )?damage from " + _NAME + r" 's (?:\(pet\) )?([A-Za-z\s']+)"
HEAL_DIRECT = _RUN + _NAME + r" 's ([A-Za-z\s']+) (?:heals|critically heals) ([A-Za-z\s']+(?:\s*\([^)]+\))?) for (\d+)"
HEAL_TICK = _RUN + r"({who}(?:\s*\([^)]+\))?) gains (\d+) health from " + _NAME + r" 's ([A-Za-z\s']+)"
DODGE = r"(?<![A-Za-z\s'])([A-Za-z\s']+) attacks\. ([A-Za-z]+) dodges\."
PARRY = r"(?<![A-Za-z\s'])([A-Za-z\s']+) attacks\. ([A-Za-z]+) parries\."
MISS = r"(?<![A-Za-z\s'])([A-Za-z\s']+) misses ([A-Za-z]+)\."
AURA_GAIN = r"(?<![A-Za-z])([A-Za-z]+) gains ([A-Za-z\s':]+?) \((\d+)\)\."
AURA_FADE = r"(?<![A-Za-z\s':])([A-Za-z\s':]+?) fades from ([A-Za-z]+)\."
AFFLICTED = r"(?<![A-Za-z])([A-Za-z]+) is afflicted by ([A-Za-z\s':]+?)(?:\s+\((\d+)\))?\."
LOOT = r"LOOT:.*?&([A-Za-z]+) receives (?:loot|item): \|cff([a-f0-9]{6})\|Hitem:(\d+):[^|]+\|h\[([^\]]+)\]\|h\|rx?(\d+)"
TRADE = r"LOOT_TRADE:.*?&([A-Za-z]+) trades item (.+?) to ([A-Za-z]+)\."
PET_OWNER = r"(?<![A-Za-z])([A-Za-z]+)\s+\(([A-Za-z]+)\)"
CONSUMABLE = r"(?<![A-Za-z])([A-Za-z]+) uses ([A-Za-z][A-Za-z '\-]+?)(?:\s+on\s+[A-Za-z\s]+)?\."
CLOCK = r"^\d{1,4}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d+"
RAID_SIZE = r"PLAYERS_IN_COMBAT:\s*(\d+)/(\d+)"
UNIT_DIED = r"UNIT_DIED:([^:]+):(\S*)"

_CUT = "\x01"


def captures(text: Column, pattern: str, new: str) -> Column:
    """Parts of the first match as an array, null if there is none: new names them ($1 for a group) between bars. A group that took
    no part is empty."""
    found = F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    return F.split(F.regexp_replace(found, pattern, new.replace("|", _CUT)), _CUT)


def named_captures(text: Column, pattern: str, new: str) -> Column:
    """captures() for a pattern with a name before a verb at {who}: a name has single white space between its words.

    A line of more than GAP_CHARS with a wider gap between two words anywhere has no match.
    """
    exact = F.when(F.length(text) <= GAP_CHARS, captures(text, pattern.replace("{who}", _EXACT), new))
    return F.when(text.rlike(GAP), exact).otherwise(captures(text, pattern.replace("{who}", _LOOSE), new))


def number(text: Column) -> Column:
    """A whole number; 0 if it can't be read."""
    return F.coalesce(text.try_cast("bigint"), F.lit(0))


def has(text: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def clock_parts(text: Column) -> Column:
    """Numbers of a line's time, as text; null if the line has no time."""
    return F.split(F.when(F.length(text) >= 11, F.nullif(F.regexp_extract(text, CLOCK, 0), F.lit(""))), "[/ :.]")


def seconds(parts: Column) -> Column:
    """Seconds of the log's clock, (month * 31 + day) days and the time of day, from clock_parts.

    The fraction is divided by 1000 whatever its number of digits.
    """
    n = [F.get(parts, F.lit(k)).try_cast("double") for k in range(6)]
    return (n[0] * 31 + n[1]) * 86400 + n[2] * 3600 + n[3] * 60 + n[4] + n[5] / 1000


def parse_ts(text: Column) -> Column:
    """Seconds of the log's clock; null if the line has no time."""
    return seconds(clock_parts(text))


def calendar_date(ts: Column, year: Column) -> Column:
    """Date of the log's clock in a given year (null if there is no such day)."""
    day = F.floor(ts / 86400).cast("int")
    month = F.floor((day - 1) / 31).cast("int")
    return F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day - month * 31), F.lit("yyyy-MM-dd")))


# ── Metadata lines ─────────────────────────────────────────────────────────────


def zone(text: Column) -> Column:
    """Zone between the first and the second & after the mark; null if it is empty or not closed."""
    parts = F.split(F.substring_index(text, "ZONE_INFO:", -1), "&")
    return F.when(text.contains("ZONE_INFO:") & (F.size(parts) >= 3), F.nullif(parts[1], F.lit("")))


def _roster_fields(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "^.*?COMBATANT_INFO:", ""), "&")


def _not_nil(x: Column) -> Column:
    return F.when(~x.isin("", "nil"), x)


def gear_slot(raw: Column) -> Column:
    """item:enchant:suffix:unique as a struct; null for nil and for item 0."""
    p = F.split(raw, ":")
    item = F.get(p, F.lit(0)).try_cast("int")
    return F.when(
        item > 0,
        F.struct(item.alias("item_id"), F.coalesce(F.get(p, F.lit(1)).try_cast("int"), F.lit(0)).alias("enchant_id"), F.coalesce(F.get(p, F.lit(2)).try_cast("int"), F.lit(0)).alias("suffix_id"), raw.alias("raw")),
    )


def talent_summary(raw: Column) -> Column:
    """Sum of the digits of each tree, as 31/20/0; null without trees."""
    digits = lambda t: F.aggregate(F.split(F.regexp_replace(t, "[^0-9]", ""), ""), F.lit(0), lambda a, c: a + F.coalesce(c.try_cast("int"), F.lit(0)))
    trees = F.transform(F.filter(F.split(raw, r"\}"), lambda t: t != ""), lambda t: digits(t).cast("string"))
    return F.when(raw.contains("}") & (raw != "nil") & (F.size(trees) > 0), F.array_join(trees, "/"))


def roster_parts(text: Column) -> Column:
    return F.when(text.contains("COMBATANT_INFO:"), _roster_fields(text))


def _is_whole(p: Column) -> Column:
    return (F.size(p) >= 29) & ~F.trim(F.get(p, F.lit(1))).isin("", "Unknown", "nil")


def _is_plain(p: Column) -> Column:
    return (F.size(p) >= 3) & ~F.get(p, F.lit(1)).isin("", "Unknown")


def roster_name(p: Column) -> Column:
    """The name alone, from roster_parts."""
    return F.when(_is_whole(p), F.trim(F.get(p, F.lit(1)))).when(_is_plain(p), F.get(p, F.lit(1)))


def roster(text: Column, p: Column) -> Column:
    """A roster line as a struct, from roster_parts: all fields if there are 29 or more, else name and class; null without a usable name."""
    at = lambda k: F.trim(F.get(p, F.lit(k)))
    none = lambda t: F.lit(None).cast(t)
    slot = "struct<item_id:int,enchant_id:int,suffix_id:int,raw:string>"
    full = F.struct(
        at(1).alias("name"), at(2).alias("class"), at(3).alias("race"), _not_nil(at(6)).alias("guild"), _not_nil(at(5)).alias("pet_name"),
        F.when(~at(29).isin("", "nil", "0x0"), at(29)).alias("guid"), talent_summary(at(28)).alias("talents"),
        F.transform(F.slice(p, 10, 19), lambda g: gear_slot(_not_nil(F.trim(g)))).alias("gear"),
    )
    least = F.struct(
        F.get(p, F.lit(1)).alias("name"), F.get(p, F.lit(2)).alias("class"), none("string").alias("race"), none("string").alias("guild"), none("string").alias("pet_name"),
        none("string").alias("guid"), none("string").alias("talents"), none(f"array<{slot}>").alias("gear"),
    )
    return F.when(p.isNotNull(), F.when(_is_whole(p), full).when(_is_plain(p), least))


def year(text: Column) -> Column:
    """Year of a roster line's DD.MM.YY; 90 and above are of the last century."""
    yy = F.substring(F.trim(F.get(_roster_fields(text), F.lit(0))), 7, 2).try_cast("int")
    return F.when(text.contains("COMBATANT_INFO:") & (F.size(_roster_fields(text)) >= 2), F.when(yy >= 90, yy + 1900).otherwise(yy + 2000))


def recorder(text: Column) -> Column:
    """Name on a roster line with talents of three trees (two braces): such lines are the recording player's own."""
    braces = F.length(text) - F.length(F.replace(text, F.lit("}"), F.lit("")))
    return F.when(text.contains("COMBATANT_INFO") & (braces == 2), F.nullif(F.get(F.split(text, "&"), F.lit(1)), F.lit("")))


def raid_size(text: Column) -> Column:
    g = captures(text, RAID_SIZE, "$1|$2")
    return F.when(text.contains("PLAYERS_IN_COMBAT:") & g.isNotNull(), F.struct(number(F.get(g, F.lit(0))).alias("active"), number(F.get(g, F.lit(1))).alias("total")))


def guid_class(guid: Column) -> Column:
    """player, pet or npc."""
    return F.when(guid.startswith("0x0000000000"), "player").when(guid.startswith("0xF140"), "pet").otherwise("npc")


def died_parts(text: Column) -> Column:
    return F.when(text.contains("UNIT_DIED:"), captures(text, UNIT_DIED, "$1|$2"))


def died(text: Column, g: Column) -> Column:
    return F.when(g.isNotNull(), F.struct(g[0].alias("name"), g[1].alias("guid"), guid_class(g[1]).alias("kind")))


def unit_died(text: Column) -> Column:
    return died(text, died_parts(text))


def combat_state(text: Column) -> Column:
    return F.when(text.contains("PLAYER_REGEN_DISABLED"), "start").when(text.contains("PLAYER_REGEN_ENABLED"), "end")


# ── Events ─────────────────────────────────────────────────────────────────────


def trailer_part(text: Column, word: str) -> Column:
    return F.when(text.contains(f" {word})"), number(F.regexp_extract(text, rf"\((\d+) {word}\)", 1))).otherwise(F.lit(0))


def school(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, rf" ({'|'.join(SCHOOLS)}) damage", 1), F.lit(""))


def damage_parts(text: Column) -> Column:
    """(source, spell, target, amount, form) of a damage line: with a spell, else melee, else periodic, the first that matches."""
    hits = has(text, " hits ", " crits ") & text.contains(" for ")
    return F.coalesce(
        F.when(hits & text.contains(" 's "), captures(text, DAMAGE_SPELL, "$1|$2|$3|$4|")),
        F.when(hits, named_captures(text, DAMAGE_MELEE, "$1|Auto Attack|$2|$3|")),
        F.when(text.contains(" suffers "), captures(text, DAMAGE_TICK, "$3|$4|$1|$2|dot")),
    )


def damage(text: Column, g: Column) -> Column:
    amount = number(g[3])
    absorbed, resisted, blocked = (trailer_part(text, w) for w in ("absorbed", "resisted", "blocked"))
    spell = F.trim(g[1])
    return F.when(
        g.isNotNull(),
        F.struct(
            g[0].alias("source"), F.trim(g[2]).alias("target"), F.when(g[4] == "dot", F.concat(spell, F.lit(" (dot)"))).otherwise(spell).alias("spell"), amount.alias("amount"),
            absorbed.alias("absorbed"), resisted.alias("resisted"), blocked.alias("blocked"),
            has(text, " crits ", " critically ").alias("is_crit"), text.contains("(glancing)").alias("is_glancing"), text.contains("(crushing)").alias("is_crushing"),
            school(text).alias("school"), text.contains("(pet)").alias("is_pet_spell"),
            ((amount == 0) & (resisted > 0)).alias("is_fully_resisted"), ((amount == 0) & (absorbed > 0)).alias("is_fully_absorbed"),
            ((amount == 0) & (blocked > 0)).alias("is_fully_blocked"),
        ),
    )


def heal_parts(text: Column) -> Column:
    """(source, spell, target, amount, form) of a healing line: direct, else periodic."""
    return F.coalesce(
        F.when(text.contains("heals "), captures(text, HEAL_DIRECT, "$1|$2|$3|$4|")), F.when(text.contains(" health from "), named_captures(text, HEAL_TICK, "$3|$4|$1|$2|hot"))
    )


def heal(text: Column, g: Column) -> Column:
    """A healing line (the suffix ' (hot)' of periodic ones is added after the rank; they are never crits)."""
    tick = g[4] == "hot"
    spell = F.when(tick, F.trim(g[1])).otherwise(F.trim(F.regexp_replace(F.trim(g[1]), " critically$", "")))
    return F.when(
        g.isNotNull(),
        F.struct(
            g[0].alias("source"), F.when(tick, g[2]).otherwise(F.trim(g[2])).alias("target"), spell.alias("spell"), number(g[3]).alias("amount"),
            (text.contains("critically heals") & ~tick).alias("is_crit"), tick.alias("is_tick"),
        ),
    )


def cast_parts(text: Column) -> Column:
    """(kind, source, spell, target) of a Dispel, Resurrect or Interrupt: the first list of which a spell stands anywhere in the line
    decides."""
    listed = lambda spells: text.rlike("|".join(spells))
    begins = text.contains("begins to cast")
    kind = F.when(listed(DISPELS), "Dispel").when(listed(RESURRECTS) & ~begins & ~text.contains("fails casting"), "Resurrect").when(listed(INTERRUPTS) & ~begins, "Interrupt")
    made = lambda k: F.when(kind == k, captures(text, CAST, f"{k}|$1|$2|$3"))
    return F.when(text.contains("casts "), F.coalesce(made("Dispel"), made("Resurrect"), made("Interrupt")))


def cast_event(text: Column, g: Column) -> Column:
    return F.when(g.isNotNull(), F.struct(g[0].alias("kind"), g[1].alias("source"), F.trim(g[2]).alias("spell"), F.trim(g[3]).alias("target")))


def rank_parts(text: Column) -> Column:
    return F.when(text.contains("CAST:") & text.contains("Rank "), named_captures(text, CAST_RANK, "$1|$2|$3"))


def cast_rank(text: Column, g: Column) -> Column:
    return F.when(g.isNotNull(), F.struct(g[0].alias("source"), g[1].alias("spell"), number(g[2]).cast("int").alias("rank")))


def aura_parts(text: Column) -> Column:
    """(kind, player, name, stacks): gains before fades before afflictions."""
    return F.coalesce(
        F.when(text.contains(" gains "), captures(text, AURA_GAIN, "AuraGain|$1|$2|$3")),
        F.when(text.contains(" fades from "), captures(text, AURA_FADE, "AuraFade|$2|$1|")),
        F.when(text.contains(" is afflicted by "), captures(text, AFFLICTED, "AuraGain|$1|$2|$3")),
    )


def aura(text: Column, g: Column) -> Column:
    """AuraGain or AuraFade (an affliction is a gain; one stack unless told)."""
    stacks = F.when(g[0] == "AuraGain", F.coalesce(g[3].try_cast("int"), F.lit(1)))
    return F.when(g.isNotNull(), F.struct(g[0].alias("kind"), g[1].alias("source"), F.trim(g[2]).alias("spell"), stacks.alias("stacks")))


def avoidance_parts(text: Column) -> Column:
    forms = ((" dodges.", DODGE, "dodge"), (" parries.", PARRY, "parry"), (" misses ", MISS, "miss"))
    return F.coalesce(*[F.when(text.contains(word), captures(text, p, f"{kind}|$1|$2")) for word, p, kind in forms])


def avoidance(text: Column, g: Column) -> Column:
    return F.when(g.isNotNull(), F.struct(g[0].alias("kind"), F.trim(g[1]).alias("attacker"), g[2].alias("defender")))


def consumable_parts(text: Column) -> Column:
    return F.when(text.contains(" uses ") & ~text.contains("CAST:"), captures(text, CONSUMABLE, "$1|$2"))


def consumable(text: Column, g: Column) -> Column:
    return F.when(g.isNotNull(), F.struct(g[0].alias("source"), F.trim(g[1]).alias("item")))


def pet_parts(text: Column) -> Column:
    return F.when(text.contains("("), captures(text, PET_OWNER, "$1|$2"))


def pet_owner(text: Column, g: Column) -> Column:
    return F.when(g.isNotNull(), F.struct(g[0].alias("pet"), g[1].alias("owner")))


def item_quality(colour: Column) -> Column:
    out = F.lit(1)
    for code, rank, _ in QUALITIES:
        out = F.when(colour == code, rank).otherwise(out)
    return out.cast("int")


def quality_label(quality: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x[2]) for x in QUALITIES]), quality + 1)


def loot_parts(text: Column) -> Column:
    return F.when(text.contains("LOOT:"), captures(text, LOOT, "$1|$2|$3|$4|$5"))


def loot(text: Column, g: Column) -> Column:
    return F.when(
        g.isNotNull(),
        F.struct(g[0].alias("player"), number(g[2]).alias("item_id"), g[3].alias("item_name"), item_quality(g[1]).alias("quality"), number(g[4]).alias("quantity")),
    )


def trade_parts(text: Column) -> Column:
    return F.when(text.contains("LOOT_TRADE:"), captures(text, TRADE, "$1|$2|$3"))


def trade(text: Column, g: Column) -> Column:
    return F.when(g.isNotNull(), F.struct(g[0].alias("from_player"), F.trim(g[1]).alias("item_name"), g[2].alias("to_player")))


def dispatch(text: Column) -> Column:
    """Class of a line: metadata, loot, combat and died exclude all others; the rest are event lines."""
    return (
        F.when(has(text, "COMBATANT_INFO:", "ZONE_INFO:", "PLAYERS_IN_COMBAT:"), "metadata")
        .when(has(text, "LOOT:", "LOOT_TRADE:"), "loot")
        .when(has(text, "PLAYER_REGEN_DISABLED", "PLAYER_REGEN_ENABLED"), "combat")
        .when(text.contains("UNIT_DIED:"), "died")
        .otherwise("event")
    )


#: Families by class of line: what the line must hold (for lines that can be passed over), its groups, and the column made of them.
#: Without groups a column is made of the text.
_FAMILIES = {
    "zone": ("metadata", ("ZONE_INFO:",), None, zone), "roster": ("metadata", ("COMBATANT_INFO:",), roster_parts, roster), "year": ("metadata", ("COMBATANT_INFO:",), None, year),
    "recorder": ("metadata", ("COMBATANT_INFO:",), None, recorder), "raid_size": ("metadata", ("PLAYERS_IN_COMBAT:",), None, raid_size),
    "loot": ("loot", ("LOOT:",), loot_parts, loot), "trade": ("loot", ("LOOT_TRADE:",), trade_parts, trade),
    "combat": ("combat", ("PLAYER_REGEN_",), None, combat_state), "died": ("died", ("UNIT_DIED:",), died_parts, died),
    "cast": ("event", ("casts ",), cast_parts, cast_event), "rank": ("event", ("CAST:",), rank_parts, cast_rank), "pet": ("event", ("(",), pet_parts, pet_owner),
    "damage": ("event", (" hits ", " crits ", " suffers "), damage_parts, damage), "heal": ("event", ("heals ", " health from "), heal_parts, heal),
    "aura": ("event", (" gains ", " fades from ", " is afflicted by "), aura_parts, aura),
    "avoidance": ("event", (" dodges.", " parries.", " misses "), avoidance_parts, avoidance), "consumable": ("event", (" uses ",), consumable_parts, consumable),
}


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, worked out once for each row however often they are used: a generator stands behind them."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(made)).alias("_made")).select(*df.columns, *[F.col(f"_made.{n}").alias(n) for n in columns])


def decode(lines: DataFrame, families: tuple[str, ...] | None = None) -> DataFrame:
    """lines(log_id, session_id, seq, text) with ts, class and a struct column for each event family, null where it doesn't apply.

    Lines without a time are dropped. With families, only these are decoded, and lines that hold none of their words are dropped
    before. Write the result once and let the later steps read it if it feeds several: this is the expensive pass.
    """
    asked = [n for n in _FAMILIES if families is None or n in families]
    if families is not None and len(asked) < len(set(families)):
        raise ValueError(f"no such family: {sorted(set(families) - set(_FAMILIES))}")
    others = [c for c in lines.columns if c != "text"]
    rows = lines.select(*[F.col(f"`{c}`") for c in others], F.trim("text").alias("text"))
    t, c = F.col("text"), F.col("class")
    if families is not None:
        rows = rows.where(has(t, *dict.fromkeys(w for n in asked for w in _FAMILIES[n][1])))
    rows = held(rows, _clock=clock_parts(t), **{"class": dispatch(t)}).where("_clock is not null")
    for n in asked:
        # a generator each, as the JVM compiles short methods only: all families in one would be interpreted
        if _FAMILIES[n][2] is not None:
            rows = held(rows, **{f"_{n}": F.when(c == _FAMILIES[n][0], _FAMILIES[n][2](t))})
    made = [(f(t, F.col(f"_{n}")) if parts else F.when(c == k, f(t))).alias(n) for n in asked for k, _, parts, f in [_FAMILIES[n]]]
    return rows.select(*[F.col(f"`{c}`") for c in others], "text", seconds(F.col("_clock")).alias("ts"), "class", *made).where("ts is not null")
