"""Rewriting of raw lines before decoding: first and second person to names, pets to owners, possessives to one form.

lines: (log_id, session_id, seq, text). Each group of rules is a CASE expression in which the first rule that matches rewrites
the line; a keyword test guards every pattern. What depends on other lines (who records, who owns which pet, which spells
pets cast) is found by aggregations over the few lines that say so and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decode as D
from ..sources.scratch import cut
from . import kernels as K
from .entries import KEY

# The game's names and the grammar of its log.
APOSTROPHES = (
    ("Onyxia's Elite Guard", "Onyxias Elite Guard"),
    ("Sartura's Royal Guard", "Sarturas Royal Guard"),
    ("Medivh's Merlot Blue Label", "Medivhs Merlot Blue Label"),
    ("Ima'ghaol, Herald of Desolation", "Imaghaol, Herald of Desolation"),
)
SUMMONED = (
    "Greater Feral Spirit", "Battle Chicken", "Arcanite Dragonling", "The Lost", "Minor Arcane Elemental", "Scytheclaw Pureborn",
    "Explosive Trap I", "Explosive Trap II", "Explosive Trap III", "Sproutling", "Spirit Protector",
)
NOT_PETS = ("Razorgore the Untamed (", "Deathknight Understudy (", "Naxxramas Worshipper (")
PET_SPELLS = (
    "Bite", "Claw", "Screech", "Savage Rend", "Growl", "Dash", "Dive", "Boar Charge", "Lightning Breath", "Scorpid Poison", "Fire Shield",
    "Furious Howl", "Gore", "Firebolt", "Lash of Pain", "Torment", "Cleave", "Soothing Kiss", "Blood Pact", "Phase Shift", "Explosive Trap Effect",
)
PET_CAST = r"CAST:\s*({who})\s+(?:casts|begins to cast|fails casting)\s+([A-Za-z][A-Za-z '\-]+?)(?:\(\d+\))++"
SUMMONER = r"([,a-zA-ZÀ-ſ][,a-zA-ZÀ-ſ ]+[,a-zA-ZÀ-ſ]) \(([,a-zA-ZÀ-ſ]+)\)"


@dataclass(frozen=True)
class Rule:
    """A rewrite; {me} in the new text is the recording player. Without a pattern, the keyword itself is replaced."""

    keyword: str
    new: str
    pattern: str | None = None


# Fixed values, all rules down to _SELF_HIT: sentences of the log, in the order in which they must be tried.
#: The first that matches rewrites the line. Rules for failed casts need a line end inside the text and never apply
#: to split lines, so they aren't listed.
YOU = (
    Rule("suffer", " {me} suffers $1 from {me} (self damage) 's", r" You suffer (.*?) from your"),
    Rule("hits you for", " {me} (self damage) 's $1 hits {me} for", r" Your (.*?) hits you for"),
    Rule("parried by", " {me} 's $1 was parried by", r" Your (.*?) is parried by"),
    Rule("failed", " {me} 's $1 fails", r" Your (.*?) failed"),
    Rule("You are immune", " fails. {me} is immune", r" failed\. You are immune"),
    Rule("our ", " {me} 's ", r" [Yy]our "),
    Rule("You gain", " {me} gains $1 from $2 's", r" You gain (.*?) from (.*?)'s"),
    Rule("You gain", " {me} gains $1 from {me} 's ", r" You gain (.*?) from "),
    Rule(" You gain", " {me} gains"),
    Rule(" You hit", " {me} hits"),
    Rule(" You crit", " {me} crits"),
    Rule(" You are", " {me} is"),
    Rule(" You suffer", " {me} suffers"),
    Rule(" You lose", " {me} loses"),
    Rule(" You die", " {me} dies"),
    Rule(" You cast", " {me} casts"),
    Rule(" You create", " {me} creates"),
    Rule(" You perform", " {me} performs"),
    Rule(" You interrupt", " {me} interrupts"),
    Rule(" You miss", " {me} misses"),
    Rule(" You attack", " {me} attacks"),
    Rule(" You block", " {me} blocks"),
    Rule(" You parry", " {me} parries"),
    Rule(" You dodge", " {me} dodges"),
    Rule(" You resist", " {me} resists"),
    Rule(" You absorb", " {me} absorbs"),
    Rule(" You reflect", " {me} reflects"),
    Rule(" You receive", " {me} receives"),
    Rule("&You receive", "&{me} receives"),
    Rule("&You", "&{me}"),
    Rule(" You deflect", " {me} deflects"),
    Rule("was dodged.", "was dodged by {me}."),
    Rule("causes you", "causes {me}"),
    Rule("heals you", "heals {me}"),
    Rule("hits you for", "hits {me} for"),
    Rule("crits you for", "crits {me} for"),
    Rule("You have slain", " $1 is slain by {me}.", r" You have slain (.*?)!"),
    Rule("you.", "$1 {me}.", r"(\S)\syou\."),
    Rule(" You fall and lose", " {me} falls and loses"),
)
PET = (
    Rule("(", "  $2's Auto Attack (pet) $3", r"(?i)  ([,a-zA-ZÀ-ſ][,a-zA-ZÀ-ſ ]+[,a-zA-ZÀ-ſ]) \(([,a-zA-ZÀ-ſ]+)\) (hits|crits|misses)"),
    Rule("(", "  $2's $1 ($2) is dismissed.", r"(?i)  Your ([,a-zA-ZÀ-ſ][,a-zA-ZÀ-ſ ]+[,a-zA-ZÀ-ſ]) \(([,a-zA-ZÀ-ſ]+)\) is dismissed\."),
    Rule("(", "  $2 's Arcane Missiles (pet)", r"(?i)  ([,a-zA-ZÀ-ſ][,a-zA-ZÀ-ſ ]+[,a-zA-ZÀ-ſ]) \(([,a-zA-ZÀ-ſ]+)\)('s| 's) Arcane Missiles"),
    Rule("(", "  $2 's", r"(?i)  ([,a-zA-ZÀ-ſ][,a-zA-ZÀ-ſ ]+[,a-zA-ZÀ-ſ]) \(([,a-zA-ZÀ-ſ]+)\)('s| 's)"),
    Rule("(", "from $2$3", r"(?i)from ([,a-zA-ZÀ-ſ][,a-zA-ZÀ-ſ ]+[,a-zA-ZÀ-ſ]) \(([,a-zA-ZÀ-ſ]+)\)('s| 's)"),
)
#: The first three leave the line as it is, so that a possessive in a buff's name stays.
POSSESSIVE = (
    Rule(" fades from ", "$0", r"(?i) fades from .*\."),
    Rule(" gains ", "$0", r"(?i) gains .*\)\."),
    Rule(" is afflicted by ", "$0", r"(?i) is afflicted by .*\)\."),
    Rule("'s ", "  $1 's $2", r"(?i)  ([,a-zA-ZÀ-ſ'\- ]*?\S)'s ([A-Z])"),
    Rule("'s ", "from $1 's $2", r"(?i)from ([,a-zA-ZÀ-ſ'\- ]*?\S)'s ([A-Z])"),
    Rule("is immune to", "is immune to $1 's $2", r"(?i)is immune to ([,a-zA-ZÀ-ſ'\- ]*?\S)'s ([A-Z])"),
    Rule(")'s ", ") 's $1", r"(?i)\)'s ([A-Z])"),
)
RENAMES = (
    Rule("Totem", "  $1 's", r"(?i)  [A-Z][,a-zA-ZÀ-ſ ]* Totem [IVX]+ \((.*?)\) 's"),
    Rule("Totem", " from $1 's", r"(?i) from [A-Z][,a-zA-ZÀ-ſ ]* Totem [IVX]+ \((.*?)\) 's"),
    Rule("Lightning", "Lightning Strike (nature) was resisted", r"(?i)Lightning Strike was resisted"),
    Rule("Lightning", "Lightning Strike (nature) $1 Nature damage", r"(?i)Lightning Strike (.*) Nature damage"),
    Rule("Onyxias", "Onyxia's Elite Guard", r"(?i)Onyxias Elite Guard"),
    Rule("Sarturas", "Sartura's Royal Guard", r"(?i)Sarturas Royal Guard"),
)
FRIENDLY_FIRE = (Rule("Power Overwhelming", "from $1 (self damage) 's Power Overwhelming", r"(?i)from ([,a-zA-ZÀ-ſ]*?) 's Power Overwhelming"),)
_SELF_TICK = r"(?i)  ([,a-zA-ZÀ-ſ' ]*?) suffers (.*) (damage) from ([,a-zA-ZÀ-ſ' ]*?) 's"
_SELF_HIT = r"(?i)  ([,a-zA-ZÀ-ſ' ]*?) 's (.*) (hits|crits) ([,a-zA-ZÀ-ſ' ]*?) for"


def first_match(text: Column, rules: Sequence[Rule], me: Column | None = None) -> Column:
    """The line after the first rule that matches; unchanged if none does."""
    out = None
    for r in rules:
        parts = r.new.split("{me}")
        new = F.lit(r.new)
        if me is not None and len(parts) > 1:
            bits = [x for k, p in enumerate(parts) for x in ((F.lit(p), me) if k < len(parts) - 1 else (F.lit(p),))]
            new = F.concat(*bits)
        hit = text.contains(r.keyword)
        if r.pattern is None:
            changed = F.replace(text, F.lit(r.keyword), new)
        else:
            hit = hit & text.rlike(r.pattern)
            changed = F.regexp_replace(text, F.lit(r.pattern), new)
        out = F.when(hit, changed) if out is None else out.when(hit, changed)
    return out.otherwise(text)


def capitalize(name: Column) -> Column:
    return F.concat(F.upper(F.substring(F.trim(name), 1, 1)), F.lower(F.substring(F.trim(name), 2, 1_000_000)))


def collapse_possessive(text: Column) -> Column:
    """No space before 's."""
    return F.when(text.contains(" 's"), F.regexp_replace(text, " +'s", "'s")).otherwise(text)


def add_quantity(text: Column) -> Column:
    """Loot without a quantity is one item."""
    return F.when(text.contains("LOOT:") & text.endswith("|h|r."), F.concat(F.substr(text, F.lit(1), F.length(text) - 1), F.lit("x1."))).otherwise(text)


def _pet_field(text: Column) -> Column:
    """The pet of a roster line, or null for none and for creatures that aren't pets."""
    parts = F.split(text, "&")
    pet = F.get(parts, F.lit(5))
    odd = F.lit(False)
    for n in NOT_PETS:
        odd = odd | pet.startswith(n)
    return F.when(text.contains("COMBATANT_INFO") & (F.size(parts) > 5) & (pet != "nil") & ~odd, pet)


def clean_roster(text: Column) -> Column:
    """Roster lines: a creature that isn't a pet becomes nil; a pet with its owner's name gets the suffix Pet."""
    parts, pet = F.split(text, "&"), _pet_field(text)
    new = F.when(pet.isNull(), F.lit("nil")).when(pet == parts[1], F.concat(pet, F.lit("Pet"))).otherwise(pet)
    fixed = F.array_join(F.transform(parts, lambda x, i: F.when(i == 5, new).otherwise(x)), "&")
    return F.when(text.contains("COMBATANT_INFO") & (F.size(parts) > 5), fixed).otherwise(text)


def first_pass(lines: DataFrame) -> DataFrame:
    return lines.withColumn("text", collapse_possessive(F.col("text"))).withColumn("text", add_quantity(clean_roster(F.col("text"))))


def owners(cleaned: DataFrame) -> DataFrame:
    """Owners of pets: (keys, owner, pets, spells, renamed). spells are what their pets cast once known, and Auto Attack; without
    any such cast, the fixed list. renamed tells pets that had their owner's name."""
    pets = cleaned.withColumn("pet", _pet_field(F.col("text"))).where("pet is not null").select(*KEY, "seq", F.split("text", "&")[1].alias("owner"), "pet")
    first = pets.groupBy(*KEY, "pet").agg(F.min("seq").alias("since"))
    g = D.named_captures(F.col("text"), PET_CAST, "$1|$2")
    casts = cleaned.where(F.col("text").contains("CAST:") & ~F.col("text").contains("LOOT:") & ~F.col("text").contains("COMBATANT_INFO")).select(*KEY, "seq", g.alias("g")).where("g is not null")
    casts = casts.select(*KEY, "seq", F.col("g")[0].alias("pet"), F.trim(F.col("g")[1]).alias("spell"))
    known = casts.join(first, [*KEY, "pet"]).where("seq > since and spell <> ''").groupBy(*KEY, "pet").agg(F.collect_set("spell").alias("cast"))
    return (
        pets.select(*KEY, "owner", "pet").distinct().join(known, [*KEY, "pet"], "left").groupBy(*KEY, "owner")
        .agg(F.collect_set("pet").alias("pets"), F.flatten(F.collect_list("cast")).alias("_cast"), F.bool_or(F.col("pet") == F.concat("owner", F.lit("Pet"))).alias("renamed"))
        .withColumn("spells", F.array_union(F.array(F.lit("Auto Attack")), F.when(F.size("_cast") > 0, F.array_distinct("_cast")).otherwise(F.array(*[F.lit(s) for s in PET_SPELLS]))))
        .drop("_cast")
    )


def summoners(cleaned: DataFrame) -> DataFrame:
    """Owners of summoned creatures, named in brackets: (keys, owner)."""
    g = D.captures(F.col("text"), SUMMONER, "$1|$2")
    named = F.lit(False)
    for n in SUMMONED:
        named = named | F.col("text").contains(n)
    s = cleaned.where(named & ~F.col("text").contains("COMBATANT_INFO") & ~F.col("text").contains("LOOT:"))
    return s.select(*KEY, g[1].alias("owner")).where("owner is not null").distinct()


def recorders(lines: DataFrame) -> DataFrame:
    """Roster lines with talents: (keys, seq, clock, me)."""
    clock = F.regexp_extract("text", D.CLOCK, 0)
    me = lines.where(F.col("text").contains("COMBATANT_INFO")).select(*KEY, "seq", clock.alias("clock"), D.recorder(F.col("text")).alias("me"))
    return me.where("me is not null and clock <> ''")


def recording_player(lines: DataFrame, strict: bool = False, facts: DataFrame | None = None) -> DataFrame:
    """Adds me: the player of the last roster line with talents at or before each line, else of the first one; and facts, a row for
    each session, by the same join.

    Lines go by number; strict compares the text of their times instead, as the log's first reader did.
    """
    me = recorders(lines)
    first = me.groupBy(*KEY).agg(F.min_by("me", "seq").alias("_first"))
    facts = first if facts is None else first.join(facts, KEY, "full_outer")
    if strict:
        # both in one order by the text of the time, dealt by ranges of it; lines come after what is said at the same time
        clock = F.regexp_extract("text", D.CLOCK, 0)
        said = me.select(*KEY, F.col("clock").alias("_clock"), F.lit(0).alias("_side"), F.col("seq").alias("_at"), F.col("me").alias("_me"))
        marked = lines.select("*", clock.alias("_clock"), F.lit(1).alias("_side"), F.col("seq").alias("_at")).unionByName(said, allowMissingColumns=True)
        out = K.asof_last_ranged(marked, KEY, ["_clock", "_side", "_at"], F.col("_me"), "_last").where("_side = 1").drop("_clock", "_side", "_at", "_me")
        out = K.attach(out, facts, KEY, "left")
    else:
        # stretches between such lines, joined by block: no window over all lines of a session
        spans = K.stretches(me.select(*KEY, "seq", F.col("me").alias("_last")), lines, KEY, ["_last"])
        out = K.along(lines, spans.join(facts, KEY, "left"), KEY)
    return out.withColumn("me", capitalize(F.coalesce("_last", "_first"))).drop("_last", "_first")


def _self_damage(text: Column) -> Column:
    """A name that damages itself is tagged."""
    same = lambda p: F.trim(F.regexp_extract(text, p, 1)) == F.trim(F.regexp_extract(text, p, 4))
    return F.when(
        text.contains(" 's "),
        F.when(text.rlike(_SELF_TICK) & same(_SELF_TICK), F.regexp_replace(text, _SELF_TICK, "  $1 suffers $2 damage from $4 (self damage) 's"))
        .when(text.rlike(_SELF_HIT) & same(_SELF_HIT), F.regexp_replace(text, _SELF_HIT, "  $1 (self damage) 's $2 $3 $4 for")).otherwise(text),
    ).otherwise(text)


def spell_name(text: Column) -> Column:
    """What stands before the first verb or full stop."""
    return F.trim(F.regexp_extract(text, r"^(.*?)(?: hits | crits | misses | was | fails | missed | is |\.|$)", 1))


def tag_pet_spells(text: Column, spells: Column) -> Column:
    """Marks what pets did with (pet) before the spell, if the owner's pets have that spell. spells: map of owner to spells."""
    first, second = r"^(?>.*?  )", r"^(?>.*?from )"
    owner = lambda marker: F.regexp_extract(text, marker + r"(\S+) 's (.*)$", 1)
    spell = lambda marker: spell_name(F.regexp_extract(text, marker + r"\S+ 's (.*)$", 1))
    has = lambda marker: F.coalesce(F.array_contains(F.try_element_at(spells, owner(marker)), spell(marker)), F.lit(False))
    tagged = lambda marker: F.regexp_replace(text, "(" + marker + r"\S+ 's )", "$1(pet) ")
    return (
        F.when(spells.isNull() | ~text.contains(" 's ") | text.contains(" 's (pet) "), text)
        .when(text.contains("Auto Attack (pet)"), F.replace(text, F.lit("Auto Attack (pet)"), F.lit("(pet) Auto Attack")))
        .when(text.contains("Arcane Missiles (pet)"), F.replace(text, F.lit("Arcane Missiles (pet)"), F.lit("(pet) Arcane Missiles")))
        .when(has(first), tagged(first)).when(has(second), tagged(second)).otherwise(text)
    )


def _step(rows: DataFrame, text: Column) -> DataFrame:
    """rows with a new text, behind a generator: it is worked out once, and no later filter is pushed through the rules."""
    return rows.withColumn("_text", F.explode(F.array(text))).drop("text").withColumnRenamed("_text", "text")


def normalise(lines: DataFrame, strict: bool = False) -> DataFrame:
    """All rewriting steps in their order. Owners, pets and recorders come by one join on blocks of lines."""
    t = F.col("text")
    cleaned = cut(first_pass(lines))  # read five times below
    pet_owners = cut(owners(cleaned))  # a few rows, used three times
    names = pet_owners.select(*KEY, "owner").unionByName(summoners(cleaned)).distinct().groupBy(*KEY).agg(F.collect_set(F.concat(F.lit("("), "owner", F.lit(")"))).alias("_owners"))
    names = cut(names)
    renamed = pet_owners.where("renamed").groupBy(*KEY).agg(F.collect_set("owner").alias("_renamed"))
    spells = pet_owners.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("owner", "spells"))).alias("_spells"))
    # a row for each session; all joins come before the rewriting of texts
    out = recording_player(cleaned, strict, names.join(renamed, KEY, "full_outer").join(spells, KEY, "full_outer"))

    fixed = None
    for a, b in APOSTROPHES:
        fixed = F.when(t.contains(a), F.replace(t, F.lit(a), F.lit(b))) if fixed is None else fixed.when(t.contains(a), F.replace(t, F.lit(a), F.lit(b)))
    out = _step(out, F.when(t.contains("'"), fixed.otherwise(t)).otherwise(t))
    same_name = F.aggregate("_renamed", t, lambda acc, n: F.replace(acc, F.concat(n, F.lit(" ("), n, F.lit(")")), F.concat(n, F.lit("Pet ("), n, F.lit(")"))))
    out = _step(out, F.when(t.contains("(") & F.col("_renamed").isNotNull(), same_name).otherwise(t))
    owned = t.contains("(") & F.coalesce(F.exists("_owners", lambda o: t.contains(o)), F.lit(False)) & ~D.has(t, "dies.", "is killed by", *NOT_PETS)
    out = _step(out, F.when(owned, first_match(t, PET)).otherwise(t))
    for _ in range(2):  # a line may name the recorder on both sides
        mine = F.col("me").isNotNull() & D.has(t, "you", "You", "dodged.")
        out = _step(out, F.when(mine, first_match(t, YOU, F.col("me"))).otherwise(t))
    out = _step(out, F.when(D.has(t, "'", " fades from ", " gains ", " is afflicted by "), first_match(t, POSSESSIVE)).otherwise(t))
    out = _step(out, F.when(D.has(t, "Totem ", "Lightning Strike", "Onyxias", "Sarturas"), first_match(t, RENAMES)).otherwise(t))
    out = _step(out, F.when(t.contains("Power Overwhelming"), first_match(t, FRIENDLY_FIRE)).otherwise(t))
    out = _step(out, _self_damage(t))
    return _step(out, tag_pet_spells(t, F.col("_spells"))).select(*lines.columns)
