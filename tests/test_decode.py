import tempfile

from minilog import at, lines, npcs, roster, zones
from pyspark.sql import functions as F

from skeinlog.functions import decode as D
from skeinlog.operators import aggregates, encounters, entries, lookups
from skeinlog.sources import logs


def decoded(spark, *texts):
    return D.decode(lines(spark, *texts))


def one(spark, payload, column):
    return decoded(spark, at(0, payload)).select(f"{column}.*").collect()


def test_clock_and_dropped_lines(spark):
    d = decoded(spark, at(1.5, "x"), "no time at all", "1/2", "", "1/27 9:5:7.5  x").collect()
    assert [r.seq for r in d] == [0, 4]
    assert d[0].ts == (31 + 27) * 86400 + 20 * 3600 + 1.5
    assert d[1].ts == (31 + 27) * 86400 + 9 * 3600 + 5 * 60 + 7 + 5 / 1000


def test_damage_forms(spark):
    (r,) = one(spark, "Ann 's Holy Shield hits Bog Guard for 108 Holy damage. (20 absorbed) (5 resisted)", "damage")
    assert (r.source, r.spell, r.target, r.amount, r.absorbed, r.resisted, r.blocked, r.school, r.is_crit) == ("Ann", "Holy Shield", "Bog Guard", 108, 20, 5, 0, "Holy", False)
    (r,) = one(spark, "Ann crits Bog Guard for 515. (glancing)", "damage")
    assert (r.source, r.spell, r.amount, r.is_crit, r.is_glancing) == ("Ann", "Auto Attack", 515, True, True)
    (r,) = one(spark, "Boss suffers 101 Physical damage from Hunter 's Savage Rend.", "damage")
    assert (r.source, r.target, r.spell, r.amount) == ("Hunter", "Boss", "Savage Rend (dot)", 101)
    (r,) = one(spark, "Hunter 's (pet) Bite hits Boss for 50.", "damage")
    assert (r.spell, r.is_pet_spell) == ("Bite", True)
    (r,) = one(spark, "Kel'Thuzad hits Ann for 5.", "damage")
    assert r.source == "Thuzad"
    (r,) = one(spark, "Boss hits Ann for 0. (300 blocked)", "damage")
    assert r.is_fully_blocked and not r.is_fully_absorbed
    assert decoded(spark, at(0, "Ann hits Boss for 5 Fire damage.")).where("damage is not null").count() == 0


def test_heals_casts_auras(spark):
    (r,) = one(spark, "Ann 's Mending Light critically heals Bob for 77.", "heal")
    assert (r.source, r.spell, r.target, r.amount, r.is_crit) == ("Ann", "Mending Light", "Bob", 77, True)
    (r,) = one(spark, "Bob gains 148 health from Ann 's Rejuvenation.", "heal")
    assert (r.source, r.spell, r.target, r.amount, r.is_tick) == ("Ann", "Rejuvenation", "Bob", 148, True)
    (r,) = one(spark, "Ann casts Cleanse on Bob.", "cast")
    assert (r.kind, r.source, r.spell, r.target) == ("Dispel", "Ann", "Cleanse", "Bob")
    (r,) = one(spark, "CAST: Ann casts Regrowth(8910)(Rank 4) on Bob.", "rank")
    assert (r.source, r.spell, r["rank"]) == ("Ann", "Regrowth", 4)
    (r,) = one(spark, "Ann gains Power Word: Fortitude (2).", "aura")
    assert (r.kind, r.source, r.spell, r.stacks) == ("AuraGain", "Ann", "Power Word: Fortitude", 2)
    (r,) = one(spark, "Power Word: Fortitude fades from Ann.", "aura")
    assert (r.kind, r.source, r.spell) == ("AuraFade", "Ann", "Power Word: Fortitude")
    (r,) = one(spark, "Ann is afflicted by Arcane Overload.", "aura")
    assert (r.kind, r.spell, r.stacks) == ("AuraGain", "Arcane Overload", 1)
    (r,) = one(spark, "Bog Guard attacks. Ann dodges.", "avoidance")
    assert (r.kind, r.attacker, r.defender) == ("dodge", "Bog Guard", "Ann")


def test_metadata(spark):
    (r,) = one(spark, roster("Ann", pet="Rex", you=True), "roster")
    assert (r["name"], r["class"], r.pet_name, r.guild, r.talents, len(r.gear), r.gear[0].item_id, r.gear[1]) == ("Ann", "WARRIOR", "Rex", "Guild", "3/3/0", 19, 47354, None)
    (r,) = one(spark, "COMBATANT_INFO: 27.01.26 20:00:00&Bob&MAGE", "roster")
    assert (r["name"], r["class"], r.gear) == ("Bob", "MAGE", None)
    d = decoded(spark, at(0, "ZONE_INFO: 1&Bog Keep&0"), at(0, roster("Ann", you=True)), at(0, "UNIT_DIED:Mire Lord:0xF1300036C4014F18"), at(0, "PLAYERS_IN_COMBAT: 32/40")).collect()
    assert d[0].zone == "Bog Keep" and d[1].year == 2026 and d[1].recorder == "Ann"
    assert (d[2].died["name"], d[2].died.kind) == ("Mire Lord", "npc") and d[3].raid_size.active == 32


def test_loot_trade_consumable(spark):
    (r,) = one(spark, "LOOT: 27.01.26 20:00:00&Ann receives loot: |cffa335ee|Hitem:123:0:0:0|h[Bog Blade]|h|rx2.", "loot")
    assert (r.player, r.item_id, r.item_name, r.quality, r.quantity) == ("Ann", 123, "Bog Blade", 4, 2)
    (r,) = one(spark, "LOOT_TRADE: 27.01.26 20:00:00&Ann trades item Bog Blade to Bob.", "trade")
    assert (r.from_player, r.item_name, r.to_player) == ("Ann", "Bog Blade", "Bob")
    (r,) = one(spark, "Ann uses Juju Power on Bob.", "consumable")
    assert (r.source, r.item) == ("Ann", "Juju Power")


FIGHT = (
    at(0, roster("Ann")), at(0, roster("Bob", "PRIEST")), at(1, "ZONE_INFO: 1&Bog Keep&0"),
    at(10, "PLAYER_REGEN_DISABLED"),
    at(11, "Ann 's Slam hits Mire Lord for 500."),
    at(12, "Mire Lord hits Ann for 3000."),
    at(13, "CAST: Bob casts Heal(1)(Rank 4) on Ann."),
    at(14, "Bob 's Heal heals Ann for 2800."),
    at(15, "Bob 's Heal heals Ann for 2800."),
    at(16, "Ann casts Pummel on Mire Lord."),
    at(17, "Mire Lord hits Ann for 99."),
    at(18, "UNIT_DIED:Ann:0x0000000000000001"),
    at(20, "UNIT_DIED:Mire Lord:0xF130000000000001"),
    at(25, "PLAYER_REGEN_ENABLED"),
    at(40, "LOOT: x&Bob receives loot: |cffa335ee|Hitem:7:0|h[Bog Blade]|h|rx1."),
    at(50, "LOOT_TRADE: x&Bob trades item Bog Blade to Ann."),
    at(400, "LOOT: x&Bob receives loot: |cff9d9d9d|Hitem:8:0|h[Mud]|h|rx1."),
)


def kept(df):
    return logs.stored(df, tempfile.mkdtemp(prefix="spark-") + "/t")


def parsed(spark, texts):
    d = kept(decoded(spark, *texts))
    players = kept(entries.roster(d))
    return d, players, kept(entries.entries(d, players))


def test_entries_and_deaths(spark):
    d, players, e = parsed(spark, FIGHT)
    heals = [(r.spell, r.effective_heal, r.overheal) for r in e.where("kind = 'Healing'").orderBy("seq").collect()]
    assert heals == [("Heal (Rank 4)", 2800, 0), ("Heal (Rank 4)", 200, 2600)]
    assert e.where("kind = 'Interrupt'").count() == 1
    (k,) = entries.deaths(e).collect()
    assert (k.player, k.killer, k.killing_blow, k.damage_amount) == ("Ann", "Mire Lord", "Auto Attack", 99)
    done, taken, healed = aggregates.damage_done(e), aggregates.damage_taken(e), aggregates.healing_done(e)
    totals = {r.player: r for r in aggregates.player_totals(done, taken, healed).collect()}
    assert totals["Ann"].damage == 500 and totals["Ann"].damage_taken == 3099 and totals["Bob"].effective == 3000 and totals["Bob"].overheal == 2600


def test_encounters_and_loot(spark):
    d, players, e = parsed(spark, FIGHT)
    marks = entries.combat_marks(d)
    enc = encounters.encounters(d, e, marks, players, npcs(spark), zones(spark))
    (r,) = enc.collect()
    assert (r["name"], r.is_boss, r.is_kill, r.player_deaths, r.attempt, r.duration) == ("Mire Lord", True, True, 1, 1, 15.0)
    loot = encounters.with_trades(encounters.attribute_loot(entries.loot_events(d), enc), entries.trade_events(d)).orderBy("seq").collect()
    assert [(x.item_name, x.boss, x.traded_to) for x in loot] == [("Bog Blade", "Mire Lord", "Ann"), ("Mud", "Trash/Other", None)]


def test_wipe_extension_merge_and_late_kill(spark):
    texts = [at(0, roster("Ann")), at(0, roster("Bob")), at(10, "PLAYER_REGEN_DISABLED"), at(11, "Ann 's Slam hits Mire Lord for 5."), at(18, "UNIT_DIED:Ann:0x0000000000000001"), at(20, "PLAYER_REGEN_ENABLED")]
    texts += [at(20 + k, "Bob 's Slam hits Mire Lord for 5.") for k in range(10, 90, 20)] + [at(200, "Bob 's Slam hits Mire Lord for 5.")]
    d, players, e = parsed(spark, texts)
    marks = entries.combat_marks(d)
    (r,) = encounters.encounters(d, e, marks, players, npcs(spark), zones(spark)).collect()
    assert (r["name"], r.is_kill, r.end - r.start, r.player_deaths, r.active_players, r.is_boss) == ("Mire Lord", False, 80.0, 1, 2, True)

    texts = [at(0, roster("Ann")), at(10, "PLAYER_REGEN_DISABLED"), at(11, "Ann 's Slam hits Left Twin for 5."), at(20, "PLAYER_REGEN_ENABLED"), at(40, "PLAYER_REGEN_DISABLED")]
    texts += [at(41, "Ann 's Slam hits Right Twin for 5."), at(60, "PLAYER_REGEN_ENABLED"), at(100, "UNIT_DIED:Right Twin:0xF130000000000001")]
    d, players, e = parsed(spark, texts)
    (r,) = encounters.encounters(d, e, entries.combat_marks(d), players, npcs(spark), zones(spark)).collect()
    assert (r["name"], r.is_kill, r.start, r.end - r.start) == ("The Twins", True, r.start, 90.0)


def test_boss_named_in_text_only(spark):
    texts = [at(0, roster("Ann")), at(1, "ZONE_INFO: 1&Bog Keep&0"), at(10, "PLAYER_REGEN_DISABLED"), at(12, "Ann 's Frost Bolt was resisted by Mire Lord."), at(20, "PLAYER_REGEN_ENABLED")]
    d, players, e = parsed(spark, texts)
    (r,) = encounters.detect(d, e, entries.combat_marks(d), players, npcs(spark), zones(spark)).collect()
    assert (r["name"], r.is_boss, r.is_kill) == ("Mire Lord", True, False)


def test_pet_damage_is_retroactive(spark):
    hit, tick = "Ann 's (pet) Trap hits Boss for 10.", "Boss suffers 3 Fire damage from Ann 's Trap."
    d, players, e = parsed(spark, [at(0, roster("Ann")), at(1, tick), at(2, hit), at(3, tick)])
    rows = {r.ability: r for r in aggregates.damage_done(e).collect()}
    assert rows["Trap"].pet_total == 10 and rows["Trap (dot)"].pet_total == 6 and rows["Trap (dot)"].is_pet


def test_pet_ticks_split_at_the_tag(spark):
    hit, tick, tagged = "Ann 's (pet) Trap hits Boss for 10.", "Boss suffers 3 Fire damage from Ann 's Trap.", "Boss suffers 5 Fire damage from Ann 's (pet) Trap."
    d, players, e = parsed(spark, [at(0, roster("Ann")), at(1, tick), at(2, tagged), at(3, tick), at(4, hit), at(5, tick), at(6, tick)])
    rows = {r.ability: r for r in aggregates.damage_done(e).collect()}
    assert rows["Trap (dot)"].pet_total == 5 + 6 and rows["Trap (dot)"].total == 17 and rows["Trap (dot)"].is_pet


def test_avoidance_and_gate(spark):
    d, players, e = parsed(spark, [at(0, "Bog attacks. Ann dodges."), at(1, roster("Ann")), at(2, "Bog attacks. Ann dodges."), at(3, "Bog misses Ann."), at(4, "Ann misses Bog."), at(5, "Ann hits Bog for 1.")])
    (r,) = aggregates.avoidance(entries.avoidance_events(d, players), e).collect()
    assert (r.player, r.dodges, r.missed_by, r.misses, r.blocks) == ("Ann", 1, 1, 1, 0)


def test_lookups(spark):
    items = spark.createDataFrame([("Flask of X", 0, "Flasks", False, False), ("Scroll of ", 3, "Scrolls", True, False), ("Toy", None, None, False, True)], "item string, category int, label string, prefix boolean, ignored boolean")
    df = spark.createDataFrame([("Flask of X",), ("Scroll of Y",), ("Toy",), ("Else",)], "i string")
    assert sorted((r.i, r.label) for r in lookups.classify_items(df, "i", items).collect()) == [("Else", None), ("Flask of X", "Flasks"), ("Scroll of Y", "Scrolls")]
    w = spark.createDataFrame([("the knight hits", "knight"), ("necroknight hits", "knight"), ("c'thun!", "c'thun")], "t string, w string")
    assert [r[0] for r in w.select(lookups.contains_word(F.col("t"), F.col("w"))).collect()] == [True, False, True]
    assert spark.range(1).select(lookups.title_case(F.lit("mire lord of McBog"))).first()[0] == "Mire Lord Of McBog"
