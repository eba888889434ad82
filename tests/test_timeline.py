import pytest
from skeinlog.functions import text
from skeinlog.operators import kernels as K
from skeinlog.operators import selection, timeline
from skeinlog.plans import reports
from pyspark.sql import functions as F

ENTRY = "log_id string, session_id int, seq long, sub int, ts double, kind string, source string, target string, spell string, amount long, effective_heal long"
ENC = "log_id string, session_id int, enc_idx int, name string, start double, end double, is_boss boolean, is_kill boolean, attempt int"


def entries(spark, *rows):
    full = [("a", 0, k, 1, float(ts), kind, who, target, spell, amount, amount if kind == "Healing" else None) for k, (ts, kind, who, target, spell, amount) in enumerate(rows)]
    return spark.createDataFrame(full, ENTRY)


def fights(spark, *spans):
    return spark.createDataFrame([("a", 0, k + 1, f"Boss {k}", float(a), float(b), True, k % 2 == 0, 1) for k, (a, b) in enumerate(spans)], ENC)


def aura(ts, gain, who="Ann", name="Might"):
    return (ts, "AuraGain" if gain else "AuraFade", who, None, name, None)


def uptime(spark, spans, *rows, persistent=None):
    got = timeline.buff_uptime(entries(spark, *rows), fights(spark, *spans), persistent).collect()
    return {r.aura: round(r.uptime, 6) for r in got}


def test_uptimes(spark):
    assert uptime(spark, [(100, 200)], aura(110, True), aura(160, False)) == {"Might": 0.5}
    assert uptime(spark, [(100, 200)], aura(50, True), aura(180, False)) == {"Might": 0.8}  # on before the pull
    assert uptime(spark, [(100, 200)], aura(100, True), (130, "Death", "Ann", None, None, None)) == {"Might": 0.3}  # until death
    lasting = spark.createDataFrame([("Might", 0, True)], "buff string, category int, death_persistent boolean")
    assert uptime(spark, [(100, 200)], aura(105, True), (130, "Death", "Ann", None, None, None), persistent=lasting) == {"Might": 0.95}
    assert uptime(spark, [(100, 200), (300, 400)], aura(90, True)) == {"Might": 1.0}
    assert uptime(spark, [(100, 200)], aura(110, True), aura(110, False)) == {"Might": 0.0}
    assert uptime(spark, [(100, 200)], aura(110, True), aura(120, True), aura(130, False), aura(160, False)) == {"Might": 0.5}  # refreshed


def test_interval_union(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 5, 8), (2, 0, 5), (2, 5, 12), (3, 0, 10), (3, 20, 30)], "k int, start int, end int")
    assert {r.k: r.covered for r in K.covered_length(df, ["k"]).collect()} == {1: 10, 2: 12, 3: 20}


def test_buckets_and_events(spark):
    active = spark.createDataFrame([("a", 0, "Ann", "Rex"), ("a", 0, "Bob", None)], "log_id string, session_id int, name string, pet_name string")
    e = entries(
        spark, (100.2, "Damage", "Ann", "Boss", "Slam", 50), (101.5, "Damage", "Boss", "Ann", "Bite", 3000), (102.1, "Healing", "Bob", "Ann", "Heal", 70), (102.2, "Healing", "Bob", "Rex (Ann)", "Heal", 9),
        (102.3, "Healing", "Bob", "Boss", "Heal", 5), (103.0, "Death", "Ann", None, None, None), (104.9, "Resurrect", "Bob", "Ann", "Rebirth", None), (104.95, "Dispel", "Bob", "Ann", "Cleanse", None),
    )
    f = fights(spark, (100, 106))
    rows = timeline.buckets(e, f, active).orderBy("second").collect()
    assert len(rows) == 7
    assert [(r.damage, r.damage_taken, r.healing, r.boss_healing, r.alive) for r in rows][:6] == [(50, 0, 0, 0, 2), (0, 3000, 0, 0, 2), (0, 0, 70, 5, 2), (0, 0, 0, 0, 1), (0, 0, 0, 0, 2), (0, 0, 0, 0, 2)]
    p = timeline.peaks(timeline.buckets(e, f, active)).first()
    assert (p.max_dps, p.max_dtps, p.max_hps, p.max_boss_hps) == (50, 3000, 70, 5)
    labels = [(r.kind, r.label) for r in timeline.point_events(e, f, active).orderBy("seq").collect()]
    assert labels == [("BigHit", "Ann takes 3000 from Boss's Bite"), ("Death", "Ann died"), ("Resurrect", "Bob resurrects Ann"), ("Dispel", "Bob dispels Cleanse on Ann")]


def test_selection(spark):
    f = fights(spark, (100, 110), (200, 210))
    e = entries(spark, *[(t, "Damage", "Ann", "Boss", "Slam", 1) for t in (99, 100, 110, 111, 205)])
    assert selection.in_selection(e, f, "kills").count() == 2 and selection.in_selection(e, f, 2).count() == 1 and selection.in_selection(e, f).count() == 5
    assert selection.duration(f).first().duration == 20
    o = selection.opener(entries(spark, *[(100 + 0.5 * k, "Damage", "Ann", "Boss", "Slam", 1) for k in range(12)]), ["source"], "ts", "seq").collect()
    assert len(o) == 8 and max(r.delay for r in o) == 3.5
    c = {(r.category, r.n) for r in selection.catalogue(f).where("category <> 'single'").collect()}
    assert c == {("all", 2), ("kills", 1), ("wipes", 1)}


def test_reports(spark):
    t = spark.createDataFrame([("a", 0, "Ann", 300, 100), ("a", 0, "Bob", 100, 0), ("a", 0, "Cid", 0, 0)], "log_id string, session_id int, player string, damage long, pet_damage long").withColumn("damage_taken", F.lit(0))
    active = t.select("log_id", "session_id", F.col("player").alias("name"))
    d = spark.createDataFrame([("a", 0, 50.0)], "log_id string, session_id int, duration double")
    rows = reports.shown(reports.damage_meter(t, active, d), "meter").collect()
    assert [(r.player, r["rank"], r.per_second, r.pct, r.bar) for r in rows] == [("Ann", 1, 6.0, 75.0, 0.75), ("Bob", 2, 2.0, 25.0, 0.25)]
    assert [r.value for r in reports.shown(reports.damage_meter(t, active, d, "personal"), "meter").collect()] == [200, 100]
    a = spark.createDataFrame([("a", 0, "Ann", "Slam", 100, 4, 1, 40, 0, False)], "log_id string, session_id int, player string, ability string, total long, hits long, crits long, crit_total long, pet_total long, is_pet boolean")
    r = reports.abilities(a).first()
    assert (r.avg_hit, r.avg_crit, r.crit_pct, r.pct, r.shown) == (20, 40, 25.0, 100.0, "Slam")
    deaths = spark.createDataFrame([("a", 0, 5, 120.0, "Ann")], "log_id string, session_id int, seq long, ts double, player string")
    e = entries(spark, (105, "Damage", "Boss", "Ann", "Bite", 1), (112, "Damage", "Boss", "Ann", "Bite", 1), (119, "Damage", "Boss", "Bob", "Bite", 1), (119, "Healing", "Bob", "Ann", "Heal", 1))
    replay = reports.death_replay(e, deaths, fights(spark, (100, 130)), 10).orderBy("seq").collect()
    assert [(x.seq, x.victim, x.to_death) for x in replay] == [(1, "Ann", 8.0), (3, "Ann", 1.0)]


def test_logs_are_kept_apart(spark):
    """Row caps and totals hold for each session, not for all together."""
    many = spark.range(1200).selectExpr("concat('log', id % 2) as log_id", "0 as session_id", "id as seq", "1 as sub", "cast(id as double) as ts", "'Death' as kind", "'Ann' as source", "cast(null as string) as target", "cast(null as string) as spell", "cast(null as long) as amount", "cast(null as long) as effective_heal", "true as target_known", "false as is_crit", "cast(null as string) as school", "0L as absorbed", "0L as resisted", "0L as blocked", "0L as overheal", "1 as stacks")
    fight = spark.createDataFrame([("log0", 0, 1, "Boss", 0.0, 99.0, True, True, 1), ("log1", 0, 1, "Boss", 0.0, 99.0, True, True, 1)], ENC)
    last = reports.event_browser(many, fight)
    assert {(r.log_id, r.n, r.lo) for r in last.groupBy("log_id").agg(F.count("*").alias("n"), F.min("seq").alias("lo")).collect()} == {("log0", 500, 200), ("log1", 500, 201)}
    assert reports.event_log(many, fight, mode="key").count() == 1200 and reports.event_log(many.unionByName(many.withColumn("seq", F.col("seq") + 10_000)), fight).groupBy("log_id").count().count() == 2
    deaths = spark.createDataFrame([("log0", 0, 50, 50.0, "Ann")], "log_id string, session_id int, seq long, ts double, player string")
    led = reports.event_log(many, fight, mode="deaths", deaths=deaths, seconds=10)
    assert sorted(r.seq for r in led.collect()) == [40, 42, 44, 46, 48, 50] and {r.death for r in led.collect()} == {50}
    for wrong in ({"mode": "nothing"}, {"mode": "deaths"}):
        with pytest.raises(ValueError):
            reports.event_log(many, fight, **wrong)
    uses = many.where("seq < 4").select("log_id", "session_id", F.col("source").alias("player"), F.lit(None).cast("int").alias("category"), F.lit("Tea").alias("consumable"))
    assert sorted((r.log_id, r.level, r.n) for r in reports.consumables_overview(uses).collect()) == [(f"log{k}", level, 2) for k in (0, 1) for level in range(4)]
    assert [r.n for r in reports.consumable_uses_by_player(uses).collect()] == [2, 2]


def test_filtered_stats(spark):
    """All: as of the line; a filter: by the final roster."""
    rows = [(105, "Damage", "Boss", "Ann", "Bite", 50), (106, "Healing", "Bob", "Ann", "Heal", 30), (205, "Healing", "Bob", "Ann", "Heal", 9)]
    e = entries(spark, *rows).withColumn("target_known", F.col("seq") > 1).withColumn("overheal", F.lit(0)).selectExpr("*", "false as is_crit", "false as is_pet_spell", "0L as absorbed", "0L as resisted", "0L as blocked", "false as is_crushing", "false as is_glancing")
    players = spark.createDataFrame([("a", 0, "Ann", 2), ("a", 0, "Bob", 0)], "log_id string, session_id int, name string, first_seen_seq long")
    f = fights(spark, (100, 110), (200, 210))
    tell = lambda which: {r.player: (r.healing, r.damage_taken) for r in selection.filtered_stats(e, f, players, which)["totals"].collect()}
    assert tell("all") == {"Bob": (9, 0), "Ann": (0, 50), "Boss": (0, 0)} and tell(1) == {"Bob": (30, 0), "Ann": (0, 50), "Boss": (0, 0)} and tell(2) == {"Bob": (9, 0)}


def test_text(spark):
    r = spark.range(1).select(text.minutes(F.lit(125)), text.spoken(F.lit(59)), text.spoken(F.lit(3725)), text.thousands(F.lit(1234567)), text.clock(F.lit(86400.0 * 58 + 3661))).first()
    assert list(r) == ["2:05", "59s", "1h 2m", "1,234,567", "01:01:01"]


def test_lanes_and_consumables(spark):
    f = fights(spark, (1000, 1100))
    facts = spark.createDataFrame([("a", 0, 600.0, 1200.0)], "log_id string, session_id int, start_time double, end_time double")
    w = timeline.consume_window(f, facts)
    assert tuple(w.first())[2:] == (700.0, 1100.0)
    uses = spark.createDataFrame([("a", 0, 1, 650.0, "Ann", "Tea", 2), ("a", 0, 2, 900.0, "Ann", "Might", 0), ("a", 0, 3, 1050.0, "Bob", "Tea", 2)], "log_id string, session_id int, seq long, ts double, player string, consumable string, category int")
    marks = timeline.consume_marks(uses, w)
    assert [(r.consumable, r.offset) for r in marks.orderBy("offset").collect()] == [("Might", 200.0), ("Tea", 350.0)]
    e = entries(spark, aura(1010, True), aura(1060, False), (1020, "Dispel", "Bob", "Ann", "Cleanse", None), (1030, "Dispel", "Bob", "Cid", "Purge", None), (1040, "Resurrect", "Bob", "Ann", "Rebirth", None))
    spans = timeline.aura_intervals(e, f)
    buffs = spark.createDataFrame([("Other", 5, False)], "buff string, category int, death_persistent boolean")
    categories = timeline.aura_categories(marks, spans.select("log_id", "session_id", "aura").distinct(), buffs)
    assert [(r.category, r.players, r.bars) for r in timeline.category_lanes(spans, marks, categories).orderBy("category").collect()] == [(0, ["Ann"], True), (2, ["Bob"], False)]
    assert [(r.player, r.active) for r in timeline.active_at(spans, marks, 30.0, 400.0).collect()] == [("Ann", ["Might"])]
    (lane,) = timeline.dispel_lanes(e, f).collect()
    assert lane.caster == "Bob" and [m.spell for m in lane.marks] == ["Cleanse", "Purge"]
    (seg,) = timeline.axis_segments(f, w).collect()
    assert (seg.lo, seg.hi, seg.at) == (0.0, 100.0, 300.0)
    moved = timeline.translate(spans.withColumn("id", F.monotonically_increasing_id()).withColumn("offset", F.col("start")), timeline.axis_segments(f, w), "id")
    assert moved.first().translated == 310.0
    assert [(r.player, r.target, r.spell) for r in reports.resurrect_detail(e).collect()] == [("Bob", "Ann", "Rebirth")]
    assert timeline.zoom(marks, 100, 250).count() == 1 and timeline.zoom(marks, 100, 101).count() == 2
