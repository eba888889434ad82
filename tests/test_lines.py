import random
import zipfile

import pytest
from minilog import at, lines, npcs, roster, zones
from pyspark.sql import functions as F

from skeinlog.functions import decode
from skeinlog.operators import encounters, entries, kernels, normalise, sessions
from skeinlog.sources import dims, logs, scratch


def rewritten(spark, *payloads, first=()):
    texts = [*first, *[at(100 + k, p) for k, p in enumerate(payloads)]]
    out = normalise.normalise(lines(spark, *texts)).orderBy("seq").collect()
    return [r.text.split("  ", 1)[1] for r in out[len(first) :]]


def test_normalise(spark):
    me = (at(0, roster("ann", you=True)), at(0, roster("Hun", pet="Rex")), at(1, "CAST: Rex casts Bite(17261)(Rank 8) on Boss."))
    given = (
        "Your Slam hits Boss for 5.", "You gain Rage (1).", "Boss hits you for 7.", "Bob 's Heal heals you for 9.", "Your Bomb hits you for 3.",
        "Rex (Hun) hits Boss for 100.", "Rex (Hun)'s Bite hits Boss for 50.", "Bob's Heal heals Cid for 9.", "Boss suffers 10 Fire damage from Bob's Burn.",
        "LOOT: x&Bob receives loot: |cffa335ee|Hitem:7:0|h[Blade]|h|r.", "Searing Totem IV (Sham)'s Attack hits Boss for 4.", "Bob hits Bob for 4.",
        "Cid's Zap hits Cid for 4.",
    )
    assert rewritten(spark, *given, first=me) == [
        "Ann 's Slam hits Boss for 5.", "Ann gains Rage (1).", "Boss hits Ann for 7.", "Bob 's Heal heals Ann for 9.", "Ann (self damage) 's Bomb hits Ann for 3.",
        "Hun 's (pet) Auto Attack hits Boss for 100.", "Hun 's (pet) Bite hits Boss for 50.", "Bob 's Heal heals Cid for 9.", "Boss suffers 10 Fire damage from Bob 's Burn.",
        "LOOT: x&Bob receives loot: |cffa335ee|Hitem:7:0|h[Blade]|h|rx1.", "Sham 's Attack hits Boss for 4.", "Bob hits Bob for 4.",
        "Cid (self damage) 's Zap hits Cid for 4.",
    ]


def test_sessions(spark):
    aliases = spark.createDataFrame([("the bog", "Bog Keep")], "alias string, canonical string")
    texts = [
        at(0, roster("Ann", you=True)), at(1, "ZONE_INFO: 1&Town&0"), at(2, "ZONE_INFO: 1&The Bog&0"), at(10, "PLAYER_REGEN_DISABLED"), at(20, "PLAYER_REGEN_ENABLED"),
        at(21, "UNIT_DIED:Mire Lord:0xF13"), at(30, "ZONE_INFO: 1&Town&0"), at(60, "PLAYER_REGEN_DISABLED"), at(61, "UNIT_DIED:Left Twin:0xF13"), at(70, "PLAYER_REGEN_ENABLED"),
        at(3000, "PLAYER_REGEN_DISABLED"), at(3010, "PLAYER_REGEN_ENABLED"),
    ]
    l = lines(spark, *texts).drop("session_id")  # noqa: E741
    m = scratch.cut(sessions.markers(l, npcs(spark), aliases))
    numbered = scratch.cut(sessions.number_sessions(m, zones(spark)))
    s = scratch.cut(sessions.sessions(numbered, zones(spark), sessions.log_years(l)))
    got = [(r["name"], r.is_raid, r.combat_count, r.kill_count, r.you_players, r.start_year) for r in s.orderBy("start_time").collect()]
    # the Twin dies between two combats of which the one in its own session began before: that session has no combat
    assert got == [("Bog Keep Full Clear", True, 2, 1, [], 2026), ("Unknown", False, 1, 0, [], 2026)]
    named = logs.export_names(s).where("is_raid").collect()
    assert [r.export_name for r in named] == ["Unknown-BogKeep-2026-01-27-export"]
    assert sessions.assign_lines(l, s).where("seq <= 5").count() >= 4
    assert sessions.display(s).where("is_raid").first().shown.startswith("Bog Keep Full Clear - 27/01/2026 - ")


def test_readers_and_dims(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for n in ("a", "b"):
        (tmp_path / "logs" / f"{n}.txt").write_text("\n".join(f"{n}{k:05d}" + "x" * 40 for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = logs.read_logs(spark, str(tmp_path / "logs"))
        for part in rows.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("r")).collect():
            assert [x.text[1:6] for x in part.r] == [f"{k:05d}" for k in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("readme.md", "no")
        z.writestr("LOG.TXT", "one\r\ntwo\n")
        z.writestr("more.txt", "three")
    with zipfile.ZipFile(tmp_path / "y.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("long.txt", "\n".join(f"line {k}" for k in range(45_000)))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("readme.md", "no")
    for stream in (True, False):
        zipped = logs.read_zipped_logs(spark, str(tmp_path / "*.zip"), stream)
        assert [r.text for r in zipped.where("log_id like '%z.zip'").orderBy("seq").collect()] == ["one", "two"]
        assert [r.text for r in zipped.where("log_id like '%y.zip'").orderBy("seq").collect()] == [f"line {k}" for k in range(45_000)]
        assert zipped.count() == 45_002

    (tmp_path / "i.toml").write_text('[zone_aliases]\n"the bog" = "Bog Keep"\n[overworld]\nzones = ["town"]\n[[raid]]\nname = "Bog Keep"\nencounter_count = 1\nbosses = ["Mire Lord"]\ntrash = ["Bogling"]\n[[raid]]\nname = "Twin Hall"\ndungeon = true\nencounter_count = 1\nbosses = ["Left Twin", "Right Twin"]\ntrash = ["Bogling"]\nencounter_groups = [{name = "The Twins", bosses = ["Left Twin", "Right Twin"]}]\n')
    d = dims.load_instances(spark, str(tmp_path / "i.toml"))
    assert sorted((r.npc, r.instance, r.is_boss, r.group_name) for r in d["npcs"].collect()) == [
        ("bogling", "bog keep", False, None), ("left twin", "twin hall", True, "The Twins"), ("mire lord", "bog keep", True, None), ("right twin", "twin hall", True, "The Twins"),
    ]
    (tmp_path / "c.toml").write_text('[ignored]\nitems = ["Toy"]\n[[category]]\nname = "Flask"\ndisplay = "Flasks"\ndeath_persistent = true\nitems = ["Big Flask"]\nbuff_names = ["Bigness"]\n[[category]]\nname = "Scroll"\ndisplay = "Scrolls"\nprefix = "Scroll of "\nitems = []\n')
    c = dims.load_consumables(spark, str(tmp_path / "c.toml"))
    assert [tuple(r) for r in c["categories"].orderBy("category").collect()] == [(0, "Flask", "Flasks"), (1, "Scroll", "Scrolls"), (2, "Other", "Other")]
    assert c["items"].count() == 3 and {(r.buff, r.death_persistent) for r in c["buffs"].collect()} == {("Bigness", True), ("Big Flask", True)}


def test_logs_of_many_splits(spark, tmp_path):
    """From the reader to encounters: two recorders, two zones, and a fight, all across borders of splits."""
    talk = [f"Cid hits Bogling for {k}." for k in range(60)]
    payloads = [roster("ann", you=True), roster("bob", klass="MAGE"), "ZONE_INFO: 1&Bog Keep&0", "UNIT_DIED:Frog:0xF13", *talk, "You gain Rage (1).", "PLAYER_REGEN_DISABLED"]
    payloads += ["Your Slam hits Mire Lord for 50." if k % 2 else "Mire Lord hits Bob for 9." for k in range(240)]
    payloads += [roster("bob", you=True), *["Your Zap hits Mire Lord for 5."] * 100, "UNIT_DIED:Mire Lord:0xF13", "PLAYER_REGEN_ENABLED"]
    payloads += ["ZONE_INFO: 1&Twin Hall&0", *["You gain Calm (1)."] * 50, "PLAYER_REGEN_DISABLED", *["Your Zap hits Left Twin for 5."] * 100, "PLAYER_REGEN_ENABLED"]
    (tmp_path / "logs").mkdir()
    for name in ("x", "y"):
        (tmp_path / "logs" / f"{name}.txt").write_text("\n".join(at(k / 5, p) for k, p in enumerate(payloads)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        raw = scratch.cut(logs.read_logs(spark, str(tmp_path / "logs")).withColumn("session_id", F.lit(0)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert raw.select(F.shiftright("seq", 23)).distinct().count() > 10
    clean = scratch.cut(normalise.normalise(raw))
    for log in (r.log_id for r in raw.select("log_id").distinct().collect()):
        texts = [r.text.split("  ", 1)[1] for r in clean.where(F.col("log_id") == log).orderBy("seq").collect()]
        first = payloads.index(roster("bob", you=True))
        for k, (p, t) in enumerate(zip(payloads, texts, strict=True)):
            if p.startswith("You"):
                assert t.startswith("Bob" if k > first else "Ann"), (k, p, t)
    decoded = scratch.cut(decode.decode(clean))
    players = scratch.cut(entries.roster(decoded))
    marks = entries.combat_marks(decoded)
    e = scratch.cut(entries.entries(decoded, players))
    assert e.where("kind = 'Damage' and reset_id = 0").count() == 2 * 60 and e.where("kind = 'Damage' and reset_id = 1").count() == 2 * 340
    assert e.where("kind = 'Damage' and reset_id = 3").count() == 2 * 100
    found = encounters.encounters(decoded, e, marks, players, npcs(spark), zones(spark)).orderBy("log_id", "enc_idx").collect()
    assert [(r["name"], r.zone, r.is_kill) for r in found] == [("Mire Lord", "bog keep", True), ("The Twins", "twin hall", False)] * 2


def test_trades_take_the_earliest_loot(spark):
    r = random.Random(4)
    loot = [(k, r.randrange(5), r.randrange(50)) for k in range(80)]
    trades = [(k, r.randrange(6), r.randrange(50)) for k in range(80)]
    want = {}
    for t, who, ts in sorted(trades):
        mine = sorted((at_, i) for i, w, at_ in loot if w == who and at_ <= ts)
        if mine:
            want[mine[0][1]] = t
    l, t = spark.createDataFrame(loot, "loot int, who int, loot_ts int"), spark.createDataFrame(trades, "trade int, who int, trade_ts int")  # noqa: E741
    assert dict(encounters.link_trades(l, t, ["who"], "loot", "trade").select("loot", "trade").collect()) == want


def test_stretches_of_lines(spark):
    r = random.Random(7)
    at_ = sorted({r.choice([0, 1 << 16, 5 << 30, 1 << 50]) + r.randrange(1 << 17) for _ in range(400)})
    rows = [(k, x, x % 3 == 0) for x in at_ for k in (1, None)]
    df = spark.createDataFrame(rows, "k int, seq long, mark boolean")
    want, now = {}, {}
    for k, x, mark in sorted(rows, key=lambda y: y[1]):
        now[k] = x if mark else now.get(k)
        want[k, x] = now[k]
    marks = df.where("mark").select("k", "seq", F.col("seq").alias("last"))
    got = {(x.k, x.seq): x["last"] for x in kernels.along(df, kernels.stretches(marks, df, ["k"], ["last"]), ["k"]).collect()}
    assert got == want


def test_last_said_of_lines(spark):
    r = random.Random(7)
    at_ = sorted({r.choice([0, 1 << 16, 5 << 30, 1 << 50]) + r.randrange(1 << 17) for _ in range(400)})
    rows = [(k, x, x % 3 == 0) for x in at_ for k in (1, None)]
    df = spark.createDataFrame(rows, "k int, seq long, mark boolean")
    facts = df.select("k", F.shiftright("seq", kernels.BLOCK_BITS).alias("_block")).distinct().withColumn("own", F.col("_block") + 1)
    want, now = {}, {}
    for k, x, mark in sorted(rows, key=lambda y: y[1]):
        now[k] = x if mark else now.get(k)
        want[k, x] = (now[k], (x >> kernels.BLOCK_BITS) + 1)
    marks = df.where("mark").select("k", "seq", F.col("seq").alias("last"))
    told = kernels.last_said(df, marks, df, ["k"], ["last"], facts=facts)
    assert told.columns == ["k", "seq", "mark", "last", "own"]
    got = told.collect()
    assert len(got) == len(rows) and {(x.k, x.seq): (x["last"], x.own) for x in got} == want


def test_scratch_needs_a_shared_folder(spark):
    class Bare:
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})

    with pytest.raises(RuntimeError):
        scratch.root(Bare)


def test_exports_of_logs_with_one_name(spark, tmp_path):
    rows = [(log, k, "Bog Keep (1/2)", True, 5015520.0 + 9000 * k, 2026, [who]) for log, who in (("a", "Ann"), ("b", "ann"), ("c", "Bob")) for k in range(2)] + [("a", 2, "Town", False, 5015520.0, 2026, [])]
    s = spark.createDataFrame(rows, "log_id string, session_no int, name string, is_raid boolean, start_time double, start_year int, you_players array<string>")
    lines_ = [(log, k, seq << 3, f"{log}{k}:{seq}") for seq in range(40) for log in "abc" for k in range(3)]
    lines_ = spark.createDataFrame(lines_, "log_id string, session_id int, seq long, text string").repartition(5)
    logs.export_sessions(lines_, s, str(tmp_path / "out"), part_bits=6)
    names = {(r.log_id, r.session_no): r.export_name for r in logs.export_names(s.where("is_raid")).collect()}
    assert len({n.lower() for n in names.values()}) == 6
    assert names["c", 0] == "Bob-BogKeep-2026-01-27-export" and names["c", 1] == "Bob-BogKeep-2026-01-27-export-2" and names["a", 0].startswith("Ann-BogKeep-2026-01-27-export-")
    for (log, k), name in names.items():
        back = logs.read_export(spark, str(tmp_path / "out"), name).orderBy("part", "seq").collect()
        assert [r.text for r in back] == [f"{log}{k}:{seq}" for seq in range(40)]
    parts = spark.read.json(str(tmp_path / "out" / "_manifest")).collect()
    assert len(parts) == 6 * 5 and all(r.lines == 8 and r.last_seq - r.first_seq == 56 for r in parts)


def test_strict_order_goes_by_the_text_of_times(spark):
    r = random.Random(3)
    texts = [f"1/27 {r.randrange(7, 13)}:{r.randrange(0, 4)}:5.5  " + (roster(f"p{k}", you=True) if k % 9 == 4 else "You gain Rage (1).") for k in range(400)]
    clock = lambda t: t.split("  ")[0]
    marks = sorted(((clock(t), k, f"P{k}") for k, t in enumerate(texts) if "COMBATANT" in t), key=lambda m: m[0])
    first = f"P{min(k for _, k, _ in marks)}"
    want = [([m[2] for m in marks if m[0] <= clock(t)] or [None])[-1] for t in texts]
    got = normalise.recording_player(lines(spark, *texts), strict=True).orderBy("seq").collect()
    assert [g.me for g in got] == [w or first for w in want]
