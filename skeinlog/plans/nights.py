"""Queries that run the operators on nights made of the events table: each day is a log, its events are entries of forty players
and five ogres, and six fights a day are encounters. DuckDB SQL says what each must return.

The time of a night is an eighth of the day's, so that fights hold a good part of the events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates, encounters, selection, timeline
from ..operators import entries as N
from . import reports
from .bindings import DAY, ORACLES, QUERIES, events, query  # noqa: F401

#: The same expressions in Spark SQL and DuckDB, by column of an entry; us, seq, user_id, event_type and amt come from the events table.
_TIME = {
    "log_id": f"concat('d', cast(us // {DAY} as string))",
    "ts": f"cast(us % {DAY} // 8 as double) / 1000000.0",
    "who": "concat('p', cast(user_id % 40 as string))",
    "other": "concat('p', cast(seq % 40 as string))",
    "ogre": "concat('Ogre', cast(seq % 5 as string))",
}
_ENTRY = {
    "kind": "case event_type when 'purchase' then 'Damage' when 'view' then 'Healing' when 'error' then 'Death' when 'click' then case when seq % 2 = 0 then 'AuraGain' else 'AuraFade' end"
    " else case seq % 3 when 0 then 'Dispel' when 1 then 'Resurrect' else 'Interrupt' end end",
    "source": "case when event_type = 'purchase' and seq % 3 = 0 then ogre else who end",
    "target": "case event_type when 'purchase' then case when seq % 3 = 0 then who else ogre end when 'view' then case when seq % 4 = 0 then ogre else other end"
    " when 'signup' then case when seq % 3 = 2 then ogre else other end end",
    "spell": "case event_type when 'purchase' then case when seq % 2 = 0 then 'Slam' else 'Bite' end when 'view' then case when user_id % 2 = 0 then 'Mend' else 'Renew (hot)' end"
    " when 'click' then case when user_id % 3 = 0 then 'Might' when user_id % 3 = 1 then 'Flask' else 'Rage' end when 'signup' then case seq % 3 when 0 then 'Cleanse' when 1 then 'Rebirth' else 'Kick' end end",
    "amount": "case when event_type in ('purchase', 'view') then amt end",
    "effective_heal": "case when event_type = 'view' then amt - amt // 4 end",
    "overheal": "case when event_type = 'view' then amt // 4 end",
    "absorbed": "case when event_type = 'purchase' then case when seq % 5 = 0 then amt % 50 else 0 end end",
    "resisted": "case when event_type = 'purchase' then seq % 4 end",
    "blocked": "case when event_type = 'purchase' then case when seq % 9 = 0 then 7 else 0 end end",
    "school": "case when event_type = 'purchase' and seq % 2 = 0 then 'Fire' end",
    "is_crit": "event_type in ('purchase', 'view') and seq % 7 = 0",
    "is_glancing": "false",
    "is_crushing": "event_type = 'purchase' and seq % 6 = 0",
    "is_pet_spell": "event_type = 'purchase' and seq % 3 = 1 and user_id % 4 = 0",
    "stacks": "case when event_type = 'click' and seq % 2 = 0 then cast(1 + seq % 3 as int) end",
    "is_fully_resisted": "event_type = 'purchase' and seq % 15 = 0",
    "is_fully_absorbed": "event_type = 'purchase' and seq % 21 = 0",
    "is_fully_blocked": "event_type = 'purchase' and seq % 27 = 0",
}
_FIGHT = {
    "start": "cast((i - 1) * 1800 + 60 as double)",
    "end": "cast((i - 1) * 1800 + 660 + 60 * i as double)",
    "name": "case i when 1 then 'Mire Lord' when 2 then 'Mire Lord' when 4 then 'The Twins' when 5 then 'The Twins' when 6 then 'Ogre1' end",
    "is_boss": "i in (1, 2, 4, 5)",
    "is_kill": "i in (2, 5)",
    "attempt": "case i when 1 then 1 when 2 then 2 when 4 then 1 when 5 then 2 end",
}
_PLAYER = {
    "class": "case k % 3 when 0 then 'MAGE' when 1 then 'ROGUE' else 'PRIEST' end",
    "race": "case when k % 2 = 0 then 'Human' else 'Gnome' end",
    "guild": "case when k % 4 <> 0 then 'Anvil' end",
    "talents": "case when k % 5 = 0 then '31/20/0' end",
    "pet_name": "case when k % 4 = 0 then concat('Cat', cast(k as string)) end",
}


def _listed(columns: dict[str, str]) -> str:
    return ", ".join(f'{v} AS "{k}"' for k, v in columns.items()).replace("as string", "as varchar")


NIGHT = f"""WITH e0 AS (SELECT event_id AS seq, epoch_us(ts) AS us, user_id, event_type, CAST(round(value*100) AS BIGINT) AS amt FROM events),
e1 AS (SELECT *, {_listed(_TIME)} FROM e0), n AS (SELECT log_id, seq, ts, user_id, {_listed(_ENTRY)} FROM e1),
f AS (SELECT log_id, CAST(i AS INT) AS enc_idx, {_listed(_FIGHT)} FROM (SELECT DISTINCT log_id FROM n), range(1, 7) t(i)),
p AS (SELECT log_id, name, k, {_listed(_PLAYER)} FROM (SELECT DISTINCT log_id, who AS name, user_id % 40 AS k FROM e1)),
pl AS (SELECT log_id, name AS pn FROM p)"""


@dataclass
class Night:
    entries: DataFrame
    fights: DataFrame
    players: DataFrame


def night(spark: SparkSession, sf_dir: str) -> Night:
    sql = lambda columns: [F.expr(v.replace("//", "div")).alias(k) for k, v in columns.items()]
    timed = events(spark, sf_dir).select("*", *sql(_TIME))
    key = [F.col("log_id"), F.lit(0).alias("session_id")]
    entries = timed.select(*key, "seq", F.lit(0).alias("sub"), "ts", "user_id", *sql(_ENTRY))
    for side in ("source", "target"):
        entries = entries.withColumn(f"{side}_known", F.coalesce(F.col(side).startswith("p"), F.lit(False)))
    fights = timed.select("log_id").distinct().select(*key, F.explode(F.sequence(F.lit(1), F.lit(6))).alias("i")).select(*N.KEY, F.col("i").alias("enc_idx"), F.lit("bog").alias("zone"), *sql(_FIGHT))
    gear = F.transform(F.sequence(F.lit(0), F.lit(18)), lambda i: F.when(i % 20 < F.col("k") % 20, F.struct(i.cast("int").alias("item_id"))))
    players = timed.select(*key, F.col("who").alias("name"), (F.col("user_id") % 40).alias("k")).distinct().select(*N.KEY, "name", *sql(_PLAYER), gear.alias("gear"), F.lit(-1).cast("long").alias("first_seen_seq"))
    return Night(entries, fights, players)


_IN = "EXISTS (SELECT 1 FROM f WHERE f.log_id = n.log_id AND {} AND ts BETWEEN start AND \"end\")".format
_WHICH = {"kills": "is_boss AND is_kill", "wipes": "is_boss AND NOT is_kill", "trash": "NOT is_boss"}


def _each(which, made) -> DataFrame:
    """made(w) of each w, with w as a column."""
    out = None
    for w in which:
        one = made(w).withColumn("which", F.lit(str(w)))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{NIGHT} SELECT log_id, w AS which, sum("end" - start) AS duration FROM f, (VALUES ('all'), ('kills'), ('wipes'), ('trash'), ('2')) v(w)
WHERE w = 'all' OR w = 'kills' AND is_boss AND is_kill OR w = 'wipes' AND is_boss AND NOT is_kill OR w = 'trash' AND NOT is_boss OR w = CAST(enc_idx AS VARCHAR) GROUP BY 1, 2""")
def selected_durations(spark, sf_dir):
    x = night(spark, sf_dir)
    return _each(("all", "kills", "wipes", "trash", 2), lambda w: selection.duration(x.fights, w)).drop("session_id")


_TOTALS = " UNION ALL ".join(f"""SELECT '{w}' AS which, log_id, source AS player, sum(amount) AS damage, 0 AS taken, 0 AS eff, 0 AS over FROM n WHERE kind = 'Damage' AND {_IN(t)} GROUP BY 2, 3
UNION ALL SELECT '{w}', log_id, target, 0, sum(amount), 0, 0 FROM n WHERE kind = 'Damage' AND {_IN(t)} GROUP BY 2, 3
UNION ALL SELECT '{w}', log_id, source, 0, 0, sum(effective_heal), sum(overheal) FROM n WHERE kind = 'Healing' AND target LIKE 'p%' AND (log_id, target) IN (SELECT (log_id, pn) FROM pl) AND {_IN(t)} GROUP BY 2, 3""" for w, t in _WHICH.items())


@query(f"""{NIGHT} SELECT which, log_id, player, CAST(sum(damage) AS BIGINT) AS damage, CAST(sum(taken) AS BIGINT) AS damage_taken, CAST(sum(eff) AS BIGINT) AS effective, CAST(sum(over) AS BIGINT) AS overheal, CAST(sum(eff + over) AS BIGINT) AS healing FROM ({_TOTALS}) GROUP BY 1, 2, 3""")
def selected_totals(spark, sf_dir):
    """Statistics of selections, counted anew by the final roster."""
    x = night(spark, sf_dir)
    return _each(_WHICH, lambda w: selection.filtered_stats(x.entries, x.fights, x.players, w)["totals"]).drop("session_id", "pet_damage")


@query(f"""{NIGHT} SELECT kind, log_id, source AS player, count(*) AS n FROM n WHERE kind IN ('Dispel', 'Interrupt', 'Resurrect', 'Death') AND {_IN("is_boss AND NOT is_kill")} GROUP BY 1, 2, 3""")
def casts_in_wipes(spark, sf_dir):
    """Dispels, interrupts, resurrections and deaths of the wipes, by player."""
    x = night(spark, sf_dir)
    rows = selection.in_selection(x.entries, x.fights, "wipes")
    out = None
    for kind in ("Dispel", "Interrupt", "Resurrect", "Death"):
        one = reports.counts_by(rows, kind).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.drop("session_id")


@query(f"""{NIGHT}, d AS (SELECT DISTINCT log_id, source AS player FROM n) SELECT d.log_id, player, coalesce(class, 'UNKNOWN') AS class FROM d LEFT JOIN p ON d.log_id = p.log_id AND player = name""")
def classes_of_sources(spark, sf_dir):
    x = night(spark, sf_dir)
    return selection.with_class(x.entries.select(*N.KEY, F.col("source").alias("player")).distinct(), x.players, "player").drop("session_id")


@query(f"""{NIGHT}, c AS (SELECT log_id, enc_idx, name, attempt, is_kill, is_boss, "end" - start AS d, CASE WHEN NOT is_boss THEN 'trash' WHEN is_kill THEN 'kills' ELSE 'wipes' END AS category FROM f)
SELECT log_id, category, CAST(NULL AS INT) AS enc_idx, count(*) AS n, sum(d) AS duration, CAST(NULL AS VARCHAR) AS label FROM c GROUP BY 1, 2 UNION ALL SELECT log_id, 'all', NULL, count(*), sum(d), NULL FROM c GROUP BY 1
UNION ALL SELECT log_id, 'single', enc_idx, 1, d, coalesce(name, 'Unknown') || CASE WHEN is_kill THEN ' (Kill)' ELSE ' (Wipe ' || coalesce(attempt, 1) || ')' END FROM c WHERE is_boss""")
def fight_catalogue(spark, sf_dir):
    return selection.catalogue(night(spark, sf_dir).fights).select("log_id", "category", "enc_idx", "n", "duration", "label")


@query(f"""{NIGHT} SELECT log_id, seq, kind FROM n WHERE kind IN ('Death', 'Resurrect', 'Damage') AND (source = 'p7' OR target = 'p7')""")
def kinds_of_player(spark, sf_dir):
    """Deaths (with resurrections) and damage that one player has a part in."""
    return selection.about_player(selection.of_kinds(night(spark, sf_dir).entries, ["Death", "Damage", "AuraGain"]), "p7").select("log_id", "seq", "kind")


_AXIS = f"""{NIGHT}, x AS (SELECT *, "end" - start AS len, coalesce(sum("end" - start) OVER (PARTITION BY log_id ORDER BY enc_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM f),
o AS (SELECT n.*, x.enc_idx, ts - start + base AS off FROM n JOIN x ON n.log_id = x.log_id AND ts BETWEEN start AND "end"),
g AS (SELECT o.*, s.pn IS NOT NULL AS s, t.pn IS NOT NULL AS t FROM o LEFT JOIN pl s ON o.log_id = s.log_id AND source = s.pn LEFT JOIN pl t ON o.log_id = t.log_id AND target = t.pn)"""
_SECONDS = f"""{_AXIS.replace("WITH ", "WITH RECURSIVE ", 1)}, r AS (SELECT log_id, count(*) AS raid FROM pl GROUP BY 1),
st AS (SELECT log_id, enc_idx, base AS off, -1 AS seq, 0 AS step FROM x UNION ALL SELECT log_id, enc_idx, off, seq, CASE WHEN kind = 'Death' AND s THEN -1 WHEN kind = 'Resurrect' AND t THEN 1 ELSE 0 END FROM g),
sk AS (SELECT st.*, raid, row_number() OVER (PARTITION BY st.log_id, enc_idx ORDER BY seq) AS k FROM st JOIN r ON st.log_id = r.log_id),
lv AS (SELECT log_id, enc_idx, off, seq, k, raid AS level FROM sk WHERE k = 1 UNION ALL SELECT sk.log_id, sk.enc_idx, sk.off, sk.seq, sk.k, greatest(0, least(raid, lv.level + sk.step)) FROM lv JOIN sk ON sk.log_id = lv.log_id AND sk.enc_idx = lv.enc_idx AND sk.k = lv.k + 1),
al AS (SELECT log_id, CAST(floor(off) AS BIGINT) AS second, arg_max(level, (enc_idx, seq)) AS alive FROM lv GROUP BY 1, 2),
sm AS (SELECT log_id, CAST(floor(off) AS BIGINT) AS second, coalesce(sum(amount) FILTER (WHERE kind = 'Damage' AND s), 0) AS damage, coalesce(sum(amount) FILTER (WHERE kind = 'Damage' AND t), 0) AS damage_taken,
  coalesce(sum(effective_heal) FILTER (WHERE kind = 'Healing' AND s AND t), 0) AS healing, coalesce(sum(effective_heal) FILTER (WHERE kind = 'Healing' AND s AND NOT t), 0) AS boss_healing FROM g GROUP BY 1, 2),
ax AS (SELECT log_id, unnest(range(0, CAST(ceil(sum(len)) AS BIGINT) + 1)) AS second FROM x GROUP BY 1),
b AS (SELECT ax.log_id, ax.second, CAST(coalesce(damage, 0) AS BIGINT) AS damage, CAST(coalesce(damage_taken, 0) AS BIGINT) AS damage_taken, CAST(coalesce(healing, 0) AS BIGINT) AS healing, CAST(coalesce(boss_healing, 0) AS BIGINT) AS boss_healing, coalesce(alive, 0) AS al
  FROM ax LEFT JOIN sm ON ax.log_id = sm.log_id AND ax.second = sm.second LEFT JOIN al ON ax.log_id = al.log_id AND ax.second = al.second),
sec AS (SELECT b.log_id, second, damage, damage_taken, healing, boss_healing, coalesce(last_value(CASE WHEN al <> 0 OR damage <> 0 OR healing <> 0 OR damage_taken <> 0 THEN al END IGNORE NULLS) OVER (PARTITION BY b.log_id ORDER BY second), raid) AS alive FROM b JOIN r ON b.log_id = r.log_id)"""


@query(f"{_SECONDS} SELECT log_id, second, damage, damage_taken, healing, boss_healing, CAST(alive AS BIGINT) AS alive FROM sec")
def fight_seconds(spark, sf_dir):
    """Each second of the fights: damage, healing, and who is alive."""
    x = night(spark, sf_dir)
    return timeline.buckets(x.entries, x.fights, x.players).select("log_id", "second", "damage", "damage_taken", "healing", "boss_healing", F.col("alive").cast("long").alias("alive"))


@query(f"{_SECONDS} SELECT log_id, max(damage) AS max_dps, max(damage_taken) AS max_dtps, max(healing) AS max_hps, max(boss_healing) AS max_boss_hps FROM sec GROUP BY 1")
def fight_peaks(spark, sf_dir):
    x = night(spark, sf_dir)
    return timeline.peaks(timeline.buckets(x.entries, x.fights, x.players)).drop("session_id")


_ZOOMS = ((37, 1234), (0, 15), (16, 4111), (5, 6), (1000, 99999))


@query(_SECONDS + " " + " UNION ALL ".join(f"SELECT '{lo}-{hi}' AS win, log_id, CAST(sum(damage) AS BIGINT) AS damage, CAST(sum(healing) AS BIGINT) AS healing FROM sec WHERE {'TRUE' if hi - lo < 2 else f'second BETWEEN {lo} AND {hi}'} GROUP BY 2" for lo, hi in _ZOOMS))
def zoomed_seconds(spark, sf_dir):
    """Windows of the seconds of the fights, each from a few dozen rows of a pyramid of sums."""
    from ..sources.scratch import cut

    x = night(spark, sf_dir)
    values = ["damage", "healing"]
    levels = cut(timeline.pyramid(timeline.buckets(x.entries, x.fights, x.players), values))
    out = None
    for lo, hi in _ZOOMS:
        one = timeline.zoomed(levels, values, lo, hi).withColumn("win", F.lit(f"{lo}-{hi}"))
        out = one if out is None else out.unionByName(one)
    return out.drop("session_id")


@query(f"""{_AXIS}, l AS (SELECT log_id, CAST(round(off * 1000) AS BIGINT) AS ms, seq, CASE kind WHEN 'Damage' THEN 'BigHit' ELSE kind END AS kind, CASE WHEN kind = 'Death' AND s THEN source || ' died' WHEN kind = 'Damage' AND t AND amount >= 2000 THEN target || ' takes ' || amount || ' from ' || source || '''s ' || spell
WHEN kind = 'Dispel' THEN source || ' dispels ' || spell || ' on ' || target WHEN kind = 'Resurrect' AND t THEN source || ' resurrects ' || target WHEN kind = 'Interrupt' THEN source || ' interrupts ' || target || ' with ' || spell END AS label FROM g) SELECT * FROM l WHERE label IS NOT NULL""")
def fight_marks(spark, sf_dir):
    """Deaths, big hits, dispels, resurrections and interrupts on the axis of the fights."""
    x = night(spark, sf_dir)
    return timeline.point_events(x.entries, x.fights, x.players).select("log_id", F.round(F.col("offset") * 1000).cast("long").alias("ms"), "seq", "kind", "label")


@query(f"{_AXIS} SELECT log_id, source AS caster, count(*) AS n, string_agg(seq || ':' || target, ',' ORDER BY off, seq) AS marks FROM o WHERE kind = 'Dispel' GROUP BY 1, 2")
def dispels_by_caster(spark, sf_dir):
    """Casters of dispels with their number, and each one's lane of marks."""
    x = night(spark, sf_dir)
    lanes = timeline.dispel_lanes(x.entries, x.fights).select(*N.KEY, "caster", F.expr("array_join(transform(marks, m -> concat(m.seq, ':', m.target)), ',')").alias("marks"))
    return timeline.dispel_casters(x.entries, x.fights).join(lanes, [*N.KEY, "caster"]).select("log_id", "caster", F.col("count").alias("n"), "marks")


_OPEN = f"""{_AXIS}, m AS (SELECT log_id, seq, ts, kind, source AS player, spell AS aura FROM n WHERE kind IN ('AuraGain', 'AuraFade')),
pr AS (SELECT DISTINCT log_id, player, aura FROM m),
pre AS (SELECT x.log_id, enc_idx, pr.player, pr.aura, base, (SELECT arg_max(kind, (m.ts, m.seq)) FROM m WHERE m.log_id = x.log_id AND m.player = pr.player AND m.aura = pr.aura AND m.ts < x.start) AS state FROM x JOIN pr ON x.log_id = pr.log_id),
mk AS (SELECT log_id, enc_idx, player, aura, -1 AS seq, base AS off, 1 AS d FROM pre WHERE state = 'AuraGain'
  UNION ALL SELECT log_id, enc_idx, source, spell, seq, off, CASE kind WHEN 'AuraGain' THEN 1 ELSE -1 END FROM o WHERE kind IN ('AuraGain', 'AuraFade')),
cs AS (SELECT *, sum(d) OVER w AS cs FROM mk WINDOW w AS (PARTITION BY log_id, enc_idx, player, aura ORDER BY off, seq)),
cm AS (SELECT *, least(0, min(cs) OVER w) AS m FROM cs WINDOW w AS (PARTITION BY log_id, enc_idx, player, aura ORDER BY off, seq)),
cp AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY log_id, enc_idx, player, aura ORDER BY off, seq), 0) AS pm FROM cm),
cl AS (SELECT *, CASE WHEN d = 1 THEN cs - m ELSE cs - m + 1 END AS lvl FROM cp WHERE NOT (d = -1 AND m < pm)),
sp AS (SELECT *, lead(off) OVER (PARTITION BY log_id, enc_idx, player, aura, lvl ORDER BY off, seq) AS fin FROM cl),
dd AS (SELECT log_id, enc_idx, source AS player, arg_min(off, seq) AS died FROM o WHERE kind = 'Death' GROUP BY 1, 2, 3),
iv AS (SELECT sp.log_id, sp.player, aura, sp.enc_idx, sp.off AS a, coalesce(fin, CASE WHEN aura = 'Flask' THEN base + len ELSE least(coalesce(died, base + len), base + len) END) AS z, fin IS NULL AS opened FROM sp JOIN x ON sp.log_id = x.log_id AND sp.enc_idx = x.enc_idx
  LEFT JOIN dd ON sp.log_id = dd.log_id AND sp.enc_idx = dd.enc_idx AND sp.player = dd.player WHERE d = 1),
ivs AS (SELECT * FROM iv WHERE NOT opened OR z > a)"""


def _persistent(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Flask", 0, True), ("Might", 1, False)], "buff string, category int, death_persistent boolean")


def _ms(c: str) -> Column:
    return F.round(F.col(c) * 1000).cast("long")


@query(f"{_OPEN} SELECT log_id, player, aura, enc_idx, CAST(round(a * 1000) AS BIGINT) AS a_ms, CAST(round(z * 1000) AS BIGINT) AS z_ms FROM ivs")
def aura_spans(spark, sf_dir):
    """Auras over six pulls: those open before a pull, those closed by fades, by the first death (but flasks) or by the end."""
    x = night(spark, sf_dir)
    return timeline.aura_intervals(x.entries, x.fights, _persistent(spark)).select("log_id", "player", "aura", "enc_idx", _ms("start").alias("a_ms"), _ms("end").alias("z_ms"))


_MORTAL = _OPEN.replace("CASE WHEN aura = 'Flask' THEN base + len ELSE least(coalesce(died, base + len), base + len) END", "least(coalesce(died, base + len), base + len)")


@query(f"{_MORTAL} SELECT log_id, aura FROM ivs UNION SELECT log_id, spell FROM o WHERE kind IN ('AuraGain', 'AuraFade')")
def auras_met(spark, sf_dir):
    x = night(spark, sf_dir)
    return timeline.available_auras(x.entries, x.fights).drop("session_id")


@query(f"{_OPEN} SELECT log_id, aura, string_agg(DISTINCT player, ',' ORDER BY player) AS players FROM ivs WHERE aura IN ('Might', 'Flask') GROUP BY 1, 2")
def aura_lanes(spark, sf_dir):
    x = night(spark, sf_dir)
    lanes = timeline.lanes(timeline.aura_intervals(x.entries, x.fights, _persistent(spark)), ["Might", "Flask"])
    return lanes.select("log_id", "aura", F.array_join("players", ",").alias("players"))


def _uses(x: Night) -> DataFrame:
    """Uses of consumables: gains of an aura whose number ends in 4."""
    u = x.entries.where("kind = 'AuraGain' and seq % 10 = 4")
    return u.select(*N.KEY, "seq", "ts", F.col("source").alias("player"), F.col("spell").alias("consumable"), F.expr("case spell when 'Might' then 1 when 'Flask' then 0 end").cast("int").alias("category"), F.expr("case spell when 'Might' then 'Buffs' when 'Flask' then 'Flasks' end").alias("label"))


_USES = """u AS (SELECT log_id, seq, ts, source AS player, spell AS consumable, CASE spell WHEN 'Might' THEN 1 WHEN 'Flask' THEN 0 END AS category FROM n WHERE kind = 'AuraGain' AND seq % 10 = 4),
sf AS (SELECT log_id, arg_min(ts, seq) AS s, arg_max(ts, seq) AS e FROM n GROUP BY 1),
wn AS (SELECT sf.log_id, greatest((SELECT min(start) FROM f WHERE f.log_id = sf.log_id) - 300, s) AS lo, (SELECT max("end") FROM f WHERE f.log_id = sf.log_id) AS hi FROM sf),
um AS (SELECT u.*, u.ts - lo AS off FROM u JOIN wn ON u.log_id = wn.log_id WHERE ts BETWEEN lo AND hi)"""


def _window(x: Night) -> DataFrame:
    facts = x.entries.groupBy(*N.KEY).agg(F.min_by("ts", "seq").alias("start_time"), F.max_by("ts", "seq").alias("end_time"))
    return timeline.consume_window(x.fights, facts)


@query(f"{NIGHT}, {_USES} SELECT log_id, seq, player, consumable, CAST(round(off * 1000) AS BIGINT) AS ms FROM um")
def consumable_marks(spark, sf_dir):
    x = night(spark, sf_dir)
    return timeline.consume_marks(_uses(x), _window(x)).select("log_id", "seq", "player", "consumable", _ms("offset").alias("ms"))


@query(f"""{NIGHT}, {_USES}, us AS (SELECT log_id, consumable AS aura, arg_min(category, seq) FILTER (WHERE category IS NOT NULL) AS category FROM um GROUP BY 1, 2), al AS (SELECT DISTINCT log_id, spell AS aura FROM n WHERE kind IN ('AuraGain', 'AuraFade'))
SELECT * FROM us UNION ALL SELECT log_id, aura, CASE aura WHEN 'Flask' THEN 0 WHEN 'Might' THEN 1 END FROM al WHERE aura IN ('Flask', 'Might') AND (log_id, aura) NOT IN (SELECT (log_id, aura) FROM us)""")
def categories_of_auras(spark, sf_dir):
    x = night(spark, sf_dir)
    auras = x.entries.where("kind in ('AuraGain', 'AuraFade')").select(*N.KEY, F.col("spell").alias("aura")).distinct()
    return timeline.aura_categories(timeline.consume_marks(_uses(x), _window(x)), auras, _persistent(spark)).drop("session_id")


@query(f"""{NIGHT}, {_USES} SELECT 'all' AS which, f.log_id, enc_idx, CAST(round((start - lo) * 1000) AS BIGINT) AS lo, CAST(round(("end" - lo) * 1000) AS BIGINT) AS hi, coalesce(name, 'Trash') AS name, is_kill FROM f JOIN wn ON f.log_id = wn.log_id WHERE is_boss
UNION ALL SELECT 'some', f.log_id, enc_idx, CAST(round((start - lo) * 1000) AS BIGINT), CAST(round(("end" - lo) * 1000) AS BIGINT), coalesce(name, 'Trash'), is_kill FROM f JOIN wn ON f.log_id = wn.log_id""")
def fights_on_consumable_axis(spark, sf_dir):
    x = night(spark, sf_dir)
    w = _window(x)
    both = timeline.encounter_bounds(x.fights, w, True).withColumn("which", F.lit("all")).unionByName(timeline.encounter_bounds(x.fights, w, False).withColumn("which", F.lit("some")))
    return both.select("which", "log_id", "enc_idx", _ms("lo").alias("lo"), _ms("hi").alias("hi"), "name", "is_kill")


@query(f"""{_AXIS}, {_USES}, sg AS (SELECT x.log_id, enc_idx, base AS a, base + len AS z, start - lo AS moved FROM x JOIN wn ON x.log_id = wn.log_id), q AS (SELECT log_id, seq, off FROM o WHERE kind = 'Death')
SELECT log_id, seq, CAST(round(coalesce((SELECT arg_min(q.off - a + moved, enc_idx) FROM sg WHERE sg.log_id = q.log_id AND q.off BETWEEN a AND z), off) * 1000) AS BIGINT) AS ms FROM q""")
def deaths_on_consumable_axis(spark, sf_dir):
    x = night(spark, sf_dir)
    deaths = timeline.concatenated_offset(x.entries.where("kind = 'Death'"), x.fights)
    return timeline.translate(deaths, timeline.axis_segments(x.fights, _window(x)), "seq").select("log_id", "seq", _ms("translated").alias("ms"))


@query(f"""{_OPEN}, {_USES}, w AS (SELECT log_id, player, aura AS what FROM ivs WHERE 500.0 BETWEEN a AND z UNION SELECT log_id, player, consumable FROM um WHERE abs(off - 500.0) <= 30.0) SELECT log_id, player, string_agg(what, ',' ORDER BY what) AS active FROM w GROUP BY 1, 2""")
def active_at_second(spark, sf_dir):
    x = night(spark, sf_dir)
    told = timeline.active_at(timeline.aura_intervals(x.entries, x.fights, _persistent(spark)), timeline.consume_marks(_uses(x), _window(x)), 500.0, 9000.0)
    return told.select("log_id", "player", F.array_join("active", ",").alias("active"))


_HEALED = """ht AS (SELECT log_id, source AS player, sum(effective_heal) AS eff, sum(overheal) AS over FROM n WHERE kind = 'Healing' AND target LIKE 'p%' GROUP BY 1, 2),
dr AS (SELECT log_id, sum("end" - start) AS d FROM f GROUP BY 1)"""


@query(f"""{NIGHT}, {_HEALED}, v AS (SELECT 'effective' AS mode, log_id, player, eff AS value FROM ht UNION ALL SELECT 'raw', log_id, player, eff + over FROM ht UNION ALL SELECT 'overheal', log_id, player, over FROM ht)
SELECT mode, v.log_id, player, CAST(value AS BIGINT) AS value, CAST(rank() OVER w AS INT) AS rank, round(100.0::DOUBLE * value / sum(value) OVER (PARTITION BY mode, v.log_id), 4) AS pct, round(value / d, 4) AS per_second FROM v JOIN dr ON v.log_id = dr.log_id WHERE value > 0 WINDOW w AS (PARTITION BY mode, v.log_id ORDER BY value DESC)""")
def healing_meters(spark, sf_dir):
    x = night(spark, sf_dir)
    totals, d = selection.filtered_stats(x.entries, x.fights, x.players)["totals"], selection.duration(x.fights)
    out = None
    for mode in ("effective", "raw", "overheal"):
        one = reports.healing_meter(totals, x.players, d, mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out.select("mode", "log_id", "player", "value", "rank", F.round("pct", 4).alias("pct"), F.round("per_second", 4).alias("per_second"))


@query(f"""{NIGHT}, {_HEALED}, s AS (SELECT log_id, greatest(max(eff) / 0.75::DOUBLE, max(eff + over)::DOUBLE) AS scale FROM ht GROUP BY 1)
SELECT ht.log_id, player, CAST(eff AS BIGINT) AS value, eff::DOUBLE / scale AS bar, over::DOUBLE / scale AS over_bar, round(100.0::DOUBLE * over / (eff + over), 4) AS overheal_pct FROM ht JOIN s ON ht.log_id = s.log_id WHERE eff > 0""")
def healing_with_overheal(spark, sf_dir):
    x = night(spark, sf_dir)
    m = reports.healing_combined(selection.filtered_stats(x.entries, x.fights, x.players)["totals"], x.players, selection.duration(x.fights))
    return m.select("log_id", "player", "value", "bar", "over_bar", F.round("overheal_pct", 4).alias("overheal_pct"))


@query(f"""{NIGHT}, a AS (SELECT log_id, source AS player, spell AS ability, sum(amount) AS total, count(*) AS hits, count(*) FILTER (WHERE is_crit) AS crits, coalesce(sum(amount) FILTER (WHERE is_pet_spell), 0) AS pet, bool_or(is_pet_spell) AS is_pet FROM n WHERE kind = 'Damage' GROUP BY 1, 2, 3)
SELECT log_id, player, CASE WHEN is_pet THEN ability || ' (Pet)' ELSE ability END AS shown, CAST(total AS BIGINT) AS total, CAST(pet AS BIGINT) AS pet_total, hits, round(100.0::DOUBLE * crits / hits, 4) AS crit_pct FROM a""")
def abilities_shown(spark, sf_dir):
    out = reports.abilities(aggregates.damage_done(night(spark, sf_dir).entries))
    return out.select("log_id", "player", "shown", "total", "pet_total", "hits", F.round("crit_pct", 4).alias("crit_pct"))


@query(f"""{NIGHT}, a AS (SELECT log_id, source AS player, spell AS ability, sum(amount) AS total, sum(effective_heal) AS eff, sum(overheal) AS over, count(*) AS hits, count(*) FILTER (WHERE is_crit) AS crits, coalesce(sum(amount) FILTER (WHERE is_crit), 0) AS ct FROM n WHERE kind = 'Healing' AND target LIKE 'p%' GROUP BY 1, 2, 3),
b AS (SELECT *, CAST(floor(ct * coalesce(eff::DOUBLE / nullif(total, 0)::DOUBLE, 0.0)) AS BIGINT) AS cr FROM a)
SELECT log_id, player, ability, CAST(eff AS BIGINT) AS effective, CASE WHEN hits > crits THEN CAST(greatest(eff - cr, 0) // (hits - crits) AS BIGINT) END AS avg_hit, CASE WHEN crits > 0 THEN CAST(cr // crits AS BIGINT) END AS avg_crit, round(100.0::DOUBLE * over / nullif(total, 0), 4) AS overheal_pct FROM b""")
def healing_abilities_shown(spark, sf_dir):
    out = reports.healing_abilities(aggregates.healing_done(night(spark, sf_dir).entries))
    return out.select("log_id", "player", "ability", "effective", "avg_hit", "avg_crit", F.round("overheal_pct", 4).alias("overheal_pct"))


def _clock_sql(ts: str) -> str:
    s = f"CAST(floor({ts} % 86400) AS BIGINT)"
    return f"printf('%02d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60)"


@query(f"{NIGHT} SELECT log_id, seq, {_clock_sql('ts')} AS time, source AS player, target, spell FROM n WHERE kind = 'Resurrect'")
def resurrections_told(spark, sf_dir):
    return reports.resurrect_detail(night(spark, sf_dir).entries).drop("session_id")


_BLOWS = """ab AS (SELECT log_id, seq, ts, kind, source, spell, amount, CASE kind WHEN 'Death' THEN source ELSE target END AS player FROM n WHERE kind = 'Death' OR kind = 'Damage' AND target LIKE 'p%'),
pd AS (SELECT *, coalesce(sum(CASE kind WHEN 'Death' THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, player ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS died FROM ab),
de AS (SELECT *, last_value(CASE kind WHEN 'Damage' THEN {'s': source, 'p': spell, 'a': amount} END IGNORE NULLS) OVER (PARTITION BY log_id, player, died ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS blow FROM pd),
dl AS (SELECT log_id, seq, ts, player, blow.s AS killer, blow.p AS killing_blow, blow.a AS damage_amount FROM de WHERE kind = 'Death')"""


def _deaths(x: Night) -> DataFrame:
    return N.deaths(x.entries.withColumn("combat_id", F.lit(0)))


@query(f"{NIGHT}, {_BLOWS} SELECT log_id, seq, {_clock_sql('ts')} AS time, killer, killing_blow, damage_amount FROM dl WHERE player = 'p3'")
def deaths_of_player(spark, sf_dir):
    return reports.death_detail(_deaths(night(spark, sf_dir)), "p3").drop("session_id")


@query(f"""{NIGHT}, {_BLOWS} SELECT log_id, seq, player, killer, killing_blow, damage_amount, {_clock_sql('ts')} AS time, (SELECT arg_min(coalesce(name, 'Trash'), enc_idx) FROM f WHERE f.log_id = dl.log_id AND dl.ts BETWEEN start AND "end") AS encounter FROM dl""")
def deaths_in_fights(spark, sf_dir):
    """All deaths with the killing blow and the fight that holds them."""
    x = night(spark, sf_dir)
    return reports.death_log(_deaths(x), x.fights, x.players).select("log_id", "seq", "player", "killer", "killing_blow", "damage_amount", "time", "encounter")


@query(f"""{NIGHT}, c AS (SELECT log_id, source AS player, count(*) FILTER (WHERE spell = 'Rage') AS d, count(*) FILTER (WHERE spell = 'Might') AS p, count(*) FILTER (WHERE spell = 'Flask') AS m FROM n WHERE kind = 'AuraFade' GROUP BY 1, 2),
x AS (SELECT log_id, target AS player, count(*) FILTER (WHERE is_fully_resisted) AS r, count(*) FILTER (WHERE is_fully_absorbed) AS a, count(*) FILTER (WHERE is_fully_blocked) AS b FROM n WHERE kind = 'Damage' AND target LIKE 'p%' GROUP BY 1, 2)
SELECT log_id, player, way, n FROM (UNPIVOT (SELECT log_id, player, coalesce(d, 0) AS dodges, coalesce(p, 0) AS parries, coalesce(m, 0) AS missed_by, coalesce(r, 0) AS full_resists, coalesce(a, 0) AS full_absorbs, coalesce(b, 0) AS full_blocks FROM c FULL JOIN x USING (log_id, player)) ON COLUMNS(* EXCLUDE (log_id, player)) INTO NAME way VALUE n) WHERE n > 0""")
def ways_of_avoiding(spark, sf_dir):
    """Fading auras as dodges, parries and misses; damage mitigated in full."""
    x = night(spark, sf_dir)
    kinds = x.entries.where("kind = 'AuraFade'").select(*N.KEY, F.col("source").alias("player"), F.expr("case spell when 'Rage' then 'dodge' when 'Might' then 'parry' else 'missed_by' end").alias("kind"))
    return reports.avoidance_detail(aggregates.avoidance(kinds, x.entries)).drop("session_id")


@query(f"""{_OPEN}, bb AS (SELECT *, max(z) OVER (PARTITION BY log_id, player, aura ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM ivs),
ii AS (SELECT *, sum(CASE WHEN pe IS NULL OR a > pe THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, player, aura ORDER BY a, z) AS isl FROM bb),
cv AS (SELECT log_id, player, aura, sum(l) AS secs FROM (SELECT log_id, player, aura, isl, max(z) - min(a) AS l FROM ii GROUP BY ALL) GROUP BY 1, 2, 3),
ct AS (SELECT log_id, source AS player, spell AS aura, count(*) FILTER (WHERE kind = 'AuraGain') AS gains, count(*) FILTER (WHERE kind = 'AuraFade') AS fades FROM o WHERE kind IN ('AuraGain', 'AuraFade') GROUP BY 1, 2, 3),
tt AS (SELECT log_id, sum(len) AS total FROM x GROUP BY 1)
SELECT log_id, player, aura, coalesce(gains, 0) AS gains, coalesce(fades, 0) AS fades, round(100 * least(coalesce(secs, 0) / total, 1.0), 4) AS uptime_pct FROM cv FULL JOIN ct USING (log_id, player, aura) JOIN tt USING (log_id)""")
def uptimes_of_night(spark, sf_dir):
    """Uptime of auras over six pulls, with auras from before a pull, deaths and flasks that outlast them."""
    x = night(spark, sf_dir)
    return reports.buff_detail(timeline.buff_uptime(x.entries, x.fights, _persistent(spark))).select("log_id", "player", "aura", "gains", "fades", F.round("uptime_pct", 4).alias("uptime_pct"))


@query(f"{NIGHT}, {_USES} , c AS (SELECT log_id, player, CAST(category AS INT) AS category, consumable, count(*) AS n FROM u GROUP BY ALL) SELECT *, CAST(sum(n) OVER (PARTITION BY log_id, player, category) AS BIGINT) AS category_total FROM c")
def consumables_by_category(spark, sf_dir):
    return reports.consumables_of(_uses(night(spark, sf_dir))).select("log_id", "player", "category", "consumable", "n", "category_total")


@query(f"{NIGHT} SELECT log_id, name, class, race, guild, talents, CAST(least(k % 20, 19) AS INT) AS gear_slots FROM p")
def player_cards(spark, sf_dir):
    return reports.player_card(night(spark, sf_dir).players).select("log_id", "name", "class", "race", "guild", "talents", F.col("gear_slots").cast("int").alias("gear_slots"))


def _told(short: bool) -> str:
    part = lambda c: f"CASE WHEN {c} > 0 THEN ' (' || {c} || ' {c})' ELSE '' END"
    more = "''" if short else "coalesce(' ' || school, '') || " + " || ".join(part(c) for c in ("absorbed", "resisted", "blocked"))
    over = "''" if short else part("overheal")
    crit = "CASE WHEN is_crit THEN ' (crit)' ELSE '' END"
    return f"""CASE kind WHEN 'Damage' THEN source || '''s ' || spell || ' hits ' || target || ' for ' || amount || {more} || {crit} WHEN 'Healing' THEN source || '''s ' || spell || ' heals ' || target || ' for ' || effective_heal || {over} || {crit}
WHEN 'Death' THEN source || ' dies' WHEN 'Dispel' THEN source || ' dispels ' || spell || ' on ' || target WHEN 'Resurrect' THEN source || ' resurrects ' || target || ' with ' || spell WHEN 'Interrupt' THEN source || ' interrupts ' || target || ' with ' || spell
WHEN 'AuraGain' THEN source || ' gains ' || spell || CASE WHEN stacks > 1 THEN ' (' || stacks || ')' ELSE '' END ELSE spell || ' fades from ' || source END"""


@query(f"{NIGHT} SELECT log_id, seq, {_told(False)} AS long, {_told(True)} AS short FROM n")
def entries_told(spark, sf_dir):
    """Every entry as text, in both forms."""
    return night(spark, sf_dir).entries.select("log_id", "seq", text.event_line().alias("long"), text.event_line(short=True).alias("short"))


@query(f"""{NIGHT}, {_BLOWS}, k AS (SELECT 'all' AS mode, log_id, seq, {_told(False)} AS text FROM n WHERE {_IN("is_boss AND is_kill")} UNION ALL SELECT 'key', log_id, seq, {_told(True)} FROM n WHERE {_IN("is_boss AND is_kill")} AND (kind IN ('Death', 'Dispel', 'Resurrect', 'Interrupt') OR kind = 'Damage' AND amount >= 2000 AND target LIKE 'p%')
UNION ALL SELECT 'deaths', log_id, seq, {_told(False)} FROM n WHERE {_IN("is_boss AND is_kill")} AND EXISTS (SELECT 1 FROM dl LEFT JOIN (SELECT dl.log_id AS l, dl.seq AS s, min(start) AS pull FROM dl JOIN f ON f.log_id = dl.log_id AND dl.ts BETWEEN start AND "end" GROUP BY 1, 2) q ON l = dl.log_id AND s = dl.seq
  WHERE dl.log_id = n.log_id AND (dl.player = n.source OR dl.player = n.target) AND n.ts BETWEEN greatest(dl.ts - 30, coalesce(pull, dl.ts - 30)) AND dl.ts)),
r AS (SELECT *, row_number() OVER (PARTITION BY mode, log_id ORDER BY seq) AS rn FROM k) SELECT mode, log_id, seq, text FROM r WHERE rn <= 5000""")
def event_log_modes(spark, sf_dir):
    """The event log of the kills in its three modes."""
    x = night(spark, sf_dir)
    out = None
    for mode in reports.MODES:
        one = reports.event_log(x.entries, x.fights, "kills", mode, _deaths(x), seconds=30).select("log_id", "seq", "text").withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{NIGHT}, s AS (SELECT log_id, min(ts) AS a, max(ts) AS z FROM n GROUP BY 1), h AS (SELECT 'all' AS log_id, log_id AS sess, CAST(substr(log_id, 2) AS BIGINT) * 86400 + a AS a, CAST(substr(log_id, 2) AS BIGINT) * 86400 + 80000 + z / 10 AS z FROM s)
SELECT sess, CAST(round((a - lag(z) OVER w) * 1000) AS BIGINT) AS gap_ms, coalesce(a - lag(z) OVER w <= 6000, FALSE) AS should_merge, 2 AS kills, 2 AS wipes FROM h WINDOW w AS (ORDER BY a)""")
def nights_reported(spark, sf_dir):
    """Nights as the sessions of one log: the gap before each, kills and wipes."""
    x = night(spark, sf_dir)
    day = F.expr("cast(substring(log_id, 2) as bigint) * 86400")
    s = x.entries.groupBy("log_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z")).select(
        F.lit("all").alias("log_id"), F.col("log_id").alias("session_id"), (day + F.col("a")).alias("start_time"), (day + 80000 + F.col("z") / 10).alias("end_time"), F.lit("bog").alias("zone")
    )
    fights = x.fights.select(F.lit("all").alias("log_id"), F.col("log_id").alias("session_id"), "is_boss", "is_kill")
    out = reports.session_report(s, fights, 6000.0)
    return out.select(F.col("session_id").alias("sess"), _ms("gap_before").alias("gap_ms"), "should_merge", F.col("kills").cast("int").alias("kills"), F.col("wipes").cast("int").alias("wipes"))


@query("""WITH s AS (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS n, CAST(o_orderkey % 9000 AS BIGINT) AS t FROM orders)
SELECT o_orderkey, format('{:,}', n) AS thousands, printf('%d:%02d', t // 60, t % 60) AS minutes, CASE WHEN t < 60 THEN t || 's' WHEN t < 3600 THEN (t // 60) || 'm ' || (t % 60) || 's' ELSE (t // 3600) || 'h ' || (t % 3600 // 60) || 'm' END AS spoken FROM s""")
def numbers_told(spark, sf_dir):
    """Numbers and lengths of time as reports show them."""
    from .bindings import table

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("n"), (F.col("o_orderkey") % 9000).cast("double").alias("t"))
    return o.select("o_orderkey", text.thousands(F.col("n")).alias("thousands"), text.minutes(F.col("t")).alias("minutes"), text.spoken(F.col("t")).alias("spoken"))


@query(f"""{NIGHT}, a AS (SELECT log_id, source AS name FROM n WHERE kind = 'Damage' AND amount > 0 UNION SELECT log_id, target FROM n WHERE kind = 'Damage' AND amount > 0) SELECT p.log_id, p.name FROM p JOIN a ON p.log_id = a.log_id AND p.name = a.name""")
def players_with_damage(spark, sf_dir):
    """The roster without those that neither did nor took damage."""
    x = night(spark, sf_dir)
    totals = selection.filtered_stats(x.entries, x.fights, x.players)["totals"].where("damage > 0 or damage_taken > 0")
    return encounters.active_roster(x.players, totals.select(*N.KEY, F.col("player").alias("name"))).select("log_id", "name")
