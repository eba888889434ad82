"""Queries that bind the generic operators to the star-schema tables, with DuckDB SQL that says what each must return.

Roles on events: user_id is the player, event_id the line number; purchase is damage, view and click are healing (or an aura's
gain and fade), error is a death, signup opens an encounter. Amounts are integers (cents).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode as D
from ..operators import aggregates, encounters, lookups, normalise, selection, sessions, timeline
from ..operators import entries as N
from ..operators import kernels as K
from ..sources import logs
from . import reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str) -> F.Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({col} as timestamp_ntz))")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), micros("ts").alias("us"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("amt")
    )


def logged(df: DataFrame, log: Column | None = None) -> DataFrame:
    """df with the columns that separate logs and sessions: one log, or one for each value of a column."""
    return df.withColumn("log_id", F.lit("all") if log is None else log.cast("string")).withColumn("session_id", F.lit(0))


def of(df: DataFrame, *kinds: str) -> DataFrame:
    return df.where(F.col("event_type").isin(*kinds))


KEY, ORDER = ["user_id"], ["us", "seq"]
E = "WITH e AS (SELECT event_id AS seq, epoch_us(ts) AS us, user_id, event_type, CAST(round(value*100) AS BIGINT) AS amt FROM events)"
HOUR, DAY = 3_600_000_000, 86_400_000_000


def _sessions_sql(gap: int) -> str:
    return f"""{E}, f AS (SELECT *, CASE WHEN us - lag(us) OVER w > {gap} OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, seq)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY us, seq) AS sid FROM f)
SELECT user_id, CAST(sid AS BIGINT) AS sid, count(*) AS n, min(us) AS s_us, max(us) AS e_us FROM g GROUP BY 1, 2"""


def _sessions(spark: SparkSession, sf_dir: str, gap: int) -> DataFrame:
    return K.gap_sessions(events(spark, sf_dir), KEY, "us", ORDER, gap).groupBy("user_id", "sid").agg(
        F.count("*").alias("n"), F.min("us").alias("s_us"), F.max("us").alias("e_us")
    )


@query(_sessions_sql(HOUR // 2))
def gap_sessions_30min(spark, sf_dir):
    return _sessions(spark, sf_dir, HOUR // 2)


@query(_sessions_sql(6 * HOUR))
def gap_sessions_6h(spark, sf_dir):
    return _sessions(spark, sf_dir, 6 * HOUR)


@query(f"""{E}, x AS (SELECT *, CASE WHEN event_type='purchase' THEN amt WHEN event_type IN ('view','click') THEN -amt ELSE 0 END AS d FROM e),
s AS (SELECT *, sum(d) OVER w AS cs FROM x WINDOW w AS (PARTITION BY user_id ORDER BY us, seq)),
m AS (SELECT *, least(0, min(cs) OVER w) AS m FROM s WINDOW w AS (PARTITION BY user_id ORDER BY us, seq)),
o AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY user_id ORDER BY us, seq),0) - m AS over FROM m)
SELECT user_id, CAST(sum(CASE WHEN d<0 THEN amt END) AS BIGINT) AS healing, CAST(sum(over) AS BIGINT) AS overheal FROM o GROUP BY 1""")
def deficit_overheal(spark, sf_dir):
    heals = F.col("event_type").isin("view", "click")
    delta = F.when(F.col("event_type") == "purchase", F.col("amt")).when(heals, -F.col("amt")).otherwise(F.lit(0))
    return K.clamped_balance(events(spark, sf_dir), KEY, ORDER, delta).groupBy("user_id").agg(
        F.sum(F.when(heals & (F.col("amt") > 0), F.col("amt"))).alias("healing"), F.sum("excess").cast("long").alias("overheal")
    )


@query(f"""{E}, h AS (SELECT *, last_value(CASE WHEN event_type='purchase' THEN seq END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hit FROM e)
SELECT seq AS death, user_id, hit FROM h WHERE event_type='error'""")
def asof_killing_blow(spark, sf_dir):
    hit = F.when(F.col("event_type") == "purchase", F.col("seq"))
    return of(K.asof_last(events(spark, sf_dir), KEY, ORDER, hit, "hit"), "error").select(F.col("seq").alias("death"), "user_id", "hit")


PAIRS = f"""{E}, x AS (SELECT *, CASE event_type WHEN 'view' THEN 1 ELSE -1 END AS d FROM e WHERE event_type IN ('view','click')),
s AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY us, seq) AS cs FROM x),
m AS (SELECT *, least(0, min(cs) OVER (PARTITION BY user_id ORDER BY us, seq)) AS m FROM s),
k AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY user_id ORDER BY us, seq),0) AS pm FROM m),
l AS (SELECT *, CASE WHEN d=1 THEN cs-m ELSE cs-m+1 END AS lvl FROM k WHERE NOT (d=-1 AND m<pm)),
p AS (SELECT user_id, us AS s_us, d, lead(us) OVER (PARTITION BY user_id, lvl ORDER BY us, seq) AS e_us FROM l)"""


def aura_pairs(spark, sf_dir) -> DataFrame:
    marks = of(events(spark, sf_dir), "view", "click")
    return K.lifo_pairs(marks, KEY, ORDER, F.col("event_type") == "view", "us", "s_us", "e_us").where("e_us is not null")


@query(f"{PAIRS} SELECT user_id, s_us, e_us FROM p WHERE d=1 AND e_us IS NOT NULL")
def lifo_aura_pairs(spark, sf_dir):
    return aura_pairs(spark, sf_dir)


UNION = f"""{PAIRS}, iv AS (SELECT user_id, s_us, e_us FROM p WHERE d=1 AND e_us IS NOT NULL),
b AS (SELECT *, max(e_us) OVER (PARTITION BY user_id ORDER BY s_us, e_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s_us>pe THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s_us, e_us) AS g FROM b),
z AS (SELECT user_id, g, max(e_us)-min(s_us) AS len FROM i GROUP BY 1,2)"""


@query(f"{UNION} SELECT user_id, CAST(sum(len) AS BIGINT) AS covered FROM z GROUP BY 1")
def interval_union(spark, sf_dir):
    return K.covered_length(aura_pairs(spark, sf_dir), KEY, "s_us", "e_us")


@query(f"""{PAIRS}, z0 AS (SELECT min(us) AS s, min(us) + 30 * 86400000000 AS t FROM e),
iv AS (SELECT user_id, s_us, coalesce(e_us, t) AS e_us FROM p, z0 WHERE d=1 AND coalesce(e_us, t) > s_us),
b AS (SELECT *, max(e_us) OVER (PARTITION BY user_id ORDER BY s_us, e_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s_us>pe THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s_us, e_us) AS g FROM b),
c AS (SELECT user_id, sum(len) AS covered FROM (SELECT user_id, g, max(e_us)-min(s_us) AS len FROM i GROUP BY 1,2) GROUP BY 1),
n AS (SELECT user_id, count(*) FILTER (WHERE event_type='view') AS gains, count(*) FILTER (WHERE event_type='click') AS fades FROM e WHERE event_type IN ('view', 'click') GROUP BY 1)
SELECT CAST(n.user_id AS VARCHAR) AS player, CAST(gains AS BIGINT) AS gains, CAST(fades AS BIGINT) AS fades, round(least(coalesce(covered, 0) / (30 * 86400000000.0)::DOUBLE, 1.0), 5) AS uptime FROM n LEFT JOIN c ON n.user_id = c.user_id""")
def buff_uptime(spark, sf_dir):
    """Auras of a fight of thirty days: views are gains, clicks are fades; what is open lasts to the end."""
    e = events(spark, sf_dir).withColumn("ts", F.col("us") / 1e6)
    marks = logged(of(e, "view", "click")).select(*N.KEY, "seq", "ts", F.when(F.col("event_type") == "view", "AuraGain").otherwise("AuraFade").alias("kind"), F.col("user_id").cast("string").alias("source"), F.lit("Might").alias("spell"))
    fight = logged(e.agg(F.min("ts").alias("start"))).select(*N.KEY, F.lit(1).alias("enc_idx"), "start", (F.col("start") + 30 * 86400).alias("end"))
    return timeline.buff_uptime(marks, fight).select("player", "gains", "fades", F.round("uptime", 5).alias("uptime"))


METER = """SELECT l_suppkey AS player, CAST(sum(round(l_extendedprice*100)) AS BIGINT) AS total, count(*) AS hits, count(*) FILTER (WHERE l_returnflag='R') AS crits,
rank() OVER (ORDER BY sum(CAST(round(l_extendedprice*100) AS BIGINT)) DESC) AS rnk FROM lineitem GROUP BY 1"""


@query(METER)
def meter_with_rank(spark, sf_dir):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    totals = logged(table(spark, sf_dir, "lineitem")).groupBy(*N.KEY, F.col("l_suppkey").alias("player")).agg(
        F.sum(cents).alias("total"), F.count("*").alias("hits"), F.count_if(F.col("l_returnflag") == "R").alias("crits")
    )
    return reports.ranked(totals, "total", N.KEY).select("player", "total", "hits", "crits", F.col("rank").cast("long").alias("rnk"))


@query("""WITH o AS (SELECT o_custkey, o_orderstatus AS name, o_orderkey AS k, epoch_us(o_orderdate) AS s FROM orders),
f AS (SELECT *, CASE WHEN lag(name) OVER w = name AND s - lag(s) OVER w < 86400000000*90 THEN 0 ELSE 1 END AS nw FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY s,k)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY o_custkey ORDER BY s,k) AS isl FROM f)
SELECT CAST(o_custkey AS VARCHAR) AS customer, CAST(isl AS BIGINT) AS isl, min(name) AS name, count(*) AS n, min(s) AS s, max(s) AS e FROM g GROUP BY 1,2""")
def merge_islands(spark, sf_dir):
    """Orders of a customer with one status, less than 90 days apart, as merged fights."""
    at = micros("o_orderdate")
    o = logged(table(spark, sf_dir, "orders"), F.col("o_custkey")).select(
        *N.KEY, F.struct(at, "o_orderkey").alias("enc_idx"), F.col("o_orderstatus").alias("name"), F.lit("x").alias("zone"), at.alias("start"), at.alias("end"),
        F.lit(True).alias("is_boss"), F.lit(False).alias("is_kill"), F.lit(1).alias("player_deaths"), F.lit(0).alias("active_players"),
    )
    merged = encounters.merge(o, 90 * DAY)
    return merged.select(F.col("log_id").alias("customer"), F.col("enc_idx").cast("long").alias("isl"), "name", F.col("player_deaths").cast("long").alias("n"), F.col("start").alias("s"), F.col("end").alias("e"))


@query("""WITH enc AS (SELECT event_id AS id, user_id, epoch_us(ts) AS s, epoch_us(ts)+7200000000 AS e FROM events WHERE event_type='signup'),
lt AS (SELECT event_id AS lid, user_id, epoch_us(ts) AS t FROM events WHERE event_type='purchase')
SELECT lid, coalesce(CAST(max(id) AS VARCHAR), 'Trash/Other') AS boss FROM lt LEFT JOIN enc ON lt.user_id=enc.user_id AND t BETWEEN s AND e GROUP BY 1""")
def loot_attribution(spark, sf_dir):
    """Purchases as loot, signups as the starts of fights of two hours."""
    e = logged(events(spark, sf_dir), F.col("user_id")).withColumn("ts", F.col("us") / 1e6)
    fights = of(e, "signup").select(*N.KEY, F.col("seq").alias("enc_idx"), F.col("seq").cast("string").alias("name"), F.col("ts").alias("start"), (F.col("ts") + 7200).alias("end"))
    return encounters.attribute_loot(of(e, "purchase").select(*N.KEY, "seq", "ts"), fights, 0.0).select(F.col("seq").alias("lid"), "boss")


@query("""SELECT event_id, strftime(ts,'%-m/%-d %H:%M:%S.') || lpad(CAST((epoch_us(ts)//1000)%1000 AS VARCHAR),3,'0') || '  U' || translate(CAST(user_id AS VARCHAR),'0123456789','abcdefghij') || ' ''s Spell' || event_type || CASE WHEN value>50 THEN ' crits ' ELSE ' hits ' END || 'Boss for ' || CAST(CAST(round(value*100) AS BIGINT) AS VARCHAR) || '.' AS line FROM events""")
def rendered_lines(spark, sf_dir):
    return render_lines(spark, sf_dir)


def render_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as combat-log lines; digits of ids become letters, as names are letters only."""
    t = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(
            F.date_format(t, "M/d HH:mm:ss.SSS"), F.lit("  U"), F.translate(F.col("user_id").cast("string"), "0123456789", "abcdefghij"), F.lit(" 's Spell"),
            F.col("event_type"), F.when(F.col("value") > 50, " crits ").otherwise(" hits "), F.lit("Boss for "), F.round(F.col("value") * 100).cast("long").cast("string"), F.lit("."),
        ).alias("line"),
    )


def damage_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries decoded from the rendered lines."""
    lines = logged(render_lines(spark, sf_dir)).selectExpr(*N.KEY, "event_id as seq", "line as text")
    return N.raw_entries(D.decode(logs.spread(lines), ("damage",)))


@query("""SELECT 'U' || translate(CAST(user_id AS VARCHAR),'0123456789','abcdefghij') AS player, 'Spell' || event_type AS ability, CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS total, count(*) AS hits,
count(*) FILTER (WHERE value > 50) AS crits, CAST(coalesce(sum(CAST(round(value*100) AS BIGINT)) FILTER (WHERE value > 50), 0) AS BIGINT) AS crit_total FROM events GROUP BY 1, 2""")
def round_trip_decode(spark, sf_dir):
    return aggregates.damage_done(damage_entries(spark, sf_dir)).select("player", "ability", "total", "hits", "crits", "crit_total")


@query("""SELECT 'U' || translate(CAST(user_id AS VARCHAR),'0123456789','abcdefghij') AS player, CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS total,
rank() OVER (ORDER BY sum(CAST(round(value*100) AS BIGINT)) DESC) AS rnk, round(100 * sum(CAST(round(value*100) AS BIGINT))::DOUBLE / (sum(sum(CAST(round(value*100) AS BIGINT))) OVER ())::DOUBLE, 4) AS pct FROM events GROUP BY 1""")
def damage_meter(spark, sf_dir):
    e = damage_entries(spark, sf_dir)
    totals = e.where("kind = 'Damage'").groupBy(*N.KEY, F.col("source").alias("player")).agg(F.sum("amount").alias("damage")).withColumn("pet_damage", F.lit(0)).withColumn("damage_taken", F.lit(0))
    span = logged(spark.range(1)).select(*N.KEY, F.lit(30.0 * 86400).alias("duration"))
    meter = reports.damage_meter(totals, totals.select(*N.KEY, F.col("player").alias("name")), span)
    return meter.select("player", F.col("value").alias("total"), F.col("rank").cast("long").alias("rnk"), F.round("pct", 4).alias("pct"))


@query("""SELECT event_id, (month(ts) * 31 + day(ts)) * 86400 * 1000 + (epoch_us(date_trunc('millisecond', ts)) - epoch_us(date_trunc('day', ts))) // 1000 AS ms FROM events""")
def decoded_clock(spark, sf_dir):
    return render_lines(spark, sf_dir).select("event_id", F.round(D.parse_ts(F.col("line")) * 1000).cast("long").alias("ms"))


IGNORED = ("new bolt", "hot rod")
EXACT = {"Tool": ("cold anvil", "hot bolt", "blue rod", "small anvil", "large ring"), "Part": ("new widget", "red gizmo", "cold gear", "hot plate", "blue ring")}


@query(f"""SELECT p_partkey, CASE {" ".join(f"WHEN p_name IN {names} THEN '{label}'" for label, names in EXACT.items())} WHEN p_name LIKE 'small %' THEN 'Scroll' ELSE 'Other' END AS category
FROM part WHERE p_name NOT IN {IGNORED} OR p_name IS NULL""")
def item_lookup(spark, sf_dir):
    """All parts: ignored ones drop out, then exact names, then a prefix, then Other."""
    items = [(i, None, None, False, True) for i in IGNORED] + [(i, k, label, False, False) for k, (label, names) in enumerate(EXACT.items()) for i in names] + [("small ", 7, "Scroll", True, False)]
    dims = spark.createDataFrame(items, "item string, category int, label string, prefix boolean, ignored boolean")
    other = spark.createDataFrame([(8, "Other", "Other")], "category int, name string, label string")
    return lookups.classify_items(table(spark, sf_dir, "part"), "p_name", dims, other).select("p_partkey", F.col("label").alias("category"))


@query("""SELECT n_nationkey, lower(r_name) AS zone, CASE lower(r_name) WHEN 'asia' THEN 'east' ELSE lower(r_name) END AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey""")
def zone_lookup(spark, sf_dir):
    joined = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    aliases = spark.createDataFrame([("asia", "east")], "alias string, canonical string")
    return lookups.normalize_zone(joined, "r_name", aliases).select("n_nationkey", F.lower("r_name").alias("zone"), F.col("zone").alias("canonical"))


@query(f"""{E}, f AS (SELECT user_id, min(seq) AS first FROM e WHERE event_type = 'signup' GROUP BY 1) SELECT e.seq, e.user_id, e.event_type FROM e JOIN f ON e.user_id = f.user_id AND e.seq > f.first""")
def asof_roster_gate(spark, sf_dir):
    e = logged(events(spark, sf_dir))
    players = of(e, "signup").groupBy(*N.KEY, F.col("user_id").alias("name")).agg(F.min("seq").alias("first_seen_seq"))
    return N.known(e, players, "user_id", "met").where("met").select("seq", "user_id", "event_type")


@query(f"""{E}, r AS (SELECT *, lag(event_type) OVER w AS pt, lag(us) OVER w AS pus FROM e WHERE event_type IN ('signup','error') WINDOW w AS (PARTITION BY user_id ORDER BY us, seq))
SELECT CAST(user_id AS VARCHAR) AS player, pus AS s_us, us AS e_us, us - pus AS len FROM r WHERE event_type = 'error' AND pt = 'signup' AND us - pus > 3600000000""")
def combat_windows(spark, sf_dir):
    state = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "end")
    marks = N.combat_marks(logged(events(spark, sf_dir), F.col("user_id")).select(*N.KEY, F.col("us").alias("seq"), F.col("us").alias("ts"), state.alias("combat")))
    return encounters.combat_windows(marks).selectExpr("log_id as player", "start as s_us", "end as e_us", "end - start as len").where("len > 3600000000")


@query(f"""{E}, s AS (SELECT seq AS id, user_id, us FROM e WHERE event_type='signup'), p AS (SELECT user_id, seq, us FROM e WHERE event_type='purchase'),
j AS (SELECT id, s.user_id, s.us AS st, p.us, p.seq, p.us - coalesce(lag(p.us) OVER (PARTITION BY id ORDER BY p.us, p.seq), s.us) AS gap FROM s JOIN p ON s.user_id = p.user_id AND p.us > s.us AND p.us <= s.us + {3 * DAY}),
b AS (SELECT *, sum(CASE WHEN gap > {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY us, seq) AS br FROM j)
SELECT id, max(us) AS last_us, count(*) AS n FROM b WHERE br = 0 GROUP BY 1""")
def activity_walk(spark, sf_dir):
    e = events(spark, sf_dir)
    starts = of(e, "signup").select(F.col("seq").alias("id"), "user_id", F.col("us").alias("end"), (F.col("us") + 3 * DAY).alias("ceiling"))
    acts = of(e, "purchase").select("user_id", "seq", F.col("us").alias("ts"))
    return encounters.walk_activity(acts, starts, KEY, "id", 6 * HOUR, 3 * DAY).select("id", F.col("last_ts").alias("last_us"), "n")


@query(f"""WITH l AS (SELECT o_orderkey AS loot, o_custkey AS who, epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01') + (SELECT min(epoch_us(ts)) FROM events) AS t FROM orders),
t AS (SELECT event_id AS trade, user_id AS who, epoch_us(ts) AS t FROM events WHERE event_type='purchase'),
f AS (SELECT trade, arg_min(loot, (l.t, loot)) AS loot FROM t JOIN l ON t.who = l.who AND l.t <= t.t GROUP BY 1)
SELECT loot, max(trade) AS trade FROM f GROUP BY 1""")
def linked_trades(spark, sf_dir):
    e = events(spark, sf_dir)
    begin = e.agg(F.min("us").alias("b"))
    loot = table(spark, sf_dir, "orders").crossJoin(F.broadcast(begin)).select(
        F.col("o_orderkey").alias("loot"), F.col("o_custkey").alias("who"), (micros("o_orderdate") - F.lit(788918400000000) + F.col("b")).alias("loot_ts")
    )
    trades = of(e, "purchase").select(F.col("seq").alias("trade"), F.col("user_id").alias("who"), F.col("us").alias("trade_ts"))
    return encounters.link_trades(loot, trades, ["who"], "loot", "trade").select("loot", "trade")


@query("""WITH b AS (SELECT *, NOT (o_orderstatus <> 'F' AND (o_orderkey % 10)::DOUBLE / 10 < 0.5) AS boss FROM orders)
SELECT o_orderkey, CASE WHEN boss THEN row_number() OVER (PARTITION BY o_custkey, lower(o_orderstatus), boss ORDER BY epoch_us(o_orderdate), o_orderkey) END AS attempt FROM b""")
def attempt_numbers(spark, sf_dir):
    """Orders as boss fights: F is a kill, and of ten players the key's last digit died; the ratio test comes before numbering."""
    o = logged(table(spark, sf_dir, "orders"), F.col("o_custkey")).select(
        *N.KEY, "o_orderkey", F.struct(micros("o_orderdate"), "o_orderkey").alias("enc_idx"), F.col("o_orderstatus").alias("name"), F.lit(True).alias("is_boss"),
        (F.col("o_orderstatus") == "F").alias("is_kill"), F.lit(10).alias("active_players"), (F.col("o_orderkey") % 10).alias("player_deaths"),
    )
    return encounters.number_attempts(encounters.demote_resets(o)).select("o_orderkey", F.col("attempt").cast("long").alias("attempt"))


@query("""WITH w AS (SELECT epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + 3 * 86400000000 AS e FROM orders WHERE o_orderstatus = 'P')
SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice*100) AS BIGINT) AS amt FROM lineitem WHERE EXISTS (SELECT 1 FROM w WHERE epoch_us(l_shipdate) BETWEEN s AND e)""")
def selection_semi_join(spark, sf_dir):
    """Lines shipped within three days of any pending order."""
    spans = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(micros("o_orderdate").alias("start"), (micros("o_orderdate") + 3 * DAY).alias("end"))
    rows = table(spark, sf_dir, "lineitem").withColumn("ts", micros("l_shipdate"))
    return selection.in_windows(rows, spans, [], 3 * DAY).select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("amt"))


@query(f"""{E}, f AS (SELECT *, us - min(us) OVER (PARTITION BY user_id) AS delay, row_number() OVER (PARTITION BY user_id ORDER BY us, seq) AS rn FROM e)
SELECT user_id, seq, delay, CAST(rn AS BIGINT) AS rn FROM f WHERE delay <= {DAY} AND rn <= 8""")
def opener(spark, sf_dir):
    return selection.opener(events(spark, sf_dir), KEY, "us", "seq", DAY, 8).select("user_id", "seq", "delay", F.col("rn").cast("long").alias("rn"))


BUCKETS = f"""{E}, g AS (SELECT user_id, us // {HOUR} AS b, sum(amt) AS total, arg_max(amt, (us, seq)) AS last FROM e GROUP BY 1, 2),
a AS (SELECT user_id, unnest(range(min(b), max(b) + 1)) AS b FROM g GROUP BY 1)"""


@query(f"""{BUCKETS} SELECT a.user_id, a.b, CAST(coalesce(total, 0) AS BIGINT) AS total, last_value(last IGNORE NULLS) OVER (PARTITION BY a.user_id ORDER BY a.b) AS level FROM a LEFT JOIN g ON a.user_id = g.user_id AND a.b = g.b""")
def dense_filled_buckets(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("b", F.floor(F.col("us") / HOUR))
    d = K.dense_buckets(e, KEY, "b", {"total": F.sum("amt"), "last": F.max_by("amt", F.struct("us", "seq"))})
    return K.asof_last(d, KEY, ["b"], F.col("last"), "level").select("user_id", "b", F.coalesce("total", F.lit(0)).alias("total"), "level")


@query("""WITH RECURSIVE x AS (SELECT epoch_us(ts) // 86400000000 AS day, event_id AS seq, CASE event_type WHEN 'error' THEN -1 ELSE 1 END AS d,
row_number() OVER (PARTITION BY epoch_us(ts) // 86400000000 ORDER BY epoch_us(ts), event_id) AS k FROM events WHERE event_type IN ('error','signup')),
r AS (SELECT day, seq, k, greatest(0, least(40, 40 + d)) AS level FROM x WHERE k = 1
UNION ALL SELECT x.day, x.seq, x.k, greatest(0, least(40, r.level + x.d)) FROM r JOIN x ON x.day = r.day AND x.k = r.k + 1)
SELECT day, seq, CAST(level AS BIGINT) AS level FROM r""")
def alive_fold(spark, sf_dir):
    e = of(events(spark, sf_dir), "error", "signup").withColumn("day", F.floor(F.col("us") / DAY)).withColumn("d", F.when(F.col("event_type") == "error", -1).otherwise(1))
    return K.clamped_fold(e, ["day"], ["us", "seq"], "d", 0, 40, 40).select("day", "seq", "level")


ABILITY = """WITH a AS (SELECT l_suppkey, l_returnflag, sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS total, count(*) AS hits, count(*) FILTER (WHERE l_linestatus='F') AS crits,
coalesce(sum(CAST(round(l_extendedprice*100) AS BIGINT)) FILTER (WHERE l_linestatus='F'), 0) AS crit_total FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, CAST(total AS BIGINT) AS total, hits, crits, CASE WHEN hits > crits THEN CAST(greatest(total - crit_total, 0) // (hits - crits) AS BIGINT) END AS avg_hit,
CASE WHEN crits > 0 THEN CAST(crit_total // crits AS BIGINT) END AS avg_crit, round(100.0::DOUBLE * total::DOUBLE / (sum(total) OVER (PARTITION BY l_suppkey))::DOUBLE, 4) AS pct FROM a"""


@query(ABILITY)
def ability_breakdown(spark, sf_dir):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    a = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.sum(cents).alias("total"), F.count("*").alias("hits"), F.count_if(F.col("l_linestatus") == "F").alias("crits"),
        F.coalesce(F.sum(F.when(F.col("l_linestatus") == "F", cents)), F.lit(0)).alias("crit_total"),
    )
    return reports.with_averages(a, ["l_suppkey"]).select("l_suppkey", "l_returnflag", "total", "hits", "crits", "avg_hit", "avg_crit", F.round("pct", 4).alias("pct"))


@query("""WITH a AS (SELECT l_suppkey, l_partkey, sum(CAST(round(l_quantity) AS BIGINT)) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS rn FROM a) SELECT l_suppkey, l_partkey, CAST(n AS BIGINT) AS n FROM r WHERE rn <= 5""")
def top_targets(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.round("l_quantity").cast("long")).alias("n"))
    return reports.top(a, ["l_suppkey"], [F.desc("n"), F.asc("l_partkey")], 5)


@query(f"{E} SELECT seq, us, user_id FROM e WHERE event_type = 'click' ORDER BY us DESC, seq DESC LIMIT 500")
def event_browser(spark, sf_dir):
    return reports.last_rows(logged(of(events(spark, sf_dir), "click")), N.KEY, ["us", "seq"], 500).select("seq", "us", "user_id")


@query(f"""{E}, d AS (SELECT seq AS death, user_id, us FROM e WHERE event_type='error')
SELECT e.seq, arg_min(death, (d.us, death)) AS death, min(d.us) - any_value(e.us) AS to_death FROM e JOIN d ON e.user_id = d.user_id AND e.us BETWEEN d.us - {3 * HOUR} AND d.us GROUP BY e.seq""")
def death_windows(spark, sf_dir):
    e = logged(events(spark, sf_dir)).select(*N.KEY, "seq", F.lit(1).alias("sub"), F.col("us").alias("ts"), "event_type", F.col("user_id").cast("string").alias("source"), F.lit(None).cast("string").alias("target"))
    deaths = of(e, "error").select(*N.KEY, "seq", "ts", F.col("source").alias("player"))
    return reports.death_replay(e, deaths, None, 3 * HOUR).select("seq", "death", F.col("to_death").cast("long").alias("to_death"))


@query("""WITH f AS (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY 1)
SELECT p.p_brand, p.p_partkey, CAST(row_number() OVER (ORDER BY f.first, p.p_size DESC, p.p_name, p.p_partkey) AS BIGINT) AS pos FROM part p JOIN f ON p.p_brand = f.p_brand""")
def loot_by_boss(spark, sf_dir):
    loot = logged(table(spark, sf_dir, "part")).select(*N.KEY, F.col("p_brand").alias("boss"), F.col("p_size").alias("quality"), F.col("p_name").alias("item_name"), F.col("p_partkey").alias("seq"))
    return reports.loot_by_boss(loot, notable=False).select(F.col("boss").alias("p_brand"), F.col("seq").alias("p_partkey"), F.col("pos").cast("long").alias("pos"))


@query(f"""{E} SELECT user_id, {", ".join(f"count(*) FILTER (WHERE event_type='{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view"))} FROM e GROUP BY 1""")
def consumable_matrix(spark, sf_dir):
    uses = logged(events(spark, sf_dir)).select(*N.KEY, F.col("user_id").alias("player"), F.col("event_type").alias("label"))
    return reports.consumable_matrix(uses, ["click", "error", "purchase", "signup", "view"]).drop("log_id", "session_id").withColumnRenamed("player", "user_id")


def uses_by_month_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uses of consumables, in a log for each half of the time."""
    e = events(spark, sf_dir).withColumn("half", F.when(F.col("us") < 1705276800000000, "first").otherwise("second"))
    return logged(e, F.col("half")).select(*N.KEY, F.col("user_id").cast("string").alias("player"), F.col("event_type").alias("category"), F.when(F.col("amt") > 5000, "large").otherwise("small").alias("consumable"))


@query("""WITH u AS (SELECT CASE WHEN epoch_us(ts) < 1705276800000000 THEN 'first' ELSE 'second' END AS log, CAST(user_id AS VARCHAR) AS p, event_type AS c,
CASE WHEN CAST(round(value*100) AS BIGINT) > 5000 THEN 'large' ELSE 'small' END AS i FROM events),
g AS (SELECT log, p, c, i, count(*) AS n FROM u GROUP BY GROUPING SETS ((log, p, c, i), (log, p, c), (log, p), (log)))
SELECT log, coalesce(p, 'all') AS player, coalesce(c, 'all') AS category, coalesce(i, 'all') AS consumable, n FROM g""")
def consumable_totals(spark, sf_dir):
    told = reports.consumables_overview(uses_by_month_half(spark, sf_dir))
    return told.select(F.col("log_id").alias("log"), *[F.coalesce(c, F.lit("all")).alias(c) for c in ("player", "category", "consumable")], "n")


@query("""SELECT CASE WHEN epoch_us(ts) < 1705276800000000 THEN 'first' ELSE 'second' END AS log, CAST(user_id AS VARCHAR) AS player, count(*) AS n FROM events GROUP BY 1, 2""")
def consumables_per_player(spark, sf_dir):
    return reports.consumable_uses_by_player(uses_by_month_half(spark, sf_dir)).select(F.col("log_id").alias("log"), "player", "n")


@query("""WITH e AS (SELECT l_suppkey AS p, l_returnflag AS s, l_linestatus AS a, sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS t, count(*) AS n, count(*) FILTER (WHERE l_quantity > 45) AS c, sum(CAST(l_linenumber AS BIGINT)) AS b FROM lineitem GROUP BY 1, 2, 3)
SELECT CAST(p AS VARCHAR) AS player, s AS source, a AS ability, CAST(t AS BIGINT) AS total, n AS hits, c AS crits, CAST(b AS BIGINT) AS mitigated, CAST(sum(t) OVER (PARTITION BY p, s) AS BIGINT) AS source_total FROM e""")
def damage_taken_by_source(spark, sf_dir):
    """Line items as damage: suppliers take it from return flags by line status; the line number is blocked."""
    e = logged(table(spark, sf_dir, "lineitem")).select(
        *N.KEY, F.lit("Damage").alias("kind"), F.col("l_suppkey").cast("string").alias("target"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("spell"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount"),
        (F.col("l_quantity") > 45).alias("is_crit"), F.lit(0).alias("absorbed"), F.lit(0).alias("resisted"), F.col("l_linenumber").cast("long").alias("blocked"), F.lit(False).alias("is_crushing"), F.lit(False).alias("is_glancing"),
    )
    return reports.taken_by_source(aggregates.damage_taken(e)).select("player", "source", "ability", "total", "hits", "crits", "mitigated", "source_total")


@query(f"""{E}, x AS (SELECT *, CASE WHEN event_type='purchase' THEN amt WHEN event_type IN ('view','click') THEN -amt ELSE 0 END AS d FROM e WHERE event_type IN ('purchase', 'view', 'click')),
s AS (SELECT *, sum(d) OVER w AS cs FROM x WINDOW w AS (PARTITION BY user_id ORDER BY us, seq)),
m AS (SELECT *, least(0, min(cs) OVER w) AS m FROM s WINDOW w AS (PARTITION BY user_id ORDER BY us, seq)),
o AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY user_id ORDER BY us, seq),0) - m AS over FROM m)
SELECT CAST(user_id AS VARCHAR) AS player, CAST(coalesce(sum(amt) FILTER (WHERE d < 0), 0) AS BIGINT) AS healing, CAST(coalesce(sum(over), 0) AS BIGINT) AS overheal,
CAST(coalesce(sum(amt) FILTER (WHERE d < 0), 0) - coalesce(sum(over), 0) AS BIGINT) AS effective, CAST(coalesce(sum(amt) FILTER (WHERE event_type = 'purchase'), 0) AS BIGINT) AS damage_taken FROM o GROUP BY 1""")
def healing_totals(spark, sf_dir):
    """Effective healing of users by themselves, from the entries on, rolled up to totals as for a selection of all."""
    e = of(logged(events(spark, sf_dir)), "purchase", "view", "click").where("amt is not null")
    hurt = F.col("event_type") == "purchase"
    me = F.col("user_id").cast("string")
    e = e.select(
        *N.KEY, F.col("us").alias("seq"), F.lit(1).alias("sub"), (F.col("us") / 1e6).alias("ts"), F.when(hurt, "Damage").otherwise("Healing").alias("kind"), F.when(hurt, "Boss").otherwise(me).alias("source"), me.alias("target"),
        F.col("event_type").alias("spell"), F.col("amt").alias("amount"), F.lit(0).alias("reset_id"), F.lit(True).alias("target_known"), F.lit(False).alias("is_pet_spell"), F.lit(False).alias("is_crit"), F.lit(False).alias("is_crushing"),
        F.lit(False).alias("is_glancing"), *[F.lit(0).alias(c) for c in ("absorbed", "resisted", "blocked")],
    )
    fight = logged(spark.range(1)).select(*N.KEY, F.lit(1).alias("enc_idx"))
    players = e.select(*N.KEY, F.col("target").alias("name"), F.lit(0).alias("first_seen_seq")).distinct()
    totals = selection.filtered_stats(N.with_effective_healing(e), fight, players)["totals"]
    return totals.where("player <> 'Boss'").select("player", "healing", "overheal", "effective", "damage_taken")


@query("""SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license')""")
def text_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(selection.text_matches("text", "LICENSE")).select("doc_id", "source")


@query(f"""{E}, r AS (SELECT *, coalesce(sum(us_len) OVER (PARTITION BY user_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, {2 * HOUR} AS us_len FROM e WHERE event_type='signup'))
SELECT p.seq, r.seq AS enc, CAST(p.us - r.us + before AS BIGINT) AS at FROM (SELECT * FROM e WHERE event_type='purchase') p JOIN r ON p.user_id = r.user_id AND p.us BETWEEN r.us AND r.us + {2 * HOUR}""")
def concatenated_axis(spark, sf_dir):
    e = events(spark, sf_dir)
    spans = of(e, "signup").select("user_id", F.col("seq").alias("enc_idx"), F.col("us").alias("start"), (F.col("us") + 2 * HOUR).alias("end"))
    acts = of(e, "purchase").select("user_id", "seq", F.col("us").alias("ts"))
    return timeline.concatenated_offset(acts, spans, KEY, 2 * HOUR).select("seq", F.col("enc_idx").alias("enc"), F.col("offset").cast("long").alias("at"))


@query("""WITH b AS (SELECT CAST(user_id AS VARCHAR) AS player, event_type FROM events) SELECT player, count(DISTINCT event_type) AS n FROM b GROUP BY 1
UNION ALL SELECT 'all', count(DISTINCT event_type) FROM b""")
def distinct_buffs(spark, sf_dir):
    """Kinds of events as auras gained."""
    e = logged(events(spark, sf_dir)).select(*N.KEY, F.col("us").alias("seq"), F.col("us").alias("ts"), F.lit("AuraGain").alias("kind"), F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("spell"))
    return reports.distinct_buffs(aggregates.buff_stats(e)).select(F.coalesce("player", F.lit("all")).alias("player"), "n")


_LETTERED = "'U' || translate(CAST(user_id AS VARCHAR),'0123456789','abcdefghij')"


@query(f"""WITH m AS (SELECT event_id, CAST(user_id AS BIGINT) % 7 AS log, CASE WHEN event_type = 'signup' THEN {_LETTERED} END AS me, 'Spell' || event_type AS spell, CAST(CAST(round(value*100) AS BIGINT) AS VARCHAR) AS amt FROM events),
w AS (SELECT *, coalesce(last_value(me IGNORE NULLS) OVER (PARTITION BY log ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(me IGNORE NULLS) OVER (PARTITION BY log ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS who FROM m)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN coalesce(who, '?') || ' ''s ' || spell || ' hits Boss for ' || amt || '.' WHEN 1 THEN 'Boss hits ' || who || ' for ' || amt || '.'
ELSE who || ' gains ' || spell || ' (1).' END AS line FROM w WHERE me IS NULL AND who IS NOT NULL""")
def normalised_lines(spark, sf_dir):
    """Events told in the first person, in seven logs; signups are roster lines of the recording player."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    name = F.concat(F.lit("u"), F.translate(F.col("user_id").cast("string"), "0123456789", "abcdefghij"))
    spell, amt = F.concat(F.lit("Spell"), "event_type"), F.round(F.col("value") * 100).cast("long").cast("string")
    roster = F.concat(F.lit("COMBATANT_INFO: 1.1.24 0:0:0&"), name, F.lit("&MAGE&Human&2&nil&nil&nil&nil&" + "nil&" * 19 + "1}2}3&0x1&nil"))
    told = (
        F.when(F.col("event_type") == "signup", roster).when(F.col("event_id") % 3 == 0, F.concat(F.lit("Your "), spell, F.lit(" hits Boss for "), amt, F.lit(".")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("Boss hits you for "), amt, F.lit("."))).otherwise(F.concat(F.lit("You gain "), spell, F.lit(" (1).")))
    )
    lines = logged(e, F.col("user_id") % 7).select(*N.KEY, F.col("event_id").alias("seq"), F.concat(F.lit("1/2 3:4:5.678  "), told).alias("text"))
    known = lines.where("contains(text, 'COMBATANT_INFO')").select("log_id").distinct()
    clean = normalise.normalise(logs.spread(lines.join(known, "log_id", "left_semi"))).where("not contains(text, 'COMBATANT_INFO')")
    return clean.select(F.col("seq").alias("event_id"), F.expr("substring(text, 16)").alias("line"))


@query("""WITH RECURSIVE m AS (SELECT epoch_us(ts) // 86400000000 AS log, epoch_us(ts) AS us, event_id, CASE event_type WHEN 'signup' THEN 'z' WHEN 'purchase' THEN 'b' WHEN 'click' THEN 's' ELSE 'o' END AS t,
CASE event_type WHEN 'signup' THEN ['bog', 'mire', 'town'][CAST(user_id % 3 AS INT) + 1] WHEN 'purchase' THEN ['bog', 'mire'][CAST(user_id // 5 % 2 AS INT) + 1] END AS v FROM events),
o AS (SELECT *, row_number() OVER w AS k, coalesce(us - lag(us) OVER w > 1800000000, TRUE) AS gap FROM m WINDOW w AS (PARTITION BY log ORDER BY us, event_id)),
r AS (SELECT log, us, event_id, t, v, k, 1 AS n, CASE WHEN t = 'z' AND v <> 'town' THEN v END AS z, CASE WHEN t = 'b' THEN v END AS i FROM o WHERE k = 1
UNION ALL SELECT o.log, o.us, o.event_id, o.t, o.v, o.k, r.n + CASE WHEN gap OR split THEN 1 ELSE 0 END,
  CASE WHEN o.t = 'z' AND o.v <> 'town' THEN o.v WHEN gap OR split THEN NULL ELSE r.z END, CASE WHEN o.t = 'b' THEN o.v WHEN gap OR split THEN NULL ELSE r.i END
  FROM r JOIN (SELECT *, k - 1 AS before FROM o) o ON r.log = o.log AND r.k = o.before, LATERAL (SELECT NOT gap AND CASE WHEN o.t = 'z' AND o.v <> 'town' THEN coalesce(r.z, '') <> o.v
    WHEN o.t = 'b' AND r.i IS NOT NULL THEN r.i <> o.v WHEN o.t = 'b' AND r.z IS NOT NULL THEN r.z <> o.v ELSE FALSE END AS split)),
g AS (SELECT log, n, min(us) AS s_us, max(us) AS e_us, count(*) FILTER (WHERE t = 's') AS combats, count(*) FILTER (WHERE t = 'b') AS kills, CASE WHEN count(DISTINCT v) FILTER (WHERE t = 'b') = 1 THEN min(v) FILTER (WHERE t = 'b') END AS kz,
  arg_max(v, k) FILTER (WHERE t = 'z' AND v <> 'town') AS rz, arg_max(v, k) FILTER (WHERE t = 'z') AS az FROM r GROUP BY 1, 2),
f AS (SELECT *, coalesce(kz, rz, az, 'unknown') AS zone FROM g WHERE combats > 0)
SELECT CAST(log AS VARCHAR) AS log, CAST(n AS BIGINT) AS session_no, zone, zone IN ('bog', 'mire') AS is_raid, s_us, e_us, combats, kills,
CASE WHEN zone = 'town' THEN 'Town' WHEN zone = 'unknown' THEN 'Unknown' WHEN kills >= 4 THEN upper(zone[1]) || zone[2:] || ' Full Clear' WHEN kills > 0 THEN upper(zone[1]) || zone[2:] || ' (' || kills || '/4)' ELSE upper(zone[1]) || zone[2:] || ' (wipes)' END AS name FROM f""")
def session_table(spark, sf_dir):
    """Sessions of each day's events: signups are zone changes, purchases boss kills, clicks starts of combats."""
    e = events(spark, sf_dir).where("user_id is not null")
    kind = F.expr("case event_type when 'signup' then 'zone' when 'purchase' then 'boss_kill' when 'click' then 'combat_start' when 'error' then 'combat_end' else 'player' end")
    zone, boss = F.expr("array('bog', 'mire', 'town')[user_id % 3]"), F.expr("array('bog', 'mire')[user_id div 5 % 2]")
    marks = e.select(
        F.floor(F.col("us") / DAY).cast("string").alias("log_id"), "seq", (F.col("us") / 1e6).alias("ts"), kind.alias("type"),
        F.when(kind == "zone", zone).otherwise("x").alias("name"), F.when(kind == "boss_kill", boss).alias("instance"),
    )
    zones = spark.createDataFrame([("bog", True, False, False, 4), ("mire", True, False, False, 4), ("town", False, False, True, None)], "zone string, is_instance boolean, is_dungeon boolean, is_overworld boolean, encounter_count int")
    s = sessions.sessions(sessions.number_sessions(marks, zones), zones)
    us = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return s.select(F.col("log_id").alias("log"), "session_no", "zone", "is_raid", us("start_time").alias("s_us"), us("end_time").alias("e_us"), F.col("combat_count").alias("combats"), F.col("kill_count").alias("kills"), "name")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS player, event_type AS t, CAST(round(value*100) AS BIGINT) AS amt FROM events)
SELECT player, count(*) FILTER (WHERE t = 'click') AS dodges, count(*) FILTER (WHERE t = 'view') AS parries, count(*) FILTER (WHERE t = 'signup') AS missed_by, count(*) FILTER (WHERE t = 'purchase' AND amt % 2 = 0) AS full_absorbs,
CAST(coalesce(sum(amt) FILTER (WHERE t = 'purchase'), 0) AS BIGINT) AS absorbed, count(*) FILTER (WHERE t IN ('click', 'view', 'signup')) AS total FROM e GROUP BY 1 HAVING count(*) FILTER (WHERE t IN ('click', 'view', 'signup')) > 0""")
def avoidance_table(spark, sf_dir):
    """Clicks are dodges, views parries, signups misses; purchases are damage that is absorbed, an even amount in full."""
    e = logged(events(spark, sf_dir)).withColumn("player", F.col("user_id").cast("string"))
    kind = F.expr("case event_type when 'click' then 'dodge' when 'view' then 'parry' when 'signup' then 'missed_by' end")
    hits = of(e, "purchase").select(*N.KEY, F.lit("Damage").alias("kind"), F.col("player").alias("target"), F.lit(True).alias("target_known"), F.col("amt").alias("absorbed"), (F.col("amt") % 2 == 0).alias("is_fully_absorbed"), F.lit(False).alias("is_fully_resisted"), F.lit(False).alias("is_fully_blocked"))
    table_of = reports.avoidance_totals(aggregates.avoidance(e.select(*N.KEY, "player", kind.alias("kind")).where("kind is not null"), hits))
    out = table_of.join(aggregates.absorbs(hits), [*N.KEY, "player"], "left")
    return out.select("player", "dodges", "parries", "missed_by", "full_absorbs", F.coalesce("absorbed", F.lit(0)).alias("absorbed"), "total")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS player, event_type AS t, epoch_us(ts) AS us FROM events WHERE event_type IN ('view', 'click'))
SELECT player, count(*) FILTER (WHERE t = 'view') AS gains, count(*) FILTER (WHERE t = 'click') AS fades, min(us) FILTER (WHERE t = 'view') AS first_gain, max(us) FILTER (WHERE t = 'click') AS last_fade FROM e GROUP BY 1""")
def buff_table(spark, sf_dir):
    e = logged(of(events(spark, sf_dir), "view", "click")).select(*N.KEY, F.col("us").alias("seq"), F.col("us").alias("ts"), F.when(F.col("event_type") == "view", "AuraGain").otherwise("AuraFade").alias("kind"), F.col("user_id").cast("string").alias("source"), F.lit("Might").alias("spell"))
    return aggregates.buff_stats(e).select("player", "gains", "fades", "first_gain", "last_fade")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS player, CASE WHEN event_type = 'click' THEN 'Bite (dot)' WHEN event_type = 'view' THEN 'Bite' ELSE 'Claw' END AS ability, event_type = 'view' AND event_id % 5 = 0 OR event_type = 'purchase' AND event_id % 9 = 0 OR event_type = 'click' AND event_id % 11 = 0 AS pet,
  event_id AS seq, CAST(round(value*100) AS BIGINT) AS amt FROM events WHERE event_type IN ('view', 'click', 'purchase')),
b AS (SELECT player, min(seq) FILTER (WHERE ability = 'Bite' AND pet) AS tag, min(seq) FILTER (WHERE ability = 'Bite (dot)' AND pet) AS tick FROM e GROUP BY 1),
f AS (SELECT e.*, pet OR (ability = 'Bite (dot)' AND tag IS NOT NULL AND (tick IS NULL OR tick > tag OR seq > tag)) AS moved FROM e JOIN b USING (player))
SELECT player, ability, CAST(sum(amt) AS BIGINT) AS total, CAST(coalesce(sum(amt) FILTER (WHERE moved), 0) AS BIGINT) AS pet_total, bool_or(moved) AS is_pet FROM f GROUP BY 1, 2""")
def pet_damage(spark, sf_dir):
    """Views and clicks are hits and ticks of a spell that some lines tag as a pet's; ticks move over with it."""
    e = logged(of(events(spark, sf_dir), "view", "click", "purchase"))
    tagged = F.expr("event_type = 'view' and seq % 5 = 0 or event_type = 'purchase' and seq % 9 = 0 or event_type = 'click' and seq % 11 = 0")
    spell = F.expr("case event_type when 'click' then 'Bite (dot)' when 'view' then 'Bite' else 'Claw' end")
    hits = e.select(*N.KEY, "seq", F.lit("Damage").alias("kind"), F.col("user_id").cast("string").alias("source"), spell.alias("spell"), F.col("amt").alias("amount"), F.lit(False).alias("is_crit"), tagged.alias("is_pet_spell"))
    return aggregates.damage_done(hits).select("player", "ability", "total", "pet_total", "is_pet")
