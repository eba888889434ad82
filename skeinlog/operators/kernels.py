"""Generic kernels for ordered event tables, as window functions and joins.

Every kernel takes the partition keys and the order as column names. Orders must be total (end in a unique column), as ties
would make results depend on the physical layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import cut


def _over(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*keys).orderBy(*order)


def _running(keys: Sequence[str], order: Sequence[str]):
    return _over(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow)


def clamped_balance(df: DataFrame, keys: Sequence[str], order: Sequence[str], delta: Column, excess: str = "excess") -> DataFrame:
    """A balance that never falls below zero: adds how much of each negative delta found nothing to take from.

    With S the running sum and M = min(0, running minimum of S), the unclamped part of step i is M(i-1) - M(i): a closed form,
    so the fold needs no per-row state.
    """
    run = _running(keys, order)
    return (
        df.withColumn("_delta", delta)
        .withColumn("_sum", F.sum("_delta").over(run))
        .withColumn("_low", F.least(F.lit(0), F.min("_sum").over(run)))
        .withColumn(excess, F.coalesce(F.lag("_low").over(_over(keys, order)), F.lit(0)) - F.col("_low"))
        .drop("_delta", "_sum", "_low")
    )


def asof_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, before: bool = False) -> DataFrame:
    """The last non-null value at or before each row (before: strictly before it)."""
    end = -1 if before else 0
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_over(keys, order).rowsBetween(W.unboundedPreceding, end)))


def asof_last_ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """asof_last for keys of any number of rows: a window inside each range of the order, and what the ranges before it end with."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.withColumn("_value", value).repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    ends = ranged.groupBy(*keys, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_last"))
    before = ends.withColumn("_before", F.last("_last", ignorenulls=True).over(_over(keys, ["_part"]).rowsBetween(W.unboundedPreceding, -1))).drop("_last")
    inside = F.last("_value", ignorenulls=True).over(_running([*keys, "_part"], order))
    return attach(ranged, before, [*keys, "_part"]).withColumn(name, F.coalesce(inside, "_before")).drop("_value", "_part", "_before")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a row for which starts is true (or null, as for the first one) begins a new run."""
    return (
        df.withColumn("_new", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0))
        .withColumn(name, F.sum("_new").over(_running(keys, order)).cast("long"))
        .drop("_new")
    )


def previous(value: str | Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.lag(value).over(_over(keys, order))


def gap_sessions(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], gap: int | float, name: str = "sid") -> DataFrame:
    """Sessions split where more than gap lies between a row and the one before."""
    return islands(df, keys, order, F.col(at) - previous(at, keys, order) > gap, name)


def lifo_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[str], opens: Column, at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs opening and closing rows so that a closing row closes the newest open one; rows: keys, start, end (null: open).

    Depth is the running sum of +1 and -1, held at zero or above; closing rows that find nothing open drop out. An opening row
    at depth d after it, and the closing row at depth d before it, belong together: the next row on the same level.
    """
    run = _running(keys, order)
    leveled = (
        df.withColumn("_d", F.when(opens, 1).otherwise(-1))
        .withColumn("_s", F.sum("_d").over(run))
        .withColumn("_m", F.least(F.lit(0), F.min("_s").over(run)))
        .withColumn("_p", F.coalesce(F.lag("_m").over(_over(keys, order)), F.lit(0)))
        .where("not (_d = -1 and _m < _p)")
        .withColumn("_level", F.when(F.col("_d") == 1, F.col("_s") - F.col("_m")).otherwise(F.col("_s") - F.col("_m") + 1))
    )
    return (
        leveled.withColumn("_end", F.lead(at).over(_over([*keys, "_level"], order)))
        .where("_d = 1")
        .select(*keys, F.col(at).alias(start), F.col("_end").alias(end))
    )


def interval_islands(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Merges overlapping and touching intervals: rows (keys, island, start, end)."""
    seen = F.max(end).over(W.partitionBy(*keys).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1))
    return (
        islands(df.withColumn("_seen", seen), keys, [start, end], F.col("_seen").isNull() | (F.col(start) > F.col("_seen")))
        .groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end))
    )


def covered_length(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", name: str = "covered") -> DataFrame:
    """Length of the union of the intervals."""
    return interval_islands(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias(name))


def range_attach(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, low: str, high: str, width: int | float, how: str = "inner") -> DataFrame:
    """Joins points with the intervals [low, high] that hold them, as an equi-join on buckets of the given width.

    An interval is listed under each bucket it touches, so choose a width near the usual length of an interval: the join then
    meets few rows that the range test throws away, and never compares all points of a key with all its intervals.
    how: inner, left or left_semi.
    """
    listed = intervals.withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long")))
    ).select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in intervals.columns], "_bucket")
    spots = points.withColumn("_spot", F.floor(F.col(at) / width).cast("long"))
    on = (F.col("_spot") == F.col("_bucket")) & F.col(at).between(F.col(low), F.col(high))
    for k in keys:
        on &= spots[k].eqNullSafe(F.col(f"_k_{k}"))
    return spots.join(listed, on, how).drop("_spot", "_bucket", *[f"_k_{k}" for k in keys])


#: Lines of a block, as a power of two: numbers of lines grow within a split of a file and jump between splits. A line is held against
#: all marks of its block (see along), so blocks are short.
BLOCK_BITS = 10


def _blocks(marks: DataFrame, of: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """For each block of lines of of, or of marks (keys, _block, _at, _value): _first, the least _at in it, and _carry, the last value in a
    block before it. The only window over a whole key runs over its blocks."""
    own = marks.groupBy(*keys, "_block").agg(F.min("_at").alias("_first"), F.max_by("_value", "_at").alias("_v"))
    none = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("_first", "_v")]
    seen = of.select(*keys, F.shiftright(F.col(at), BLOCK_BITS).alias("_block")).distinct().select(*keys, "_block", *none)
    blocks = seen.unionByName(own).groupBy(*keys, "_block").agg(F.min("_first").alias("_first"), F.first("_v", ignorenulls=True).alias("_v"))
    carry = F.last("_v", ignorenulls=True).over(_over(keys, ["_block"]).rowsBetween(W.unboundedPreceding, -1))
    return blocks.withColumn("_carry", carry).drop("_v")


def last_said(rows: DataFrame, marks: DataFrame, of: DataFrame, keys: Sequence[str], values: Sequence[str], at: str = "seq", facts: DataFrame | None = None) -> DataFrame:
    """Adds to each row what the last mark at or before its line says (null: there is none), and what facts (keys, _block, columns) say of
    its block of lines. of holds the lines.

    Like along over stretches, but marks aren't joined: rows, marks, and a row for each block with what the mark before it says,
    are dealt by block once, and a window in the block does the rest.
    """
    m = marks.select(*keys, at, F.shiftright(F.col(at), BLOCK_BITS).alias("_block"), F.struct(*values).alias("_said"))
    heads = _blocks(m.select(*keys, "_block", F.col(at).alias("_at"), F.col("_said").alias("_value")), of, keys, at).select(*keys, "_block", F.col("_carry").alias("_said"))
    told = ["_said", *(c for c in (facts.columns if facts is not None else ()) if c not in (*keys, "_block"))]
    for part in (facts,) if facts is not None else ():
        heads = heads.unionByName(part, allowMissingColumns=True)
    heads = heads.withColumn(at, F.shiftleft(F.col("_block"), BLOCK_BITS)).withColumn("_kind", F.lit(0))
    both = rows.withColumn("_block", F.shiftright(F.col(at), BLOCK_BITS)).withColumn("_kind", F.lit(2))
    both = both.unionByName(m.withColumn("_kind", F.lit(1)), allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    run = _running([*keys, "_block"], [at, "_kind"])
    both = both.select(*rows.columns, "_kind", *[F.last(c, ignorenulls=True).over(run).alias(c) for c in told]).where("_kind = 2")
    return both.select(*rows.columns, *[F.col(f"_said.{v}").alias(v) for v in values], *told[1:])


def stretches(marks: DataFrame, of: DataFrame, keys: Sequence[str], values: Sequence[str], at: str = "seq") -> DataFrame:
    """What the last mark at or before a line says, as stretches of lines: (keys, _block, _from, _to, values).

    of holds the lines; each block of lines that it has is covered without a gap, by the stretches of the block's own marks and
    by what the mark before the block says (null: there is none). So the table has a row for each mark and block, however far
    apart line numbers lie, and the only window over a whole key runs over its blocks.
    """
    size = 1 << BLOCK_BITS
    block = F.shiftright(F.col(at), BLOCK_BITS)
    last_of = F.shiftleft(F.col("_block"), BLOCK_BITS) + F.lit(size - 1)
    m = marks.select(*keys, at, *values, block.alias("_block"))
    inside = m.withColumn("_to", F.coalesce(F.lead(at).over(_over([*keys, "_block"], [at])) - 1, last_of)).select(*keys, "_block", F.col(at).alias("_from"), "_to", *values)
    blocks = _blocks(m.select(*keys, "_block", F.col(at).alias("_at"), F.struct(*values).alias("_value")), of, keys, at)
    before = blocks.select(
        *keys, "_block", F.shiftleft(F.col("_block"), BLOCK_BITS).alias("_from"), F.coalesce(F.col("_first") - 1, last_of).alias("_to"), *[F.col(f"_carry.{v}").alias(v) for v in values]
    )
    return inside.unionByName(before).where("_from <= _to")


def along(rows: DataFrame, spans: DataFrame, keys: Sequence[str], at: str = "seq") -> DataFrame:
    """Adds to each row what the stretch of its line says (see stretches, of which of must hold the rows' lines)."""
    listed = spans.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in spans.columns])
    spots = rows.withColumn("_spot", F.shiftright(F.col(at), BLOCK_BITS))
    on = (F.col("_spot") == F.col("_block")) & F.col(at).between(F.col("_from"), F.col("_to"))
    for k in keys:
        on &= spots[k].eqNullSafe(F.col(f"_k_{k}"))
    return spots.join(listed, on).drop("_spot", "_block", "_from", "_to", *[f"_k_{k}" for k in keys])


def dense_buckets(df: DataFrame, keys: Sequence[str], bucket: str, aggregates: dict[str, Column], axis: DataFrame | None = None) -> DataFrame:
    """Aggregates by bucket with every bucket of the axis present; missing values are null. axis: (keys, bucket); without one, all
    between a key's first and last."""
    grouped = df.groupBy(*keys, bucket).agg(*[v.alias(k) for k, v in aggregates.items()])
    if axis is None:
        axis = grouped.groupBy(*keys).agg(F.min(bucket).alias("_lo"), F.max(bucket).alias("_hi")).select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(bucket))
    return axis.join(grouped, [*keys, bucket], "left")


def ranked_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds each row's number in its key, and _part, a range of the order that it lies in: no task holds a whole key, only the
    rows of one range; equal rows of the order stay together."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    w = _over([*keys, "_part"], order)
    before = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(_over(keys, ["_part"]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return attach(ranged, before.drop("_n"), [*keys, "_part"]).withColumn(name, F.row_number().over(w) + F.col("_before")).drop("_before")


def attach(df: DataFrame, few: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Adds the columns of few to each row of the same keys, null keys too."""
    other = few.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in few.columns])
    on = F.lit(True)
    for k in keys:
        on &= df[k].eqNullSafe(other[f"_k_{k}"])
    return df.join(other, on, how).drop(*[f"_k_{k}" for k in keys])


def clamped_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], delta: str, low: int | str, high: int | str, begin: int | str, name: str = "level", block: int = 256) -> DataFrame:
    """A running sum held between low and high after each step; these and begin are numbers, or columns that are one for each key.

    Two clamps have no closed form as a window, but steps compose: any run of them is x -> least(high', greatest(low', x + add)).
    Each block of a key's steps (block of them, by rank) is reduced to such a triple, a key's few triples are folded to the
    level that each block begins with, and then each block is folded on its own. No array holds more than a block's steps,
    but for the triples: one for each block.
    """
    bound = lambda v: F.lit(v).cast("long") if isinstance(v, int) else F.col(v).cast("long")
    steps = ranked_within(df.select(*keys, *order, F.col(delta).cast("long").alias("_d"), bound(low).alias("_low"), bound(high).alias("_high"), bound(begin).alias("_begin")), keys, order, "_rank")
    steps = steps.withColumn("_block", F.floor((F.col("_rank") - 1) / block)).drop("_part", "_rank")
    blocks = cut(steps.groupBy(*keys, "_block", "_low", "_high", "_begin").agg(F.array_sort(F.collect_list(F.struct(*order, "_d"))).alias("_steps")))
    hold = lambda x: f"greatest(_low, least(_high, {x}))"
    triple = f"""aggregate(_steps, named_struct('a', 0L, 'l', {-(2**62)}L, 'h', {2**62}L), (t, s) ->
        named_struct('a', t.a + s._d, 'l', {hold("t.l + s._d")}, 'h', {hold("t.h + s._d")}))"""
    levels = lambda array, first, step: f"""aggregate({array}, array({first}), (acc, s) -> concat(acc, array({step.replace("x", "element_at(acc, -1)")})))"""
    heads = (
        blocks.select(*keys, "_block", "_begin", F.expr(triple).alias("_t")).groupBy(*keys, "_begin").agg(F.array_sort(F.collect_list(F.struct("_block", "_t"))).alias("_ts"))
        .withColumn("_firsts", F.expr(levels("_ts", "_begin", "least(s._t.h, greatest(s._t.l, x + s._t.a))")))
        .select(*keys, F.posexplode("_ts").alias("_at", "_z"), "_firsts").select(*keys, F.col("_z._block").alias("_block"), F.expr("_firsts[_at]").alias("_first"))
    )
    return (
        attach(blocks, heads, [*keys, "_block"])
        .withColumn("_levels", F.expr(f"slice({levels('_steps', '_first', hold('x + s._d'))}, 2, size(_steps))"))
        .select(*keys, F.explode(F.arrays_zip("_steps", "_levels")).alias("_z"))
        .select(*keys, *[F.col(f"_z._steps.{c}").alias(c) for c in order], F.col("_z._levels").alias(name))
    )


def last_match(points: DataFrame, id_cols: Sequence[str], matched: DataFrame, value: str, rank: str) -> DataFrame:
    """points with the value of the match with the largest rank; null without any."""
    best = matched.groupBy(*id_cols).agg(F.max_by(value, rank).alias(value))
    return points.join(best, list(id_cols), "left")
