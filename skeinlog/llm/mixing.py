"""Operator 2: mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each source gets a target number of words, that is a mean number of copies of its documents. Whole copies are allotted for
certain; the rest of the target is filled by a sample in which documents have chances of their own: a chance grows with the
square root of the document's size (in classes of powers of two), and where it reaches 1 the copy is certain too. Documents
are ranked by their random odds divided by their inclusion odds, and taken in that order while they fit; what is missing then is
filled by later ones that still fit, a few times over, and the one that comes nearest to the rest is added. Random numbers are
digests of the ids, so reruns agree.

A source may hold any share of the rows. Ranks are summed in two levels: cells of equal width in the logarithm of the ratio of
odds, as many as the source's rows ask for, then the rows in a cell. What is drawn comes down to one row for each source and
class, and to a few places in the source's order, by which each row then finds its own copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, word_count


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """Targets by source, from rows (source, size): (source, source_size, target), as many rows as sources.

    Sources by code point, null last, get the weights in turn and share the total of all sizes; a target stops at cap
    times its source's size, and the excess is shared again by weight until none is above. This has a closed form: sources
    reach their cap in order of cap * size / weight, so running sums in that order tell which do.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    up = W.orderBy("at_cap", "source").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("w", w)
        .withColumn("at_cap", F.col("source_size") * cap / F.col("w"))
        .withColumn("share", (F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * cap).over(up), F.lit(0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(up), F.lit(0))))
        .withColumn("capped", F.col("at_cap") <= F.col("share"))
        .withColumn("level", F.coalesce(F.max(F.when(~F.col("capped"), F.col("share"))).over(whole), F.lit(0.0)))
        .select("source", "source_size", F.when(F.col("capped"), F.col("source_size") * float(cap)).otherwise(F.col("level") * F.col("w")).alias("target"))
    )


def _random(id_col, seed: str) -> F.Column:
    """48 bits of a digest of the id."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")


def _odds(u: F.Column, p: F.Column) -> F.Column:
    """Random odds divided by inclusion odds."""
    r = (u + 0.5) / F.lit(float(1 << 48))
    return r / (1 - r) * (1 - p) / p


def _class(size: F.Column) -> F.Column:
    """Number of binary digits of a size."""
    return F.length(F.bin(size))


#: Square root of a class's scale, near enough and exact: 1, 1.5, 2, 3, 4, 6, 8 and so on.
_ROOT = "shiftleft(1L, cast(class div 2 as int)) * if(class % 2 = 0, 1.0D, 1.5D)"
#: Cells to a doubling of the ratio of odds, at least; a cell then holds at most 0.3 % of a source. And rows of a cell, about.
CELLS, CELL_ROWS = 64, 50_000


def chances(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """Chances by source and class, from rows (source, size): (source, class, n, rows, source_size, target, base, p).

    base is the number of certain copies, p the chance of one more; base * n + p * n over a source's classes is its target (n
    being a class's words). Within a source p is k times a class's root, at most 1: classes reach 1 in the order of their roots,
    so running sums from the largest class tell which do, and what k is for the others.
    """
    by_class = materialize(
        sized.where("size > 0").groupBy("source", _class(F.col("size")).alias("class")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        .withColumn("root", F.expr(_ROOT))
    )
    plan = source_targets(sized, weights, cap).withColumn("m", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    plan = materialize(plan.selectExpr("source as s", "source_size", "target", "floor(m) as whole", "target - floor(m) * source_size as rest"))
    above = W.partitionBy("source").orderBy(F.desc("class")).rowsBetween(W.unboundedPreceding, -1)
    onward = W.partitionBy("source").orderBy(F.desc("class")).rowsBetween(0, W.unboundedFollowing)
    k = (F.col("rest") - F.coalesce(F.sum("n").over(above), F.lit(0))) / F.sum(F.col("n") * F.col("root")).over(onward)
    own = W.partitionBy("source")
    return (
        by_class.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("k", k).withColumn("full", F.col("k") * F.col("root") >= 1)
        .withColumn("k", F.coalesce(F.max_by("k", F.when(~F.col("full"), F.col("class"))).over(own), F.lit(0.0)))
        .selectExpr("source", "class", "n", "rows", "source_size", "target", "whole + if(full, 1, 0) as base", "if(full, 0D, greatest(k * root, 0D)) as p")
    )


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")).withColumn("u", _random("doc_id", seed))


#: How often what is missing is filled by later documents that fit.
REFILLS = 3
_TAKEN = "exists(rounds, r -> size <= r.most and place <= r.cut)"


def _refilled(ranked: DataFrame, cuts: DataFrame) -> DataFrame:
    """cuts (s, rounds, cut, gap) after one more round: the documents behind the cut that fit into the gap, in their order, as far as
    they fit together. Sums go by cells first, so only the rows of the cells that the round reaches are sorted."""
    behind = ranked.join(cuts.select("s", "cut", "gap"), F.col("source").eqNullSafe(F.col("s"))).where("size <= gap and coalesce(place > cut, true)").drop("s", "cut")
    cells = behind.groupBy("source", "cell").agg(F.sum("size").alias("n"))
    cells = cells.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("cell")) - F.col("n")).selectExpr("source as s", "cell as c", "before")
    inside = W.partitionBy("source", "cell").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    near = behind.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).where("before <= gap")
    new = (
        near.withColumn("upto", F.sum("size").over(inside) + F.col("before")).where("upto <= gap")
        .groupBy("source").agg(F.max("place").alias("new"), F.sum("size").alias("took")).withColumnRenamed("source", "n")
    )
    return cuts.join(new, F.col("s").eqNullSafe(F.col("n")), "left").selectExpr(
        "s", "if(new is null, rounds, concat(rounds, array(struct(cast(gap as double) as most, new as cut)))) as rounds", "coalesce(new, cut) as cut", "gap - coalesce(took, 0) as gap"
    )


def _draw(sized: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """A row for each source, (s, source_size, target, classes, rounds, last): base and p by class, up to which size and place each
    round takes documents, and the place of the document added to come nearest (null: none).

    Rows with the same id and chance have one place; they are ranked as one document of all their words.
    """
    told = materialize(chances(sized, weights, cap))
    grain = told.groupBy("source").agg(F.sum("rows").alias("_n"), F.sum(F.col("n") * F.col("p")).alias("rest"))
    told = told.join(grain, told.source.eqNullSafe(grain.source)).select(told["*"], "rest", F.greatest(F.lit(CELLS), F.ceil(F.col("_n") * 0.18 / CELL_ROWS)).alias("cells"))
    some = told.where("p > 0").selectExpr("source as s", "class as c", "p", "rest", "cells")
    units = materialize(
        sized.where("size > 0").join(some, F.col("source").eqNullSafe(F.col("s")) & (_class(F.col("size")) == F.col("c"))).drop("s", "c")
        .withColumn("q", _odds(F.col("u"), F.col("p"))).withColumn("cell", F.floor(F.log2("q") * F.col("cells")))
        .groupBy("source", "cell", "q", "u", F.col("doc_id").cast("string").alias("id")).agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    )
    before = materialize(
        units.groupBy("source", "cell").agg(F.sum("size").alias("n"))
        .withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("cell")) - F.col("n")).selectExpr("source as s", "cell as c", "before")
    )
    inside = W.partitionBy("source", "cell").orderBy("q", "u", "id").rowsBetween(W.unboundedPreceding, 0)
    place = F.struct("q", "u", "id")
    ranked = materialize(
        units.withColumn("upto", F.sum("size").over(inside))
        .join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
        .select("source", "cell", place.alias("place"), "size", "rest", (F.col("upto") + F.col("before") <= F.col("rest")).alias("fits"))
    )
    cuts = materialize(
        ranked.groupBy("source").agg(F.max(F.when(F.col("fits"), F.col("place"))).alias("cut"), (F.first("rest") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0))).alias("gap"))
        .selectExpr("source as s", "if(cut is null, array(), array(struct(1e300D as most, cut as cut))) as rounds", "cut", "gap")
    )
    for _ in range(REFILLS):
        cuts = materialize(_refilled(ranked, cuts))
    off = F.abs(F.col("gap") - F.col("size"))
    last = (
        ranked.join(cuts, F.col("source").eqNullSafe(F.col("s"))).where(off < F.col("gap")).where(f"not {_TAKEN}")
        .groupBy("source").agg(F.min_by("place", F.struct(off, "place")).alias("last")).withColumnRenamed("source", "l")
    )
    classes = told.groupBy("source", "source_size", "target").agg(F.map_from_entries(F.collect_list(F.struct("class", F.struct("base", "p")))).alias("classes"))
    return (
        classes.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").join(last, F.col("source").eqNullSafe(F.col("l")), "left")
        .select(F.col("source").alias("s"), "source_size", "target", "classes", "rounds", "last")
    )


def _copies(rows: DataFrame, size: str, u: str, id_col: str, s: str, name: str) -> DataFrame:
    """Adds the copies of each row, from its source's row of _draw; names of that row's columns begin with s."""
    own = F.try_element_at(F.col(f"{s}classes"), _class(F.col(size)))
    place = F.when(own.p > 0, F.struct(_odds(F.col(u), own.p).alias("q"), F.col(u).alias("u"), F.col(id_col).cast("string").alias("id")))
    taken = _TAKEN.replace("rounds", f"{s}rounds").replace("size", size).replace("place", f"{s}place")
    more = F.coalesce(F.expr(taken), F.lit(False)) | F.coalesce(F.col(f"{s}place") == F.col(f"{s}last"), F.lit(False))
    return rows.withColumn(f"{s}place", place).withColumn(name, F.when(F.col(size) > 0, own.base + more.cast("long")).otherwise(0).cast("long"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """How often the mix takes each document: a row for each row of docs, (doc_id, source, size, source_size, target, copies, taken).

    size is the number of words of the whole text (null or blank: 0); taken is copies * size, and copies is at most cap
    rounded up. Documents without words are taken 0 times. A null source is a source of its own. Rows with the same id and
    size class in a source are taken together; a null id is ranked as the text 'null'. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    sized = materialize(_sized(docs, id_col, text_col, source_col, seed))
    drawn = materialize(_draw(sized, weights, cap))
    targets = materialize(source_targets(sized, weights, cap)).withColumnRenamed("source", "t").withColumnRenamed("source_size", "_n")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("t"))).join(drawn.drop("source_size", "target"), F.col("source").eqNullSafe(F.col("s")), "left")
    return (
        _copies(joined, "size", "u", "doc_id", "", "copies")
        .select("doc_id", "source", "size", F.col("_n").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def take_mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mix itself: each row of docs as often as mix_sources says. All columns of docs stay, whatever their names.

    The draw is one row for each source, so texts are repeated where they are, without a shuffle as long as sources are few.
    """
    drawn = materialize(_draw(materialize(_sized(docs, id_col, text_col, source_col, seed)), weights, cap)).selectExpr(
        "s as __mix_s", "classes as __mix_classes", "rounds as __mix_rounds", "last as __mix_last"
    )
    size, u = word_count(docs[f"`{text_col}`"]), _random(docs[f"`{id_col}`"], seed)
    joined = docs.select("*", size.alias("__mix_size"), u.alias("__mix_u"), docs[f"`{id_col}`"].alias("__mix_id")).join(
        drawn, F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("__mix_s"))
    )
    times = _copies(joined, "__mix_size", "__mix_u", "__mix_id", "__mix_", "__mix_times").where("__mix_times > 0")
    return times.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_times"))).alias("__mix_copy")).drop("__mix_copy")
