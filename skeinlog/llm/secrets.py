"""Operator 9: secret scans by corpus-wide ownership frequency. DataFrame functions only.

Candidates are what fixed patterns match, and other long mixed tokens. Each candidate's digest is counted over the corpus by
distinct documents (repositories) and distinct sources (owners). A value that many owners or very many documents hold is a
widely copied example; one that stays with few owners in few documents looks live. Fixed-pattern matches are always reported,
with that verdict; other tokens only where they look live.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize

#: Kinds; order breaks ties of equal starts.
KINDS = ("assign", "access", "hex", "token")
#: Patterns in Java's syntax. Fixed values of the contract, but for the tokens; hex and tokens are whole runs of their characters.
_ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]+"
_HEX = r"[0-9a-f]{24,}"
_TOKEN = r"[A-Za-z0-9+/_-]{20,}"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: What a token must have: a digit, a capital and a small letter; or a digit and a letter, if it is of 24 letters and digits.
_MIXED = "x.value rlike '[0-9]' and (x.value rlike '[A-Z]' and x.value rlike '[a-z]' or length(x.value) >= 24 and x.value rlike '^[A-Za-z0-9]+$' and x.value rlike '[A-Za-z]')"


def _matches(kind: str, pattern: str, group: int, test: str, keep: str) -> str:
    """SQL for an array of (kind, k, gap, hit, value) of all leftmost matches that are kept or tell where others are: k numbers
    them, gap and hit are the code points before a match and in it. test: a cheap one, for texts that can't match."""
    p = _quoted(pattern)
    zipped = f"arrays_zip(regexp_extract_all(t, {p}, 0), regexp_extract_all(t, {p}, {group}), split(t, {p}, -1))"
    told = f"transform({zipped}, (z, k) -> struct('{kind}' as kind, k as k, length(z['2']) as gap, length(z['0']) as hit, z['1'] as value))"
    return f"if({test}, transform(filter({told}, x -> x.hit is not null), x -> struct(x.kind as kind, x.k as k, x.gap as gap, x.hit as hit, if({keep}, x.value, null) as value)), array())"


def _rows(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """(row, doc_id, owner, found) of each row of docs, see _matches; row numbers rows once this is written."""
    any_word = r"(?i)password|passwd|secret|token|api_?key"
    found = "concat({})".format(
        ", ".join(
            [
                _matches("assign", _ASSIGN, 1, f"t rlike {_quoted(any_word)}", "length(x.value) >= 6"),
                _matches("access", _ACCESS, 0, "contains(t, 'AKIA')", "length(x.value) >= 20"),
                _matches("hex", _HEX, 0, f"t rlike {_quoted('[0-9a-f]{24}')}", "true"),
                _matches("token", _TOKEN, 0, f"t rlike {_quoted('[A-Za-z0-9+/_-]{20}')}", _MIXED),
            ]
        )
    )
    return (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
        .select("row", "doc_id", "owner", F.expr(found).alias("found"))
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", live_owners: int = 2, live_documents: int = 10) -> DataFrame:
    """Secrets of each document: (doc_id, spans, n_live, n_example); a row for each row of docs.

    spans is an array of (kind, start, stop, value, documents, owners, live), by start, then kind in the order of KINDS; start and
    stop count code points. documents and owners count the distinct ones in which the value occurs in the whole corpus; live says
    that owners is at most live_owners and documents at most live_documents. A token that another pattern's span touches is left
    out, and so is one that isn't live.

    A null text has no secrets; a null owner counts as an owner. Rows that repeat an id are rows of their own but one document
    in the counts; rows without an id count as one document together. Other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    rows = materialize(_rows(docs, id_col, text_col, owner_col))
    # places are running sums over the matches of one text
    so_far = W.partitionBy("row", "kind").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    each = (
        rows.where("size(found) > 0").select("row", "doc_id", F.coalesce("owner", F.lit("\0")).alias("owner"), F.explode("found").alias("s"))
        .select("row", "doc_id", "owner", "s.*").withColumn("stop", F.sum(F.col("gap") + F.col("hit")).over(so_far).cast("int")).where("value is not null")
        .select("row", F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).alias("doc_id"), "owner", "kind", (F.col("stop") - F.col("hit")).alias("start"), "stop", "value", F.sha2("value", 256).alias("digest"))
    )
    each = materialize(each)
    # one row for each digest and owner (or document) before they are counted, so that a value held by all meets in no single task
    spread = materialize(
        each.select("digest", F.lit(True).alias("own"), F.col("owner").alias("x")).unionByName(each.select("digest", F.lit(False).alias("own"), F.col("doc_id").alias("x")))
        .groupBy("digest", "own", "x").agg(F.lit(1).alias("n")).groupBy("digest").agg(F.count_if("own").alias("owners"), F.count_if(~F.col("own")).alias("documents"))
    )
    judged = materialize(each.join(spread, "digest").withColumn("live", F.expr(f"owners <= {live_owners} and documents <= {live_documents}")))
    rank = "array_position(array({}), kind)".format(", ".join(f"'{k}'" for k in KINDS))
    # of the base spans before a token, the one that ends last tells whether they touch; and the next one after it
    near = W.partitionBy("row").orderBy("start", F.expr(rank))
    touched = judged.withColumn("_before", F.max(F.when(F.col("kind") != "token", F.col("stop"))).over(near.rowsBetween(W.unboundedPreceding, W.currentRow)))
    touched = touched.withColumn("_after", F.min(F.when(F.col("kind") != "token", F.col("start"))).over(near.rowsBetween(W.currentRow, W.unboundedFollowing)))
    kept = touched.where("kind <> 'token' or live and coalesce(_before <= start, true) and coalesce(_after >= stop, true)")
    merged = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.expr(f"struct(start, {rank} as rank, kind, stop, value, documents, owners, live)"))).alias("kept")).withColumnRenamed("row", "r")
    none = "cast(array() as array<struct<start:int,rank:bigint,kind:string,stop:int,value:string,documents:bigint,owners:bigint,live:boolean>>)"
    return rows.select("row", "doc_id").join(merged, F.col("row") == F.col("r"), "left").select("doc_id", F.expr(f"coalesce(kept, {none})").alias("kept")).selectExpr(
        "doc_id",
        "transform(kept, x -> struct(x.kind as kind, x.start as start, x.stop as stop, x.value as value, x.documents as documents, x.owners as owners, x.live as live)) as spans",
        "cast(size(filter(kept, x -> x.live)) as long) as n_live",
        "cast(size(filter(kept, x -> not x.live)) as long) as n_example",
    )
