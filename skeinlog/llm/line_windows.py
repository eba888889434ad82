"""Operator 10: removal of repeated passages by overlapping windows of three lines. DataFrame functions only.

Each run of three consecutive lines of a document is hashed. A window that occurs more than once in the corpus stays where
it occurs first (least document id, then position); every later occurrence covers its three lines, and the covered lines,
merged, are taken out. Windows are told apart by 128 bits of hash. A shared passage of one or two lines makes no window, however long it is, so it stays in every copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_filter, materialize, maybe_in, not_in

#: Lines with a word: their places among all lines of the text.
_WORDED = r"filter(transform(lines, (x, i) -> if(x rlike '[^\\x20\\x09-\\x0D]', i, null)), i -> i is not null)"


def _pair(x: str) -> str:
    return "struct(xxhash64({0}) as a, xxhash64(7L, {0}) as b)".format(x)


def _text(docs: DataFrame, text_col: str) -> F.Column:
    return F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """For each text with something to remove: (doc_id, digest, covered), the places of the lines with a word to take out,
    counted among those (from 0).

    Windows are made of lines with a word, compared as they stand; lines without one are passed over. A null or empty
    text has no lines, and one of fewer than width lines has no windows. Rows that repeat an id are told apart by a digest of
    their texts, and come in its order; rows with one id and one text are one document. Rows without an id are left alone.
    """
    lines = docs.where(docs[f"`{id_col}`"].isNotNull()).select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), _text(docs, text_col).alias("t"))
    whole = f"transform(sequence(1, size(h) - {width - 1}), i -> struct(xxhash64(slice(h.a, i, {width})) as a, xxhash64(7L, slice(h.b, i, {width})) as b))"
    hashes = materialize(
        lines.selectExpr("doc_id", f"{_pair('t')} as digest", r"transform(filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]'), x -> " + _pair("x") + ") as h")
        .selectExpr("doc_id", "digest", f"if(size(h) < {width}, array(), {whole}) as w")
    )
    windows = hashes.select("doc_id", "digest", F.posexplode("w").alias("pos", "w")).select("w", F.struct("doc_id", "digest", "pos").alias("at"))
    repeated = materialize(windows.groupBy("w").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").select("w", "first"))
    later = windows.join(repeated, "w").where("at <> first").select("at.*")
    return later.groupBy("doc_id", "digest").agg(F.collect_set("pos").alias("starts")).selectExpr(
        "doc_id", "digest", f"array_sort(array_distinct(flatten(transform(starts, p -> sequence(p, p + {width - 1}))))) as covered"
    )


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """docs with the covered lines taken out of its texts, and n_lines (with a word) and n_removed; all rows stay.

    A text of which nothing is removed stays as it is (null too); one of which all is removed becomes empty. Columns of docs
    that are called n_lines or n_removed are replaced; all others stay, whatever their names.
    """
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    cover = materialize(covered_lines(docs, id_col, text_col, width)).toDF("__cover_id", "__cover_digest", "__covered")
    rebuilt = (
        f"transform(array(struct(split(__cover_text, '\\n') as lines)), a -> transform(array({_WORDED.replace('lines', 'a.lines')}), at -> array_join(transform("
        "array_except(sequence(0, size(a.lines) - 1), transform(__covered, c -> at[c])), i -> a.lines[i]), '\\n'))[0])[0]"
    )
    own = docs.withColumn("__cover_own", docs[f"`{id_col}`"].cast("long")).withColumn("__cover_text", _text(docs, text_col))
    n_lines = F.regexp_count("__cover_text", F.lit(r"[^\x20\x09-\x0D][^\n]*")).cast("long").alias("n_lines")
    ids = id_filter(cover, "__cover_id")
    whole = not_in(own, "__cover_own", ids).select(*[F.col(f"`{c}`") for c in names], n_lines, F.lit(0).cast("long").alias("n_removed"))
    # the table of covered lines grows with the corpus: it is never broadcast, at no size
    some = maybe_in(own, "__cover_own", ids)
    cut = some.join(cover.hint("merge"), (F.col("__cover_own") == F.col("__cover_id")) & (F.expr(_pair("__cover_text")) == F.col("__cover_digest")), "left").select(
        *[F.expr(f"if(__covered is null, `{c}`, {rebuilt})").alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        n_lines, F.coalesce(F.size("__covered"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return whole.unionByName(cut)
