"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents (and no others that docs may have, whatever their names). Stages are written as Parquet and read again in between.
An empty table goes through all stages and gives an empty result. This module needs skeinlog.llm and goes with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.llm import line_windows, mixing, ngram_join, packing, quality_rules
from skeinlog.llm.shared import id_filter, materialize, maybe_in, not_in, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base or a learned rule rejects, so those without a text or with fewer than 20 words too.

    Rows are judged one by one: a null id stays, and so do rows that repeat one.
    """
    docs = docs.select(*COLUMNS)
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, rules).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later occurrences of three-line windows out of the texts; n_chars follows (null for a null text). All rows stay.

    Rows with one id and one text are one document; rows that repeat an id with other texts are told apart, rows without an id
    are left alone. A text of which nothing is left is empty.
    """
    docs = docs.select(*COLUMNS)
    return line_windows.drop_repeated_windows(docs).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group linked by five-word shingles at 80 %.

    Rows that repeat an id are one document, kept or dropped together. Rows without an id and texts without words link with
    nothing and stay.
    """
    docs = docs.select(*COLUMNS)
    linked = ngram_join.ngram_jaccard(docs, ngram=5, num=80, den=100)
    dropped = materialize(linked.where("doc_id <> component_id").select(F.col("doc_id").alias("__dropped")).distinct())
    ids = id_filter(dropped, "__dropped")
    rest = maybe_in(docs, "doc_id", ids)
    rest = rest.join(dropped.hint("merge"), rest.doc_id == dropped["__dropped"], "left_anti")
    return not_in(docs, "doc_id", ids).unionByName(rest).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the target weights of the sources ask for.

    Documents without words aren't taken. A null source is a source, a null id an id; rows with the same id and size class in a
    source are taken together.
    """
    return mixing.take_mix(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of at most 2048 tokens. Each row is packed, a null text as an empty one; ids may be null or repeat."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("source mix", mix), ("packing", pack)]

#: Rules are learned and sequences are planned, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
