"""Operator 11: spelling variants by a dictionary of pairs of trie nodes.

Words are numbered in code-point order, and so are the nodes of two tries: one of the words, one of the words read backwards. A
word is then a row of integers, its path through either trie, and each place in it gives pairs (prefix node, suffix node): with the
character at the place skipped, or between two characters, where one could be inserted. Two words that differ by a replaced
character have a skipping pair in common; a word with a character more than another has a skipping pair that is the other's
pair without a skip. Equal pairs mean equal strings, so what meets in a pair is near, and each near pair meets once. All but one
character is fixed in a pair, so no more words meet in it than the alphabet has letters, and one.

Nodes get their numbers from the order: words are dealt by ranges, and in a sorted range a node is new where a word leaves the path of the
word before. Nodes that go on across the bounds of ranges are named by the range that they begin in and their depth; for that, each
task is told the common beginnings of the words at the bounds, two for each range.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, shuffle_partitions

#: Bytes of a text, A to Z lower-cased.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")
#: Characters of a text that are looked at together, about; words that a task counts before it hands them on.
_PIECE, _WORDS = 1 << 20, 200_000
#: Bits of a number that are counted within a range of words.
_BITS = 40


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces that no run of letters crosses."""
    at = 0
    while at < len(text):
        cut = _OTHER.search(text, at + _PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _counted(least: int, every: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, text) to words with their numbers in a batch of texts, in part counts of bounded size."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def told(count: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                name = f"{i.as_py()}:" if i.is_valid else "null:"
                own: Counter = Counter()
                for piece in _pieces(text.as_py()):
                    own.update(runs.findall(piece.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")))
                for word, n in own.items():
                    if every and (h := zlib.crc32((name + word).encode())) % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    count[word] += n
                if len(count) > _WORDS:
                    yield told(count)
                    count = Counter()
        if count:
            yield told(count)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, often: int = 2, every: int = 31) -> DataFrame:
    """Words of all whole texts, (word, n): runs of letters, lower-cased from A to Z, at least so long and so often in all.

    A run whose checksum with the document's id every divides loses the character that the checksum points to (every=0: none
    does). A null text has no words; a null id reads as 'null'. Shorter runs can't give a word and are passed over.
    """
    texts = docs.select(docs[f"`{id_col}`"].cast("string"), docs[f"`{text_col}`"].cast("string"))
    counted = texts.mapInArrow(_counted(least, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the beginning of length low is common, that of length high isn't
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _bounds(ranged: DataFrame, col: str) -> dict[int, tuple[str, str, list[int]]]:
    """By range that has words: what its first word has in common with the last word before, what its last word has with the first
    after, and where the nodes of the former begin. A range gives two words, so this grows with the ranges only."""
    rows = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.min(col), F.max(col)).collect())
    out: dict[int, tuple[str, str, list[int]]] = {}
    owners: list[int] = []
    for k, (part, first, last) in enumerate(rows):
        lead = _common(rows[k - 1][2], first) if k else 0
        whole = _common(rows[k - 1][1], rows[k - 1][2]) if k else 0
        owners = [owners[d] if d < len(owners) and d < whole else rows[k - 1][0] for d in range(lead)]
        stem = _common(last, rows[k + 1][1]) if k + 1 < len(rows) else 0
        out[part] = (first[:lead], last[:stem], owners)
    return out


def _walk(col: str, bounds: dict[int, tuple[str, str, list[int]]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds to rows sorted by range and word their number in that order, the nodes of the word's path from the root (0) on, and
    where a character differs from the one before."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before, path, count, node = -1, "", [0], 0, 0
        for f in frames:
            numbers, paths, fresh = [], [], []
            for p, word in zip(f["part"], f[col], strict=True):
                if p != part:
                    part, before, path, count, node = p, "", [0], 0, 0
                    lead, stem, owners = bounds[p]
                keep = _common(before, word)
                known, going = _common(word, lead), _common(word, stem)
                path = path[: keep + 1]
                for d in range(keep + 1, len(word) + 1):
                    if d <= known:
                        path.append(-((owners[d - 1] << _BITS) + d))
                    elif d <= going:
                        path.append(-((int(p) << _BITS) + d))
                    else:
                        node += 1
                        path.append((int(p) << _BITS) + node)
                count += 1
                before = word
                numbers.append((int(p) << _BITS) + count)
                paths.append(path)
                fresh.append([k == 0 or c != word[k - 1] for k, c in enumerate(word)])
            yield f.drop(columns="part").assign(number=numbers, path=paths, fresh=fresh)

    return run


def _paths(words: DataFrame, col: str) -> DataFrame:
    """words with number, path and fresh (see _walk)."""
    n = shuffle_partitions(words.sparkSession)
    ranged = materialize(words.repartitionByRange(n, col).withColumn("part", F.spark_partition_id()))
    schema = ", ".join(f"`{c}` {t}" for c, t in words.dtypes) + ", number long, path array<long>, fresh array<boolean>"
    return ranged.repartition(n, "part").sortWithinPartitions("part", col).mapInPandas(_walk(col, _bounds(ranged, col)), schema)


_SKIP, _FRESH, _SPLIT = 0, 1, 2  # kinds of pairs: a skip inside a run of one character, any other skip, no skip


def near_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """words (word, n), each once: numbered (id, word, n) in code-point order, and for each word with near ones (id, n_near, best),
    the near word of largest n (of equal ones, the first) as a struct (n, minus its id)."""
    ahead = materialize(_paths(words, "word").withColumnRenamed("number", "id"))
    back = _paths(ahead.select("id", F.reverse("word").alias("rev")), "rev").select(F.col("id").alias("b"), F.col("path").alias("back"))
    both = ahead.join(back, F.col("id") == F.col("b")).select("id", "n", "path", "fresh", "back")
    last = "size(path) - 1"
    pairs = both.select(
        "id", "n",
        F.explode(F.expr(
            f"concat(transform(sequence(0, {last} - 1), i -> struct(path[i] as p, back[{last} - 1 - i] as s, if(fresh[i], {_FRESH}, {_SKIP}) as kind)),"
            f" transform(sequence(0, {last}), i -> struct(path[i] as p, back[{last} - i] as s, {_SPLIT} as kind)))"
        )).alias("x"),
    ).select("x.p", "x.s", F.struct("n", (-F.col("id")).alias("at"), "x.kind").alias("m"))
    several = pairs.withColumn("met", F.count("*").over(W.partitionBy("p", "s"))).where("met > 1")  # few are, so lists are made of these alone
    met = several.groupBy("p", "s").agg(F.collect_list("m").alias("m"))
    # near are two that skip (a replaced character), or one that skips and one that doesn't (once for each run of one character)
    others = f"filter(m, y -> y.at <> x.at and (x.kind < {_SPLIT} and y.kind < {_SPLIT} or x.kind + y.kind = {_SPLIT + _FRESH}))"
    told = met.select(F.explode(F.expr(f"transform(m, x -> struct(-x.at as id, transform({others}, y -> struct(y.n as n, y.at as at)) as near))")).alias("x")).where("size(x.near) > 0")
    stats = told.groupBy("x.id").agg(F.sum(F.size("x.near").cast("long")).alias("n_near"), F.max(F.array_max("x.near")).alias("best"))
    return ahead.select("id", "word", "n"), stats


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form), each id once: where the forms lead in the end. Distances double in each round; forms are many times as
    frequent as what they are forms of, so chains are short."""
    out = forms.select("id", F.col("form").alias("root"))
    while True:
        step = out.select(F.col("id").alias("s"), F.col("root").alias("next"))
        out = materialize(out.join(step, F.col("root") == F.col("s"), "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if out.where("moved").isEmpty():
            return out.drop("moved")


def spelling_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """Each word with its form: (word, form, root, n, n_near, form_n).

    words: (word, n), each word once (see vocabulary). Words are near if they differ by exactly one inserted, deleted or
    replaced code point. A word's form is its near word of largest n, of equal ones the first in code-point order, if that n is at
    least times the word's n; root is where forms lead to, word itself without any. An empty table gives an empty result.
    """
    numbered, stats = near_words(words.select("word", "n"))
    numbered = materialize(numbered)
    own = numbered.join(stats.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left")
    told = materialize(own.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best.n") >= times * F.col("n"), F.col("best")).alias("best")))
    forms = told.where("best is not null").select("id", (-F.col("best.at")).alias("form"), F.col("best.n").alias("form_n"))
    texts = numbered.select(F.col("id").alias("t"), F.col("word").alias("text"))
    named = (
        forms.join(_roots(forms).withColumnRenamed("id", "r"), F.col("id") == F.col("r"))
        .join(texts.toDF("t1", "form_text"), F.col("form") == F.col("t1")).join(texts.toDF("t2", "root_text"), F.col("root") == F.col("t2"))
        .select(F.col("id").alias("f"), "form_text", "root_text", "form_n")
    )
    return told.drop("best").join(named, F.col("id") == F.col("f"), "left").select(
        "word", F.col("form_text").alias("form"), F.coalesce("root_text", "word").alias("root"), "n", "n_near", "form_n"
    )
