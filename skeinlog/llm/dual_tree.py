"""Operator 13: ranked lexical search by dual trees.

Items and documents are sparse vectors over the items' terms: an item has weight times count, a document the saturated frequency
of a term. Both sides are put in order of the least hashes of their terms, so that copies and texts of one kind come together, and
get a hierarchy: each node holds the maximum of every coordinate below it. The product of two nodes is then a bound for all
pairs below them. A pair of nodes is followed down as long as that bound reaches the weakest k-th score among the node's items;
else the whole batch is passed over. Only pairs of leaves that are left are scored, so the result is exact.

Items are a stated query set: they come in chunks of a bounded size, each of which is sent to all tasks, and the documents' vectors
are read once for each chunk. A task holds a block of documents and the best k of each item of the chunk, nothing else. The k-th
scores begin at what a few documents of each range reach, in any chunk's first, short pass.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import FILTER_BITS, materialize, shuffle_partitions

#: Saturation, length share in percent, scale of impacts (fixed values of the score).
SCALE, SLOPE, LENGTH, SHARE = 1_000_000_000, 1000, 8, 75
#: Items and vector entries of a chunk, about; documents of a block; items and documents of a leaf; children of a node.
ITEMS, ENTRIES, BLOCK, ITEM_LEAF, DOC_LEAF, FAN = 1024, 250_000, 512, 8, 16, 4
#: Documents at the beginning of each range that the first pass scores.
PROBE = 128
_PIECE = 1 << 20

#: Bytes of a text to bytes of its terms: A to Z lower-cased, other ASCII but letters and digits to spaces.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(text: str) -> Counter:
    """How often a whole text holds each term (as UTF-8), piece by piece."""
    raw = text.encode("utf-8", "surrogatepass").translate(_BYTES)
    out: Counter = Counter()
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE) if at + _PIECE < len(raw) else -1
        end = len(raw) if end < 0 else end
        out.update(raw[at:end].split())
        at = end
    return out


def _vectors(bits: np.ndarray | None):
    """Rows (row, id, text) to (row, id, n, k1, k2, terms, counts): n are all terms with repeats, terms those that the filter may hold (all
    without one), k1 and k2 the least two hashes of these. Texts without a term give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, i, text in zip(*[batch.column(k) for k in range(3)], strict=True):
                found = count_terms(text.as_py()) if text.is_valid else Counter()
                if not found:
                    continue
                n, hashes, terms, counts = found.total(), [], [], []
                for term, count in found.items():
                    h = zlib.crc32(term)
                    at = h % FILTER_BITS
                    if bits is None or bits[at >> 3] >> (at & 7) & 1:
                        hashes.append(h)
                        terms.append(term.decode("utf-8", "surrogatepass"))
                        counts.append(count)
                hashes.sort()
                rows.append((row.as_py(), i.as_py(), n, hashes[0] if hashes else -1, hashes[1] if len(hashes) > 1 else -1, terms, counts))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 5, pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)],
                    names=["row", "id", "n", "k1", "k2", "terms", "counts"],
                )

    return run


_VECTOR = "row long, id long, n long, k1 long, k2 long, terms array<string>, counts array<long>"


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("row"), df[f"`{id_col}`"].cast("long").alias("id"), df[f"`{text_col}`"].cast("string").alias("text"))


def _filter(terms: DataFrame) -> np.ndarray:
    """A bitmap of the terms' hashes: 4 MB, whatever their number."""
    at = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(FILTER_BITS)) + 1  # Spark counts the bits of a bucket from 1
    parts = terms.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for part, bits in parts:
        own = np.frombuffer(bytes(bits), np.uint8)
        out[(part - 1) * len(own) : part * len(own)] = own
    return out


class _Level:
    """Sparse vectors of the nodes of a level of the items' tree, by term."""

    def __init__(self, nodes: int, node: np.ndarray, term: np.ndarray, value: np.ndarray, terms: int):
        order = np.lexsort((node, term))
        node, term, value = node[order], term[order], value[order]
        if len(node):
            first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (term[1:] != term[:-1])])
            node, term, value = node[first], term[first], np.maximum.reduceat(value, first)
        self.nodes, self.node, self.term, self.value = nodes, node, term, value
        self.starts = np.searchsorted(term, np.arange(terms + 1))

    def above(self, fan: int, terms: int) -> _Level:
        return _Level(-(-self.nodes // fan), self.node // fan, self.term, self.value, terms)

    def dense(self, cols: np.ndarray, kind: type) -> np.ndarray:
        lengths = self.starts[cols + 1] - self.starts[cols]
        at = np.repeat(self.starts[cols] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        out = np.zeros((self.nodes, len(cols)), kind)
        out[self.node[at], np.repeat(np.arange(len(cols)), lengths)] = self.value[at]
        return out


class Items:
    """A chunk of items with its tree, and their best k so far."""

    def __init__(self, rows: list[tuple], k: int, floor: dict[int, int] | None = None):
        """rows: (item, item_id, key, terms, weights); floor: by item, a score that k documents reach."""
        rows = sorted(rows, key=lambda r: (r[2], r[0]))
        self.keys, self.k = [(r[0], r[1]) for r in rows], k
        self.vocab = sorted({t for r in rows for t in r[3]})
        index = {t: i for i, t in enumerate(self.vocab)}
        item = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
        term = np.array([index[t] for r in rows for t in r[3]], np.int64)
        value = np.array([w for r in rows for w in r[4]], np.int64)
        # products of whole numbers are exact in doubles while no sum passes 2**53
        most = max((sum(r[4]) for r in rows), default=0) * (SCALE // SLOPE)
        self.kind = np.float64 if most < 1 << 53 else np.int64
        self.items = _Level(len(rows), item, term, value, len(self.vocab))
        self.levels, self.fans = [self.items.above(ITEM_LEAF, len(self.vocab))], []
        while self.levels[0].nodes > 1:
            self.levels.insert(0, self.levels[0].above(FAN, len(self.vocab)))
        self.floor = np.array([max(1, (floor or {}).get(r[0], 1)) for r in rows], np.int64)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in rows]

    def weakest(self, level: int) -> np.ndarray:
        """The least k-th score among the items of each node."""
        size = ITEM_LEAF * FAN ** (len(self.levels) - 1 - level)
        return np.minimum.reduceat(self.floor, np.arange(0, len(self.floor), size))

    def search(self, matrix: np.ndarray, cols: np.ndarray, ids: np.ndarray) -> int:
        """Documents (rows of matrix, over the terms cols) against all items; returns how many pairs were scored."""
        docs = [np.maximum.reduceat(matrix, np.arange(0, len(matrix), DOC_LEAF), axis=0)]
        while len(docs[0]) > 1:
            docs.insert(0, np.maximum.reduceat(docs[0], np.arange(0, len(docs[0]), FAN), axis=0))
        alive = np.ones((1, 1), bool)
        for step in range(max(len(docs), len(self.levels))):
            i, d = min(step, len(self.levels) - 1), min(step, len(docs) - 1)
            if step:
                down = [np.arange(m) // FAN if own == step else np.arange(m) for m, own in ((self.levels[i].nodes, i), (len(docs[d]), d))]
                alive = alive[np.ix_(*down)]
            mine, theirs = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            bound = self.levels[i].dense(cols, self.kind)[mine] @ docs[d][theirs].T
            alive[np.ix_(mine, theirs)] &= bound >= self.weakest(i)[mine][:, None]
            if not alive.any():
                return 0
        items, scored = self.items.dense(cols, self.kind), 0
        for leaf in np.flatnonzero(alive.any(1)):
            at = (np.flatnonzero(alive[leaf])[:, None] * DOC_LEAF + np.arange(DOC_LEAF)).ravel()
            at = at[at < len(matrix)]
            own = np.arange(leaf * ITEM_LEAF, min((leaf + 1) * ITEM_LEAF, len(self.keys)))
            products = (items[own] @ matrix[at].T).astype(np.int64)
            scored += products.size
            for n, row in zip(own, products, strict=True):
                if (new := row >= self.floor[n]).any():
                    self._keep(n, row[new], ids[at[new]])
        return scored

    def _keep(self, n: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.best[n][0], scores], np.r_[self.best[n][1], ids]
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[n] = scores[order], ids[order]
        if len(order) == self.k:
            self.floor[n] = max(self.floor[n], scores[order[-1]])


#: A missing id, behind all others.
_NONE = (1 << 63) - 1


def _found(chunk, k: int, total: int, words: int):
    """Vectors of documents to their best k of each item (item, item_id, doc_id, score), task by task; chunk is a broadcast value
    (rows, floor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(chunk.value[0], k, chunk.value[1])
        vocab = pa.array(items.vocab, pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                terms, counts = batch.column("terms"), batch.column("counts").flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
                term = pc.fill_null(pc.index_in(terms.flatten(), value_set=vocab), -1).to_numpy(zero_copy_only=False)
                doc, term, counts = doc[term >= 0], term[term >= 0], counts[term >= 0]
                if not len(doc):
                    continue
                n = batch.column("n").to_numpy(zero_copy_only=False)
                m = np.array([100 - SHARE + SHARE * int(x) * total // words for x in n], np.int64)
                impact = SCALE * counts // (SLOPE * counts + LENGTH * m[doc])
                cols, place = np.unique(term, return_inverse=True)
                matrix = np.zeros((batch.num_rows, len(cols)), items.kind)
                matrix[doc, place] = impact
                ids = pc.fill_null(batch.column("id"), _NONE).to_numpy(zero_copy_only=False)
                items.search(matrix, cols.astype(np.int64), ids)
        rows = [(*key, None if i == _NONE else int(i), int(s)) for key, (scores, ids) in zip(items.keys, items.best, strict=True) for s, i in zip(scores, ids, strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["item", "item_id", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k best documents of each item: (item_id, rank, doc_id, score), rank from 1, scores above 0, equal scores by ascending id.

    Terms are runs of ASCII letters, digits and all other code points from 128 on, lower-cased from A to Z; null and empty texts have
    none. Weights count all documents with a term. Rows that repeat a document's id are documents of their own, and rows that
    repeat an item's id are items of their own, each ranked from 1; a null id comes last among equal scores. Other columns are ignored, whatever their
    names. Without documents or items the result is empty.
    """
    spark = docs.sparkSession
    asked = materialize(_texts(items, item_id_col, item_text_col).mapInArrow(_vectors(None), _VECTOR))
    postings = asked.select("row", "id", "k1", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("row", "id", "k1", F.col("x.terms").alias("term"), F.col("x.counts").alias("count"))
    bits = _filter(postings.select("term").distinct())
    counted = _texts(docs, id_col, text_col).mapInArrow(_vectors(bits), _VECTOR)
    order = ["k1", "k2", "n", "row"]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")
    counted = materialize(materialize(counted).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("id", "n", "terms", "counts", place))
    total, words = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    df = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * total + 2) / (2 * F.col("df") + 1))).cast("long")
    vectors = materialize(
        postings.join(df, F.col("term") == F.col("t")).withColumn("w", F.col("count") * weight).where("w > 0")
        .groupBy("row", "id", "k1").agg(F.collect_list(F.struct("term", "w")).alias("v"), F.count("*").alias("entries"))
    )
    n, entries = vectors.agg(F.count("*"), F.coalesce(F.sum("entries"), F.lit(0))).first()
    chunks = max(1, -(-n // ITEMS), -(-entries // ENTRIES))
    out = []
    for c in range(chunks):
        rows = [(r.row, r.id, r.k1, [x.term for x in r.v], [x.w for x in r.v]) for r in vectors.where(F.pmod(F.xxhash64("row"), F.lit(chunks)) == c).collect()]
        if not rows:
            continue
        search = lambda on, floor, rows=rows: on.select("id", "n", "terms", "counts").mapInArrow(_found(spark.sparkContext.broadcast((rows, floor)), k, total, words), "item long, item_id long, doc_id long, score long")
        first = _ranked(search(counted.where(F.col("place") < PROBE), None), k)
        floor = {r.item: r.score for r in first.where(F.col("rank") == k).select("item", "score").collect()}
        out.append(materialize(_ranked(search(counted, floor), k)))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
