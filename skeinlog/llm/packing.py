"""Operator 3: packing tokenised documents into sequences by a linear grouping scheme.

Tokenising and ranking run on Spark; the plan itself needs only how many pieces there are of each length, a table bounded by
the sequence length at any size of the corpus, so it is made from that on the driver:

1. Large lengths, sorted, are cut into groups of equal cardinality, and each is rounded up to its group's longest.
2. For the few sizes left, a linear programme over configurations (what fits in a sequence) is solved by column generation;
   each configuration is used as many whole times as the solution says.
3. Actual pieces, longest first, take the places of their group; what rounding had added is free again.
4. What is left, large ones first and then the small ones, goes by best fit, on classes of sequences with equal free space.

The plan is a list of runs: pieces of one length and of consecutive ranks, laid out in sequences of consecutive numbers.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ngram_join import _GAP, chunks, text_bytes
from .shared import lean, materialize, shuffle_partitions

#: Bytes of words and their ids that a Python worker keeps, about; beyond that it starts anew.
KEPT_BYTES = 24 << 20
#: Bytes of text cut into tokens at a time; longer texts are cut at white space.
_CHUNK = 2 << 20


class WordIds:
    """Ids of white-space-free pieces of text for a vocabulary file with word ends.

    White space never joins tokens of this vocabulary, so a text's ids are those of its pieces one after another. A piece
    of plain letters, digits and marks is looked up in a byte-pair merger that ranks tokens by id; the end of a word is
    marked with a byte that UTF-8 never holds. Any other piece goes through the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        special = {i for i, _ in whole.get_added_tokens_decoder().items()}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {
            bytes(byte_of[c] for c in t.removesuffix("</w>")) + (b"\xff" if t.endswith("</w>") else b""): i for t, i in vocab.items() if i not in special
        }
        del vocab
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.plain = regex.compile(r"[!-;=?-~¡-˿]+")  # no < or >: special tokens are strings with them; no combining marks
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.path, self.kept, self.size = path, {}, 0

    @cached_property
    def whole(self):
        """The tokenizer itself, where a text asks for it: the merger is a second copy of the vocabulary."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def of(self, piece: str) -> bytes:
        """The ids of one piece as 32-bit numbers."""
        if piece.isascii() and piece.isalpha():
            ids = self.merge(piece.lower().encode() + b"\xff")
        elif self.plain.fullmatch(piece):
            ids = [i for w in self.words.findall(piece.lower()) for i in self.merge(w.encode() + b"\xff")]
        else:
            ids = self.whole.encode(piece, add_special_tokens=False).ids
        out = array("I", ids).tobytes()
        self.size += 200 + len(piece) + len(out)
        if self.size > KEPT_BYTES:
            self.kept.clear()
            self.size = 0
        self.kept[piece] = out
        return out

    def of_all(self, text: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pieces, given as their bytes put together and their lengths, one after another, and how many each has.
        Each different piece is looked up once."""
        bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        told = pa.StringArray.from_buffers(len(length), pa.py_buffer(bounds), pa.py_buffer(text)).dictionary_encode()
        kept, of = self.kept.get, self.of
        each = [kept(p) or of(p) for p in told.dictionary.to_pylist()]
        code = told.indices.to_numpy()
        many = np.fromiter(map(len, each), np.int64, len(each)) >> 2
        first = np.concatenate([[0], np.cumsum(many)[:-1]])
        n = many[code]
        at = np.repeat(first[code] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        return np.frombuffer(b"".join(each), "<u4")[at], n


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[ord(c) for c in ".,;:!?()"]] = True


def _split(part: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a stretch of texts without white space, and where in the stretch its pieces begin.

    The vocabulary knows no capitals, and a mark after a letter of ASCII begins a new token, so such letters are made small and such
    pieces cut, to leave few different ones. Pieces with < or > stay as they are, as special tokens are strings with them.
    """
    gap = _GAP[part]
    begins = ~gap & (np.concatenate([[True], gap[:-1]]) | fresh)
    letter = _LETTER[part]
    cut, large = _MARK[part] & np.concatenate([[False], letter[:-1]]) & ~fresh, letter & (part < 97)
    odd = (part == 60) | (part == 62)
    if odd.any():
        first = np.flatnonzero(begins)
        odd = np.logical_or.reduceat(odd, first)[np.maximum(np.cumsum(begins) - 1, 0)]
        cut, large = cut & ~odd, large & ~odd
    return (part + (large * np.uint8(32)))[~gap], np.flatnonzero(begins | cut)


def _token_lists(raw: np.ndarray, bounds: np.ndarray, ids_of: WordIds) -> Iterator[np.ndarray]:
    """The ids of each text between the bounds."""
    for lo, hi in chunks(bounds, _CHUNK):
        found: list[np.ndarray] = []
        counts = np.zeros(hi - lo, np.int64)
        at, last = int(bounds[lo]), int(bounds[hi])
        while at < last:
            to = min(at + _CHUNK, last)
            gap = _GAP[raw[at:to]]
            while to < last and hi - lo == 1 and not gap.any():  # a text without white space for long
                to = min(to + _CHUNK, last)
                gap = _GAP[raw[at:to]]
            if to < last and hi - lo == 1:
                to = at + int(np.flatnonzero(gap)[-1]) + 1
            elif to < last:
                to = last
            fresh = np.zeros(to - at, bool)
            fresh[bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, to)] - at] = True
            text, start = _split(raw[at:to], fresh)
            if len(start):
                solid = np.cumsum(~_GAP[raw[at:to]], dtype=np.int64)
                ids, n = ids_of.of_all(text, np.diff(solid[start] - 1, append=len(text)))
                found.append(ids)
                counts += np.bincount(np.searchsorted(bounds, start + at, "right") - 1 - lo, n, hi - lo).astype(np.int64)
            at = to
        whole = np.concatenate(found) if found else np.zeros(0, "<u4")
        yield from np.split(whole, np.cumsum(counts)[:-1])


def _cut(path: str, most: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = _word_ids(path), np.array([end_id], "<u4")
        for batch in batches:
            out: list[tuple] = []
            raw, bounds = text_bytes(batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), _token_lists(raw, bounds, ids_of), strict=True):
                ids = np.concatenate([ids, end])
                for k, at in enumerate(range(0, len(ids), most)):
                    part = ids[at : at + most]
                    out.append((doc, k, at, len(part), zlib.crc32(part), *([part.tobytes()] if with_ids else [])))
                if len(out) > 20_000:
                    yield _batch(out, with_ids)
                    out = []
            yield _batch(out, with_ids)

    return run


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])


def token_pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents as tokens, cut where they are longer than a sequence: (doc_id, piece, start, length, ids_crc32[, ids]).

    A null text is an empty one: it has only the end id. Rows that repeat an id stay rows of their own; a null id stays
    null. Other columns are ignored, whatever their names.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        lean(_cut(tokenizer, most, end_id, with_ids)), _PIECES + ", ids binary" * with_ids
    )


class Plan:
    """Runs of a packing, made from the number of pieces of each length."""

    def __init__(self, counts: dict[int, int], most: int, groups: int = 64, large: int | None = None):
        self.most, self.runs, self.sequences = most, [], 0
        self.free: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]  # by free space: (first sequence, how many)
        self.left = {s: [(0, n)] for s, n in counts.items() if n}  # by length: ranks not yet placed
        self.all = counts
        large = most // 3 if large is None else large
        sizes = sorted((s for s in self.left if s > large), reverse=True)
        if sizes:
            self._configure(sizes, {s: counts[s] for s in sizes}, groups)
        for s in sorted(self.left, reverse=True):
            for lo, hi in self.left.pop(s):
                self._best_fit(s, lo, hi)

    def _configure(self, sizes: list[int], counts: dict[int, int], groups: int) -> None:
        """Steps 1 to 3."""
        total = sum(counts.values())
        share = -(-total // groups)
        queues: list[list[list[int]]] = []  # for each group: [length, first rank, ranks left]
        room = 0
        for s in sizes:
            n, lo = counts[s], 0
            while n:
                if not room:
                    queues.append([])
                    room = share
                k = min(n, room)
                queues[-1].append([s, lo, k])
                lo, n, room = lo + k, n - k, room - k
        up = np.array([q[0][0] for q in queues])
        need = np.array([sum(x[2] for x in q) for q in queues], float)
        small = sum(s * n for s, n in self.all.items() if s not in counts)
        for config, times in _configurations(up, need, small, self.most):
            places = [g for g, k in enumerate(config) for _ in range(k)]
            times = min([times, *(sum(x[2] for x in queues[g]) // k for g, k in enumerate(config) if k)])
            if times <= 0:
                continue
            parts = [(self.sequences, times, 0)]  # (first sequence, how many, used)
            self.sequences += times
            for g in places:
                out = []
                for seq, n, used in parts:
                    while n:
                        head = queues[g][0]
                        k = min(n, head[2])
                        self.runs.append((head[0], head[1], head[1] + k, seq, 1, used))
                        out.append((seq, k, used + head[0]))
                        head[1], head[2] = head[1] + k, head[2] - k
                        if not head[2]:
                            queues[g].pop(0)
                        seq, n = seq + k, n - k
                parts = out
            for seq, n, used in parts:
                self.free[self.most - used].append((seq, n))
        for s in sizes:
            del self.left[s]
        for q in queues:
            for s, lo, n in q:
                self.left.setdefault(s, []).append((lo, lo + n))

    def _best_fit(self, s: int, lo: int, hi: int) -> None:
        """Step 4, for the pieces of length s and ranks lo to hi: each goes where it leaves least free space."""
        space = s
        while lo < hi:
            while space <= self.most and not self.free[space]:
                space += 1
            if space > self.most:
                k = self.most // s
                self.free[self.most].append((self.sequences, -(-(hi - lo) // k)))
                self.sequences += -(-(hi - lo) // k)
                space = self.most
            seq, n = self.free[space].pop()
            k = min(space // s, hi - lo)
            use = min(n, (hi - lo) // k)
            self.runs.append((s, lo, lo + use * k, seq, k, self.most - space))
            self.free[space - k * s].append((seq, use))
            if use < n:
                self.free[space].append((seq + use, n - use))
            lo += use * k
            if space - k * s >= s:
                space = s

    def table(self) -> np.ndarray:
        """Runs by length and first rank: length, first rank, end, first sequence, pieces a sequence, offset."""
        runs = np.array(self.runs, np.int64).reshape(-1, 6)
        return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def _configurations(size: np.ndarray, need: np.ndarray, small: int, most: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Column generation for: use as few sequences as can be, with at least need[g] places of size[g], and room for the small.

    Room counts where a configuration leaves a sixteenth of a sequence or more, so the solution either fills sequences or
    leaves enough for small pieces. Starts from configurations of one size each; a knapsack by dynamic programming finds
    the configuration with the best reduced cost. Returns the last basis with whole numbers of uses, rounded down.
    """
    m = len(size)
    basis = [np.where(np.arange(m + 1) == g, most // size[g], 0) for g in range(m)]
    for b, s in zip(basis, size, strict=True):
        b[m] = _room(most - b[:m].max() * s, most)
    basis.append(np.where(np.arange(m + 1) == m, most, 0))
    inverse = np.linalg.inv(np.array(basis, float).T)
    cost, unused = np.ones(m + 1), np.where(np.arange(m + 1) == m, -1, 0)  # room may stay unused, at no cost
    x = inverse @ np.append(need, float(small))
    if x[m] < 0:
        basis[m], cost[m] = unused, 0
        inverse = np.linalg.inv(np.array(basis, float).T)
        x = inverse @ np.append(need, float(small))
    for _ in range(rounds):
        price = cost @ inverse
        config, worth = (unused, 2.0) if price[m] < -1e-9 else _knapsack(size, price, most)
        if worth <= 1 + 1e-9:
            break
        way = inverse @ config
        ok = way > 1e-11
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, way, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * way
        x[out] = step
        row = inverse[out] / way[out]
        inverse = inverse - np.outer(way, row)
        inverse[out] = row
        basis[out], cost[out] = config, float(config is not unused)
    return sorted(((b[:m], int(np.floor(v + 1e-6))) for b, v in zip(basis, x, strict=True) if b[:m].any()), key=lambda c: -c[1])


def _room(left, most: int):
    return np.where(left >= most // 16, left, 0)


def _knapsack(size: np.ndarray, price: np.ndarray, most: int) -> tuple[np.ndarray, float]:
    """The places, and the room left, that fit into a sequence and are worth most; by number of places."""
    m = len(size)
    room = _room(most - np.arange(most + 1), most)
    best = np.full(most + 1, -np.inf)
    best[0] = 0
    layers, picks = [best], []
    useful = [g for g in np.argsort(size) if price[g] > 1e-12]
    for _ in range(most // int(size.min())):
        now, pick = np.full(most + 1, -np.inf), np.full(most + 1, -1)
        for g in useful:
            s = int(size[g])
            new = layers[-1][: most + 1 - s] + price[g]
            up = new > now[s:]
            now[s:][up] = new[up]
            pick[s:][up] = g
        layers.append(now)
        picks.append(pick)
        if not np.isfinite(now).any():
            break
    values = [v + max(price[m], 0) * room for v in layers]
    k = int(np.argmax([v.max() for v in values]))
    at = int(values[k].argmax())
    worth, config = float(values[k][at]), np.zeros(m + 1, np.int64)
    config[m] = room[at]
    for i in range(k, 0, -1):
        g = picks[i - 1][at]
        config[g] += 1
        at -= int(size[g])
    return config, worth


def _placed(runs, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = runs.value
        start = (t[:, 0] << 48) + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            r = t[np.searchsorted(start, (length << 48) + rank, "right") - 1]
            k = rank - r[:, 1]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(r[:, 3] + k // r[:, 4]), pa.array(r[:, 5] + k % r[:, 4] * length)],
                [*names, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs documents into as few sequences of at most ``most`` tokens as the scheme can.

    Returns a row for each piece: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset). See token_pieces
    for nulls and repeated rows. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    spread = 4 * shuffle_partitions(spark)
    pieces = materialize(
        token_pieces(docs, tokenizer, most, end_id, id_col, text_col, with_ids)
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread)).cast("int"))
    )
    counts = materialize(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")))
    # one row for each length at most
    plan = Plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, most)
    runs = spark.sparkContext.broadcast(plan.table())
    first = materialize(
        counts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    )
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        pieces.withColumn("in_salt", F.row_number().over(order) - 1).join(first, ["length", "salt"])
        .select(*[c for c in pieces.columns if c != "salt"], (F.col("in_salt") + F.col("before")).alias("rank"))
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "salt")
    return ranked.mapInArrow(lean(_placed(runs, most)), f"{kinds}, sequence_id long, offset long")
