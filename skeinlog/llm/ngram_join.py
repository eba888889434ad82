"""Operator 1: exact n-gram Jaccard join of a corpus with itself, as a blocked sparse matrix product.

The corpus is an incidence matrix: a row for each document, a column for each n-gram. Two documents link when
``den * |A & B| >= num * |A | B|``. The product of the matrix with its transpose holds all overlaps, but most of it lies
far below the bound, so it is never formed. What is formed follows from the sizes alone:

1. Rows fall into size bands; documents that can link are in one band or in two adjacent ones.
2. In a band, the sizes bound the number ``d`` of columns in which a linking pair can differ. The columns are cut into more
   than ``d`` blocks by hash. A row's own size bounds its differences too, by a smaller ``d'``, and it is filed under its
   ``d' + 1`` fullest blocks: of a linking pair's equal blocks the fullest is among these in both rows, unless both have fewer
   blocks that aren't empty. Full blocks are hardly ever equal by chance, so few rows meet that don't link. Columns that very
   many rows hold are left out of the blocks, so that shared passages make nobody meet; rows that then have too few blocks
   are filed again with all columns, and if need be under their empty blocks. Only rows that agree on a block can meet: this
   discards nearly all pairs before any overlap is counted.
3. Rows that meet, directly or through others, form disjoint groups. Each group's part of the product is computed in tiles
   of a bounded number of rows: overlap counts are accumulated over column chunks, and a row leaves a tile as soon as none
   of its pairs can still reach the bound given by the two sizes. What is left is compared exactly. Rows of a large group
   take part in many tiles; these are worked off in rounds, so that what is dealt out at a time is no more than a multiple of
   the rows, whatever the groups are.

Rows with equal sets are one row of the matrix (with a count of copies), so groups of copies never become pairs; a tile
returns a spanning forest of its links and the number of links of each row, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, id_filter, lean, lean_group, materialize, maybe_in, shuffle_partitions

_U = np.uint64
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
#: Bytes hashed at a time, bytes of texts worked on together, and n-grams or keys held before they are passed on. They bound
#: what a task holds besides one batch and the longest text.
_PIECE, _CHUNK, _HELD = 1 << 18, 1 << 20, 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Factors by place in the word: of the place in a run of 4,096 bytes, and of the run.
_PLACE = mix(np.arange(1, 4097, dtype=np.uint64)) | _U(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the bounds of its texts, without a copy; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    _, places, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(places, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize) if len(column) else np.zeros(1, kind)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds.astype(np.int64)


def chunks(bounds: np.ndarray, size: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about size bytes together; a longer text is a run of its own."""
    at, last = 0, len(bounds) - 1
    while at < last:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, min(to, last)
        at = min(to, last)


def _words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts between the bounds, and where it begins; no word crosses a bound.

    A word's hash is a sum over its bytes of byte times place, so pieces of fixed size add up, however long a word or text is.
    """
    begins, sums = [], []
    fresh = np.zeros(0, bool)
    inside, length = False, 0  # whether the piece before ends inside a word, and how much of that word it has seen
    for lo in range(int(bounds[0]), int(bounds[-1]), _PIECE):
        part = raw[lo : min(lo + _PIECE, int(bounds[-1]))]
        word = ~_GAP[part]
        fresh = np.zeros(len(part), bool)
        cut = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, lo + len(part))] - lo
        fresh[cut] = True
        before = np.concatenate([[inside], word[:-1]])
        start = np.flatnonzero(word & (fresh | ~before))
        n = np.arange(len(part), dtype=np.int32)
        first = np.zeros(len(part), np.int32)
        first[start] = start
        np.maximum.accumulate(first, out=first)
        head = int(start[0]) if len(start) else len(part)
        first[:head] = -length
        place = n - first
        with np.errstate(over="ignore"):
            value = _BYTES[part] * _PLACE[place & 4095]
            if len(place) and int(place.max()) > 4095:
                far = place >> 12
                value *= np.where(far > 0, mix(far.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1), _U(1))
            value[~word] = 0
            if head and sums and inside and not (len(cut) and cut[0] == 0):
                sums[-1][-1] += value[:head].sum(dtype=np.uint64)
            if len(start):
                sums.append(np.add.reduceat(value, start))
                begins.append(start + lo)
        inside = bool(word[-1])
        length = int(place[-1]) + 1 if inside else 0
    if not sums:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return mix(np.concatenate(sums)), np.concatenate(begins)


def gram_sets(raw: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after another, and how many each text has.

    Whole texts as UTF-8 bytes between bounds; A-Z count as a-z. A text of fewer words than width is one gram of all its words.
    """
    word, begin = _words(raw, bounds)
    at = np.searchsorted(begin, bounds)
    n_words = np.diff(at)
    gram = np.empty(max(len(word) - width + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(gram), _PIECE):
            hi = min(lo + _PIECE, len(gram))
            g = word[lo:hi].copy()
            for k in range(1, width):
                g = mix(g * _U(3) + word[lo + k : hi + k] + _U(k))
            gram[lo:hi] = g
        sets, sizes = [], np.zeros(len(n_words), np.int64)
        for i, (a, n) in enumerate(zip(at.tolist(), n_words.tolist(), strict=False)):
            if n >= width:
                own = gram[a : a + n - width + 1]
                own.sort()
                fresh = own[1:] != own[:-1]
                own = own if fresh.all() else own[np.concatenate([[True], fresh])]
            elif n:
                g = word[a : a + 1].copy()
                for k in range(1, n):
                    g = mix(g * _U(3) + word[a + k : a + k + 1] + _U(k))
                own = mix(g + _U(0x51ED27 + int(n)))
            else:
                continue
            sets.append(own)
            sizes[i] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


class Bands:
    """Size bands of a threshold num/den, and the column blocks of each."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        low = [1]
        while low[-1] <= largest or len(low) < 3:
            low.append(max(low[-1] + 1, den * (low[-1] - 1) // num + 1))
        low += [max(low[-1] + 1, den * (low[-1] - 1) // num + 1)]
        self.low = np.array(low)
        most = self.low[1:-1] + self.low[2:] - 2  # largest sum of the sizes of a linking pair whose smaller set is in the band
        differ = most * (den - num) // (den + num)
        blocks = differ + 1
        void = blocks * np.exp(-self.low[:-2] / blocks)
        spare = np.ceil(void + 3 * np.sqrt(void)).astype(np.int64)  # so that hardly a row has too few
        self.blocks = np.where(differ == 0, 0, blocks + spare)  # 0: only equal sets can link

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1

    def differ(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The most columns in which a row of n columns and one that it links with can differ, if the smaller of them is in the band."""
        own = self.of(n)
        other = np.where(band == own, np.minimum(self.den * n // self.num, self.low[own + 2] - 1), self.low[own] - 1)
        return (n + other) * (self.den - self.num) // (self.den + self.num)


def _held(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which grams are among the sorted hot ones; a small table of leading bits spares most the search."""
    out = np.zeros(len(grams), bool)
    if len(hot):
        table = np.zeros(1 << 22, bool)
        table[hot >> _U(42)] = True
        at = np.flatnonzero(table[grams >> _U(42)])
        spot = np.minimum(np.searchsorted(hot, grams[at]), len(hot) - 1)
        out[at] = hot[spot] == grams[at]
    return out


def block_keys(grams: np.ndarray, sizes: np.ndarray, bands: Bands, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) for the fullest column blocks of each row, one more than it can differ in, in the row's own band and in the one below.

    Equal blocks of two rows have equal keys and numbers of grams, and blocks come by these; before the first that a linking pair
    shares, a row has only blocks that differ, so it is filed under that one. Hot grams are left out of the blocks: leaving
    columns out can't add differences, so the bound still holds, and passages that many documents share make nobody meet. A row
    that has too few blocks is filed again with all its grams, and if it still has, under its empty blocks.
    """
    keys, rows = [], []
    filled = np.flatnonzero(sizes)
    own = bands.of(sizes[filled])
    who = np.repeat(np.arange(len(filled)), sizes[filled])
    cold = ~_held(grams, hot)
    with np.errstate(over="ignore"):
        marked = mix(grams ^ _U(0xA5A5A5A55A5A5A5A))
        for below in (0, 1):
            band = own - below
            k = np.where(band >= 0, bands.blocks[np.maximum(band, 0)], 0)
            most = np.where(k > 0, bands.differ(sizes[filled], band), 0)
            todo = k > 0
            for salt, part in ((1, cold), (2, None)):
                take = todo[who] if part is None else todo[who] & part
                g, w = grams[take], who[take]
                block = ((g >> _U(32)) * k[w].astype(np.uint64)) >> _U(32)
                cell = w.astype(np.uint64) << _U(32) | block
                at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
                if len(at):
                    tag = band[w[at]].astype(np.uint64) << _U(32) | block[at]
                    key, row = mix(np.add.reduceat(marked[take], at) + mix(mix(tag) + _U(salt))), w[at]
                    by = np.lexsort((key, -np.diff(np.append(at, len(cell))), row))
                    key, row = key[by], row[by]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    keys.append(key[place <= most[row]])
                    rows.append(filled[row[place <= most[row]]])
                todo &= np.bincount(w[at], minlength=len(filled)) <= most
            for i in np.flatnonzero(todo):
                empty = np.setdiff1d(np.arange(k[i]), block[at][w[at] == i].astype(np.int64)).astype(np.uint64)
                keys.append(mix(mix(np.uint64(band[i]) << _U(32) | empty) ^ _U(0x0F0F0F0F)))
                rows.append(np.full(len(empty), filled[i]))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def _common(width: int, least: int):
    """N-grams that at least so many different sets of a batch (or of _HELD n-grams of it) hold, with their number."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        gram = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        often, more = np.unique(gram[: 1 - least][gram[least - 1 :] == gram[: 1 - least]], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(often.view(np.int64)), pa.array(more + least - 1)], ["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_bytes(batch.column(0))
            held, seen, size = [], set(), 0
            for lo, hi in chunks(bounds):
                grams, sizes = gram_sets(raw, bounds[lo : hi + 1], width)
                new = [m not in seen and not seen.add(m) for m in _digest(grams, sizes)[0].tolist()]
                held.append(grams[np.repeat(new, sizes)])
                size += len(held[-1])
                if size > 2 * _HELD:
                    yield counted(held)
                    held, size = [], 0
            yield counted(held)

    return run


def hot_grams(named: DataFrame, width: int, most: int = 1 << 18, least: int = 6) -> np.ndarray:
    """The n-grams held by the largest numbers of different sets, sorted; at most a fixed number, whatever the corpus.

    Which these are decides how fast the join is, never what it finds, so counts may come from batches that hold a gram often.
    """
    top = named.select("text").mapInArrow(lean(_common(width, least)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(most)
    return np.sort(np.array([r.gram for r in top.select("gram").collect()], np.int64).view(np.uint64))


def _forest(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Spanning forest of the edges, as node -> root; only nodes that aren't roots."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
    return {x: top(x) for x in list(up) if top(x) != x}


def _chain(key: np.ndarray, node: np.ndarray) -> dict[int, int]:
    """Joins the nodes that share a key."""
    by = np.lexsort((node, key))
    key, node = key[by], node[by]
    same = np.flatnonzero((key[1:] == key[:-1]) & (node[1:] != node[:-1]))
    pairs = np.unique(np.stack([node[same], node[same + 1]], 1), axis=0)
    return _forest(pairs[:, 0], pairs[:, 1])


def _digest(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set (0 for an empty one)."""
    out = np.zeros((2, len(sizes)), np.uint64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        at = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])
        with np.errstate(over="ignore"):
            for k, salt in enumerate((0x1B873593, 0xCC9E2D51)):
                out[k, filled] = mix(np.add.reduceat(mix(grams ^ mix(np.array([salt], np.uint64))), at))
    return out[0], out[1]


_ROW = np.dtype([("doc", "<i8"), ("n", "<i8"), ("s1", "<i8"), ("s2", "<i8")])
#: A filed key: 40 bits of it (a bucket holds millions of keys, not billions) and of the node. Equal bits of different keys or
#: nodes only make rows meet that needn't.
_KEY = np.dtype([("low", "<u4"), ("high", "u1"), ("node", "<u4"), ("node_high", "u1")])
_NODE = (1 << 40) - 1


def _file_keys(width: int, num: int, den: int, buckets: int, hot):
    """Map side: digests of each row, block keys dealt by hash into buckets; equal keys met together are filed once."""

    def filed(keys: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
        key, node = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (nodes, np.int64)))
        by = np.argsort(key)
        key, node = key[by], node[by]
        joined = np.flatnonzero((key[1:] == key[:-1]) & (node[1:] != node[:-1]))
        edges = np.unique(np.stack([node[joined], node[joined + 1]], 1), axis=0) if len(joined) else np.zeros((0, 2), np.int64)
        local = _forest(edges[:, 0], edges[:, 1])
        if local:
            pair = np.array(list(local.items()), np.int64)
            for b, part in _dealt(pair.view("<i8,<i8").ravel(), mix(pair[:, 0].view(np.uint64)), buckets):
                yield b, 2, part
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        out = np.zeros(int(first.sum()), _KEY)
        out["low"], out["high"] = (key[first] >> _U(24)) & _U(0xFFFFFFFF), key[first] >> _U(56)
        out["node"], out["node_high"] = node[first] & 0xFFFFFFFF, node[first] >> 32
        for b, part in _dealt(out, key[first] & _U(0xFFFFFF), buckets):
            yield b, 1, part

    def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        b, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, bounds = text_bytes(batch.column(1))
            rows, keys, nodes, size = [], [], [], 0
            for lo, hi in chunks(bounds):
                grams, sizes = gram_sets(raw, bounds[lo : hi + 1], width)
                s1, s2 = (s.view(np.int64) for s in _digest(grams, sizes))
                row = np.zeros(hi - lo, _ROW)
                row["doc"], row["n"], row["s1"], row["s2"] = doc[lo:hi], sizes, s1, s2
                rows.append(row)
                key, at = block_keys(grams, sizes, Bands(num, den, int(sizes.max(initial=1))), hot.value)
                keys.append(key)
                nodes.append(s1[at] & _NODE)
                size += len(key)
                if size > _HELD:
                    yield batch_of(list(filed(keys, nodes)))
                    keys, nodes, size = [], [], 0
            row = np.concatenate(rows) if rows else np.zeros(0, _ROW)
            # by document, as equal sets needn't meet here: many copies of one text would fill a bucket
            yield batch_of([*((b, 0, part) for b, part in _dealt(row, mix(row["doc"].view(np.uint64)), buckets)), *filed(keys, nodes)])

    return run


def _dealt(rows: np.ndarray, by: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Rows dealt into buckets by a hash, each bucket's as bytes."""
    where = (by % _U(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    rows, where = rows[order], where[order]
    cut = np.flatnonzero(np.diff(where)) + 1
    for part, b in zip(np.split(rows, cut), where[np.concatenate([[0], cut])] if len(where) else [], strict=False):
        yield int(b), part.tobytes()


_MET = "kind int, a long, b long, c long, d long, e int"


def _meet(num: int, den: int):
    """Reduce side: rows as filed, and a forest that joins the nodes of each key of the bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blobs = {k: b"".join(pdf.blob[pdf.kind == k]) for k in (0, 1, 2)}
        row = np.frombuffer(blobs[0], _ROW)
        filed = np.frombuffer(blobs[1], _KEY)
        bands = Bands(num, den, int(row["n"].max(initial=1)))
        docs = pd.DataFrame({"kind": 0, "a": row["doc"], "b": row["n"], "c": row["s1"], "d": row["s2"], "e": bands.of(row["n"])})
        key = filed["high"].astype(np.uint64) << _U(32) | filed["low"]
        node = filed["node_high"].astype(np.int64) << 32 | filed["node"]
        pairs = [*_chain(key, node).items(), *np.frombuffer(blobs[2], "<i8").reshape(-1, 2).tolist()]
        met = pd.DataFrame(pairs, columns=["a", "b"], dtype="int64").assign(kind=1, c=0, d=0, e=0)
        return pd.concat([docs, met[["kind", "a", "b", "c", "d", "e"]]]).astype({"kind": "int32", "e": "int32"})

    return run


def overlaps(rows: list[np.ndarray], side: np.ndarray, alone: bool, num: int, den: int, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Linking pairs of a tile. alone: of all its rows with each other; else of those of side 0 with those of side 1.

    Overlap counts are accumulated over column chunks; rows without a pair that can still reach its bound are dropped.
    """
    left = np.flatnonzero(side == 0)
    right = left if alone else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return left[:0], left[:0]
    size = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), size)
    column, at = np.unique(np.concatenate(rows), return_inverse=True)
    shared = np.bincount(at) > 1
    keep = shared[at]
    row, column = row[keep], (np.cumsum(shared) - 1)[at[keep]]
    width = int(shared.sum())
    need = -(-num * (size[left][:, None] + size[right][None, :]) // (num + den))
    count = np.zeros((len(left), len(right)), np.int32)
    rest = np.bincount(row, minlength=len(rows))
    i, j = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, width, chunk):
        s, t = np.searchsorted(column, [lo, lo + chunk])
        block = np.zeros((len(rows), min(chunk, width - lo)), np.float32)
        block[row[s:t], column[s:t] - lo] = 1
        count[np.ix_(i, j)] += (block[left[i]] @ block[right[j]].T).astype(np.int32)
        rest = rest - np.bincount(row[s:t], minlength=len(rows))
        alive = count[np.ix_(i, j)] + np.minimum(rest[left[i]][:, None], rest[right[j]][None, :]) >= need[np.ix_(i, j)]
        if alone:
            alive &= left[i][:, None] != right[j][None, :]
        i, j = i[alive.any(1)], j[alive.any(0)]
        if not len(i):
            break
    sub = np.ix_(i, j)
    a, b = np.nonzero((count[sub] >= need[sub]) if len(i) else np.zeros((0, 0), bool))
    a, b = left[i[a]], right[j[b]]
    if alone:
        a, b = a[a < b], b[a < b]
    return a, b


def _by_run(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of equal keys of a sorted partition, each whole; holds one run and one batch at a time."""
    held: pd.DataFrame | None = None
    for f in frames:
        f = f if held is None else pd.concat([held, f], ignore_index=True)
        if not len(f):
            continue
        k = f[keys].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        for lo, hi in zip([0, *cut[:-1]], cut, strict=False) if len(cut) else ():
            yield f.iloc[lo:hi]
        held = f.iloc[cut[-1] if len(cut) else 0 :]
    if held is not None and len(held):
        yield held


_TILE = ["grp", "c1", "c2", "i", "j"]
#: A set that more than one of so many rows have is one of many copies; there are fewer than this.
MANY = 1_000


def _multiply(num: int, den: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tile in _by_run(frames, _TILE):
            tile = tile.drop_duplicates(["rep", "s1"])
            if len(tile) < 2:
                continue
            rep, copies = tile.rep.to_numpy(), tile.copies.to_numpy()
            a, b = overlaps([np.frombuffer(g, np.uint64) for g in tile.grams], tile.side.to_numpy(), bool((head := tile.iloc[0]).c1 == head.c2 and head.i == head.j), num, den)
            if not len(a):
                continue
            links = np.bincount(a, copies[b], len(tile)) + np.bincount(b, copies[a], len(tile))
            up = _forest(rep[a], rep[b])
            hit = np.flatnonzero(links)
            roots = [up.get(x, x) for x in rep[hit].tolist()]
            yield pd.DataFrame({"rep": rep[hit], "s1": tile.s1.to_numpy()[hit], "root": roots, "links": links[hit].astype(np.int64)})

    return run


def _with_grams(width: int):
    """Adds each candidate's n-gram hashes; a row whose text isn't the one that was filed, or that was met before, is left out.

    Rows come sorted by rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = None, set()
        for batch in batches:
            raw, bounds = text_bytes(batch.column("text"))
            names = [c for c in batch.schema.names if c != "text"]
            for lo, hi in chunks(bounds):
                grams, sizes = gram_sets(raw, bounds[lo : hi + 1], width)
                s1 = _digest(grams, sizes)[0].view(np.int64)
                at = np.concatenate([[0], np.cumsum(sizes)])
                part = batch.slice(lo, hi - lo)
                same = s1 == part.column("s1").to_numpy()
                for i in np.flatnonzero(same):
                    if (rep := part.column("rep")[i].as_py()) != last:
                        last, met = rep, set()
                    same[i] = s1[i] not in met
                    met.add(s1[i])
                blobs = pa.array([grams[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), blobs], [*names, "grams"]).filter(pa.array(same))

    return run


#: Bytes of text whose keys one bucket holds, about; so a bucket stays small at any size of the corpus.
BUCKET_BYTES = 16 << 20


def ngram_jaccard(docs: DataFrame, ngram: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = 1024) -> DataFrame:
    """Links documents whose sets of distinct word n-grams have a Jaccard similarity of at least num/den, exactly.

    Returns a row for each row of docs: (doc_id, n_shingles, component_id, n_links). component_id is the least id that
    links lead to; n_links counts the other rows linked directly, copies included.

    A null, empty or blank text has no n-grams (0), links with nothing and is a component of its own. A text of fewer words
    than ngram is one n-gram. Rows that repeat an id are one document with several texts: each row is returned, those with
    words all with the same component. A row without an id can't be named by a link: it gets null n_shingles and
    component_id, and 0 links. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = base.where("doc_id is not null")
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(4 * shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    hot = spark.sparkContext.broadcast(hot_grams(named, ngram))
    met = materialize(
        named.mapInArrow(lean(_file_keys(ngram, num, den, buckets, hot)), "bucket long, kind int, blob binary")
        .groupBy("bucket").applyInPandas(lean_group(_meet(num, den)), _MET)
    )
    rows = met.where("kind = 0").selectExpr("a as doc_id", "b as n", "c as s1", "d as s2", "e as cls")
    reps = materialize(rows.groupBy("s1", "s2", "n", "cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    groups = components(met.where("kind = 1").select("a", "b"))
    candidates = materialize(
        reps.join(groups, reps.s1.bitwiseAND(F.lit(_NODE)) == groups.node).selectExpr("rep", "s1", "n", "cls", "copies", "root as grp")
    )
    tiles = materialize(_tiles(candidates, tile_rows))
    grams = materialize(
        maybe_in(named, "doc_id", id_filter(candidates, "rep")).join(tiles.hint("merge"), F.col("doc_id") == tiles.rep)
        .select("rep", "s1", "copies", "tile", "text")
        .mapInArrow(lean(_with_grams(ngram)), "rep long, s1 long, copies long, tile array<struct<grp:long,c1:int,c2:int,i:int,j:int,side:int>>, grams binary")
    )
    links = _in_rounds(grams, _rounds(tiles), num, den)
    joined = components(links.selectExpr("rep as a", "root as b").unionByName(_same_ids(rows, reps)))
    counted = links.groupBy("rep", "s1").agg(F.sum("links").alias("links"))
    named_by = materialize(
        reps.alias("r").join(joined, F.col("r.rep") == joined.node, "left")
        .join(counted.alias("l"), (F.col("r.rep") == F.col("l.rep")) & (F.col("r.s1") == F.col("l.s1")), "left")
        .select("r.s1", "r.s2", "r.rep", F.coalesce("root", "r.rep").alias("component"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    )
    # sets with a large share of all rows are few, so they are broadcast, and a join by set never gathers their rows in one task
    many = named_by.crossJoin(F.broadcast(reps.agg(F.sum("copies").alias("all")))).where(f"copies * {MANY} > all").select(named_by.columns)
    split = rows.where("n > 0").join(F.broadcast(many.select("s1", "s2", F.lit(True).alias("many"))), ["s1", "s2"], "left")
    told = split.where("many").join(F.broadcast(many), ["s1", "s2"]).unionByName(split.where("many is null").join(named_by, ["s1", "s2"]))
    out = told.selectExpr("doc_id", "n as n_shingles", "component as component_id", "links + copies - 1 as n_links").unionByName(
        rows.where("n = 0").selectExpr("doc_id", "n as n_shingles", "doc_id as component_id", "0L as n_links")
    )
    nameless = base.where("doc_id is null").selectExpr("doc_id", "cast(null as long) as n_shingles", "cast(null as long) as component_id", "0L as n_links")
    return out.unionByName(nameless)


def _same_ids(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) that join the sets of each id with several, by their representatives."""
    own = rows.where("n > 0").select("doc_id", F.struct("s1", "s2").alias("set"))
    several = materialize(own.groupBy("doc_id").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo <> hi").select("doc_id"))
    sets = own.join(several, "doc_id").distinct()
    mine = sets.select("doc_id", "set.s1", "set.s2").join(reps.select("s1", "s2", "rep"), ["s1", "s2"])
    return mine.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))


#: N-grams dealt out at a time, as a multiple of those of all candidates, about.
ROUND = 2


def _rounds(tiles: DataFrame) -> int:
    own, dealt = tiles.agg(F.sum("n"), F.sum(F.col("n") * F.size("tile"))).first()
    return -(-(dealt or 0) // (ROUND * (own or 1))) or 1


def _in_rounds(grams: DataFrame, rounds: int, num: int, den: int) -> DataFrame:
    """Links of all tiles, (rep, s1, root, links). A tile belongs to one round; each is written before the next one's rows are dealt out."""
    out = []
    for r in range(rounds):
        mine = f"filter(tile, t -> pmod(xxhash64({', '.join(f't.{c}' for c in _TILE)}), {rounds}) = {r})"
        out.append(materialize(
            grams.select("rep", "s1", "copies", "grams", F.explode(F.expr(mine) if rounds > 1 else F.col("tile")).alias("t"))
            .select("rep", "s1", "copies", "grams", "t.*").repartition(*_TILE).sortWithinPartitions(*_TILE)
            .mapInPandas(lean(_multiply(num, den)), "rep long, s1 long, root long, links long")
        ))
    return reduce(DataFrame.unionByName, out)


def _tiles(candidates: DataFrame, tile_rows: int, tile_grams: int = 1 << 19) -> DataFrame:
    """Candidates with the tiles of their group's product that they take part in.

    A group of at most tile_rows rows with tile_grams n-grams is one tile. A larger one is cut into cells by size band and,
    within it, by hash, so that a cell holds about so many of both; tiles pair the cells of one band and of adjacent bands, as
    no others hold links.
    """
    cells = candidates.groupBy("grp", "cls").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    parts = F.ceil(F.greatest(F.col("m") / tile_rows, F.least("m", F.col("w") / tile_grams))).cast("int")
    shape = materialize(
        cells.groupBy("grp").agg(F.sum("m").alias("total"), F.sum("w").alias("wide"), F.map_from_entries(F.collect_list(F.struct("cls", parts.alias("k")))).alias("parts"))
        .where("total > 1").withColumnRenamed("grp", "g")
    )  # a band's number of parts; there are as many entries as size bands, at most a few hundred
    spot = "struct(grp, {} as c1, {} as c2, {} as i, {} as j, {} as side)"
    many = f"""concat(
        transform(sequence(0, k - 1), x -> {spot.format("cls", "cls", "least(h, x)", "greatest(h, x)", "if(h <= x, 0, 1)")}),
        if(up is null, array(), transform(sequence(0, up - 1), x -> {spot.format("cls", "cls + 1", "h", "x", "0")})),
        if(down is null, array(), transform(sequence(0, down - 1), x -> {spot.format("cls - 1", "cls", "x", "h", "1")})))"""
    return (
        candidates.join(shape, candidates.grp == shape.g)
        .selectExpr("*", "parts[cls] as k", "parts[cls + 1] as up", "parts[cls - 1] as down")
        .selectExpr("*", "cast(pmod(xxhash64(rep, 7L), k) as int) as h")
        .selectExpr("rep", "s1", "copies", "n", f"if(total <= {tile_rows} and wide <= {tile_grams}, array({spot.format('-1', '-1', '0', '0', '0')}), {many}) as tile")
    )
