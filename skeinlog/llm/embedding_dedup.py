"""Operator 5: near-duplicate embeddings by int8 tile products with error bounds, exact after a recheck.

Vectors are scaled to length one and rounded to 8-bit integers, once, where they are read. For each, the length e of what
rounding took away is known, so the product of two rounded vectors is off by at most e1 * (1 + e2) + e2. Only the integers are
shuffled: a tile multiplies those of up to tile_rows vectors with as many others (in single precision, which holds these sums
exactly). Pairs whose bound lies above the threshold are links, those whose bound lies below it are none; vectors with a pair in
between are looked up in full for the tiles where that is so, and there only such pairs are computed in double precision.

Only vectors with the same label are compared. Equal vectors are one row with a count of copies. A label's vectors are dealt
into blocks by hash, and a tile is a pair of blocks, so a label of any size is many tasks; no pair ever leaves a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import _by_run, _forest
from .shared import components, id_filter, materialize, maybe_in

_TILE = ["label", "i", "j"]


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(8-bit integers, scale, upper bound of the length of the error) of each row, scaled to length one."""
    unit = vectors / np.abs(vectors).max(1, keepdims=True)  # first, so that squares neither overflow nor vanish
    unit = unit / np.sqrt((unit * unit).sum(1))[:, None]
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(1)) + 1e-12
    return q.astype(np.int8), scale, error


def screen(a: tuple, b: tuple | None, least: float, side: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of two quantised sets (or of one with itself) whose cosine may be least or more, with whether that is sure."""
    alone = b is None
    (qa, sa, ea), (qb, sb, eb) = a, a if alone else b
    for i in range(0, len(qa), side):
        for j in range(i if alone else 0, len(qb), side):
            x, y = slice(i, i + side), slice(j, j + side)
            product = np.zeros((len(qa[x]), len(qb[y])))
            for k in range(0, qa.shape[1], 1024):  # 1024 products of at most 127 * 127 are exact in single precision
                product += qa[x, k : k + 1024].astype(np.float32) @ qb[y, k : k + 1024].astype(np.float32).T
            product *= sa[x][:, None] * sb[y][None, :]
            bound = ea[x][:, None] * (1 + eb[y][None, :]) + eb[y][None, :]
            p, r = np.nonzero(product + bound >= least - 1e-9)
            sure = (product - bound)[p, r] >= least + 1e-9
            p, r = p + i, r + j
            if alone:
                p, r, sure = p[p < r], r[p < r], sure[p < r]
            yield p, r, sure


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two sets, in double precision."""
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _parts(tile: pd.DataFrame) -> list[pd.DataFrame]:
    """The two sides of a tile, or its only one; none if a side is empty."""
    alone = tile.i.iat[0] == tile.j.iat[0]
    parts = [tile] if alone else [tile[tile.side == 0], tile[tile.side == 1]]
    return parts if all(len(p) for p in parts) else []


def _told(parts: list[pd.DataFrame], a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Links of a tile: how many each vector has, copies included, and a root that its links lead to."""
    rep, copies = [p.rep.to_numpy() for p in parts], [p.copies.to_numpy() for p in parts]
    up = _forest(rep[0][a], rep[-1][b])
    own = lambda k, at, of: pd.DataFrame({"rep": rep[k][at], "d1": parts[k].d1.to_numpy()[at], "d2": parts[k].d2.to_numpy()[at], "links": of})
    links = pd.concat([own(0, a, copies[-1][b]), own(-1, b, copies[0][a])]).groupby(["rep", "d1", "d2"], as_index=False).sum()
    links["root"] = [up.get(x, x) for x in links.rep.tolist()]
    return links


def _screened(least: float):
    """Sure links of each tile (side null), and the vectors with a pair that isn't decided (side 0 or 1)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tile in _by_run(frames, _TILE):
            parts, found, open_rows = _parts(tile), [], []
            for n, at in _by_width(parts, parts and [p.codes.map(len).to_numpy() for p in parts]):
                sets = [
                    (np.frombuffer(b"".join(p.codes.iloc[k]), np.int8).reshape(len(k), n), p.scale.to_numpy()[k], p.error.to_numpy()[k])
                    for p, k in zip(parts, at, strict=True)
                ]
                for a, b, sure in screen(sets[0], sets[1] if len(sets) > 1 else None, least):
                    found.append((at[0][a[sure]], at[-1][b[sure]]))
                    for k, x in ((0, a), (-1, b)):
                        open_rows.append(parts[k].iloc[np.unique(at[k][x[~sure]])])
            if found and sum(len(a) for a, _ in found):
                yield _told(parts, *(np.concatenate(x) for x in zip(*found, strict=True))).assign(label=tile.label.iat[0], i=0, j=0, side=None, copies=0)[_OUT]
            if open_rows and sum(map(len, open_rows)):
                yield pd.concat(open_rows).drop_duplicates(["rep", "d1", "d2", "side"]).assign(links=0, root=0)[_OUT]

    return run


_OUT = ["label", "i", "j", "side", "rep", "d1", "d2", "copies", "root", "links"]


def _rechecked(least: float):
    """Links among the pairs that screening left open, from full vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tile in _by_run(frames, _TILE):
            parts, found = _parts(tile.drop_duplicates(["rep", "d1", "d2", "side"])), []
            for _, at in _by_width(parts, parts and [p.embedding.map(len).to_numpy() for p in parts]):
                full = [np.stack(list(p.embedding.iloc[k])).astype(np.float64) for p, k in zip(parts, at, strict=True)]
                full = [np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1]) for v in full]  # powers of two: exact, and no square overflows
                sets = [quantise(v) for v in full]
                for a, b, sure in screen(sets[0], sets[1] if len(sets) > 1 else None, least):
                    a, b = a[~sure], b[~sure]
                    for lo in range(0, len(a), 1 << 15):
                        x, y = a[lo : lo + (1 << 15)], b[lo : lo + (1 << 15)]
                        near = cosine(full[0][x], full[-1][y]) >= least
                        found.append((at[0][x[near]], at[-1][y[near]]))
            if found and sum(len(a) for a, _ in found):
                yield _told(parts, *(np.concatenate(x) for x in zip(*found, strict=True)))[["rep", "d1", "d2", "root", "links"]]

    return run


def _by_width(parts: list[pd.DataFrame], widths: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows of each part with vectors of the same number of components; others can't be compared."""
    for n in np.unique(widths[0]) if parts else ():
        at = [np.flatnonzero(w == n) for w in widths]
        if all(len(k) for k in at):
            yield int(n), at


def _quantised(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            width, n = lists.value_lengths().to_numpy(), len(lists)
            values, first = lists.values.to_numpy(), lists.offsets.to_numpy()
            codes, scale, error = [b""] * n, np.zeros(n), np.zeros(n)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                for lo in range(0, len(at), 1024):
                    k = at[lo : lo + 1024]
                    q, scale[k], error[k] = quantise(values[first[k][:, None] + np.arange(w)])
                    for i, row in zip(k.tolist(), q, strict=True):
                        codes[i] = row.tobytes()
            names = [c for c in batch.schema.names if c != "embedding"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(codes, pa.binary()), pa.array(scale), pa.array(error)], [*names, "codes", "scale", "error"])

    return run, f"vec_id long, label {kind}, d1 long, d2 long, codes binary, scale double, error double"


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile_rows: int = 2048) -> DataFrame:
    """Links vectors of equal labels with cosine >= least: (vec_id, n_links, component_id, kept), a row for each row.

    A vector that is null, empty, zero, or holds a null or a number that isn't finite links with nothing, and so does one
    with a null label or of another number of components; it is a component of its own and is kept. component_id is the
    least id that links lead to. Rows that repeat an id are each a vector, and one document in the components; rows without
    an id have a null component and aren't kept. Other columns are ignored, whatever their names. An empty table gives an
    empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    kind = rows.schema["label"].dataType.simpleString()
    test = (
        "vec_id is not null and label is not null and embedding is not null and size(embedding) > 0"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0D)"
    )
    # -0.0 counts as 0.0 in the digest
    sound = rows.where(test).selectExpr("vec_id", "label", "xxhash64(transform(embedding, x -> x + 0D)) as d1", "xxhash64(7L, transform(embedding, x -> x + 0D)) as d2", "embedding")
    keyed = materialize(sound.mapInArrow(*_quantised(kind)))
    reps = materialize(
        keyed.groupBy("label", "d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first(F.struct("codes", "scale", "error")).alias("q"))
        .select("label", "d1", "d2", "rep", "copies", "q.*")
    )
    parts = materialize(reps.groupBy("label").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("k")).withColumnRenamed("label", "l"))
    screened = materialize(
        reps.join(parts, reps.label == parts.l).withColumn("h", F.expr("cast(pmod(xxhash64(rep, d1, 11L), k) as int)"))
        .select("label", "d1", "d2", "rep", "copies", "codes", "scale", "error", F.expr("explode(transform(sequence(0, k - 1), x -> struct(least(h, x) as i, greatest(h, x) as j, if(h <= x, 0, 1) as side)))").alias("t"))
        .select("label", "t.*", "rep", "d1", "d2", "copies", "codes", "scale", "error")
        .repartition(*_TILE).sortWithinPartitions(*_TILE)
        .mapInPandas(_screened(least), f"label {kind}, i int, j int, side int, rep long, d1 long, d2 long, copies long, root long, links long")
    )
    undecided = screened.where("side is not null").drop("root", "links")
    some = maybe_in(sound, "vec_id", id_filter(undecided, "rep")).toDF("vec_id", "vl", "v1", "v2", "embedding")
    rechecked = (
        some.join(undecided.hint("merge"), (F.col("vec_id") == F.col("rep")) & (F.col("v1") == F.col("d1")) & (F.col("v2") == F.col("d2")) & (F.col("vl") == F.col("label")))
        .select(*undecided.columns, "embedding").repartition(*_TILE).sortWithinPartitions(*_TILE)
        .mapInPandas(_rechecked(least), "rep long, d1 long, d2 long, root long, links long")
    )
    links = materialize(screened.where("side is null").select("rep", "d1", "d2", "root", "links").unionByName(rechecked))
    # an id with several vectors joins them: copies are known by their least id
    several = materialize(keyed.groupBy("vec_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.min("label").alias("ll"), F.max("label").alias("lh")).where("lo <> hi or ll <> lh").select(F.col("vec_id").alias("b")))
    same = keyed.select("vec_id", "label", "d1", "d2").join(several, F.col("vec_id") == F.col("b")).distinct().join(reps.select("label", "d1", "d2", "rep"), ["label", "d1", "d2"]).selectExpr("rep as a", "b")
    joined = components(links.selectExpr("rep as a", "root as b").unionByName(same))
    counted = links.groupBy(F.col("rep").alias("r"), F.col("d1").alias("r1"), F.col("d2").alias("r2")).agg(F.sum("links").alias("links"))
    named = materialize(
        reps.drop("codes", "scale", "error").join(joined, reps.rep == joined.node, "left")
        .join(counted, (F.col("rep") == F.col("r")) & (F.col("d1") == F.col("r1")) & (F.col("d2") == F.col("r2")), "left")
        .select("label", "d1", "d2", F.coalesce("root", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    out = keyed.select("vec_id", "label", "d1", "d2").join(named, ["label", "d1", "d2"]).select(
        "vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept")
    )
    lone = rows.where(f"not coalesce({test}, false)")
    return out.unionByName(lone.selectExpr("vec_id", "0L as n_links", "vec_id as component_id", "vec_id is not null as kept"))
