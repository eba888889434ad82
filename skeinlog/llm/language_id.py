"""Operator 6: language identification by averaged hashed subword embeddings and a linear softmax.

A text's vector is the mean of the embeddings of its subwords (2 to 4 bytes inside a word and its borders, hashed); a linear
layer and a softmax make it a language. Embeddings and layer are trained together by stochastic gradient descent in numpy on a
bounded sample. A temperature fitted on texts kept out of training calibrates the scores, and a score below the threshold
found there is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled texts that the model is fitted on, at most, by a digest of the id; and subword buckets and vector length.
FIT_ROWS = 2_500
BUCKETS, WIDTH = 1 << 15, 16

_LETTER = regex.compile(r"\p{L}")
_BORDER = np.ones(256, bool)
_BORDER[[*range(97, 123), *range(128, 256)]] = False


#: Bytes of a text whose subwords are worked out together.
_CHUNK = 1 << 20


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Buckets of the subwords of a whole text: 2 to 4 bytes, of which inner ones aren't word borders; those that begin in one stretch
    of bytes at a time, so that memory is the text's and a stretch's."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
    for at in range(0, len(raw), _CHUNK):
        own = raw[at : at + _CHUNK + 3]
        border = _BORDER[own]
        b = np.where(border, 32, own).astype(np.uint32)
        for n in (2, 3, 4):
            m = min(len(own) - n + 1, _CHUNK)
            if m <= 0:
                continue
            packed, clear = b[:m].copy(), np.ones(m, bool)
            for k in range(1, n):
                packed = (packed << np.uint32(8)) | b[k : m + k]
                if k < n - 1:
                    clear &= ~border[k : m + k]
            if n == 2:
                clear = ~(border[:m] & border[1 : m + 1])
            packed = packed[clear] ^ np.uint32(n * 0x1F123BB5 & 0xFFFFFFFF)
            packed ^= packed >> np.uint32(15)
            yield ((packed * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


def subword_counts(text: str) -> np.ndarray:
    """How often a whole text has the subwords of each bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for ids in _pieces(text):
        out += np.bincount(ids, minlength=BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: each subword's embedding times the layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated score; 'und' and 0 for a text that is null or has no letter."""
        if text is None or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        p = self.probabilities(subword_counts(text))
        k = int(p.argmax())
        return self.languages[k], float(p[k])

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.table / max(int(counts.sum()), 1) + self.bias

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(counts) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different subwords of a text (at most BUCKETS) and how often it has each."""
    counts = subword_counts(text)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def train(texts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 6, rate: float = 0.4, seed: int = 5) -> Model:
    """Stochastic gradient descent over four fifths of the texts, given as counted subwords; the others fit the temperature and the
    threshold."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    seen = [(i, t, names.index(y)) for i, (t, y) in enumerate(zip(texts, langs, strict=True))]
    if not seen:
        return Model(names, np.zeros((BUCKETS, len(names))), np.zeros(len(names)))
    embedding = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    layer, bias = rng.normal(0, 0.1, (WIDTH, len(names))), np.zeros(len(names))
    fit, kept = [s for s in seen if s[0] % 5], [s for s in seen if not s[0] % 5]
    steps = epochs * max(len(fit), 1)
    step = 0
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            _, (ids, n), y = fit[k]
            share = n / n.sum()
            mean = share @ embedding[ids]
            error = _softmax(mean @ layer + bias)
            error[y] -= 1
            lr = rate * (1 - step / steps)
            back = layer @ error
            layer -= lr * np.outer(mean, error)
            bias -= lr * error
            embedding[ids] -= lr * len(ids) ** 0.5 * share[:, None] * back
            step += 1
    model = Model(names, embedding @ layer, bias)
    if kept:
        z = np.array([model.logits(np.bincount(*s[1][:1], weights=s[1][1], minlength=BUCKETS)) for s in kept])
        y = np.array([s[2] for s in kept])

        def loss(t: float) -> float:
            return -float(np.mean([np.log(_softmax(r / t)[k] + 1e-12) for r, k in zip(z, y, strict=True)]))

        model.temperature = min(np.geomspace(0.5, 8, 40), key=loss)
        p = np.array([_softmax(r / model.temperature) for r in z])
        top, right = p.max(1), p.argmax(1) == y
        order = np.argsort(-top)
        precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= 0.99
        model.threshold = float(top[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return model


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Fits a model on at most fit_rows documents with a language and a letter, outside the held-out third of the ids.

    Texts stay on executors: the driver gets the counts of their subwords, so its share is bounded however long texts are.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    named = named.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    # a bounded number of ids, so broadcasting them is safe at any size of the corpus
    chosen = F.broadcast(named.select("id", F.xxhash64("id").alias("order")).dropDuplicates(["id"]).orderBy("order", "id").limit(fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("text")):
                if _LETTER.search(t := text.as_py()):
                    ids, n = counted(t)
                    row = batch.slice(k, 1)
                    told = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (ids, n)]
                    yield pa.RecordBatch.from_arrays([row.column("order"), row.column("id"), row.column("lang"), *told], ["order", "id", "lang", "ids", "n"])

    kind = named.schema["id"].dataType.simpleString()
    rows = (
        named.where("text is not null").join(chosen, "id").select("order", "id", "text", "lang").mapInArrow(run, f"order long, id {kind}, lang string, ids binary, n binary")
        .orderBy("order", "id", "lang", F.xxhash64("ids", "n")).limit(fit_rows).collect()
    )
    read = lambda b: np.frombuffer(b, "<i4")
    return train([(read(r.ids), read(r.n)) for r in rows], [r.lang for r in rows])


def held_out(doc_id) -> F.Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of each whole text: (doc_id, lang_pred, score, rejected); a row for each row of docs.

    A null text, or one without a letter, is 'und' with score 0 and rejected; so is every text if nothing was learned.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([s < m.threshold or x == "und" for x, s in found], pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
