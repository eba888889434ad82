"""Operators 11 to 13, and long texts for 6 and 8, against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlog.llm import dual_tree, language_id, pii_crf, sharding, spelling

DOCS = "doc_id long, text string, shard string, word string, n long, id long, covered string"


def docs(spark, rows):
    """Rows (id, text), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "clash", "clash", 7, 7, "clash") for i, t in rows], DOCS)


# ── 11: spelling variants ──────────────────────────────────────────────────────


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k:])


def brute_words(rows, least=7, often=2, every=31):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= often}


def brute_forms(words, times=10):
    out = {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= times * n else None
        out[w] = [form, n, len(close), words[form] if form else None]
    rows = set()
    for w, (form, n, many, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, many, form_n))
    return rows


def variants(r, n):
    stems = ["".join(r.choice("abcdé") for _ in range(r.choice([6, 7, 8, 9]))) for _ in range(12)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(r.randrange(0, 30)):
            w = r.choice(stems)
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abcdé") + w[at:], w[:at] + r.choice("abcdé") + w[at + 1 :]])
            words.append(r.choice([w, w.capitalize(), w.upper()]))
        rows.append((r.choice([k, k, None]), r.choice([" ", ", ", "-", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_spelling_variants_against_brute_force(spark, parts):
    """With ranges of few words, so that nodes go on over many bounds."""
    rows = [*variants(random.Random(parts), 260), (None, None), (None, ""), (5, "aaaaaaaa aaaaaaaaa AAAAAAAA aaaaaaab aaaaaaab"), (5, "a" * 60_000 + " " + "a" * 60_000), (6, "a" * 60_001 + "," + "a" * 60_001)]
    rows += [(100 + k, "chainabcd " * 60 + "chainabce " * 5 + "chainabxe " * (k < 3)) for k in range(10)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = spelling.vocabulary(docs(spark, rows))
        want = brute_words(rows)
        assert dict(tuple(r) for r in found.collect()) == want
        got = {tuple(r) for r in spelling.spelling_variants(found).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == brute_forms(want) and sum(r[1] is not None for r in got) > 20 and any(r[:3] == ("chainabxe", "chainabce", "chainabcd") for r in got)


def test_spelling_without_words(spark):
    assert spelling.spelling_variants(spelling.vocabulary(docs(spark, [(1, "short words"), (2, None)]))).count() == 0
    assert spelling.spelling_variants(spelling.vocabulary(docs(spark, []))).count() == 0


def test_words_are_the_same_however_texts_are_cut(monkeypatch, spark):
    rows = [(k, t) for k, (_, t) in enumerate(variants(random.Random(1), 50))]
    import pyarrow as pa

    monkeypatch.setattr(spelling, "_PIECE", 5)
    told = Counter()
    for b in spelling._counted(7, 31)(iter([pa.RecordBatch.from_arrays([pa.array([str(i) for i, _ in rows]), pa.array([t for _, t in rows])], names=["i", "t"])])):
        told.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
    assert {w: n for w, n in told.items() if n > 1} == brute_words(rows)


# ── 12: sharding ───────────────────────────────────────────────────────────────


def test_shards(spark):
    rows = [(i, f"text {i % 50} é") for i in range(3000)] + [(None, None), (None, "x"), (7, "text 7 é"), (7, ""), (7, "long " * 200_000)] + [(99, "hot")] * 2000
    got = sharding.assign_shards(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    places = Counter()
    for r in got:
        places[r.shard] += 1
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(places[s]))
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    ids = {r.doc_id: r for r in got}
    share = Counter(r.shard for r in ids.values())
    assert all(abs(share[s] - len(ids) / 8) < 5 * math.sqrt(len(ids) / 8) for s in range(8))
    moved = sum(r.grown_shard == 8 for r in ids.values())
    assert abs(moved - len(ids) / 9) < 5 * math.sqrt(len(ids) / 9)
    again = sharding.assign_shards(docs(spark, rows).repartition(7)).collect()
    assert Counter((r.doc_id, r.shard, r.slot) for r in again if r.doc_id not in (7, 99, None)) == Counter((r.doc_id, r.shard, r.slot) for r in got if r.doc_id not in (7, 99, None))
    assert sharding.assign_shards(docs(spark, [])).count() == 0


def test_weights_of_shards(spark, tmp_path):
    weights = (3, 0, 1)
    many = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    share = Counter(r.shard for r in sharding.assign_shards(many, weights, 4).collect())
    assert share[1] == 0 and abs(share[0] - 6000) < 250
    grown = Counter((r.shard, r.grown_shard) for r in sharding.assign_shards(many, weights, 4).collect())
    assert abs(sum(n for (_, g), n in grown.items() if g == 3) - 4000) < 300 and not any(s != g for s, g in grown if g != 3)
    with pytest.raises(ValueError):
        sharding.assign_shards(many, (0, 0))
    sharding.write_shards(many, str(tmp_path / "out"), weights)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 8000 and {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == {s: n for s, n in share.items() if n}


# ── 13: ranked search ──────────────────────────────────────────────────────────

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(rows, items, k):
    own = [(i, Counter(terms(t))) for i, t in rows]
    own = [(i, c) for i, c in own if c]
    n, words = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for i, c in own:
            m = 25 + 75 * c.total() * n // words
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in Counter(terms(text)).items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out.update((item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ranked_search_against_brute_force(spark, monkeypatch, seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["é", "漢字", "ＡＢ", "x²"]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    say = lambda n: r.choice([" ", "_", "... ", "\n"]).join(r.choices(vocab, weights, k=n)).replace("w1", "W1")
    rows = [(i, say(r.choice([1, 3, 20, 90]))) for i in range(700)] + [(3, say(5)), (None, say(9)), (None, None), (11, ""), (12, "!!! ,,,"), (13, "w5 " * 90_000)]
    rows += [(1000 + i, "same text w7 w8 w9") for i in range(40)]
    items = [(k, say(r.choice([1, 2, 12, 40]))) for k in range(60)] + [(60, None), (61, ""), (62, "nowhere"), (3, "w2 w2 w2 w3"), (None, "w4")]
    if seed == 2:  # several chunks, small trees and a first pass that sees little
        monkeypatch.setattr(dual_tree, "ITEMS", 20)
        monkeypatch.setattr(dual_tree, "PROBE", 16)
    got = dual_tree.ranked_search(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(tuple(x) for x in got.collect()) == brute_search(rows, items, 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_without_documents_or_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dual_tree.ranked_search(docs(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    assert dual_tree.ranked_search(docs(spark, [(1, "a")]), none).count() == 0


def test_most_pairs_are_pruned():
    """Groups of documents of one kind: once an item has its k documents, other groups are passed over as a whole."""
    rng = np.random.default_rng(3)
    groups, items = 30, []
    for g in range(groups):
        items += [(len(items), len(items), g, [f"t{g}_{k}" for k in rng.choice(40, 8, replace=False)], [1000] * 8) for _ in range(8)]
    tree = dual_tree.Items(items, 10)
    plain = {i: [] for i in range(len(items))}
    place = {t: i for i, t in enumerate(tree.vocab)}
    scored = total = 0
    for b in range(groups):
        cols = np.array(sorted(place[t] for t in tree.vocab if t.startswith(f"t{b}_") or t.startswith("t0_")), np.int64)
        matrix = np.zeros((64, len(cols)), tree.kind)
        for d in range(64):
            matrix[d, rng.choice(len(cols), 12, replace=False)] = rng.integers(1, 900)
        ids = np.arange(b * 64, b * 64 + 64)
        scored += tree.search(matrix, cols, ids)
        total += 64 * len(items)
        dense = tree.items.dense(cols, tree.kind)
        for i, row in enumerate(dense @ matrix.T):
            plain[i] += [(-s, d) for s, d in zip(row, ids, strict=True) if s > 0]
    for i, (scores, ids) in enumerate(tree.best):
        assert [(-s, d) for s, d in zip(scores, ids, strict=True)] == sorted(plain[i])[:10]
    assert scored < total / 4


# ── 6 and 8: long texts ────────────────────────────────────────────────────────


def test_subwords_are_the_same_however_texts_are_cut(monkeypatch):
    r = random.Random(5)
    texts = ["", "a", "the cat", "x" * 50, *("".join(r.choice("aé b1,ß\n") for _ in range(r.randrange(200))) for _ in range(60))]
    whole = [language_id.subword_counts(t) for t in texts]
    monkeypatch.setattr(language_id, "_CHUNK", 7)
    for t, w in zip(texts, whole, strict=True):
        assert (language_id.subword_counts(t) == w).all()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def test_base_spans_are_those_of_the_plain_patterns():
    r = random.Random(6)
    parts = ["a", "b.c", "@", "@", "x.y", ".", "..", "-", "_", "+", "1", "22", "255", "256", "1.2.3.4", " ", "%", "4111111111111111", "+1 (800) 555-2077", "é", "\n", "(", ")"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 22)))
        want = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)] + [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(t):
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and pii_crf._luhn(digits):
                want.append((m.start(), 2, m.end()))
        want += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii_crf.base_spans(t) == sorted(want), t


@pytest.mark.parametrize("text", ["1" * 3_000_000, "a" * 2_000_000 + "1", "1 " * 1_000_000, "1." * 700_000, "a@" * 500_000])
def test_unbroken_runs_are_read_once(text):
    pii_crf.nodes(text, pii_crf.base_spans(text))


def test_personal_data_beside_clashing_columns(spark):
    rows = [(1, "call +1 (800) 555-2077", "a", "b"), (1, "mail a.b@c.de", "a", "b"), (None, None, "a", "b"), (None, "1.2.3.4", "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, spans string")
    found = pii_crf.find_pii(df, pii_crf.learn(df)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, [(s.kind, s.start, s.stop) for s in r.base]) for r in found) == [(False, 1, [("email", 5, 13)]), (False, 1, [("phone", 5, 22)]), (True, 0, []), (True, 0, [("ip", 0, 7)])]
