import glob
import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinlog.llm import chat_format, embedding_dedup, language_id, line_windows, mixing, ngram_join, packing, pii_crf, quality_rules, secrets, shared

DOCS = "doc_id long, text string, lang string, source string, n_chars long, covered string"
ODD = [None, "", " \t\n", "one", "two words", "!!! ... ,,,", "word " * 3000, "a\n\nb\n \nc", "é́  x 漢字 <|endoftext|>"]


def docs(spark, *texts, source=lambda i: f"s{i % 3}"):
    rows = [(i, t, "en", source(i), 0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(n=120, seed=4):
    """Texts with exact and near copies, and a passage that many share."""
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(20))
    out = []
    for k in range(n):
        if k % 4 == 1 and out:
            w = r.choice(out).split()
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
        else:
            own = " ".join(r.choice(vocab) for _ in range(r.choice([3, 8, 30, 120])))
            out.append(own + (" " + passage if k % 3 == 0 else ""))
    return out


def brute(texts, width, num, den):
    sets = []
    for t in texts:
        w = [x.lower() if x.isascii() else x for x in words(t)]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root, links = list(range(len(texts))), [0] * len(texts)
    top = lambda x: x if root[x] == x else top(root[x])
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), top(i), links[i]) for i in range(len(texts))]


@pytest.mark.parametrize("width,num,tile", [(4, 85, 128), (5, 80, 3)])
def test_ngram_join(spark, width, num, tile):
    texts = corpus() + ODD
    got = ngram_join.ngram_jaccard(docs(spark, *texts), width, num, 100, tile_rows=tile).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(texts, width, num, 100)


def test_block_keys_lose_no_pair():
    r = np.random.default_rng(1)
    bands = ngram_join.Bands(80, 100, 2000)
    for n in [7, 9, 12, 20, 45, 130, 600]:
        for _ in range(15):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            b = a.copy()
            while True:  # as many differences as the threshold lets pass
                c = np.unique(np.append(np.delete(b, r.integers(len(b))), r.integers(0, 1 << 63, int(r.integers(0, 3)), dtype=np.uint64)))
                if len(np.intersect1d(a, c)) * 100 < 80 * len(np.union1d(a, c)):
                    break
                b = c
            hot = np.sort(r.choice(a, len(a) * int(r.integers(0, 10)) // 10, replace=False))
            keys, rows = ngram_join.block_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), bands, hot)
            assert len(a) == len(b) and (a == b).all() or set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def test_rows_that_share_a_passage_hardly_meet():
    r = np.random.default_rng(2)
    bands = ngram_join.Bands(80, 100, 4000)
    met = 0
    for _ in range(100):
        x = r.integers(0, (1 << 64) - 1, 5000, dtype=np.uint64)
        a, b = np.sort(x[:2500]), np.sort(x[2300:4800])
        keys, rows = ngram_join.block_keys(np.concatenate([a, b]), np.array([2500, 2500]), bands, np.zeros(0, np.uint64))
        met += bool(set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist()))
        assert len(keys) < 0.49 * 5000
    assert met < 20


def test_tiles_of_a_large_group_go_in_rounds(spark, monkeypatch):
    r = random.Random(8)
    first = [f"w{r.randrange(900)}" for _ in range(60)]
    texts = [" ".join(first[:k] + [f"x{k}"] + first[k + 1 :]) for k in range(60)]  # all near each other
    dealt = []
    deal, write = ngram_join._rounds, ngram_join._in_rounds
    monkeypatch.setattr(ngram_join, "_rounds", lambda tiles: dealt.append((tiles.agg(F.sum(F.size("tile"))).first()[0], deal(tiles))) or dealt[-1][1])
    monkeypatch.setattr(ngram_join, "_in_rounds", lambda grams, rounds, *a: dealt.append(rounds) or write(grams, rounds, *a))
    got = ngram_join.ngram_jaccard(docs(spark, *texts), 4, 80, 100, tile_rows=3).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == brute(texts, 4, 80, 100)
    (copies, rounds), used = dealt
    assert used == rounds > 1 and copies / rounds <= ngram_join.ROUND * 60


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    kept = lambda: sum(os.path.getsize(os.path.join(at, f)) for top in glob.glob(f"{spark.sparkContext._jvm.java.lang.System.getProperty('java.io.tmpdir')}/blockmgr-*") for at, _, fs in os.walk(top) for f in fs if f.startswith("shuffle_"))
    before = kept()
    df = spark.range(200_000).selectExpr("id", "hash(id) as h").repartition(4, "h")
    out = shared.materialize(df)
    for _ in range(50):
        if kept() - before < 100_000:
            break
        time.sleep(0.1)
    assert out.count() == 200_000 and kept() - before < 100_000


def test_copies_of_one_set_fill_no_bucket():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "text": [None, "same words in all of these", f"{'x ' * 9}"] * 200})
    rows = {}
    for b in ngram_join._file_keys(4, 85, 100, 8, SimpleNamespace(value=np.zeros(0, np.uint64)))(iter([batch])):
        for bucket, kind, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if kind == 0:
                rows[bucket] = rows.get(bucket, 0) + len(blob) // ngram_join._ROW.itemsize
    assert sum(rows.values()) == 600 and len(rows) == 8 and max(rows.values()) < 150


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    texts = ["Ab cd", "x" * 9000 + " ab", "", "ab\tCD \n", "é " + "x" * 9000, "y" * 4095 + "z", "y" * 4096 + "z", "y" * 4097 + "z", " ", "z"]
    want = [[w.lower() if w.isascii() else w for w in words(t)] for t in texts]
    found = []
    for piece in (3, 4096, 1 << 18):
        monkeypatch.setattr(ngram_join, "_PIECE", piece)
        raw, bounds = ngram_join.text_bytes(pa.array(["skip", *texts, None])[1:])
        hashes, begin = ngram_join._words(raw, bounds)
        at = np.searchsorted(begin, bounds)
        assert np.diff(at).tolist() == [len(w) for w in want] + [0]
        found.append(hashes.tolist())
    flat = [w for t in want for w in t]
    assert found[0] == found[1] == found[2] and len(set(found[0])) == len(set(flat)) == len(set(zip(flat, found[0], strict=True)))


def test_ngram_join_on_repeated_ids(spark):
    r = random.Random(6)
    a, b, c = (" ".join(f"w{r.randrange(900)}" for _ in range(40)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (7, b), (7, ""), (8, c), (8, c), (9, c + " more")] + [(2, "hot id")] * 50
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.ngram_jaccard(d, 5, 80, 100).drop("n_shingles").collect()))
    assert got == sorted([(3, 3, 1), (5, 3, 1), (5, 3, 1), (7, 3, 1), (7, 7, 0), (8, 8, 2), (8, 8, 2), (9, 8, 2)] + [(2, 2, 49)] * 50)


def test_ngram_join_of_very_long_texts(spark):
    r = random.Random(9)
    long = [f"w{r.randrange(90_000)}" for _ in range(400_000)]
    texts = [" ".join(long), " ".join(long[:-9] + ["x"] * 9), "v" * 3_000_000, "V" * 3_000_000, "v" * 2_999_999]
    got = sorted(map(tuple, ngram_join.ngram_jaccard(docs(spark, *texts), 5, 80, 100).select("doc_id", "component_id", "n_links").collect()))
    assert got == [(0, 0, 1), (1, 0, 1), (2, 2, 1), (3, 2, 1), (4, 4, 0)]


def test_ngram_join_empty_and_nameless(spark):
    d = docs(spark, "a b c d e f", "a b c d e f")
    assert ngram_join.ngram_jaccard(d.where("false")).count() == 0
    d = d.withColumn("doc_id", F.when(F.col("doc_id") == 0, None).otherwise(F.col("doc_id")))
    assert {(r.doc_id, r.component_id) for r in ngram_join.ngram_jaccard(d).collect()} == {(None, None), (1, 1)}


def test_mixing(spark):
    r = random.Random(3)
    texts = [" ".join(["w"] * r.randrange(1, 200)) for _ in range(300)] + [t for t in ODD if len(words(t)) < 200]
    d = docs(spark, *texts, source=lambda i: None if i % 10 == 9 else "abcd"[min(i % 10, 3)])
    m = mixing.mix_sources(d)
    rows = m.collect()
    assert set(map(tuple, rows)) == set(map(tuple, mixing.mix_sources(d).collect()))
    total = sum(len(words(t)) for t in texts)
    longest, by = 200, {}
    for x in rows:
        assert x.size == len(words(texts[x.doc_id])) and x.taken == x.copies * x.size <= 3 * x.size
        by.setdefault(x.source, [x.target, 0, x.source_size])[1] += x.taken
    assert abs(sum(t for t, _, _ in by.values()) - total) < 1e-6
    for target, taken, size in by.values():
        assert abs(taken - target) <= longest / 2 and target <= 3 * size + 1e-9  # half the document that no longer fits, at most
    want = dict(m.where("copies > 0").select("doc_id", "copies").collect())
    assert dict(mixing.take_mix(d).groupBy("doc_id").count().collect()) == want
    assert mixing.mix_sources(d.where("false")).count() == 0


def test_mix_chances(spark):
    """Sources alike in all but their ids are so many draws of one sample; what fills the last gap weighs little in large ones."""
    sizes = [3, 5, 9, 17, 33, 65, 120] * 40
    n = 60
    rows = [(1000 * s + k, f"s{s:04d}", "w " * z) for s in range(n) for k, z in enumerate(sizes)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = {r["class"]: r.p + r.base for r in mixing.chances(mixing._sized(d, "doc_id", "text", "source", "x"), (1, 3)).where("source = 's0000'").collect()}
    assert len(want) == 6 and 0 < min(want.values()) < 0.5 * max(want.values()) and abs(sum(want[z.bit_length()] * z for z in sizes) - sum(sizes) / 2) < 1e-6
    taken = {}
    for r in mixing.mix_sources(d, (1, 3)).where("source_size * 0.6 > target").collect():
        taken.setdefault(r.size.bit_length(), []).append(r.copies)
    for c, p in want.items():
        m = len(taken[c])
        assert m >= 40 * n // 2 and abs(np.mean(taken[c]) - p) < 0.02 + 4 * (p * (1 - min(p, 1)) / m) ** 0.5, c


def test_mix_cells_are_even(spark):
    u = F.expr("(xxhash64(id) & 281474976710655L)")
    for p in (0.001, 0.05, 0.5, 0.999):
        cells = spark.range(20_000).select(F.floor(F.log2(mixing._odds(u, F.lit(p))) * mixing.CELLS).alias("c")).groupBy("c").count()
        assert cells.agg(F.max("count")).first()[0] < 0.01 * 20_000


def test_mix_of_repeated_rows_ties_and_clashing_names(spark):
    rows = [(k % 40, "ab"[k % 40 % 2], "w " * (10 if k % 40 < 30 else 25), 1.5) for k in range(200)] + [(None, None, "x y"), (None, None, "x y"), (7, None, None)] * 1
    rows = [(*r, 1.5) if len(r) == 3 else r for r in rows]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, p double").selectExpr("*", "1 as size", "2 as u", "3 as cut", "4 as s", "5 as copies", "6 as base", "'x' as target")
    want, got = {}, {}
    for r in mixing.mix_sources(d).collect():
        want[r.doc_id, r.source, r.size] = want.get((r.doc_id, r.source, r.size), 0) + r.copies
    taken = mixing.take_mix(d)
    assert taken.columns == d.columns
    for r in taken.collect():
        k = (r.doc_id, r.source, len(words(r.text)))
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    assert mixing.take_mix(d.where("false")).count() == 0


def test_packing(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = corpus(60) + ODD + ["It's 12,5 İstanbul ſtraße ÀÉÎ don't!! a.b,c", "x" * 300]
    rows = packing.pack(docs(spark, *texts), path, most=256).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted(by[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == [(k, min(256, len(ids) - k)) for k in range(0, len(ids), 256)]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 256 and len(at) <= 1.1 * sum(r.length for r in rows) / 256 + 1


@pytest.mark.parametrize("lengths", [[], [5], [2048] * 7, [700] * 100, list(range(1, 2049)), [1500] * 9 + [600] * 9 + [40] * 50])
def test_plan_places_each_piece_once(lengths):
    counts = {}
    for s in lengths:
        counts[s] = counts.get(s, 0) + 1
    plan = packing.Plan(counts, 2048)
    used, seen = np.zeros(plan.sequences, int), {}
    for s, lo, hi, seq, k, _ in plan.runs:
        for i in range(lo, hi):
            used[seq + (i - lo) // k] += s
            seen[s] = seen.get(s, 0) + 1
    assert seen == counts and used.max(initial=0) <= 2048


def test_quality_rules(spark):
    r = random.Random(5)
    clean = [" ".join(f"word{r.randrange(900)}" for _ in range(60)) + "." for _ in range(150)]
    junk = [" ".join(f"word{r.randrange(900)}***" for _ in range(60)) for _ in range(60)]
    passage, long = "a passage of nine words that comes two times ", [" ".join(f"v{r.randrange(50_000)}" for _ in range(9000)) for _ in range(2)]
    texts = clean + junk + ODD + ["same words again and here " * 20, "l1 x\nl2 y\nl1 x\n" * 2, f"{long[0]} {passage}{long[1]}\n{passage}", f"{long[0]}\n" * 2, long[1]]
    d = docs(spark, *texts)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rules = quality_rules.learn_rules(d, labels)
    assert rules and quality_rules.learn_rules(d, labels.where("false")) == []
    for x in quality_rules.apply_rules(d.select("doc_id", "text"), rules).collect():
        t, w, s = texts[x.doc_id] or "", words(texts[x.doc_id]), x.stats
        lines = [y for y in t.split("\n") if words(y)]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        often = Counter(windows)
        cover = {k + j for k, y in enumerate(windows) if often[y] > 1 for j in range(8)}
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert s.n_repeat_words == len(cover)
        assert x.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
        if x.doc_id < 210:
            assert x.kept == (x.doc_id < 150)


def test_line_windows(spark):
    p = "first line here\nsecond line here\n\nthird line here"
    texts = [p, "x\n" + p + "\ny", "only\n" + p.replace("third", "3rd"), p, "a\nb", "q\nq\nq\nq", *ODD]
    got = {r.doc_id: r for r in line_windows.drop_repeated_windows(docs(spark, *texts)).collect()}
    assert [got[k].text for k in range(6)] == [p, "x\n\ny", texts[2], "", "a\nb", "q"]
    assert [got[k].n_removed for k in range(6)] == [0, 3, 0, 3, 0, 3] and got[6].text is None and got[0].covered == "clash"
    assert line_windows.drop_repeated_windows(docs(spark, *texts).where("false")).count() == 0


def test_line_windows_on_repeated_ids_and_clashing_names(spark):
    a, b = "a 1\nb 2\nc 3", "x 1\ny 2\nz 3"
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b), (None, a), (4, None), (5, "p\n" * 40_000), (6, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'m' as n_lines", "7 as N_Removed", "1 as w", "2 as digest", "3 as at", "4 as covered", "5 as lines", "6 as h")
    out = line_windows.drop_repeated_windows(d)
    assert out.columns == ["doc_id", "text", "w", "digest", "at", "covered", "lines", "h", "n_lines", "n_removed"]
    got = sorted(((x.doc_id or 0, x.text, x.n_lines, x.n_removed) for x in out.collect()), key=str)
    by = {}
    for i, t, n, k in got:
        by.setdefault(i, []).append((t, n, k))
    assert by[1] == [(a, 3, 0)] and sorted(by[2]) == [("", 3, 3), (b, 3, 0), (b, 3, 0)] and by[3] == [("", 3, 3)] and by[0] == [(a, 3, 0)]
    assert by[4] == [(None, 0, 0)] and by[6] == [("", 0, 0)] and by[5][0][1:] == (40_000, 39_999) and line_windows.drop_repeated_windows(d.where("false")).count() == 0


def test_quality_rules_on_clashing_names(spark):
    rows = [(1, "word " * 30), (1, "word " * 30), (2, None), (None, "a b"), (3, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'m' as stats", "7 as Kept", "1 as w", "2 as t", "3 as l", "4 as rule", "5 as base_failed", "6 as n_words", "8 as __id")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    rules = quality_rules.learn_rules(d, labels)
    out = quality_rules.apply_rules(d, [*rules, quality_rules.Rule((("symbols", ">", 0.5),), 1, 1.0)])
    assert [x.stats.n_words for x in out.orderBy("doc_id", "text").collect()] == [2, 30, 30, 0, 0] and out.where("base_failed").count() == 5
    assert out.columns == ["doc_id", "text", "w", "t", "l", "n_words", "__id", "stats", "base_failed", "rule", "kept"] and quality_rules.apply_rules(d.where("false"), []).count() == 0


def test_near_vectors(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(90, 16))
    v[30:60] = v[:30] + r.normal(scale=0.15, size=(30, 16))
    v[60:66] = v[0]
    v[:30] /= np.linalg.norm(v[:30], axis=1)[:, None]
    for k in range(10):  # ties and near ties with the threshold, above and below
        w = r.normal(size=16)
        w -= (w @ v[k]) * v[k]
        v[70 + 2 * (k // 2)] = v[k]
        v[71 + 2 * (k // 2)] = 0.93 * v[k] + (1 - 0.93**2) ** 0.5 * w / np.linalg.norm(w)
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v)] + [(90, None, 0), (91, [0.0] * 16, 0), (92, [float("nan")] * 16, 0), (93, [None] * 16, 1), (94, v[0].tolist(), None), (95, [1.0], 0), (96, [], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    v = v.astype(np.float32).astype(float)
    cos = v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    near = (cos >= 0.93) & (np.arange(90)[:, None] % 2 == np.arange(90) % 2) & ~np.eye(90, dtype=bool)
    reach = near | np.eye(90, dtype=bool)
    for _ in range(8):
        reach = reach @ reach
    for tile in (512, 7):
        got = {x.vec_id: x for x in embedding_dedup.near_vectors(d, tile_rows=tile).collect()}
        assert len(got) == 97 and all(got[k].n_links == 0 and got[k].component_id == k for k in range(90, 97))
        for i in range(90):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), np.flatnonzero(reach[i])[0], np.flatnonzero(reach[i])[0] == i)


def test_near_vectors_ship_integers_and_bound_their_error():
    r = np.random.default_rng(4)
    v = r.normal(size=(200, 48)) * 10.0 ** r.integers(-150, 150, (200, 1))
    v[100:] = v[:100] * 3 + np.abs(v[:100]).max(1, keepdims=True) * r.normal(scale=r.uniform(0, 0.3, (100, 1)), size=(100, 48))
    q = embedding_dedup.quantise(v)
    u = v / np.abs(v).max(1, keepdims=True)
    true = u @ u.T / np.outer(np.linalg.norm(u, axis=1), np.linalg.norm(u, axis=1))
    seen, open_pairs = set(), 0
    for a, b, sure in embedding_dedup.screen(q, None, 0.93, side=64):
        assert q[0].dtype == np.int8 and (true[a[sure], b[sure]] >= 0.93).all()
        seen |= set(zip(a.tolist(), b.tolist(), strict=True))
        open_pairs += (~sure).sum()
    need = {(i, j) for i, j in zip(*np.nonzero(true >= 0.93), strict=True) if i < j}
    assert need <= seen and len(need) > 30 and open_pairs < 40


def test_near_vectors_of_repeated_ids_and_empty_tables(spark):
    d = spark.createDataFrame([(3, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [0.0, 1.0], 1), (8, [1.0, 0.01], 1), (9, [1.0, 0.0], 2), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, embedding_dedup.near_vectors(d.selectExpr("*", "1 as rep", "2 as d1", "3 as codes")).collect()), key=str)
    assert got == sorted([(3, 2, 3, True), (5, 2, 3, False), (5, 1, 3, False), (7, 1, 3, False), (8, 2, 3, False), (9, 0, 9, True), (None, 0, None, False)], key=str)
    assert embedding_dedup.near_vectors(d.where("false")).count() == 0


def test_language_id(spark):
    r = random.Random(8)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["the", "ing", "st"], "cc": ["é", "eau", "ç"]}
    text = lambda y: " ".join("".join(r.choice(parts[y]) for _ in range(3)) for _ in range(30))
    rows = [(i, text(y), y) for i in range(240) for y in ["abc"[i % 3] * 2]]
    d = spark.createDataFrame(rows + [(900 + k, t, None) for k, t in enumerate(ODD)], "doc_id long, text string, lang string")
    model = language_id.learn(d.selectExpr("*", "'x' as `order`", "1 as ids", "2 as n", "3 as id"))
    assert language_id.identify(d.where("false"), model).count() == 0
    again = language_id.identify(d.limit(3).unionByName(d.limit(3)).selectExpr("*", "'x' as lang_pred", "1 as score"), model)
    assert again.columns == ["doc_id", "lang_pred", "score", "rejected"] and again.count() == 6
    assert language_id.identify(spark.createDataFrame([(None, "the st " * 500_000)], "doc_id long, text string"), model).first().lang_pred == "bb"
    got = {x.doc_id: x for x in language_id.identify(d, model).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert len(held) > 40 and np.mean([got[i].lang_pred == y for i, _, y in held]) > 0.97
    assert all((got[900 + k].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) for k, t in enumerate(ODD))
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in language_id.identify(d, language_id.learn(d.where("false"))).collect()} == {"und"}


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\", "\\\\", "###", "</turn>\n", ">: ", "", None, "### Role <x>: ", "a\n### User: b</turn>\n"]
    rows = [(1, k, ["user", "assistant"][k % 2], t) for k, t in enumerate(nasty)] + [(2, 0, "tool>: ", "x"), (2, 0, None, "y"), (2, None, "assistant", "z"), (None, 0, "user", "n"), (None, 0, "user", "n")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    d = d.selectExpr("*", "'x' as turns", "1 as alone", "2 as formatted", "3 as segments", "4 as wrong")
    back = chat_format.read_back(chat_format.format_chats(d)).collect()
    got = {x.conv_id: x for x in back}
    assert sum(x.conv_id is None for x in back) == 2 and got[None].wrong == "ends in asked" and chat_format.format_chats(d.where("false")).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "\\#>: " * 300_000), (1, 1, "assistant", None)], d.select("conv_id", "turn", "role", "text").schema)
    assert chat_format.read_back(chat_format.format_chats(long)).first().turns[0].text == "\\#>: " * 300_000
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t or "") for _, _, r, t in rows[: len(nasty)]]
    assert got[1].learned == [t or "" for t in nasty[1::2]][: len(got[1].learned)] or "".join(got[1].learned) == "".join(t or "" for t in nasty[1::2])
    assert got[1].wrong is None and got[2].wrong.startswith("turn 0") and [t.text for t in got[2].turns] == ["y", "x", "z"]


def plain_spans(text):
    """The base patterns of the contract, as plainly as can be."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(map(int, m[0].split("."))) <= 255:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(sum(divmod(2 * c, 10)) if k % 2 else c for k, c in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def pii_corpus(n=240, seed=12):
    """Texts with personal data, other mentions of their telephone numbers, and other numbers of the same form: (text, added)."""
    r = random.Random(seed)
    some = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    talk = lambda: " ".join(f"w{r.choice('abcdefg')}{r.choice('xyz')}" for _ in range(r.randrange(2, 9)))
    out = []
    for k in range(n):
        d = r.choice("23456789") + some(9)
        parts, more = [talk()], []
        if k % 3:
            parts.append(f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}")
            if k % 3 == 1:
                other = r.choice([f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}", f"({d[:3]}) {d[3:6]}-{d[6:]}"])
                parts += [talk(), other]
                more.append(other)
        parts += [talk(), f"{some(3)}-{some(3)}-{some(4)}", "in 2019", talk(), r.choice([f"jo.ann{k}@mail.example.org", "4111 1111 1111 1111", "10.20.30.40", some(16), "7.300.1.2", ""])]
        out.append((" ".join(parts), more))
    return out


def test_pii_spans_that_only_skip_edges_find(spark):
    found = pii_corpus()
    d = docs(spark, *[t for t, _ in found], *ODD)
    field = pii_crf.learn(d)
    rows = {x.doc_id: x for x in pii_crf.find_pii(d, field).collect()}
    alone = {x.doc_id: x for x in pii_crf.find_pii(d, pii_crf.Field(field.weights, field.beside, 0 * field.agree)).collect()}
    right = wrong = missed = without = 0
    for i, (text, more) in enumerate(found):
        tell = lambda spans: [(x.start, pii_crf.KINDS.index(x.kind), x.stop) for x in spans]
        assert tell(rows[i].base) == plain_spans(text) and set(tell(rows[i].base)) <= set(tell(rows[i].spans))
        new = [text[s:e] for s, _, e in sorted(set(tell(rows[i].spans)) - set(tell(rows[i].base)))]
        right, wrong, missed = right + len(set(new) & set(more)), wrong + len(set(new) - set(more)), missed + len(set(more) - set(new))
        without += sum(text[s:e] in more for s, _, e in tell(alone[i].spans))
    assert right >= 0.9 * (right + missed) and right >= 0.9 * (right + wrong) and right == 80 and right - without > 50
    assert all(rows[len(found) + k].base == [] == rows[len(found) + k].spans for k in range(len(ODD)))
    assert pii_crf.learn(d.where("false")) is None and pii_crf.find_pii(d.where("false"), field).count() == 0


def test_pii_numbers_run_together():
    field = pii_crf.fit(sum((pii_crf.examples(t) for t, _ in pii_corpus()), Counter()))
    text = "4111111111111111 4242424242424242 and +1 (826) 555-4081 190.137.223.204 then 4111111111111112 or 10.0.0.300"
    base, spans = pii_crf.find_spans(text, field)
    assert [text[s:e] for s, _, e in base] == ["190.137.223.204"] and "+1 (826) 555-4081" in [text[s:e] for s, _, e in spans]
    assert not {"4111111111111112", "10.0.0.300"} & {text[s:e] for s, _, e in spans}
    assert pii_crf.find_spans(None, field) == ([], []) and pii_crf.find_spans("Version 2.0 of 12 things", field) == ([], [])
    long = "1 2 3.5 4-4 " * 20_000 + "x@" * 50_000
    assert pii_crf.find_spans(long, field)[0] == plain_spans(long)


def test_pii_evidence_reaches_every_mention():
    kinds = len(pii_crf.KINDS) + 1
    weights, apart = np.zeros((len(pii_crf.shape("1")), kinds)), np.zeros((kinds, kinds))
    weights[0, 0] = 0.5  # every node leans a little to 'none'
    field = pii_crf.Field(weights, apart, np.array([0, 2.0, 0]))
    found = [pii_crf.Node(30 * i, 30 * i + 9, f"{i}-555-4781", 4 * (i == 0)) for i in range(5)]
    p = pii_crf.posterior(found, field)
    b = pii_crf._spoke(2.0, kinds)
    hub = np.arange(kinds) == 4  # summed out by hand: the mentions are independent, given their shared node
    away = np.exp(0.5 * (np.arange(kinds) == 0) + b * np.eye(kinds))  # shared node's label, mention's label
    joint = np.exp(b * hub) * away.sum(1) ** 4
    exact = (joint[:, None] * away / away.sum(1)[:, None]).sum(0) / joint.sum()
    assert np.allclose(p[1:], exact, atol=1e-3)

    pair = np.exp(b * np.eye(kinds))
    pair = np.log(pair @ pair)
    assert np.isclose(pair[0, 0] - pair[0, 1], 2.0)  # two spokes agree as one edge does
    field = pii_crf.Field(0 * weights, apart, np.array([0, 6.0, 0]))
    text = "call +1 (873) 555-4781" + " or maybe 873-555-4781" * 20
    base, spans = pii_crf.find_spans(text, field)
    assert len(base) == 1 and [pii_crf.KINDS[k] for _, k, _ in spans] == ["phone"] * 21


def plain_secrets(text):
    """(kind, start, end, value) of the contract's base patterns, and of other tokens, as plainly as can be."""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span(), m[2]))
    out += [("access", *m.span(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span(), m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
        v, has = m[0], [re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]")]
        if len(v) >= 20 and all(has) or len(v) >= 24 and has[0] and (has[1] or has[2]) and v.isalnum():
            out.append(("token", *m.span(), v))
    return out


def test_secrets_against_brute_force(spark):
    r = random.Random(21)
    some = lambda k, of="abcdefXYZ0123456789": "".join(r.choice(of) for _ in range(k))
    pool = [some(24, "0123456789abcdef"), "AKIA" + some(17, "ABCD0123"), some(30), some(12), "K3y" + some(40, "+/_-aB1")]
    make = [lambda v: f'password = "{v}"', lambda v: f"API_KEY:{v} é", lambda v: f"x {v} y", lambda v: f"secret=token={v}", lambda v: v + "ü" + v]
    texts = [" ".join(r.choice(make)(r.choice(pool) if r.random() < 0.5 else some(r.randrange(4, 40))) for _ in range(r.randrange(4))) for _ in range(150)]
    texts += ["token: " * 3000 + "x " * 9, ("AKIA" + "A1" * 10 + " é ") * 2000, *ODD]
    d = docs(spark, *texts, source=lambda i: f"s{i % 5}" if i % 7 else None)
    got = {x.doc_id: x for x in secrets.scan_secrets(d, live_owners=2, live_documents=3).collect()}
    where, owned = {}, {}
    for i, t in enumerate(texts):
        for *_, v in plain_secrets(t or ""):
            where.setdefault(v, set()).add(i)
            owned.setdefault(v, set()).add(f"s{i % 5}" if i % 7 else None)
    live = {v for v in where if len(owned[v]) <= 2 and len(where[v]) <= 3}
    n_token = n_dropped = 0
    for i, t in enumerate(texts):
        all_of = plain_secrets(t or "")
        base = [x for x in all_of if x[0] != "token"]
        want = base + [x for x in all_of if x[0] == "token" and x[3] in live and not any(b[1] < x[2] and x[1] < b[2] for b in base)]
        n_token, n_dropped = n_token + len(want) - len(base), n_dropped + len(all_of) - len(want)
        want = sorted(((k, s, e, v, len(where[v]), len(owned[v]), v in live) for k, s, e, v in want), key=lambda x: (x[1], secrets.KINDS.index(x[0])))
        assert [(x.kind, x.start, x.stop, x.value, x.documents, x.owners, x.live) for x in got[i].spans] == want
        assert got[i].n_live == sum(x[-1] for x in want) and got[i].n_example == len(want) - got[i].n_live
    assert n_token > 10 and n_dropped > 10


def test_secrets_examples_and_live_keys(spark):
    """A value of many sources, and one of many documents of one source, are examples; one that stays with its owner is live."""
    shared, copied, own = "Ab3" + "xY9z" * 6, "Zz8" + "vT5c" * 6, "Qq7" + "pL2m" * 6
    texts = [f"key {shared} x"] * 9 + [f"key {copied} x"] * 30 + [f"mine {own} y"] * 2 + ["password=" + shared, "password=hunter2secret"]
    got = {x.doc_id: x for x in secrets.scan_secrets(docs(spark, *texts, source=lambda i: f"s{i}" if i < 9 else "one")).collect()}
    tell = lambda k: [(s.kind, s.live) for s in got[k].spans]
    assert tell(0) == tell(20) == [] and tell(39) == tell(40) == [("token", True)] and tell(41) == [("assign", False)] and tell(42) == [("assign", True)]
    clash = docs(spark, *texts[:2]).selectExpr("*", "1 as spans", "2 as row", "3 as found", "4 as owner", "5 as digest", "6 as t")
    assert secrets.scan_secrets(clash).count() == 2 and secrets.scan_secrets(clash.where("false")).count() == 0


def test_long_tokens_with_a_uniform_prefix(spark):
    keys = ["k" * 70 + "K1" + "k" * 30, "K" * 6000 + "1k", "+/_-" * 40 + "kK3"]
    no = ["k" * 5000, "-" + "K1" * 3000, "kK" * 3000]
    got = {x.doc_id: [(s.kind, s.value) for s in x.spans] for x in secrets.scan_secrets(docs(spark, *[f"key {k} x" for k in keys + no])).collect()}
    assert got == {i: [("token", k)] if k in keys else [] for i, k in enumerate(keys + no)}
