import random
import zlib

import numpy as np
import pytest
from test_operators import brute, words

import corpus_pipeline as pipeline
from skeinlog.llm.shared import materialize


def line_dedup(texts):
    """Three-line windows, the first occurrence by id and place stays."""
    seen, out = set(), []
    for t in texts:
        lines = t.split("\n")
        at = [k for k, x in enumerate(lines) if words(x)]
        gone = set()
        for k in range(len(at) - 2):
            w = tuple(lines[i] for i in at[k : k + 3])
            if w in seen:
                gone |= set(at[k : k + 3])
            seen.add(w)
        out.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    r = random.Random(11)
    vocab = [f"w{k}" for k in range(500)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = "\n".join(line(15) for _ in range(3))
    texts = []
    for k in range(160):
        if k % 5 == 1:
            w = texts[-1].split(" ")
            w[r.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
        else:
            texts.append(line(80) + ("\n" + passage if k % 4 == 0 else ""))
    junk = [" ".join(x + "***" for x in line(60).split()) for _ in range(60)]
    docs = [(k, t, "en", None if k % 7 == 6 else f"s{k % 7 // 3}", len(t)) for k, t in enumerate(texts + junk)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 160)) for k in range(220)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))

    now, got = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in pipeline.STAGES:
        now = got[name] = materialize(stage(spark, now, str(tmp_path)))
    held = lambda name: {x.doc_id: x.text for x in got[name].collect()}
    assert held("quality rules") == dict(enumerate(texts))
    deduped = line_dedup(texts)
    assert held("line dedup") == dict(enumerate(deduped))
    stay = {i for i, _, component, _ in brute(deduped, 5, 80, 100) if i == component}
    assert len(stay) < 160 and held("near duplicates") == {i: deduped[i] for i in stay}
    mixed = [x.doc_id for x in got["source mix"].collect()]
    size = lambda ids: sum(len(words(deduped[i])) for i in ids)
    assert set(mixed) <= stay and max(map(mixed.count, mixed)) <= 3 and abs(size(mixed) - size(stay)) <= 3 * 100
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.array(t.encode(deduped[i], add_special_tokens=False).ids + [0], "<u4") for i in set(mixed)}
    rows = got["packing"].collect()
    assert sorted((x.doc_id, x.length, x.ids_crc32) for x in rows) == sorted((i, len(ids[i]), zlib.crc32(ids[i].tobytes())) for i in mixed)
    end = {}
    for x in sorted(rows, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == end.get(x.sequence_id, 0)
        end[x.sequence_id] = x.offset + x.length
    assert max(end.values()) <= 2048


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents of every odd kind, with labels beside them."""
    P = pytest.importorskip("public_tokenizers")
    assert P.path("word_bpe_49k.json")
    r = random.Random(3)
    line = lambda n: " ".join(f"w{r.randrange(700)}" for _ in range(n))
    a, b = "\n".join(line(12) for _ in range(5)), "\n".join(line(12) for _ in range(5))
    rows = [(1, a, "s"), (1, a, "s"), (2, a, "s"), (2, b, "t"), (3, None, None), (None, b, None), (None, None, "s"), (4, "", "s"), (5, " \n\t", "s"), (6, line(400_000), "t"), (7, "x" * 2_000_000, "t"), (8, line(30), None)]
    d = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d = d.selectExpr("*", "1 as n_lines", "'x' as stats", "2 as kept", "3 as size", "4 as u", "5 as piece", "6 as length", "7 as rank")
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int").write.parquet(folder + "/labels.parquet")
    return d, folder, a, b


def test_stages_on_odd_rows(spark, odd):
    d, folder, a, b = odd
    told = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=str)
    by_name = dict(pipeline.STAGES)
    good = pipeline.quality(spark, d, folder)
    assert good.columns == list(pipeline.COLUMNS) and [i for i, _ in told(good)].count(1) == 2 and {i for i, _ in told(good)} == {1, 2, None, 6, 8}
    lined = by_name["line dedup"](spark, d, folder)
    got = told(lined)
    assert lined.columns == list(pipeline.COLUMNS) and lined.count() == d.count() and got.count((1, a)) == 2 and (2, "") in got and (2, b) in got and (None, b) in got and (3, None) in got and (None, None) in got
    unique = told(by_name["near duplicates"](spark, d, folder))
    assert [i for i, _ in unique].count(1) == 2 and 2 not in {i for i, _ in unique} and [i for i, _ in unique].count(None) == 2 and {3, 4, 5, 6, 7, 8} <= {i for i, _ in unique}
    mixed = by_name["source mix"](spark, d, folder)
    assert mixed.columns == list(pipeline.COLUMNS) and not {3, 4, 5} & {i for i, _ in told(mixed)}
    packed = by_name["packing"](spark, d, folder)
    assert packed.where("piece = 0").count() == d.count() and packed.agg({"length": "max"}).first()[0] <= 2048
    assert packed.where("doc_id = 6 and piece > 100").count() > 0


def test_stages_on_an_empty_table(spark, odd):
    d, folder, _, _ = odd
    now = d.where("false")
    for _, stage in pipeline.STAGES:
        now = materialize(stage(spark, now, folder))
        assert now.count() == 0
