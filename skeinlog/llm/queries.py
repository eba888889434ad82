"""Queries of the operators in this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, dual_tree, embedding_dedup, language_id, line_windows, mixing, ngram_join, packing, pii_crf, quality_rules, secrets, sharding, spelling
from .shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, 85 % Jaccard, all documents."""
    return ngram_join.ngram_jaccard(table(spark, sf_dir, "documents"), ngram=4, num=85, den=100)


@query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3 in turn; each is taken 3 times at most."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules learned from labels.quality, applied to all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.apply_rules(docs, rules)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[f"stats.{c}" for c in counts], "base_failed", "kept", "rule")


@query
def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows removed; the texts that are left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_windows.drop_repeated_windows(docs)


ORACLES["op10_line_windows"] = """
WITH a AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
p AS (SELECT doc_id, text, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '[^\x20\x09-\x0D]')) AS nb FROM a),
w AS (SELECT doc_id, q AS pos, struct_pack(a := l[nb[q]], b := l[nb[q + 1]], c := l[nb[q + 2]]) AS w
      FROM (SELECT doc_id, l, nb, unnest(range(1, len(nb) - 1)) AS q FROM p)),
f AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM w),
c AS (SELECT doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) AS cov FROM f WHERE k > 1 GROUP BY doc_id)
SELECT p.doc_id, CAST(len(nb) AS BIGINT) AS n_lines, CAST(coalesce(len(cov), 0) AS BIGINT) AS n_removed,
       CASE WHEN cov IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1),
            lambda i: coalesce(NOT list_contains(cov, list_position(nb, i)), TRUE)), lambda i: l[i]), chr(10)), '') END AS text
FROM p LEFT JOIN c ON p.doc_id = c.doc_id
"""

ORACLES["op2_source_mix"] = """
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
      CAST('0x' || md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:12] AS BIGINT) AS u FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS w FROM d GROUP BY source),
k AS (SELECT *, n * 3 / w AS r, coalesce(sum(n * 3) OVER b, 0) AS c0, coalesce(sum(w) OVER b, 0) AS w0, sum(n) OVER () AS t, sum(w) OVER () AS ws FROM s
      WINDOW b AS (ORDER BY n * 3 / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, (t - c0) / (ws - w0) AS share FROM k),
g AS (SELECT *, r <= share AS capped, max(CASE WHEN r > share THEN share END) OVER () AS lvl FROM h),
t AS (SELECT source, n, CASE WHEN capped THEN n * 3 ELSE coalesce(lvl, 0) * w END AS target FROM g),
m AS (SELECT *, floor(CASE WHEN n > 0 THEN target / n ELSE 0 END) AS whole, target - floor(CASE WHEN n > 0 THEN target / n ELSE 0 END) * n AS rest FROM t),
c AS (SELECT source AS cs, length(bin(size)) AS class, sum(size)::DOUBLE AS cn FROM d WHERE size > 0 GROUP BY 1, 2),
cr AS (SELECT *, (1 << (class // 2))::DOUBLE * CASE WHEN class % 2 = 0 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS root FROM c),
ck AS (SELECT *, (rest - coalesce(sum(cn) OVER (PARTITION BY cs ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(cn * root) OVER (PARTITION BY cs ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kk FROM cr JOIN m ON cs IS NOT DISTINCT FROM source),
cf AS (SELECT *, kk * root >= 1 AS filled FROM ck),
cp AS (SELECT cs, class, cn, whole + CASE WHEN filled THEN 1 ELSE 0 END AS base,
      CASE WHEN filled THEN 0 ELSE greatest(coalesce(arg_max(kk, CASE WHEN NOT filled THEN class END) OVER (PARTITION BY cs), 0) * root, 0) END AS p FROM cf),
cs AS (SELECT cs AS rs, sum(cn * p) AS left_over FROM cp GROUP BY cs),
q AS (SELECT d.*, base, p, left_over, CASE WHEN p > 0 THEN ((u + 0.5) / 281474976710656) / (1 - (u + 0.5) / 281474976710656) * (1 - p) / p END AS q
      FROM d JOIN cp ON d.source IS NOT DISTINCT FROM cs AND length(bin(size)) = class JOIN cs ON d.source IS NOT DISTINCT FROM rs WHERE size > 0),
o AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY q, u, CAST(doc_id AS VARCHAR)) AS pl, sum(size) OVER (PARTITION BY source ORDER BY q, u, CAST(doc_id AS VARCHAR)) AS upto FROM q WHERE q IS NOT NULL),
o0 AS (SELECT *, upto <= left_over AS got FROM o),
""" + "".join(f"""e{k} AS (SELECT source AS es, min(left_over) - coalesce(sum(size) FILTER (WHERE got), 0) AS gap, coalesce(max(pl) FILTER (WHERE got), 0) AS cut FROM o{k} GROUP BY source),
n{k} AS (SELECT o{k}.*, gap, pl > cut AND size <= gap AS can FROM o{k} JOIN e{k} ON source IS NOT DISTINCT FROM es),
o{k + 1} AS (SELECT * EXCLUDE (got, gap, can), got OR (can AND sum(CASE WHEN can THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY pl) <= gap) AS got FROM n{k}),
""" for k in range(3)) + """e3 AS (SELECT source AS es, min(left_over) - coalesce(sum(size) FILTER (WHERE got), 0) AS gap FROM o3 GROUP BY source),
f AS (SELECT source AS fs, arg_min(pl, (abs(gap - size), pl)) AS last FROM o3 JOIN e3 ON source IS NOT DISTINCT FROM es WHERE NOT got AND abs(gap - size) < gap GROUP BY source),
x AS (SELECT DISTINCT source AS xs, doc_id AS xd, size AS xz, got OR coalesce(pl = last, FALSE) AS more FROM o3 LEFT JOIN f ON source IS NOT DISTINCT FROM fs),
y AS (SELECT d.doc_id, d.source, d.size, CAST(coalesce(base, 0) + coalesce(CAST(more AS INT), 0) AS BIGINT) AS copies FROM d LEFT JOIN cp ON d.source IS NOT DISTINCT FROM cs AND length(bin(size)) = class AND size > 0
      LEFT JOIN x ON d.source IS NOT DISTINCT FROM xs AND d.doc_id = xd AND d.size = xz)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target, copies, copies * size AS taken FROM y JOIN t ON y.source IS NOT DISTINCT FROM t.source
"""


@query
def op3_group_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of 0.93 and more within a label."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op5_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.r, a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT r, count(*) AS n FROM p GROUP BY r)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON vec_id = c.x LEFT JOIN n ON v.r = n.r
"""


def _spans(of: str = "spans") -> str:
    return f"array_join(transform({of}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')"


@query
def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; a value that at most two sources and ten documents hold looks live."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = "filter(spans, x -> x.kind <> 'token')"
    return found.selectExpr(
        "doc_id",
        *[f"cast(size(filter(spans, x -> x.kind = '{k}')) as long) as n_{k}" for k in ("assign", "access", "hex")],
        f"sha2({_spans(base)}, 256) as base_sha256",
        f"{_spans()} as spans",
        f"{_spans('filter(spans, x -> x.live)')} as live_spans",
        "n_live", "n_example",
    )


_SECRET = r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_FOUND = " FROM d UNION ALL SELECT r, doc_id, source, ".join(f"'{k}' AS kind, {i} AS rank, regexp_extract_all(t, '{p}', 0) AS h, regexp_extract_all(t, '{p}', {g}) AS v, string_split_regex(t, '{p}') AS g" for i, (k, p, g) in enumerate((("assign", _SECRET, 1), ("access", "AKIA[A-Z0-9]+", 0), ("hex", "[0-9a-f]+", 0), ("token", "[A-Za-z0-9+/_-]+", 0))))
ORACLES["op9_secret_ownership"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, doc_id, source, {_FOUND} FROM d),
e AS (SELECT r, doc_id, source, kind, rank, unnest(range(1, len(h) + 1)) AS i, h, v, g FROM m),
s AS (SELECT r, doc_id, source, kind, rank, v[i] AS v, length(h[i]) AS n, list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(h[1:i], lambda x: length(x))) AS e FROM e
  WHERE CASE kind WHEN 'assign' THEN length(v[i]) >= 6 WHEN 'access' THEN length(v[i]) >= 20 WHEN 'hex' THEN length(v[i]) >= 24
    ELSE regexp_matches(v[i], '[0-9]') AND (length(v[i]) >= 20 AND regexp_matches(v[i], '[A-Z]') AND regexp_matches(v[i], '[a-z]') OR length(v[i]) >= 24 AND regexp_full_match(v[i], '[A-Za-z0-9]+') AND regexp_matches(v[i], '[A-Za-z]')) END),
f AS (SELECT *, CAST(e - n AS BIGINT) AS b FROM s),
c AS (SELECT v AS cv, count(DISTINCT coalesce(source, chr(1))) <= 2 AND count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) <= 10 AS live FROM f GROUP BY v),
j AS (SELECT f.*, live FROM f JOIN c ON v = cv),
k AS (SELECT *, kind || ':' || b || ':' || CAST(e AS BIGINT) AS told FROM j WHERE kind <> 'token' OR live AND NOT EXISTS (SELECT 1 FROM j o WHERE o.r = j.r AND o.kind <> 'token' AND o.b < j.e AND j.b < o.e)),
g AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS na, count(*) FILTER (WHERE kind = 'access') AS nk, count(*) FILTER (WHERE kind = 'hex') AS nh, count(*) FILTER (WHERE live) AS nl, count(*) FILTER (WHERE NOT live) AS ne,
  string_agg(told, ',' ORDER BY b, rank) FILTER (WHERE kind <> 'token') AS base, string_agg(told, ',' ORDER BY b, rank) AS spans, string_agg(told, ',' ORDER BY b, rank) FILTER (WHERE live) AS live_spans FROM k GROUP BY r)
SELECT doc_id, coalesce(na, 0) AS n_assign, coalesce(nk, 0) AS n_access, coalesce(nh, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(live_spans, '') AS live_spans,
  coalesce(nl, 0) AS n_live, coalesce(ne, 0) AS n_example FROM d LEFT JOIN g ON d.r = g.r
"""


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold the template's own strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", r"'\\### Assistant: </turn> ok' as text")
    back = chat_format.read_back(chat_format.format_chats(turns.unionByName(odd)))
    return back.selectExpr(
        "conv_id",
        "cast(size(turns) as long) as n_turns",
        "sha2(array_join(transform(turns, x -> concat(x.role, '\n', x.text, '\n')), ''), 256) as turns_sha256",
        "cast(length(array_join(learned, '')) as long) as loss_chars",
        "sha2(array_join(learned, ''), 256) as loss_sha256",
        "formatted_chars",
        "wrong is null as valid",
    )


ORACLES["op7_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok', NULL FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, replace(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), '>: ', '\>: ') AS esc,
  coalesce(role, '') AS r FROM c),
g AS (SELECT conv_id, list({'r': r, 't': text, 'e': length(esc), 'turn': turn} ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS l FROM e GROUP BY conv_id, alone),
s AS (SELECT *, array_to_string(list_transform(l, lambda x: CASE x.r WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END), '') AS p,
  array_to_string(list_transform(list_filter(l, lambda x: x.r = 'assistant'), lambda x: x.t), '') AS loss FROM g)
SELECT conv_id, CAST(len(l) AS BIGINT) AS n_turns,
  sha256(array_to_string(list_transform(l, lambda x: x.r || chr(10) || x.t || chr(10)), '')) AS turns_sha256,
  CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(list_sum(list_transform(l, lambda x: x.e + 8 + CASE x.r WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15
    ELSE 13 + length(replace(replace(replace(replace(x.r, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), '>: ', '\>: ')) END)) AS BIGINT) AS formatted_chars,
  regexp_full_match(p, 's?(ua)+') AS valid
FROM s
"""


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from lang outside the held-out ids, applied to all documents."""
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs)
    return language_id.identify(docs, model).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op8_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = table(spark, sf_dir, "documents")
    found = pii_crf.find_pii(docs, pii_crf.learn(docs))
    return found.selectExpr(
        "doc_id",
        *[f"cast(size(filter(base, x -> x.kind = '{k}')) as long) as n_{k}" for k in pii_crf.KINDS],
        f"sha2({_spans('base')}, 256) as base_sha256",
        f"{_spans()} as spans",
    )


def _crc32(text: str) -> str:
    """DuckDB SQL for the checksum of a text's UTF-8 bytes, four bits at a time."""
    steps = list(range(16))
    for _ in range(4):
        steps = [(x >> 1) ^ (0xEDB88320 * (x & 1)) for x in steps]
    digit = "(strpos('0123456789ABCDEF', b[{}]) - 1)::BIGINT".format
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: [{digit(2)}, {digit(1)}]))),"
        f" lambda c, n: xor(c >> 4, list_extract({steps}::BIGINT[], (xor(c, n) & 15) + 1))))"
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least 7 letters and 2 occurrences in all documents; a form is 10 times as frequent."""
    return spelling.spelling_variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


ORACLES["op11_spelling_variants"] = rf"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS id, {_LOWER("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}'))")} AS w FROM documents),
h AS (SELECT w, {_crc32("id || ':' || w")} AS h, k FROM (SELECT id, w, count(*) AS k FROM r GROUP BY 1, 2)),
v AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, CAST(sum(k) AS BIGINT) AS n FROM h GROUP BY 1),
d AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM v WHERE length(word) >= 7 AND n >= 2),
s AS (SELECT word, n, left(word, CAST(i AS INT)) AS a, substr(word, CAST(i AS INT) + 2) AS b FROM d),
i AS (SELECT DISTINCT s.word AS long, s.n AS long_n, v.word AS short, v.n AS short_n FROM s JOIN v ON a || b = v.word AND v.n >= 2 AND length(v.word) >= 7),
p AS (SELECT x.word, y.word AS near, y.n AS near_n FROM s x JOIN s y ON x.a = y.a AND x.b = y.b AND x.word <> y.word UNION ALL SELECT long, short, short_n FROM i UNION ALL SELECT short, long, long_n FROM i),
b AS (SELECT word, count(*) AS n_near FROM p GROUP BY 1),
t AS (SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM p),
f AS (SELECT v.word, v.n, near AS form, near_n AS form_n FROM v JOIN t ON v.word = t.word AND k = 1 AND near_n >= 10 * n),
c AS (SELECT word, form AS top FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.top = f.word),
e AS (SELECT word, top AS root FROM c WHERE top NOT IN (SELECT word FROM f))
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0) AS n_near, form_n FROM v LEFT JOIN b ON v.word = b.word LEFT JOIN f ON v.word = f.word LEFT JOIN e ON v.word = e.word
WHERE length(v.word) >= 7 AND v.n >= 2
"""


@query
def op12_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of equal weight; the document id and the number of shards decide."""
    from pyspark.sql import functions as F

    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


ORACLES["op12_rendezvous_shards"] = f"""
WITH d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, k, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, CASE WHEN t = '' THEN 0 ELSE {_crc32("t")} END AS text_crc32, CAST('0x' || md5('shard:slot:' || k)[1:12] AS BIGINT) AS place,
  list_transform(range(0, 9), lambda i: -1.0::DOUBLE / ln((CAST('0x' || md5('shard:' || i || ':' || k)[1:12] AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)) AS scored FROM d),
g AS (SELECT *, CAST(list_position(scored[1:8], list_max(scored[1:8])) - 1 AS INT) AS shard, CAST(list_position(scored, list_max(scored)) - 1 AS INT) AS grown_shard FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, k, text_crc32, size) - 1 AS slot, grown_shard FROM g
"""


@query
def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return dual_tree.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format
ORACLES["op13_dual_tree_search"] = f"""
WITH q AS (SELECT row_number() OVER () AS q, item_id, {_TERMS(_LOWER("coalesce(text, '')"))} AS l FROM benchmark),
i AS (SELECT q, item_id, t, count(*) AS c FROM (SELECT q, item_id, unnest(l) AS t FROM q) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS(_LOWER("coalesce(text, '')"))} AS l FROM documents),
n AS (SELECT r, doc_id, CAST(len(l) AS BIGINT) AS n FROM d WHERE len(l) > 0),
a AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS words FROM n),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(l) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM f GROUP BY 1), a),
m AS (SELECT r, doc_id, 25 + (75 * n * total) // words AS m FROM n, a),
s AS (SELECT q, item_id, doc_id, m.r, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN w ON i.t = w.t JOIN f ON i.t = f.t JOIN m ON f.r = m.r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= 10
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
