"""Operator 4: quality rules as a learned decision list. DataFrame functions only, from text to verdict.

Statistics of each text are SQL expressions. Rules are learned from a bounded sample of labelled documents' statistics by
sequential covering: a conjunction of thresholds is grown on two thirds of what is left, pruned on the other third, and
kept if it is precise there; what it covers is set aside and the next is grown. The list is then one CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the rules are learned from, at most; taken in the order of a digest of the id.
FIT_ROWS = 8_000

_NOT_GAP = r"[^\\x20\\x09-\\x0D]"

#: Ratios that rules may test, from the statistics below.
FEATURES = {
    "symbols": "n_symbols / word_chars",
    "capitals": "n_capitals / word_chars",
    "marks": "n_marks / word_chars",
    "digits": "n_digits / word_chars",
    "word_length": "word_chars / n_words",
    "distinct_words": "n_distinct / n_words",
    "repeat_words": "n_repeat_words / n_words",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}

_WORDS = r"regexp_extract_all(__qr_t, '[^\\x20\\x09-\\x0D]+', 0)"
_PAIRED = "zip_with(slice({0}, 1, size({0}) - {1}), slice({0}, {1} + 1, size({0}) - {1}), (a, b) -> xxhash64(a, b))"
#: Words in 8-word windows that the text holds twice or more. Hashes of words are put together two by two, then four by four, then
#: eight by eight; sorted window hashes give the places of the repeated ones; each place adds eight words, or as many as lie before
#: the next place. Each step is worked out once and kept in a column.
_STEPS = (
    ("__qr_t", "coalesce(cast({text} as string), '')"),
    ("__qr_w", f"transform({_WORDS}, x -> xxhash64(x))"),
    ("__qr_2", "if(size(__qr_w) < 9, array(), " + _PAIRED.format("__qr_w", 1) + ")"),
    ("__qr_4", "if(size(__qr_2) = 0, array(), " + _PAIRED.format("__qr_2", 2) + ")"),
    ("__qr_8", "if(size(__qr_4) = 0, array(), " + _PAIRED.format("__qr_4", 4) + ")"),
    ("__qr_s", "if(size(array_distinct(__qr_8)) = size(__qr_8), array(), array_sort(transform(__qr_8, (x, i) -> struct(x as h, i as i))))"),
    ("__qr_p", "if(size(__qr_s) = 0, array(), array_sort(transform(filter(__qr_s, (x, k) -> coalesce(x.h = get(__qr_s, k - 1).h, false) or coalesce(x.h = get(__qr_s, k + 1).h, false)), x -> x.i)))"),
    ("__qr_l", f"filter(split(__qr_t, '\\n'), x -> x rlike '{_NOT_GAP}')"),
)
_COUNTS = r"""named_struct(
    'n_words', cast(size(__qr_w) as long),
    'word_chars', cast(length(__qr_t) - regexp_count(__qr_t, '[\\x20\\x09-\\x0D]') as long),
    'n_symbols', cast(regexp_count(__qr_t, '[#*$%&|<>]') as long),
    'n_lines', cast(size(__qr_l) as long),
    'n_dup_lines', cast(size(__qr_l) - size(array_distinct(__qr_l)) as long),
    'n_repeat_words', aggregate(transform(__qr_p, (x, k) -> least(8, coalesce(get(__qr_p, k + 1) - x, 8))), 0L, (a, x) -> a + x),
    'n_capitals', cast(regexp_count(__qr_t, '\\p{Lu}') as long),
    'n_digits', cast(regexp_count(__qr_t, '[0-9]') as long),
    'n_marks', cast(regexp_count(__qr_t, '[!?]') as long),
    'n_distinct', cast(size(array_distinct(__qr_w)) as long))"""


def _held(df: DataFrame, name: str, value: str) -> DataFrame:
    """df with one more column, worked out once for each row however often it is used: a generator stands behind it."""
    return df.select("*", F.explode(F.array(F.expr(value))).alias(name))


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one more column, stats (or a new one for one of that name): a struct of counts over the whole text (null: as an
    empty one).

    n_words; word_chars (code points in words); n_symbols (characters of #*$%&|<>); n_lines (lines with a word);
    n_dup_lines (those equal to an earlier one); n_repeat_words (words in 8-word windows found twice or more); n_capitals,
    n_digits, n_marks (of ! and ?); n_distinct (different words). The counts come out of a generator, so that a filter on
    them doesn't make Spark work them out anew for each condition.
    """
    out = docs.drop("stats")
    names = out.columns
    for name, value in _STEPS:
        out = _held(out, name, value.replace("{text}", f"`{text_col}`"))
    return _held(out, "stats", _COUNTS).select(*[F.col(f"`{c}`") for c in names], "stats")


def base_failed(s: str = "stats") -> F.Column:
    """Too short, or too much of it repeated: needs no learning."""
    return F.expr(f"{s}.n_words < 20 or 100 * {s}.n_repeat_words > 30 * {s}.n_words")


@dataclass(frozen=True)
class Rule:
    """Rejects a text if all conditions (feature, '>' or '<=', threshold) hold."""

    conditions: tuple[tuple[str, str, float], ...]
    covered: int
    precision: float

    def sql(self, s: str = "stats") -> str:
        return " and ".join(f"{_of(f, s)} {op} {t!r}D" for f, op, t in self.conditions)


def _of(feature: str, s: str) -> str:
    import re

    return "coalesce(try_divide({}), 0D)".format(re.sub(r"\b(n_\w+|word_chars)\b", rf"{s}.\1", FEATURES[feature]).replace(" / ", ", "))


def rejects(rules: list[Rule], s: str = "stats") -> F.Column:
    """The decision list as one ordered conditional expression: the number of the first rule that rejects, else null."""
    if not rules:
        return F.lit(None).cast("int")
    return F.expr("case " + " ".join(f"when {r.sql(s)} then {i}" for i, r in enumerate(rules, 1)) + " end")


def learn_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, least_precision: float = 0.97) -> list[Rule]:
    """Learns which statistics mark documents labelled 0, from at most fit_rows labelled documents that pass base_failed.

    Null labels and ids are passed over; of several labels of a document the least counts. Without labels there are no
    rules, and nothing is rejected.
    """
    # a bounded number of ids, so broadcasting them is safe at any size of the corpus
    chosen = F.broadcast(
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    )
    named = docs.select(F.col(f"`{id_col}`").alias("__own"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    picked = named.join(chosen, F.col("__own") == F.col("__id")).select("__id", "__label", "__text")
    rows = (
        text_stats(picked, "__text").where(~base_failed())
        .select(F.pmod(F.xxhash64("__id", F.lit(3)), F.lit(3)).alias("part"), F.expr("__label = 0").alias("junk"), *[F.expr(_of(f, "stats")).alias(f) for f in FEATURES])
        .orderBy("__id").limit(2 * fit_rows).collect()
    )
    if not rows:
        return []
    x = np.array([[r[f] for f in FEATURES] for r in rows], float)
    return _cover(x, np.array([r["junk"] for r in rows]), np.array([r["part"] for r in rows]) > 0, least_precision)


def _cover(x: np.ndarray, junk: np.ndarray, grow: np.ndarray, least_precision: float) -> list[Rule]:
    names, rules, left = list(FEATURES), [], np.ones(len(x), bool)
    while len(rules) < 16 and (left & grow & junk).sum() >= 3:
        rule = _grow(x[left & grow], junk[left & grow])
        rule = _prune(rule, x[left & ~grow], junk[left & ~grow])
        if not rule:
            break
        hit, held = _holds(rule, x) & left, _holds(rule, x[left & ~grow])
        true = int(junk[left & ~grow][held].sum())
        if held.sum() < 2 or true / held.sum() < least_precision or junk[hit].mean() < least_precision:
            break
        rules.append(Rule(tuple((names[f], ">" if up else "<=", float(t)) for f, up, t in rule), int(hit.sum()), float(junk[hit].mean())))
        left &= ~hit
    return rules


def _holds(rule: list[tuple[int, bool, float]], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, up, t in rule:
        out &= (x[:, f] > t) == up
    return out


def _grow(x: np.ndarray, junk: np.ndarray) -> list[tuple[int, bool, float]]:
    """Adds the threshold with the largest information gain until no clean document is covered."""
    rule: list[tuple[int, bool, float]] = []
    inside = np.ones(len(x), bool)
    while len(rule) < 5:
        p, n = (inside & junk).sum(), (inside & ~junk).sum()
        if not n or not p:
            break
        best, most = None, 1e-9
        for f in range(x.shape[1]):
            v = np.unique(x[inside, f])
            if len(v) < 2:
                continue
            cut = (v[1:] + v[:-1]) / 2
            cut = cut[np.unique(np.linspace(0, len(cut) - 1, 128).astype(int))]
            at_p, at_n = np.sort(x[inside & junk, f]), np.sort(x[inside & ~junk, f])
            low_p, low_n = np.searchsorted(at_p, cut, "right"), np.searchsorted(at_n, cut, "right")
            for up, cp, cn in ((True, p - low_p, n - low_n), (False, low_p, low_n)):
                gain = cp * (np.log2((cp + 1e-9) / (cp + cn + 1e-9)) - np.log2(p / (p + n)))
                k = int(gain.argmax())
                if gain[k] > most:
                    best, most = (f, up, float(cut[k])), gain[k]
        if best is None:
            break
        rule.append(best)
        inside &= _holds([best], x)
    return rule


def _prune(rule: list[tuple[int, bool, float]], x: np.ndarray, junk: np.ndarray) -> list[tuple[int, bool, float]]:
    """Drops last conditions as long as that doesn't lower (p - n) / (p + n) on rows that growing didn't see."""

    def worth(r: list[tuple[int, bool, float]]) -> float:
        hit = _holds(r, x)
        p, n = (hit & junk).sum(), (hit & ~junk).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def apply_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """docs with stats, base_failed, rule (the number of the rule that rejects it, or null) and kept; all rows stay.

    A null or empty text has no words and fails the base. Columns of docs with these names are replaced; all others stay,
    whatever their names. An empty table gives an empty result.
    """
    docs = docs.drop("stats", "base_failed", "rule", "kept")
    return text_stats(docs, text_col).select("*", base_failed().alias("base_failed"), rejects(rules).alias("rule")).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )
