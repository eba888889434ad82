"""Operator 8: personal data by a skip-chain conditional random field over the base patterns.

Base patterns find e-mail addresses, IP addresses, card numbers and telephone numbers. Every text with a digit or an @ is a
random field: its nodes are the base matches, the other runs of digits (with the marks that number formats put between them),
tokens with an @, and words that are the name part of a found address. A node's own potential is a linear function of its
shape; nodes next to each other share a potential, and so do distant ones with equal or similar content (the same token, the
same last digits, the same name), whatever lies between: the skip edges. All potentials are learned together, by
pseudo-likelihood, on a bounded sample with the base matches as labels; each node is learned from twice, once without what the
patterns test, so that the field learns how far to trust a node's surroundings. Loopy message passing, run until the messages
settle, then spreads what the patterns are sure of; a node that ends up more likely personal data than not is added to the
spans. Base spans stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds, in the order that breaks ties; label 0 is 'none of them'. Patterns are fixed values of the contract.
KINDS = ("email", "ip", "card", "phone")
#: They are tried where a run of their characters begins alone, as what fails there fails further on, and give nothing back: so
#: a text of any length is read once.
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Other nodes: tokens with an @, and runs of digits with marks between them (letters beside them make them part of a word).
_NODE = re.compile(r"(?<![^\x20\x09-\x0D@])[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]*[A-Za-z0-9]|(?<![A-Za-z0-9])[+(]{0,2}(?:[0-9]{1,6}(?:[\x20().-]{1,2}[0-9]{1,6})*|[0-9]+)(?![A-Za-z0-9])")
_WORD = re.compile(r"[^\x20\x09-\x0D.,;:!?()\[\]<>\"']+")

#: Texts that the potentials are learned from, at most.
FIT_ROWS = 1_500
#: Messages have settled when none would move by more than this. Steps are damped by half, and by half again after each PATIENCE
#: rounds, in case a loop swings; ROUNDS only keeps a field that never settles from running for ever.
SETTLED, PATIENCE, ROUNDS = 1e-4, 200, 2_000


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted; code points, end exclusive."""
    out = []
    if "@" in text:
        at = 0
        for m in _LOCAL.finditer(text):
            # what a match before has taken of the run is gone
            if max(m.start(), at) < m.end() and text.startswith("@", m.end()) and (d := _DOMAIN.match(text, m.end() + 1)):
                out.append((max(m.start(), at), 0, d.end()))
                at = d.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return sorted(out)


@dataclass(frozen=True)
class Node:
    start: int
    end: int
    token: str
    label: int  # 0, or the kind of the base span that it is, plus 1


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[Node]:
    """The nodes of a text, by place: base spans, and what lies between them."""
    out = [Node(s, e, text[s:e], k + 1) for s, k, e in base]
    names = {x for s, k, e in base if k == 0 for x in _names(text[s:e])}
    at = 0
    for s, e in [*_joined((s, e) for s, _, e in base), (len(text), len(text))]:
        gap = text[at:s]
        out += [Node(at + m.start(), at + m.end(), m[0], 0) for m in _NODE.finditer(gap)]
        if names:
            out += [Node(at + m.start(), at + m.end(), m[0], 0) for m in _WORD.finditer(gap) if m[0].lower() in names]
        at = e
    return sorted(out, key=lambda n: (n.start, n.label))


def _joined(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _names(address: str) -> set[str]:
    """Words of the part before the @ that are long enough to name someone."""
    return {x for x in re.split(r"[^a-z]+", address.split("@")[0].lower()) if len(x) >= 4}


def _digits(token: str) -> str:
    return re.sub(r"[^0-9]", "", token)


#: How many of a node's features at the end are what the base patterns test; learning leaves them out every other time.
TESTED = 2


def shape(token: str) -> tuple[int, ...]:
    """What a node's own potential depends on: yes or no, each."""
    digits = _digits(token)
    n, plain = len(digits), not any(c.isalpha() for c in token)
    return tuple(map(int, (
        True, "@" in token, plain and n <= 4, plain and 5 <= n <= 8, plain and 9 <= n <= 11, plain and 12 <= n <= 15, plain and n >= 16, not digits,
        plain and token.count(".") == 3, plain and "-" in token, plain and "(" in token, plain and " " in token, plain and n == len(token),
        token.startswith("+"), plain and 12 <= n <= 19 and not _luhn(digits),
    )))


def refused(token: str) -> list[bool]:
    """Labels that a node can't have, as a kind's check turns it down."""
    digits, parts = _digits(token), token.split(".")
    numbers = len(parts) == 4 and all(p.isdecimal() and p.isascii() for p in parts)
    return [False, False, numbers and any(len(p.lstrip("0")) > 3 or int(p[-4:]) > 255 for p in parts), 12 <= len(digits) <= 19 and not _luhn(digits), False]


#: Kinds of skip edges: between equal tokens, numbers with the same last seven digits, and an address and its name.
SKIPS = ("same", "digits", "name")


def keys(token: str) -> list[tuple[int, str]]:
    """(kind of edge, key): nodes that share one are joined by a skip edge."""
    digits = _digits(token)
    out = [(0, token.lower())]
    if len(digits) >= 7 and not any(c.isalpha() for c in token):
        out.append((1, digits[-7:]))
    return out + [(2, x) for x in (sorted(_names(token)) if "@" in token else [token.lower()] if token.isalpha() else [])]


def _groups(found: list[Node]) -> dict[tuple[int, ...], list[int]]:
    """Nodes that share keys, with the number of keys of each kind that they share; keys that the same nodes share act as one.

    A key of the kinds digits and name counts where it joins more than equal tokens do.
    """
    by_key: dict[tuple[int, str], list[int]] = defaultdict(list)
    for i, node in enumerate(found):
        for key in dict.fromkeys(keys(node.token)):
            by_key[key].append(i)
    groups: dict[tuple[int, ...], list[int]] = {}
    for (kind, _), same in by_key.items():
        if len(same) > 1 and (kind == 0 or len({found[i].token.lower() for i in same}) > 1):
            groups.setdefault(tuple(same), [0] * len(SKIPS))[kind] += 1
    return groups


def _beside(found: list[Node]) -> list[int]:
    """Nodes that the next one follows closely."""
    return [i for i in range(len(found) - 1) if 0 <= found[i + 1].start - found[i].end <= 2]


@dataclass
class Field:
    """Potentials: weights (features by labels), beside (label by next label), agree (by kind of skip edge)."""

    weights: np.ndarray
    beside: np.ndarray
    agree: np.ndarray


def _spoke(agree: float, k: int) -> float:
    """Agreement of each of two edges that meet in a shared node, so that their ends agree as over one edge of agree."""
    e = np.exp(agree)
    return float(np.log(e + np.sqrt(e * e - (k - 1) + e * (k - 2))))


def posterior(found: list[Node], field: Field) -> np.ndarray:
    """Marginals of each node by loopy belief propagation.

    Nodes with a label are fixed. Two occurrences of a key are joined by an edge; more are each joined to one node that they
    share, so m of them make m edges and any two are two edges apart, however many lie between.
    """
    n, k = len(found), len(KINDS) + 1
    own = np.array([shape(x.token) for x in found], float) @ field.weights
    known = np.array([x.label for x in found])
    no = np.array([refused(x.token) for x in found])
    own[:, 0] = np.logaddexp(own[:, 0], np.where(no, own, -np.inf).max(1))  # what was refused is none, not the next best kind
    own[no] = -30
    own[known > 0] = -30
    own[known > 0, known[known > 0]] = 30
    edges: dict[tuple[int, int], np.ndarray] = {(i, i + 1): field.beside for i in _beside(found)}
    hub = n
    for same, times in _groups(found).items():
        agree = float(np.dot(times, field.agree))
        if agree <= 0:
            continue
        if len(same) == 2:
            edges[same] = edges.get(same, 0) + agree * np.eye(k)
        else:
            spoke = _spoke(agree, k) * np.eye(k)
            edges.update(((i, hub), spoke) for i in same)
            hub += 1
    if not edges or known.all():
        return _norm(own)
    own = np.concatenate([own, np.zeros((hub - n, k))])
    pair = np.array(list(edges))
    a, b = np.concatenate([pair[:, 0], pair[:, 1]]), np.concatenate([pair[:, 1], pair[:, 0]])
    table = np.exp(np.array([*edges.values(), *(p.T for p in edges.values())]))
    m, back = len(pair), np.concatenate([np.arange(len(pair)) + len(pair), np.arange(len(pair))])
    message = np.full((2 * m, k), -np.log(k))
    for turn in range(ROUNDS):
        total = own.copy()
        np.add.at(total, b, message)
        out = total[a] - message[back]
        out = np.einsum("ei,eij->ej", np.exp(out - out.max(1, keepdims=True)), table)
        move = np.log(out / out.sum(1, keepdims=True) + 1e-30) - message
        message += 0.5 ** (1 + turn // PATIENCE) * move
        if np.abs(move).max() < SETTLED:
            break
    total = own.copy()
    np.add.at(total, b, message)
    return _norm(total[:n])


def _norm(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def find_spans(text: str | None, field: Field | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a whole text, as (start, kind, end)."""
    text = text or ""
    base = base_spans(text)
    if field is None or not ("@" in text or _DIGIT.search(text)):
        return base, base
    found = nodes(text, base)
    if all(x.label for x in found):
        return base, base
    p = posterior(found, field)
    added = [(x.start, int(q[1:].argmax()), x.end) for x, q in zip(found, p, strict=True) if not x.label and q[0] < 0.5]
    return base, sorted(base + added)


def _retold(text: str, base: list[tuple[int, int, int]]) -> tuple[list[Node], int]:
    """The nodes of a text to which other forms of its telephone numbers are added, labelled as those, and two other numbers of the
    same form for each, labelled as none; and where what was added begins. So form alone tells little, and the skip edges have
    something to be learned from."""
    end, mine = len(text), set()
    for start, kind, stop in base:
        if KINDS[kind] == "phone":
            digits = _digits(text[start:stop])[-10:]
            mark = "- "[sum(map(int, digits)) % 2]
            for shift in (0, 3, 6):
                told = "".join(str((int(c) + shift) % 10) for c in digits)
                text += " or "
                if not shift:
                    mine.add(len(text))
                text += mark.join((told[:-7], told[-7:-4], told[-4:])).lstrip(mark)
    found = nodes(text, base) if mine else []
    return [replace(x, label=KINDS.index("phone") + 1) if x.start in mine else x for x in found], end


def examples(text: str) -> Counter:
    """What is learned from a text: (features, label before, label after, votes of skip edges, label) with their number.

    -1 is no neighbour; a vote is a kind of edge's share of other nodes with each label, in quarters. So there are few different
    examples, however many nodes a text has.
    """
    base = base_spans(text)
    retold, end = _retold(text, base)
    found = nodes(text, base)
    # what lies in a match that is too long for its kind may be one of several numbers run together, and what is like a found
    # number may be that number: no label is known
    long = _joined(sorted(m.span() for p, most in ((_CARD, 19), (_PHONE, 15)) for m in p.finditer(text) if len(_digits(m[0])) > most))
    ends = np.array([e for _, e in long])
    inside = lambda x: (k := int(np.searchsorted(ends, x.start, "right"))) < len(long) and long[k][0] <= x.start
    unsure = {x.start for x in found if not x.label and inside(x)} if long else set()
    unsure |= {found[i].start for same in _groups(found) if any(found[i].label for i in same) for i in same if not found[i].label}
    return _examples(found, 0, unsure) + _examples(retold, end, unsure)


def _examples(found: list[Node], least: int, unsure: set[int]) -> Counter:
    k = len(KINDS) + 1
    found = [x for x in found if x.start not in unsure]
    before, after = [-1] * len(found), [-1] * len(found)
    for i in _beside(found):
        before[i + 1], after[i] = found[i].label, found[i + 1].label
    votes = np.zeros((len(found), len(SKIPS), k))
    for same, times in _groups(found).items():
        n = np.bincount([found[i].label for i in same], minlength=k)
        for i in same:
            rest = n.copy()
            rest[found[i].label] -= 1
            votes[i] += np.minimum(times, 1)[:, None] * rest / (len(same) - 1)
    votes = np.rint(np.minimum(votes, 1) * 4).astype(int).reshape(len(found), len(SKIPS) * k).tolist()
    return Counter((shape(x.token), b, a, tuple(v), x.label) for x, b, a, v in zip(found, before, after, votes, strict=True) if x.start >= least)


def fit(counted: dict, rounds: int = 3000, decay: float = 2e-4) -> Field | None:
    """All potentials together, by the pseudo-likelihood of the labels given their neighbours' (see examples)."""
    if not counted:
        return None
    k = len(KINDS) + 1
    x, before, after, votes, y = (np.array(c) for c in zip(*counted, strict=True))
    many = np.array(list(counted.values()), float)
    hidden = x.copy()
    hidden[:, -TESTED:] = 0
    x, before, after, votes, y, many = (np.concatenate([a, b]) for a, b in ((x, hidden), (before, before), (after, after), (votes, votes), (y, y), (many, many)))
    many = np.minimum(many, 50) / np.minimum(many, 50).sum()  # a form met very often doesn't outvote all others
    votes = votes.reshape(len(x), len(SKIPS), k) / 4
    x, one = x.astype(float), np.eye(k + 1)[:, :k]  # -1: a row of zeros
    before, after, truth = one[before], one[after], np.eye(k)[y]
    w, beside, agree = np.zeros((x.shape[1], k)), np.zeros((k, k)), np.zeros(len(SKIPS))
    held = [np.zeros_like(p) for p in (w, beside, agree)]
    for _ in range(rounds):
        p = _norm(x @ w + before @ beside + after @ beside.T + np.einsum("t,ntl->nl", agree, votes))
        e = (p - truth) * many[:, None]
        grads = (x.T @ e, before.T @ e + e.T @ after, np.einsum("ntl,nl->t", votes, e))
        for q, g, v in zip((w, beside, agree), grads, held, strict=True):
            v *= 0.9
            v -= 0.5 * (g + decay * q)
            q += v
    return Field(w, beside, agree)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Field | None:
    """Potentials from at most fit_rows documents, taken by a digest of the id. Texts stay on executors: what comes to the driver
    is the number of each different example."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    # a bounded number of ids, so broadcasting them is safe at any size of the corpus
    chosen = F.broadcast(named.select("id").dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(fit_rows))
    votes = len(SKIPS) * (len(KINDS) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for t in batch.column(0):
                if (text := t.as_py()) and ("@" in text or _DIGIT.search(text)):
                    seen.update(examples(text))
            rows = [[*x, b, a, *v, y] for x, b, a, v, y in seen]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], ["example", "n"])

    told = named.join(chosen, "id").select("text").mapInArrow(run, "example array<int>, n long").groupBy("example").agg(F.sum("n").alias("n")).orderBy("example").collect()
    split = lambda e: (tuple(e[: -3 - votes]), e[-3 - votes], e[-2 - votes], tuple(e[-1 - votes : -1]), e[-1])
    return fit({split(r.example): r.n for r in told})


def _told(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in spans]


def find_pii(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in each whole text: (doc_id, base, spans), arrays of (kind, start, stop); a row for each row of docs.

    Both go by start, then kind as in KINDS. A null text is an empty one; rows that repeat an id stay rows of their own, and a
    null id stays null. Other columns are ignored, whatever their names.
    Without a model (nothing to learn from) the spans are the base spans. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t.as_py(), shared.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([_told(f[k]) for f in found], kind) for k in (0, 1))], ["doc_id", "base", "spans"])

    spans = "array<struct<kind:string,start:int,stop:int>>"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id long, base {spans}, spans {spans}")
