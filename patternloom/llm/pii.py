"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The base spans of a document are matches of four patterns that pass a check. The candidates of the field
are these matches and every wider look-alike (a number split, joined or written otherwise, an address with
an odd domain). Candidates form a chain in text order; skip edges join a candidate with the last one of
the same digits or letters, and with the last one that shares their end, however far away. Loopy message
passing then makes the labels of a document consistent: a look-alike of something that is certain
elsewhere takes its label. Base matches keep theirs. The weights are trained here, by stochastic gradient
descent on the pseudo-likelihood, from the base labels of a bounded sample of documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternloom.session import ship

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE = 3000  # documents with candidates, about
MOST = 200  # candidates of one document in the sample, in a row; where they begin is drawn
ROUNDS = 10  # of message passing
SURE = 0.7  # marginal from which a candidate is added
SIMILAR = 7  # last digits or letters that similar candidates share

# The patterns of the four kinds, in an equal form that no input makes slow.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

HINT = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]")
NUMBER = re.compile(r"[0-9]+\Z")
#: Wider look-alikes: addresses (of up to 64 and 255 characters, the most an address has), numbers with points or
#: dashes, and up to 8 groups of digits in brackets or apart. What is longer is no candidate, in any text.
WIDE = re.compile(
    r"[^\s@<>\"'(),;:]{1,64}+@[^\s@<>\"'(),;:]{1,255}+"
    r"|(?<![0-9A-Za-z])\+?\(?[0-9]{1,19}+\)?(?:[.\-/\x20]{1,2}\(?[0-9]{1,19}+\)?){0,7}+(?![0-9A-Za-z])"
)
GROUP = re.compile(r"[0-9]{13,19}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern of addresses, found from each @ outwards."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all matches that pass, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in (x.lstrip("0")[:4] or "0" for x in m[0].split("."))):
            out.append((1, *m.span()))
    for kind, pattern, low, high in ((2, CARD, 16, 19), (3, PHONE, 8, 15)):
        for m in pattern.finditer(text):
            n = sum(map(m[0].count, "0123456789"))
            if low <= n <= high and (kind == 3 or luhn("".join(DIGIT.findall(m[0])))):
                out.append((kind, *m.span()))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(label, start, end) in text order: base matches, and look-alikes (label 0) that touch none of them."""
    out = [(kind + 1, a, b) for kind, a, b in base]
    taken = np.array(sorted((a, b) for _, a, b in base) or [(0, 0)])
    reach = np.maximum.accumulate(taken[:, 1])

    def free(a: int, b: int) -> bool:
        k = int(np.searchsorted(taken[:, 0], b)) - 1
        return k < 0 or reach[k] <= a

    for m in WIDE.finditer(text):
        a, b = m.span()
        b -= len(m[0]) - len(m[0].rstrip(".-"))
        if b - a >= 6 and free(a, b):
            out.append((0, a, b))
        if " " in m[0] and "@" not in m[0]:  # parts of a number that stands beside others
            out += [(0, *g.span()) for g in GROUP.finditer(text, a, b) if g.span() != (a, b) and free(*g.span())]
    return sorted(set(out), key=lambda x: (x[1], x[2], -x[0]))


FEATURES = 14
CONSTANT = np.eye(1, FEATURES)[0]


def features(text: str, a: int, b: int) -> np.ndarray:
    part = text[a:b]
    digits = "".join(DIGIT.findall(part))
    n, fields = len(digits), part.split(".")
    quad = len(fields) == 4 and all(NUMBER.match(f) and len(f) <= 3 and int(f) <= 255 for f in fields)
    bare = bool(NUMBER.match(part.lstrip("+").replace(" ", "").replace("-", "")))
    return np.array(
        [
            1, "@" in part, bool(DOMAIN.search(part)), quad, len(fields) == 4, bare and 16 <= n <= 19, 16 <= n <= 19 and luhn(digits),
            13 <= n <= 19, part.startswith("+") and 8 <= n <= 15, 8 <= n <= 15, n == 10, "(" in part, n < 8, n > 19,
        ],
        np.float64,
    )


def edges(text: str, nodes: list[tuple[int, int, int]]) -> np.ndarray:
    """(node, node, type) of the chain (0) and of skips to the last equal (1) or similar (2) candidate."""
    out = [(i - 1, i, 0) for i in range(1, len(nodes))]
    equal: dict[str, int] = {}
    similar: dict[str, int] = {}
    for i, (_, a, b) in enumerate(nodes):
        part = text[a:b].lower()
        form = part if "@" in part else "".join(DIGIT.findall(part))
        end = form[-SIMILAR:] if len(form) >= SIMILAR else None
        if form in equal:
            out.append((equal[form], i, 1))
        if end in similar and similar[end] != equal.get(form):
            out.append((similar[end], i, 2))
        equal[form] = i
        if end:
            similar[end] = i
    return np.array(out, np.int64).reshape(-1, 3)


@dataclass
class Field:
    node: np.ndarray  # FEATURES x labels
    pair: np.ndarray  # types x labels x labels, symmetric


def fit_field(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int = 5, epochs: int = 15) -> Field:
    """Pseudo-likelihood of (features, labels or -1, edges): each known label given those of its neighbours.

    The features of half the nodes, drawn anew each time, are hidden but for the constant, so that the
    field learns what a neighbour's label tells.
    """
    size = len(LABELS)
    node, pair = np.zeros((FEATURES, size)), np.zeros((3, size, size))
    rng, done, steps = np.random.default_rng(seed), 0, epochs * max(1, len(examples))
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            x, y, e = examples[k]
            rate = 0.3 * (1 - done / steps)
            done += 1
            x = np.where(rng.random((len(y), 1)) < 0.5, x, x * CONSTANT)
            logits = x @ node
            for here, there in ((0, 1), (1, 0)):
                known = y[e[:, there]] >= 0
                np.add.at(logits, e[known, here], pair[e[known, 2], y[e[known, there]]])
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), np.maximum(y, 0)] -= 1
            p[y < 0] = 0
            p /= np.sqrt(len(y))
            node -= rate * (x.T @ p + 1e-4 * node)
            step = np.zeros_like(pair)
            for here, there in ((0, 1), (1, 0)):
                known = y[e[:, there]] >= 0
                np.add.at(step, (e[known, 2], y[e[known, there]]), p[e[known, here]])
            pair -= rate * ((step + step.transpose(0, 2, 1)) / 2 + 1e-4 * pair)
    return Field(node, pair)


def marginals(field: Field, x: np.ndarray, y: np.ndarray, e: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Beliefs of all nodes by damped loopy sum-product; nodes with a label above 0 are certain."""
    own = x @ field.node
    own[y > 0] = -50.0
    own[y > 0, y[y > 0]] = 0.0
    own -= own.max(axis=1, keepdims=True)
    source, target = np.concatenate((e[:, 0], e[:, 1])), np.concatenate((e[:, 1], e[:, 0]))
    weight = np.exp(field.pair[np.concatenate((e[:, 2], e[:, 2]))])
    half, messages = len(e), np.zeros((2 * len(e), len(LABELS)))
    for _ in range(rounds):
        belief = own.copy()
        np.add.at(belief, target, messages)
        back = np.concatenate((messages[half:], messages[:half]))
        rest = belief[source] - back
        rest = np.exp(rest - rest.max(axis=1, keepdims=True))
        new = np.log(np.einsum("ei,eij->ej", rest, weight) + 1e-300)
        new -= new.max(axis=1, keepdims=True)
        messages = 0.5 * messages + 0.5 * new
    belief = own.copy()
    np.add.at(belief, target, messages)
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def find_spans(text: str | None, field: Field | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind and start, in code points."""
    if not text or not HINT.search(text):
        return []
    base = base_spans(text)
    out = [(k, a, b, True) for k, a, b in base]
    nodes = candidates(text, base) if field else []
    if any(n[0] == 0 for n in nodes):
        y = np.array([n[0] for n in nodes])
        x = np.array([features(text, a, b) for _, a, b in nodes])
        belief = marginals(field, x, y, edges(text, nodes))
        best = belief[:, 1:].argmax(axis=1) + 1
        end = -1
        for (label, a, b), k, p in zip(nodes, best, belief):
            if label == 0 and p[k] >= SURE and a >= end:
                out.append((int(k) - 1, a, b, False))
                end = b
    return [(KINDS[k], a, b, is_base) for k, a, b, is_base in sorted(out)]


def _examples(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for place, text in zip(batch.column("place").to_pylist(), batch.column("text").to_pylist()):
            nodes = candidates(text, base_spans(text)) if text else []
            if len(nodes) > most:
                start = place % (len(nodes) - most + 1)
                nodes = nodes[start : start + most]
            if not nodes:
                continue
            e = edges(text, nodes)
            y = np.array([n[0] for n in nodes])
            unsure = (y[e[:, :2]] > 0).any(axis=1) & (e[:, 2] > 0)
            touched = e[unsure, :2].ravel()
            y[touched[y[touched] == 0]] = -1  # looks like something certain: not an example of nothing
            x = np.array([features(text, a, b) for _, a, b in nodes])
            rows.append({"place": place, "x": x.ravel(), "y": y, "e": e.ravel()})
        yield pa.RecordBatch.from_pylist(
            rows, pa.schema([("place", pa.int64()), ("x", pa.list_(pa.float64())), ("y", pa.list_(pa.int64())), ("e", pa.list_(pa.int64()))])
        )


def train_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most: int = MOST) -> Field | None:
    """Fit on about ``sample`` documents with candidates, by the hash of their id and text; None if there are none.

    Of a document with more than ``most`` candidates a stretch of so many, drawn by that hash, is an example.
    Repeated rows count once.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(5)).alias("place"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    total = rows.count()
    chosen = rows.where(F.pmod("place", F.lit(1 << 30)) < float(1 << 30) * sample / max(1, total))
    got = chosen.dropDuplicates(["place"]).mapInArrow(partial(_examples, most=most), "place long, x array<double>, y array<long>, e array<long>").toArrow().sort_by("place")
    made = [
        (np.array(r["x"]).reshape(-1, FEATURES), np.array(r["y"], np.int64), np.array(r["e"], np.int64).reshape(-1, 3)) for r in got.to_pylist()
    ]
    return fit_field(made) if made else None


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "base"), s)) for s in find_spans(t, field)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "spans": pa.array(found, SPANS_ARROW)})

    return run


SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find_personal_data(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and spans (kind, start, end, base) by kind and start, in code points.

    ``base`` tells the fixed patterns from what the field adds; added spans touch no base span. Null and
    empty texts have none; repeated rows are searched one by one. Other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("spans", T._parse_datatype_string(SPANS))])
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan(shared), kind)
    return found.select(F.col("id").alias(id_col), "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
