"""Metadata of a labelled table: attributes, domains, labels and classes.

Only the schema-sized part of the data lives here (one entry per column, one
per label, nominal domains up to a checked size); rows never do.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

WORD_BITS = 60


@dataclass(frozen=True)
class Label:
    label: int
    shape: str
    x0: float
    x1: float
    x2: float | None = None

    def __getitem__(self, key):
        return getattr(self, key)


@dataclass(frozen=True)
class Attribute:
    pos: int
    name: str
    kind: str
    min: float | None = None
    max: float | None = None
    domain: tuple[str, ...] = ()
    labels: tuple[Label, ...] = ()

    @property
    def numeric(self) -> bool:
        return self.kind == "numeric"

    @property
    def n_values(self) -> int:
        return len(self.labels) if self.numeric else len(self.domain)


@dataclass(frozen=True)
class Word:
    """One bigint of a rule mask: values ``first .. first+bits-1`` of ``var``."""

    var: int
    first: int
    bits: int

    @property
    def full(self) -> int:
        return (1 << self.bits) - 1


@dataclass(frozen=True)
class TableModel:
    class_col: str
    attributes: tuple[Attribute, ...]
    classes: tuple[str, ...]
    class_counts: tuple[int, ...] = field(default=())
    custom_labels: bool = False

    @cached_property
    def words(self) -> tuple[Word, ...]:
        """Every attribute has at least one word; long domains are split evenly."""
        out = []
        for a in self.attributes:
            n = a.n_values
            parts = max(1, -(-n // WORD_BITS))
            base, extra, first = n // parts, n % parts, 0
            for p in range(parts):
                bits = base + (1 if p < extra else 0)
                out.append(Word(a.pos, first, bits))
                first += bits
        return tuple(out)

    @cached_property
    def var_words(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {a.pos: [] for a in self.attributes}
        for i, w in enumerate(self.words):
            out[w.var].append(i)
        return out

    @property
    def n_vars(self) -> int:
        return len(self.attributes)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def mask_columns(self) -> list[str]:
        return [f"m{i}" for i in range(self.n_words)]

    @property
    def n_rows(self) -> int:
        return sum(self.class_counts)

    @property
    def n_features(self) -> int:
        """Number of (attribute, value) features, the class included."""
        return sum(a.n_values for a in self.attributes) + len(self.classes)

    def features(self) -> list[tuple[int, int]]:
        return [(a.pos, j) for a in self.attributes for j in range(a.n_values)]

    def mask(self, conditions: dict[int, list[int]]) -> list[int]:
        """Rule mask selecting the given values of the given variables."""
        masks = [0] * self.n_words
        for var, values in conditions.items():
            for i in self.var_words[var]:
                w = self.words[i]
                for v in values:
                    if w.first <= v < w.first + w.bits:
                        masks[i] |= 1 << (v - w.first)
        return masks

    def row_masks(self, word: int) -> list[int]:
        """Every mask under which rows are looked up in this word: those a row can hold, or single own labels."""
        w, a = self.words[word], self.attributes[self.words[word].var]
        if w.bits == 0:
            return []
        if not a.numeric:
            return sorted({1 << b for b in range(w.bits)} | {w.full})
        if self.custom_labels:  # a row may hold any set of them
            return [1 << b for b in range(w.bits)]
        runs = {((1 << n) - 1) << b for n in range(1, w.bits + 1) for b in range(w.bits - n + 1)}
        return sorted(runs)

    @cached_property
    def signature_bound(self) -> int:
        """Upper bound of the number of distinct encoded rows, known without a scan."""
        bound = max(len(self.classes), 1) + 1
        for a in self.attributes:
            n = a.n_values
            if a.numeric and self.custom_labels:
                bound *= 1 << n
            elif a.numeric:
                bound *= max(2 * n, 1)
            else:
                bound *= n + 2
            if bound > 1 << 62:
                return 1 << 62
        return bound

    # -- storage ---------------------------------------------------------

    def attributes_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (a.pos, a.name, a.kind, a.min, a.max, list(a.domain), a.n_values) for a in self.attributes
        ]
        return spark.createDataFrame(
            rows, "pos int, name string, kind string, min double, max double, domain array<string>, n_values int"
        )

    def labels_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(a.pos, *asdict(x).values()) for a in self.attributes for x in a.labels]
        return spark.createDataFrame(
            rows, "var int, label int, shape string, x0 double, x1 double, x2 double"
        )

    def values_frame(self, spark: SparkSession) -> DataFrame:
        """One row per (variable, value) with its readable text."""
        rows = []
        for a in self.attributes:
            if a.numeric:
                for x in a.labels:
                    pts = [x.x0, x.x1] + ([x.x2] if x.x2 is not None else [])
                    body = ", ".join(f"{p:.6f}" for p in pts)
                    rows.append((a.pos, x.label, a.name, f"Label {x.label}: {x.shape}({body})"))
            else:
                rows += [(a.pos, j, a.name, v) for j, v in enumerate(a.domain)]
        return spark.createDataFrame(rows, "var int, val int, name string, value_text string")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> TableModel:
        raw = json.loads(text)
        attrs = tuple(
            Attribute(**{**a, "domain": tuple(a["domain"]), "labels": tuple(Label(**x) for x in a["labels"])})
            for a in raw["attributes"]
        )
        return TableModel(
            raw["class_col"], attrs, tuple(raw["classes"]), tuple(raw["class_counts"]), raw["custom_labels"]
        )

    def with_labels(self, labels: DataFrame) -> TableModel:
        """Replace label definitions by the caller's (var, label, shape, x0, x1, x2)."""
        given: dict[int, list[Label]] = {}
        for r in labels.select("var", "label", "shape", "x0", "x1", "x2").collect():
            given.setdefault(r["var"], []).append(Label(*r[1:]))
        attrs = []
        for a in self.attributes:
            mine = tuple(sorted(given.get(a.pos, a.labels), key=lambda x: x.label))
            attrs.append(Attribute(a.pos, a.name, a.kind, a.min, a.max, a.domain, mine))
        return TableModel(self.class_col, tuple(attrs), self.classes, self.class_counts, True)
