"""Main text of web pages: the best contiguous region by scores of words and tags.

A page is a sequence of words and tags. Words score positive and tags negative, by weights learnt from
pages whose markup labels its article: the log ratio of how often a class of words (by the element around
them) or a tag occurs inside and outside. One linear scan finds the contiguous region with the
largest sum. It chooses the element: the ``article`` or ``main`` that holds most of it, or else the smallest container
that holds all of it. All blocks of that element are the text (lists, tables and code too, wherever they stand), without
what is never part of an article: elements and whole class, id or role names that are fixed below.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternloom.llm.spread import numbered
from patternloom.session import ship

SAMPLE = 2000  # labelled pages, about
LEAST, MOST = 0.05, 4.0  # bounds of a weight
UNSEEN = {"word": 0.5, "tag": -0.2}
LABEL = "article"

# Elements by their use in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no text of the page; that of RAW_TEXT is no markup either.
RAW = frozenset("script style textarea title noscript template iframe svg select option button".split())
RAW_TEXT = frozenset("script style textarea iframe".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
#: Classes, ids and roles, as whole tokens, that name something beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo sidebar side-bar widget comment comments respond replies disqus cookie cookies"
    " consent notice alert popup modal newsletter subscribe signup share social related recommended breadcrumb breadcrumbs menu nav navbar navigation"
    " footer pagination toolbar login search".split()
)
#: Elements inside a line; others that are not known count as one class.
INLINE = frozenset(
    "a abbr audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label map mark math meter object output picture progress q rp rt ruby"
    " s samp small span strike strong sub sup time tt u var video".split()
)
KNOWN = BLOCKS | VOID | RAW | INLINE
#: Elements that hold several blocks; of the body, those without a word of the best stretch are something else.
CONTAINERS = frozenset("address article aside body center details dialog div fieldset footer form header html main section".split())
NEVER_BESIDE = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())  # by a class, id or role
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
COMMENT = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?", re.S)
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)  # quotes mean nothing
TAG_START = re.compile(r"</?[A-Za-z]")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in page order, without comments and raw text.

    Where a tag does not end because of a quote, quotes mean nothing from there on; one that does not end at all
    is cut off, and the page with it. So no character is read more than a few times.
    """
    at = pos = 0
    tag, unclosed = TAG, set()
    while (pos := page.find("<", pos)) >= 0:
        if not TAG_START.match(page, pos):
            m = COMMENT.match(page, pos)
            if not m:
                pos += 1
                continue
        else:
            m = tag.match(page, pos)
            if not m and tag is TAG:
                tag = LOOSE_TAG
                m = tag.match(page, pos)
            if not m:
                break
        if pos > at:
            yield "text", page[at:pos], ""
        at = pos = m.end()
        if m.re is COMMENT:
            continue
        name = m[2].lower()
        yield ("close" if m[1] else "open"), name, m[3]
        if not m[1] and name in RAW_TEXT and name not in unclosed and not m[3].endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            if end or name == "script":
                at = pos = end.end() if end else len(page)
                yield "close", name, ""
            else:
                unclosed.add(name)
    rest = page[at:pos] if pos >= 0 else page[at:]
    if rest:
        yield "text", rest, ""


def names(attributes: str) -> dict[str, list[str]]:
    """The lowered tokens of class, id and role; the first of equal attributes counts."""
    found: dict[str, list[str]] = {}
    for key, *values in ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id", "role"):
            found.setdefault(key.lower(), "".join(values).lower().split())
    return found


@dataclass
class Element:
    name: str
    parent: int  # place among the elements of the page, in order of their starts
    raw: bool = False  # it or one around it has no text of the page
    beside: bool = False  # it is itself something beside the article
    article: bool = False
    words: int = 0  # in it, without what is beside in it
    all_words: int = 0
    title: bool = False  # holds an h1


def _beside(elements: list[Element]) -> list[bool]:
    """Whether each element is in something beside the article; what holds the article is none, nor is a form or dialog around it."""
    for e in reversed(elements[1:]):
        around = elements[e.parent]
        around.words += 0 if e.beside else e.words
        around.all_words += e.all_words
        around.title |= e.title
    held = max((k for k, e in enumerate(elements) if e.article and e.words), key=lambda k: elements[k].words, default=0)
    if held:
        while held := elements[held].parent:
            if elements[held].name not in ASIDE - {"form", "dialog"}:
                elements[held].beside = False
    else:  # without a labelled article, it is where the title and most words are
        for e in elements:
            if e.title and 2 * e.all_words > elements[0].all_words and e.name not in ASIDE - {"form", "dialog"}:
                e.beside = False
    inherited: list[bool] = []
    for k, e in enumerate(elements):
        inherited.append(e.beside or k > 0 and inherited[e.parent])
    return inherited


@dataclass
class Page:
    """Scored items in page order, and the block and element each belongs to."""

    classes: list[str] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    block: list[int] = field(default_factory=list)  # of texts, else -1
    holders: list[int] = field(default_factory=list)  # elements
    beside: list[bool] = field(default_factory=list)
    label: list[bool] = field(default_factory=list)  # inside the labelled article
    texts: list[str] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


INLINE_OPEN = ("b", "i", "em", "strong", "span", "u", "a")
ITEMS = ("li", "td", "th", "tr", "dt", "dd")


def read(page: str) -> Page:
    out, number = Page(), 0
    elements, stack = [Element("", 0)], [0]
    around = [""]  # for each element on the stack, the block or link that text in it belongs to
    opened: Counter = Counter()  # names on the stack
    holders = out.holders

    def add(kind: str, count: int, block: int, text: str) -> None:
        out.classes.append(kind)
        out.counts.append(count)
        out.block.append(block)
        holders.append(stack[-1])
        out.label.append(opened[LABEL] > 0)
        out.texts.append(text)

    def pop() -> Element:
        closed = elements[stack.pop()]
        around.pop()
        opened[closed.name] -= 1
        return closed

    for what, name, attributes in tokens(page):
        if what == "text":
            top = elements[stack[-1]]
            if top.raw:
                continue
            text = html.unescape(name)
            if text:
                count = len(text.split())
                top.words += count
                top.all_words += count
                add(f"word {around[-1]}", count, number, text)
            continue
        kind = f"tag {name if name in KNOWN else 'other'}"
        if what == "open":
            if name == "body" and not opened["body"]:  # ends the head and what is open in it
                while len(stack) > 1 and elements[stack[-1]].name != "html":
                    pop()
            elif name in ("article", "main") and not opened["noscript"] and not opened["template"]:
                while elements[stack[-1]].raw:  # cannot hold it
                    pop()
            raw = elements[stack[-1]].raw
            if not raw:
                number += name in BLOCKS
                add(kind, 1, number if name == "br" else -1, " " if name == "br" else "")
            if name in VOID or attributes.endswith("/"):
                continue
            if name in BLOCKS:
                while (top := elements[stack[-1]].name) and (top == "p" or top == name and name in ITEMS or top in INLINE_OPEN and opened["p"]):
                    pop()
            named = names(attributes) if attributes else {}
            beside = name in ASIDE or name not in NEVER_BESIDE and any(not BESIDE.isdisjoint(x) for x in named.values())
            if name == "header" and opened[LABEL]:  # an article's own heading
                beside = False
            article = not raw and (name in ("article", "main") or not {"article", "main"}.isdisjoint(named.get("role", ())))
            elements.append(Element(name, stack[-1], raw or name in RAW, beside, article, title=name == "h1" and not raw))
            stack.append(len(elements) - 1)
            around.append(name if name in BLOCKS or name == "a" else around[-1])
            opened[name] += 1
        else:
            if opened[name]:
                while pop().name != name:
                    pass
            if not elements[stack[-1]].raw:
                number += name in BLOCKS
                add(kind, 1, -1, "")
    beside = _beside(elements)
    out.beside = [beside[k] for k in holders]
    out.elements = elements
    return out


def learn(inside: Counter, outside: Counter) -> dict[str, float]:
    """Weights of classes: bounded log ratios, above zero for words and below for tags."""
    total_in, total_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    weights = {}
    for name in {*inside, *outside}:
        ratio = np.log((inside[name] + 0.5) / total_in) - np.log((outside[name] + 0.5) / total_out)
        weights[name] = float(np.clip(ratio, LEAST, MOST) if name.startswith("word") else np.clip(ratio, -MOST, -LEAST))
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous items with the largest sum; the first of equal ones, and none if no sum is above zero."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, region = total, (start, k + 1)
    return region


def chosen_element(page: Page, a: int, b: int) -> list[bool]:
    """Which elements are in the one that the stretch of items a to b chooses, and not beside it; none without words."""
    elements = page.elements
    words = [0] * len(elements)  # of the stretch, in each element and those in it
    for k in range(a, b):
        if page.block[k] >= 0 and not page.beside[k]:
            words[page.holders[k]] += page.counts[k]
    for k in range(len(elements) - 1, 0, -1):
        words[elements[k].parent] += words[k]
    if not words[0]:
        return [False] * len(elements)
    articles = [k for k, e in enumerate(elements) if e.article and 2 * words[k] >= words[0]]
    root = articles[-1] if articles else max(k for k, n in enumerate(words) if n == words[0])
    while root and elements[root].name not in CONTAINERS:
        root = elements[root].parent
    whole = elements[root].name in ("", "html", "body")
    inside: list[bool] = []
    for k, e in enumerate(elements):
        there = k == root or k > 0 and inside[e.parent]
        if there and whole and not words[k] and e.name in CONTAINERS and elements[e.parent].name in ("", "html", "body"):
            there = False
        inside.append(there)
    return inside


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the element that the best region chooses, each with single spaces, joined by an empty line."""
    if not page:
        return ""
    seen = read(page)
    scores = [weights.get(c, UNSEEN[c.split()[0]]) * n for c, n in zip(seen.classes, seen.counts)]
    # Words named as something beside the article earn nothing; their tags still cost.
    scores = [min(0.0, s) if b else s for s, b in zip(scores, seen.beside)]
    inside = chosen_element(seen, *best_region(scores))
    blocks: dict[int, list[str]] = {}
    for k, block in enumerate(seen.block):
        if block >= 0 and inside[seen.holders[k]] and not seen.beside[k]:
            blocks.setdefault(block, []).append(seen.texts[k])
    lines = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n\n".join(x for x in lines if x)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        inside, outside = Counter(), Counter()
        for page in batch.column("html").to_pylist():
            seen = read(page or "")
            if any(seen.label):
                for name, n, label in zip(seen.classes, seen.counts, seen.label):
                    (inside if label else outside)[name] += n
        names = [n for n in {*inside, *outside} if n != f"tag {LABEL}"]
        yield pa.RecordBatch.from_pydict(
            {"name": pa.array(names, pa.string()), "inside": pa.array([inside[n] for n in names], pa.int64()), "outside": pa.array([outside[n] for n in names], pa.int64())}
        )


def train_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights from about ``sample`` pages that hold an ``article`` element, by the hash of their id and content."""
    ship(pages.sparkSession)
    labelled = pages.where(F.col(html_col).contains(f"<{LABEL}")).select(F.xxhash64(F.col(id_col), F.col(html_col), F.lit(3)).alias("place"), F.col(html_col).alias("html"))
    total = labelled.count()
    chosen = labelled.where(F.pmod("place", F.lit(1 << 30)) < float(1 << 30) * sample / max(1, total))
    counts = chosen.select("html").mapInArrow(_counts, "name string, inside long, outside long")
    # Elements that HTML does not know share a class, so there are at most some hundred.
    held = counts.groupBy("name").agg(F.sum("inside"), F.sum("outside")).collect()
    return learn(Counter({r[0]: r[1] for r in held}), Counter({r[0]: r[2] for r in held})) | {f"tag {LABEL}": -LEAST}


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, shared.value) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names if n != "html"} | {"text": pa.array(texts, pa.string())})

    return run


def extract_text(pages: DataFrame, weights: dict[str, float], html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of each page; empty for null, empty and textless pages.

    Character references are decoded, white space inside a block becomes one space, and blocks are joined by
    an empty line. A column ``text`` of the input is replaced. Repeated rows are read one by one.
    """
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    rows, fields, names = numbered(pages, ("text",), html=F.col(html_col))
    return rows.mapInArrow(_extract(shared), T.StructType([*fields, T.StructField("text", T.StringType())])).toDF(*names, "text")
