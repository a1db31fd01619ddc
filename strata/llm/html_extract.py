"""Main text of HTML pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks: runs of text between block-level
tags, with character references decoded and white space collapsed.  Each block
has shallow features: its word count and link density, those of the blocks
before and after it, whether it is a heading or ends like a sentence, and
whether the element around it is named as the article or as a kind of
boilerplate.  A decision tree tells text from boilerplate.  It is trained on a
small labelled table: the blocks of pages that :func:`labelled_pages` makes from
page shapes, half of them without an element or a name for the article.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.shared import packed, plain, table

#: Elements whose content is never text.
_SKIP = frozenset("script style noscript template svg math iframe object canvas head title select option button textarea audio video".split())
#: Elements that start and end a block.
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a head can have; any other one ends it, as does text.
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BAD_ELEMENTS = frozenset("nav footer aside form menu dialog".split())
#: Words in a class, id or role that name boilerplate.
_BAD_NAMES = frozenset(
    "ad ads adbox advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus feedback foot footer form gdpr head header links login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget contentinfo complementary alert".split()
)
_GOOD_NAMES = frozenset("article articlebody content entry post story maincontent".split())
#: Every alternative ends at the end of the page at the latest, so no part of a page is scanned twice.  Quotes count after an equals sign only.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"'=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[\"'=])*)(?:>|\Z)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    bad: bool
    good: bool

    @property
    def stop(self) -> bool:
        return self.text[-1] in ".!?:;…。”\"'"


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _kinds(attributes: dict[str, str]) -> tuple[bool, bool]:
    """Whether a class, id or role names boilerplate, and whether one names the article.

    A compound name such as ``no-sidebar`` or ``post-comments`` is boilerplate
    only if all its parts are, and else is left to the tree.
    """
    bad = good = False
    for value in (attributes.get("class"), attributes.get("id"), attributes.get("role")):
        for word in (value or "").split():
            parts = [x.lower() for x in _PART.findall(word)]
            of_bad = sum(x in _BAD_NAMES for x in parts)
            bad = bad or word.lower() in _BAD_NAMES or 0 < of_bad == len(parts)
            good = good or word.lower() in _GOOD_NAMES or (not of_bad and any(x in _GOOD_NAMES for x in parts))
    return bad, good


def _is_hidden(attributes: dict[str, str]) -> bool:
    return attributes.get("hidden", "false").strip().lower() != "false" or bool(_HIDDEN.search(attributes.get("style", "")))


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, in time linear in the page; markup that is not closed ends with the page.

    White space is what Unicode calls so, the no-break space included.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, boilerplate, article, skipped
    bad = good = skip = False
    open_: dict[str, int] = {}  # elements on the stack by name, so that stray end tags cost nothing
    link = heading = 0
    parts: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, text.count(" ") + 1, min(linked, text.count(" ") + 1), heading > 0, bad, good))
        parts.clear()
        linked = 0

    def leave(depth: int) -> None:
        nonlocal bad, good, skip
        for gone, *_ in stack[depth:]:
            open_[gone] -= 1
        del stack[depth:]
        bad, good, skip = stack[-1][1:] if stack else (False, False, False)

    def put(raw: str) -> None:
        nonlocal linked
        if raw and stack and stack[-1][0] == "head" and not raw.isspace():
            leave(len(stack) - 1)
        if raw and not skip:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link:
                linked += len(text.split())

    at = 0
    for m in _TOKEN.finditer(page):
        put(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name, closing = name.lower(), bool(m[2])
        if name in _BLOCK:
            end()
        if not closing and name not in _HEAD and stack and stack[-1][0] == "head":
            leave(len(stack) - 1)
        if name == "br" or name in ("td", "th"):
            parts.append(" ")
        if name == "a":
            link = 0 if closing else 1
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            heading = 0 if closing else 1
        if name not in _BLOCK and name not in _SKIP and name != "span" or name in _VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1) if open_.get(name) else ():
                if stack[k][0] == name:
                    leave(k)
                    break
        elif not m[4].rstrip().endswith("/"):
            if name in ("p", "li") and stack and stack[-1][0] == name:
                leave(len(stack) - 1)
            attributes = _attributes(m[4]) if m[4] else {}
            named_bad, named_good = _kinds(attributes) if attributes else (False, False)
            body, article = name in ("body", "html"), name in ("article", "main")
            is_good = article or (not body and named_good)
            is_bad = not body and (name in _BAD_ELEMENTS or (name == "header" and not good) or named_bad)
            # An article inside of boilerplate is one, unless it is itself named as boilerplate.
            bad = is_bad or (bad and not article)
            good = (good or is_good) and not bad
            skip = skip or name in _SKIP or (bool(attributes) and _is_hidden(attributes))
            stack.append((name, bad, good, skip))
            open_[name] = open_.get(name, 0) + 1
    put(page[at:])
    end()
    return out


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "boilerplate", "article", "stop")
#: Features of the neighbouring blocks.
NEIGHBOURS = frozenset((2, 3, 4, 5))


def features(found: list[Block]) -> np.ndarray:
    words = np.array([b.words for b in found], dtype=float)
    density = np.array([b.linked for b in found], dtype=float) / np.maximum(words, 1)
    flags = np.array([(b.heading, b.bad, b.good, b.stop) for b in found], dtype=float).reshape(-1, 4)
    shift = lambda v, k: np.concatenate([[0.0], v[:-1]]) if k < 0 else np.concatenate([v[1:], [0.0]])
    return np.column_stack([words, density, shift(words, -1), shift(density, -1), shift(words, 1), shift(density, 1), flags])


class _Page:
    """A labelled page in the making: markup, and a label for each block, 1 for text."""

    def __init__(self, seed: int):
        self.rnd, self.markup, self.labels = random.Random(seed), [], []

    def say(self, low: int, high: int, stop: str = "") -> str:
        return " ".join("word" for _ in range(self.rnd.randint(low, high))) + stop

    def put(self, label: int, before: str, text: str, after: str = "") -> None:
        self.markup += [before, text, after]
        self.labels.append(label)

    def raw(self, markup: str) -> None:
        self.markup.append(markup)

    def link(self, low: int = 1, high: int = 3) -> str:
        return f"<a href='/x'>{self.say(low, high)}</a>"

    def menu(self, tag: str = "div", item: str = "div", name: str = "") -> None:
        self.raw(f"<{tag}{name}>")
        for _ in range(self.rnd.randint(2, 6)):
            self.put(0, f"<{item}>", self.link(), f"</{item}>")
        self.raw(f"</{tag}>")

    def small_print(self, tag: str = "div") -> None:
        """Short lines without links at the top or the end of a page, by a block of links."""
        for _ in range(self.rnd.randint(1, 3)):
            self.put(0, f"<{tag}>", self.say(1, 6), f"</{tag}>")
        self.put(0, f"<{tag}>", " ".join(self.link() for _ in range(3)), f"</{tag}>")

    def text(self, tag: str = "p", low: int = 18, high: int = 80, short: float = 0.2, rich: float = 0.15) -> None:
        """Paragraphs, with headings, short ones, and some with links between long ones."""
        if self.rnd.random() < 0.8:
            self.put(1, "<h1>", self.say(3, 9), "</h1>")
        for k in range(self.rnd.randint(3, 8)):
            if k and self.rnd.random() < short:
                self.put(1, f"<{tag}>", self.say(1, 7, self.rnd.choice((".", "!", "?", ""))), f"</{tag}>")
            if k and self.rnd.random() < 0.15:
                self.put(1, "<h2>", self.say(1, 5), "</h2>")
            links = f" {self.link(2, 5)}" if self.rnd.random() < rich else ""
            self.put(1, f"<{tag}>", self.say(low, high, ".") + links, f"</{tag}>")


def _soup(p: _Page) -> None:
    p.menu()
    p.raw("<div>")
    p.text(tag=p.rnd.choice(("p", "div")))
    p.raw("</div>")
    p.small_print()


def _bare(p: _Page) -> None:
    p.text()


def _table(p: _Page) -> None:
    p.raw("<table><tr><td>")
    p.menu("table", "tr")
    p.raw("</td><td>")
    p.text()
    p.raw("</td></tr></table>")
    p.small_print("p")


def _related(p: _Page) -> None:
    p.small_print()
    p.text(short=0.4)
    p.put(0, "<h3>", p.say(1, 3), "</h3>")
    for _ in range(p.rnd.randint(3, 6)):
        p.put(0, "<div>", p.link(4, 14), "</div>")
    p.small_print("p")


def _teasers(p: _Page) -> None:
    p.menu("ul", "li")
    p.text(rich=0.4)
    for _ in range(p.rnd.randint(2, 4)):
        p.put(0, "<h4>", p.link(3, 9), "</h4>")
        p.put(0, "<div>", p.say(4, 9), "</div>")
    p.menu("ul", "li")


def _article(p: _Page) -> None:
    p.menu("nav", "li")
    p.put(0, "<div class='ad'>", p.say(4, 20, "."), "</div>")
    p.raw("<article>")
    p.text(low=1, high=60)
    p.put(1, "<ul><li>", p.link(), "</ul>")
    p.raw("</article>")
    p.put(0, "<footer>", p.say(5, 40, "."), "</footer>")


def _main(p: _Page) -> None:
    p.put(0, "<header>", p.link(), "</header>")
    p.raw("<main>")
    p.text(low=2, high=50)
    p.put(0, "<aside>", p.say(5, 30, "."), "</aside>")
    p.raw("</main>")
    p.put(0, "<div class='comments'><p>", p.say(10, 60, "."), "</p></div>")


def _named(p: _Page) -> None:
    p.put(0, "<div id='cookie-notice'>", p.say(15, 50, "."), "</div>")
    p.menu(name=" class='sidebar'")
    p.raw("<div class='entry-content'>")
    p.text(low=2, high=50)
    p.raw("</div>")
    p.put(0, "<form>", p.say(3, 12), "</form>")
    p.put(0, "<div class='footer'>", p.say(10, 40, "."), "</div>")


#: Page shapes; every second one names the article.
SHAPES = (_soup, _article, _bare, _main, _table, _named, _related, _article, _teasers, _main)


def labelled_pages(variants: int = 8, seed: int = 1) -> list[tuple[str, list[int]]]:
    """(markup, labels of its blocks) of ``variants`` pages of each shape."""
    out = []
    for k in range(variants):
        for i, shape in enumerate(SHAPES):
            page = _Page(seed * 10_007 + 101 * k + i)
            shape(page)
            out.append(("<body>" + "".join(page.markup), page.labels))
    return out


@lru_cache
def training_rows(variants: int = 8, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    pages = labelled_pages(variants, seed)
    return np.concatenate([features(blocks(markup)) for markup, _ in pages]), np.array([x for _, labels in pages for x in labels])


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 7):
    """A decision tree by Gini impurity: a label, or (feature, threshold, left, right).

    Equal splits go to the first feature and the lowest threshold.
    """
    if depth == 0 or len(set(y.tolist())) == 1:
        return int(y.mean() >= 0.5)
    best = None
    for f in [7, 8, 6, 9, *range(6)]:
        values = np.unique(x[:, f])
        for t in ((values[1:] + values[:-1]) / 2).tolist():
            left = x[:, f] <= t
            cost = sum(p.sum() * 2 * (q := y[p].mean()) * (1 - q) for p in (left, ~left))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, t)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t = best
    left = x[:, f] <= t
    return (f, t, fit_tree(x[left], y[left], depth - 1), fit_tree(x[~left], y[~left], depth - 1))


def used_features(tree) -> set[int]:
    return set() if isinstance(tree, int) else {tree[0]} | used_features(tree[2]) | used_features(tree[3])


def classify(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), tree, dtype=bool)
    f, t, left, right = tree
    return np.where(x[:, f] <= t, classify(left, x), classify(right, x)).astype(bool)


def main_text(page: str | None, tree) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, classify(tree, features(found)).tolist()) if keep)


def _extract(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py(), tree) for p in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def extract_text(pages: DataFrame, html_col: str = "html", training: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``pages`` with the column of HTML replaced by ``text``, the main text.

    Blocks are joined by one line break.  A null or empty page, or one without
    text, gives an empty string.  A column named ``text`` is replaced.
    ``training`` is a labelled table (features, labels) in place of the own one.
    """
    tree = fit_tree(*(training or training_rows()))
    rows = pages.select(packed(pages, html_col, "text").alias("row"), plain(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(_extract(tree), f"row {rows.schema['row'].dataType.simpleString()}, text string")
    others = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(pages.columns) if c not in (html_col, "text")]
    return out.select(*others, "text")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op2_html_text": op2_html_text}
ORACLES: dict[str, str] = {}
