"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path of element names from the root. For each path, text length
and punctuation are summed and divided by its number of blocks; the ratios are fused with themselves smoothed along the page, multiplied, and
damped by the share of linked text; a path counts as content if its score reaches a share of the score of the path with most
text, weighed by score. The content's place is the article or main element with most text of content paths or, where
there is none, the nearest element around all content paths. Of the place every block stays whose path isn't mostly
links, with headings, lists and quotations that aren't so themselves. A second article beside or inside the place stays
out unless it takes turns with others of its size.

Parts that are never content (menus, footers, scripts and the like, by element name or by class, id and role) leave before
any counting. A class name counts as a whole, or by its last word, or if its other words only say that it is a container:
``comment-list`` and ``cookie-banner`` count, ``legal-history`` does not. Names that may also stand for a wrapper (a form, a
header, a social or related section) give way if their element holds most of the page's text, and headers inside an
article belong to it.

Null and empty pages, and pages without content, give an empty text. Pages are read in linear time, whatever is left open
in them and however deep they are. Of paths of equal weight the first on the page counts. Repeated rows give repeated rows,
columns other than ``page_id``, ``url`` and ``html`` are ignored by :func:`main_text`, and a table without rows gives none.
"""

from __future__ import annotations

import heapq
import html
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.llm.markup import Tags

#: Share of the heaviest path's score from which a path counts as content.
THRESHOLD = 0.1
#: Score and weight of paths in an article or main element, times this.
ARTICLE_FACTOR = 4.0

#: Element and class names with a meaning of their own on web pages.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("aside audio button canvas datalist dialog fieldset footer form head header menu nav noscript object option select svg template video".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BETWEEN = frozenset("h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th summary address".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice newsletter subscribe subscription popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments commentlist respond reply replies discussion disqus share sharing social related recommended "
    "recommendations widget pagination pager toolbar login signup signin register skip hidden copyright legal disclaimer alert complementary contentinfo search".split()
)
#: Words of a class name that only say that the element holds something.
CONTAINERS = frozenset("area bar block body bottom box btn button buttons col column container content cta float group holder icons inner item items left link links list main module outer page panel post posts right row section site slot top unit wrap wrapper zone".split())
#: Of these names, those whose element stays if it holds most of the page's text.
WRAPPERS = frozenset("form header masthead social share sharing related recommended widget search legal copyright notice alert promotion skip login signup toolbar".split())
#: Class names that start with these tell a state of the page, not what the element is.
STATES = ("has-", "no-", "not-", "with-", "without-", "is-", "js-", "hide-", "show-", "has_", "no_", "with_", "without_", "is_")
CONTENT_ROLES = frozenset("article main articlebody".split())

_NAMED = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、؟]")


class Paths:
    """Paths of element names as numbers: a path is its parent's number and a name."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, str], int] = {}
        self.parent, self.name = [-1], [""]

    def below(self, parent: int, name: str) -> int:
        n = self.numbers.setdefault((parent, name), len(self.name))
        if n == len(self.name):
            self.parent.append(parent)
            self.name.append(name)
        return n

    def common(self, paths: set[int]) -> int:
        """The nearest path above or at all of the paths; a parent's number is less than a child's."""
        seen, left = set(paths), [-p for p in paths]
        heapq.heapify(left)
        while len(left) > 1:
            above = self.parent[-heapq.heappop(left)]
            if above not in seen:
                seen.add(above)
                heapq.heappush(left, -above)
        return -left[0]

    def under(self, above: int) -> list[bool]:
        """For every path whether it is at or below one."""
        out = [False] * len(self.name)
        out[above] = True
        for n in range(above + 1, len(out)):
            out[n] = out[self.parent[n]]
        return out

    def text(self, n: int) -> str:
        names = []
        while n:
            names.append(self.name[n])
            n = self.parent[n]
        return "/".join(reversed(names))


class Block:
    __slots__ = ("path", "element", "parts", "linked", "places", "wrappers")

    def __init__(self, path: int, element: int, places: tuple[int, ...], wrappers: tuple[int, ...]):
        self.path, self.element, self.places, self.wrappers, self.parts, self.linked = path, element, places, wrappers, [], 0


class Element(NamedTuple):
    name: str
    never: bool
    path: int
    element: int
    #: Numbers of the article and main elements around its content, and of those that count only if they hold most of the text.
    places: tuple[int, ...]
    wrappers: tuple[int, ...]


def boilerplate(name: str) -> str | None:
    """The word that makes a class name one of what is never content, if there is one."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    telling = [w for w in words if w in BOILERPLATE]
    if telling and (words[-1] in BOILERPLATE and len(words) < 4 or all(w in BOILERPLATE or w in CONTAINERS for w in words)):
        return telling[-1]
    return None


def described(attributes: str) -> set[str]:
    """The names of an element's class, id, role and property, without those of states; of boilerplate, the telling word."""
    names = (n.lower() for g in _NAMED.findall(attributes) for n in "".join(g).split())
    return {boilerplate(n) or n for n in names if not n.startswith(STATES)}


def blocks(page: str) -> tuple[list[tuple[int, tuple[int, ...], str, int, int]], Paths, Paths]:
    """(path, numbers of the enclosing article and main elements, text, linked characters, element) in page order, the paths,
    and the elements as a tree of their own."""
    paths, elements, tags = Paths(), Paths(), Tags(page)
    top = Element("", False, 0, 0, (), ())
    stack: list[Element] = []
    open_names: dict[str, int] = {}
    out: list[Block] = []
    block: Block | None = None
    links = skipped = number = 0

    def pop_to(k: int) -> None:
        nonlocal skipped
        while len(stack) > k:
            e = stack.pop()
            skipped -= e.never
            open_names[e.name] -= 1

    def text(s: str) -> None:
        nonlocal block
        if s and not skipped:
            if block is None:
                if s.isspace():
                    return
                e = stack[-1] if stack else top
                block = Block(e.path, e.element, e.places, e.wrappers)
                out.append(block)
            s = html.unescape(s) if "&" in s else s
            block.parts.append(s)
            if links:
                block.linked += len(s)

    at, size = 0, len(page)
    while tag := tags.next(at):
        text(page[at : tag.start])
        at, name = tag.end, tag.name
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if tag.closing else 1))
            continue
        block = None
        if tag.closing:
            if open_names.get(name):
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name)
                pop_to(k)
                links = 0
            continue
        if name in RAW:
            at = tags.raw_end(name, at) or size
            continue
        if name in VOID:
            continue
        if name == "body" and open_names.get("head"):
            pop_to(next(k for k, s in enumerate(stack) if s.name == "head"))
        if name in CLOSES_P and open_names.get("p"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == "p":
                    pop_to(k)
                    break
                if stack[k].name in ("td", "th", "button", "body", "table"):
                    break
        closes = SIBLINGS.get(name, ())
        if any(open_names.get(c) for c in closes):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in closes:
                    pop_to(k)
                    if name != "tr":
                        break
                elif stack[k].name in ("ul", "ol", "dl", "table", "tbody", "thead", "div", "body", "select"):
                    break
        around = stack[-1] if stack else top
        plain = name in ("html", "body")
        given = described(tag.attributes) if tag.attributes and not plain else set()
        told = (given & BOILERPLATE | {name} & NEVER) - ({"header"} if around.places else set())
        hidden = bool(not plain and tag.attributes and _HIDDEN.search(tag.attributes))
        number += 1
        never = hidden or bool(told - WRAPPERS)
        is_place = name in ("article", "main") or bool(given & CONTENT_ROLES)
        stack.append(Element(name, never, paths.below(around.path, name), elements.below(around.element, str(number)), (*around.places, number) if is_place else around.places, (*around.wrappers, number) if told and not never else around.wrappers))
        open_names[name] = open_names.get(name, 0) + 1
        skipped += never
    text(page[at:])
    texts = [" ".join("".join(b.parts).split()) for b in out]
    held: dict[int, int] = {}
    for b, t in zip(out, texts, strict=True):
        for w in b.wrappers:
            held[w] = held.get(w, 0) + len(t)
    most = sum(map(len, texts)) / 2
    return [(b.path, b.places, t, min(b.linked, len(t)), b.element) for b, t in zip(out, texts, strict=True) if t and all(held[w] > most for w in b.wrappers)], paths, elements


def _fused(values: list[float]) -> list[float]:
    """Geometric means of each value with the one smoothed along the page, so that a short block beside long ones stays weak."""
    last = len(values) - 1
    return [(v * (0.25 * values[max(0, k - 1)] + 0.5 * v + 0.25 * values[min(last, k + 1)])) ** 0.5 for k, v in enumerate(values)]


def path_sums(found: list[tuple[int, tuple[int, ...], str, int, int]]) -> dict[int, list[int]]:
    """Of each path the number of blocks, characters, punctuation marks and linked characters."""
    sums: dict[int, list[int]] = {}
    for path, _, t, linked, _ in found:
        s = sums.setdefault(path, [0, 0, 0, 0])
        for k, v in enumerate((1, len(t), len(_PUNCTUATION.findall(t)), linked)):
            s[k] += v
    return sums


def path_scores(found: list[tuple[int, tuple[int, ...], str, int, int]]) -> dict[int, float]:
    """The fused ratios of each path, a mean over its blocks."""
    sums = path_sums(found)
    length = _fused([sums[p][1] / sums[p][0] for p, *_ in found])
    marks = _fused([1 + sums[p][2] / sums[p][0] for p, *_ in found])
    scores: dict[int, float] = {}
    for (path, places, *_), a, b in zip(found, length, marks, strict=True):
        n, chars, _, linked = sums[path]
        scores[path] = scores.get(path, 0) + a * b / n * (1 - linked / chars) * (ARTICLE_FACTOR if places else 1)
    return scores


def extract(page: str | None, threshold: float = THRESHOLD) -> str:
    """The main text: blocks in page order, joined by one space."""
    found, paths, elements = blocks(page) if page else ([], Paths(), Paths())
    if not found:
        return ""
    scores, sums = path_scores(found), path_sums(found)
    placed = {b[0] for b in found if b[1]}
    best = max(scores, key=lambda p: (scores[p] * sums[p][1] * (ARTICLE_FACTOR if p in placed else 1), -p))
    if scores[best] <= 0:
        return ""
    content = {p for p in scores if scores[p] >= threshold * scores[best]}
    if any(b[1] for b in found if b[0] == best):
        inside = [b for b in found if b[1]]
        depth = 0
        while held := _held(inside, content, depth):
            place = max(held, key=lambda p: (held[p], -p))
            if depth and 2 * held[place] <= sum(len(b[2]) for b in inside if b[0] in content):
                break
            inside = [b for b in inside if len(b[1]) > depth and b[1][depth] == place]
            depth += 1
    else:
        around = {max(0, elements.parent[b[4]]) for b in found if b[0] in content}
        under = elements.under(elements.common(around))
        inside = [b for b in found if under[b[4]]]
    own = path_sums(inside)
    mostly_links = {p for p, (_, chars, _, linked) in own.items() if 2 * linked > chars}
    return " ".join(t for path, _, t, linked, _ in inside if path not in mostly_links or paths.name[path] in BETWEEN and 2 * linked <= len(t))


def _held(inside: list[tuple[int, tuple[int, ...], str, int, int]], content: set[int], depth: int) -> dict[int, int]:
    """Characters of content paths in each article or main element at this depth."""
    held: dict[int, int] = {}
    for path, places, t, *_ in inside:
        if len(places) > depth and path in content:
            held[places[depth]] = held.get(places[depth], 0) + len(t)
    return held


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each page."""

    @F.pandas_udf("string")
    def texts(htmls: pd.Series) -> pd.Series:
        return pd.Series([extract(h) for h in htmls], dtype=object)

    return pages.select("page_id", "url", texts("html").alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

