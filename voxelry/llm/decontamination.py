"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as sequences of lower-case words. An item of n words may differ from a passage by
k = 15 % of n word edits. Cut into k + 1 pieces, one piece must then stand in the passage unchanged; one Aho-Corasick
automaton finds the pieces of all items in a text at once, and around each hit Myers' bit-parallel algorithm gives the
smallest edit distance between the item and any run of words there.

Items without words match nothing. Items are handled in slices of bounded size, each broadcast to one pass over the
documents, so their number is not limited. Null texts count as empty; repeated documents give repeated rows; items
that repeat are matched each under its own id, and items without an id are left out; a document's null id stays null.
Other columns are ignored by :func:`find_items` and kept by :func:`remove_contaminated`; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_SHARE = 15
#: Items broadcast at once: at most so many, and so many characters for each on average.
SLICE_ITEMS, SLICE_CHARS = 20_000, 20_000_000
SCHEMA = "doc_id long, item_id long, distance long, item_words long, last_word long"
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def budget(n_words: int, share: int = ERROR_SHARE) -> int:
    return n_words * share // 100


def pieces(words: list[str], k: int) -> Iterator[tuple[int, list[str]]]:
    """(first word, words) of k + 1 pieces whose lengths differ by one at most."""
    n = len(words)
    for p in range(k + 1):
        a, b = p * n // (k + 1), (p + 1) * n // (k + 1)
        yield a, words[a:b]


class Pattern:
    """An item's words as bit masks for Myers' algorithm; Python's integers carry any length."""

    def __init__(self, words: list[str]):
        self.n, self.masks = len(words), {}
        for k, w in enumerate(words):
            self.masks[w] = self.masks.get(w, 0) | 1 << k

    def best(self, text: list[str]) -> tuple[int, int]:
        """The smallest distance to a run of words of ``text``, and the index after the first such run's end."""
        full, top = (1 << self.n) - 1, 1 << (self.n - 1)
        plus, minus, score = full, 0, self.n
        best, end = self.n, 0
        for j, w in enumerate(text):
            eq = self.masks.get(w, 0)
            across = (((eq & plus) + plus) ^ plus) | eq | minus
            up, down = (minus | ~(across | plus)) & full, plus & across
            score += bool(up & top) - bool(down & top)
            if score < best:
                best, end = score, j + 1
            up, down = up << 1 & full, down << 1 & full
            steep = eq | minus
            plus, minus = (down | ~(steep | up)) & full, up & steep
        return best, end


def matcher(items: list[tuple[int, str]], share: int = ERROR_SHARE):
    """A function that gives (item, distance, words of the item, last word's index) for each item found in a text."""
    import ahocorasick

    patterns, found_in = [], {}
    for item_id, text in items:
        words = words_of(text)
        if not words:
            continue
        k = budget(len(words), share)
        for first, piece in pieces(words, k):
            found_in.setdefault(f" {' '.join(piece)} ", []).append((len(patterns), first))
        patterns.append((item_id, Pattern(words), k))
    automaton = ahocorasick.Automaton()
    for piece, at in found_in.items():
        automaton.add_word(piece, (piece.count(" ") - 1, at))
    if found_in:
        automaton.make_automaton()

    def search(text: str | None) -> list[tuple[int, int, int, int]]:
        words = words_of(text)
        if not words or not found_in:
            return []
        line = f" {' '.join(words)} "
        windows: dict[int, set[tuple[int, int]]] = {}
        counted, number = 0, -1
        for end, (length, at) in automaton.iter(line):
            number += line.count(" ", counted, end + 1)
            counted = end + 1
            for which, first in at:
                _, pattern, k = patterns[which]
                start = number - length - first - k
                windows.setdefault(which, set()).add((start, start + pattern.n + 2 * k))
        out = []
        for which, spans in windows.items():
            item_id, pattern, k = patterns[which]
            best = (k + 1, 0)
            lo, hi = None, None
            for a, b in [*sorted(spans), (1 << 62, 1 << 62)]:
                if lo is not None and a <= hi:
                    hi = max(hi, b)
                    continue
                if lo is not None:
                    d, end = pattern.best(words[max(0, lo) : max(0, hi)])
                    best = min(best, (d, max(0, lo) + end - 1))
                lo, hi = a, b
            if best[0] <= k:
                out.append((item_id, best[0], pattern.n, best[1]))
        return out

    return search


def _slices(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in slices of at most ``SLICE_ITEMS`` items on average and a bounded number of characters."""
    n, chars = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    parts = max(1, -(-n // SLICE_ITEMS), -(-chars // SLICE_CHARS))
    for k in range(parts):
        part = benchmark.where(F.pmod(F.xxhash64(item), F.lit(parts)) == k) if parts > 1 else benchmark
        yield [(r[0], r[1]) for r in part.select(item, text).collect() if r[0] is not None]


def find_items(docs: DataFrame, benchmark: DataFrame, share: int = ERROR_SHARE, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and item that it holds, with the smallest distance: ``SCHEMA``."""
    columns = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]

    def one(items: list[tuple[int, str]]) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = matcher(items, share)
            for batch in batches:
                rows = [(d.as_py(), *hit) for d, t in zip(batch.column(0), batch.column(1), strict=True) for hit in search(t.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], columns)

        return docs.select(F.col(doc).cast("long"), text).mapInArrow(work, SCHEMA)

    return reduce(DataFrame.unionByName, (one(items) for items in _slices(benchmark, "item_id", "text")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, share: int = ERROR_SHARE) -> DataFrame:
    """``docs`` without those that hold an item, in one pass and with all columns; null texts stay."""
    kept = docs
    for items in _slices(benchmark, "item_id", "text"):
        kept = kept.where(~_holds(items, share)(F.col("text")))
    return kept


def _holds(items: list[tuple[int, str]], share: int):
    cached = {}

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        if "search" not in cached:
            cached["search"] = matcher(items, share)
        return pd.Series([bool(cached["search"](t)) for t in texts], dtype=bool)

    return holds
