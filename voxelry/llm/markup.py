"""Reading tags of a page in linear time, whatever is left open in it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_NAME = re.compile(r"[A-Za-z][^\s/>]*")


class Tag(NamedTuple):
    start: int
    end: int
    #: Lower-cased; empty for comments and declarations.
    name: str
    closing: bool
    attributes: str


class Finder:
    """``find`` from places that mostly go forwards: what was found, or not found, is remembered."""

    def __init__(self, page: str):
        self.page, self.size, self.known = page, len(page), {}

    def __call__(self, what: str, at: int) -> int:
        """The next place of ``what`` from ``at`` on, or the page's size."""
        low, found = self.known.get(what, (1, 0))
        if not low <= at <= found:
            found = self.page.find(what, at)
            found = self.size if found < 0 else found
            self.known[what] = at, found
        return found


class Tags:
    """The tags of a page, one after the other: :meth:`next` gives the first one at or after a place."""

    def __init__(self, page: str):
        self.page, self.size, self.find = page, len(page), Finder(page)
        #: Places outside quotes from which no tag ends.
        self.endless: set[int] = set()

    def _end(self, at: int) -> int | None:
        """The end of a tag, not counting signs in quotes, from a place outside quotes."""
        seen = []
        while at < self.size and at not in self.endless:
            seen.append(at)
            gt = self.find(">", at)
            quote = min(self.find('"', at), self.find("'", at))
            if gt < quote:
                return gt
            if quote == self.size:
                break
            close = self.find(self.page[quote], quote + 1)
            if close == self.size:
                break
            at = close + 1
        self.endless.update(seen)
        return None

    def next(self, at: int) -> Tag | None:
        while (lt := self.find("<", at)) < self.size:
            after = self.page[lt + 1 : lt + 2]
            if self.page.startswith("<!--", lt):
                return Tag(lt, min(self.find("-->", lt + 4) + 3, self.size), "", False, "")
            gt = self.find(">", lt)
            if gt == self.size:
                return None
            if after in ("!", "?") or after == "/" and not self.page[lt + 2 : lt + 3].isalpha():
                return Tag(lt, gt + 1, "", False, "")
            name = _NAME.match(self.page, lt + 1 + (after == "/"), gt)
            if name:
                end = self._end(name.end())
                end = gt if end is None else end
                return Tag(lt, end + 1, name[0].lower(), after == "/", self.page[name.end() : end])
            at = lt + 1
        return None

    def raw_end(self, name: str, at: int) -> int | None:
        """Where the content of a script or the like ends, after its closing tag, if it has one."""
        key = f"</{name}"
        low, found, end = self.find.known.get(key, (1, 0, None))
        if not low <= at <= found:
            m = re.compile(rf"</{name}\b[^>]*>?", re.I).search(self.page, at)
            found, end = (m.start(), m.end()) if m else (self.size, None)
            self.find.known[key] = at, found, end
        return end


def without_markup(page: str) -> Iterator[str]:
    """The text between tags, without scripts and styles that have an end."""
    tags, at = Tags(page), 0
    while tag := tags.next(at):
        yield page[at : tag.start]
        at = tag.end
        if tag.name in ("script", "style") and not tag.closing:
            at = tags.raw_end(tag.name, at) or at
    yield page[at:]
