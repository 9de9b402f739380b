"""Where the markup of an HTML page stands. The time grows with the page's length, whatever is in it."""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

_SIGN = re.compile("[\"'>]")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))", re.S)


class Tag(NamedTuple):
    """name: in small letters, None for comments and the like; raw: the attributes as they stand."""

    start: int
    end: int
    closing: bool
    name: str | None
    raw: str


class Markup:
    """Tags of a page, one after the other. A tag ends at the first > outside quotes; what never ends is text."""

    def __init__(self, page: str):
        self.page = page
        self._signs = [m.start() for m in _SIGN.finditer(page)]
        self._dead: set[int] = set()  # quotes from which no end of a tag can be reached

    def _end(self, at: int) -> int:
        """The place after the > that ends the tag, -1 if there is none. No quote is tried twice in vain."""
        page, tried = self.page, []
        while True:
            k = bisect_left(self._signs, at)
            sign = self._signs[k] if k < len(self._signs) else -1
            if sign >= 0 and page[sign] == ">":
                return sign + 1
            other = -1 if sign < 0 or sign in self._dead else page.find(page[sign], sign + 1)
            if sign >= 0:
                tried.append(sign)
            if other < 0:
                self._dead.update(tried)
                return -1
            at = other + 1

    def next(self, at: int) -> Tag | None:
        """The first tag, comment or declaration from `at` on."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith(("<!", "<?"), start) or page.startswith("</", start) and start + 2 < len(page) and not (page[start + 2].isascii() and page[start + 2].isalpha()):
                if page.startswith("<!--", start):
                    end = _COMMENT.match(page, start).end()
                else:
                    end = page.find(">", start) + 1 or len(page)
                return Tag(start, end, False, None, "")
            first = page[start + 1 + page.startswith("</", start) : start + 2 + page.startswith("</", start)]
            end = self._end(start + 1) if first.isascii() and first.isalpha() else -1
            if end > 0:
                m = _NAME.match(page, start, end)
                return Tag(start, end, bool(m[1]), m[2].lower(), page[m.end() : end - 1])
            at = start + 1
        return None

    def raw_end(self, name: str, at: int) -> tuple[int, int]:
        """Where the text of a raw element ends that begins at `at`, and where its end tag ends; the page's end if it has none."""
        m = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(self.page, at)
        return m.span() if m else (len(self.page), len(self.page))
