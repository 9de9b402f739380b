"""Elements of HTML pages, and the few selectors that extraction needs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from weftlink.sources.markup import Markup

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; that of the second set still has character references.
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
ESCAPED_TEXT = frozenset("title textarea".split())
_HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_SCOPE_END = frozenset("applet caption html table td th marquee object template button".split())
#: A start tag closes the nearest open element of the first set, unless one of the second comes before it.
_IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "table", "td", "th", "section", "article", "nav", "aside", "body"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table", "body"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table", "body"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "body"))),
    "tr": (frozenset(("tr",)), frozenset(("table", "body"))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table", "body"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table", "body"))),
    "tbody": (frozenset(("thead", "tbody", "tfoot")), frozenset(("table", "body"))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot")), frozenset(("table", "body"))),
}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements deeper than this are put beside one another, as browsers do.
DEEPEST = 512
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Element:
    __slots__ = ("tag", "attributes", "parent", "children", "depth")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.depth = parent.depth + 1 if parent is not None else 0
        self.children: list[Element | str] = []

    def descendants(self) -> Iterator[Element]:
        """All elements below, in document order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Element):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        """All text below, with nothing put between its parts."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


class _Builder:
    def __init__(self) -> None:
        self.root = Element("html", {}, None)
        self.head = Element("head", {}, self.root)
        self.body = Element("body", {}, self.root)
        self.root.children = [self.head, self.body]
        self.now: Element | None = None  # None: before the body has begun

    def text(self, data: str) -> None:
        if self.now is None:
            if not data.strip():
                return
            self.now = self.body
        self.now.children.append(data)

    def close_p(self) -> None:
        up = self.now
        while up is not None and up.tag not in _SCOPE_END:
            if up.tag == "p":
                self.now = up.parent
                return
            up = up.parent

    def start(self, tag: str, raw: str) -> Element | None:
        given = _attributes(raw) if raw else {}
        if tag in ("html", "body"):
            known = self.root if tag == "html" else self.body
            for k, v in given.items():
                known.attributes.setdefault(k, v)
            if tag == "body" and self.now is None:
                self.now = self.body
            return None
        if tag == "head":
            return None
        if self.now is None:
            if tag in _HEAD_ONLY:
                element = Element(tag, given, self.head)
                self.head.children.append(element)
                return element
            self.now = self.body
        if tag in _CLOSES_P:
            self.close_p()
            if tag in _HEADINGS and self.now.tag in _HEADINGS:
                self.now = self.now.parent
        elif tag in _IMPLIED:
            closes, stops = _IMPLIED[tag]
            up = self.now
            while up is not None and up.tag not in stops:
                if up.tag in closes:
                    self.now = up.parent
                    break
                up = up.parent
            if tag in ("li", "dd", "dt"):
                self.close_p()
        element = Element(tag, given, self.now)
        self.now.children.append(element)
        if tag not in VOID and not (raw.endswith("/") and tag in ("svg", "path", "circle", "rect", "use", "g")) and element.depth < DEEPEST:
            self.now = element
        return element

    def end(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            return
        up = self.now
        while up is not None and up is not self.body:
            if up.tag == tag or tag in _HEADINGS and up.tag in _HEADINGS:
                self.now = up.parent
                return
            if up.tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                break
            up = up.parent
        if tag == "p" and self.now is not None:
            self.now.children.append(Element("p", {}, self.now))
        elif tag == "br":
            self.start("br", "")


def parse(page: str) -> Element:
    """The html element, with a head and a body."""
    build, markup = _Builder(), Markup(page)
    at, end = 0, len(page)
    while at < end:
        found = markup.next(at)
        if found is None:
            build.text(unescape(page[at:]))
            break
        if found.start > at:
            build.text(unescape(page[at : found.start]))
        at, tag = found.end, found.name
        if tag is None:
            continue
        if found.closing:
            build.end(tag)
            continue
        element = build.start(tag, found.raw)
        if element is not None and (tag in RAW_TEXT or tag in ESCAPED_TEXT):
            stop, after = markup.raw_end(tag, at)
            data, at = page[at:stop], after
            element.children.append(unescape(data) if tag in ESCAPED_TEXT else data)
            if build.now is element:
                build.now = element.parent
        elif element is not None and element.parent is build.head and build.now is None and tag in ("noscript", "template"):
            at = markup.raw_end(tag, at)[1]
    return build.root


_PART = re.compile(r"([a-zA-Z][a-zA-Z0-9-]*|\*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]]+))\s*)?\]")


def _simple(compound: str) -> list[tuple]:
    tests, at = [], 0
    while at < len(compound):
        m = _PART.match(compound, at)
        if m is None:
            raise ValueError(f"selector {compound!r}")
        tests.append(m.groups())
        at = m.end()
    return tests


class Selector:
    """A list of selectors of tags, classes, ids and attributes, joined by descent or by '>'."""

    def __init__(self, text: str):
        self.choices = []
        for one in text.split(","):
            if not one.strip():
                raise ValueError(f"selector {text!r}")
            steps, child = [], False
            for word in re.sub(r"\s*>\s*(?![^\[]*\])", " > ", one.strip()).split(" "):
                if word == ">":
                    child = True
                elif word:
                    steps.append((child, _simple(word)))
                    child = False
            self.choices.append(steps)

    @staticmethod
    def _meets(e: Element, tests: list[tuple]) -> bool:
        for tag, cls, ident, name, how, a, b, c in tests:
            if tag is not None:
                if tag != "*" and e.tag != tag.lower():
                    return False
            elif cls is not None:
                if cls not in e.attributes.get("class", "").split():
                    return False
            elif ident is not None:
                if e.attributes.get("id") != ident:
                    return False
            else:
                value, want = e.attributes.get(name.lower()), a if a is not None else b if b is not None else c
                if value is None:
                    return False
                if how and not {"=": value == want, "~=": want in value.split(), "^=": value.startswith(want), "$=": value.endswith(want), "*=": want in value, "|=": value == want or value.startswith(f"{want}-")}[how]:
                    return False
        return True

    def matches(self, e: Element) -> bool:
        return any(self._path(e, steps, len(steps) - 1) for steps in self.choices)

    def _path(self, e: Element, steps: list, k: int) -> bool:
        if not self._meets(e, steps[k][1]):
            return False
        if k == 0:
            return True
        up = e.parent
        while up is not None:
            if self._path(up, steps, k - 1):
                return True
            if steps[k][0]:
                return False
            up = up.parent
        return False

    def all(self, root: Element) -> list[Element]:
        return [e for e in root.descendants() if self.matches(e)]

    def first(self, root: Element) -> Element | None:
        return next((e for e in root.descendants() if self.matches(e)), None)
