"""The main text, headings, description and links of HTML pages.

This is the one step that needs Python: it walks element trees. It takes a batch of pages at a time and returns plain
columns; everything after it is expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftlink.functions import lexicon
from weftlink.functions.text import SPACE
from weftlink.settings import CORE, Settings
from weftlink.sources.dom import Element, Selector, parse

MOST_PARAGRAPHS = 80
ZONE_WORDS = 50
_SPACE = re.compile(f"[{SPACE}]+", re.A)
_BLOCKS = frozenset("p div li ul ol blockquote h1 h2 h3 h4 h5 h6 table pre section article aside main figure".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_HEADING = re.compile("|".join(f"(?:{p})" for p in lexicon.BOILERPLATE_HEADINGS), re.I | re.A)
_TEXT = re.compile("|".join(f"(?:{p})" for p in lexicon.BOILERPLATE_TEXTS), re.I | re.A)
_BYLINE = re.compile(lexicon.BYLINE)
_WORDS = frozenset(lexicon.BOILERPLATE_WORDS)
_PART = re.compile("|".join(map(re.escape, lexicon.BOILERPLATE_PARTS)))
_NOISE = [Selector(",".join([*lexicon.NOISE_TAGS, *(f'[role="{r}"]' for r in lexicon.NOISE_ROLES)]))]
_INNER = Selector(",".join(lexicon.INNER_NOISE))
_ZONES = [(Selector(s), name, trust) for s, name, trust in lexicon.ZONES]
_DESCRIPTION, _SHARED = Selector('meta[name="description"]'), Selector('meta[property="og:description"]')
_ROBOTS, _CANONICAL, _TITLE, _H1, _BODY = Selector('meta[name="robots"]'), Selector('link[rel="canonical"]'), Selector("title"), Selector("h1"), Selector("body")

EXTRACT = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("meta_desc", T.StringType()),
        T.StructField("h1", T.StringType()),
        T.StructField("headings", T.ArrayType(T.StructType([T.StructField("level", T.StringType()), T.StructField("text", T.StringType())]))),
        T.StructField("paragraphs", T.ArrayType(T.StringType())),
        T.StructField("paragraph_positions", T.ArrayType(T.DoubleType())),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("raw_links", T.ArrayType(T.StringType())),
        T.StructField("extraction_method", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("robots", T.StringType()),
        T.StructField("canonical", T.StringType()),
    ]
)
_ARROW = pa.struct(
    [
        ("title", pa.string()),
        ("meta_desc", pa.string()),
        ("h1", pa.string()),
        ("headings", pa.list_(pa.struct([("level", pa.string()), ("text", pa.string())]))),
        ("paragraphs", pa.list_(pa.string())),
        ("paragraph_positions", pa.list_(pa.float64())),
        ("links", pa.list_(pa.string())),
        ("raw_links", pa.list_(pa.string())),
        ("extraction_method", pa.string()),
        ("confidence", pa.float64()),
        ("robots", pa.string()),
        ("canonical", pa.string()),
    ]
)


def squeeze(text: str) -> str:
    """White space as single blanks, none at the ends."""
    return _SPACE.sub(" ", text).strip(" ")


def is_boilerplate_heading(text: str | None) -> bool:
    return bool(text) and len(text) >= 3 and bool(_HEADING.search(squeeze(text)))


def is_boilerplate_text(text: str) -> bool:
    return bool(_TEXT.search(text) or _BYLINE.search(text))


def is_boilerplate_element(e: Element) -> bool:
    names = " ".join(e.attributes.get(k, "") for k in ("class", "id", "aria-label")).lower()
    return len(names) > 2 and bool(_PART.search(names) or not _WORDS.isdisjoint(re.split(r"[\s\-_/]+", names)))


def position(i: int, n: int) -> float:
    """i of n as a share from 0 to 1, to three places of its exact value."""
    return 0.0 if n <= 1 else float(Decimal(i / (n - 1)).quantize(Decimal("0.001"), ROUND_HALF_UP))


def _section_decides(e: Element, zone: Element) -> bool:
    """Whether the nearest heading before e, among its siblings or those of its ancestors, opens a section that is not the page's own."""
    for _ in range(8):
        if e is zone or e.parent is None:
            return False
        before = None
        for sibling in e.parent.children:
            if sibling is e:
                break
            if isinstance(sibling, Element) and sibling.tag in _HEADINGS:
                before = sibling
        if before is not None:
            return is_boilerplate_heading(squeeze(before.text()))
        e = e.parent
    return False


def _utf16(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


def _links(root: Element, url: str) -> list[str]:
    out = []
    for e in root.descendants():
        href = e.attributes.get("href") if e.tag == "a" else None
        if href and not href.startswith(("#", "mailto:", "tel:")):
            try:
                out.append(urljoin(url, href.strip()))
            except ValueError:
                continue
    return out


def _paragraphs(zone: Element, least_words: int) -> list[str]:
    flagged: dict[int, bool] = {}

    def inside(e: Element) -> bool:
        up = e.parent
        while up is not None and up is not zone and up.tag not in ("body", "html"):
            if flagged.setdefault(id(up), is_boilerplate_element(up)):
                return True
            up = up.parent
        return False

    out: dict[str, None] = {}
    for e in zone.descendants():
        if e.tag not in ("p", "li", "div") or e.tag == "div" and any(c.tag in _BLOCKS for c in e.elements()):
            continue
        if inside(e) or _section_decides(e, zone):
            continue
        text = squeeze(e.text())
        if len(text.split(" ")) >= least_words and text not in out and not is_boilerplate_text(text):
            out[text] = None
    return list(out)


def extract(url: str, page: str, settings: Settings = CORE) -> dict:
    """A page's record. Titles are read before anything is removed, links after; raw_links are those before."""
    root = parse(page)

    def attribute(selector: Selector, name: str) -> str | None:
        found = selector.first(root)
        return None if found is None else found.attributes.get(name)

    h1 = _H1.first(root)
    out = {
        "title": squeeze("".join(t.text() for t in _TITLE.all(root))),
        "h1": squeeze(h1.text()) if h1 is not None else "",
        "meta_desc": attribute(_DESCRIPTION, "content") or attribute(_SHARED, "content") or "",
        "robots": (attribute(_ROBOTS, "content") or "").lower(),
        "canonical": attribute(_CANONICAL, "href") or None,
        "raw_links": _links(root, url),
    }
    gone = list(_NOISE)
    if settings.exclude_selectors:
        try:
            gone.append(Selector(settings.exclude_selectors.replace("\n", ",")))
        except ValueError:
            pass  # a selector that cannot be read removes nothing
    for selector in gone:
        for e in selector.all(root):
            e.remove()
    zone = None
    if settings.include_selectors:
        zone, method, trust = Selector(settings.include_selectors.split("\n")[0].strip()).first(root), "user-override", 0.99
    if zone is None:
        for selector, method, trust in _ZONES:
            zone = selector.first(root)
            if zone is not None and len(squeeze(zone.text()).split(" ")) >= ZONE_WORDS:
                break
        else:
            (_, method, trust), zone = lexicon.LAST_ZONE, _BODY.first(root)
    for e in list(zone.descendants()):
        if is_boilerplate_element(e):
            e.remove()
    for e in _INNER.all(zone):
        e.remove()
    texts = _paragraphs(zone, settings.min_paragraph_words)
    headings = [(e.tag.upper(), squeeze(e.text())) for e in zone.descendants() if e.tag in ("h1", "h2", "h3", "h4")]
    return out | {
        "headings": [{"level": level, "text": t} for level, t in headings if 2 < _utf16(t) < 300],
        "paragraphs": texts[:MOST_PARAGRAPHS],
        "paragraph_positions": [position(i, len(texts)) for i in range(min(len(texts), MOST_PARAGRAPHS))],
        "links": _links(root, url),
        "extraction_method": method,
        "confidence": trust,
    }


def with_extract(pages: DataFrame, settings: Settings = CORE, url: str = "url", html: str = "html") -> DataFrame:
    """pages with a struct column `extract`. A null page counts as empty. The html column is dropped."""
    keep = [c for c in pages.columns if c not in (html, "extract")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows = [extract(u or "", h or "", settings) for u, h in zip(some.column(some.schema.get_field_index(url)).to_pylist(), some.column(some.schema.get_field_index("_html")).to_pylist())]
                yield pa.RecordBatch.from_arrays([*[some.column(i) for i in range(len(keep))], pa.array(rows, _ARROW)], names=[*keep, "extract"])

    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("extract", EXTRACT)])
    return pages.select(*keep, pages[html].alias("_html")).mapInArrow(run, schema)
