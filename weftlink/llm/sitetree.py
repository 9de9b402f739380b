"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is an element's path of tags and classes. Its importance is the
normalised entropy of what its pages show there, of the presentation (the children's tags) and of the content (the
text): a branch that looks and reads the same on page after page says nothing about any of them. What a branch's tag,
role or class says is a prior: it raises the importance that a menu, a footer or an advert needs in order to stay, and
decides alone only where a host has too few pages to judge.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import common
from weftlink.sources.markup import Markup

#: A branch is judged by its host's pages if so many different ones have it.
LEAST_PAGES = 8
#: Importance below which a branch goes; the same for branches that a tag, role or name marks as furniture.
LEAST_IMPORTANCE, FURNITURE_IMPORTANCE = 0.3, 0.95
#: Weight of the content's entropy against the presentation's.
CONTENT_WEIGHT = 0.9
#: Bare text goes too if it looks the same everywhere (presentation below the first) beside a branch that does not (above the second) and has so many times its text.
PLAIN_LOOK, RICH_LOOK, TIMES = 0.05, 0.25, 10
#: Longer paths are hashed. Deeper elements are put beside one another, as browsers do.
LONGEST_PATH, DEEPEST = 512, 512
#: Decisions of up to so many bytes are handed to every worker; more are joined to the pages by a shuffle.
BROADCAST_BYTES = 16_000_000
#: Pages that Python gets at once.
BATCH_ROWS = 500
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template noscript textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_HIDDEN = frozenset("button canvas embed head iframe input math noembed noframes noscript object option picture script select style svg template textarea title video audio".split())
_FURNITURE = frozenset("aside dialog footer form menu nav".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners billboard bottombar breadcrumb breadcrumbs byline comment comments consent cookie cookies cta disqus dropdown "
    "footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup popups promo promos promoted promotion "
    "recommended related replies respond share sharing sidebar sidebars signup skyscraper social sponsor sponsored sponsors subscribe subscription taboola teaser toc toolbar topbar widget widgets".split()
)
#: Readers' words may read as the page's own, so such a branch goes whatever its importance.
_READERS = frozenset("comment comments disqus replies respond".split())
_MAIN = frozenset(("article", "main"))
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th caption figcaption".split())
#: Start tags that end an open element of the same list's first name.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_WORD = re.compile(r"[a-z0-9]+")


#: Branches that stay though their host repeats them, where their main or article branch holds most of the text: the branch itself, and prose in it.
_KEPT = r"/(article|main)(\.[^/]*)?((/[^/]*)*/(p|h[1-6]|li|dt|dd|pre|blockquote|td|th)(\.[^/]*)?)?$"
_KEPT_PATTERN = re.compile(_KEPT)
#: How the path of furniture ends: certain by tag, role or readers' names, or likely by other names.
CERTAIN, LIKELY = "!", "?"


class Node:
    __slots__ = ("tag", "path", "parent", "children", "hidden", "depth")

    def __init__(self, tag: str, path: str, parent: Node | None, hidden: bool):
        self.tag, self.path, self.parent, self.hidden = tag, path, parent, hidden
        self.depth = parent.depth + 1 if parent is not None else 0
        self.children: list[Node | str] = []

    @property
    def furniture(self) -> bool:
        return self.path.endswith((CERTAIN, LIKELY))


def _mark(tag: str, given: dict[str, str], names: list[str], in_main: bool) -> str:
    if tag in _FURNITURE or tag == "header" and not in_main or (given.get("role") or "").lower() in _ROLES:
        return CERTAIN
    if tag in ("html", "body", "article", "main") or _NAMES.isdisjoint(names):
        return ""
    return LIKELY if _READERS.isdisjoint(names) else CERTAIN


def tree(page: str) -> Node:
    """The elements of a page, with implied end tags of p, li and the like. Unclosed elements end with their parents."""
    root = now = Node("#root", "", None, False)
    markup, at, end = Markup(page), 0, len(page)
    while at < end:
        found = markup.next(at)
        if found is None:
            now.children.append(page[at:])
            break
        if found.start > at:
            now.children.append(page[at : found.start])
        at, tag = found.end, found.name
        if tag is None:
            continue
        if found.closing:
            up = now
            while up is not None and up.tag != tag:
                up = up.parent
                if up is not None and tag in _INLINE and up.tag not in _INLINE:
                    up = None  # an inline end tag closes nothing around its block
            if up is not None and up.parent is not None:
                now = up.parent
            continue
        if tag in _ENDS_P:
            up = now
            while up.tag in _INLINE:
                up = up.parent
            if up.tag == "p":
                now = up.parent
        elif tag in _ENDS:
            closes, within = _ENDS[tag]
            up = now
            while up.parent is not None and up.tag not in within:
                if up.tag in closes:
                    now = up.parent
                    break
                up = up.parent
        given = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(found.raw)} if found.raw else {}
        names = _WORD.findall(f"{given.get('class', '')} {given.get('id', '')}".lower())
        hidden = tag in _HIDDEN or "hidden" in given or (given.get("aria-hidden") or "").lower() == "true"
        path = f"{now.path}/{tag}{''.join('.' + n for n in names if not n.isdigit())}"
        path = (path if len(path) <= LONGEST_PATH else "#" + xxhash.xxh64_hexdigest(path)) + _mark(tag, given, names, now.tag in _MAIN)
        node = Node(tag, path, now, hidden)
        now.children.append(node)
        if tag in _VOID or found.raw.endswith("/") and tag not in _INLINE and tag not in _ENDS_P:
            continue
        if tag in _RAW:
            at = markup.raw_end(tag, at)[1]
        elif node.depth < DEEPEST:
            now = node
    return root


def _main(root: Node) -> Node | None:
    """The only main or article branch of a page outside its furniture, if there is one."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in _MAIN:
            found.append(node)
            continue
        stack += [c for c in node.children if isinstance(c, Node) and not c.hidden and not c.furniture]
    return found[0] if len(found) == 1 else None


def blocks(node: Node, drop: frozenset[str] | set[str] = frozenset(), keep: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """Texts of the blocks under node in order, without the paths in drop and furniture that is not in keep; white space as one blank."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.tag == "br":
            held.append(" ")
        elif x is node or not x.hidden and x.path not in drop and (not x.furniture or x.path in keep):
            if x.tag not in _INLINE:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return out


def branches(root: Node) -> Iterator[tuple[str, int, int, int, bool]]:
    """(path, presentation, content, characters, prose) of the page and each shown block element; the first two as hashes. prose: whether there is any in it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.hidden]
    told: dict[int, tuple[bytes, int, bool]] = {}
    nothing = (b"", 0, False)
    for node in reversed(order):
        words = [" ".join(c.split()) if isinstance(c, str) else "" for c in node.children]
        below = [nothing if isinstance(c, str) else told.get(id(c), nothing) for c in node.children]
        digest = xxhash.xxh64_digest(b"".join([w.encode() or d for w, (d, _, _) in zip(words, below)]))
        told[id(node)] = digest, sum(map(len, words)) + sum(n for _, n, _ in below), node.tag in _PROSE or any(x for _, _, x in below)
        if node is root or node.tag not in _INLINE and node.tag not in ("html", "body"):
            kids = " ".join(c.tag for c in node.children if isinstance(c, Node) and not c.hidden)
            yield node.path, xxhash.xxh64_intdigest(kids) >> 1, int.from_bytes(digest, "big") >> 1, told[id(node)][1], told[id(node)][2]


def extract(page: str, drop: frozenset[str] | set[str] = frozenset(), keep: frozenset[str] | set[str] = frozenset(), judged: bool = False) -> str:
    """The main text of a page. Where its host is not judged, a lone main or article branch is all of it if it holds as much as what else is left of the page."""
    root = tree(page)
    main = None if judged else _main(root)
    if main is not None:
        own = "\n".join(blocks(main, {p for p in drop if not _KEPT_PATTERN.search(p)}, keep))
        if len(own) >= len("\n".join(blocks(root, {*drop, main.path}, keep))):
            return own
    return "\n".join(blocks(root, drop, keep))


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _page(html: str = "html"):
    return F.xxhash64(F.coalesce(html, F.lit("")))


def branch_rows(pages: DataFrame) -> DataFrame:
    """(host, page, path, shown, told, chars, prose) of the branches of pages (url, html), equal pages of a host once.

    A page has one presentation and one content at a path: all its elements there together.
    """
    names = ["host", "page", "path", "shown", "told", "chars", "prose"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.groups(batch, 2):
                rows = []
                for host, page, html in zip(*(some.column(i).to_pylist() for i in range(3))):
                    at: dict[str, tuple[int, int, int, bool]] = {}
                    for path, shown, told, chars, prose in branches(tree(html or "")):
                        a, b, n, some_prose = at.get(path, (0, 0, 0, False))
                        at[path] = (a * 31 + shown) % (1 << 63), (b * 31 + told) % (1 << 63), n + chars, some_prose or prose
                    rows += [(host, page, path, *x) for path, x in at.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)

    each = pages.select(host_of().alias("host"), _page().alias("page"), "html")
    return each.mapInArrow(run, "host string, page long, path string, shown long, told long, chars long, prose boolean").distinct()


def importance(rows: DataFrame, content_weight: float = CONTENT_WEIGHT) -> DataFrame:
    """(host, path, pages, look, importance, chars, prose) of each branch of each host's tree, from branch_rows().

    look: the presentation's part of importance; chars: a page's mean; the path '' is the page itself.
    """
    # one row for a value at a branch, with the number of pages that have it: a host's size is summed before it is gathered
    sides = F.explode(F.array(F.struct(F.lit(False).alias("content"), F.col("shown").alias("value")), F.struct(F.lit(True).alias("content"), F.col("told").alias("value")))).alias("side")
    values = rows.select("host", "path", "chars", "prose", sides).groupBy("host", "path", "side").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.max("prose").alias("prose"))
    spread = values.groupBy("host", "path", F.col("side.content").alias("content")).agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"), F.sum("chars").alias("chars"), F.max("prose").alias("prose"))
    # entropy over its largest value, log(pages)
    entropy = F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.log("pages"))).otherwise(F.lit(1.0))
    weight = F.when(F.col("content"), F.lit(content_weight)).otherwise(F.lit(1 - content_weight))
    look = F.max(F.when(~F.col("content"), entropy)).alias("look")
    return spread.groupBy("host", "path").agg(F.max("pages").alias("pages"), look, F.sum(weight * entropy).alias("importance"), (F.max("chars") / F.max("pages")).alias("chars"), F.max("prose").alias("prose"))


def decisions(weighed: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE, furniture_importance: float = FURNITURE_IMPORTANCE) -> DataFrame:
    """(host, path, stays, why) of the branches that importance decides against what the page itself would suggest, from importance().

    The path '' says that a host is judged. why: 'judged'; 'same' for what a host repeats; 'furniture' for what is
    marked so and not important enough; 'plain' for bare text that looks the same everywhere beside the main text;
    'main' for what stays despite its name, for it holds most of the host's text.
    """
    known = weighed.where(F.col("pages") >= least_pages)
    pages = known.where("path = ''").select("host", F.col("chars").alias("whole"))
    known = known.where("path <> ''").withColumn("parent", F.when(F.substring("path", 1, 1) == "/", F.regexp_replace("path", "/[^/]*$", "")))
    # the main or article branch that holds most of a host's text: in it, prose that is repeated stays
    main = known.where(F.col("path").rlike(r"/(article|main)[^/!?]*$")).join(pages, "host").where(F.col("chars") * 2 >= F.col("whole"))
    main = main.groupBy("host").agg(F.max_by("path", "chars").alias("main"))
    beside = known.where("parent IS NOT NULL").groupBy("host", "parent").agg(F.max_by(F.struct("chars", "look"), "chars").alias("most"))
    rows = known.join(pages, "host").join(main, "host", "left").join(beside, ["host", "parent"], "left")
    marked = F.col("path").rlike("[!?]$")
    inside = (F.col("path") == F.col("main")) | F.col("path").startswith(F.concat("main", F.lit("/")))
    own = F.coalesce(inside & F.col("path").rlike(_KEPT), F.lit(False))
    plain = ~F.col("prose") & (F.col("look") < PLAIN_LOOK) & (F.col("most.look") > RICH_LOOK) & (F.col("chars") * TIMES <= F.col("most.chars"))
    named = F.col("path").endswith(LIKELY) & (F.col("importance") >= least_importance) & (F.col("chars") * 2 >= F.col("whole"))
    why = (
        F.when(named, "main").when(marked & (F.col("importance") < furniture_importance), "furniture")
        .when(~marked & ~own & (F.col("importance") < least_importance), "same").when(~marked & plain, "plain")
    )
    told = rows.select("host", "path", why.alias("why")).where("why IS NOT NULL")
    return told.unionByName(pages.select("host", F.lit("").alias("path"), F.lit("judged").alias("why"))).select("host", "path", F.col("why").isin("main", "judged").alias("stays"), "why")


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html).

    A null html counts as empty and gives an empty text. A url without a host belongs to the host ''. Hosts of fewer
    than least_pages different pages are not judged: there furniture goes by its marks, and a lone main or article
    branch that holds most of the page is its text. Of equal branches none is preferred: they stay or go together.
    Repeated rows stay and are judged as one page; other columns are not read; an empty table gives no rows. Only the
    whole page bounds a text: nothing is cut off.
    """
    rows = branch_rows(pages)
    weighed = common.cut_lineage(importance(rows))  # read several times, and the pages are parsed for it
    told = common.cut_lineage(decisions(weighed, least_pages, least_importance).select("host", "path", "stays"))
    size = told.agg(F.sum(F.length("path") + F.length("host") + 16)).first()[0] or 0
    wide = pages.select("page_id", "url", "html", host_of().alias("host"))
    if size <= broadcast_bytes:  # checked: the decisions of all hosts fit into every worker
        known: dict[str, tuple[set[str], set[str]]] = {}
        for host, path, stays in told.collect():
            known.setdefault(host, (set(), set()))[stays].add(path)
        shared = pages.sparkSession.sparkContext.broadcast(known)
        joined = wide.select("page_id", "url", "html", "host", F.lit(None).cast("array<string>").alias("drop"), F.lit(None).cast("array<string>").alias("keep"))
    else:
        shared = None
        often = told.join(weighed.select("host", "path", F.col("pages").alias("often")), ["host", "path"])
        found = common.salted_join(rows.select("host", "page", "path"), often, ["host", "path"], ["page"], "often")
        own = found.groupBy("host", "page").agg(F.collect_set(F.when(~F.col("stays"), F.col("path"))).alias("drop"), F.collect_set(F.when(F.col("stays"), F.col("path"))).alias("keep"))
        joined = wide.withColumn("page", _page()).join(own, ["host", "page"], "left").select("page_id", "url", "html", "host", "drop", "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_host = shared.value if shared is not None else {}
        for batch in batches:
            for some in common.groups(batch, 2):
                texts = []
                for html, host, out, kept in zip(*(some.column(i).to_pylist() for i in range(2, 6))):
                    drop, keep = of_host.get(host, ((), ())) if shared is not None else (set(out or ()), set(kept or ()))
                    texts.append(extract(html or "", drop, keep, "" in keep))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
