from weftlink.plans import site
from weftlink.settings import CORE, Settings
from weftlink.sources import sitemap
from weftlink.sources.dom import Selector, parse
from weftlink.sources.extract import extract, is_boilerplate_heading, is_boilerplate_text, position

LONG = "words that make up the body of this paragraph and go on for a while"


def test_headings():
    for text, expected in {"About the Author": True, "About Our Authors": True, "Related Posts": True, "Competitive Intelligence in Practice": False, "Subscribe to our Newsletter": True, "": False}.items():
        assert is_boilerplate_heading(text) is expected


def test_paragraph_patterns():
    assert is_boilerplate_text("Jane is a senior content strategist at Acme") and is_boilerplate_text("by Jane Doe and others")
    assert not is_boilerplate_text("by jane doe and others") and not is_boilerplate_text("The river is long and wide")


def test_author_sections_go():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(3))
    page = f'<body><article class="post-content">{body}<h2>About the Author</h2><p>{LONG} bio</p><p>{LONG} more</p></article></body>'
    assert extract("http://x/", page, Settings(min_paragraph_words=5))["paragraphs"] == [f"{LONG} {i}" for i in range(3)]
    page = f"<main><p>{LONG} a {LONG}</p><p>{LONG} b {LONG} {LONG}</p><h2>About the Author</h2><div><p>{LONG} bio</p></div></main>"
    got = extract("http://x/", page, Settings(min_paragraph_words=5))
    assert len(got["paragraphs"]) == 2 and got["extraction_method"] == "html5-main" and got["confidence"] == 0.93


def test_zones_and_boilerplate_elements():
    many = " ".join(f"<p>{LONG} {i}</p>" for i in range(5))
    for page, method in {
        f'<div role="main">{many}</div>': "aria-main",
        f"<article>short</article><div class='entry-content'>{many}</div>": "cms-entry-content",
        f"<div id=content>{many}</div>": "id-content",
        f"<div>{many}</div>": "density-detected-body",
    }.items():
        assert extract("http://x/", page)["extraction_method"] == method
    assert extract("http://x/", "<p>few</p>")["confidence"] == 0.35
    page = f'<article>{many}<div class="author-bio"><p>{LONG} q</p></div><div id="my ad"><p>{LONG} r</p></div><div aria-label="Newsletter"><p>{LONG} s</p></div><figure><figcaption>{LONG} t</figcaption></figure><p aria-hidden="true">{LONG} u</p><div class="navigate">{LONG} v</div></article>'
    assert extract("http://x/", page)["paragraphs"] == [f"{LONG} {i}" for i in range(5)] + [f"{LONG} v"]
    page = f'<article>{many}</article><section class="own">{LONG}<p>{LONG}</p></section>'
    got = extract("http://x/", page, Settings(include_selectors="section.own", exclude_selectors="p:bad"))
    assert got["extraction_method"] == "user-override" and got["paragraphs"] == [LONG]


def test_texts_join_without_a_gap():
    got = extract("http://x/", "<title> A &amp;\n B </title><h1>x</h1><article>a<br>b<h1>one</h1><p>two</p></article>")
    assert (got["title"], got["h1"]) == ("A & B", "x")
    assert parse("a<br>b<p>c").text() == "abc"
    assert [e.tag for e in parse("<ul><li>1<li>2</ul><p>a<p>b<div>c</div>").descendants()] == ["head", "body", "ul", "li", "li", "p", "p", "div"]
    assert parse("<script>var t='</p>';if(a<b){}</script><p>x").descendants().__next__().children[0].tag == "script"


def test_selectors():
    root = parse('<div class="a b" id=i data-x="1"><p><b>t</b></p></div>')
    for text, n in {"div.a": 1, ".a.b": 1, "#i": 1, "[data-x]": 1, "[data-x=1]": 1, "div > b": 0, "div b": 1, "div > p > b": 1, "i, b": 1, "*": 5}.items():
        assert len(Selector(text).all(root)) == n, text


def test_links_and_positions():
    page = f'<meta name=description content="d"><nav><a href="/nav">n</a></nav><article><p>{LONG}<a href="b">x</a><a href="//x.org/c#f">y</a><a href="#t">z</a><a href="mailto:m">m</a></p></article>'
    got = extract("https://www.s.com/a/", page)
    assert got["links"] == ["https://www.s.com/a/b", "https://x.org/c#f"] and got["raw_links"][0] == "https://www.s.com/nav" and got["meta_desc"] == "d"
    assert [position(i, 81) for i in (0, 3, 80)] == [0.0, 0.037, 1.0] and position(0, 1) == 0.0


def test_crawl(spark):
    good = "<article>" + "".join(f"<p>{LONG} {i} {{}}</p>" for i in range(8)) + '<a href="/b">to b</a><a href="/b/">again</a><a href="https://www.s.com/a">self</a></article>'
    shell = "<div id='root'></div><script src='/_app.js'></script><!--" + "x" * 120 + "-->"
    rows = [
        (1, "https://www.s.com/a", good.replace("{}", "a"), 200, "text/html", None, None),
        (2, "http://s.com/a/", good, 200, None, None, None),
        (3, "https://s.com/b", good.replace("{}", "b"), None, None, None, None),
        (4, "https://s.com/c", '<meta name="robots" content="NOINDEX">' + good, 200, None, None, None),
        (5, "https://s.com/d", '<link rel="canonical" href="https://s.com/a">' + good, 200, None, None, None),
        (6, "https://s.com/e", "<p>too short to be of any use</p>" + " " * 10 + "<!--" + "x" * 100 + "-->", 200, None, None, None),
        (7, "https://s.com/f", shell, 200, None, None, None),
        (8, "https://s.com/g", shell, 200, None, None, good.replace("{}", "g")),
        (9, "https://s.com/h", "", 404, None, None, None),
        (10, "https://s.com/i", good, 200, "application/pdf", None, None),
        (11, "https://s.com/j", "tiny", 200, None, None, None),
        (12, "https://s.com/k", None, None, None, "dns", None),
        (13, "ftp://s.com/l", good, 200, None, None, None),
    ]
    raw = spark.createDataFrame(rows, "page_id long, url string, html string, http_status int, content_type string, fetch_error string, rendered_html string")
    found = site.crawl(raw, CORE)
    log = {r.page_id: r.status for r in found.fetch_log.collect()}
    assert log == {1: "success:raw", 3: "success:raw", 6: "no-body-content:raw", 7: "failed:render-unavailable", 8: "success:rendered", 9: "failed:http-404", 10: "skipped:non-html", 11: "failed:empty", 12: "failed:dns"}
    assert {r.page_id: r.reason for r in found.skipped.collect()} == {2: "duplicate", 4: "noindex", 5: "canonical"}
    pages = {r.normalized_url: r for r in site.complete(found.pages).collect()}
    assert set(pages) == {"s.com/a", "s.com/b", "s.com/g"}
    assert pages["s.com/a"].existing_links == ["s.com/b", "s.com/a"]
    assert {k: (r.inbound_count, r.is_orphan) for k, r in pages.items()} == {"s.com/a": (3, False), "s.com/b": (3, False), "s.com/g": (0, True)}
    assert pages["s.com/g"].render_method == "playwright" and pages["s.com/g"].page_seq > pages["s.com/b"].page_seq
    assert pages["s.com/a"].title == "https://www.s.com/a"


def test_sitemaps(spark):
    def parsed(body):
        from pyspark.sql import functions as F

        r = spark.createDataFrame([(body,)], "b string").select(sitemap.parse_sitemap(F.col("b")).alias("p")).first().p
        return r.is_index, r.urls, r.children

    assert parsed("<urlset><url><loc> http://a/x?a=1&amp;&amp;lt;b </loc></url><URL><LOC>http://a/y.PNG</LOC></URL><url><lastmod/></url></urlset>") == (False, ["http://a/x?a=1&<b"], [])
    assert parsed("<loc>http://a/1</loc> <loc>http://a/2.pdf</loc>")[1] == ["http://a/1"]
    assert parsed("<sitemapindex><sitemap><loc>http://a/s1</loc></sitemap><sitemap><loc>http://a/s2</loc></sitemap></sitemapindex>") == (True, [], ["http://a/s1", "http://a/s2"])
    robots = spark.createDataFrame([("a.com", "User-agent: x\r\nSITEMAP:  https://a.com/m1 \nsitemap: /relative"), ("b.com", None)], "domain string, body string")
    many = "".join(f"<url><loc>https://a.com/{i}</loc></url>" for i in range(12))
    files = spark.createDataFrame(
        [
            ("https://a.com/m1", f"<urlset>{many}</urlset>"),
            ("https://a.com/sitemap.xml", "<urlset><url><loc>https://a.com/late</loc></url></urlset>"),
            ("https://b.com/sitemap.xml", "<sitemapindex><sitemap><loc>https://b.com/one</loc></sitemap><sitemap><loc>https://b.com/lost</loc></sitemap></sitemapindex>"),
            ("https://b.com/one", "<url><loc>https://b.com/1</loc></url><url><loc>https://b.com/1</loc></url>"),
            ("https://b.com/post-sitemap.xml", "<url><loc>https://b.com/2</loc></url><url><loc>https://b.com/1</loc></url>"),
        ],
        "url string, body string",
    )
    rows = [(r.domain, r.seq, r.url) for r in sitemap.discover(robots, files).orderBy("domain", "seq").collect()]
    assert rows == [("a.com", i, f"https://a.com/{i}") for i in range(12)] + [("b.com", 0, "https://b.com/1"), ("b.com", 1, "https://b.com/2")]
    assert len(sitemap.discover(robots, files, max_urls=3).where("domain = 'a.com'").collect()) == 3
    given = sitemap.discover(robots, files, manual=("https://a.com/m1",)).where("domain = 'a.com'")
    assert given.count() == 13  # a sitemap given by hand does not end the search
    assert sitemap.link_candidates(sitemap.discover(robots, files), "https://b.com/1/").where("domain = 'b.com'").count() == 1
    kinds = {(r.url, r.type) for r in sitemap.sitemap_files(robots, files).collect()}
    assert ("https://b.com/sitemap.xml", "index") in kinds and ("https://b.com/page-sitemap.xml", "failed") in kinds
    assert sitemap.url_list(" http://a/x \nftp://b\nhttp://a/y\nhttp://c/x", include=("a/",), exclude=("y",)) == ["http://a/x"]
