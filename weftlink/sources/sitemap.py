"""Addresses from robots.txt files and sitemaps that are already fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.lexicon import SITEMAP_PATHS
from weftlink.functions.text import trim
from weftlink.functions.urls import is_page_url, normalize, site_key

#: A sitemap that robots.txt names ends the search once so many addresses are known.
ENOUGH, MOST_URLS = 10, 1000
_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def _decoded(x: Column) -> Column:
    """The five references, one after the other: a doubly escaped one is decoded twice."""
    for name, mark in _ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(mark))
    return x


def location(block: Column) -> Column:
    """The first address in a block; empty without one."""
    return _decoded(trim(F.regexp_extract(block, r"(?is)<loc>(.*?)</loc>", 1)))


def _locations(body: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), location), lambda u: u != "")


def parse_sitemap(body: Column) -> Column:
    """(is_index, urls, children) of a sitemap's text. Pages stand in url blocks, or bare where no block has one."""
    index = body.rlike(r"(?i)<sitemapindex")
    blocks = F.filter(_locations(body, r"(?is)<url.*?</url>"), is_page_url)
    bare = F.filter(_locations(body, r"(?is)<loc>.*?</loc>"), is_page_url)
    none = F.array().cast("array<string>")
    return F.struct(
        index.alias("is_index"),
        F.when(index, none).when(F.size(blocks) > 0, blocks).otherwise(bare).alias("urls"),
        # the pattern takes the index's own tag into the first block, as long as it ends one
        F.when(index, _locations(body, r"(?is)<sitemap.*?</sitemap>")).otherwise(none).alias("children"),
    )


def robots_sitemaps(body: Column) -> Column:
    """The sitemaps that a robots.txt names."""
    found = F.transform(F.split(body, r"\r?\n"), lambda line: trim(F.regexp_extract(line, r"(?i)^sitemap:\s*(.+)", 1)))
    return F.filter(found, lambda u: u.startswith("http"))


def sitemap_candidates(robots: DataFrame, manual: tuple[str, ...] = ()) -> DataFrame:
    """(domain, seq, url, kind): where each domain of robots (domain, body; null: none) has its sitemaps, in order, each once."""
    given = F.array(*[F.lit(u) for u in manual if u.startswith("http")]) if manual else F.array().cast("array<string>")
    origin = F.concat(F.lit("https://"), F.col("domain"))

    def of(urls: Column, kind: str) -> Column:
        return F.transform(urls, lambda u: F.struct(u.alias("url"), F.lit(kind).alias("kind")))

    named = F.coalesce(robots_sitemaps(F.col("body")), F.array().cast("array<string>"))
    probes = F.array(*[F.concat(origin, F.lit(p)) for p in SITEMAP_PATHS])
    rows = robots.select("domain", F.posexplode(F.concat(of(given, "manual"), of(named, "robots"), of(probes, "probe"))).alias("seq", "c")).select("domain", "seq", "c.*")
    # a sitemap given by hand counts as such, wherever else it is named
    first = rows.groupBy("domain", "url").agg(F.min("seq").alias("seq"), F.min_by("kind", "seq").alias("kind"), F.max(F.col("kind") == "robots").alias("in_robots"))
    return first


def discover(robots: DataFrame, files: DataFrame, manual: tuple[str, ...] = (), max_urls: int = MOST_URLS) -> DataFrame:
    """(domain, seq, url, sitemap): the addresses of each domain in the order in which they are found, at most max_urls.

    files (url, body) are the fetched sitemaps; one that is missing has failed. An index leads to its children, one
    level deep. The search of a domain ends after a sitemap that robots.txt names and that is not given by hand, once
    ENOUGH addresses are known.
    """
    parsed = files.select(F.col("url").alias("file"), parse_sitemap(F.col("body")).alias("p")).dropDuplicates(["file"])
    tried = sitemap_candidates(robots, manual).join(parsed, F.col("url") == F.col("file")).select("domain", "seq", F.col("url").alias("sitemap"), "kind", "in_robots", "p")
    direct = tried.select("domain", "seq", "sitemap", "kind", "in_robots", F.lit(0).alias("child"), F.posexplode(F.col("p.urls")).alias("at", "url"))
    children = tried.select("domain", "seq", "sitemap", "kind", "in_robots", F.posexplode(F.col("p.children")).alias("child", "child_url"))
    deeper = children.join(parsed, F.col("child_url") == F.col("file")).select("domain", "seq", "sitemap", "kind", "in_robots", "child", F.posexplode(F.col("p.urls")).alias("at", "url"))
    found = direct.unionByName(deeper)
    first = found.groupBy("domain", "url").agg(F.min(F.struct("seq", "child", "at", "sitemap")).alias("f"))
    # how many addresses are known after each sitemap that was tried
    new = first.groupBy("domain", F.col("f.seq").alias("seq")).agg(F.count("*").alias("new"))
    upto = Window.partitionBy("domain").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    known = tried.select("domain", "seq", "kind", "in_robots").join(new, ["domain", "seq"], "left").withColumn("known", F.sum(F.coalesce("new", F.lit(0))).over(upto))
    stop = known.where((F.col("known") >= ENOUGH) & F.col("in_robots") & (F.col("kind") != "manual")).groupBy("domain").agg(F.min("seq").alias("stop"))
    kept = first.join(stop, "domain", "left").where(F.col("stop").isNull() | (F.col("f.seq") <= F.col("stop")))
    order = Window.partitionBy("domain").orderBy("f")
    return kept.select("domain", (F.row_number().over(order) - 1).alias("seq"), "url", F.col("f.sitemap").alias("sitemap")).where(F.col("seq") < max_urls)


def sitemap_files(robots: DataFrame, files: DataFrame, manual: tuple[str, ...] = ()) -> DataFrame:
    """(domain, url, type, url_count, child_count) of each candidate: urlset, index, or failed."""
    parsed = files.select(F.col("url").alias("file"), parse_sitemap(F.col("body")).alias("p")).dropDuplicates(["file"])
    rows = sitemap_candidates(robots, manual).join(parsed, F.col("url") == F.col("file"), "left")
    kind = F.when(F.col("file").isNull(), "failed").when(F.col("p.is_index"), "index").otherwise("urlset")
    return rows.select("domain", "seq", "url", kind.alias("type"), F.coalesce(F.size("p.urls"), F.lit(0)).alias("url_count"), F.coalesce(F.size("p.children"), F.lit(0)).alias("child_count"))


def link_candidates(urls: DataFrame, target: str) -> DataFrame:
    """The addresses (domain, url, ...) of their own domain, without the target's."""
    return urls.where((site_key(F.col("url")) == F.col("domain")) & (normalize(F.col("url"), every_slash=True) != normalize(F.lit(target), every_slash=True)))


def url_list(text: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), most: int | None = None) -> list[str]:
    """The addresses of a text, one a line: http, no part of exclude, some part of include if there are any; the first `most`."""
    urls = [u for u in map(str.strip, text.split("\n")) if u.startswith("http")]
    urls = [u for u in urls if not any(x in u for x in exclude) and (not include or any(x in u for x in include))]
    return urls[:most]
