"""The plans against a plain model that walks over pages, paragraphs and phrases one by one."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.test_functions import plain_keywords
from weftlink.functions.lexicon import GENERIC_ANCHORS, GENERIC_WORDS, STOPWORDS
from weftlink.operators import anchors, graph, report
from weftlink.operators.allocate import allocate
from weftlink.plans import site, target
from weftlink.settings import Settings
from weftlink.streaming.pages import analyze_stream

WORDS = [a + b for a in ("bright", "hollow", "market", "river", "silent", "copper", "marble") for b in ("", "stone", "field", "wood")] + ["of", "the", "in", "guide", "tools"]


def make_site(seed, n=9, host="s.com"):
    rng = random.Random(seed)
    phrases = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 5))) for _ in range(12)]
    kinds = ["blog", "products", "pricing", "x", "guide"]
    urls = [f"https://{host}/{rng.choice(kinds)}/p{i}" for i in range(n)]
    rows = []
    for i, url in enumerate(urls):
        title, h2 = rng.choice(phrases), rng.choice(phrases)
        paragraphs = []
        for _ in range(rng.randint(3, 7)):
            text = [rng.choice(WORDS) for _ in range(rng.randint(8, 60))]
            text[rng.randrange(len(text)) : 0] = rng.choice(phrases).split()
            paragraphs.append(" ".join(text))
        link = f'<p><a href="{rng.choice(urls)}">{" ".join(rng.choice(WORDS) for _ in range(14))}</a></p>' if rng.random() < 0.5 else ""
        html = f"<title>{title}</title><article><h1>{title}</h1><h2>{h2}</h2>{''.join(f'<p>{p}</p>' for p in paragraphs)}{link}</article>"
        rows.append((i, url, html))
    return rows


def bounded(text, phrase):
    m = re.search(rf"(?<![a-zA-Z0-9À-ɏ])({re.escape(phrase)})(?![a-zA-Z0-9À-ɏ])", text, re.I)
    return m and m[1]


def phrases(page):
    out = {}
    for s in [page.title, page.h1, *[h.text for h in page.headings], *page.topics, *page.keywords[:30]]:
        tokens = [t for t in re.sub(r"[^\w\s'-]", " ", re.sub(r"[|\-–—].*$", "", s)).split() if len(t) > 1]
        for n in range(2, min(7, len(tokens)) + 1):
            for a in range(len(tokens) - n + 1):
                out[" ".join(tokens[a : a + n])] = None
    return sorted(out, key=lambda p: (-len(p.split()), p))


def best_anchor(text, listed):
    best, top = None, -1
    for phrase in listed:
        found = bounded(text, phrase)
        if not found:
            continue
        at, w = text.lower().index(found.lower()), found.split()
        points = {2: 2, 3: 3, 4: 4, 5: 4, 6: 4}.get(len(w), 3) + max(0, 3 - sum(x.lower() in GENERIC_WORDS for x in w))
        points += 2 if at / len(text) < 0.33 else 1 if at / len(text) < 0.66 else 0
        points += any(x[0].isupper() for x in w[1:])
        if min(10, points) > top:
            best, top = (found, min(10, points)), min(10, points)
    return best


def kept_words(text):
    return [w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s]", " ", text.lower())) if len(w) > 3 and w not in STOPWORDS and not w.isdigit()][:60]


def points_of(anchor, text, goal, shared, position):
    low, raw = anchor.lower().strip(), 0
    h2 = [h.text.lower() for h in goal.headings if h.level == "H2"]
    if goal.h1 and (low in goal.h1.lower() or " ".join(goal.h1.lower().split(" ")[:4]) in low):
        raw += 3
    elif low in goal.title.lower():
        raw += 2.5
    elif any(low in h or " ".join(h.split(" ")[:3]) in low for h in h2):
        raw += 2
    elif low in goal.meta_desc.lower():
        raw += 1.5
    elif re.sub(r"\s+", "-", low) in re.sub("[/-]", " ", goal.url.split("/", 3)[3]).strip().lower():
        raw += 1
    elif shared:
        raw += 0.5
    raw += 2 if shared >= 10 else 1.5 if shared >= 6 else 1 if shared >= 3 else 0.5 if shared else 0
    own = kept_words(text)
    near = sum(w in goal.keywords for w in own) / math.sqrt(len(own) * len(goal.keywords)) if own and goal.keywords else 0
    raw += 1 if near >= 0.25 else 0.5 if near >= 0.12 else 0
    n = len(text.split())
    raw += 2 if n >= 80 else 1.5 if n >= 40 else 1 if n >= 20 else 0
    raw += 2 if goal.is_orphan else 1 if goal.inbound_count < 2 else 0
    raw += goal.page_type in ("product", "commercial", "service")
    raw += 1 if position <= 0.25 else 0.5 if position <= 0.5 else 0
    raw -= 3 * (low in GENERIC_ANCHORS) + 2 * (len(anchor) < 4) + 0.5 * (" " not in anchor and len(anchor) < 8)
    return max(1, min(10, math.floor(raw + 0.5)))


def model(pages, s):
    """Suggestions as (source, target, paragraph, anchor, score), in the order in which they are made."""
    out, to = [], {}
    listed = {p.page_seq: phrases(p) for p in pages}
    for src in pages:
        used, n = set(), 0
        for goal in pages:
            if src.page_seq == goal.page_seq or goal.normalized_url in src.existing_links or n >= s.max_links_per_source or to.get(goal.page_seq, 0) >= s.max_links_per_target:
                continue
            shared = sum(k in goal.keywords for k in src.keywords)
            if shared < s.min_keyword_overlap:
                continue
            best = None
            for i, (text, position) in enumerate(zip(src.paragraphs, src.paragraph_positions)):
                found = best_anchor(text, listed[goal.page_seq])
                if found and found[0].lower() not in used:
                    points = points_of(found[0], text, goal, shared, position)
                    if best is None or points > best[4]:
                        best = (src.page_seq, goal.page_seq, i, found[0], points)
            if best and best[4] >= s.min_score:
                out.append(best)
                used.add(best[3].lower())
                n += 1
                to[goal.page_seq] = to.get(goal.page_seq, 0) + 1
    return out


@pytest.mark.parametrize("seed, settings", [(1, Settings()), (2, Settings(max_links_per_source=2, max_links_per_target=2, min_score=5, min_keyword_overlap=1)), (3, Settings(max_links_per_source=1, max_links_per_target=1, min_score=3, min_keyword_overlap=0))])
def test_site_as_the_model(spark, seed, settings):
    rows = make_site(seed) + [(i + 100, u, h) for i, u, h in make_site(seed + 50, 4, "other.org")]
    made = site.analyze_sites(spark.createDataFrame(rows, "page_id long, url string, html string"), settings)
    pages = sorted(made.pages.collect(), key=lambda p: p.page_seq)
    for p in pages:
        assert p.keywords == plain_keywords(" ".join([p.title, p.meta_desc, p.h1, *[h.text for h in p.headings], *p.paragraphs]))
    expected = [x for host in ("other.org", "s.com") for x in model([p for p in pages if p.site_key == host], settings)]
    got = made.opportunities.collect()
    index = {(p.page_seq, t): i for p in pages for i, t in enumerate(p.paragraphs)}
    assert sorted((r.src_seq, r.tgt_seq, index[r.src_seq, r.existing_paragraph], r.suggested_anchor, r.score) for r in got) == sorted(expected)
    assert expected
    for r in got:
        assert r.suggested_anchor in r.existing_paragraph and f"[{r.suggested_anchor}]({r.target_url})" in r.updated_paragraph
        assert r.priority == ("High" if r.score >= 8 else "Medium" if r.score >= 6 else "Low") and r.score_breakdown.total == r.score


def test_reports(spark, tmp_path):
    made = site.analyze_sites(spark.createDataFrame(make_site(2), "page_id long, url string, html string"), Settings(min_score=4, min_keyword_overlap=1))
    opps, pages = made.opportunities, made.pages
    one = report.summary(made.crawl.fetch_log, pages, made.crawl.skipped, opps).first()
    assert one.total_opps == opps.count() == one.high_priority + one.med_priority + one.low_priority and one.fetched_ok == 9
    total = {r.normalized_url: r for r in graph.degrees(pages, opps).collect()}
    assert sum(r.outbound for r in total.values()) == opps.count() + graph.known_edges(pages).count()
    assert report.page_flags(pages, opps).where("flag = 'orphan'").count() == sum(r.inbound == 0 for r in total.values()) == one.orphan_pages
    first = opps.orderBy(*report.in_order(opps)).first()
    assert report.filter_opportunities(opps, pages, source=first.source_url, target=first.target_url).count() == 1
    assert report.filter_opportunities(opps, pages, search=first.suggested_anchor.upper()).count() >= 1
    assert report.filter_opportunities(opps, pages, orphan_only=True).count() == sum(r.is_orphan for r in opps.join(pages.select(F.col("page_seq").alias("tgt_seq"), "is_orphan"), "tgt_seq").collect())
    assert sum(report.filter_opportunities(opps, band=b).count() for b in ("high", "medium", "low")) == opps.count()
    assert report.anchor_variations(opps).first().anchor == first.suggested_anchor and report.top_opportunities(opps).count() == min(8, opps.count())
    assert report.facets(opps).where("facet = 'linkType'").agg(F.sum("n")).first()[0] == opps.count()
    table = report.export_rows(opps, pages)
    assert tuple(table.columns) == report.EXPORT_COLUMNS and "](" not in table.first()["Updated Paragraph"]
    report.write_csv(table, str(tmp_path / "csv"))
    again = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(str(tmp_path / "csv"))
    assert again.count() == opps.count() and again.first()["Score"].endswith("/10")
    rest = site.without_opportunity(pages, opps)
    assert rest.count() == 9 - opps.select("src_seq").distinct().count()


def test_caps(spark):
    rows = [("s", 1, t, 0, f"anchor {t % 3}", 9 - t % 2) for t in range(2, 9)] + [("s", s, 9, p, f"same {p}", 8) for s in range(2, 8) for p in range(2)]
    frame = spark.createDataFrame(rows, "site_key string, src_seq long, tgt_seq long, para_idx int, anchor string, score int")
    got = [tuple(r)[1:5] for r in allocate(frame, Settings(max_links_per_source=2, max_links_per_target=3)).orderBy("src_seq", "tgt_seq").collect()]
    assert got == [(1, 2, 0, "anchor 2"), (1, 3, 0, "anchor 0"), (2, 9, 0, "same 0"), (3, 9, 0, "same 0"), (4, 9, 0, "same 0")]


def test_target(spark):
    rows = make_site(4, 10)
    goal = rows[0][1]
    made = target.analyze_target(spark.createDataFrame(rows, "page_id long, url string, html string"), goal + "/")
    scores = made.scores.orderBy(F.desc("composite_score"), "page_seq").collect()
    assert len(scores) == 9 and all(0 <= r.composite_score <= 10 for r in scores)
    opps = made.opportunities.collect()
    strict = {r.source_norm for r in opps if r.opportunity_type is None}
    filled = {r.source_norm for r in opps if r.opportunity_type}
    assert not strict & filled and {r.target_url for r in opps} == {goal}
    linked = {r.normalized_url for r in scores if r.already_links}
    assert not linked & filled
    assert strict | filled == {r.normalized_url for r in scores if not r.already_links and (r.composite_score >= 0.5 or r.normalized_url in strict)}
    one = made.diagnostics.first()
    assert (one.opps_after_filter, one.opps_before_filter, one.semantic_opps) == (len(opps), len(strict), len(filled)) and one.zero_opp_reason is None
    assert target.top_scores(made.scores).count() == 9
    alone = target.analyze_target(spark.createDataFrame(rows[:1], "page_id long, url string, html string"), goal)
    assert alone.diagnostics.first().zero_opp_reason.startswith("No source pages yielded valid body content")


def test_natural_anchors(spark):
    pages = spark.createDataFrame(
        [("s", 1, ["Introduction to Silent Copper Marble Tools for all"], [0.0], "x", "", [], []), ("s", 2, ["none"], [0.0], "Guide to silent copper marble", "here", [("H2", "river wood")], ["copper"])],
        "site_key string, page_seq long, paragraphs array<string>, paragraph_positions array<double>, h1 string, title string, headings array<struct<level:string,text:string>>, topics array<string>",
    )
    assert [tuple(r) for r in anchors.natural_anchors(anchors.paragraphs(pages), pages).collect()] == [("s", 1, 0, 2, "Silent Copper Marble")]


def test_stream(spark, tmp_path):
    rows = make_site(5)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for k in range(2):
        frame.where(F.col("page_id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    analyze_stream(stream, str(tmp_path / "pages"), str(tmp_path / "log"), lambda df, n: seen.append({(r.source_url, r.target_url) for r in df.collect()}), Settings(min_score=4)).awaitTermination(120)
    whole = site.analyze_sites(frame, Settings(min_score=4)).opportunities
    assert seen[-1] == {(r.source_url, r.target_url) for r in whole.collect()}
