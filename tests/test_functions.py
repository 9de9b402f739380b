import random
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from weftlink.functions import text as words
from weftlink.functions import urls
from weftlink.functions.lexicon import STOPWORDS
from weftlink.operators import anchors, corpus, scoring, semantic


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url, site, normal, slug",
    [
        ("https://www.Example.com/A/b-c/?q=1#x", "example.com", "example.com/a/b-c", "a b c"),
        ("http://example.com", "example.com", "example.com", ""),
        ("http://example.com//", "example.com", "example.com/", ""),
        ("https://user@host.org:8080/p", "host.org", "host.org/p", "p"),
        ("No Address", "", "no address", ""),
    ],
)
def test_urls(spark, url, site, normal, slug):
    row = spark.range(1).select(F.lit(url).alias("u")).select(urls.site_key(F.col("u")).alias("s"), urls.normalize(F.col("u")).alias("n"), urls.slug(F.col("u")).alias("g")).first()
    assert (row.s, row.n, row.g) == (site, normal, slug)


def test_every_closing_slash(spark):
    got = [one(spark, urls.normalize(F.lit(u), every_slash=True)) for u in ("http://a.b//", "http://a.b", "http://a.b/c//")]
    assert got == ["a.b/", "a.b/", "a.b/c"]


def test_page_and_link_types(spark):
    kinds = {"/blog/x": "blog", "/products/x": "product", "/pricing": "commercial", "/services/": "service", "/hub/x": "resource", "/customer/x": "case-study", "/careers": "company", "/vs/x": "comparison", "/what-is-x": "informational", "/x": "general", "/blog/pricing": "blog"}
    for path, kind in kinds.items():
        assert one(spark, urls.page_type(F.lit(f"https://S.com{path.upper()}"))) == kind
    assert one(spark, urls.link_type(F.lit("blog"), F.lit("informational"))) == "Blog-to-guide"
    assert one(spark, urls.link_type(F.lit("general"), F.lit("blog"))) == "general-to-blog"


def test_white_space(spark):
    assert one(spark, words.squeeze(F.lit(chr(0xFEFF) + " a" + chr(0xA0) + "b" + chr(0x3000) + "\nc "))) == "a b c"
    assert one(spark, words.word_count(F.lit("a" + chr(0xA0) + "b c"))) == 3
    assert one(spark, words.word_count(F.lit(""))) == 1


def plain_keywords(text, top=100):
    import re

    kept = [w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s'-]", " ", text.lower())) if len(w) > 3 and w not in STOPWORDS and not re.fullmatch("[0-9]+", w)]
    weight = {}
    for w in kept:
        weight[w] = weight.get(w, 0) + 1
    for a, b in zip(kept, kept[1:]):
        weight[f"{a} {b}"] = weight.get(f"{a} {b}", 0) + 0.65
    return [t for t, _ in sorted(weight.items(), key=lambda x: -x[1])][:top]


def test_keywords(spark):
    rng = random.Random(3)
    pool = ["apple", "river", "stone", "it's", "well-known", "2024", "with", "cat", "Crème", "market"]
    texts = [" ".join(rng.choice(pool) for _ in range(n)) for n in (0, 1, 5, 60, 300)] + ["gold fish " * 20 + "gold " * 0, "x"]
    # a pair twenty times weighs a little more than a word thirteen times
    texts.append("alpha bravo " * 20 + "tango " * 13)
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.keywords for r in words.keyword_lists(frame, "id", F.col("text")).collect()}
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_keywords(t)


def test_topics_keep_repeats_and_numbers(spark):
    got = one(spark, words.topics(F.lit("Market-research 20245"), F.lit("Market"), F.array(F.lit("about nothing")), F.lit("")))
    assert got == ["market", "research", "20245", "market", "nothing"]


def test_cosine_counts_repeats(spark):
    ours, theirs = F.array(*[F.lit(x) for x in ("a", "a", "b")]), F.array(F.lit("a"))
    assert one(spark, words.cosine(ours, theirs)) == pytest.approx(2 / 3**0.5)
    assert one(spark, words.cosine(F.array().cast("array<string>"), theirs)) == 0


def test_positions_round_the_exact_value(spark):
    for n in range(81):
        exact = [float(Decimal(i / (n - 1)).quantize(Decimal("0.001"), ROUND_HALF_UP)) if n > 1 else 0.0 for i in range(n)]
        assert one(spark, corpus.positions(F.lit(n))) == exact


@pytest.mark.parametrize(
    "text, phrase, found",
    [
        ("The competitive intelligence platform", "intel", None),
        ("The Competitive Intelligence platform", "competitive intelligence", "Competitive Intelligence"),
        ("natural science", "ci", None),
        ("caféteria café", "café", "café"),
        ("a.b (x) *y*", "(x)", "(x)"),
        ("ab_cd ab", "ab", "ab"),
        ("x", "x", None),
    ],
)
def test_bounded_phrase(spark, text, phrase, found):
    assert one(spark, anchors.bounded_phrase(F.lit(text), F.lit(phrase))) == found


def test_generic_anchors(spark):
    cases = [("analysis", {}, True), ("insights", {}, True), ("competitive intelligence tools", {}, False), ("", {}, True), ("river", {"allow_single_word": True}, False), ("Market", {"allow_single_word": True}, True), ("cat", {"allow_single_word": True}, True), ("two words", {"min_words": 3}, True)]
    for phrase, options, expected in cases:
        assert one(spark, anchors.is_generic_anchor(F.lit(phrase), **options)) is expected


def test_phrases(spark):
    got = one(spark, anchors.phrases_of(F.array(F.lit("Big Data - Site"), F.lit("a Big"), F.lit(None)), 7))
    assert got == ["Big", "Data", "Big Data"]
    rows = anchors.candidates(
        spark.createDataFrame([("s", 1, "Red fox | Site", "red fox", [], ["fox"], [])], "site_key string, page_seq long, title string, h1 string, headings array<struct<level:string,text:string>>, topics array<string>, keywords array<string>"), every=True
    )
    assert [r.phrase for r in rows.orderBy("rank").collect()] == ["red fox", "Red fox", "fox", "red", "Red"]


def test_anchor_types(spark):
    def of(anchor, title="Competitive Intelligence Guide | Site", h1="Competitive Intelligence", topics=("competitive", "intelligence")):
        return one(spark, anchors.anchor_type(F.lit(anchor), F.lit(title), F.lit(h1), F.array(*[F.lit(t) for t in topics])))

    assert of("competitive intelligence") == "exact"
    assert of("intelligence guide") == "partial"
    assert of("one two three four five") == "long-tail"
    assert of("the Acme thing") == "entity"
    assert of("intelligence tools") == "branded"
    assert of("river stones") == "semantic"
    assert of("anything at", h1="") == "partial"  # an empty title is a part of everything


def test_contexts_and_links(spark):
    text = " ".join(f"w{i}" for i in range(20))
    assert one(spark, anchors.word_context(F.lit(text), F.lit("w9 w10"))) == "…w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16…"
    assert one(spark, anchors.word_context(F.lit("a b c"), F.lit("a"))) == "a b c"
    assert one(spark, anchors.word_context(F.lit("abc"), F.lit("b"))) == ""
    assert one(spark, anchors.bracket_context(F.lit(text), F.lit("W9"))) == "…w3 w4 w5 w6 w7 w8 [W9] w10 w11 w12 w13 w14 w15…"
    assert one(spark, anchors.bracket_context(F.lit("a b"), F.lit("zz"))) == "zz"
    assert one(spark, anchors.insert_link(F.lit("See Red Fox here"), F.lit("red fox"), F.lit("http://x/$1"))) == "See [red fox](http://x/$1) here"
    assert one(spark, anchors.insert_link(F.lit("none"), F.lit("red fox"), F.lit("u"))) == "none (See also: [red fox](u))"


def test_scores(spark):
    none = F.array().cast("array<string>")
    points, reason = scoring.anchor_relevance(F.lit("red fox"), F.lit("The Red Fox"), F.lit(""), none, F.lit(""), F.lit(""), F.lit(0))
    assert (one(spark, points), one(spark, reason)) == (3.0, "Anchor closely matches target H1")
    points, reason = scoring.anchor_relevance(F.lit("red fox"), F.lit("Other"), F.lit("x"), F.array(F.lit("a red fox den")), F.lit(""), F.lit(""), F.lit(0))
    assert one(spark, points) == 2.0
    points, _ = scoring.anchor_relevance(F.lit("red fox"), F.lit(""), F.lit("x"), none, F.lit(""), F.lit("red fox"), F.lit(2))
    assert one(spark, points) == 0.5  # two words are never found in an address
    assert one(spark, scoring.score(F.lit(7.5))) == 8 and one(spark, scoring.score(F.lit(-3.0))) == 1 and one(spark, scoring.score(F.lit(12.0))) == 10
    assert one(spark, scoring.penalty_points(F.lit("here"))) == 3.5 and one(spark, scoring.penalty_points(F.lit("abc"))) == 2.5
    assert one(spark, scoring.confidence(F.lit(0.88), F.lit("a b c"), F.lit(10))) == 94
    assert one(spark, semantic.composite(F.lit(3), F.lit(0.1), F.lit(None).cast("int"), F.lit(1))) == 2.9


def test_derived_anchors(spark):
    def of(shared, target):
        return one(spark, semantic.derived_anchor(F.array(*[F.lit(x) for x in shared]).cast("array<string>"), F.array(*[F.lit(x) for x in target]).cast("array<string>")))

    assert of(["b"], ["a", "b", "c"]) == "a b"
    assert of(["zz", "long keyword"], ["a"]) == "long keyword"
    assert of(["zz"], []) == "zz" and of([], ["a", "b"]) is None


def test_repeated_paragraphs(spark):
    def pages(*paragraphs):
        rows = [("s", i, list(p), [0.0] * len(p), len(p)) for i, p in enumerate(paragraphs)]
        return spark.createDataFrame(rows, "site_key string, page_seq long, paragraphs array<string>, paragraph_positions array<double>, paragraph_count int")

    frame, own = "This paragraph stands on every page of the site, word for word, always.", [f"Only page {i} has this paragraph, which is long enough to be counted too." for i in range(3)]
    rows = {r.page_seq: r for r in corpus.drop_repeated(pages(*[(frame, o, "tail") for o in own])).collect()}
    assert all(r.paragraphs == [own[i], "tail"] and r.paragraph_positions == [0.0, 1.0] and r.n_repeated == 1 for i, r in rows.items())
    rows = corpus.drop_repeated(pages((frame,), (frame,), (own[2],))).collect()
    assert Counter(r.n_repeated for r in rows) == {0: 3}
    assert Counter(r.n_repeated for r in corpus.drop_repeated(pages((frame,), (frame,))).collect()) == {0: 2}
