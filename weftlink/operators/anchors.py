"""Phrases of a target page that stand in the paragraphs of other pages of its site.

Phrases and paragraphs meet by all runs of letters and digits of a phrase (of a very long one by the first), which a
paragraph that has the phrase has too, one after the other; only then is the phrase itself looked for, with what stands
between its runs. A phrase is matched once for a site, whichever pages it stands for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.lexicon import GENERIC_ANCHORS, GENERIC_WORD_PATTERNS, GENERIC_WORDS, STOPWORDS
from weftlink.functions.text import let, split_words, trim
from weftlink.lineage import cut_lineage, cut_table
from weftlink.settings import CORE, Settings

_SIDE = "a-zA-Z0-9À-ɏ"
_ASCII_SIDE = "a-zA-Z0-9"
#: What follows the first bar or dash of a title names the site.
SITE_NAME = "[|\\-–—].*$"


def bounded_pattern(phrase: Column, ascii_only: bool = False) -> Column:
    """A pattern for the phrase, of any case, with no letter or digit on either side."""
    side = _ASCII_SIDE if ascii_only else _SIDE
    literal = F.concat(F.lit(r"\Q"), F.regexp_replace(phrase, r"\\E", r"\\\\E\\\\\\\\E\\\\Q"), F.lit(r"\E"))
    fold = "iu" if ascii_only else "i"
    return F.concat(F.lit(f"(?{fold})(?<![{side}])("), literal, F.lit(f")(?![{side}])"))


def bounded_phrase(text: Column, phrase: Column, ascii_only: bool = False) -> Column:
    """The phrase as text has it first, between other characters than letters and digits; null if it does not, or for a phrase of one character."""
    found = F.call_function("regexp_extract", text, bounded_pattern(phrase, ascii_only), F.lit(1))
    return F.when((F.length(phrase) >= 2) & (found != ""), found)


def _words(x: Column) -> Column:
    return F.filter(split_words(trim(x)), lambda w: w != "")


def is_generic_word(word: Column) -> Column:
    low = F.lower(word)
    return reduce(lambda a, p: a | low.rlike(p), GENERIC_WORD_PATTERNS, low.isin(*GENERIC_WORDS))


def is_generic_anchor(phrase: Column, min_words: int = 2, allow_single_word: bool = False) -> Column:
    """Whether a phrase is no anchor: empty, a single word unless such are allowed and it says something, or of too few words."""
    words = _words(F.coalesce(phrase, F.lit("")))
    single = is_generic_word(F.get(words, F.lit(0))) if allow_single_word else F.lit(True)
    return F.when(F.size(words) == 0, True).when(F.size(words) == 1, single).otherwise(F.size(words) < min_words)


def ngrams(tokens: Column, most: int, least: int = 1) -> Column:
    """All runs of least to most tokens, joined by blanks."""
    n = F.size(tokens)
    lengths = F.sequence(F.lit(least), F.least(F.lit(most), n))
    runs = F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda s: F.array_join(F.slice(tokens, s, k), " ")))
    return F.when(n >= least, F.flatten(runs)).otherwise(F.array().cast("array<string>"))


def phrases_of(sources: Column, most: int = 7, least: int = 1) -> Column:
    """The distinct phrases of an array of titles, headings and keywords."""

    def tokens(s: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(s, SITE_NAME, ""), r"[^a-zA-Z0-9_\s'-]", " ")
        return F.filter(F.split(clean, r"\s+"), lambda t: F.length(t) > 1)

    every = F.flatten(F.transform(F.transform(F.filter(sources, lambda s: s.isNotNull()), tokens), lambda t: ngrams(t, most, least)))
    return F.array_distinct(F.filter(every, lambda p: F.length(p) >= 3))


def page_sources(custom_topics: tuple[str, ...] = ()) -> Column:
    """Where a page's phrases come from: title, h1, headings, topics, its first 30 keywords, and the caller's own."""
    own = F.array(*[F.lit(t) for t in custom_topics]) if custom_topics else F.array().cast("array<string>")
    return F.concat(F.array("title", "h1"), F.col("headings.text"), F.col("topics"), F.slice("keywords", 1, 30), own)


def candidates(pages: DataFrame, settings: Settings = CORE, every: bool = False, ranked: bool = True) -> DataFrame:
    """(site_key, page_seq, phrase, words, rank) of each page's phrases, longest first, then in the order of the Unicode collation.

    Without `every`, phrases that are no anchors are left out, which leaves the order of the others as it is. Without `ranked` there is no rank.
    """
    least = 1 if every or settings.allow_single_word else max(2, settings.min_anchor_words)
    phrases = F.explode_outer(phrases_of(page_sources(settings.custom_topics), settings.max_phrase_words, least)).alias("phrase")
    rows = pages.select("site_key", "page_seq", phrases).where("phrase IS NOT NULL")
    rows = rows.withColumn("words", F.size(F.split("phrase", " ")))
    if not every:
        rows = rows.where(~is_generic_anchor(F.col("phrase"), settings.min_anchor_words, settings.allow_single_word))
    if not ranked:
        return rows
    order = Window.partitionBy("site_key", "page_seq").orderBy(F.desc("words"), F.collate("phrase", "UNICODE"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(site_key, page_seq, para_idx, text, position) of each paragraph."""
    each = F.posexplode(F.arrays_zip(F.col("paragraphs").alias("text"), F.col("paragraph_positions").alias("position"))).alias("para_idx", "p")
    return pages.select("site_key", "page_seq", each).select("site_key", "page_seq", "para_idx", "p.text", "p.position")


def anchor_quality(phrase: Column, text: Column, offset: Column) -> Column:
    """0 to 10: length in words, words that say something, place in the paragraph, a capital inside."""

    def of(words: Column) -> Column:
        n = F.size(words)
        length = F.when(n == 1, 0).when(n == 2, 2).when(n == 3, 3).when(n <= 6, 4).otherwise(3)
        capital = F.exists(F.slice(words, 2, F.greatest(n, F.lit(1))), lambda w: w.rlike("^[A-Z]")).cast("int")
        vague = F.size(F.filter(words, lambda w: F.lower(w).isin(*GENERIC_WORDS)))
        telling = let(vague, lambda v: F.when((n == 1) & (v > 0), 0).when(n == 1, 1).otherwise(F.greatest(F.lit(0), 3 - v)))
        return length + telling + capital

    share = F.when(F.length(text) > 0, offset / F.length(text)).otherwise(F.lit(0.5))
    early = F.when(share < 0.33, 2).when(share < 0.66, 1).otherwise(0)
    return F.least(F.lit(10), let(split_words(trim(phrase)), of) + early)


def _runs(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(f"[{_SIDE}]+"), F.lit(0)), lambda r: F.lower(r))


#: Runs by which a phrase meets a text at most; of a longer phrase the first ones.
MOST_RUNS = 8
#: Keys of phrases that are broadcast at most, of 8 bytes each; beyond that texts and phrases meet by a shuffle.
BROADCAST_KEYS = 500_000


def phrase_matches(texts: DataFrame, phrases: DataFrame, keep: list[str], broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(site_key, *keep, phrase, anchor, char_offset, anchor_score) for each phrase of its site that a text has.

    texts: (site_key, *keep, text), unique by site_key and keep; phrases: (site_key, phrase). Where phrases, then unique,
    have `only`, a phrase is not looked for in the texts of the page src_seq that it names.
    """

    def key(runs: Column) -> Column:
        return F.xxhash64("site_key", runs)

    heads = phrases if "only" in phrases.columns else phrases.select("site_key", "phrase", F.lit(None).cast("long").alias("only")).distinct()
    heads = heads.withColumn("runs", _runs(F.col("phrase")))
    heads = cut_table(heads.select("site_key", "phrase", "only", F.when(F.size("runs") > 0, key(F.slice("runs", 1, MOST_RUNS))).alias("key")))
    known = heads.where("key IS NOT NULL").drop_duplicates(["key"]).select("key")

    def keys(runs: Column) -> Column:
        n = F.size(runs)
        every = F.transform(F.sequence(F.lit(1), F.least(F.lit(MOST_RUNS), n)), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: key(F.slice(runs, i, k))))
        return F.when(n > 0, F.array_distinct(F.flatten(every)))

    # this is all CPU: it gets the session's number of shuffle partitions, not as few as the bytes would fill
    texts = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "site_key", *keep)
    # the texts stay behind while runs meet phrases, and join again by their keys
    listed = texts.select("site_key", *keep, F.explode_outer(let(_runs(F.col("text")), keys)).alias("key"))
    if known.count() <= broadcast_keys:  # few of a text's keys are a phrase's: those alone are moved
        listed = listed.join(F.broadcast(known), "key", "left_semi")
    abroad = F.lit(True) if "src_seq" not in keep else F.col("only").isNull() | (F.col("only") != F.col("src_seq"))
    met_some = listed.join(heads, ["site_key", "key"]).where(abroad)
    # phrases without a run are few: marks only
    others = heads.where("key IS NULL").withColumn("head", F.substring(F.lower("phrase"), 1, 2))
    marks = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"(?s)(?=([^{_SIDE}]{{2}}))"), F.lit(1)))
    met_none = texts.select("site_key", *keep, F.explode_outer(marks).alias("head")).join(others, ["site_key", "head"]).where(abroad)
    columns = ["site_key", *keep, "phrase"]
    met = met_some.select(columns).unionByName(met_none.select(columns))
    met = met.join(texts.select("site_key", *keep, "text"), ["site_key", *keep])
    found = met.withColumn("anchor", bounded_phrase(F.col("text"), F.col("phrase"))).where("anchor IS NOT NULL")
    found = found.withColumn("char_offset", F.instr(F.lower("text"), F.lower("anchor")) - 1)
    found = found.withColumn("char_offset", F.greatest("char_offset", F.lit(0)))
    return found.withColumn("anchor_score", anchor_quality(F.col("anchor"), F.col("text"), F.col("char_offset"))).drop("text")


def best_anchors(texts: DataFrame, targets: DataFrame, settings: Settings = CORE) -> DataFrame:
    """(site_key, src_seq, para_idx, tgt_seq, anchor, char_offset, anchor_score): for each paragraph and target page with any, the best anchor.

    texts: paragraphs(); targets: pages. The first of a target's phrases with the highest score is taken.
    """
    own = candidates(targets, settings)
    matches = phrase_matches(texts.withColumnRenamed("page_seq", "src_seq"), own, ["src_seq", "para_idx"])
    met = matches.join(own.select("site_key", F.col("page_seq").alias("tgt_seq"), "phrase", "rank"), ["site_key", "phrase"]).where("src_seq <> tgt_seq")
    best = F.max_by(F.struct("anchor", "char_offset", "anchor_score"), F.struct("anchor_score", -F.col("rank"))).alias("b")
    return met.groupBy("site_key", "src_seq", "para_idx", "tgt_seq").agg(best).select("site_key", "src_seq", "para_idx", "tgt_seq", "b.*")


def numbered_matches(texts: DataFrame, targets: DataFrame, settings: Settings = CORE) -> tuple[DataFrame, DataFrame]:
    """What best_anchors() is made of, without the pairs: (site_key, src_seq, hits), and (site_key, id, pages) of each phrase that is met.

    hits are (para_idx, id, anchor) of a page's paragraphs, in each by falling anchor_score and then in the order of
    candidates(): the first whose phrase a target has is that target's best anchor. A page's own phrases that no other page has are left out.
    """
    own = candidates(targets, settings, ranked=False)
    phrases = own.groupBy("site_key", "phrase").agg(F.when(F.count("*") == 1, F.min("page_seq")).alias("only"))
    matches = phrase_matches(texts.withColumnRenamed("page_seq", "src_seq"), phrases, ["src_seq", "para_idx"])
    order = F.struct("para_idx", (-F.col("anchor_score")).alias("a"), (-F.size(F.split("phrase", " "))).alias("w"), F.collate("phrase", "UNICODE").alias("c"), "phrase", "id", "anchor")
    matches = cut_table(matches.withColumn("id", F.xxhash64("phrase")).select("site_key", "src_seq", "para_idx", "anchor_score", "phrase", "id", "anchor"))
    hits = matches.groupBy("site_key", "src_seq").agg(F.sort_array(F.collect_list(order)).alias("h"))
    hits = hits.select("site_key", "src_seq", F.transform("h", lambda h: F.struct(h["para_idx"].alias("para_idx"), h["id"].alias("id"), h["anchor"].alias("anchor"))).alias("hits"))
    met = own.join(matches.select("site_key", "phrase", "id").distinct(), ["site_key", "phrase"])
    return hits, met.groupBy("site_key", "id").agg(F.sort_array(F.collect_list("page_seq")).alias("pages"))


def bare_title(title: Column) -> Column:
    """A title in small letters without the site's name."""
    return trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), SITE_NAME, ""))


def anchor_type(anchor: Column, title: Column, h1: Column, topics: Column) -> Column:
    """exact, partial, entity, branded, semantic or long-tail: how an anchor stands to its target's titles and topics."""
    known = F.struct(trim(F.lower(anchor)).alias("low"), bare_title(title).alias("t"), trim(F.lower(F.coalesce(h1, F.lit("")))).alias("h"), split_words(trim(anchor)).alias("words"))

    def of(x: Column) -> Column:
        low, t, h, words = x["low"], x["t"], x["h"], x["words"]
        capital = F.exists(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: w.rlike("^[A-Z]"))
        branded = F.exists(topics, lambda k: low.contains(F.lower(k)) | F.lower(k).contains(low))
        out = F.when(F.size(words) >= 5, F.lit("long-tail")).when((low == t) | (low == h), F.lit("exact"))
        out = out.when(t.contains(low) | h.contains(low) | low.contains(t) | low.contains(h), F.lit("partial"))
        return out.when(capital, F.lit("entity")).when(branded, F.lit("branded")).otherwise(F.lit("semantic"))

    return F.when(F.coalesce(anchor, F.lit("")) == "", F.lit("semantic")).otherwise(let(known, of))


def word_context(text: Column, anchor: Column, around: int = 6) -> Column:
    """The words of a squeezed text around the anchor's first bounded place; empty without one."""
    at = F.regexp_instr(text, bounded_pattern(anchor, ascii_only=True)) - 1
    known = F.struct(text.alias("text"), at.alias("at"), split_words(text).alias("words"))

    def of(x: Column) -> Column:
        n, at = F.size(x["words"]), x["at"]
        before = F.when(at > 0, 1 + F.length(F.regexp_replace(F.substr(x["text"], F.lit(1), at - 1), "[^ ]", ""))).otherwise(F.lit(0))

        def cut(first: Column) -> Column:
            bounds = F.struct(F.greatest(F.lit(0), first - around).alias("a"), F.least(n, first + F.size(split_words(anchor)) + around).alias("b"))

            def shown(y: Column) -> Column:
                lead, tail = F.when(y["a"] > 0, F.lit("…")).otherwise(F.lit("")), F.when(y["b"] < n, F.lit("…")).otherwise(F.lit(""))
                return F.concat(lead, F.array_join(F.slice(x["words"], y["a"] + 1, y["b"] - y["a"]), " "), tail)

            return let(bounds, shown)

        return F.when(at >= 0, let(let(before, lambda w: F.when(w < n, w).otherwise(F.lit(0))), cut)).otherwise(F.lit(""))

    return F.when(anchor != "", let(known, of)).otherwise(F.lit(""))


def bracket_context(text: Column, anchor: Column, around: int = 6) -> Column:
    """The words around the anchor's first place, the anchor in brackets; the anchor alone if it has no place."""

    def of(at: Column) -> Column:
        before, after = _words(F.substr(text, F.lit(1), at - 1)), _words(F.substr(text, at + F.length(anchor)))
        pre = let(before, lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - around, F.lit(0)) + 1, F.lit(around)), " "))
        post = F.array_join(F.slice(after, 1, around), " ")
        lead = let(pre, lambda p: F.when(p != "", F.concat(F.lit("…"), p, F.lit(" "))).otherwise(F.lit("")))
        tail = let(post, lambda p: F.when(p != "", F.concat(F.lit(" "), p, F.lit("…"))).otherwise(F.lit("")))
        return F.when(at > 0, F.concat(lead, F.lit("["), anchor, F.lit("]"), tail)).otherwise(anchor)

    empty = (F.coalesce(text, F.lit("")) == "") | (F.coalesce(anchor, F.lit("")) == "")
    return F.when(empty, F.lit("")).otherwise(let(F.instr(F.lower(text), F.lower(anchor)), of))


def insert_link(text: Column, anchor: Column, url: Column) -> Column:
    """text with its first such phrase as a Markdown link; the link at its end if it has none. The address is put in as it is."""
    at = F.instr(F.lower(text), F.lower(anchor))
    link = F.concat(F.lit("["), anchor, F.lit("]("), url, F.lit(")"))
    inside = F.concat(F.substr(text, F.lit(1), at - 1), link, F.substr(text, at + F.length(anchor)))
    return F.when(at > 0, inside).otherwise(F.concat(text, F.lit(" (See also: "), link, F.lit(")")))


def natural_anchors(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """(site_key, src_seq, para_idx, tgt_seq, anchor): the first of a target's titles, or part of one, that a paragraph has.

    Titles are h1, title, second headings and 20 topics, the longest first; each is tried whole, then in runs of five
    down to two of its telling words. Sides are ASCII letters and digits.
    """
    h2 = F.filter("headings", lambda h: h["level"] == "H2")["text"]
    titles = F.concat(F.array("h1", "title"), h2, F.slice("topics", 1, 20))
    squeezed = F.transform(titles, lambda t: trim(F.regexp_replace(t, r"\s+", " ")))
    kept = F.filter(squeezed, lambda t: (F.length(t) > 4) & ~F.lower(t).isin(*GENERIC_ANCHORS))
    longest = F.sort_array(F.transform(kept, lambda t, at: F.struct((-F.length(t)).alias("size"), at.alias("at"), t.alias("whole"))))

    def parts(whole: Column) -> Column:
        words = F.filter(F.split(F.lower(whole), " "), lambda w: (F.length(w) > 3) & ~w.isin(*STOPWORDS))

        def runs(w: Column) -> Column:
            n = F.size(w)
            every = F.transform(F.sequence(F.least(n, F.lit(5)), F.lit(2)), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda s: F.array_join(F.slice(w, s, k), " ")))
            return F.when(n >= 2, F.filter(F.flatten(every), lambda p: ~p.isin(*GENERIC_ANCHORS))).otherwise(F.array().cast("array<string>"))

        return let(words, runs)

    tried = F.flatten(F.transform(longest, lambda t: F.concat(F.array(t["whole"]), parts(t["whole"]))))
    # a phrase's place in the order is its first one; place and match travel as one number, which a hash aggregate can take the least of
    rows = cut_lineage(targets.select("site_key", F.col("page_seq").alias("tgt_seq"), F.posexplode(F.array_distinct(tried)).alias("place", "phrase")))
    near = phrase_matches_ascii(texts.withColumnRenamed("page_seq", "src_seq"), rows.select("site_key", "phrase").distinct(), ["src_seq", "para_idx"])
    para = ["site_key", "src_seq", "para_idx"]
    hits = cut_lineage(near.groupBy(*para).agg(F.sort_array(F.collect_list(F.struct("phrase", "anchor"))).alias("hits")))
    each = hits.select(*para, F.posexplode("hits.phrase").alias("hit", "phrase"))
    met = each.join(rows, ["site_key", "phrase"]).where("src_seq <> tgt_seq")
    first = F.min(F.shiftleft(F.col("place").cast("long"), 32) + F.col("hit")).alias("first")
    best = met.groupBy(*para, "tgt_seq").agg(first).withColumn("hit", F.col("first").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    return best.join(hits.select(*para, F.col("hits.anchor").alias("anchors")), para).select(*para, "tgt_seq", F.get("anchors", F.col("hit")).alias("anchor"))


#: Letters and digits of ASCII, and the four letters that equal one of them whatever the case.
_ASCII_RUN = f"[{_ASCII_SIDE}\u212a\u017f\u0130\u0131]+"


def _ascii_key(run: Column) -> Column:
    return F.lower(F.translate(run, "\u212a\u017f\u0130\u0131", "ksii"))


def phrase_matches_ascii(texts: DataFrame, phrases: DataFrame, keep: list[str]) -> DataFrame:
    """(site_key, *keep, phrase, anchor) with ASCII sides. texts are unique by site_key and keep, phrases distinct.

    A phrase meets a text by its first two ASCII runs, which stand there one after the other, by its only one, or without
    one by its first four characters. A phrase that is one ASCII run needs no search: where the run is, it is.
    """
    runs = F.regexp_extract_all("phrase", F.lit(_ASCII_RUN), F.lit(0))
    heads = phrases.select("site_key", "phrase", F.transform(runs, _ascii_key).alias("runs"), F.col("phrase").rlike(f"^[{_ASCII_SIDE}]{{2,}}$").alias("sure"))
    listed = texts.select("site_key", *keep, F.regexp_extract_all("text", F.lit(_ASCII_RUN), F.lit(0)).alias("runs"))

    def firsts(sorted_runs: Column) -> Column:
        return F.filter(sorted_runs, lambda x, i: (i == 0) | (F.get(sorted_runs, i - 1)["r"] != x["r"]))

    placed = F.sort_array(F.transform("runs", lambda r, i: F.struct(_ascii_key(r).alias("r"), i.alias("i"), r.alias("anchor"))))
    ones = listed.select("site_key", *keep, F.explode(let(placed, firsts)).alias("x")).select("site_key", *keep, "x.r", "x.anchor")
    single = heads.where(F.size("runs") == 1).select("site_key", "phrase", F.get("runs", F.lit(0)).alias("r"), "sure")
    columns = ["site_key", *keep, "phrase"]
    sure = ones.join(single.where("sure").drop("sure"), ["site_key", "r"]).select(*columns, "anchor")
    met = ones.join(single.where("NOT sure").drop("sure"), ["site_key", "r"]).select(columns)

    def neighbours(keys: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(keys) - 1), lambda i: F.concat(F.get(keys, i - 1), F.lit(" "), F.get(keys, i))))

    twos = listed.where(F.size("runs") > 1).select("site_key", *keep, F.explode(let(F.transform("runs", _ascii_key), neighbours)).alias("r"))
    double = heads.where(F.size("runs") > 1).select("site_key", "phrase", F.concat(F.get("runs", F.lit(0)), F.lit(" "), F.get("runs", F.lit(1))).alias("r"))
    met = met.unionByName(twos.join(double, ["site_key", "r"]).select(columns))
    # sides are ASCII, so a phrase without a run may begin inside a word of another script
    fours = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"(?s)(?=([^{_ASCII_SIDE}]{{4}}))"), F.lit(1)))
    others = heads.where(F.size("runs") == 0).select("site_key", "phrase", F.substring(F.lower("phrase"), 1, 4).alias("r"))
    met = met.unionByName(texts.select("site_key", *keep, F.explode(fours).alias("r")).join(others, ["site_key", "r"]).select(columns))
    # the texts stay behind while runs meet phrases, and join again by their keys
    found = met.join(texts.select("site_key", *keep, "text"), ["site_key", *keep]).withColumn("anchor", bounded_phrase(F.col("text"), F.col("phrase"), ascii_only=True))
    return found.where("anchor IS NOT NULL").select(*columns, "anchor").unionByName(sure)
