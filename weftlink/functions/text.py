"""Column expressions for words, keywords and topics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.lexicon import STOPWORDS

#: White space as web pages know it; a plain \s is ASCII only here.
SPACE = r"\s" + "".join(map(chr, (0x0B, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
#: What a second occurrence of a pair of words adds to its weight.
PAIR_WEIGHT = 0.65


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, also where the optimizer puts the whole into a filter or a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return trim(F.regexp_replace(x, f"[{SPACE}]+", " "))


def split_words(x: Column) -> Column:
    """The parts between white space; empty ones at the ends count."""
    return F.split(x, f"[{SPACE}]+", -1)


def word_count(x: Column) -> Column:
    return F.size(split_words(x))


def _long(words: Column, least: int, numbers: bool) -> Column:
    def kept(w: Column) -> Column:
        told = (F.length(w) >= least) & ~w.isin(*STOPWORDS)
        return told if numbers else told & ~w.rlike("^[0-9]+$")

    return F.filter(words, kept)


def keyword_words(text: Column) -> Column:
    """Words that may be keywords, in order: of four characters at least, no stop words, no numbers."""
    return _long(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s'-]", " "), r"\s+", -1), 4, False)


def paragraph_keywords(text: Column) -> Column:
    """The first 60 such words of a paragraph, repeats included; apostrophes and hyphens part words."""
    return F.slice(_long(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", -1), 4, False), 1, 60)


def topics(title: Column, h1: Column, headings: Column, meta: Column) -> Column:
    """The first 40 words of five characters at least of a page's titles and description, repeats and numbers included."""
    joined = F.concat_ws(" ", F.concat(F.array(title, h1), headings, F.array(meta)))
    return F.slice(_long(F.split(F.regexp_replace(F.lower(joined), r"[^a-z0-9\s]", " "), r"\s+", -1), 5, True), 1, 40)


def repeated_sum(n: Column, step: float) -> Column:
    """step added n times, one addition after the other: a product would round otherwise, and ties would fall otherwise."""
    return F.when(n == 1, F.lit(step)).otherwise(F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda acc, _: acc + F.lit(step)))


def keyword_terms(words: Column) -> Column:
    """The words and the pairs of neighbours among them as (term, pair, pos)."""

    def terms(w: Column) -> Column:
        ones = F.transform(w, lambda x, i: F.struct(x.alias("term"), F.lit(0).alias("pair"), i.alias("pos")))
        at = F.sequence(F.lit(0), F.size(w) - 2)
        twos = F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)).alias("term"), F.lit(1).alias("pair"), i.alias("pos")))
        return F.when(F.size(w) >= 2, F.concat(ones, twos)).otherwise(ones)

    return let(words, terms)


def ranked_keywords(pages: DataFrame, key: str, text: Column, top: int = 100) -> DataFrame:
    """(key, term, weight, rank) of the `top` keywords of each row of pages, which is unique by key.

    A word weighs 1 for each occurrence, a pair of neighbouring words 0.65. Equal weights: words before pairs, then by first occurrence.
    Rows are dealt by key before their terms are made: counting and ranking then need no shuffle of terms.
    """
    terms = pages.select(key, text.alias("_text")).repartition(key).select(key, F.explode_outer(keyword_terms(keyword_words(F.col("_text")))).alias("t")).where("t IS NOT NULL").select(key, "t.*")
    counted = terms.groupBy(key, "term").agg(F.count("*").alias("n"), F.min(F.struct("pair", "pos")).alias("first"))
    weight = F.when(F.col("first.pair") == 0, F.col("n").cast("double")).otherwise(repeated_sum(F.col("n"), PAIR_WEIGHT))
    order = Window.partitionBy(key).orderBy(F.desc("weight"), "first")
    return counted.withColumn("weight", weight).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(key, "term", "weight", "rank")


def keyword_lists(pages: DataFrame, key: str, text: Column, top: int = 100) -> DataFrame:
    """(key, keywords): the ranked terms of each row that has any."""
    listed = ranked_keywords(pages, key, text, top).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k"))
    return listed.select(key, F.col("k.term").alias("keywords"))


def shared_in_order(ours: Column, theirs: Column) -> Column:
    """Terms of ours, distinct, that theirs has too, in the order of ours."""
    return F.array_intersect(ours, theirs)


def cosine(ours: Column, theirs: Column) -> Column:
    """The share of ours, repeats included, that theirs has, over the root of both sizes' product; 0 for an empty list."""
    common = F.size(F.filter(ours, lambda w: F.array_contains(theirs, w)))
    return F.when((F.size(ours) > 0) & (F.size(theirs) > 0), common / F.sqrt(F.size(ours).cast("double") * F.size(theirs))).otherwise(F.lit(0.0))


def half_up(x: Column, places: int = 0) -> Column:
    """x rounded with halves going up."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale if places else F.floor(x + 0.5)
