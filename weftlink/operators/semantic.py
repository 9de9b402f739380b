"""One target page: how near every other page of its site is to it, and links where no strict one was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.functions import text as words
from weftlink.functions import urls
from weftlink.operators import anchors
from weftlink.settings import TARGET_PAGE, Settings

#: The least composite score of a fill-in, how many there are, and how many scores are reported.
LEAST_COMPOSITE, MOST_FILL_INS, REPORTED_SCORES = 0.5, 20, 20


def composite(shared: Column, similarity: Column, anchor_score: Column, title_overlap: Column) -> Column:
    """0 to 10, to one place: shared keywords, similarity, the best anchor if there is one, words of the title."""
    parts = F.lit(0.0) + F.least(F.lit(4.0), shared * F.lit(0.4)) + F.least(F.lit(3.0), similarity * F.lit(12.0))
    # least() would pass over a missing score
    parts = parts + F.when(anchor_score.isNotNull(), F.least(F.lit(2.0), anchor_score * F.lit(0.2))).otherwise(F.lit(0.0)) + F.least(F.lit(1.0), title_overlap * F.lit(0.5))
    return words.half_up(parts, 1)


def candidate_scores(pages: DataFrame, target: str, settings: Settings = TARGET_PAGE) -> DataFrame:
    """A row for each other page of the target's site: shared keywords, similarity, best anchor, composite score.

    Order: composite (falling), page_seq.
    """
    goal = pages.where(F.col("normalized_url") == urls.normalize(F.lit(target)))
    texts = anchors.paragraphs(pages)
    best = anchors.best_anchors(texts, goal, settings)
    best = best.groupBy("site_key", "src_seq").agg(F.max_by(F.struct("anchor", "anchor_score", "para_idx"), F.struct("anchor_score", -F.col("para_idx"))).alias("b"))
    one = goal.select(
        "site_key", F.col("normalized_url").alias("_norm"), F.col("url").alias("target_url"), F.col("title").alias("target_title"), F.col("h1").alias("target_h1"),
        F.col("topics").alias("target_topics"), F.col("page_type").alias("target_page_type"), F.col("keywords").alias("target_keywords"),
    )
    rows = pages.join(F.broadcast(one), "site_key").where("normalized_url <> _norm")  # the target is one row
    rows = rows.join(best.select("site_key", F.col("src_seq").alias("page_seq"), "b.*"), ["site_key", "page_seq"], "left")
    title_words = F.filter(words.split_words(F.lower("title")), lambda w: (F.length(w) > 4) & F.array_contains(F.col("target_keywords"), w))
    rows = rows.withColumns(
        {
            "shared_keywords": words.shared_in_order(F.col("keywords"), F.col("target_keywords")),
            "already_links": F.array_contains("existing_links", F.col("_norm")),
            "title_overlap": F.size(title_words),
            "_similarity": words.cosine(F.col("keywords"), F.col("target_keywords")),
        }
    )
    rows = rows.withColumn("composite_score", composite(F.size("shared_keywords"), F.col("_similarity"), F.col("anchor_score"), F.col("title_overlap")))
    return rows.withColumn("cosine_similarity", words.half_up(F.col("_similarity"), 3)).withColumn("anchor_para", F.get("paragraphs", F.col("para_idx"))).select(
        "site_key", "page_seq", "url", "normalized_url", "title", "page_type", "render_method", "extraction_method", "confidence", "paragraphs", "shared_keywords", "cosine_similarity",
        "composite_score", "anchor", "anchor_score", "anchor_para", "already_links", "title_overlap", "target_url", "target_title", "target_h1", "target_topics", "target_page_type", "target_keywords",
    )


def derived_anchor(shared: Column, target_keywords: Column) -> Column:
    """An anchor from keywords: the first two neighbours in the target's list of which one is shared, else a long shared keyword, else the first; null without any."""
    n = F.size(target_keywords)
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.array(F.get(target_keywords, i), F.get(target_keywords, i + 1)))).otherwise(F.array().cast("array<array<string>>"))
    hits = F.filter(pairs, lambda p: F.arrays_overlap(p, shared))
    long = F.filter(shared, lambda k: (F.size(words.split_words(k)) >= 2) | (F.length(k) >= 8))
    found = F.coalesce(F.array_join(F.get(hits, F.lit(0)), " "), F.get(long, F.lit(0)), F.get(shared, F.lit(0)))
    return F.when(F.size(shared) > 0, found)


def semantic_reason(shared: Column, similarity: Column, anchor: Column, title_overlap: Column) -> Column:
    n = F.size(shared).cast("string")
    told = F.array_compact(
        F.array(
            F.when(F.size(shared) > 0, F.concat(n, F.lit(" shared keywords: "), F.array_join(F.slice(shared, 1, 5), ", "))),
            F.when(similarity > 0, F.concat(F.lit("semantic similarity: "), F.format_number(similarity * 100, 1), F.lit("%"))),
            F.when(anchor.isNotNull(), F.concat(F.lit('natural anchor "'), anchor, F.lit('" found in body content'))),
            F.when(title_overlap > 0, F.concat(title_overlap.cast("string"), F.lit(" target keyword(s) in source title"))),
        )
    )
    return F.when(F.size(told) > 0, F.array_join(told, "; ")).otherwise("Low semantic overlap — marginal candidate")


def fill_ins(scores: DataFrame, strict: DataFrame) -> DataFrame:
    """Links from the nearest pages that neither link to the target nor have a strict suggestion (source_norm); 20 at most."""
    known = strict.select(F.col("source_norm").alias("normalized_url")).distinct()
    rows = scores.where(~F.col("already_links") & (F.col("composite_score") >= LEAST_COMPOSITE)).join(known, "normalized_url", "left_anti")
    para = F.coalesce("anchor_para", F.get("paragraphs", F.lit(0)), F.when(F.col("title") != "", F.col("title")))
    title = F.coalesce(F.when(F.col("target_h1") != "", F.col("target_h1")), "target_title", F.lit(""))
    lead = F.array_join(F.slice(words.split_words(words.trim(F.regexp_replace(title, anchors.SITE_NAME, ""))), 1, 4), " ")
    rows = rows.withColumn("_para", para).withColumn("_anchor", F.coalesce("anchor", derived_anchor(F.col("shared_keywords"), F.col("target_keywords")), F.when(lead != "", lead)))
    rows = rows.where("_para IS NOT NULL AND _anchor IS NOT NULL").orderBy(F.desc("composite_score"), "page_seq").limit(MOST_FILL_INS)
    p, a, own, points = F.col("_para"), F.col("_anchor"), F.col("anchor").isNotNull(), F.col("composite_score")
    link = F.concat(F.lit("["), a, F.lit("]("), F.col("target_url"), F.lit(")"))
    at = F.instr(p, a)
    linked = F.when(at > 0, F.concat(F.substr(p, F.lit(1), at - 1), link, F.substr(p, at + F.length(a)))).otherwise(p)
    trust = words.half_up(F.coalesce("confidence", F.lit(0.5)) * 100).cast("string")
    return rows.select(
        "site_key", F.col("page_seq").alias("src_seq"), F.col("normalized_url").alias("source_norm"), F.col("url").alias("source_url"), "target_url", F.col("title").alias("source_title"), "target_title",
        F.col("page_type").alias("source_page_type"), "target_page_type", F.concat("page_type", F.lit("-to-"), "target_page_type").alias("link_type"), p.alias("existing_paragraph"), a.alias("suggested_anchor"),
        F.when(own, anchors.bracket_context(p, a)).otherwise(F.concat(F.lit("…"), F.array_join(F.slice(words.split_words(p), 1, 10), " "), F.lit("…"))).alias("anchor_context"),
        F.when(own, anchors.anchor_type(a, F.col("target_title"), F.col("target_h1"), F.col("target_topics"))).otherwise("semantic").alias("anchor_type"),
        F.when(own, linked).otherwise(F.concat(p, F.lit("\n\n(Consider adding a link to: "), link, F.lit(")"))).alias("updated_paragraph"),
        semantic_reason(F.col("shared_keywords"), F.col("cosine_similarity"), F.col("anchor"), F.col("title_overlap")).alias("reason"),
        F.concat(F.lit('Paragraph extracted via "'), "extraction_method", F.lit('" ('), trust, F.lit("% confidence)")).alias("body_content_reason"), "render_method",
        F.when(own, F.array().cast("array<string>")).otherwise(F.array(F.lit("No verbatim anchor found — suggested anchor requires minor content edit"))).alias("warnings"),
        F.slice("shared_keywords", 1, 15).alias("shared_keywords"), F.lit(0.5).alias("para_position"), F.lit("Middle").alias("para_position_label"), words.half_up(points).cast("int").alias("score"),
        words.half_up(F.col("cosine_similarity") * 100).cast("int").alias("confidence"), F.when(points >= 5, "High").when(points >= 2.5, "Medium").otherwise("Low").alias("priority"),
        F.when(own, "natural").otherwise("semantic").alias("opportunity_type"), F.lit("main-body").alias("source_type"), points,
    )


def no_result_reason(scores: DataFrame, log: DataFrame, min_score: int) -> DataFrame:
    """One row (reason): why a target has no suggestion at all."""
    seen = scores.agg(
        F.count("*").alias("n"), F.coalesce(F.bool_and("already_links"), F.lit(True)).alias("linked"), F.coalesce(F.bool_and(F.col("composite_score") < 1), F.lit(True)).alias("low"), F.coalesce(F.max("composite_score"), F.lit(0.0)).alias("top")
    )
    counts = log.agg(F.count_if("js_detected").alias("js"), F.count_if(F.col("status").startswith("failed:render")).alias("render"), F.count_if(F.col("status").startswith("failed:") & ~F.col("status").startswith("failed:render")).alias("fetch"))
    text = (
        F.when(F.col("n") == 0, F.concat(F.lit("No source pages yielded valid body content ("), F.col("js").cast("string"), F.lit(" JS-rendered, "), F.col("render").cast("string"), F.lit(" render failures, "), F.col("fetch").cast("string"), F.lit(" fetch failures).")))
        .when(F.col("linked"), F.lit("All fetched pages already link to the target page."))
        .when(F.col("low"), F.concat(F.lit("All "), F.col("n").cast("string"), F.lit(" pages scored below 1/10 — target content may be very different from the rest of the site.")))
        .otherwise(F.concat(F.lit(f"Scores found but all below minimum threshold ({min_score}/10). Highest: "), F.format_number("top", 1), F.lit(".")))
    )
    return seen.join(F.broadcast(counts)).select(text.alias("reason"))
