"""All pages of a site against one target page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions import text as words
from weftlink.functions import urls
from weftlink.lineage import cut_table
from weftlink.operators import semantic
from weftlink.plans import site
from weftlink.settings import TARGET_PAGE, Settings


@dataclass
class TargetAnalysis:
    """scores: a row for each other page; opportunities: strict ones and fill-ins; diagnostics: one row."""

    crawl: site.Crawl
    pages: DataFrame
    scores: DataFrame
    opportunities: DataFrame
    diagnostics: DataFrame


def target_pages(raw: DataFrame, target: str, settings: Settings = TARGET_PAGE) -> tuple[site.Crawl, DataFrame]:
    """The crawl of the target's site among raw (page_id, url, html), and its completed pages, written."""
    own = raw.where(urls.site_key(F.col("url")) == urls.site_key(F.lit(target)))
    found = site.crawl(own, settings, target)
    goal = F.col("normalized_url") == urls.normalize(F.lit(target))
    # the target comes last, whatever its id
    ordered = found.pages.withColumn("page_seq", F.when(goal, F.lit((1 << 62) - 1)).otherwise(F.col("page_seq")))
    return found, cut_table(site.complete(ordered))


def analyze_target(raw: DataFrame, target: str, settings: Settings = TARGET_PAGE) -> TargetAnalysis:
    """Links to `target` from the pages of its site among raw (page_id, url, html).

    Strict suggestions are those that the analysis of the whole site makes for the target: links between other pages
    use up their sources' caps too. Pages without one are filled in by nearness.
    """
    found, pages = target_pages(raw, target, settings)
    goal = pages.where(F.col("normalized_url") == urls.normalize(F.lit(target))).select("site_key", F.col("page_seq").alias("tgt_seq"))
    theirs = cut_table(site.suggested(pages, settings).join(goal, ["site_key", "tgt_seq"], "left_semi"))
    strict = cut_table(site.describe(theirs, pages))
    scores = cut_table(semantic.candidate_scores(pages, target, settings))
    extra = semantic.fill_ins(scores, strict)
    made = strict.drop("tgt_seq", "target_norm").withColumn("_kind", F.lit(0)).unionByName(extra.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    made = cut_table(made)
    return TargetAnalysis(found, pages, scores, made.drop("_kind"), diagnostics(found, scores, strict, made, settings))


def top_scores(scores: DataFrame) -> DataFrame:
    """The first 20 candidates by composite score, as they are reported."""
    ranked = scores.orderBy(F.desc("composite_score"), "page_seq").limit(semantic.REPORTED_SCORES)
    return ranked.select("url", "title", F.col("composite_score").alias("score"), F.size("shared_keywords").alias("shared_kws"), F.col("cosine_similarity").alias("cos_sim"), F.col("anchor").isNotNull().alias("has_anchor"), "anchor", "already_links")


def diagnostics(found: site.Crawl, scores: DataFrame, strict: DataFrame, made: DataFrame, settings: Settings) -> DataFrame:
    """One row of counts, and the reason where nothing is suggested."""
    log = found.fetch_log
    counts = log.agg(
        F.count_if(F.col("status") == "success:raw").alias("raw_fetched"),
        F.count_if("js_detected").alias("js_detected"),
        F.count_if(F.col("status") == "success:rendered").alias("rendered"),
        F.count_if(F.col("status").startswith("failed:render")).alias("render_failed"),
        F.count_if(F.col("status").startswith("failed:") & ~F.col("status").startswith("failed:render")).alias("fetch_failed"),
        F.count_if(F.col("status").startswith("no-body-content")).alias("no_body_content"),
    )
    total = made.agg(
        F.count("*").alias("opps_after_filter"),
        F.count_if(F.col("_kind") == 0).alias("opps_before_filter"),
        F.count_if(F.col("_kind") == 1).alias("semantic_opps"),
        F.coalesce(words.half_up(F.avg("score"), 1), F.lit(0.0)).alias("average_score"),
        F.coalesce(F.max("score"), F.lit(0)).alias("highest_score"),
    )
    one = counts
    for part in (scores.agg(F.count("*").alias("scored_pairs")), total, semantic.no_result_reason(scores, log, settings.min_score)):  # each has one row
        one = one.join(F.broadcast(part))
    return one.withColumn("zero_opp_reason", F.when(F.col("opps_after_filter") == 0, F.col("reason"))).drop("reason")
