"""Scores of link opportunities, and the words that explain them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlink.functions.lexicon import GENERIC_ANCHORS, MONEY_TYPES
from weftlink.functions.text import half_up, trim


def _lead(text: Column, words: int) -> Column:
    """The first words of a text in small letters."""
    return F.array_join(F.slice(F.split(F.lower(text), " "), 1, words), " ")


def anchor_relevance(anchor: Column, h1: Column, title: Column, h2: Column, meta: Column, slug: Column, shared: Column) -> tuple[Column, Column]:
    """Points for where the target has the anchor, and the reason; the first that applies."""
    low = trim(F.lower(anchor))
    steps = [
        ((h1 != "") & (F.lower(h1).contains(low) | low.contains(_lead(h1, 4))), 3.0, "Anchor closely matches target H1"),
        (F.lower(title).contains(low), 2.5, "Anchor found in target page title"),
        (F.exists(h2, lambda h: F.lower(h).contains(low) | low.contains(_lead(h, 3))), 2.0, "Anchor matches a target H2 heading"),
        (F.lower(meta).contains(low), 1.5, "Anchor found in target meta description"),
        # a slug has blanks for hyphens, so only anchors of one word are found
        (slug.contains(F.regexp_replace(low, r"\s+", "-")), 1.0, "Anchor phrase matches target URL slug"),
        (shared > 0, 0.5, None),
    ]
    points, reason = F.lit(0.0), F.lit(None).cast("string")
    for test, value, text in reversed(steps):
        points = F.when(test, F.lit(value)).otherwise(points)
        reason = F.when(test, F.lit(text)).otherwise(reason)
    return points, reason


def overlap_points(shared: Column) -> Column:
    return F.when(shared >= 10, 2.0).when(shared >= 6, 1.5).when(shared >= 3, 1.0).when(shared >= 1, 0.5).otherwise(0.0)


def similarity_points(similarity: Column) -> Column:
    return F.when(similarity >= 0.25, 1.0).when(similarity >= 0.12, 0.5).otherwise(0.0)


def length_points(words: Column) -> Column:
    return F.when(words >= 80, 2.0).when(words >= 40, 1.5).when(words >= 20, 1.0).otherwise(0.0)


def strategic_points(is_orphan: Column, inbound: Column, page_type: Column) -> Column:
    return F.when(is_orphan, 2.0).when(inbound < 2, 1.0).otherwise(0.0) + F.when(page_type.isin(*MONEY_TYPES), 1.0).otherwise(0.0)


def position_points(position: Column) -> Column:
    return F.when(position <= 0.25, 1.0).when(position <= 0.50, 0.5).otherwise(0.0)


def _generic(anchor: Column) -> Column:
    return trim(F.lower(anchor)).isin(*GENERIC_ANCHORS)


def _short(anchor: Column) -> Column:
    return (F.size(F.split(anchor, " ")) == 1) & (F.length(anchor) < 8)


def penalty_points(anchor: Column) -> Column:
    return F.when(_generic(anchor), 3.0).otherwise(0.0) + F.when(F.length(anchor) < 4, 2.0).otherwise(0.0) + F.when(_short(anchor), 0.5).otherwise(0.0)


def raw_points(anchor: Column, relevance: Column, shared: Column, similarity: Column, words: Column, is_orphan: Column, inbound: Column, page_type: Column, position: Column) -> Column:
    """The sum of all points; each is a multiple of a half, so the sum is exact."""
    parts = [relevance, overlap_points(shared), similarity_points(similarity), length_points(words), strategic_points(is_orphan, inbound, page_type), position_points(position)]
    return reduce(lambda a, b: a + b, parts) - penalty_points(anchor)


def score(raw: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), half_up(raw))).cast("int")


def confidence(trust: Column, anchor: Column, points: Column) -> Column:
    """Percent: from the zone's confidence, the anchor's length and the score."""
    n = F.size(F.split(anchor, " "))
    natural = F.when(n >= 3, 0.95).when(n >= 2, 0.85).otherwise(0.70)
    return half_up((trust * F.lit(0.40) + natural * F.lit(0.30) + (points / 10) * F.lit(0.30)) * 100).cast("int")


def reasons(relevance_reason: Column, shared: Column, similarity: Column, words: Column, is_orphan: Column, inbound: Column, page_type: Column, position: Column) -> Column:
    n = shared.cast("string")
    told = [
        relevance_reason,
        F.when(shared >= 10, F.concat(F.lit("Very high inter-page keyword overlap ("), n, F.lit(" shared terms)")))
        .when(shared >= 6, F.concat(F.lit("High inter-page keyword overlap ("), n, F.lit(" terms)")))
        .when(shared >= 3, F.concat(F.lit("Good inter-page keyword overlap ("), n, F.lit(" terms)"))),
        F.when(similarity >= 0.25, F.concat(F.lit("Strong paragraph-to-target semantic similarity ("), half_up(similarity * 100).cast("string"), F.lit("%)"))).when(
            similarity >= 0.12, F.lit("Moderate paragraph-to-target semantic overlap")
        ),
        F.when(words >= 80, "Rich paragraph context (80+ words)").when(words >= 40, "Good paragraph length (40+ words)").when(words >= 20, "Acceptable paragraph length (20+ words)"),
        F.when(is_orphan, "Target is an orphan page (zero inbound internal links)").when(inbound < 2, "Target has very few inbound internal links"),
        F.when(page_type.isin(*MONEY_TYPES), "Target is a high-value conversion / money page"),
        F.when(position <= 0.25, "Anchor is in the opening section of the article (high SEO value)").when(position <= 0.50, "Anchor is in the first half of the article"),
    ]
    return F.array_compact(F.array(*told))


def warnings(anchor: Column) -> Column:
    told = [
        F.when(_generic(anchor), "Generic anchor text (click here / read more / etc.)"),
        F.when(F.length(anchor) < 4, "Anchor text too short (< 4 characters)"),
        F.when(_short(anchor), "Single very short word used as anchor"),
    ]
    return F.array_compact(F.array(*told))


def breakdown(raw: Column, anchor: Column, shared: Column, words: Column, is_orphan: Column, inbound: Column, page_type: Column, position: Column, points: Column) -> Column:
    """The parts as they are reported: anchor_relevance is the sum clamped to 3, and penalties name one only."""
    low = F.lower(anchor)
    return F.struct(
        half_up(F.greatest(F.lit(0.0), F.least(F.lit(3.0), raw - F.greatest(F.lit(0.0), raw - 3.0))), 1).alias("anchor_relevance"),
        half_up(F.least(F.lit(3.0), shared * F.lit(0.5)), 1).alias("keyword_overlap"),
        length_points(words).alias("paragraph_quality"),
        strategic_points(is_orphan, inbound, page_type).alias("strategic_value"),
        position_points(position).alias("position_bonus"),
        F.when(low.isin(*GENERIC_ANCHORS), -3.0).when(F.length(anchor) < 4, -2.0).otherwise(0.0).alias("penalties"),
        points.cast("double").alias("total"),
    )


def position_label(position: Column) -> Column:
    return F.when(position <= 0.25, "Early").when(position <= 0.60, "Middle").otherwise("Late")


def priority(points: Column) -> Column:
    return F.when(points >= 8, "High").when(points >= 6, "Medium").otherwise("Low")


def body_reason(para_idx: Column, method: Column, trust: Column, position: Column) -> Column:
    return F.concat(
        F.lit("Paragraph #"), (para_idx + 1).cast("string"), F.lit(' extracted via "'), method, F.lit('" (confidence '), half_up(trust * 100).cast("string"),
        F.lit("%) — confirmed main-body content ("), position_label(position), F.lit(" section of article), not from author bio, sidebar, or template section."),
    )


def validation_proof(method: Column, anchor: Column) -> Column:
    return F.concat(
        F.lit('✓ Valid main-body paragraph from "'), method, F.lit('". Anchor "'), anchor,
        F.lit('" exists naturally in visible body content. Source does not already link to target. sourceType: main-body.'),
    )
