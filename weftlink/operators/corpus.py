"""Paragraphs that a site repeats, and the positions of those that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.functions.text import half_up, trim

#: A paragraph of so many characters goes if at least so many of a site's pages, and this share of them, have it.
LEAST_CHARS, LEAST_PAGES, LEAST_SHARE = 50, 3, 0.40


def positions(n: Column) -> Column:
    """0 to 1 in n equal steps, to three places; n is 80 at most, where plain rounding of halves is exact."""
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n > 1, half_up(i / (n - 1), 3)).otherwise(F.lit(0.0)))
    return F.when(n > 0, steps).otherwise(F.array().cast("array<double>"))


def paragraph_counts(pages: DataFrame, site: str = "site_key", paragraphs: str = "paragraphs") -> DataFrame:
    """(site, paragraph, n): on how many pages of its site each long paragraph is."""
    each = pages.select(site, F.explode(F.array_distinct(paragraphs)).alias("paragraph")).withColumn("paragraph", trim(F.col("paragraph")))
    return each.where(F.length("paragraph") >= LEAST_CHARS).groupBy(site, "paragraph").agg(F.count("*").alias("n"))


def repeated_paragraphs(pages: DataFrame, site: str = "site_key", paragraphs: str = "paragraphs") -> DataFrame:
    """(site, paragraph, n, pages) of the paragraphs that make up a site's frame."""
    sizes = pages.groupBy(site).agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    least = F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("pages") * F.lit(LEAST_SHARE)))
    return paragraph_counts(pages, site, paragraphs).join(sizes, site).where(F.col("n") >= least)


def drop_repeated(pages: DataFrame) -> DataFrame:
    """pages without their sites' repeated paragraphs, and n_repeated; positions are counted anew on sites that have any.

    A page has 80 paragraphs at most and a repeated one is on two fifths of the pages, so a site has 200 at most.
    """
    sets = repeated_paragraphs(pages).groupBy("site_key").agg(F.collect_set("paragraph").alias("_frame"))
    joined = pages.join(sets, "site_key", "left")
    kept = F.filter("paragraphs", lambda p: ~F.array_contains(F.col("_frame"), p))
    joined = joined.withColumn("_kept", F.when(F.col("_frame").isNotNull(), kept))
    changed = F.col("_kept").isNotNull()
    return joined.withColumns(
        {
            "n_repeated": F.when(changed, F.size("paragraphs") - F.size("_kept")).otherwise(0),
            "paragraphs": F.when(changed, F.col("_kept")).otherwise(F.col("paragraphs")),
            "paragraph_positions": F.when(changed, positions(F.size("_kept"))).otherwise(F.col("paragraph_positions")),
            "paragraph_count": F.when(changed, F.size("_kept")).otherwise(F.col("paragraph_count")),
        }
    ).drop("_frame", "_kept")
