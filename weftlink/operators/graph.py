"""The links between the pages of a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(pages: DataFrame, links: str = "existing_links") -> DataFrame:
    """(site_key, src, dst): each page's distinct links, as normal forms."""
    return pages.select("site_key", F.col("normalized_url").alias("src"), F.explode(F.array_distinct(links)).alias("dst"))


def known_edges(pages: DataFrame, links: str = "existing_links") -> DataFrame:
    """The links that lead to a page of the set; one from a page to itself counts."""
    known = pages.select("site_key", F.col("normalized_url").alias("dst")).distinct()
    return edges(pages, links).join(known, ["site_key", "dst"], "left_semi").select("site_key", "src", "dst")


def inbound(pages: DataFrame, links: str = "existing_links") -> DataFrame:
    """(site_key, normalized_url, inbound_count) of the pages with any."""
    return known_edges(pages, links).groupBy("site_key", F.col("dst").alias("normalized_url")).agg(F.count("*").alias("inbound_count"))


def with_inbound(pages: DataFrame, links: str = "existing_links") -> DataFrame:
    """pages with inbound_count and is_orphan."""
    joined = pages.drop("inbound_count", "is_orphan").join(inbound(pages, links), ["site_key", "normalized_url"], "left")
    joined = joined.withColumn("inbound_count", F.coalesce("inbound_count", F.lit(0)).cast("int"))
    return joined.withColumn("is_orphan", F.col("inbound_count") == 0)


def degrees(pages: DataFrame, opportunities: DataFrame | None = None, links: str = "existing_links") -> DataFrame:
    """(site_key, normalized_url, inbound, outbound) of every page, suggested links (source_norm, target_norm) included."""
    all_edges = known_edges(pages, links)
    if opportunities is not None:
        all_edges = all_edges.unionByName(opportunities.select("site_key", F.col("source_norm").alias("src"), F.col("target_norm").alias("dst")))
    ends = F.explode(F.array(F.struct(F.col("dst").alias("normalized_url"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("normalized_url"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")
    counted = all_edges.select("site_key", ends).select("site_key", "e.*").groupBy("site_key", "normalized_url").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))
    known = pages.select("site_key", "normalized_url").distinct()
    return known.join(counted, ["site_key", "normalized_url"], "left").fillna(0, ["inbound", "outbound"])
