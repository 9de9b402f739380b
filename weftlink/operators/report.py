"""What is said about a run: filters, counts, lists and the table for export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.operators.graph import degrees

#: The columns of the exported table, and how many anchors and opportunities a summary lists.
EXPORT_COLUMNS = (
    "Source URL", "Target URL", "Anchor Text", "Anchor Type", "Anchor Context", "Paragraph Position", "Existing Paragraph",
    "Updated Paragraph", "Score", "Priority", "Reason", "Body Content Proof", "Shared Keywords", "Page Type", "Link Type",
    "Confidence", "Target Inbound Links", "Is Orphan Target",
)
ANCHOR_VARIATIONS, TOP_OPPORTUNITIES, TOO_MANY_LINKS = 25, 8, 7
ORDER = ("rank_key", "src_seq", "tgt_seq")


def in_order(opportunities: DataFrame) -> list[Column]:
    """The order of suggestions: by score, then as they were found."""
    return [F.desc("score"), F.col("src_seq"), F.col("tgt_seq")]


def score_band(points: Column, band: str) -> Column:
    return {"high": points >= 8, "medium": (points >= 6) & (points < 8), "low": points < 6}[band]


def filter_opportunities(
    opportunities: DataFrame,
    pages: DataFrame | None = None,
    *,
    link_type: str = "",
    priority: str = "",
    source: str = "",
    target: str = "",
    position: str = "",
    anchor_type: str = "",
    orphan_only: bool = False,
    band: str = "",
    search: str = "",
) -> DataFrame:
    """The suggestions that meet every filter given. search looks for a text of any case in both addresses, anchor, context and shared keywords."""
    out = opportunities
    for column, value in (("link_type", link_type), ("priority", priority), ("source_url", source), ("target_url", target), ("para_position_label", position), ("anchor_type", anchor_type)):
        if value:
            out = out.where(F.col(column) == value)
    if band:
        out = out.where(score_band(F.col("score"), band))
    if search:
        q = search.lower()
        found = F.lower("source_url").contains(q) | F.lower("target_url").contains(q) | F.lower("suggested_anchor").contains(q) | F.lower(F.coalesce("anchor_context", F.lit(""))).contains(q)
        out = out.where(found | F.exists("shared_keywords", lambda k: k.contains(q)))
    if orphan_only:
        out = out.join(pages.where("is_orphan").select(F.col("url").alias("target_url")).distinct(), "target_url", "left_semi")
    return out


def facets(opportunities: DataFrame) -> DataFrame:
    """(facet, value, n): the values that filters can take, with their counts."""
    pairs = [("linkType", "link_type"), ("source", "source_url"), ("target", "target_url"), ("anchorType", "anchor_type")]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), F.col(c).alias("value")) for n, c in pairs])).alias("f")
    return opportunities.select(each).select("f.*").where("value IS NOT NULL AND value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def counts_by(opportunities: DataFrame, column: str) -> DataFrame:
    """(column, n); empty values count as unknown."""
    key = F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit("unknown")).alias(column)
    return opportunities.groupBy(key).agg(F.count("*").alias("n"))


def anchor_variations(opportunities: DataFrame, most: int = ANCHOR_VARIATIONS) -> DataFrame:
    """(anchor) of the first different anchors in the order of suggestions."""
    first = F.min(F.struct((-F.col("score")).alias("s"), "src_seq", "tgt_seq")).alias("first")
    return opportunities.groupBy(F.col("suggested_anchor").alias("anchor")).agg(first).orderBy("first").limit(most).select("anchor")


def page_flags(pages: DataFrame, opportunities: DataFrame | None = None) -> DataFrame:
    """(site_key, url, title, page_type, inbound, outbound, flag) of the pages with no inbound link, one, or too many outbound ones, suggestions included."""
    known = degrees(pages, opportunities)
    rows = pages.select("site_key", "normalized_url", "url", "title", "page_type").join(known, ["site_key", "normalized_url"])
    flags = F.array_compact(F.array(F.when(F.col("inbound") == 0, "orphan"), F.when(F.col("inbound") == 1, "needs_more"), F.when(F.col("outbound") > TOO_MANY_LINKS, "too_many")))
    return rows.select("site_key", "url", "title", "page_type", "inbound", "outbound", F.explode(flags).alias("flag"))


def summary(fetch_log: DataFrame, pages: DataFrame, skipped: DataFrame, opportunities: DataFrame) -> DataFrame:
    """One row of counts."""
    log = fetch_log.agg(
        F.count("*").alias("_log"),
        F.count_if(~F.col("success")).alias("fetch_failed"),
        F.count_if(F.col("status") == "js-detected").alias("js_detected"),
        F.count_if(F.col("status") == "success:raw").alias("raw_fetched"),
        F.count_if(F.col("status") == "success:rendered").alias("rendered"),
        F.count_if(F.col("status").startswith("no-body-content")).alias("no_body_content"),
        F.count_if(F.col("status").startswith("failed:render")).alias("render_failed"),
    )
    kept = pages.agg(F.count("*").alias("fetched_ok"), F.coalesce(F.sum("n_repeated"), F.lit(0)).alias("boilerplate_removed"))
    gone = skipped.agg(F.count("*").alias("skipped_total"))
    made = opportunities.agg(
        F.count("*").alias("total_opps"),
        F.count_if(F.col("score") >= 8).alias("high_priority"),
        F.count_if((F.col("score") >= 6) & (F.col("score") < 8)).alias("med_priority"),
        F.count_if(F.col("score") < 6).alias("low_priority"),
    )
    flags = page_flags(pages, opportunities).agg(*[F.count_if(F.col("flag") == f).alias(n) for f, n in (("orphan", "orphan_pages"), ("needs_more", "needs_more_links"), ("too_many", "too_many_links"))])
    one = log
    for part in (kept, gone, made, flags):  # each has one row
        one = one.join(F.broadcast(part))
    return one.withColumn("total_urls_entered", F.col("_log") + F.col("skipped_total")).drop("_log")


def top_opportunities(opportunities: DataFrame, most: int = TOP_OPPORTUNITIES) -> DataFrame:
    return opportunities.orderBy(*in_order(opportunities)).limit(most)


def export_rows(opportunities: DataFrame, pages: DataFrame) -> DataFrame:
    """The table for export, in EXPORT_COLUMNS; all texts. A target without inbound links has an empty cell there."""
    first = Window.partitionBy("url").orderBy("page_seq")
    known = pages.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(F.col("url").alias("target_url"), "inbound_count", "is_orphan")
    rows = opportunities.join(known, "target_url", "left")
    empty = F.lit("")
    cells = [
        F.col("source_url"), F.col("target_url"), F.col("suggested_anchor"), F.coalesce("anchor_type", empty), F.coalesce("anchor_context", empty), F.coalesce("para_position_label", empty),
        F.col("existing_paragraph"), F.regexp_replace("updated_paragraph", r"\[([^\]]+)\]\([^)]+\)", "$1"), F.concat(F.col("score").cast("string"), F.lit("/10")), F.col("priority"), F.col("reason"),
        F.col("body_content_reason"), F.array_join("shared_keywords", "; "), F.col("source_page_type"), F.col("link_type"), F.concat(F.col("confidence").cast("string"), F.lit("%")),
        F.when(F.col("inbound_count") > 0, F.col("inbound_count").cast("string")).otherwise(empty), F.when(F.col("is_orphan"), "Yes").otherwise("No"),
    ]
    return rows.select(*[c.alias(n) for c, n in zip(cells, EXPORT_COLUMNS)])


def failures(fetch_log: DataFrame) -> DataFrame:
    """(view, url, status, message) of the addresses that gave no record: failed fetches, and pages without text of their own."""
    view = F.when(F.col("status").startswith("failed:"), "failed").when((F.col("status") == "no-body-content") | F.col("status").startswith("no-body-content:"), "no-body")
    return fetch_log.where(~F.col("success")).select(view.alias("view"), "url", "status", "message").where("view IS NOT NULL")


def skips(skipped: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """(url, reason, details) of all that was left out, fetches of other kinds of content included."""
    other = fetch_log.where(F.col("status").startswith("skipped:")).select("url", F.col("status").alias("reason"), F.col("message").alias("details"))
    return skipped.select("url", "reason", "details").unionByName(other)


def json_rows(**sections: DataFrame) -> DataFrame:
    """(section, json): each row of each section as one JSON object; columns that are null are left out."""
    parts = [df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("json")) for name, df in sections.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_json(rows: DataFrame, path: str) -> None:
    """json_rows() as lines of JSON, a folder for each section."""
    rows.write.partitionBy("section").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """rows as CSV with a header; every cell in quotes, quotes doubled."""
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
