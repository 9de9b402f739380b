"""Pages as they come: the steps that look at one page at a time run on a stream, the others on each site that changed.

An addition of this engine; the batch plans do not use it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftlink.functions import urls
from weftlink.plans import site
from weftlink.settings import CORE, Settings
from weftlink.sources.extract import with_extract


def page_stream(raw: DataFrame, settings: Settings = CORE) -> DataFrame:
    """A stream of raw (page_id, url, html) as extracted pages (page_id, url, site_key, page_type, extract), without those that scripts build."""
    rows = raw.where(urls.is_url(F.col("url")) & ~site.is_script_page(F.col("html")))
    rows = rows.select("page_id", "url", "html", urls.site_key(F.col("url")).alias("site_key"), urls.page_type(F.col("url")).alias("page_type"))
    return with_extract(rows, settings)


def analyze_stream(raw: DataFrame, crawled: str, checkpoint: str, sink: Callable[[DataFrame, int], None], settings: Settings = CORE) -> StreamingQuery:
    """Appends each batch of raw to the table of crawled pages, and gives sink the suggestions of the sites it touches."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        to = f"{crawled}/batch={number}"
        batch.select("page_id", "url", "html").write.mode("overwrite").parquet(to)  # a repeated batch replaces itself
        touched = spark.read.parquet(to).select(urls.site_key(F.col("url")).alias("_site")).distinct()
        known = spark.read.parquet(crawled).drop("batch")
        found = known.join(touched, urls.site_key(F.col("url")) == F.col("_site"), "left_semi")
        sink(site.analyze_sites(found, settings).opportunities, number)

    return raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
