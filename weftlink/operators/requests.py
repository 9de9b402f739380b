"""What is wrong with a list of addresses that is to be analysed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions import urls
from weftlink.functions.text import trim

#: The least number of addresses, and how many that are none a message names.
LEAST_URLS, NAMED_INVALID = 2, 3


def check_requests(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(request, n_urls, error) of rows (request, seq, url); error: null for a request that can be analysed.

    Addresses count once, trimmed, and only with http in front. A request needs two, `most` at most where that is
    given, all of them addresses of one site. The first fault by this order is told; seq is the order of a request.
    """
    clean = rows.select("request", "seq", trim(F.col("url")).alias("url"))
    known = clean.where(F.col("url").startswith("http")).groupBy("request", "url").agg(F.min("seq").alias("seq"))
    known = known.withColumn("invalid", ~urls.is_url(F.col("url"))).withColumn("site", urls.site_key(F.col("url")))
    sites = known.where("site <> ''").groupBy("request", "site").agg(F.min("seq").alias("at"))
    sites = sites.groupBy("request").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "site")))["site"], ", ").alias("sites"), F.count("*").alias("n_sites"))
    wrong = known.where("invalid").groupBy("request").agg(F.slice(F.array_sort(F.collect_list(F.struct("seq", "url")))["url"], 1, NAMED_INVALID).alias("wrong"))
    counts = known.groupBy("request").agg(F.count("*").alias("n"))
    told = rows.groupBy("request").agg(F.count("url").alias("given")).join(counts, "request", "left").join(sites, "request", "left").join(wrong, "request", "left")
    n = F.coalesce("n", F.lit(0))
    error = F.when(F.col("given") == 0, "No URLs provided.").when(n < LEAST_URLS, "Please enter at least 2 URLs. Internal linking requires comparing multiple pages.")
    if most is not None:
        error = error.when(n > most, f"Maximum {most} URLs per request. Please trim the list.")
    error = error.when(F.col("wrong").isNotNull(), F.concat(F.lit("Invalid URL(s): "), F.array_join("wrong", ", ")))
    error = error.when(F.col("n_sites") > 1, F.concat(F.lit("All URLs must be from the same domain. Found: "), F.col("sites")))
    return told.select("request", n.alias("n_urls"), error.alias("error"))
