"""Nulls in every column, repeated rows, columns with clashing names, and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

from weftlink.llm import decontam, langid, linededup, media, nearcopies, packing, pii, quality, simhash, sitetree, suffixdedup

CLASHING = ("tid", "key", "ctx", "pos", "node", "fp", "digest", "start", "lines", "shingle", "n", "component", "host", "path", "page", "held_out", "score", "n_removed", "kept", "m")


@pytest.fixture
def odd(spark, prose):
    """Rows (doc_id, text, lang, source, n_chars) with nulls everywhere, one row twice, and more columns."""
    long = prose(1, 120)
    rows = [(None, long, "en", "s", 1), (None, long, None, None, None), (None, None, None, None, None), (7, None, None, "s", 0), (8, "", "en", None, 0), (9, long, None, "s", None), (9, long, None, "s", None), (9, prose(2, 9), "de", "s", 3), (3, "x\ny\nz\nx\ny\nz", "en", "s", 4), (None, "x\ny\nz", None, "s", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


def test_documents(spark, odd):
    n = odd.count()
    labels = spark.createDataFrame([(9, 1, 0), (8, 0, 0), (None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("other"))
    items = spark.createDataFrame([(1, "x y z"), (None, "x y z"), (2, None), (None, None)], "item_id long, text string").withColumn("shingles", F.lit(1))
    for rows in (packing.pack(odd).where("start = 0"), media.document_media(odd), pii.pseudonymize(odd), langid.identify(odd), quality.classify(odd, labels), quality.accepted(odd, labels.limit(0)).union(odd), linededup.remove_repeats(odd), simhash.near_duplicates(odd), nearcopies.near_copies(odd), suffixdedup.deduplicate(odd, 100)):
        assert rows.count() == n, rows.columns
    assert sorted(r.component_id for r in simhash.near_duplicates(odd).collect() if r.component_id is not None) == [3, 7, 7, 7, 9, 9, 9, 9, 9]
    assert {(r.doc_id, r.n_removed > 0) for r in suffixdedup.deduplicate(odd, 100).collect() if r.n_bytes > 100} == {(None, True), (9, True)}
    assert {r.n_removed for r in linededup.remove_repeats(odd).where("n_chars = 4").collect()} == {3 + 3}
    assert [(r.doc_id, r.item_id) for r in decontam.contained_items(odd, items).collect()] == [(None, 1)]
    assert decontam.decontaminate(odd, items).count() == n - 1
    stays = nearcopies.near_copies(odd).where("stays").select("doc_id").collect()
    assert sorted(r.doc_id for r in stays if r.doc_id is not None) == [3, 7, 9, 9, 9] and sum(r.doc_id is None for r in stays) == 1


def test_pages(spark):
    rows = [(None, None, None), (None, "http://a/", "<p>x</p>"), (1, None, "<p>y</p>"), (1, "http://a/", None)] * 2
    table = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    assert sorted(r.text for r in sitetree.main_text(table).collect()) == ["", "", "", "", "x", "x", "y", "y"]
