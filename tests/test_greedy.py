"""Suggested links without all pairs of a site: the same rows, and few pairs looked at."""

import numpy as np
import pyarrow as pa
import pytest

from tests.test_site import make_site
from weftlink.operators.allocate import allocate
from weftlink.operators.greedy import _GOAL, Site
from weftlink.plans import site
from weftlink.settings import TARGET_PAGE, Settings


@pytest.mark.parametrize("settings", [Settings(min_score=5, min_keyword_overlap=1), TARGET_PAGE, Settings(max_links_per_source=3, max_links_per_target=2, min_score=4, min_keyword_overlap=0)])
def test_rows_of_all_pairs(spark, settings):
    rows = make_site(11, 30) + [(i + 100, u, h) for i, u, h in make_site(12, 8, "other.org")]
    pages = site.complete(site.crawl(spark.createDataFrame(rows, "page_id long, url string, html string"), settings).pages)
    pages = pages.checkpoint() if spark.sparkContext.getCheckpointDir() else pages.cache()
    made = site.suggested(pages, settings)
    every = allocate(site.score_pairs(pages, settings), settings).select(made.columns)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, every.collect())) and every.count() > 40


def test_few_pairs_are_looked_at():
    """Every page has an anchor to every other: 4 million pairs, of which those near the sources' turns are looked at."""
    n, found = 2000, Site(Settings())
    found.add_phrases(pa.record_batch({"id": np.arange(3), "pages": [list(range(n))] * 3}, schema=pa.schema({"id": pa.int64(), "pages": pa.list_(pa.int64())})))
    words = [f"word{k}" for k in range(12)]
    goal = {"h1": "red river stone", "h1_lead": "red river stone", "title": "t", "h2": [], "h2_leads": [], "meta": "", "slug": "s", "strategic": 2.0, "keywords": words}
    found.goals.append(pa.RecordBatch.from_pylist([{"seq": i, **goal} for i in range(n)]).select(["seq", *_GOAL]))
    found.close()
    hits = pa.array([{"para_idx": p, "id": p, "anchor": a} for p, a in enumerate(("red river", "river stone", "red river stone"))], pa.struct({"para_idx": pa.int32(), "id": pa.int64(), "anchor": pa.string()}))
    paras = [{"para_idx": p, "points": 2.0, "para_words": words[:3]} for p in range(3)]
    made = [(s, *x) for s in range(n) for x in found.links(s, hits, paras, words, [])]
    assert len(made) == 3 * n and found.looked < 30 * n
    assert max(np.bincount([t for _, t, _, _ in made])) == 10 and made[0][1] == 1
