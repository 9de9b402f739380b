"""Every query with SQL has the rows of its SQL on the driver's smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from weftlink import queries
from weftlink.plans import site, target
from weftlink.sources.extract import extract

SF = "/root/testdata/sf0.001"
KNOWN, ORACLES = queries.queries(), queries.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_operator_of_the_engine_has_sql():
    assert set(ORACLES) <= set(KNOWN)
    assert set(KNOWN) - set(ORACLES) == {"opportunities", "target_opportunities", "target_scores", "target_diagnostics"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_sql(spark, tables, name):
    found = KNOWN[name](spark, SF)
    columns = sorted(found.columns)
    told = tables.execute(ORACLES[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == columns
    expected = Counter(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in told.fetchall())
    assert Counter(repr(tuple(plain(r[c]) for c in columns)) for r in found.collect()) == expected


CUT = ["Hills &amp; dales &amp", "Dales &lt", "Both &amp;&amp", "Told &quot;so&quot", "Whole &amp; sound"]


@pytest.fixture(scope="module")
def cut_off(spark, tmp_path_factory):
    """Pages whose titles end inside a reference, on one host, so that all are records."""
    body = "".join(f"<p>{' '.join(f'word{chr(97 + k)}{chr(97 + j)}' for j in range(20))}</p>" for k in range(5))
    html = [f'<html><head><meta charset="utf-8"><title>{t}</title></head><body><nav></nav><div class="ad">ad</div><article><h1>{t}</h1>{body}</article><footer>f</footer></body></html>' for t in CUT]
    at = str(tmp_path_factory.mktemp("cut"))
    spark.createDataFrame([(i, f"http://cut.example.org/en/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{at}/pages.parquet/*.parquet'")
    return at, con


@pytest.mark.parametrize("name", ["extract_headings", "extract_titles", "page_records"])
def test_references_cut_off_are_as_sql_has_them(spark, cut_off, name):
    at, con = cut_off
    found = KNOWN[name](spark, at)
    columns = sorted(found.columns)
    expected = Counter(repr(tuple(plain(r))) for r in con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({ORACLES[name]})").fetchall())
    assert expected and Counter(repr(tuple(plain(r[c]) for c in columns)) for r in found.collect()) == expected


def test_extraction_itself_reads_references_as_browsers_do():
    assert extract("http://a.b/", "<title>Hills &amp dales &amp</title><body><h1>x &lt</h1>")["title"] == "Hills & dales &"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_target_scores_make_no_suggestions(spark, monkeypatch):
    expected = target.top_scores(queries._target(spark, SF).scores).collect()
    monkeypatch.setattr(site, "score_pairs", lambda *_: pytest.fail("the site's pairs are not needed"))
    assert expected and KNOWN["target_scores"](spark, SF).collect() == expected
