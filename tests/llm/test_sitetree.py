import math
import os
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftlink.llm import common, queries, sitetree


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def body(i, extra=""):
    return f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="ad">Buy {i}</div>{extra}<article><header><h1>Head &amp; {i}</h1></header><p><b>First {i}<br>line<p>Second&nbsp;  {i}</p><ul><li>one<li>two {i}</ul><aside>side</aside>
    <div class="comments"><p>nice</p></div></article><div id="cookie-notice">We use</div><form><p>mail</p></form><footer>&copy; x</footer>"""


def test_blocks_of_the_article(spark):
    rows = sitetree.main_text(pages(spark, [("http://a.b/1", body(1)), ("http://a.b/1", body(1))]).selectExpr("*", "'x' AS host")).collect()
    assert [r.text for r in rows] == ["Head & 1\nFirst 1 line\nSecond 1\none\ntwo 1"] * 2
    assert all(r.n_chars == len(r.text) for r in rows)


def test_repeated_branches_of_a_host_go(spark):
    page = lambda i: f'<body><div class="lead"><span>Same slogan everywhere</span></div><div class="story"><p>Story number {i * i} of the day</p></div><div class="tail"><p>Imprint and legal</p></div></body>'
    many = [(f"https://Host.example/{i}", page(i)) for i in range(20)] + [(f"https://few.example/{i}", page(i)) for i in range(3)]
    for limit in (200_000, 0):
        rows = sorted(sitetree.main_text(pages(spark, many), broadcast_bytes=limit).collect())
        assert [r.text for r in rows[:20]] == [f"Story number {i * i} of the day" for i in range(20)]
        assert rows[20].text == "Same slogan everywhere\nStory number 0 of the day\nImprint and legal"


def test_repeated_articles_stay(spark):
    rows = sitetree.main_text(pages(spark, [(f"http://h/{i}", f"<body><nav>{i}</nav><article><p>The same article</p></article></body>") for i in range(30)])).collect()
    assert {r.text for r in rows} == {"The same article"}


def test_text_beside_a_teaser_stays(spark):
    page = lambda i: f'<body><div class="story"><div>Story number {i * i} of the day is told in divs</div><div>and ends {i} lines later</div></div><article class="card"><p>Read this too</p></article></body>'
    many = [(f"http://many.example/{i}", page(i)) for i in range(20)] + [("http://few.example/1", page(1))]
    texts = [r.text for r in sorted(sitetree.main_text(pages(spark, many)).collect())]
    assert texts[:20] == [f"Story number {i * i} of the day is told in divs\nand ends {i} lines later" for i in range(20)]
    assert texts[20] == "Story number 1 of the day is told in divs\nand ends 1 lines later\nRead this too"


def test_odd_pages(spark):
    rows = [(None, None), ("", ""), ("no url", "plain &lt;text&gt;\n x"), ("http://x", "<p>a<p>b<!-- c --><br>d"), ("http://x", "<div>" * 3000 + "deep"), ("http://x", "<article>" + "<p>word " * 5000), ("http://x", "<article>A</article><article>B</article>"), ("http://x", "a < b <c")]
    got = [r.text for r in sorted(sitetree.main_text(pages(spark, rows)).collect())]
    assert got[:4] == ["", "", "plain <text> x", "a\nb d"]
    assert got[4] == "deep" and got[5] == "\n".join(["word"] * 5000) and got[6] == "A\nB" and got[7] == "a < b <c"
    assert sitetree.main_text(pages(spark, rows).limit(0)).collect() == []


def test_importance_as_brute_force(spark):
    many = [("http://a/", f'<body><nav><a>{i % 3}</a></nav><div class="x">{"<p>t</p>" * (i % 4)}{i // 2}</div><main><p>{i}</p></main></body>') for i in range(12)]
    many += [("http://b/", "<p>one</p>"), ("http://b/", "<p>one</p>"), (None, None)]
    seen = defaultdict(set)
    for url, html in many:
        host = (url or "")[7:-1]
        at = defaultdict(list)
        for path, shown, told, _, _ in sitetree.branches(sitetree.tree(html or "")):
            at[path].append((shown, told))
        for path, x in at.items():
            seen[host, path].add((html, tuple(a for a, _ in x), tuple(b for _, b in x)))
    expected = {}
    for key, rows in seen.items():
        n, h = len(rows), []
        for side in (1, 2):
            counts = Counter(r[side] for r in rows).values()
            h.append(-sum(c / n * math.log(c / n) for c in counts) / math.log(n) if n > 1 else 1.0)
        expected[key] = (n, h[0], 0.1 * h[0] + 0.9 * h[1])
    rows = sitetree.importance(sitetree.branch_rows(pages(spark, many))).collect()
    got = {(r.host, r.path): (r.pages, r.look, r.importance) for r in rows}
    assert got.keys() == expected.keys() and all(x == pytest.approx(expected[k], abs=1e-9) for k, x in got.items())


def test_a_name_does_not_hide_the_main_text(spark):
    story = lambda i: f'<body><div class="menu">Menu {i}</div><div class="story social">{"".join(f"<div>Line {k} of story {i}</div>" for k in range(9 + i))}</div><div class="comments">{"".join(f"<p>I agree {k} {i}</p>" for k in range(3 + i))}</div></body>'
    for limit in (1000, 0):
        rows = sorted(sitetree.main_text(pages(spark, [(f"http://h/{i}", story(i)) for i in range(10)]), broadcast_bytes=limit).collect())
        assert [r.text for r in rows] == ["\n".join(f"Line {k} of story {i}" for k in range(9 + i)) for i in range(10)]


DRIVER = "/root/testdata/sf0.1/pages.parquet"


@pytest.mark.skipif(not os.path.exists(DRIVER), reason="needs the driver's tables")
def test_importance_decides_without_names(spark):
    """On the driver's pages the tree removes branches on its own, and with a class that says nothing the same text is left."""
    table = spark.read.parquet(DRIVER)
    told = sitetree.decisions(sitetree.importance(sitetree.branch_rows(table))).groupBy("why").count().collect()
    assert {r.why for r in told if r["count"] >= 50} >= {"judged", "furniture"}
    blank = table.withColumn("html", F.regexp_replace("html", 'class="ad"', 'class="q7"'))
    told = sitetree.decisions(sitetree.importance(sitetree.branch_rows(blank))).where("why = 'plain'").collect()
    assert len(told) >= 50 and {r.path for r in told} == {"/html/body/div.q7"}
    assert sorted(sitetree.main_text(table).collect()) == sorted(sitetree.main_text(blank).collect())


def test_long_hostile_pages(spark):
    size = 1 << 18
    odd = ["<a " * (size // 3), "<!" * (size // 2), "<a b='" * (size // 6), "<div>" * (size // 5), "<b>" * (size // 6) + "</i>" * (size // 8), "<div>" * 10_000 + "</x>" * 20_000, "<p>" * (size // 3), "<" * size]
    rows = sorted(sitetree.main_text(pages(spark, [("http://x", h) for h in odd])).collect())
    assert [r.n_chars for r in rows][:2] == [size // 3 * 3 - 1, 0] and rows[3].text == ""


def test_pages_come_in_small_batches(spark, tmp_path):
    """The query bounds the rows that Parquet's reader and Python hold at once; its rows are those without that bound."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": sitetree.BATCH_ROWS, "spark.sql.parquet.columnarReaderBatchSize": common.READ_ROWS}
    before = {k: spark.conf.get(k) for k in names}
    pages(spark, [(f"https://h{i % 3}.example/{i}", body(i)) for i in range(1200)]).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    table = spark.read.parquet(f"{tmp_path}/pages.parquet")
    expected = sorted(map(tuple, sitetree.main_text(table).collect()))
    try:
        assert sorted(map(tuple, queries.op6_html(spark, str(tmp_path)).collect())) == expected
        sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
        assert max(r.n for r in table.mapInArrow(sizes, "n long").collect()) <= sitetree.BATCH_ROWS
        assert all(int(spark.conf.get(k)) <= most for k, most in names.items())
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 100)
        common.small_reads(spark)
        assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "100"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
