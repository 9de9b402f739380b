"""Each stage of the pipeline against a plain version of it, on its predecessor's rows."""

import random

import corpus_pipeline
from tests.llm.test_native import shingles
from tests.llm.test_nearcopies import edited, plain_components
from tests.llm.test_packing import hold, whole
from weftlink.llm import quality

GOOD = "river stone walking morning letters quiet garden window travel reading people careful".split()


def plain_lines(texts):
    seen, out = set(), []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            gone |= {p, p + 1, p + 2} if w in seen else set()
            seen |= {w} if any(w) else set()
        out.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_stages_as_brute_force(spark, tmp_path):
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(GOOD) + rng.choice(["", "s", "ed", "ing", "ly", "er"]) + rng.choice(["", " the", " of a"]) for _ in range(n))
    bad = lambda n: " ".join(rng.choice(GOOD).upper() + rng.choice(["!!", "$$$", "###"]) for _ in range(n))
    items = [prose(20) for _ in range(4)]
    frame = "\n".join(prose(8) for _ in range(4))
    texts = [bad(60) if i % 4 == 0 else prose(60 + i % 50) for i in range(200)]
    for i in range(1, 200, 4):
        texts[i] = [f"{prose(30)}\n{frame}\n{prose(30)}", edited(texts[i - 2], rng, 1) if i > 4 else texts[i], f"{prose(90)} {items[i % 4]} {prose(20)}", texts[i + 1]][i // 4 % 4]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, prose(50), None, None, None), (5000, None, None, None, None), (5001, "", None, None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    order = lambda df: sorted([(r.doc_id if r.doc_id is not None else -1, r.text) for r in df.collect()], key=str)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        after = spark.read.parquet(f"{tmp_path}/stage{k}")
        before = sorted([(r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.collect()], key=lambda r: r[0])
        if k == 0:
            good = {(r.doc_id, r.score) for r in quality.classify(docs, labels).collect() if r.predicted == 1}
            assert sorted(r.doc_id or -1 for r in after.collect()) == sorted(i or -1 for i, _ in good)
            assert 130 < after.count() < 170 and None in {i for i, _ in good}
        elif k == 1:
            assert order(after) == sorted(zip([i for i, _ in before], plain_lines([t for _, t in before])), key=str)
            assert all(r.n_chars == len(r.text) for r in after.collect() if None not in (r.doc_id, r.text))
        elif k == 2:
            ends = sorted(before, key=lambda r: (r[0] < 0, r[0]))
            least = plain_components([t for _, t in ends])
            assert order(after) == sorted([r for i, r in enumerate(ends) if least[i] == i], key=str) and after.count() < len(before)
        elif k == 3:
            clean = [(i, t) for i, t in before if not any(len(shingles(x) & shingles(t or "")) >= 0.8 * len(shingles(x)) for x in items)]
            assert order(after) == sorted(clean, key=str) and len(clean) < len(before)
        else:
            known = [t for _, t in before]
            ids = {i if i >= 0 else None: x for (i, _), x in zip(before, whole(known).values())}
            assert hold(after.collect(), ids) == 0
        assert k == 4 or after.columns == docs.columns
        kept[name], docs = after.count(), after
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "length").collect()), key=str) == sorted(map(tuple, docs.select("doc_id", "length").collect()), key=str)


def test_empty_table(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
