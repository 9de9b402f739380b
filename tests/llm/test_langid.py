import random
import zlib

from weftlink.llm import langid

WORDS = {"aa": "the and of that with there what which other about".split(), "bb": "der die und nicht eine über schön heißt wird noch".split(), "cc": "les une été où garçon être avec dans pour elle".split()}


def text(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def corpus(spark):
    rows = [(i, text(lang, i, 2 + i % 60), lang, "s", 1) for i in range(600) for lang in [("aa", "bb", "cc")[i % 3]]]
    rows += [(600, None, "aa", "s", 1), (601, "", "bb", "s", 1), (602, "12 34 !!", "cc", "s", 1), (603, text("bb", 1, 20000), None, "s", 1), (604, text("aa", 5, 9).upper(), None, "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")


def test_held_out_accuracy_and_odd_texts(spark):
    frame = corpus(spark)
    rows = {r.doc_id: r for r in langid.identify(frame).collect()}
    truth = {r.doc_id: r.lang for r in frame.collect()}
    assert len(rows) == 605
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [i for i, r in rows.items() if r.held_out and i < 600]
    assert len(held) > 100
    assert sum(rows[i].lang_pred == truth[i] for i in held) / len(held) > 0.98
    assert [rows[i].lang_pred for i in (600, 601, 602)] == ["und"] * 3
    assert rows[603].lang_pred == "bb" and rows[604].lang_pred == "aa"


def test_labels_of_held_out_rows_change_nothing(spark):
    frame = corpus(spark)
    flipped = frame.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS string)) % 4 = 2 THEN 'xx' ELSE lang END AS lang", "'other' AS source", "score")
    assert sorted(langid.identify(frame).collect()) == sorted(langid.identify(flipped).collect())


def test_without_labels_and_without_rows(spark, docs):
    assert langid.identify(docs([])).collect() == []
    assert [r.lang_pred for r in langid.identify(docs(["one", "two"]).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()] == ["und", "und"]
    assert {r.lang_pred for r in langid.identify(docs(["one two"] * 8)).collect()} == {"en"}
