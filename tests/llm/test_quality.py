import random

from weftlink.llm import quality

GOOD = "river stone walking morning letters quiet garden window travel reading people careful".split()


def text(good, seed, n=80):
    rng = random.Random(seed)
    words = [rng.choice(GOOD) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n)]
    return " ".join(words) if good else " ".join(w.upper() + rng.choice(["!!", "$$$", "###"]) for w in words)


def tables(spark):
    rows = [(i, text(i % 3 > 0, i, 5 + i % 200), "en", "s", 0) for i in range(900)] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, text(True, 1, 30000), "en", "s", 0)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(900)] + [(5000, 1, 0), (2, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, predicted int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    rows = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(rows) == 903 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    held = [i for i, r in rows.items() if r.held_out and i < 900]
    assert sum(rows[i].predicted == int(i % 3 > 0) for i in held) / len(held) > 0.97
    assert rows[900].score == rows[901].score and rows[902].predicted == 1


def test_held_out_labels_change_nothing(spark):
    docs, labels = tables(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert sorted(quality.classify(docs, labels).collect()) == sorted(quality.classify(docs, flipped).collect())


def test_without_labels_or_rows(spark):
    docs, labels = tables(spark)
    assert {r.score for r in quality.classify(docs.limit(5), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).collect() == []
    assert {r.predicted for r in quality.classify(docs, labels.where("quality = 1")).where("doc_id < 50").collect()} == {1}
