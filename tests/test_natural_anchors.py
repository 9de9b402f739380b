from pyspark.sql import functions as F

from weftlink.operators import anchors


def _tables(spark, texts, phrases):
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "site_key string, at int, text string")
    return rows, spark.createDataFrame([("s", p) for p in phrases], "site_key string, phrase string")


def test_phrases_with_a_frequent_first_word_meet_few_texts(spark, monkeypatch):
    rows, phrases = _tables(spark, [f"the word{i} stands here" for i in range(40)], [f"the word{i}" for i in range(40)])
    monkeypatch.setattr(anchors, "bounded_phrase", lambda text, phrase, ascii_only: F.lit("met"))
    assert anchors.phrase_matches_ascii(rows, phrases, ["at"]).count() == 40


def test_letters_that_fold_to_ascii_are_letters_of_a_run(spark):
    rows, phrases = _tables(spark, ["The \u212aelvin Scale, the kelvin scale", "Kelvins only; \u212aelvin, KELVIN"], ["kelvin scale", "kelvin"])
    got = {(r["at"], r.phrase, r.anchor) for r in anchors.phrase_matches_ascii(rows, phrases, ["at"]).collect()}
    assert got == {(0, "kelvin scale", "\u212aelvin Scale"), (0, "kelvin", "\u212aelvin"), (1, "kelvin", "\u212aelvin")}


def test_phrases_with_frequent_first_words_meet_few_texts(spark, monkeypatch):
    rows, phrases = _tables(spark, [f"out of the word{i} it stands" for i in range(40)], [f"of the word{i}" for i in range(40)])
    monkeypatch.setattr(anchors, "bounded_phrase", lambda text, phrase: F.lit("met"))
    assert anchors.phrase_matches(rows, phrases, ["at"]).count() == 40


def test_phrases_of_one_run_of_many_and_of_none(spark):
    texts = ["A state-of-the-art guide to all the old things we know, of x", "State of the art; guide", "-- 'tis", None, "", "of-the", "OF THE"]
    listed = ["state-of-the-art guide to all the old things we", "state-of-the-art guide to all the old things they", "of the", "of-the", "--", "tis", "art", "x"]
    want = {(0, listed[0], "state-of-the-art guide to all the old things we"), (0, "art", "art"), (0, "of-the", "of-the"), (1, "of the", "of the"), (1, "art", "art"), (2, "--", "--"), (2, "tis", "tis"), (5, "of-the", "of-the"), (6, "of the", "OF THE")}
    rows, phrases = _tables(spark, texts, listed)
    for most in (anchors.BROADCAST_KEYS, 0):
        assert {(r["at"], r.phrase, r.anchor) for r in anchors.phrase_matches(rows, phrases, ["at"], most).collect()} == want
