from weftlink.operators import anchors


def test_phrases_of_any_script_are_found(spark):
    texts = {0: "Наш Городской Музей открыт", 1: "我们的城市博物馆指南很好", 2: "Hier ist Él Camino largo", 3: "The city guide", 4: "Η πόλη της Αθήνας"}
    rows = spark.createDataFrame([("s", i, t) for i, t in texts.items()], "site_key string, at int, text string")
    phrases = spark.createDataFrame([("s", p) for p in ("городской музей", "城市博物馆指南", "él camino", "city guide", "πόλη της", "другой музей")], "site_key string, phrase string")
    got = {(r["at"], r.phrase, r.anchor) for r in anchors.phrase_matches_ascii(rows, phrases, ["at"]).collect()}
    assert got == {(0, "городской музей", "Городской Музей"), (1, "城市博物馆指南", "城市博物馆指南"), (2, "él camino", "Él Camino"), (3, "city guide", "city guide"), (4, "πόλη της", "πόλη της")}
