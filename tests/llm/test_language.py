from folioflow.llm import language as L

EN = "The editor keeps every heading in order. The planner removes the double spaces during a slow upload. The scanner finds two spelling mistakes. "
FR = "La rédactrice garde chaque titre dans l'ordre. Le planificateur retire les espaces en double pendant un envoi lent. Le scanner trouve deux fautes. "
DE = "Die Redakteurin behält jede Überschrift in der Reihenfolge. Der Planer entfernt die doppelten Leerzeichen. Der Scanner findet zwei Schreibfehler. "
C = L.Classifier({"en": EN * 3, "fr": FR * 3, "de": DE * 3})


def test_labels():
    assert [L.label_code(x) for x in ("EN", "eng", "zh-CN", "fr_CA", "German", "??", "", None, "und")] == ["en", "en", "zh", "fr", "de", None, None, None, None]


def test_sentences_and_stretches():
    assert C.guess("The planner keeps the double spaces in order.")[0] == "en"
    assert C.guess("Le scanner garde les espaces pendant un envoi.")[0] == "fr"
    text = "The editor keeps every heading in order. Der Planer entfernt die doppelten Leerzeichen."
    assert [x[2] for x in C.stretches(text)] == ["en", "de"]
    assert C.guess("ระบบส่งออกซ่อนเลขหน้า")[0] == "th" and C.guess("表の検出器はページ番号を隠す")[0] == "ja"
    assert C.guess("www.example.org/p1 12.5 | 44")[0] is None and C.guess("")[0] is None


def test_wrong_labels_in_the_sample_are_dropped():
    got = L.fit({"en": [EN] * 6 + [FR] * 2, "fr": [FR] * 6})
    assert "rédactrice" not in got["en"]


def test_table(spark):
    blocks = spark.createDataFrame([("b1", "d1", EN * 2), ("b1", "d1", EN * 2), ("b2", "d1", DE), ("b3", "d2", FR), ("b4", "d3", None), ("b5", "d3", "")], "block_id string, document_id string, source_text string")
    docs = spark.createDataFrame([("d1", "English"), ("d1", "English"), ("d2", "de"), ("d3", None)], "document_id string, source_language string")
    s = L.block_languages(blocks, {"en": EN * 3, "fr": FR * 3, "de": DE * 3})
    got = {tuple(r) for r in L.language_cases(*L.languages(blocks, docs, s)).collect()}
    assert got == {("document", "d2", "fr"), ("export_block", "b2", "de")}
    assert L.block_languages(blocks.limit(0), {}).count() == 0
