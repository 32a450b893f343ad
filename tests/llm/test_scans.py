from folioflow.llm import scans as S


def test_numbers_and_words():
    assert all(map(S.looks_numeric, ["xiv", "12", "— l6 —", "Seite 4 von 9", "[3]", "p. 7", "xlv ."]))
    assert not any(map(S.looks_numeric, ["The title", "947 pages of text here", "", "Introduction"]))
    assert S.words_of("(The d'une x1 www.a.b/c 12.5 teórico-práctico)") == ["the", "une", "x1", "teórico-práctico"]
    assert S.anagram_of("ab") == S.anagram_of("ba")


def line(i, page, no, text, y, size=11.0, block=None):
    b = block or f"d_p{page}_b1"
    return (f"{b}_l{no}_{i}", b, "d", page, no, text, {"x": 1.0, "y": float(y), "width": 1.0, "height": 1.0}, 0.0, size)


def test_pages(spark):
    rows = []
    for p in range(4):
        rows.append(line(0, p, 0, "A RUNNING TITLE", 30, 9.0, f"d_p{p}_b0"))
        rows.append(line(1, p, 0, str(10 + p), 812, 9.0, f"d_p{p}_b9"))
        for k in range(12):
            rows.append(line(2, p, k, "the planner removes every second window and the well-known translation", 100 + 14 * k))
        rows.append(line(3, p, 12, "the pIanner rem0ves the trans-", 290))
        rows.append(line(3, p, 13, "lation and the well-", 304))
        rows.append(line(3, p, 14, "known windovv", 318))
    schema = "line_id string, block_id string, document_id string, page_index int, line_no int, text string, bbox struct<x double, y double, width double, height double>, baseline double, font_size double"
    df = spark.createDataFrame(rows + rows[:3], schema)
    defects, words, _ = S.repairs(df)
    got = {}
    for r in defects.collect():
        got.setdefault(r.defect, []).append(r.line_id)
    assert len(got["running_header"]) == 4 and len(got["page_number"]) == 4
    assert sorted(got["hyphen"]) == sorted(f"d_p{p}_b1_l12_3" for p in range(4))
    assert {x for x in got["misread"]} == {f"d_p{p}_b1_l{n}_3" for p in range(4) for n in (12, 14)}
    text = S.paragraphs(df).where("page_index = 0").collect()[0].text
    assert text.endswith("the planner removes the translation and the well-known window")
    assert S.repairs(df.limit(0))[0].count() == 0
