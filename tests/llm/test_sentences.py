from folioflow.llm.sentences import Model, left_of, split_sentences, viterbi

NAMES = ["Velmar", "Okrande", "Tiskova"]
VERBS = ["reads the page", "keeps the list", "opens the file again", "counts the words"]
TEXTS = [f"The {a} {v}. Dr. {n} noted in sec. 12 that the {a} {w}. {n} answered: “It {v}. It {w}.” The {a} {w} at 9.30 a.m." for a in ("editor", "planner", "scanner") for v in VERBS for w in VERBS for n in NAMES]
TEXTS += [f"Dr. {n} noted in sec. 3 that the {a} {v}." for n in NAMES for a in ("editor", "planner") for v in VERBS]
TEXTS += [f"{n} answered: “It {v}. It {w}.”" for n in NAMES for v in VERBS for w in VERBS]
TEXTS += [f"The {a} {v}." for a in ("editor", "planner", "scanner") for v in VERBS] * 3
THAI = [f"{a}{v} {b}{w}" for a in ("ระบบส่งออก", "คิวชุดงาน", "คลังกุญแจ") for b in ("คลังกุญแจ", "ระบบส่งออก") for v in ("ซ่อนเลขหน้า", "ลบช่องว่าง") for w in ("ซ่อนเลขหน้า", "ลบช่องว่าง")]
MODEL = Model.train(TEXTS + THAI * 4)


def parts(text):
    return [text[a:b] for a, b in viterbi(text, MODEL)]


def test_abbreviations_decimals_and_quotes():
    assert parts("The editor reads the page. Dr. Velmar noted in sec. 12 that it opens the file again.") == ["The editor reads the page.", "Dr. Velmar noted in sec. 12 that it opens the file again."]
    assert parts("Okrande answered: “It reads the page. It counts the words.” The planner keeps the list.") == ["Okrande answered: “It reads the page. It counts the words.”", "The planner keeps the list."]
    assert parts("The scanner keeps the list at 9.30 a.m. The editor reads the page.") == ["The scanner keeps the list at 9.30 a.m.", "The editor reads the page."]


def test_a_quote_that_opens_the_sentence_stays_with_its_frame():
    assert len(parts("“The editor keeps the list.” Velmar answered.")) == 1


def test_scripts_without_spaces_or_stops():
    assert parts("ระบบส่งออกซ่อนเลขหน้า คลังกุญแจลบช่องว่าง") == ["ระบบส่งออกซ่อนเลขหน้า", "คลังกุญแจลบช่องว่าง"]
    assert len(Model.train(["甲读取文件。乙保存列表。"] * 9).chains) == 1
    m = Model.train(["甲读取文件。乙保存列表。", "乙保存列表。甲读取文件。", "甲读取文件。"] * 9)
    assert len(viterbi("甲读取文件。乙保存列表。", m)) == 2


def test_thai_is_seen_without_stops():
    assert [left_of(f"ระบบส่งออกซ่อนเลขหน้า{x}") for x in (".", "!", "...")] == [left_of("ระบบส่งออกซ่อนเลขหน้า")] * 3
    m = Model.train([t.replace(" ", ". ") + "." for t in THAI] * 4)
    assert all(not k.endswith(".") for k in m.chains["th"].left)
    assert len(viterbi(THAI[0], m)) == len(viterbi(THAI[0].replace(" ", ". "), m)) == 2


def test_edges():
    assert viterbi("", MODEL) == [] and viterbi(" \n\t", MODEL) == []
    assert viterbi("  unfinished text", MODEL) == [(2, 17)]
    long = "The editor reads the page. " * 4000
    assert len(viterbi(long, MODEL)) == 4000


def test_table(spark):
    df = spark.createDataFrame([("b1", "The editor reads the page. The planner keeps the list.", None, 1), ("b2", None, " ", 2)], "block_id string, source_text string, translated_text string, kind int")
    rows = split_sentences(df, MODEL).collect()
    assert {(r.block_id, r.side, r.start_pos, r.end_pos) for r in rows} == {("b1", "source", 0, 26), ("b1", "source", 27, 54)}
    assert split_sentences(df.limit(0), MODEL).count() == 0
