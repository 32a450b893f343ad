import random

from folioflow.llm import truncation as t


def test_ends_that_tell_by_themselves():
    assert t.assess('{"a": "text"}', True)[0] == "whole"
    assert t.assess('{"a": "text', True)[0] == "cut"
    assert t.assess('```json\n{"a": "text"}', True)[0] == "cut"
    assert t.assess("He said: “Wait", False)[0] == "cut"
    assert t.assess("half a cha�", False)[0] == "cut"
    assert t.assess("the rest is mis...", False)[0] == "cut"
    assert t.assess("A whole sentence.", False) == ("ask", "sentence", True)
    assert t.assess(" ​ ", False)[0] == "whole" and t.assess("…", False)[0] == "whole"


def test_recounted_lengths():
    x = "a<b\né😀"
    assert t.COUNTS["chars"](x) == 6 and t.COUNTS["utf8"](x) == 10 and t.COUNTS["utf16"](x) == 7
    assert t.COUNTS["entities"](x) == 9 and t.COUNTS["json"](x) == 7 and t.COUNTS["crlf"](x) == 7


def test_table(spark):
    whole = [("block", f"w{i}", f"The editor number {i} reads every single page of the long report on older machines.") for i in range(60)]
    heads = [("block", f"h{i}", "The editor on older machines") for i in range(20)]
    cut = [("block", "c1", "The editor reads every page because the pla"), ("block", "c2", "The editor reads “every page")]
    rows = [(a, b, "p", "q", False, c) for a, b, c in whole + heads + cut]
    df = spark.createDataFrame(rows, "record_kind string, record_id string, provider string, project_id string, structured boolean, text string")
    m = t.measure(df)
    got = t.truncated(m)
    assert {r.record_id for r in got.collect()} == {"c1", "c2"}
    rates = t.rates(m, got).where("project_id = 'q'").collect()
    assert [(r.n, r.n_truncated) for r in rates] == [(82, 2)]
    assert t.truncated(t.measure(df.limit(0))).count() == 0


def _broken(i: int) -> str:
    """Three letters that end no text twice."""
    return "".join(chr(97 + i // k % 26) for k in (1, 26, 676))


def test_hidden_limit(spark):
    rows = [("block", f"x{i}", "p", "q", False, ("The editor reads every page " * 5)[:117] + _broken(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "record_kind string, record_id string, provider string, project_id string, structured boolean, text string")
    limits = {(r.unit, r.length) for r in t.hidden_limits(t.measure(df)).collect()}
    assert ("chars", 120) in limits


def _limits(spark, lengths):
    rows = [("block", f"x{i}", "p", "q", False, (f"{i:04} " + "The editor reads every page " * 99)[: n - 3] + _broken(i)) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "record_kind string, record_id string, provider string, project_id string, structured boolean, text string")
    return {r.length for r in t.hidden_limits(t.measure(df)).where("unit = 'chars'").collect()}


def test_limit_at_any_length(spark):
    assert _limits(spark, [255] * 8 + [1024] * 12 + [*range(1014, 1024)] + [300, 300, 300, 301, 301, 302, 303]) == {255, 1024}


def test_limit_among_many_texts(spark):
    around = [n for n in range(105, 136) for _ in range(4)]
    assert _limits(spark, around + [120] * 20) == {120}
    assert _limits(spark, around * 3) == set()


def test_planted_limits_of_other_units(spark):
    draw = random.Random(3)

    def prose(n):
        word = lambda: "".join(draw.choices("abcdefghijklmnoprstuvwzäé", k=draw.randint(2, 9)))
        return " ".join(word() + draw.choice(["", "", "", " &", " “so”"]) for _ in range(n))

    def until(count, n):
        text = prose(400)
        while count(text) > n:
            text = text[:-1]
        return text if count(text) == n and text[-1].isalpha() else until(count, n)

    plan = [("a", "chars", 255), ("b", "utf8", 255), ("c", "entities", 1023), ("d", "crlf", 50)]
    rows = [("block", f"{k}{i}", k, "q", False, until(t.COUNTS[unit], n)) for k, unit, n in plan for i in range(25)]
    rows += [("block", f"{k}n{i}", k, "q", False, prose(200)[: 30 + 17 * i % 900]) for k, *_ in plan for i in range(60)]
    df = spark.createDataFrame(rows, "record_kind string, record_id string, provider string, project_id string, structured boolean, text string")
    found = {(r.source, r.unit, r.length) for r in t.hidden_limits(t.measure(df)).collect()}
    assert {(k, unit, n) for k, unit, n in plan} <= found


def test_same_text_again_is_no_limit(spark):
    rows = [("block", f"x{i}", "p", "q", False, "The editor") for i in range(50)]
    df = spark.createDataFrame(rows, "record_kind string, record_id string, provider string, project_id string, structured boolean, text string")
    assert t.hidden_limits(t.measure(df)).count() == 0
