from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import pairs as P

A = P.refusal_automaton()
SRC = "The page planner removes the double spaces and keeps every heading in order."


def test_defects():
    assert P.judge(SRC, " ​", "fr", A) == "empty" and P.judge(SRC, None, "fr", A) == "empty"
    assert P.judge(SRC, "12", "fr", A) == "empty" and P.judge("Page 6 of 9", "6", "fr", A) == "" and P.judge("4", "", "fr", A) == "empty"
    assert P.judge(SRC, "I’m sorry, but I can’t translate this passage.", "fr", A) == "refusal"
    assert P.judge(SRC, "Yulvick said: “Sorry, I cannot translate page 9.” Le planificateur retire les espaces et garde chaque titre.", "fr", A) == ""
    assert P.judge(SRC, "> " + SRC.replace("double", "doubled"), "fr", A) == "copied"
    assert P.judge(SRC, "Der Planer entfernt die doppelten Leerzeichen und behält jede Überschrift in der Reihenfolge.", "fr", A) == "wrong_language"
    assert P.judge(SRC, "Le planificateur retire les espaces en double et garde chaque titre dans l'ordre.", "fr", A) == ""
    assert P.judge("export --format docx", "export --format docx", "fr", A) == "" and P.judge("Lumora Flow 5.8", "Lumora Flow 5.8", "fr", A) == ""


def test_refusals_after_a_preamble_or_a_long_quotation():
    sorry = "I’m sorry, but I can’t translate this passage."
    assert P.judge(SRC, "Thank you for the text. " * 9 + sorry, "fr", A) == "refusal"
    assert P.judge(SRC, f"“{SRC * 8}” {sorry}", "fr", A) == "refusal"
    # further on, what the source declines may be its translation
    assert P.judge("The page is long. " * 9 + sorry, "La page est longue. " * 9 + "Je ne peux pas traduire ce passage.", "fr", A) == ""


def test_an_answer_that_repeats_the_prompt():
    assert P.copied_share(SRC, " ".join([SRC] * 12)) > 0.9
    assert P.judge(SRC, " ".join([SRC] * 12), "fr", A) == "copied"


@settings(max_examples=200, deadline=None)
@given(st.text("abcdefgh ", min_size=1, max_size=60), st.text("abcdefgh ", max_size=60), st.integers(1, 9))
def test_no_copy_is_ruled_out_without_the_automaton(prompt, other, times):
    p, a = " ".join(prompt.split()), " ".join((prompt * times + other).split())
    share = P.SuffixAutomaton(p).covered(a, P.RUN)
    assert share < P.COPIED or P.copied_share(prompt, a) >= P.COPIED


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40), st.integers(1, 6))
def test_automaton_against_brute_force(prompt, answer, run):
    hit = [False] * len(answer)
    for i in range(len(answer)):
        for j in range(i + run, len(answer) + 1):
            if answer[i:j] in prompt:
                hit[i:j] = [True] * (j - i)
    assert P.SuffixAutomaton(prompt).covered(answer, run) == sum(hit) / max(1, len(answer))


def test_table(spark):
    rows = [("b1", "p", "d", SRC, "", "translated"), ("b2", "p", "d", SRC, SRC, "reviewed"), ("b3", "p", "d", SRC, SRC, "pending"), ("b4", "p", "d", SRC, "Le planificateur retire « les espaces", "translated"), ("b5", "p", "d", None, None, None)]
    b = spark.createDataFrame(rows, "block_id string, project_id string, document_id string, source_text string, translated_text string, unit_status string")
    docs = spark.createDataFrame([("d", "fr"), ("d", "fr")], "document_id string, target_language string")
    assert {tuple(r) for r in P.pair_defects(P.examine(b, P.targets(b, docs))).collect()} == {("b1", "empty"), ("b2", "copied"), ("b4", "truncated")}
    assert P.pair_defects(P.examine(b.limit(0), P.targets(b, docs))).count() == 0
