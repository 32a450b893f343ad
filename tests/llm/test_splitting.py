import random

from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm.split import cut, split_oversized


def check(text, limit, overlap):
    spans = cut(text, limit, overlap)
    o = min(overlap, limit - 1)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= limit for a, b in spans)
    assert all(c == b - o for (_, b), (c, _) in zip(spans, spans[1:]))
    return spans


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,\n。ก\U0001f600́", max_size=300), st.integers(1, 60), st.integers(0, 70))
def test_limits_and_overlap_hold(text, limit, overlap):
    check(text, limit, overlap)


def test_cuts_at_the_strongest_boundary():
    text = "one two three four. Five six seven eight nine ten eleven"
    (_, end), *_ = check(text, 40, 0)
    assert text[:end] == "one two three four. "


def test_no_boundary_adds_pieces_then_cuts_anywhere():
    assert len(check("x" * 100, 30, 5)) >= 4


def test_table(spark):
    random.seed(1)
    long = " ".join(random.choice(["alpha", "beta.", "gamma,"]) for _ in range(400))
    rows = [("a", "d1", 1, long, 9), ("a", "d1", 1, long, 9), ("a", "d1", 2, "short", 9), ("a", "d2", 1, None, 9), ("a", "d2", 2, "", 9), ("b", "d3", 1, long, 9)]
    items = spark.createDataFrame(rows, "item_kind string, document_id string, item_no int, text string, max_chars int")
    limits = spark.createDataFrame([("a", 200, 20), ("a", 200, 20), (None, 5, 1)], "item_kind string, max_chars int, overlap_chars int")
    got = split_oversized(items, limits).collect()
    assert {(r.document_id, r.item_no) for r in got} == {("d1", 1)}
    assert [r.piece_no for r in sorted(got, key=lambda r: r.piece_no)] == list(range(got[0].n_pieces))
    assert all(r.text == long[r.start_pos : r.end_pos] and len(r.text) <= 200 for r in got)
    assert split_oversized(items.limit(0), limits).count() == 0
