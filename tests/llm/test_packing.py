import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm.packing import best_fit, divide, fill_report, fullest_first, mix_windows, pack, pack_calls, round_robin


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from("abc")), max_size=40), st.integers(50, 90))
def test_nothing_lost_nothing_over(items, capacity):
    sizes, queues = [s for s, _ in items], [q for _, q in items]
    for bins in (pack(sizes, queues, capacity), best_fit(sizes, capacity), round_robin(sizes, queues, capacity), fullest_first(sizes, capacity)):
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
    assert len(pack(sizes, queues, capacity)) <= max(len(best_fit(sizes, capacity)), len(round_robin(sizes, queues, capacity)))


def test_divide():
    assert divide(10, 4) == [3, 3, 4] and sum(divide(1001, 256)) == 1001


def test_windows_keep_proportions():
    sizes, queues = [1] * 400, ["a"] * 300 + ["b"] * 100
    for b in round_robin(sizes, queues, 40)[:-1]:
        assert abs(sum(queues[i] == "a" for i in b) - 30) <= 1


def test_table(spark):
    u = lambda *x: [(i, "t", n) for i, n in x]
    rows = [("c1", u(("d_p0_b1", 300), ("d_p0_b2", 100), ("d_p0_b2", 100)), 256, 1), ("c1", u(("d_p0_b1", 300), ("d_p0_b2", 100), ("d_p0_b2", 100)), 256, 1), ("c2", u(("x", 9)), None, 1), ("c3", None, 5, 1), ("c4", [], 5, 1)]
    df = spark.createDataFrame(rows, "call_id string, units array<struct<id string, text string, tokens int>>, max_output_tokens int, capacity int")
    got = pack_calls(df).collect()
    assert {(r.unit_id, r.n_parts) for r in got if r.oversized} == {("d_p0_b1", 2)}
    assert sum(r.tokens for r in got if r.call_id == "c1") == 400
    assert [(r.unit_id, r.request_no) for r in got if r.call_id == "c2"] == [("x", 0)]
    assert {r.call_id for r in got} == {"c1", "c2"}


def test_many_units_are_packed_as_well_as_few():
    draw = random.Random(2)
    for n in (399, 401, 900):
        sizes = [draw.randint(200, 480) for _ in range(n)]
        bins = pack(sizes, ["q"] * n, 1000)
        assert len(bins) <= min(len(best_fit(sizes, 1000)), len(fullest_first(sizes, 1000)))
        assert sorted(i for b in bins for i in b) == list(range(n))


def test_windows_of_a_corpus(spark):
    draw = random.Random(4)
    rows = [(f"i{k}", draw.choices("abc", [6, 3, 1])[0], draw.randint(1, 60)) for k in range(3000)] + [("i5", "a", 7), ("big", "a", 1300), (None, "a", 3), ("n", None, 3), ("m", "a", None)]
    df = spark.createDataFrame(rows, "item_id string, source string, tokens int")
    got = mix_windows(df, 500, part_tokens=20_000).collect()
    ids = {r[0] for r in rows if r[0] and r[1] and r[2] is not None}
    assert {r.item_id for r in got} == ids and len(got) == len(ids) + 2  # the large one in three
    room, mix = Counter(), Counter()
    for r in got:
        room[r.window_id] += r.tokens
        mix[r.window_id, r.source] += r.tokens
    assert max(room.values()) <= 500 and len({w.split("_")[0] for w in room}) > 2
    want = sum(r.tokens for r in got if r.source == "a") / sum(room.values())
    full = [w for w in room if room[w] >= 480]
    assert len(full) > len(room) * 0.8
    assert sum(abs(mix[w, "a"] / room[w] - want) for w in full) / len(full) < 0.1
    aimed = mix_windows(df, 500, {"b": 1.0, "c": 1.0}, part_tokens=20_000).collect()
    assert sum(r.tokens for r in aimed) == sum(room.values())
    assert mix_windows(df.limit(0), 500).count() == 0


def test_fill_report(spark):
    df = spark.createDataFrame([("c", [(f"b{i}", "t", 60) for i in range(5)], 100)], "call_id string, units array<struct<id string, text string, tokens int>>, max_output_tokens int")
    assert fill_report(pack_calls(df)).collect() == [("c", 5, 3, 200, 0)]
