import random

import numpy as np

from folioflow.llm import leakage as K


def test_matches_against_brute_force():
    random.seed(3)
    vocabulary = "abcdef"
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(30))) for i in range(5)]
    docs = [" ".join(random.choice(vocabulary) for _ in range(50)) for _ in range(8)]
    docs[2] = "z " + items[1][1] + " z"
    tests = K.Tests(items, 3)
    got = set(zip(*(x.tolist() for x in K.matches(docs, tests))))
    want = set()
    for d, t in enumerate(docs):
        w = t.split()
        for k, (_, x) in enumerate(items):
            v = x.split()
            for i in range(len(w)):
                for j in range(len(v)):
                    if w[i] != v[j] or i and j and w[i - 1] == v[j - 1]:
                        continue
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    if n >= 3:
                        want.add((d, i, k, j, n))
    assert got == want


def test_suffix_array_is_in_full_order():
    random.seed(8)
    seq = np.array([random.choice([1, 2, 3, -1]) for _ in range(200)] + [-1])
    key = [v if v >= 0 else 100 + i for i, v in enumerate(seq.tolist())]
    assert K.suffix_array(seq, 1000).tolist() == sorted(range(len(seq)), key=lambda i: key[i:])


def test_bounded_steps_give_the_same(monkeypatch):
    random.seed(4)
    items = [(i, " ".join(random.choice("abcdefgh") for _ in range(40))) for i in range(30)]
    docs = [" ".join(random.choice("abcdefgh") for _ in range(60)) for _ in range(9)] + [items[3][1], items[7][1] + " x " + items[3][1]]
    tests = K.Tests(items, 3)
    whole = set(zip(*(x.tolist() for x in K.matches(docs, tests))))
    monkeypatch.setattr(K, "SUFFIXES", 7)
    monkeypatch.setattr(K, "PLACES", 5)
    assert whole == set(zip(*(x.tolist() for x in K.matches(docs, tests)))) and whole


def test_table(spark):
    random.seed(5)
    item = " ".join(f"word{random.randrange(1000)}" for _ in range(60))
    w = item.split()
    changed = " ".join("new" if i % 9 == 4 else x for i, x in enumerate(w))
    other = " ".join(random.sample(w, len(w)))
    rows = [(1, f"before {item.upper()}! after"), (2, changed), (3, " ".join(w[:20])), (4, other), (5, None), (6, ""), (7, " ".join(w[:18]) + " gap " * 20 + " ".join(w[30:55])), (1, f"before {item.upper()}! after")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(9, item), (9, item), (10, None), (11, "")], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in K.find_leaks(docs, items).collect()) == [(1, 9), (2, 9), (7, 9)]
    places = {r.doc_id: (r.start_word, r.end_word) for r in K.find_leaks(docs, items).collect()}
    assert places[1] == (1, 61) and places[2][0] <= 1
    assert K.find_leaks(docs, items.limit(0)).count() == 0 and K.find_leaks(docs.limit(0), items).count() == 0
    assert {r.doc_id for r in K.remove_leaks(docs, K.find_leaks(docs, items)).collect()} == {3, 4, 5, 6}
