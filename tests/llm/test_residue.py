import functools
import random
from collections import Counter

import numpy as np

from folioflow.llm import ngrams
from folioflow.llm import residue as R

SUBJECTS = ["the editor", "the planner", "a signed contract", "the night shift", "our archive", "the style sheet"]
VERBS = ["keeps every heading in order", "removes the double spaces", "counts the words of each unit", "opens the old folder again", "prints a list of the open pages", "compares both columns"]
WHEN = ["during a slow upload", "at the end of the month", "before the backup", "for scanned letters", "without any network"]
PROSE = [f"{s} {v} {w}." for s in SUBJECTS for v in VERBS for w in WHEN] + ["the help page lists what an error means.", "the log may hold a message for the review desk."]


@functools.cache
def models() -> R.Models:
    return R.Models(PROSE)


def test_fields_of_shapes_not_listed():
    m = models()
    get = lambda t: [f for f, *_ in m.fields.unfilled(t, m.prose)]
    assert get("Dear {{ name }}, your order ##order_no## is ready.") == ["{{ name }}", "##order_no##"]
    for held_out in ("[Customer Name]", "<Your Name Here>", "[Nombre del cliente]", "[Ihr Unternehmen]", "<<Kundenname>>", "{{ patient.surname }}", "[INSERT ADDRESS]", "%(due_date)s", "__________", "DD/MM/YYYY"):
        assert get(f"Dear {held_out}, welcome.") == [held_out]
    assert get("Keep `{name}` and the mark “${title}” unchanged.\n```\nexport job-{n}\n```") == []
    for prose in ("plain text: a [link](x) and 5 < 6", "as shown before [12], see (fig. 3) and [sic]", "it costs $5 or 40% (see ch. 7)", "at 10:30: two rows", "<b>bold</b> and __init__"):
        assert get(prose) == []


def test_held_out_wording():
    m = models()
    said = {
        "error_page": ["the page you asked for could not be found on this server.", "your session has timed out. please sign in again.", "502 bad gateway: the server did not respond", "the service is unavailable at the moment, please try again later."],
        "script_notice": ["this website needs javascript enabled to work.", "please allow javascript in your browser and reload the page.", "your browser has javascript disabled."],
        "filler": ["lorem ipsum dolor sit amet consectetur.", "placeholder text, replace before release.", "text goes here.", "test test test test test test"],
    }
    for kind, texts in said.items():
        for t in texts:
            got = [R.KINDS[k] for b, k in zip(*m.judge(R.windows(t))[:2]) if b > 1]
            assert kind in got, t
    for t in PROSE[::7]:
        assert not any(b > 1 for b in m.judge(R.windows(t))[0]), t


def test_invented_words():
    draw = random.Random(5)
    parts = ["bra", "zil", "kom", "ter", "vu", "ong", "stip", "fal", "mer"]
    text = " ".join(" ".join("".join(draw.choices(parts, k=draw.randint(1, 3))) for _ in range(9)) + "." for _ in range(5))
    m = models()
    assert sum(m.judge(R.windows(text))[3]) >= R.STRANGE
    shuffled = " ".join(draw.sample(" ".join(PROSE).replace(".", "").split(), 40)) + "."
    assert sum(m.judge(R.windows(shuffled))[3]) < R.STRANGE


def test_ngrams_back_off():
    m = ngrams.Model(["abcabcabc", "abcabd"], 14)
    x, at = ngrams.codes(["abcabc", "xyzxyz"])
    a, b = ngrams.sums(m.log(ngrams.all_grams(x, 14)), at)
    assert a > b
    # what neither side has seen tells nothing
    other = ngrams.Model(["qqqq"], 14)
    x, at = ngrams.codes(["xyzxyz"])
    h = ngrams.all_grams(x, 14)
    assert ngrams.sums(m.ratio(h, other.log(h), 0.9), at)[0] <= 0


def test_table(spark):
    rows = [
        (1, "Lorem ipsum dolor sit amet, consectetur adipiscing elit."), (2, "Error 404: Page not found."), (3, "The editor keeps every heading in order.\n\nPlease enable JavaScript in your browser to view this page."),
        (4, "The editor keeps every heading in order."), (5, "The log may hold a message for the review desk."), (6, "If you see “404 Page not found”, check the spelling of the link."), (7, None), (8, ""), (9, " \n"), (10, "[INSERT NAME HERE] counts the words of each unit."), (10, "[INSERT NAME HERE] counts the words of each unit."),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = R.find_residue(docs, models())
    assert sorted((r.doc_id, r.residue) for r in got.distinct().collect()) == [(1, "filler"), (2, "error_page"), (3, "script_notice"), (10, "placeholder")]
    assert {r.doc_id for r in R.exclude(docs, got).collect()} == {4, 5, 6, 7, 8, 9}
    assert R.find_residue(docs.limit(0), R.Models([])).count() == 0
    assert R.sample(docs.limit(0)) == []


def test_models_of_all_texts(spark, monkeypatch):
    """Above the size that the driver takes, every window of every text counts, in numpy as in the table."""
    monkeypatch.setattr(R, "SMALL_CHARS", 0)
    monkeypatch.setattr(R, "sample", None)
    draw = random.Random(3)
    texts = [" ".join(draw.choices(PROSE, k=3)) for _ in range(400)] + ["lorem ipsum dolor sit amet, consectetur adipiscing elit."] * 3 + [None, "", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want: list[Counter] = [Counter(), Counter()]
    for t in texts:
        if t:
            for w in R.windows(t):
                want[R.side(w)][w] += 1
    every = R.window_counts(docs)
    assert {(r.side, r.w): r.n for r in every.collect()} == {(s, w): n for s in (0, 1) for w, n in want[s].items()}
    rows = R.counts(every).collect()
    for s in (0, 1):
        assert sum(r.n for r in rows if (r.what, r.side) == ("prose", s)) == sum(len(w) + 1 for w in want[s])
        assert {r.word: r.n for r in rows if (r.what, r.side) == ("word", s)} == Counter(x for w, n in want[s].items() for x in R.WORD.findall(w) * n)
    first = R._models(R.counts(every), (0, 1))
    for s in (0, 1):
        whole = ngrams.Model(sorted(want[s]), R.PROSE_BITS)
        for a, b in zip([*first[s].prose.seen, *first[s].prose.left], [*whole.seen, *whole.left]):
            assert np.array_equal(np.isnan(a), np.isnan(b)) and np.mean(~np.isclose(a, b, atol=1e-4, equal_nan=True)) < 1e-4
    got = R.fit(docs)
    small = R.Models([w for t in texts if t for w in R.windows(t)])
    assert got.common == small.common and np.allclose(got.usual["la"], small.usual["la"], atol=0.02)
    for a, b in zip(got.prose.seen, small.prose.seen):
        assert np.array_equal(np.isnan(a), np.isnan(b))
    # residue is out of the prose
    assert sum(map(len, want)) - sum(1 for s in (0, 1) for w in want[s] if "lorem" in w) == R.counts(every, first).where("what = 'prose' AND low % 2097152 = 3").agg({"n": "sum"}).first()[0]
    found = R.find_residue(docs, got).collect()
    assert {r.doc_id for r in found} == {400, 401, 402} and {r.residue for r in found} == {"filler"}


def test_small_tables_are_whole(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PROSE)], "doc_id bigint, text string")
    a, b = R.fit(docs), models()
    assert isinstance(a, R.Models) and a.usual == b.usual and a.common == b.common
    assert all(np.array_equal(x, y, equal_nan=True) for x, y in zip(a.prose.seen, R.Models([w for t in PROSE for w in R.windows(t)]).prose.seen))
