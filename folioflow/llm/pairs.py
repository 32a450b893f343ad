"""Problem 6: broken prompt and response pairs.

Copied answers are found by running the answer through a suffix automaton of
the prompt, refusals by an automaton of their phrases at the head of the
answer, cut answers by stacks of delimiters and the corpus's ends (see
truncation), and answers in a third language by votes of function words.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.arrow import map_rows
from folioflow.llm import truncation
from folioflow.llm.language import CODEY, plain, script_counts

#: Function words that vote for a language written in Latin letters.
STOPWORDS = {
    "en": "the a an of to in and is are was were that this for with on at by from it its when before after during each both any end as or not",
    "fr": "le la les l un une des du de d et est sont que qui pour avec dans sur sous par au aux ce cette quand avant après pendant sans chaque en ne pas",
    "de": "der die das den dem des ein eine einer eines und ist sind dass für mit im in auf von vom zum zur bei nach vor während ohne jedes jeder nicht um am",
    "es": "el la los las un una unos del de y es son que para con en por al lo se cuando antes tras durante sin cada ambas dos no su otra",
    "pt": "o a os as um uma dos das do da de e é são que para com em no na nos nas por ao quando antes após durante sem cada duas não outra pela",
    "id": "yang dan di ke dari untuk dengan pada dalam adalah ini itu setiap sebelum setelah selama ketika tanpa kedua apa pun oleh tidak atau karena sebuah",
}
VOTE = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words.split():
        VOTE.setdefault(_w, []).append(_lang)
SCRIPT_LANG = {"thai": "th", "burmese": "my", "cyrillic": "ru"}

#: Stems of phrases that decline a request, as they stand in the first sentence.
REFUSALS = {
    "en": ["i cannot help", "i can't help", "i can not help", "can't translate", "cannot translate", "can not translate", "unable to translate", "not able to produce", "not able to translate", "unable to assist", "can't assist", "cannot assist", "unable to help", "must decline", "have to decline", "i decline", "something i won't do", "i won't translate", "i will not translate", "cannot be translated", "can't be translated", "cannot comply", "can't comply", "unable to comply", "can't fulfil", "cannot fulfil", "against the usage policy", "against my guidelines", "cannot provide", "can't provide this", "no translation can be given", "no translation can be provided", "falls outside what i may", "outside what i can", "don't feel comfortable", "not comfortable", "i will not translate", "not permitted to", "not allowed to translate"],
    "fr": ["ne peux pas traduire", "ne peux pas vous aider", "ne peux pas aider", "ne suis pas en mesure", "ne puis traduire", "refuse de traduire", "impossible de traduire", "ne peux répondre", "ne peux pas répondre à cette demande", "ne peux pas donner suite", "dois refuser", "ne peut pas être traduit", "dois décliner", "impossible de répondre", "impossible de vous aider", "n'ai pas le droit de traduire"],
    "de": ["kann ich nicht übersetzen", "kann ich leider nicht helfen", "kann diesen text nicht übersetzen", "nicht übersetzen", "kann ich nicht helfen", "muss ich ablehnen", "lehne ich ab", "nicht in der lage", "darf ich nicht", "nicht behilflich sein"],
    "es": ["no puedo traducir", "no puedo ayudar", "no me es posible traducir", "no es posible traducir", "debo rechazar", "no estoy en condiciones", "no puedo atender", "no puedo cumplir", "no puedo realizar esta", "tengo que rechazar", "no me es posible", "no me está permitido"],
    "pt": ["não posso traduzir", "não posso ajudar", "não consigo traduzir", "não é possível traduzir", "devo recusar", "não posso atender", "preciso recusar", "não posso cumprir", "recuso", "não consigo atender", "não consigo ajudar", "não me é possível", "não me é permitido"],
    "id": ["tidak dapat menerjemahkan", "tidak bisa menerjemahkan", "tidak dapat membantu", "tidak bisa membantu", "harus menolak", "tidak dapat memenuhi", "tidak bisa memenuhi"],
    "ru": ["не могу перевести", "не могу помочь", "не могу выполнить", "вынужден отказать", "вынуждена отказать", "отказываюсь", "не в состоянии перевести", "не буду переводить", "невозможно перевести"],
    "zh": ["无法翻译", "不能翻译", "无法提供帮助", "无法协助", "不能提供", "无法帮助", "无法完成", "无法满足", "拒绝翻译", "无法处理这", "不便翻译"],
    "ja": ["翻訳できません", "お手伝いできません", "訳すことができません", "訳すことはできません", "お応えできません", "お断り", "対応できません", "訳せません", "応じられません", "翻訳することはできません"],
    "th": ["ไม่สามารถแปล", "ไม่สามารถทำตาม", "ไม่สามารถช่วย", "แปลข้อความนี้ไม่ได้", "แปลไม่ได้", "ขอปฏิเสธ", "ไม่อาจแปล", "ช่วยเรื่องนี้ไม่ได้", "ไม่สามารถดำเนินการ"],
    "my": ["ဘာသာမပြန်နိုင်ပါ", "ဘာသာပြန်မပေးနိုင်ပါ", "ဘာသာပြန်ပေး၍ မရပါ", "မဆောင်ရွက်ပေးနိုင်ပါ", "မကူညီနိုင်ပါ", "ငြင်းပယ်", "ဘာသာပြန်ပေးနိုင်ခြင်း မရှိ", "မပြန်ဆိုနိုင်ပါ", "ဘာသာပြန် မပေးနိုင်ပါ", "ဘာသာပြန်ပေးရန် မဖြစ်နိုင်ပါ", "ကူညီ၍ မရပါ", "ဘာသာပြန်ပေးရန် ခွင့်မပြု", "ခွင့်မပြုပါ"],
}
QUOTED = re.compile(r"“[^”]*(?:”|$)|„[^“]*(?:“|$)|«[^»]*(?:»|$)|「[^」]*(?:」|$)|\"[^\"]*(?:\"|$)")

#: Shortest copied run, least share of the answer that must be copied, and fewest letters of prose.
RUN, COPIED, PROSE = 12, 0.6, 12
#: Where the head of an answer ends, in characters.
HEAD = 110


def refusal_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrases in REFUSALS.values():
        for p in phrases:
            a.add_word(p, p)
    a.make_automaton()
    return a


def own_words(text: str) -> str:
    """The text in lower case without quoted speech."""
    return QUOTED.sub(" ", text.replace("’", "'")).lower().strip()


def refuses(text: str, automaton: ahocorasick.Automaton, source: str = "") -> bool:
    """True if the answer's own words decline the request; quoted speech doesn't count.

    At its head (HEAD) any phrase tells; further on, after a preamble, one does
    unless the source has such a phrase too, which the answer may only translate.
    """
    found = [end for end, _ in automaton.iter(own_words(text))]
    return bool(found) and (min(found) < HEAD or not any(automaton.iter(source.replace("’", "'").lower())))


class SuffixAutomaton:
    """All substrings of a text, for streaming matches."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    k = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.length.append(self.length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = k
                        p = self.link[p]
                    self.link[q] = self.link[cur] = k
            last = cur

    def covered(self, text: str, run: int) -> float:
        """Share of ``text`` in substrings of at least ``run`` characters of the automaton's text."""
        state = size = done = hit = 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            else:
                size = 0
            if size >= run:
                a = max(done, i + 1 - size)
                hit += i + 1 - a
                done = i + 1
        return hit / max(1, len(text))


def copied_share(prompt: str, answer: str) -> float:
    """Share of the answer that runs of the prompt cover; case, spacing, numbers and cell marks don't count."""
    p, a = (" ".join(re.sub(r"[\d|.,•*-]+", " ", plain(x)).lower().split()) for x in (prompt, answer))
    if not a:
        return 0.0
    run = RUN if a.isascii() or len(a.encode()) < 2 * len(a) else RUN // 2 + 2
    if p == a:
        return 1.0
    half = max(2, run // 2)
    # a run of L covered characters holds at least L / 3 in whole blocks of the answer, so clear cases need no automaton
    if sum(a[i : i + half] in p for i in range(0, len(a), half)) * half * 3 < len(a) * COPIED:
        return 0.0
    return SuffixAutomaton(p).covered(a, run)


class Profile:
    """A text without addresses and numbers, and its letters by script, worked out once."""

    def __init__(self, text: str):
        self.plain = plain(text)
        self.scripts = script_counts(self.plain)
        self.code = bool(CODEY.search(text))


def votes(p: Profile) -> tuple[str | None, float]:
    """(language, lead from 0 to 1) by script and function words; None for what has none."""
    n = p.scripts
    other = {k: v for k, v in n.items() if k != "latin"}
    if other and sum(other.values()) * 2 >= n.get("latin", 0):
        if other.get("kana") and other["kana"] * 12 >= other.get("han", 0):
            return "ja", 1.0
        top = max(other, key=other.get)
        return ("zh" if top == "han" else SCRIPT_LANG.get(top, "ja")), 1.0
    words = re.findall(r"[^\W\d_]+", p.plain.lower())
    score: dict[str, float] = {}
    for w in words:
        langs = VOTE.get(w)
        if langs:
            for x in langs:
                score[x] = score.get(x, 0.0) + 1 / len(langs)
    if not score:
        return None, 0.0
    order = sorted(score.items(), key=lambda x: (-x[1], x[0]))
    lead = (order[0][1] - (order[1][1] if len(order) > 1 else 0)) / order[0][1]
    return (order[0][0], lead) if order[0][1] >= 1.5 and lead >= 0.25 else (None, lead)


def is_prose(p: Profile) -> bool:
    """False for code, bare numbers and names: what may stay as it is."""
    if p.code:
        return False
    if sum(v for k, v in p.scripts.items() if k != "latin") >= PROSE // 2:
        return True
    words = re.findall(r"[^\W\d_]+", p.plain)
    return sum(1 for w in words if w[:1].islower()) >= 2 and sum(map(len, words)) >= PROSE


def judge(source: str, answer: str | None, target: str | None, automaton) -> str:
    """The defect by the pair alone: empty, refusal, copied, wrong_language, or '' for none."""
    if answer is None or not re.search(r"[^\W\d_]", answer):
        # a number stands for a number, but not for prose
        bare = answer is not None and re.search(r"\d", answer)
        return "empty" if (is_prose(Profile(source)) if bare else re.search(r"\w", source)) else ""
    if refuses(answer, automaton, source):
        return "refusal"
    a = Profile(answer)
    if not is_prose(a):
        return ""
    said, _ = votes(a)
    # a copy is in the source's language; the target's own can only be one if the source is in it, which is right
    if said and said == target:
        return ""
    if copied_share(source, answer) >= COPIED:
        return "copied"
    if said and target:
        s = Profile(source)
        own, _ = votes(s) if is_prose(s) else (None, 0.0)
        if own and said != own:
            return "wrong_language"
    return ""


def targets(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(block_id, target): each block's target language, from ids alone; blocks of unknown documents have none."""
    t = documents.where("document_id IS NOT NULL").groupBy("document_id").agg(F.max("target_language").alias("target"))
    return blocks.select("block_id", "document_id").join(t, "document_id").groupBy("block_id").agg(F.max("target").alias("target"))


def examine(blocks: DataFrame, target: DataFrame) -> DataFrame:
    """Each newest block's defect by the pair alone, with what truncation.measure() says of its translation, in one pass.

    blocks: block_id, project_id, source_text, translated_text, unit_status,
    one row a block and partitioned by block_id as tables.newest() leaves it,
    so that the join with target (of targets()) moves no texts. defect is null
    for units that aren't finished.
    """
    rows = blocks.join(target, "block_id", "left")

    def make():
        automaton = refusal_automaton()

        def kernel(block, project, source, answer, status, target):
            out = [[] for _ in range(10)]
            for b, p, s, a, st, t in zip(block, project, source, answer, status, target):
                defect = judge(s or "", a, t, automaton) if st in ("translated", "reviewed") else None
                m = truncation.measure_text(a, False) if a is not None else ("whole", None, True, None, 0)
                for col, v in zip(out, ("export_block", b, None, p, *m, defect)):
                    col.append(v)
            return out

        return kernel

    return map_rows(rows.select("block_id", "project_id", "source_text", "translated_text", "unit_status", "target"), truncation.MEASURED + ", defect string", make)


def pair_defects(examined: DataFrame) -> DataFrame:
    """(block_id, defect): one defect of each defective pair, from examine()'s rows (settled).

    Only finished units count (translated or reviewed). In this order: empty,
    refusal, copied, wrong_language, truncated; a pair whose answer breaks off
    in the wrong language is of the wrong language. A null target leaves
    languages unjudged; null sources count as empty texts. A pair's end is
    judged against the ends of all translations.
    """
    cut = truncation.truncated(examined).select(F.col("record_id").alias("block_id")).distinct().withColumn("cut", F.lit(True))
    own = examined.where("defect IS NOT NULL").select(F.col("record_id").alias("block_id"), "defect")
    return own.join(cut, "block_id", "left").select("block_id", F.when(F.col("defect") != "", F.col("defect")).when(F.col("cut"), "truncated").alias("defect")).where("defect IS NOT NULL")
