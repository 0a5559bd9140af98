"""Problem 2: flag answers that are no usable answer to their question.

Defects, of which an answer has one at most; the first that holds counts:

* `empty`: no letter or digit is left once markup, invisible characters and words for null are gone.
* `copy`: a suffix automaton of the question is traversed with the answer; all that the answer says,
  but for a few letters, is covered by long stretches of the question.
* `refusal`: an automaton over act phrases ("answer", "help") and inability phrases ("cannot",
  "decline") reaches both near each other, or a phrase that declines by itself.
* `other_language`: script and stopword votes give a sentence another language than the question's,
  and the question does not ask for that language.
* `truncated`: a delimiter stack is not empty at the end, the answer ends in a mark or a word that
  must go on, or the place where it ends is one where the answers of the corpus go on. The last is
  counted over the whole corpus: of all places with the same characters before them, how many end.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftdocs.llm.lookalike import Table, classes
from weftdocs.session import cut, spread, table

# ---- fixed values: word lists ----
NULL_WORDS = {"null", "none", "nil", "nan", "na", "n/a", "#n/a", "undefined", "nul", "(null)", "<na>", "nat", "void"}
ACTS = ["お答え", "回答", "返答", "答える", "お手伝い", "対応", "お話し", "お伝え", "ご案内", "ご提供", "お示し", "コメント", "answer", "help", "assist", "respond", "reply", "comment", "discuss", "share", "say", "provide", "disclose"]
INABILITY = ["できません", "できかね", "しかね", "かねます", "控え", "立場にありません", "ご遠慮", "お断り", "can't", "cannot", "can not", "unable to", "won't", "will not", "not able to", "must decline", "have to decline", "decline to", "inappropriate for me", "not permitted to", "not allowed to", "rather not", "keep me from", "not something i can", "outside what i may"]
ALONE = ["開示しておりません", "ノーコメント", "こちらでは扱えません", "こちらは控えます", "お答えを控え", "回答を控え", "返答を差し控え", "no comment", "i'd rather not", "i can't help", "i cannot help", "i can't assist", "i cannot assist", "inappropriate for me to", "not something i can share", "outside what i may discuss", "guidelines keep me from", "i am not permitted", "i'm not permitted", "i must decline", "i am unable to answer", "i'm unable to"]
FIRST_PERSON = re.compile(r"\b(?:i|i'm|i'd|me|my|we|sorry|unfortunately)\b")
STOPWORDS = {
    "en": "the of and to in is are was were by for with on at that this it as from be has have had will would which who what when where while an a its their there these those they he she we you or but not no if so than then into over under about after before between out up down only also can could may must should do does did been being because until during each both all any",
    "fr": "le la les des du de et est sont pour par dans sur au aux une un que qui ce cette ces ont été pas ne sera avant après avec sans sous plus mais ou où donc elle il ils elles nous vous leur leurs son sa ses en se être avoir",
    "de": "der die das und ist sind für mit im in den dem des ein eine einen einem einer zu zum zur von vom auf aus an am als auch werden wurde wird war waren nicht bei nach über unter vor bis durch oder aber wenn dass sich es sie er wir noch nur hat haben kann muss",
    "es": "el la los las de del y es son para por en con una un que se al fue no",
    "it": "il lo la gli di del della e è sono per con una un che nel non alla",
    "pt": "o a os as de do da e é são para por com uma um que no na não",
}
ASKED_LANGUAGE = {
    "en": re.compile(r"英語|english", re.I), "ja": re.compile(r"日本語|和文|japanese", re.I), "fr": re.compile(r"フランス語|french|français", re.I),
    "de": re.compile(r"ドイツ語|german|deutsch", re.I), "zh": re.compile(r"中国語|chinese", re.I), "ko": re.compile(r"韓国語|korean", re.I), "es": re.compile(r"スペイン語|spanish", re.I),
}
JA_WORDS = ["は", "を", "が", "に", "の", "で", "と", "です", "ます", "した", "する", "から", "まで", "である", "れた"]
OPEN, CLOSE = "([{（「『【［｛〈《“‘", ")]}）」』】］｝〉》”’"
GO_ON_MARKS = "、,，:：;；・(（「『[［{=＝/／&＆"
GO_ON_WORDS = {"and", "or", "the", "a", "an", "of", "to", "in", "by", "with", "for", "on", "at", "from", "but", "because", "which", "that", "und", "der", "et", "de"}
GO_ON_JA = re.compile(r"(?:なお|また|ただし|さらに|そして|しかし|および|または|及び|並びに|ため|ので)$")

LONG_MATCH = 5  # a shorter stretch of the question proves no copy
LEFT_OVER = 0.2  # share of other letters in a reworded copy, which still ends as a question
CONTEXTS = (12, 8, 5, 3, 2)  # characters before a place, the longest known first
SEEN, ENDS = 3, 0.08  # places that make a context known; share of ends under which a place goes on
STOPS = ".。!！?？"
LIST_JA = re.compile("[^。はがを]*、[^。はがを]*")


INVISIBLE = Table(lambda ch: None if unicodedata.category(ch) in ("Cf", "Cc") and ch not in "\n\t" else ch)


def clean(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").translate(INVISIBLE).strip()


def letters(text: str) -> str:
    return re.sub(r"[\W_]+", "", classes(clean(text)).lower())


@lru_cache(4096)
def letters_of_question(question: str) -> str:
    return letters(question)


def is_empty(answer: str | None) -> bool:
    bare = re.sub(r"<[^<>]*>|&[a-z]+;", " ", clean(answer))
    bare = re.sub(r"[*_`~#|>]+", " ", bare).strip()
    return not any(ch.isalnum() for ch in bare) or bare.lower().strip(" .。()[]\"'") in NULL_WORDS


class SuffixAutomaton:
    """All substrings of a text, in linear size."""

    def __init__(self, text: str):
        self.link, self.length, self.next = [-1], [0], [{}]
        last = 0
        for ch in text:
            cur = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][ch]
                if self.length[q] != self.length[p] + 1:
                    twin = self._state(self.length[p] + 1, dict(self.next[q]))
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = twin
                        p = self.link[p]
                    self.link[q] = twin
                    q = twin
                self.link[cur] = q
            last = cur

    def _state(self, length: int, after: dict) -> int:
        self.link.append(0)
        self.length.append(length)
        self.next.append(after)
        return len(self.next) - 1

    def uncovered(self, text: str, least: int) -> int:
        """Characters of text outside all common stretches of at least `least`."""
        state, n, covered, left = 0, 0, 0, 0
        for i, ch in enumerate(text):
            while state and ch not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if ch in self.next[state]:
                state, n = self.next[state][ch], n + 1
            if n >= least:
                left += max(0, i + 1 - n - covered)
                covered = i + 1
        return left + len(text) - covered


@lru_cache(4096)
def automaton(question: str) -> SuffixAutomaton:
    return SuffixAutomaton(question)


ASKING = re.compile(r"(?:[?？]|か|ください|下さい)[。.」』\"”]*$")
LABEL = re.compile(r"^\W*(?:ご?質問|問い?|question|query|q)\s*(?:は|is)?\s*[:：]\s*", re.I)  # stands before a repeated question


def is_copy(question: str | None, answer: str) -> bool:
    q, a = letters_of_question(question or ""), letters(LABEL.sub("", clean(answer)))
    if len(a) <= LONG_MATCH or len(q) <= LONG_MATCH or 2 * len(a) < len(q):
        return False
    left = automaton(q).uncovered(a, LONG_MATCH)
    return left == 0 or (left <= LEFT_OVER * len(a) and bool(ASKING.search(clean(answer))))


@lru_cache(1)
def refusals() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for label, phrases in (("act", ACTS), ("no", INABILITY), ("alone", ALONE)):
        for p in phrases:
            out.add_word(p, (*out.get(p, ()), (label, len(p))))
    out.make_automaton()
    return out


def is_refusal(answer: str) -> bool:
    text = clean(answer).lower().replace("’", "'").replace("‘", "'")
    acts, noes = [], []
    for end, hits in refusals().iter(text):
        for label, n in hits:
            if label == "alone":
                return True
            (acts if label == "act" else noes).append((end + 1 - n, end + 1))
    own = bool(FIRST_PERSON.search(text))
    for s, e in noes:
        japanese = text[s:e] > "\x7f"
        for s2, e2 in acts:
            gap = s - e2 if e2 <= s else s2 - e
            if (japanese and 0 <= s - e2 <= 14) or (not japanese and own and -8 <= gap <= 24):
                return True
    return False


def language(text: str) -> str | None:
    """The language of a sentence, or None for names, values and the like."""
    if re.search("[가-힣]{2}", text):
        return "ko"
    kana = re.findall("[ぁ-ゖ]", text)
    han = re.findall("[一-鿿]", text)
    if kana:
        return "ja" if len(kana) >= 2 and sum(w in text for w in JA_WORDS) >= 2 else None
    if len(han) >= 6 and not re.search("[ァ-ヺ]", text) and sum(text.count(w) for w in "的是为个这将由应了在和该于与并从") >= 1:
        return "zh"
    words = re.findall(r"[^\W\d_]+", text.lower())
    votes = {k: sum(w in v for w in words) for k, v in stopwords().items()}
    best = max(votes, key=votes.get)
    return best if len(words) >= 4 and votes[best] >= 2 else None


@lru_cache(1)
def stopwords() -> dict[str, set[str]]:
    return {k: set(v.split()) for k, v in STOPWORDS.items()}


def is_other_language(question: str | None, answer: str) -> bool:
    q = clean(question)
    own = "ja" if re.search("[ぁ-ゖァ-ヺ]", q) else "ko" if re.search("[가-힣]", q) else "zh" if re.search("[一-鿿]", q) else language(q) or "en"
    for s in re.split(r"[。！？\n]+|[.!?](?=\s|$)", clean(answer)):
        of = language(s)
        if of and of != own and not (of in ASKED_LANGUAGE and ASKED_LANGUAGE[of].search(q)):
            return True
    return False


def breaks_off(answer: str) -> bool:
    """By delimiters and by words that must go on."""
    text = clean(answer)
    stack = []
    for i, ch in enumerate(text):
        if ch in OPEN:
            stack.append(CLOSE[OPEN.index(ch)])
        elif ch in CLOSE and stack and stack[-1] == ch:
            stack.pop()
    if stack or text.count('"') % 2 or (text and text[-1] in GO_ON_MARKS):
        return True
    word = re.search(r"([A-Za-z]+)$", text)
    return bool(word and " " in text and word[1].lower() in GO_ON_WORDS) or bool(GO_ON_JA.search(text))


def masked(question: str | None, answer: str) -> str:
    """The answer without the question it may repeat first, and with each number as one digit."""
    q, a = classes(clean(question)).lower(), classes(clean(answer)).lower()
    same = next((i for i, (x, y) in enumerate(zip(q, a, strict=False)) if x != y), min(len(q), len(a)))
    if same >= 10 and same < len(a):
        a = re.sub(r"^[はか、,:：\s]+", "", a[same:]) or a
    return re.sub(r"\d+(?:[.,]\d+)*", "0", a)


def places(t: str) -> tuple[list[str], list[str]]:
    """The characters before every place of a text, at all lengths of CONTEXTS; and those before places where a sentence or the text ends."""
    comma = "、" if LIST_JA.fullmatch(t) else "," if "," in t and "." not in t else None  # in a list, an item may be the last
    t = "^" + t
    every, ends = [], []
    for i in range(2, len(t) + 1):
        if t[i - 1] in STOPS:
            continue
        before = [t[max(0, i - n) : i] for n in CONTEXTS if i >= n or n == CONTEXTS[-1]]
        every += before
        if i == len(t) or t[i] == comma or (t[i] in STOPS and (i + 1 == len(t) or t[i] in "。！？" or t[i + 1] == " ")):
            ends += before
    return every, ends


def counted_places(texts: DataFrame) -> DataFrame:
    """(context, n, e): how often each context occurs and how often it ends, counted in each batch first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every, ends = Counter(), Counter()
            for t in batch["masked"]:
                a, b = places(t)
                every.update(a)
                ends.update(b)
            if every:
                yield pd.DataFrame({"context": list(every), "n": list(every.values()), "e": [ends[c] for c in every]})

    return texts.select("masked").mapInPandas(count, "context string, n long, e long")


@F.pandas_udf(T.ArrayType(T.StringType()))
def last_contexts(texts: pd.Series) -> pd.Series:
    """The contexts of the place where a text ends, the longest first; none after a full stop."""

    def of(t: str) -> list[str]:
        t = "^" + t
        if t[-1] in STOPS or len(t) < 3:
            return []
        return [t[max(0, len(t) - n) :] for n in CONTEXTS if len(t) >= n or n == CONTEXTS[-1]]

    return texts.map(of)


def endings(answers: DataFrame) -> DataFrame:
    """(masked, goes_on): for each distinct masked answer, whether the corpus goes on where it ends.

    An answer counts once for each different question, and is left out of its own count once.
    """
    texts = answers.select("masked").distinct()
    wanted = texts.select("masked", F.posexplode(last_contexts("masked")).alias("level", "context"))
    counts = counted_places(answers.select("asked", "masked").distinct())
    counts = counts.join(wanted.select("context").distinct(), "context", "left_semi").groupBy("context").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    known = wanted.join(counts, "context").filter(F.col("n") - 1 >= SEEN).withColumn("share", (F.col("e") - 1) / (F.col("n") - 1))
    return known.groupBy("masked").agg(F.min_by("share", "level").alias("share")).select("masked", (F.col("share") < ENDS).alias("goes_on"))


def defects(df: DataFrame, key: str, question: str, answers: list[str]) -> DataFrame:
    """(key, answer_field, defect): one row per defective answer of the named columns.

    A null answer is empty. A null question can neither be copied nor set a language other than
    English. Repeated rows are each judged; other columns are ignored; an empty table gives no rows.
    """
    pairs = df.select(key, F.col(question).alias("question"), F.explode(F.array(*[F.struct(F.lit(a).alias("answer_field"), F.col(a).alias("answer")) for a in answers])).alias("x")).select(key, "question", "x.*")

    @F.pandas_udf("struct<defect:string,masked:string,asked:string>")
    def judge(questions: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for q, a in zip(questions, texts, strict=True):
            if is_empty(a):
                out.append(("empty", None, None))
            elif is_copy(q, a):
                out.append(("copy", None, None))
            elif is_refusal(a):
                out.append(("refusal", None, None))
            elif is_other_language(q, a):
                out.append(("other_language", None, None))
            else:
                out.append(("truncated" if breaks_off(a) else None, masked(q, a), letters_of_question(q or "")))
        return pd.DataFrame(out, columns=["defect", "masked", "asked"])

    judged = cut(pairs.withColumn("j", judge("question", "answer")).select(key, "answer_field", "j.*"))
    sound = judged.filter("defect IS NULL")
    cut_off = endings(judged.filter("masked IS NOT NULL")).filter("goes_on").select("masked")
    late = sound.join(cut_off, "masked").select(key, "answer_field", F.lit("truncated").alias("defect"))
    return judged.filter("defect IS NOT NULL").select(key, "answer_field", "defect").unionByName(late)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return defects(spread(table(spark, folder, "gold_100_review")), "review_id", "question", ["system_answer", "gold_v3"])
