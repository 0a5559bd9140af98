"""Problem 4: bring text that looks the same to one consistent form.

1. A text is cut into tokens: runs of letters of one kind (kanji, kana, Latin and so on), or single
   other characters. Ignorable characters never cut a token, and the kind of a letter is the kind of
   its look-alike class, so that texts which look the same are cut at the same places.
2. `spellings` counts the distinct spellings in the corpus. They are spread over shards by their class
   string, which spellings at cost zero from each other share; nothing else can reach a word for free.
3. In each shard a trie holds the vocabulary, the plain spellings, letter by letter with marks set
   apart. A weighted edit automaton reads each other spelling as it stands and keeps the nodes it may
   be in, with their costs: dropping an ignorable character is free, and so is reading a letter, or the
   letters a compatibility character stands for, as a look-alike; every other replacement, deletion or
   insertion costs `EDIT`. States over `BOUND` are dropped. Of the words reached at the least cost, the
   most frequent one is the canonical spelling.
4. A spelling that reaches no word is normalised by table.
5. `unify` puts the canonical spellings back into the texts; texts that look the same are then equal.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftdocs.session import cut, spread, table

# Letters of another script with the shape of a Latin letter (Cyrillic, Greek, Armenian).
SHAPES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ӏ": "I", "Ү": "Y", "Ԍ": "G", "Ԝ": "W",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "օ": "o", "ս": "u", "ց": "g", "հ": "h", "ո": "n",
}
# Kanji and hiragana with the shape of a katakana letter. Both are ordinary letters, so
# the corpus decides which spelling of a word is canonical.
TWINS = {"力": "カ", "口": "ロ", "夕": "タ", "卜": "ト", "二": "ニ", "八": "ハ", "工": "エ", "へ": "ヘ", "べ": "ベ", "ぺ": "ペ"}
# Compatibility forms that a reader tells apart keep their own form.
TOLD_APART = ("<super>", "<sub>", "<circle>", "<fraction>")
SHARD_WORDS = 50_000  # spellings for each trie, on average


@lru_cache(1 << 16)
def ignorable(ch: str) -> bool:
    c = ord(ch)
    return unicodedata.category(ch) == "Cf" or 0xFE00 <= c < 0xFE10 or 0xE0100 <= c < 0xE01F0 or c in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0)


@lru_cache(1 << 16)
def form(ch: str) -> str:
    """One character in its plain form: compatibility forms, dashes, tildes and blanks by table."""
    if unicodedata.decomposition(ch).startswith(TOLD_APART):
        return ch
    if ch in "〜～∼˜∿":
        return "~"
    if unicodedata.category(ch) == "Pd" or ch in "−⁃‐‑":
        return "-"
    if unicodedata.category(ch) == "Zs":
        return " "
    return "".join(SHAPES.get(x, x) for x in unicodedata.normalize("NFKC", ch))


class Table(dict):
    """For str.translate: a character's value is worked out when it is first met."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, c: int) -> str | None:
        out = self[c] = self.of(chr(c))
        return out


FORMS = Table(lambda ch: None if ignorable(ch) else form(ch))
LOOKS = Table(lambda ch: TWINS.get(ch, ch))


def plain(token: str) -> str:
    """Normalised by table."""
    kept = token.translate(FORMS)
    return kept if kept.isascii() else unicodedata.normalize("NFC", kept.replace("゛", "゙").replace("゜", "゚") if re.search("[゛゜]", kept) else kept)


def classes(token: str) -> str:
    """The class string: look-alikes have the same one."""
    return plain(token).translate(LOOKS)


@lru_cache(1 << 16)
def kind(ch: str) -> str:
    """The kind of a character's class; '+' goes on with any token, '' stands alone."""
    if ignorable(ch) or unicodedata.combining(ch) or ch in "ﾞﾟ":
        return "+"
    c = TWINS.get(form(ch)[:1], form(ch)[:1])
    if "ァ" <= c <= "ヺ" or c == "ー":
        return "k"
    if "ぁ" <= c <= "ゖ":
        return "h"
    if unicodedata.category(c)[0] == "L":
        return "c" if ord(c) >= 0x2E80 else "l"
    return "d" if c.isdigit() else ""


@lru_cache(1)
def token_pattern() -> re.Pattern:
    """The tokens of a text of the Basic Multilingual Plane, from the kinds of its characters."""
    of: dict[str, list[str]] = {}
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000:
            of.setdefault(kind(chr(c)), []).append(chr(c))
    chars = {k: "".join(re.escape(ch) for ch in members) for k, members in of.items()}
    goes_on = chars["+"]
    runs = [f"[{chars[k]}][{chars[k]}{goes_on}]*" for k in sorted(of) if k not in ("", "+")]
    return re.compile("|".join([f"[{goes_on}]+", *runs, f".[{goes_on}]*"]), re.S)


def tokens(text: str) -> list[str]:
    if not text or max(text) <= "\uffff":
        return token_pattern().findall(text)
    out: list[str] = []
    last = None  # kind of the open token; None after the marks a text may begin with
    for ch in text:
        k = kind(ch)
        if out and (k == "+" or (k and k == last)):
            out[-1] += ch
        else:
            out.append(ch)
            last = None if k == "+" else k
    return out


# Tokens cannot hide in texts without any of these: characters that are not in their plain form, or twins.
TOUCHY = re.compile("[^\\x09\\x0a\\x0d\\x20-\\x7eぁ-ふほぼぽま-ゖァ-イウオキ-コシ-チツ-テナヌネノヒ-フホ-ロワ-ヺー一-鿿、。・「」々ä-üÄ-Üßéèêàâûôîçëï]|[" + "".join({*TWINS, *TWINS.values()}) + "]")


def is_plain(token: str) -> bool:
    return plain(token) == token


def spellings(df: DataFrame, text: str) -> DataFrame:
    """(spelling, class, plain, n): distinct spellings, with n texts each."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def rows() -> pd.DataFrame:
            keys = list(seen)
            out = pd.DataFrame({"spelling": keys, "class": [classes(k) for k in keys], "plain": [is_plain(k) for k in keys], "n": list(seen.values())})
            seen.clear()
            return out

        for batch in batches:
            for t in batch["_text"]:
                seen.update({k for k in tokens(t) if len(k) > 1 or TOUCHY.match(k)})
            if len(seen) > 200_000:  # memory bound of a task; the sums are the same at any value
                yield rows()
        if seen:
            yield rows()

    found = df.select(F.col(text).alias("_text")).filter(F.length("_text") > 0).mapInPandas(count, "spelling string, class string, plain boolean, n long")
    return found.groupBy("spelling", "class", "plain").agg(F.sum("n").alias("n"))


EDIT, BOUND = 1.0, 0.0  # cost of an edit a reader would see; the dearest word that may be chosen


@lru_cache(1 << 16)
def letters(ch: str) -> str:
    """The letters one character stands for, marks set apart."""
    return unicodedata.normalize("NFD", {"゛": "゙", "゜": "゚"}.get(ch, form(ch)))


def look(letter: str) -> str:
    """What letters of the same look share."""
    return TWINS.get(letter, letter)


class Trie:
    """Vocabulary by letter. A node maps the look of a letter to the letters that go on, and each to its node."""

    def __init__(self):
        self.root: dict = {}

    def add(self, word: str, n: int) -> None:
        node = self.root
        for x in unicodedata.normalize("NFD", word):
            node = node.setdefault(look(x), {}).setdefault(x, {})
        node["word"] = (n, word)

    @staticmethod
    def after(node: dict) -> Iterator[tuple[str, dict]]:
        return ((x, child) for c, same in node.items() if c != "word" for x, child in same.items())

    def walk(self, token: str, bound: float = BOUND) -> str | None:
        """The most frequent of the words at least cost, up to `bound`; of equals, the first in code point order."""
        states: dict[int, tuple[float, dict]] = {id(self.root): (0.0, self.root)}  # node -> cost

        def reach(into: dict, node: dict, cost: float) -> None:
            if cost <= bound and cost < into.get(id(node), (bound + 1, None))[0]:
                into[id(node)] = (cost, node)
                if cost + EDIT <= bound:
                    for _, child in self.after(node):  # a letter of the word left out of the token
                        reach(into, child, cost + EDIT)

        if bound >= EDIT:
            start: dict = {}
            reach(start, self.root, 0.0)
            states = start
        for ch in token:
            if ignorable(ch):
                continue  # dropped at no cost
            for x in letters(ch):
                held: dict[int, tuple[float, dict]] = {}
                for cost, node in states.values():
                    for child in node.get(look(x), {}).values():
                        reach(held, child, cost)  # the same letter or a look-alike
                    if cost + EDIT <= bound:
                        reach(held, node, cost + EDIT)  # a letter of the token left out
                        for _, child in self.after(node):
                            reach(held, child, cost + EDIT)  # another letter
                states = held
                if not states:
                    return None
        ends = [(cost, -node["word"][0], node["word"][1]) for cost, node in states.values() if "word" in node]
        return min(ends)[2] if ends else None


def canonical(vocab: DataFrame, shards: int) -> DataFrame:
    """(spelling, canonical) of the spellings that are not canonical."""

    def match(part: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        for w, n in zip(part["spelling"][part["plain"]], part["n"][part["plain"]], strict=True):
            trie.add(w, n)
        best = [trie.walk(w) or plain(w) for w in part["spelling"]]
        out = pd.DataFrame({"spelling": part["spelling"], "canonical": best})
        return out[out["spelling"] != out["canonical"]]

    # only classes with several spellings, or with one that is not plain, need a walk
    several = vocab.groupBy("class").agg(F.count("*").alias("k"), F.bool_and("plain").alias("all_plain")).filter("k > 1 OR NOT all_plain").select("class")
    placed = vocab.join(several, "class", "left_semi").withColumn("shard", F.pmod(F.xxhash64("class"), F.lit(shards)))
    return placed.groupBy("shard").applyInPandas(match, "spelling string, canonical string")


def unify(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, canonical): each text with its consistent form.

    Null texts stay null, empty ones empty. Keys must be unique; repeated keys give repeated rows.
    Other columns are ignored.
    """
    base = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    vocab = cut(spellings(base, "_text"))
    changed = canonical(vocab, max(1, vocab.count() // SHARD_WORDS))

    @F.pandas_udf("array<string>")
    def touchy(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list({k for k in tokens(t) if TOUCHY.search(k)}) if t and TOUCHY.search(t) else [])

    @F.pandas_udf("string")
    def put(texts: pd.Series, maps: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(texts, maps, strict=True):
            if t is None or m is None:
                out.append(t)
                continue
            by = {r["spelling"]: r["canonical"] for r in m}
            out.append("".join(by.get(k, k) for k in tokens(t)))
        return pd.Series(out)

    held = base.select("_key", F.explode(touchy("_text")).alias("spelling"))
    maps = held.join(changed, "spelling").groupBy("_key").agg(F.collect_set(F.struct("spelling", "canonical")).alias("_map"))
    return base.join(maps, "_key", "left").select(F.col("_key").alias(key), F.col("_text").alias(text), put("_text", "_map").alias("canonical"))


def hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, form, variant): each row with the hashes of its consistent form and of its text; rows without text are left out."""
    return unify(df, key, text).filter(F.length("canonical") > 0).select(F.col(key).alias("k"), F.md5("canonical").alias("form"), F.md5(text).alias("variant"))


def classes_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, variants, links): one row per row whose text has look-alikes, at any size of a class.

    class_id is the least key of the class, variants the number of different texts in it, links the number
    of rows whose text looks the same but is a different string. No pairs are made.
    """
    rows = cut(hashed(df, key, text))
    variants = rows.groupBy("form", "variant").agg(F.count("*").alias("copies"), F.min("k").alias("first"))
    several = variants.groupBy("form").agg(F.count("*").alias("variants"), F.sum("copies").alias("rows"), F.min("first").alias("class_id")).filter("variants > 1")
    sizes = variants.join(several, "form").select("variant", "form", "class_id", "variants", (F.col("rows") - F.col("copies")).alias("links"))
    return rows.join(sizes, ["form", "variant"]).select(F.col("k").alias(key), "class_id", "variants", "links")


def look_alikes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b): rows with different texts of the same consistent form, key_a < key_b.

    Exact copies are no pairs. Variants are paired first, once per pair of different texts, and then
    widened to their rows, so that a much repeated text is never compared with its own copies.
    """
    rows = cut(hashed(df, key, text))
    variants = rows.select("form", "variant").distinct()
    several = variants.groupBy("form").agg(F.count("*").alias("n")).filter("n > 1").select("form")
    some = variants.join(several, "form")
    a, b = some.select("form", F.col("variant").alias("va")), some.select("form", F.col("variant").alias("vb"))
    pairs = a.join(b, "form").filter("va < vb").select("va", "vb")
    left = rows.select(F.col("variant").alias("va"), F.col("k").alias("ka"))
    right = rows.select(F.col("variant").alias("vb"), F.col("k").alias("kb"))
    return pairs.join(left, "va").join(right, "vb").filter("ka <> kb").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = look_alikes(spread(table(spark, folder, "extracted_docs")), "ext_id", "text").select(F.lit("extracted_docs").alias("src"), "key_a", "key_b")
    asked = look_alikes(spread(table(spark, folder, "gold_100_review")), "review_id", "question").select(F.lit("gold_100_review").alias("src"), "key_a", "key_b")
    return docs.unionByName(asked)


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with look-alikes: class, different texts in it, and links; the scalable form of p4_found."""
    docs = classes_of(spread(table(spark, folder, "extracted_docs")), "ext_id", "text").withColumnRenamed("ext_id", "key")
    asked = classes_of(spread(table(spark, folder, "gold_100_review")), "review_id", "question").withColumnRenamed("review_id", "key")
    return docs.withColumn("src", F.lit("extracted_docs")).unionByName(asked.withColumn("src", F.lit("gold_100_review")))


def p4_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose text changes, with their consistent form."""
    docs = unify(spread(table(spark, folder, "extracted_docs")), "ext_id", "text").select(F.lit("extracted_docs").alias("src"), F.col("ext_id").alias("key"), "canonical", F.col("text").alias("was"))
    asked = unify(spread(table(spark, folder, "gold_100_review")), "review_id", "question").select(F.lit("gold_100_review").alias("src"), F.col("review_id").alias("key"), "canonical", F.col("question").alias("was"))
    return docs.unionByName(asked).filter("canonical <> was").drop("was")
