"""Problem 8: find text that was decoded with a wrong character encoding, and give back the original.

A text is seen as units, runs of letters and non-ASCII characters between other ASCII characters.

1. `vocabulary`: document frequencies of all units that hold a non-ASCII character, and of all
   non-ASCII characters, over the whole corpus.
2. `twins`: garbled units are joined with all clean near-twins: units of the same ASCII characters whose
   bytes, in some encoding, are those that the garbled unit was read from. Units that merely share the text
   stripped of its non-ASCII characters never meet, however many they are.
3. `alignment` infers the transformation of a pair: the character encoding of the clean unit whose bytes,
   aligned with those that the garbled characters were read from, are the same ones throughout.
4. `learn`: a transformation is learned when enough different pairs, or enough aligned characters, support it.
5. `verdicts`: learned transformations are applied to all remaining units. A restored unit that the corpus
   holds is taken as it is. Else a restored run counts when its characters are known to the corpus and more
   frequent than the unit itself, or stand in more different units than the garbled run does, which no number
   of copies changes; so a sound unit that could be read as garbled, by chance, stays as it is. Of
   single-byte encodings, the restored unit must also be formed like a word and the garbled one must not.
6. `find`: documents holding a garbled unit. Characters lost for good (the replacement character, or
   runs of question marks inside words) can be found, but not restored.
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
from pyspark.sql import types as T

from weftdocs.session import cut, spread, table

# Encodings of stored bytes and encodings they are commonly misread as.
STORED_AS = ["utf-8", "cp932", "euc_jp", "cp1252", "mac_roman", "cp437", "cp850"]
READ_AS = ["cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "cp932", "koi8_r", "cp1250", "iso8859_15"]
MULTI = {"utf-8", "cp932", "euc_jp"}  # several bytes make a character
TRANSFORMS = [(e, d) for e in STORED_AS for d in READ_AS if e != d and (e in MULTI or d != "cp932") and {e, d} != {"cp1252", "latin-1"} and {e, d} != {"cp1252", "iso8859_15"}]
POSSIBLE = frozenset(TRANSFORMS)

MIN_PAIRS = 3  # distinct pairs that must support a transformation,
MIN_CHARS = 4  # or, where several bytes make a character, aligned characters in all
MIN_LETTERS = 3  # ASCII letters that are left of a unit with a twin
KNOWN_SHARE = 0.8  # share of a run's restored characters that the corpus must know
CLEAR = 3  # times as many units that decide between two characters
QUOTES = dict.fromkeys(map(ord, "‘’“”„«»"))
LOST = "�"
# A unit: ASCII letters are kept, every other ASCII character separates.
UNIT = re.compile(r"[A-Za-z]*[\u0080-\U0010ffff][A-Za-z\u0080-\U0010ffff]*")
# Question marks in the place of lost characters: inside a word, or alone between blanks or before a digit.
ASKED = re.compile(r"(?<=[^\W\d_])\?{2,}(?=[^\W\d_])|(?<![^\s])\?{2,}(?=\s\w|\d)")
# Characters that wrong decoding brings about. A text without any of them needs no closer look.
SUSPECT = r"[\u0080-ɏˆ-˝Ͱ-ԯ֐-߿‐-›₧€™←-⋿⌐-◿-ﬁﬂ｡-ﾟ�縺繧繝縲]|\?\?"
PATTERN = {
    "utf-8": re.compile("(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3})+"),
    "cp932": re.compile("(?:[\x81-\x9f\xe0-\xea][\x40-\x7e\x80-\xfc])+"),
    "euc_jp": re.compile("(?:[\xa1-\xa8\xb0-\xf4][\xa1-\xfe])+"),
}


@lru_cache(None)
def to_bytes(read_as: str) -> dict[str, str]:
    """Non-ASCII character -> the bytes it was read from, as Latin-1 characters."""
    out: dict[str, str] = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(read_as)] = chr(b)
        except UnicodeDecodeError:
            if read_as != "cp932" or b == 0x80:
                out[chr(b)] = chr(b)  # undefined bytes come out as control characters
    if read_as == "cp932":
        for lead in [*range(0x81, 0xA0), *range(0xE0, 0xFD)]:
            for trail in [*range(0x40, 0x7F), *range(0x80, 0xFD)]:
                try:
                    out.setdefault(bytes([lead, trail]).decode("cp932"), chr(lead) + chr(trail))
                except UnicodeDecodeError:
                    pass
        for k in range(1880):  # user-defined area
            lead, trail = divmod(k, 188)
            out[chr(0xE000 + k)] = chr(0xF0 + lead) + chr(0x40 + trail + (trail >= 63))
        for k, b in enumerate((0xA0, 0xFD, 0xFE, 0xFF)):
            out[chr(0xF8F0 + k)] = chr(b)
    return out


class Inverse:
    """Undoes one transformation, place by place."""

    def __init__(self, stored: str, read: str):
        self.stored, self.read, self.wide = stored, read, read == "cp932"
        self.bytes_of = to_bytes(read)
        self.pattern = PATTERN.get(stored)
        self.known = frozenset(self.bytes_of)
        self.single: dict[int, str] = {}
        if stored not in MULTI:
            for ch, b in self.bytes_of.items():
                try:
                    self.single[ord(ch)] = b.encode("latin-1").decode(stored)
                except UnicodeDecodeError:
                    pass
        # one character per byte; what cannot come from a byte of this encoding breaks a run
        self.table = {ord(ch): b for ch, b in self.bytes_of.items() if len(b) == 1}

    def runs(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, restored) of the places where whole characters can be restored."""
        if self.wide:
            parts, at, starts = [], 0, {}
            for i, ch in enumerate(text):
                b = ch if ch < "\x80" else self.bytes_of.get(ch, "￿")
                if self.stored == "euc_jp" and len(b) == 2 and b[0] < "\xa1":
                    b = "￿"
                starts[at] = i
                parts.append(b)
                at += len(b)
            starts[at] = len(text)
            raw = "".join(parts)
        else:
            raw, starts = "".join(self.table.get(ord(ch), "￿") if ch >= "\x80" else ch for ch in text), None
        out = []
        for m in self.pattern.finditer(raw):
            s, e = m.span()
            if starts is not None:
                if s not in starts:
                    continue
                lost_next = e in starts and starts[e] < len(text)
                if e not in starts and not lost_next:
                    continue
                s, e = starts[s], starts[e]
            try:
                back = m[0].encode("latin-1").decode(self.stored)
            except UnicodeDecodeError:
                back = m[0].encode("latin-1").decode(self.stored, "replace").replace(LOST, "")
            if back:
                out.append((s, e, back))
        return out

    def whole(self, text: str) -> str | None:
        """The text with every non-ASCII place restored, or None."""
        if self.pattern is None:
            return text.translate(self.single) if any(ord(c) in self.single for c in text) else None
        runs = self.runs(text)
        covered = sum(1 for s, e, _ in runs for ch in text[s:e] if ch >= "\x80")
        if not runs or covered < sum(ch >= "\x80" for ch in text):
            return None
        return replaced(text, runs)


@lru_cache(None)
def inverse(stored: str, read: str) -> Inverse:
    return Inverse(stored, read)


def replaced(text: str, runs: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, back in runs:
        out += [text[at:s], back]
        at = e
    return "".join([*out, text[at:]])


def scanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(kind, key, df, doc): one pass over all texts.

    Kinds 'u' and 'c' are counts of units and of single non-ASCII characters in the documents of a batch;
    kind 'h' says which document holds which suspect unit ('??' for question marks in the place of lost characters).
    """
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odd = re.compile(SUSPECT)
        units, chars = Counter(), Counter()

        def rows() -> pd.DataFrame:
            keys = [*units, *chars]
            out = pd.DataFrame({"kind": ["u"] * len(units) + ["c"] * len(chars), "key": keys, "df": [*units.values(), *chars.values()], "doc": [None] * len(keys)})
            units.clear(), chars.clear()
            return out

        suspects: dict[str, bool] = {}
        for batch in batches:
            names, held = [], []
            for k, t in zip(batch["_key"], batch["_text"], strict=True):
                found = set(UNIT.findall(t))
                units.update(found)
                chars.update(ch for ch in set().union(*found) if ch >= "\x80")
                for u in found:
                    if u not in suspects:
                        suspects[u] = bool(odd.search(u))
                mine = [u for u in found if suspects[u]] + (["??"] if "??" in t and ASKED.search(t) else [])
                names += [k] * len(mine)
                held += mine
            if held:
                yield pd.DataFrame({"kind": "h", "key": held, "df": 1, "doc": names})
            if len(units) > 200_000:  # memory bounds of a task; the sums are the same at any value
                yield rows()
            if len(suspects) > 500_000:
                suspects.clear()
        if units:
            yield rows()

    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    return source.mapInPandas(count, f"kind string, key string, df long, doc {kind}")


def vocabulary(seen: DataFrame) -> DataFrame:
    """(kind, key, df): document frequencies of units ('u') and of single non-ASCII characters ('c')."""
    return seen.filter("kind <> 'h'").groupBy("kind", "key").agg(F.sum("df").alias("df"))


def contexts(vocab: DataFrame) -> dict[str, int]:
    """In how many different units each non-ASCII character stands. Bounded by the characters of Unicode."""
    chars = vocab.filter("kind = 'u'").select(F.explode(F.array_distinct(F.split("key", ""))).alias("ch")).filter(F.col("ch") >= "\x80")
    return {r["ch"]: r["count"] for r in chars.groupBy("ch").count().collect()}


def least(text: str, units_with: dict[str, int]) -> int:
    """At most so many different units hold the text: as many as hold its rarest character."""
    return min((units_with.get(ch, 0) for ch in text if ch >= "\x80"), default=0)


def like_a_word(text: str) -> bool:
    """Latin letters, ASCII ones among them, in small letters, capitals, or with a first capital; quotation marks do not count."""
    text = text.translate(QUOTES)
    return text.isalpha() and (text.islower() or text.isupper() or text.istitle()) and any(ch < "\x80" for ch in text) and all(unicodedata.name(ch, "").startswith("LATIN") for ch in text if ch >= "\x80")


def one_way(garbled: str, clean: str, units_with: dict[str, int]) -> bool | None:
    """Whether the second of two units is the clean one: by its form, then by the units its characters stand in."""
    a, b = like_a_word(garbled), like_a_word(clean)
    if a != b:
        return b
    a, b = least(garbled, units_with), least(clean, units_with)
    return b > a if max(a, b) >= CLEAR * min(a, b) else None


def lettered(raw: bytes) -> bool:
    """Whether enough text is left of a unit without its non-ASCII characters."""
    return sum(65 <= b <= 90 or 97 <= b <= 122 for b in raw) >= MIN_LETTERS


def encoded(text: str, stored: str) -> bytes | None:
    try:
        return text.encode(stored)
    except UnicodeEncodeError:
        return None


def read_from(text: str, read_as: str) -> bytes | None:
    """The bytes a text was read from, or None where this encoding cannot have brought it about."""
    table_ = to_bytes(read_as)
    parts = [ch if ch < "\x80" else table_.get(ch) for ch in text]
    return None if None in parts else "".join(parts).encode("latin-1")


def alignment(garbled: str, clean: str) -> list[tuple[str, str, int]]:
    """(stored, read, characters) of the transformations under which the bytes of both units are the same."""
    out = []
    characters = sum(ch >= "\x80" for ch in clean)
    bytes_of = {e: encoded(clean, e) for e in STORED_AS}
    for d in READ_AS:
        raw = read_from(garbled, d)
        if raw is not None:
            out += [(e, d, characters) for e in STORED_AS if bytes_of[e] == raw and (e, d) in POSSIBLE]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def clean_keys(units: pd.Series) -> pd.Series:
    """What a unit's bytes are decoded to: the unit, and another one where an encoding gives two characters the same bytes."""
    return units.map(lambda u: sorted({raw.decode(e) for e, raw in ((e, encoded(u, e)) for e in STORED_AS) if raw is not None and lettered(raw)}))


@F.pandas_udf(T.ArrayType(T.StringType()))
def garbled_keys(units: pd.Series) -> pd.Series:
    """What the bytes that a unit may have been read from are decoded to in other encodings."""

    def of(u: str) -> list[str]:
        out = set()
        for d in READ_AS:
            raw = read_from(u, d)
            if raw is not None and lettered(raw):
                for e in STORED_AS:
                    if (e, d) in POSSIBLE:
                        try:
                            out.add(raw.decode(e))
                        except UnicodeDecodeError:
                            pass  # bytes of no text
        return sorted(out - {u})

    return units.map(of)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("stored", T.StringType()), T.StructField("read", T.StringType()), T.StructField("characters", T.IntegerType())])))
def alignments(garbled: pd.Series, clean: pd.Series) -> pd.Series:
    return pd.Series([alignment(g, c) for g, c in zip(garbled, clean, strict=True)], dtype=object)


def surely(units_with: dict[str, int], vocab: DataFrame):
    """Column function (stored, garbled, clean, df_garbled, df_clean): whether the pair goes this way.

    Bytes of several to a character go one way only, so how often each of the two stands does not matter.
    Single-byte encodings can be undone both ways: `one_way` decides, and frequency only where it cannot.
    """
    shared = vocab.sparkSession.sparkContext.broadcast(units_with)

    @F.pandas_udf("boolean")
    def sure(stored: pd.Series, garbled: pd.Series, clean: pd.Series) -> pd.Series:
        return pd.Series([e in MULTI or one_way(g, c, shared.value) for e, g, c in zip(stored, garbled, clean, strict=True)], dtype=object)

    return F.coalesce(sure("stored", "garbled", "clean"), F.col("df_clean") > F.col("df_garbled"))


def twins(vocab: DataFrame, units_with: dict[str, int]) -> DataFrame:
    """(stored, read, garbled, clean, characters): garbled units with clean near-twins and the transformation between them."""
    units = vocab.filter("kind = 'u'").select(F.col("key").alias("unit"), "df")
    clean = units.select(F.col("unit").alias("clean"), F.col("df").alias("df_clean"), F.explode(clean_keys("unit")).alias("key"))
    suspects = units.filter(F.col("unit").rlike(SUSPECT)).select(F.col("unit").alias("garbled"), F.col("df").alias("df_garbled"), F.explode(garbled_keys("unit")).alias("key"))
    pairs = suspects.join(clean, "key").filter("garbled <> clean").select("garbled", "clean", "df_garbled", "df_clean").distinct()
    found = pairs.withColumn("a", F.explode(alignments("garbled", "clean"))).select("garbled", "clean", "df_garbled", "df_clean", "a.*")
    return found.filter(surely(units_with, vocab)).select("stored", "read", "garbled", "clean", "characters")


def learn(pairs: DataFrame, min_pairs: int = MIN_PAIRS, min_chars: int = MIN_CHARS) -> list[tuple[str, str]]:
    """Transformations with enough twins. Their number is bounded by the table of encodings."""
    enough = (F.col("pairs") >= min_pairs) | ((F.col("characters") >= min_chars) & F.col("stored").isin(*MULTI))
    rows = pairs.groupBy("stored", "read").agg(F.count("*").alias("pairs"), F.sum("characters").alias("characters")).filter(enough).collect()
    return sorted((r["stored"], r["read"]) for r in rows)


def held_by_corpus(vocab: DataFrame, learned: list[tuple[str, str]], units_with: dict[str, int]) -> DataFrame:
    """(unit, clean): units that a learned transformation turns, as a whole, into another unit of the corpus."""

    @F.pandas_udf("array<struct<stored:string,clean:string>>")
    def restored(units: pd.Series) -> pd.Series:
        inverses = [inverse(e, d) for e, d in learned]

        def of(u: str) -> list[tuple]:
            out = {}
            chars = {ch for ch in u if ch >= "\x80"}
            for inv in inverses:
                if not chars <= inv.known if inv.pattern else chars.isdisjoint(inv.known):
                    continue  # a character that this encoding cannot have brought about
                clean = inv.whole(u)
                if clean is not None and clean != u and len(clean) > 1 and any(ch >= "\x80" for ch in clean):
                    out[clean, inv.stored] = None
            return [(e, c) for c, e in out]

        return units.map(of)

    units = vocab.filter("kind = 'u'").select(F.col("key").alias("unit"), "df")
    # a restored unit has at least two letters and is long enough not to arise by chance
    suspects = units.filter(F.col("unit").rlike(SUSPECT) & (F.length("unit") >= 3)).select(F.col("unit").alias("garbled"), F.col("df").alias("df_garbled"), F.explode(restored("unit")).alias("g")).select("garbled", "df_garbled", "g.*")
    joined = suspects.join(units.select(F.col("unit").alias("clean"), F.col("df").alias("df_clean")), "clean").filter(surely(units_with, vocab))
    return joined.groupBy(F.col("garbled").alias("unit")).agg(F.max_by("clean", F.struct("df_clean", "clean")).alias("clean"))


def verdicts(vocab: DataFrame, learned: list[tuple[str, str]], units_with: dict[str, int]) -> DataFrame:
    """(unit, verdict, restored) of the garbled units; verdict is restored or lost."""
    chars = vocab.filter("kind = 'c'").select(F.col("key").alias("ch"), "df").filter("df > 1")
    known = {r["ch"]: r["df"] for r in chars.collect()}  # bounded by the characters of Unicode
    shared = vocab.sparkSession.sparkContext.broadcast((known, units_with))

    @F.pandas_udf("struct<verdict:string,restored:string>")
    def judge(units: pd.Series, dfs: pd.Series) -> pd.DataFrame:
        inverses, (df_of, held) = [inverse(e, d) for e, d in learned], shared.value
        out = [judged(u, n, inverses, df_of, held) for u, n in zip(units, dfs, strict=True)]
        return pd.DataFrame(out, columns=["verdict", "restored"])

    suspects = vocab.filter((F.col("kind") == "u") & F.col("key").rlike(SUSPECT)).select(F.col("key").alias("unit"), "df")
    judged_ = suspects.join(held_by_corpus(vocab, learned, units_with), "unit", "left").withColumn("j", judge("unit", "df"))
    return judged_.select(
        "unit",
        F.when(F.col("clean").isNotNull(), "restored").otherwise(F.col("j.verdict")).alias("verdict"),
        F.coalesce("clean", "j.restored").alias("restored"),
    ).filter("verdict IS NOT NULL")


def accepted(text: str, df: int, inv: Inverse, known: dict[str, int], units_with: dict[str, int]) -> list[tuple[int, int, str]]:
    """Runs whose restored characters the corpus knows better than it knows the unit, or the run."""
    out = []
    for s, e, back in inv.runs(text):
        total = sum(ch >= "\x80" for ch in back)
        good = sum(known.get(ch, 0) > df for ch in back if ch >= "\x80")
        if total and good < KNOWN_SHARE * total:
            seldom = least(text[s:e], units_with)
            good = sum(known.get(ch, 0) > df or units_with.get(ch, 0) > seldom for ch in back if ch >= "\x80")
        if not total or good < KNOWN_SHARE * total:
            continue
        if inv.stored != "utf-8" and (total < 2 or e - s < 3):  # two-byte codes need more evidence
            continue
        out.append((s, e, back))
    if inv.stored != "utf-8" and out:
        seen = sum(1 for s, e, _ in out for ch in text[s:e] if ch >= "\x80")
        odd = sum(1 for ch in text if ch in inv.bytes_of and not "぀" <= ch <= "鿿")
        if seen < 0.5 * odd:
            return []
    return out


def exchanged(text: str, inv: Inverse, units_with: dict[str, int]) -> list[tuple[int, int, str]]:
    """Runs of a single-byte encoding: the unit becomes a word, by characters that the corpus knows better."""
    back = inv.whole(text)
    if back is None or back == text or not like_a_word(back):
        return []
    changed = [i for i, (a, b) in enumerate(zip(text, back, strict=True)) if a != b]
    inside = any(0 < i < len(text) - 1 and text[i - 1] < "\x80" and text[i + 1] < "\x80" for i in changed)
    if not inside or any(units_with.get(back[i], 0) <= units_with.get(text[i], 0) for i in changed):
        return []
    return [(i, i + 1, back[i]) for i in changed]


def judged(unit: str, df: int, inverses: list[Inverse], known: dict[str, int], units_with: dict[str, int]) -> tuple[str | None, str | None]:
    best, gain = None, 0
    chars = {ch for ch in unit if ch >= "\x80"}
    exchange = max(unit) < "\u3000" and not like_a_word(unit)  # else no single-byte encoding makes a word of it
    for inv in inverses:
        if not inv.pattern and not exchange or chars.isdisjoint(inv.known):
            continue
        runs = accepted(unit, df, inv, known, units_with) if inv.pattern else exchanged(unit, inv, units_with)
        size = sum(e - s for s, e, _ in runs)
        if size > gain:
            best, gain = replaced(unit, runs), size
    if LOST in unit:
        return "lost", best
    return ("restored", best) if best is not None else (None, None)


def garbled_units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit, verdict, restored): the garbled units of each document, once each; '??' stands for question marks."""
    seen = cut(scanned(docs, key, text))
    vocab = cut(vocabulary(seen))
    units_with = contexts(vocab)
    asked = docs.sparkSession.createDataFrame([("??", "lost", None)], "unit string, verdict string, restored string")
    wrong = verdicts(vocab, learn(twins(vocab, units_with)), units_with).unionByName(asked)
    held = seen.filter("kind = 'h'").select(F.col("doc").alias(key), F.col("key").alias("unit")).distinct()
    return held.join(wrong, "unit").select(key, "unit", "verdict", "restored")


def find(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, places, lost): documents with garbled places, how many units, and how many of them lost.

    A document without a garbled place, or with a null or empty text, gives no row. Repeated rows with
    one key count once. Columns other than key and text are ignored. An empty table gives no rows.
    """
    return garbled_units(docs, key, text).groupBy(key).agg(F.count("*").alias("places"), F.count_if(F.col("verdict") == "lost").alias("lost"))


def restore(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, restored, lost): the garbled documents with their text given back where that can be done.

    A unit that was garbled twice is restored twice. Lost characters stay as they are and are counted.
    """
    found = cut(garbled_units(docs, key, text))
    again = found.filter("restored IS NOT NULL").groupBy("unit").agg(F.first("restored").alias("second"))
    twice = found.join(again.withColumnRenamed("unit", "restored"), "restored", "left").withColumn("back", F.coalesce("second", "restored"))
    maps = twice.groupBy(key).agg(F.collect_list(F.struct("unit", "back")).alias("_map"), F.count_if(F.col("verdict") == "lost").alias("lost"))

    @F.pandas_udf("string")
    def put(texts: pd.Series, found_: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(texts, found_, strict=True):
            by = {r["unit"]: r["back"] for r in m if r["back"] is not None}
            out.append(UNIT.sub(lambda u: by.get(u[0], u[0]), t))  # noqa: B023
        return pd.Series(out)

    return docs.select(key, F.col(text).alias("_text")).join(maps, key).select(key, put("_text", "_map").alias("restored"), "lost")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return find(spread(table(spark, folder, "documents")), "doc_id").select("doc_id")


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return restore(spread(table(spark, folder, "documents")), "doc_id")
