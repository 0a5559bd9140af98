"""Column functions for text: tokens, identifiers, versions, numbers, dates."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What belongs to a word and to a run of Japanese, for lines (LINE_*), chunks (BAG_*) and file names (NAME_*).
LINE_ASCII, LINE_RUN = "[A-Za-z0-9][A-Za-z0-9_.-]*[A-Za-z0-9]", "[぀-ヿ㐀-鿿豈-﫿々〆ヶー]+"
BAG_ASCII, BAG_CHAR = "[a-z0-9_]+", "[぀-ヿ一-鿿]"
NAME_ASCII, NAME_RUN = "[A-Za-z0-9_]{2,}", "[ぁ-んァ-ヶ一-鿿々ー]{2,}"
MARKS = "[\u0300-\u036f\u3099\u309a]"  # text without any of these is composed already
ID_PATTERN = "(?:^|[^A-Za-z0-9-])([A-Za-z]{1,4})[-_]?([0-9]{1,4})(?:[^A-Za-z0-9]|$)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shingles(c: Column, n: int) -> Column:
    """All n-character windows of a string of at least n characters."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def composed(text: str | Column) -> Column:
    """NFC. Only texts that hold a combining mark go to Python."""
    from weftdocs.functions.forms import normal_form

    c = col(text)
    return F.coalesce(normal_form(F.when(c.rlike(MARKS), c)), c)


def search_tokens(text: str | Column) -> Column:
    """Tokens of lines: words of two or more characters that keep inner _ . -, whole runs of Japanese, and the
    two-character windows of longer runs; in lower case, duplicates kept."""
    c = col(text)
    runs = F.regexp_extract_all(c, F.lit(LINE_RUN), F.lit(0))
    words = F.transform(F.regexp_extract_all(c, F.lit(LINE_ASCII), F.lit(0)), F.lower)
    return F.concat(words, F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.concat(F.array(r), shingles(r, 2))))))


def tokens_of(query: str) -> list[str]:
    """The distinct search tokens of a query, in order."""
    q = unicodedata.normalize("NFC", query)
    out = [w.lower() for w in re.findall(LINE_ASCII, q)]
    for r in re.findall(LINE_RUN, q):
        out += [r] if len(r) == 1 else [r, *(r[i : i + 2] for i in range(len(r) - 1))]
    return list(dict.fromkeys(out))


def mentions(text: str | Column, tokens: list[str]) -> Column:
    """A text without this holds none of the tokens; a cheap test before a text is cut into tokens."""
    return F.lower(col(text)).rlike("|".join(re.escape(t) for t in tokens) or "$^")


def token_count(text: str | Column) -> Column:
    """How many search tokens a text has, without making them: a run of n characters has n, as does a single one."""
    c = col(text)
    return F.regexp_count(c, F.lit(LINE_ASCII)) + F.length(F.array_join(F.regexp_extract_all(c, F.lit(LINE_RUN), F.lit(0)), ""))


def bag_tokens(text: str | Column) -> Column:
    """Tokens of chunks, as a bag: words, pairs of Japanese characters that follow each other, whatever stands between, and single ones."""
    low = F.lower(col(text))
    chars = F.regexp_extract_all(low, F.lit(BAG_CHAR), F.lit(0))
    pairs = F.array_compact(F.zip_with(chars, F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b)))
    return F.concat(F.regexp_extract_all(low, F.lit(BAG_ASCII), F.lit(0)), pairs, chars)


def strong_weak(text: str | Column) -> tuple[Column, Column]:
    """Strong tokens are words and whole runs of Japanese; weak ones are windows of three and two that are not strong themselves."""
    c = col(text)
    runs = F.regexp_extract_all(c, F.lit(NAME_RUN), F.lit(0))
    strong = F.array_distinct(F.concat(F.transform(F.regexp_extract_all(c, F.lit(NAME_ASCII), F.lit(0)), F.lower), runs))
    weak = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.concat(shingles(r, 3), shingles(r, 2)))))
    return strong, F.array_except(weak, strong)


def trigrams(text: str | Column) -> Column:
    return F.array_distinct(shingles(F.regexp_replace(F.lower(col(text)), r"\s+", ""), 3))


def fold(text: str | Column) -> Column:
    """Lower case with blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(col(text)), r"\s+", " "))


def canonical_id(prefix: str | Column, number: str | Column) -> Column:
    return F.concat(F.upper(col(prefix)), col(number))


def parse_numeric(cell: str | Column) -> Column:
    """The number of a cell with thousands separators or a percent sign, else null."""
    c = F.trim(col(cell))
    return F.when(c.rlike(r"^[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]+)?[%％]?$"), F.regexp_replace(c, "[,%％]", "").try_cast("double"))


def stem(name: str | Column) -> Column:
    return F.regexp_replace(col(name), r"\.[A-Za-z0-9]+$", "")


def version_rank(name: str | Column) -> Column:
    """Old before plain, plain before numbered versions, those before final."""
    s = F.lower(stem(name))
    number = F.regexp_extract(s, r"(?:_v|改訂-| rev-)([0-9]+)", 1).try_cast("int")
    return F.when(s.contains("_old"), -1).when(s.contains("_final"), 10000).otherwise(F.coalesce(number, F.lit(0)))


def version_base(name: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(stem(name)), r"(_old|_final|_v[0-9]+|[ _]?改訂-[0-9]+| rev-[0-9]+)", ""))


def clip(text: str | Column, limit: int) -> Column:
    c = col(text).cast("string")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 1), F.lit("…")))


def locator(cell: str | Column, sheet: str | Column, paragraph: str | Column) -> Column:
    """A cell comes before a sheet, and a sheet before a paragraph."""
    return F.coalesce(F.concat(F.lit("cell:"), col(cell)), F.concat(F.lit("sheet:"), col(sheet)), F.concat(F.lit("par:"), col(paragraph).cast("string")), F.lit("-"))


def half_up(value: str | Column, digits: int) -> Column:
    return F.round(col(value).cast("decimal(38,10)"), digits)


def round_up_to(value: str | Column, unit: float) -> Column:
    """Up to the next multiple of unit, with a guard against binary fractions."""
    return F.ceil(F.round(col(value) / F.lit(unit), 9)) * F.lit(unit)


def iso_date(cell: str | Column) -> Column:
    """Dates written as 2024-05-06, 2024/5/6 or 2024年5月6日."""
    c = col(cell)
    part = lambda k: F.regexp_extract(c, r"([0-9]{4})[-/年]([0-9]{1,2})[-/月]([0-9]{1,2})", k)
    return F.when(part(1) != "", F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd"))
