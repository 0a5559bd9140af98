"""Numbers, rates, answers and changes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftdocs.functions.text import col

NUMBER = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
# Coarse names of hues in degrees, up to each bound.
HUES = [(15, "red"), (45, "orange"), (70, "yellow"), (165, "green"), (255, "blue"), (330, "purple"), (361, "red")]
# Kinds of change, the first that fits, with rank.
TAGS = {"amount": r"[0-9]{1,3}(?:,[0-9]{3})+", "rate": r"[0-9] ?[%％]", "date": r"[0-9]{4}年|[0-9]{1,2}月[0-9]{1,2}日|[0-9]{4}-[0-9]{2}-[0-9]{2}", "task": r"T[0-9]{2}", "person": r"[一-龯々]+さん"}
BOILERPLATE = r"^(?:\[(?:page|sheet|slide)[0-9]+\]|\[ページ ?[0-9]+\]|ID \| item \| owner \| days|[-=*_ ]+|KR-[0-9]+)$"


def numbers(text: str | Column) -> Column:
    """All numbers of a text, without thousands separators, in order."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, ",", ""))


def same_numbers(a: str | Column, b: str | Column) -> Column:
    """Whether two texts hold the same numbers, each as often."""
    return F.array_sort(numbers(a)) == F.array_sort(numbers(b))


def only_number(text: str | Column) -> Column:
    """The number of a text that holds exactly one, as written, else null."""
    n = numbers(text)
    return F.when(F.size(n) == 1, n[0])


def decimals(number: Column) -> Column:
    """Places after the point of a number as written."""
    return F.length(F.regexp_extract(number, r"\.([0-9]+)$", 1))


def number_verdict(a: str | Column, b: str | Column) -> Column:
    """exact: one number on either side, and equal; rounded: equal once both have the fewer places, which must differ; else no."""
    x, y = only_number(a), only_number(b)
    least = F.least(decimals(x), decimals(y))
    scaled = lambda v: F.floor(v.cast("decimal(30,10)") * F.pow(F.lit(10), least).cast("decimal(20,0)") + F.lit(0.5).cast("decimal(2,1)"))
    same = x.cast("decimal(30,10)") == y.cast("decimal(30,10)")
    return F.when(x.isNull() | y.isNull(), "no").when(same, "exact").when((decimals(x) != decimals(y)) & (scaled(x) == scaled(y)), "rounded").otherwise("no")


def normal_answer(text: str | Column) -> Column:
    """An answer for comparison: lower case, without blanks, thousands separators, quotation marks and a closing stop or copula."""
    c = F.lower(F.regexp_replace(col(text), "[\\s　,，\"'「」]+", ""))
    return F.regexp_replace(c, "(?:です|である)?[。.]*$", "")


def answer_verdict(a: str | Column, b: str | Column) -> Column:
    """same, number, contains or different: the first that holds of two answers."""
    x, y = normal_answer(a), normal_answer(b)
    empty = (x == "") | (y == "")
    return F.when(x == y, "same").when(number_verdict(a, b) != "no", "number").when(~empty & (F.contains(x, y) | F.contains(y, x)), "contains").otherwise("different")


def set_contained(found: Column, wanted: Column) -> Column:
    """Whether every wanted item is held by, or holds, some found item."""
    return F.forall(wanted, lambda w: F.exists(found, lambda f: F.contains(f, w) | F.contains(w, f)))


def rate(cell: str | Column) -> Column:
    """(low, high, mid) of a rate written as one number or as a range; null without a number or with more than two."""
    n = F.transform(numbers(cell), lambda x: x.cast("double"))
    low, high = F.least(n[0], n[F.size(n) - 1]), F.greatest(n[0], n[F.size(n) - 1])
    return F.when((F.size(n) >= 1) & (F.size(n) <= 2), F.struct(low.alias("low"), high.alias("high"), ((low + high) / 2).alias("mid")))


def hours(cell: str | Column) -> Column:
    """Hours written as 2, 2.5h, 3時間 or 4 hours, else null."""
    return F.regexp_extract(F.trim(col(cell)), r"(?i)^([0-9]+(?:\.[0-9]+)?) ?(?:h|hours?|時間)?$", 1).try_cast("double")


def header_core(header: str | Column) -> Column:
    """A column header without the unit in brackets at its end."""
    return F.trim(F.regexp_replace(col(header), r"[（(\[][^（）()\[\]]*[）)\]] *$", ""))


def without_bracket(text: str | Column) -> Column:
    """A text without brackets at its end, unless a number would be lost."""
    c = col(text)
    bare = header_core(c)
    return F.when(same_numbers(bare, c), bare).otherwise(c)


def rounded_as_asked(question: str | Column, value: Column) -> Column:
    """A value with the decimal places that a question states; otherwise as it is."""
    places = F.coalesce(F.regexp_extract(col(question), "小数(?:点以下|第) ?([0-9])", 1).try_cast("int"), F.regexp_extract(col(question), r"(?i)([0-9]) decimal", 1).try_cast("int"))
    shift = F.pow(F.lit(10.0), places)
    return F.when(places.isNull(), value).otherwise(F.floor(value * shift + 0.5) / shift)


def tilde_range(text: str | Column) -> Column:
    """Intervals such as [1, 2) as 1〜2."""
    return F.regexp_replace(col(text), r"[\[(]\s*(-?[0-9.]+)\s*,\s*(-?[0-9.]+)\s*[\])]", "$1〜$2")


def coarse_colour(rgb: str | Column) -> Column:
    """A coarse name of a colour written as RRGGBB: by brightness and saturation first, then by hue."""
    c = F.upper(col(rgb))
    r, g, b = (F.conv(F.substring(c, k, 2), 16, 10).cast("int") for k in (1, 3, 5))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (high - low).cast("double")
    hue = F.when(high == r, F.pmod((g - b) / span, F.lit(6.0))).when(high == g, (b - r) / span + 2).otherwise((r - g) / span + 4) * 60
    named = F.lit(None).cast("string")
    for bound, name in reversed(HUES):
        named = F.when(hue < bound, name).otherwise(named)
    grey = F.when(high < 48, "black").when(low > 239, "white").otherwise("grey")
    return F.when(c.rlike("^[0-9A-F]{6}$"), F.when(span < 24, grey).otherwise(named))


def status_kind(text: str | Column) -> Column:
    """done, open or unknown from a word of status."""
    c = F.lower(col(text))
    return F.when(c.rlike("未完了|未着手|対応中|進行中|移行|open|pending"), "open").when(c.rlike("完了|済|確認|done|closed|review"), "done").otherwise("unknown")


def change_tags(line: str | Column) -> Column:
    """What a changed line is about, in fixed order."""
    return F.array_compact(F.array(*[F.when(col(line).rlike(p), F.lit(tag)) for tag, p in TAGS.items()]))


def change_score(line: str | Column) -> Column:
    """(intent, rank, score) of a changed line: substantive before wording before boilerplate; a longer line does not score higher."""
    tags = change_tags(line)
    boilerplate = F.trim(col(line)).rlike(BOILERPLATE)
    return F.struct(
        F.when(boilerplate, "boilerplate").when(F.size(tags) > 0, "substantive").otherwise("wording").alias("intent"),
        F.when(boilerplate, 0).when(F.size(tags) > 0, 2).otherwise(1).alias("rank"), F.when(boilerplate, 0).otherwise(F.size(tags)).alias("score"),
    )


def paraphrases(question: str | Column) -> Column:
    """Different wordings of a question that ask the same."""
    c = col(question)
    made = [F.regexp_replace(c, "を?教えてください。?$", "は何ですか。"), F.regexp_replace(c, "は何ですか。?$", "を教えてください。"), F.regexp_replace(c, "を?答えてください。?$", "を示してください。"), F.regexp_replace(c, "^What is ", "Tell me "), F.regexp_replace(c, r"\?$", ".")]
    return F.array_except(F.array_distinct(F.array(*made)), F.array(c))


def condition_of(question: str | Column) -> Column:
    """The condition of a what-if question, else null."""
    c = col(question)
    found = F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in ("もし(.{1,80}?)(?:たら|なら|れば)", "([^。、]{1,80})場合", r"(?i)\bif ([^,?]{1,80})")])
    return F.trim(found)
