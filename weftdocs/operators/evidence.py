"""Typed evidence in lines, look-ups with caps, and scans that state how complete they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of evidence that take a whole line, and where key and value stand.
WHOLE = {
    "highlight": (r"^([A-Z]{1,2}[0-9]+)\((yellow|red|green|blue|orange)\): ([^\n]+)$", 1, 3),
    "param": (r"^([A-Za-z_][A-Za-z0-9_]*) = ([^\n]+)$", 1, 2),
    "heading": (r"^(#+) ([^\n]+)$", 1, 2),
    "marker": (r"^\[(page|sheet|slide)([0-9]+)\]", 1, 2),
    "subject": (r"^(件名|Subject|Betreff|Objet): ([^\n]+)$", 1, 2),
}
# Kinds that may stand several times in a line. The second pattern must match all of what the first one finds.
WITHIN = {
    "amount": (r"[0-9]{1,3}(?:,[0-9]{3})+(?:円| yens?| Yens?)", r"^()([0-9,]+)", 1, 2),
    "rate": (r"[0-9]+(?:\.[0-9])? ?[%％]", r"^()([0-9.]+)", 1, 2),
    "person": (r"[一-龯々]+(?:さん[一-龯々]*)?", r"^(([一-龯々]{1,8})(?:さん|様|氏|部長|課長|社長))$", 2, 1),
    "condition": (r"別契約|明記|必須|任意|対象外|除外|条件|ただし|以上|以下|未満", r"^((.+))$", 1, 2),
    "alias": (r"[A-Za-z0-9_一-龯ぁ-んァ-ヶー]{2,40}\s*[（(][^()（）\n]{2,40}[）)]", r"^([^\s（(]+)\s*[（(]([^()（）]+)[）)]$", 1, 2),
    "ext": (r"(?i)(?:\bEXT[.:\s-]*|内線[：:\s]*)[0-9]{2,8}\b", r"(([0-9]{2,8}))$", 1, 2),
    "number": (r"[0-9A-Za-z_¥￥$.,%％/-]+(?:円|万円|億円)?", r"^()([¥￥$]?[0-9][0-9,]*(?:\.[0-9]+)?(?:円|万円|億円|%|％)?)$", 1, 2),
}
BOLD = "【太字箇所】"  # what follows is a list of bold words, set apart by " / "
CELL_MARK = " | "


def extract(lines: DataFrame, keep: list[str], line: str = "line") -> DataFrame:
    """(keep, ev_type, ev_key, ev_value): every hit of every kind in each line. One scan for all kinds.

    Cells of a table row without digits are column names; such a row is a header.
    """
    c = F.col(line)
    hit = lambda kind, k, v: F.struct(F.lit(kind).alias("ev_type"), k.alias("ev_key"), v.alias("ev_value"))
    whole = F.array_compact(F.array(*[F.when(c.rlike(p), hit(kind, F.regexp_extract(c, p, k), F.regexp_extract(c, p, v))) for kind, (p, k, v) in WHOLE.items()]))

    def within(kind: str, p: str, check: str, k: int, v: int) -> Column:
        found = F.filter(F.regexp_extract_all(c, F.lit(p), F.lit(0)), lambda t: t.rlike(check))
        return F.transform(found, lambda t: hit(kind, F.regexp_extract(t, check, k), F.regexp_extract(t, check, v)))

    words = F.filter(F.transform(F.split(F.regexp_replace(c, BOLD, ""), " / "), F.trim), lambda x: x != "")
    nothing = F.slice(whole, 1, 0)
    bold = F.when(c.startswith(BOLD), F.transform(words, lambda x: hit("bold", x, x))).otherwise(nothing)
    columns = F.when(c.contains(CELL_MARK) & ~c.rlike("[0-9]"), F.transform(F.split(c, r" \| "), lambda x: hit("column", F.trim(x), F.trim(x)))).otherwise(nothing)
    return lines.select(*keep, F.explode(F.concat(whole, *[within(kind, *spec) for kind, spec in WITHIN.items()], bold, columns)).alias("e")).select(*keep, "e.*")


def certificate(universe: DataFrame, key: str, applicable: Column, scanned: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: total, applicable, scanned, unsupported, hits, complete (every applicable member was
    scanned, and there was one)."""
    marked = universe.select(key, applicable.alias("ok")).groupBy(key).agg(F.bool_or("ok").alias("ok"))
    seen = scanned.select(key).distinct().withColumn("seen", F.lit(1))
    hit = hits.select(key).distinct().withColumn("hit", F.lit(1))
    joined = marked.join(seen, key, "left").join(hit, key, "left")
    ok, done = F.coalesce("ok", F.lit(False)), F.col("seen").isNotNull()
    return joined.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("applicable"), F.count_if(ok & done).alias("scanned"), F.count_if(~ok).alias("unsupported"), F.count("hit").alias("hits"), ((F.count_if(ok) > 0) & (F.count_if(ok & ~done) == 0)).alias("complete")
    )


def exclude_any_require_all(df: DataFrame, tags: str, exclude: list[str], require: list[str]) -> DataFrame:
    """Rows without any excluded tag and with all required ones."""
    none = reduce(lambda a, b: a & b, [~F.array_contains(tags, t) for t in exclude], F.lit(True))
    return df.filter(reduce(lambda a, b: a & b, [F.array_contains(tags, t) for t in require], none))
