"""Differences between versions of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftdocs.operators.lines import lines


def version_pairs(docs: DataFrame, family: list[str], key: str, *order: str) -> DataFrame:
    """(family, old, new): consecutive versions of each family."""
    w = Window.partitionBy(*family).orderBy(*order)
    return docs.select(*family, F.lag(key).over(w).alias("old"), F.col(key).alias("new")).filter("old IS NOT NULL")


def changed_lines(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(old, new, line, change, times): lines added or removed between versions, as multisets.

    A line that one version has more often counts by the difference. No order, so no Python.
    """
    rows = lines(docs, key, text).groupBy(key, "line").agg(F.count("*").alias("n"))
    before = pairs.select("old", "new").join(rows.withColumnRenamed(key, "old"), "old").select("old", "new", "line", (-F.col("n")).alias("d"))
    after = pairs.select("old", "new").join(rows.withColumnRenamed(key, "new"), "new").select("old", "new", "line", F.col("n").alias("d"))
    net = before.unionByName(after).groupBy("old", "new", "line").agg(F.sum("d").alias("d")).filter("d <> 0")
    return net.select("old", "new", "line", F.when(F.col("d") > 0, "add").otherwise("remove").alias("change"), F.abs("d").alias("times"))


def moved(changes: DataFrame, group: list[str]) -> DataFrame:
    """Adds moved: the same line, blanks aside, was both added and removed in its group."""
    shape = F.lower(F.regexp_replace("line", r"\s+", ""))
    w = Window.partitionBy(*group, shape)
    return changes.withColumn("moved", (F.max((F.col("change") == "add").cast("int")).over(w) == 1) & (F.max((F.col("change") == "remove").cast("int")).over(w) == 1))


def edit_blocks(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(old, new, op, old_from, old_to, new_from, new_to): edit blocks in order; positions count lines from 0, the end is exclusive.

    The n-th line of some content is matched with the n-th line of the same content in the other version.
    Matches that cross no other match are anchors; what lies between two anchors is one block. Empty and
    null texts give no block; \\n and \\r\\n end a line alike.
    """
    parts = F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n")
    some = docs.filter(F.length(text) > 0)
    numbered = some.select(F.col(key).alias("k"), F.posexplode(parts).alias("no", "line")).withColumn("nth", F.row_number().over(Window.partitionBy("k", "line").orderBy("no")))
    both = pairs.select("old", "new").filter("old IS NOT NULL AND new IS NOT NULL").distinct()
    side = lambda name, at: both.join(numbered.select(F.col("k").alias(name), F.col("no").alias(at), F.xxhash64("line").alias("h"), "line", "nth"), name)
    matched = side("old", "i").join(side("new", "j"), ["old", "new", "h", "line", "nth"]).select("old", "new", "i", "j")
    w = Window.partitionBy("old", "new").orderBy("i")
    before, after = F.max("j").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.min("j").over(w.rowsBetween(1, Window.unboundedFollowing))
    anchors = matched.withColumn("_b", before).withColumn("_a", after).filter("coalesce(_b, -1) < j AND coalesce(_a, j + 1) > j").select("old", "new", "i", "j")
    sizes = some.select(F.col(key).alias("k"), F.size(parts).alias("n"))
    ends = both.join(sizes.select(F.col("k").alias("old"), F.col("n").alias("i")), "old").join(sizes.select(F.col("k").alias("new"), F.col("n").alias("j")), "new").select("old", "new", "i", "j")
    gaps = anchors.unionByName(ends).withColumn("i0", F.coalesce(F.lag("i").over(w) + 1, F.lit(0))).withColumn("j0", F.coalesce(F.lag("j").over(w) + 1, F.lit(0))).filter("i > i0 OR j > j0")
    op = F.when(F.col("i") == F.col("i0"), "insert").when(F.col("j") == F.col("j0"), "delete").otherwise("replace")
    return gaps.select("old", "new", op.alias("op"), F.col("i0").alias("old_from"), F.col("i").alias("old_to"), F.col("j0").alias("new_from"), F.col("j").alias("new_to"))
