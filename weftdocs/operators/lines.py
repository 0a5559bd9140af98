"""Located lines of documents, markers that carry on, and scans over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKER = r"^\[(page|sheet|slide)([0-9]+)\]"


def lines(docs: DataFrame, doc: str, text: str, *keep: str) -> DataFrame:
    """(doc, line_no from 1, line, kept columns) of every line that is not blank."""
    split = docs.select(doc, *keep, F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n")).alias("pos", "line"))
    return split.select(doc, *keep, (F.col("pos") + 1).alias("line_no"), "line").filter(F.trim("line") != "")


def carried_context(numbered: DataFrame, doc: str) -> DataFrame:
    """Adds the kind and number of the last marker at or before each line; a new marker replaces the old."""
    mark = F.when(F.col("line").rlike(MARKER), F.struct(F.regexp_extract("line", MARKER, 1).alias("kind"), F.regexp_extract("line", MARKER, 2).cast("int").alias("no")))
    order = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = numbered.withColumn("_mark", F.last(mark, ignorenulls=True).over(order))
    return carried.select("*", F.col("_mark.kind").alias("marker"), F.col("_mark.no").alias("marker_no")).drop("_mark")


def grep(numbered: DataFrame, doc: str, pattern: str, per_doc: int | None = None) -> DataFrame:
    """Lines that match, with the number of matching lines of their document; at most per_doc of each, first ones first."""
    hits = numbered.filter(F.col("line").rlike(pattern))
    order = Window.partitionBy(doc).orderBy("line_no")
    ranked = hits.withColumn("hit_no", F.row_number().over(order)).withColumn("hits", F.count("*").over(Window.partitionBy(doc)))
    return ranked.filter(F.col("hit_no") <= per_doc) if per_doc else ranked


def capped(df: DataFrame, group: list[str], order: list[Column | str], per_group: int) -> DataFrame:
    """The first rows of each group."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= per_group).drop("_rank")


def forward_fill(df: DataFrame, group: list[str], order: list[str], value: str, clears: Column) -> DataFrame:
    """Fills nulls of value from the rows before; a row on which `clears` holds starts anew."""
    run = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = df.withColumn("_island", F.sum(F.when(clears, 1).otherwise(0)).over(run))
    inside = Window.partitionBy(*group, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn(f"{value}_filled", F.last(value, ignorenulls=True).over(inside)).drop("_island")


def gap_clusters(df: DataFrame, group: list[str], value: str, tie: str, gap: float) -> DataFrame:
    """Numbers the clusters of each group: a step of more than gap between neighbours starts a new one."""
    order = Window.partitionBy(*group).orderBy(value, tie)
    step = (F.col(value) - F.lag(value).over(order)) > gap
    return df.withColumn("cluster", F.sum(F.when(step, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
