"""Joins that refuse ambiguous matches, and joins of snapshots, grids and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_right(right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the right side whose key occurs once; null keys never match."""
    some = right.dropna(subset=keys)
    return some.join(some.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n"), keys)


def join_unique(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that answers only where the right side has exactly one row for the key."""
    return left.join(unique_right(right, keys), keys, "left")


def compare(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, before, after, change): keyed full outer comparison of two snapshots; equal values are left out."""
    a = old.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "add").when(F.col("_b").isNull(), "remove").when(~F.col("before").eqNullSafe(F.col("after")), "modify")
    return a.join(b, keys, "full_outer").withColumn("change", change).filter("change IS NOT NULL").select(*keys, "before", "after", "change")


def overlapping(df: DataFrame, start: str, end: str, window_start: Column, window_end: Column, more_than_days: int) -> DataFrame:
    """Rows whose closed interval meets the window, and is longer than so many days."""
    return df.filter((F.col(start) <= window_end) & (F.col(end) >= window_start) & (F.datediff(end, start) > more_than_days))


def two_hops(start: DataFrame, first: DataFrame, second: DataFrame, key: str, via: str, goal: str) -> DataFrame:
    """(key, goal): goals reached directly (column goal of first) or by way of `via` of second, once each."""
    hop = start.join(first, key)
    direct = hop.filter(F.col(goal).isNotNull()).select(key, goal)
    return direct.unionByName(hop.drop(goal).join(second, via).select(key, goal)).distinct()


def grid_place(cell: str | Column) -> tuple[Column, Column]:
    """(column number, row number) of a cell such as AB12."""
    c = F.upper(F.col(cell)) if isinstance(cell, str) else F.upper(cell)
    letters = F.regexp_extract(c, "^([A-Z]{1,3})[0-9]+$", 1)
    digits = F.transform(F.filter(F.split(letters, ""), lambda x: x != ""), lambda x: F.ascii(x) - 64)
    return F.aggregate(digits, F.lit(0), lambda s, d: s * 26 + d), F.regexp_extract(c, "([0-9]+)$", 1).try_cast("int")


def beside(cells: DataFrame, group: list[str], key: str, steps: list[tuple[int, int]]) -> DataFrame:
    """(group, key, neighbour): cells with columns c and r that lie one of the steps apart. An equi-join on the place."""
    moved = cells.select(*group, F.col(key), F.explode(F.array(*[F.struct((F.col("c") + dc).alias("c"), (F.col("r") + dr).alias("r")) for dc, dr in steps])).alias("to"))
    there = cells.select(*group, F.col(key).alias("neighbour"), F.struct("c", "r").alias("to"))
    return moved.join(there, [*group, "to"]).select(*group, key, "neighbour")


def latest(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The last row of each key: a ledger read in which the last record wins."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of values by row; a value that does not occur counts zero."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, values)
