"""Verdicts, thresholds and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micro_pr(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: true and false positives, false negatives, precision and recall over distinct keys."""
    a, b = found.select(*keys).distinct().withColumn("_f", F.lit(1)), truth.select(*keys).distinct().withColumn("_t", F.lit(1))
    j = a.join(b, keys, "full_outer").agg(F.count_if(F.col("_f").isNotNull() & F.col("_t").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))
    return j.select("tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


def best_threshold(df: DataFrame, confidence: str, points: Column, groups: list[str]) -> DataFrame:
    """(groups, threshold, ev, committed): commit from the threshold on; largest sum of points, the higher threshold on a tie.

    Never committing, with a sum of zero, is a candidate too; its threshold is null.
    """
    by = df.groupBy(*groups, confidence).agg(F.sum(points).alias("p"), F.count("*").alias("n"))
    run = Window.partitionBy(*groups).orderBy(F.desc(confidence)).rowsBetween(Window.unboundedPreceding, 0)
    swept = by.select(*groups, F.col(confidence).alias("threshold"), F.sum("p").over(run).alias("ev"), F.sum("n").over(run).alias("committed"))
    best = swept.groupBy(*groups).agg(F.max(F.struct("ev", "threshold", "committed")).alias("b"))
    some = F.col("b.ev") > 0
    return best.select(*groups, F.when(some, F.col("b.threshold")).alias("threshold"), F.when(some, F.col("b.ev")).otherwise(0.0).alias("ev"), F.when(some, F.col("b.committed")).otherwise(F.lit(0)).alias("committed"))


def majority(df: DataFrame, group: list[str], vote: str, least: int) -> DataFrame:
    """(group, vote, n): the vote with most members, if they are at least `least` and no other vote has as many."""
    c = df.filter(F.col(vote).isNotNull()).groupBy(*group, vote).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group)
    top = c.withColumn("_m", F.max("n").over(w)).filter((F.col("n") == F.col("_m")) & (F.col("n") >= least))
    return top.withColumn("_k", F.count("*").over(w)).filter("_k = 1").drop("_m", "_k")


def mean_one_weights(df: DataFrame, key: str, wanted: dict[str, float] | None = None) -> DataFrame:
    """Adds weight: wanted share over actual share of the row's class, scaled to a mean of one. Without wanted shares, all classes have the same one."""
    share = F.try_element_at(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]), F.col(key)) if wanted else F.lit(1.0)
    n = df.groupBy(key).agg(F.count("*").alias("_c")).withColumn("_w", F.coalesce(share, F.lit(0.0)))  # one row per class
    whole = n.agg(F.sum("_c").alias("_n"), F.sum("_w").alias("_s"))
    rated = n.crossJoin(F.broadcast(whole)).select(key, F.try_divide(F.col("_w") * F.col("_n"), F.col("_c") * F.col("_s")).alias("weight"))  # one row
    return df.join(rated, key, "left")
