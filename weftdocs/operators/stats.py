"""Column statistics, each as one aggregate plan."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftdocs.operators.search import top

PERCENTS = (10, 25, 50, 75, 90, 95)
RANGES = 256  # ranges of values that are counted side by side


def melt(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """(kept columns, column, value): one row per row and column. One scan, no join."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("p")
    return df.select(*keep, pairs).select(*keep, "p.column", "p.value")


def per_column(df: DataFrame, columns: list[str], **of) -> DataFrame:
    """(column, results): one aggregation over all columns at once, whose single row is then turned into one row a column."""
    value = lambda c: F.col(c).cast("double")
    row = df.agg(*[f(value(c)).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in of.items()])
    turned = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{k}_{i}").alias(k) for k in of]) for i, c in enumerate(columns)])).alias("r")
    return row.select(turned).select("r.*")


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, low, high, mean, total, std): population standard deviation; nulls are left out."""
    return per_column(df, columns, n=F.count, low=F.min, high=F.max, mean=F.avg, total=F.sum, std=F.stddev_pop)


def ranged(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Adds _range, the number of the range between two bounds that a value falls into."""
    if not bounds:
        return df.withColumn("_range", F.lit(0.0))
    splits = [float("-inf"), *bounds, float("inf")]
    return Bucketizer(splits=splits, inputCol="_v", outputCol="_range", handleInvalid="keep").transform(df.withColumn("_v", F.col(value).cast("double"))).drop("_v")


def bounds_of(df: DataFrame, value: str) -> list[float]:
    """Bounds of ranges that hold about the same number of rows, RANGES at most: approximate quantiles."""
    at = ", ".join(f"{i / RANGES}D" for i in range(1, RANGES))
    found = df.select(F.col(value).cast("double").alias("v")).agg(F.expr(f"percentile_approx(v, array({at}), {10 * RANGES})")).first()[0]
    return sorted(v for v in set(found or []) if abs(v) < float("inf"))


def counted_values(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n, below): how often each value occurs in its group, and how many smaller ones there are. Nulls are left out.

    Values are counted first and cut into ranges at approximate quantiles of all rows, so that no range of a
    group holds many; running counts go over the values of one range, and those of the ranges below are added.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    at = ranged(counts, "value", bounds_of(df, value))
    sizes = at.groupBy(*group, "_range").agg(F.sum("n").alias("_n"))
    lower = sizes.withColumn("_below", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*group, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at.join(lower.drop("_n"), [*group, "_range"]).select(*group, "value", "n", (F.col("_below") + inside).alias("below"))


def committed(first: Column, second: Column) -> Column:
    """A value only where two computations agree within 1e-9, absolutely or relatively."""
    return F.when(F.abs(first - second) <= F.greatest(F.lit(1e-9), F.lit(1e-9) * F.greatest(F.abs(first), F.abs(second))), first)


def percentiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, pct, value), linear between neighbours; exact, from counted values."""
    counted = counted_values(melt(df, columns), ["column"], "value")
    total = per_column(df, columns, total=F.count).filter("total > 0")  # one row for each column
    wanted = total.select("column", "total", F.explode(F.array(*[F.lit(p) for p in PERCENTS])).alias("pct")).withColumn("at", F.col("pct") / 100.0 * (F.col("total") - 1))
    low, high = F.floor("at"), F.ceil("at")
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    hit = counted.join(F.broadcast(wanted), "column").filter(holds(low) | holds(high))
    ends = hit.groupBy("column", "pct", "at").agg(F.max(F.when(holds(low), F.col("value"))).alias("a"), F.max(F.when(holds(high), F.col("value"))).alias("b"))
    return ends.select("column", "pct", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("value"))


def correlations(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(column, r): Pearson over rows where both are present; null for a constant column or under two rows."""
    t = F.col(target).cast("double")
    with_target = lambda v: F.when(v.isNotNull(), t)
    of = {"c": lambda v: F.covar_pop(v, t), "n": lambda v: F.count(with_target(v)), "s": F.stddev_pop, "t": lambda v: F.stddev_pop(with_target(v))}
    r = per_column(df.filter(F.col(target).isNotNull()), features, **of)
    return r.select("column", F.when((F.col("n") >= 2) & (F.col("s") > 0) & (F.col("t") > 0), F.try_divide("c", F.col("s") * F.col("t"))).alias("r"))


def histogram(df: DataFrame, value: str, bins: int, width: float | None = None) -> DataFrame:
    """(bin, low, high, n): equal widths from the smallest value on; the last bin is closed; empty bins stay.

    Without a width there are `bins` bins up to the largest value. Under two different values: no rows.
    """
    some = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    span = some.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n_all"), F.stddev_pop("v").alias("s")).filter("hi > lo")
    w = (F.col("hi") - F.col("lo")) / bins if width is None else F.lit(width)
    k = F.lit(bins) if width is None else F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / F.lit(width)).cast("int"))
    frame = F.broadcast(span.withColumn("w", w).withColumn("k", k))  # one row
    counted = some.crossJoin(frame).groupBy(F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")).cast("int"), F.col("k") - 1).alias("bin")).agg(F.count("*").alias("n"))
    all_bins = frame.select(F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"), "lo", "w")
    return all_bins.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def scott_width(df: DataFrame, value: str) -> DataFrame:
    """One row: 3.5 * population deviation * n ** (-1/3), cut to three decimals."""
    w = F.lit(3.5) * F.stddev_pop(value) * F.pow(F.count(value), F.lit(-1.0 / 3))
    return df.agg((F.floor(w * 1000 + 1e-9) / 1000).alias("width"))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, rows with a null, complete rows, null cells."""
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])
    return df.agg(F.count("*").alias("rows"), F.count_if(nulls > 0).alias("rows_with_null"), F.count_if(nulls == 0).alias("complete_rows"), F.sum(nulls).alias("null_cells"))


def gram(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """One row of sums of products of (1, features, target) over complete rows: all that least squares needs."""
    names = ["_one", *features, target]
    rows = df.select(F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in (*features, target)]).dropna()
    return rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j])


def least_squares(df: DataFrame, target: str, features: list[str]) -> dict[str, float] | None:
    """Coefficients with intercept; None under features + 2 rows. Only the sums reach the driver."""
    import numpy as np

    n = len(features) + 1
    row = gram(df, target, features).first()
    if row is None or row["s_0_0"] is None or row["s_0_0"] < n + 1:
        return None
    g = np.array([[row[f"s_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    b = np.array([row[f"s_{i}_{n}"] for i in range(n)])
    fit = np.linalg.lstsq(g, b, rcond=None)[0]
    return dict(zip(["intercept", *features], fit.tolist(), strict=True))


def f1_sweep(df: DataFrame, score: str, truth: str) -> DataFrame:
    """One row: the threshold of the best F1 when a row counts as positive from the threshold on.

    Rows of one score are taken together; of equal F1 the lower threshold wins. Scores are counted first, all
    rows and positive ones, and the running counts go over ranges of scores that are cut at quantiles.
    """
    rows = df.select(F.lit(0).alias("_g"), F.col(score).cast("double").alias("t"), F.col(truth).alias("y"))
    every = counted_values(rows, ["_g"], "t").select("_g", "value", "n", "below")
    good = rows.groupBy("_g", F.col("t").alias("value")).agg(F.sum("y").alias("p"))
    whole = F.broadcast(rows.agg(F.count("t").alias("all_n"), F.sum("y").alias("all_p")))  # one row
    up = Window.partitionBy("_range").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged(every.join(good, ["_g", "value"]), "value", bounds_of(rows, "t"))
    per = joined.groupBy("_range").agg(F.sum("p").alias("pp"))
    above = per.select("_range", F.coalesce(F.sum("pp").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p0"))  # one row for each range
    swept = joined.join(F.broadcast(above), "_range").crossJoin(whole).select("value", (F.sum("p").over(up) + F.col("p0")).alias("tp"), (F.col("all_n") - F.col("below")).alias("taken"), "all_p")
    f1 = F.try_divide(2.0 * F.col("tp"), F.col("taken") + F.col("all_p"))
    return top(swept.select(F.col("value").alias("threshold"), "tp", (F.col("taken") - F.col("tp")).alias("fp"), (F.col("all_p") - F.col("tp")).alias("fn"), F.round(f1, 8).alias("f1")), 1, F.desc("f1"), "threshold")


def average_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, rank): rank from 1 of each value; ties share their average."""
    return counted_values(df, group, value).select(*group, F.col("value").alias(value), (F.col("below") + (F.col("n") + 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, rho) from average ranks over rows with both values; null where one side is constant."""
    rows = df.select(*group, F.col(x).alias("x"), F.col(y).alias("y")).dropna(subset=["x", "y"])
    # pairs of values are counted first, so that each is looked up once
    pairs = rows.groupBy(*group, "x", "y").agg(F.count("*").alias("k"))
    ranked = pairs.join(average_ranks(rows, group, "x").withColumnRenamed("rank", "rx"), [*group, "x"]).join(average_ranks(rows, group, "y").withColumnRenamed("rank", "ry"), [*group, "y"])
    s = lambda e: F.sum(F.col("k") * e)
    by = ranked.groupBy(*group).agg(F.sum("k").alias("n"), s(F.col("rx")).alias("a"), s(F.col("ry")).alias("b"), s(F.col("rx") * F.col("ry")).alias("ab"), s(F.col("rx") * F.col("rx")).alias("aa"), s(F.col("ry") * F.col("ry")).alias("bb"))
    vx, vy = F.col("n") * F.col("aa") - F.col("a") * F.col("a"), F.col("n") * F.col("bb") - F.col("b") * F.col("b")
    return by.select(*group, F.when((vx > 0) & (vy > 0), (F.col("n") * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt(vx) / F.sqrt(vy)).alias("rho"))


def unique_best(df: DataFrame, group: list[str], value: Column | str, *order: Column) -> DataFrame:
    """The row of the largest value of each group; none where two rows share it."""
    w = Window.partitionBy(*group)
    v = F.col(value) if isinstance(value, str) else value
    best = df.withColumn("_best", F.max(v).over(w)).filter(v == F.col("_best"))
    return best.withColumn("_n", F.count("*").over(w)).filter("_n = 1").drop("_n", "_best")
