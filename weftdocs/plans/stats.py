"""Statistics queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftdocs.functions.text import half_up, parse_numeric
from weftdocs.operators import lines as L
from weftdocs.operators import stats as M
from weftdocs.operators.search import top
from weftdocs.session import table

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MELT = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS value FROM lineitem" for c in COLUMNS)


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def column_stats(spark: SparkSession, folder: str) -> DataFrame:
    m = M.moments(table(spark, folder, "lineitem"), COLUMNS)
    return m.select("column", "n", *r6("low", "high", "mean"), F.round("total", 2).alias("total"), *r6("std"))


COLUMN_STATS = f"SELECT \"column\", count(value) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(sum(value), 2) AS total, round(stddev_pop(value), 6) AS std FROM ({MELT}) GROUP BY 1"


def dual_check(spark: SparkSession, folder: str) -> DataFrame:
    """Variances by two computations, kept only where they agree."""
    m = M.melt(table(spark, folder, "lineitem"), COLUMNS).groupBy("column")
    both = m.agg(F.var_pop("value").alias("a"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count("value").alias("n"))
    second = F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2))
    return both.select("column", M.committed(F.col("a"), second).isNotNull().alias("agree"), F.round("a", 4).alias("variance"))


DUAL_SQL = f"""
WITH m AS (SELECT "column", var_pop(value) AS a, sum(value * value) / count(value) - pow(sum(value) / count(value), 2) AS b FROM ({MELT}) GROUP BY 1)
SELECT "column", abs(a - b) <= greatest(1e-9, 1e-9 * greatest(abs(a), abs(b))) AS agree, round(a, 4) AS variance FROM m"""


def column_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return M.percentiles(table(spark, folder, "lineitem"), COLUMNS).select("column", "pct", *r6("value"))


PERCENTILES = "SELECT \"column\", pct, round(v, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT \"column\", {p} AS pct, quantile_cont(value, {p / 100}) AS v FROM ({MELT}) GROUP BY 1" for p in M.PERCENTS) + ")"


def column_correlations(spark: SparkSession, folder: str) -> DataFrame:
    return M.correlations(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"]).select("column", *r6("r"))


CORR_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr({c}, l_extendedprice), 6) AS r FROM lineitem" for c in ["l_quantity", "l_discount", "l_tax", "l_linenumber"])


def top_feature(spark: SparkSession, folder: str) -> DataFrame:
    r = M.correlations(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return top(r.select("column", F.round(F.abs("r"), 6).alias("strength")), 1, F.desc("strength"), "column")


TOP_FEATURE = "SELECT \"column\", abs(r) AS strength FROM (" + " UNION ALL ".join(CORR_SQL.split(" UNION ALL ")[:3]) + ") ORDER BY 2 DESC, 1 LIMIT 1"


def histogram10(spark: SparkSession, folder: str) -> DataFrame:
    return M.histogram(table(spark, folder, "orders"), "o_totalprice", 10).select("bin", *[F.round(c, 4).alias(c) for c in ("low", "high")], "n")


HIST_SQL = """
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 10))::INT, 9) AS bin, count(*) AS n FROM orders, s GROUP BY 1)
SELECT b::INT AS bin, round(lo + b * (hi - lo) / 10, 4) AS low, round(lo + (b + 1) * (hi - lo) / 10, 4) AS high, coalesce(n, 0) AS n FROM range(10) r(b) CROSS JOIN s LEFT JOIN c ON c.bin = b"""


def scott_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Bins of Scott's width, and the second most frequent of them first."""
    events = table(spark, folder, "events")
    width = M.scott_width(events, "value").first()["width"]
    h = M.histogram(events, "value", 1, width).select("bin", F.round("low", 4).alias("low"), "n")
    return top(h, 5, F.desc("n"), "bin")


SCOTT_SQL = """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, floor(3.5 * stddev_pop(value) * pow(count(value), -1.0::DOUBLE / 3) * 1000 + 1e-9) / 1000 AS w FROM events),
k AS (SELECT *, greatest(1, ceil((hi - lo) / w))::INT AS k FROM s), c AS (SELECT least(floor((value - lo) / w)::INT, k - 1) AS bin, count(*) AS n FROM events, k WHERE value IS NOT NULL GROUP BY 1)
SELECT bin, round(lo + bin * w, 4) AS low, n FROM c, k ORDER BY n DESC, bin LIMIT 5"""


def ratios(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    p = M.percentiles(li, COLUMNS).groupBy("column").pivot("pct", [10, 50, 90]).agg(F.first("value"))
    both = M.moments(li, COLUMNS).select("column", "low", "high").join(p, "column")
    return both.select("column", F.round(F.try_divide("high", "low"), 6).alias("max_over_min"), F.round(F.col("high") - F.col("low"), 6).alias("spread"), F.round(F.col("90") - F.col("50"), 6).alias("p90_p50"), F.round(F.col("90") - F.col("10"), 6).alias("p90_p10"))


RATIOS_SQL = f"SELECT \"column\", round(max(value) / nullif(min(value), 0), 6) AS max_over_min, round(max(value) - min(value), 6) AS spread, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.5), 6) AS p90_p50, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 6) AS p90_p10 FROM ({MELT}) GROUP BY 1"


def missing_rows(spark: SparkSession, folder: str) -> DataFrame:
    return M.missing(table(spark, folder, "evidence_rows"), ["ev_key", "ev_value", "project", "sheet", "cell", "paragraph"])


MISSING_SQL = """
WITH n AS (SELECT (ev_key IS NULL)::INT + (ev_value IS NULL)::INT + (project IS NULL)::INT + (sheet IS NULL)::INT + (cell IS NULL)::INT + (paragraph IS NULL)::INT AS k FROM evidence_rows)
SELECT count(*) AS rows, count(*) FILTER (k > 0) AS rows_with_null, count(*) FILTER (k = 0) AS complete_rows, sum(k)::BIGINT AS null_cells FROM n"""


def missing_by_project(spark: SparkSession, folder: str) -> DataFrame:
    """The project with most rows that miss a cell or a key; nothing on a tie."""
    e = table(spark, folder, "evidence_rows").filter("project IS NOT NULL")
    per = e.groupBy("project").agg(F.count_if(F.col("ev_key").isNull() | F.col("cell").isNull()).alias("missing_rows"))
    best = per.agg(F.max_by("project", "missing_rows").alias("project"), F.max("missing_rows").alias("missing_rows"), F.count("*").alias("entities"))
    ties = per.join(F.broadcast(best.select("missing_rows")), "missing_rows", "left_semi").agg(F.count("*").alias("ties"))  # one row each
    return best.crossJoin(ties).filter("ties = 1 AND entities >= 2").select("project", "missing_rows")


MISSING_BY = "WITH p AS (SELECT project, count(*) FILTER (ev_key IS NULL OR cell IS NULL) AS missing_rows FROM evidence_rows WHERE project IS NOT NULL GROUP BY 1) SELECT * FROM p WHERE missing_rows = (SELECT max(missing_rows) FROM p) AND (SELECT count(*) FROM p WHERE missing_rows = (SELECT max(missing_rows) FROM p)) = 1"


def linear_model(spark: SparkSession, folder: str) -> DataFrame:
    """Price by quantity: fitted from sums, and the mean error of its predictions."""
    li = table(spark, folder, "lineitem")
    fit = M.least_squares(li, "l_extendedprice", ["l_quantity"])
    if fit is None:
        return spark.createDataFrame([], "intercept double, slope double, r2 double")
    predicted = F.lit(fit["intercept"]) + F.lit(fit["l_quantity"]) * F.col("l_quantity")
    stats = li.agg(F.sum(F.pow(F.col("l_extendedprice") - predicted, F.lit(2))).alias("rss"), (F.var_pop("l_extendedprice") * F.count("l_extendedprice")).alias("tss"))
    return stats.select(F.lit(round(fit["intercept"], 3)).alias("intercept"), F.lit(round(fit["l_quantity"], 3)).alias("slope"), F.round(1 - F.col("rss") / F.col("tss"), 6).alias("r2"))


LINEAR_SQL = "SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem"


def best_f1(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").select(F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return M.f1_sweep(li, "score", "y")


F1_SQL = """
WITH g AS (SELECT l_quantity AS t, sum((l_returnflag = 'R')::INT) AS p, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT sum(p) AS all_p FROM g),
s AS (SELECT t, sum(p) OVER w AS tp, sum(n) OVER w AS taken FROM g WINDOW w AS (ORDER BY t DESC))
SELECT t AS threshold, tp::BIGINT AS tp, (taken - tp)::BIGINT AS fp, (all_p - tp)::BIGINT AS fn, round(2.0::DOUBLE * tp / (taken + all_p), 8) AS f1 FROM s, a ORDER BY f1 DESC, threshold LIMIT 1"""


def rank_correlation(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderpriority", "o_totalprice", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("d"))
    return M.spearman(o, ["o_orderpriority"], "o_totalprice", "d").select("o_orderpriority", *r6("rho"))


SPEARMAN_SQL = """
WITH r AS (SELECT o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_orderpriority, o_orderdate) - 1) / 2.0 AS ry FROM orders)
SELECT o_orderpriority, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1"""


def nearest_to_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Of each segment, all customers whose balance is nearest to the segment's mean."""
    c = table(spark, folder, "customer")
    means = c.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 6).alias("mean"))
    gap = c.join(F.broadcast(means), "c_mktsegment").withColumn("gap", F.round(F.abs(F.col("c_acctbal") - F.col("mean")), 4))
    least = gap.groupBy("c_mktsegment").agg(F.min("gap").alias("gap"))  # one row for each segment
    return gap.join(F.broadcast(least), ["c_mktsegment", "gap"]).select("c_mktsegment", "c_custkey", "gap")


NEAREST_SQL = "WITH m AS (SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1), g AS (SELECT c_mktsegment, c_custkey, round(abs(c_acctbal - mean), 4) AS gap FROM customer JOIN m USING (c_mktsegment)) SELECT * FROM g QUALIFY gap = min(gap) OVER (PARTITION BY c_mktsegment)"


def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence types with their shares, most frequent first."""
    c = table(spark, folder, "evidence_rows").groupBy("ev_type").agg(F.count("*").alias("n"))
    return c.select("ev_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"))  # a few types


VALUE_SQL = "SELECT ev_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM evidence_rows GROUP BY 1"


def monthly_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Sums by month with the number of contributing customers; the three largest months."""
    o = table(spark, folder, "orders").withColumn("y", F.year("o_orderdate")).withColumn("m", F.month("o_orderdate"))
    s = o.groupBy("y", "m").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count_distinct("o_custkey").alias("customers"))
    return top(s, 3, F.desc("total"), "y", "m")


MONTHLY_SQL = "SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 3"


def rank_pair_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Of each segment's balances, the second largest over the third smallest, half up to two places."""
    c = table(spark, folder, "customer").select("c_mktsegment", F.col("c_acctbal").alias("v"), "c_custkey")
    w = Window.partitionBy("c_mktsegment")
    # rank limits that Spark applies in each task before it shuffles
    low = c.withColumn("up", F.row_number().over(w.orderBy("v", "c_custkey"))).filter("up <= 3").filter("up = 3").select("c_mktsegment", F.col("v").alias("b"))
    high = c.withColumn("down", F.row_number().over(w.orderBy(F.desc("v"), "c_custkey"))).filter("down <= 2").filter("down = 2").select("c_mktsegment", F.col("v").alias("a"))
    picked = c.select("c_mktsegment").distinct().join(high, "c_mktsegment", "left").join(low, "c_mktsegment", "left")
    return picked.select("c_mktsegment", half_up(F.try_divide("a", "b"), 2).cast("double").alias("ratio"))


RANK_PAIR_SQL = """
WITH r AS (SELECT c_mktsegment, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS up, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS down FROM customer)
SELECT c_mktsegment, round((max(v) FILTER (down = 2) / nullif(max(v) FILTER (up = 3), 0))::DECIMAL(38,10), 2)::DOUBLE AS ratio FROM r GROUP BY 1"""


def growth(spark: SparkSession, folder: str) -> DataFrame:
    """First to last yearly total of each priority, as growth rate."""
    o = table(spark, folder, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    g = o.groupBy("o_orderpriority").agg(F.min_by("v", "y").alias("first"), F.max_by("v", "y").alias("last"))
    return g.select("o_orderpriority", F.round(F.try_divide(F.col("last") - F.col("first"), "first"), 6).alias("growth"))


GROWTH_SQL = "WITH s AS (SELECT o_orderpriority, year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY 1, 2) SELECT o_orderpriority, round((arg_max(v, y) - arg_min(v, y)) / nullif(arg_min(v, y), 0), 6) AS growth FROM s GROUP BY 1"


def pivot_leaf(spark: SparkSession, folder: str) -> DataFrame:
    """A pivot by flag and status with several aggregates; groups with a null key are dropped."""
    li = table(spark, folder, "lineitem").filter("l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL")
    p = li.groupBy("l_returnflag", "l_linestatus").agg(F.count("l_quantity").alias("n"), F.sum("l_quantity").alias("total"), F.round(F.avg("l_extendedprice"), 4).alias("average"), F.min("l_tax").alias("low"), F.max("l_tax").alias("high"))
    return p.withColumn("largest", F.col("average") == F.max("average").over(Window.partitionBy(F.lit(1))))  # a few leaves


PIVOT_SQL = "WITH p AS (SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, sum(l_quantity) AS total, round(avg(l_extendedprice), 4) AS average, min(l_tax) AS low, max(l_tax) AS high FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2) SELECT *, average = max(average) OVER () AS largest FROM p"


def pivot_source(spark: SparkSession, folder: str) -> DataFrame:
    """Which pair of dimensions and which aggregate reproduce a displayed pivot of orders: candidates by largest error."""
    o = table(spark, folder, "orders").withColumn("y", F.year("o_orderdate").cast("string"))
    dims = [("o_orderstatus", "y"), ("o_orderpriority", "y"), ("o_orderpriority", "o_orderstatus")]
    cells = F.explode(F.array(*[F.struct(F.lit(f"{a}*{b}").alias("dims"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in dims])).alias("d")
    grid = o.select("o_totalprice", cells).groupBy("d.dims", "d.a", "d.b").agg(F.round(F.avg("o_totalprice"), 2).alias("avg"), F.max("o_totalprice").alias("max"), F.count("*").cast("double").alias("count"))
    shown = o.groupBy("o_orderstatus", "y").agg(F.round(F.avg("o_totalprice"), 0).alias("shown"))  # as displayed: without decimals
    compared = grid.join(F.broadcast(shown), (grid.a == shown.o_orderstatus) & (grid.b == shown.y), "left")
    long = compared.select("dims", "shown", F.explode(F.array(*[F.struct(F.lit(c).alias("agg"), F.col(c).alias("v")) for c in ("avg", "max", "count")])).alias("x"))
    worst = long.groupBy("dims", "x.agg").agg(F.max(F.when(F.col("shown").isNull(), F.lit(1e18)).otherwise(F.abs(F.col("x.v") - F.col("shown")))).alias("worst"))
    return worst.select("dims", "agg", (F.col("worst") <= 0.51).alias("reproduces"))


PIVOT_SOURCE_SQL = """
WITH o AS (SELECT *, year(o_orderdate)::VARCHAR AS y FROM orders), g AS (
 SELECT 'o_orderstatus*y' AS dims, o_orderstatus AS a, y AS b, o_totalprice AS p FROM o UNION ALL SELECT 'o_orderpriority*y', o_orderpriority, y, o_totalprice FROM o UNION ALL SELECT 'o_orderpriority*o_orderstatus', o_orderpriority, o_orderstatus, o_totalprice FROM o),
c AS (SELECT dims, a, b, round(avg(p), 2) AS avg, max(p) AS max, count(*)::DOUBLE AS count FROM g GROUP BY 1, 2, 3), s AS (SELECT o_orderstatus, y, round(avg(o_totalprice), 0) AS shown FROM o GROUP BY 1, 2),
l AS (UNPIVOT (SELECT dims, shown, avg, max, count FROM c LEFT JOIN s ON a = o_orderstatus AND b = y) ON avg, max, count INTO NAME agg VALUE v)
SELECT dims, agg, max(CASE WHEN shown IS NULL THEN 1e18 ELSE abs(v - shown) END) <= 0.51 AS reproduces FROM l GROUP BY 1, 2"""


def event_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of each user's values with a gap of more than 5."""
    c = L.gap_clusters(table(spark, folder, "events").filter("value IS NOT NULL"), ["user_id"], "value", "event_id", 5.0)
    return c.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


CLUSTER_SQL = """
WITH g AS (SELECT user_id, value, event_id, (value - lag(value) OVER w > 5)::INT AS step FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)),
c AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY user_id ORDER BY value, event_id) AS cluster FROM g)
SELECT user_id, cluster, count(*) AS n, min(value) AS low, max(value) AS high FROM c GROUP BY 1, 2"""


def low_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    """Text columns with at most 20 different values."""
    e = table(spark, folder, "evidence_rows")
    names = ["ev_type", "ev_key", "project", "sheet"]
    counts = e.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in names])).alias("p")).groupBy("p.column").agg(F.count_distinct("p.v").alias("n"))
    return counts.filter("n <= 20")


LOW_SQL = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n FROM evidence_rows" for c in ["ev_type", "ev_key", "project", "sheet"]) + ") WHERE n <= 20"


def numeric_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence keys whose values are numbers throughout, with their mean; other keys stay text."""
    e = table(spark, folder, "evidence_rows").filter("ev_key IS NOT NULL AND trim(ev_value) <> ''").withColumn("v", parse_numeric("ev_value"))
    k = e.groupBy("ev_key").agg(F.count("*").alias("n"), F.count("v").alias("numeric"), F.avg("v").alias("mean"))
    return k.select("ev_key", "n", (F.col("n") == F.col("numeric")).alias("is_numeric"), F.when(F.col("n") == F.col("numeric"), F.round("mean", 6)).alias("mean"))


NUMERIC_SQL = r"""
WITH e AS (SELECT ev_key, CASE WHEN regexp_matches(trim(ev_value), '^[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]+)?[%％]?$') THEN try_cast(regexp_replace(trim(ev_value), '[,%％]', '', 'g') AS DOUBLE) END AS v FROM evidence_rows WHERE ev_key IS NOT NULL AND trim(ev_value) <> '')
SELECT ev_key, count(*) AS n, count(*) = count(v) AS is_numeric, CASE WHEN count(*) = count(v) THEN round(avg(v), 6) END AS mean FROM e GROUP BY 1"""

QUERIES = {
    "stats_columns": column_stats, "stats_dual_check": dual_check, "stats_percentiles": column_percentiles, "stats_correlations": column_correlations, "stats_top_feature": top_feature,
    "stats_histogram": histogram10, "stats_scott_histogram": scott_histogram, "stats_ratios": ratios, "stats_missing": missing_rows, "stats_missing_argmax": missing_by_project, "stats_linear_model": linear_model,
    "stats_f1_sweep": best_f1, "stats_spearman": rank_correlation, "stats_nearest_to_mean": nearest_to_mean, "stats_value_counts": value_counts, "stats_monthly_totals": monthly_totals,
    "stats_rank_pair_ratio": rank_pair_ratio, "stats_growth": growth, "stats_pivot_leaf": pivot_leaf, "stats_pivot_source": pivot_source, "stats_gap_clusters": event_clusters,
    "stats_low_cardinality": low_cardinality, "stats_numeric_columns": numeric_columns,
}
ORACLE = {
    "stats_columns": COLUMN_STATS, "stats_dual_check": DUAL_SQL, "stats_percentiles": PERCENTILES, "stats_correlations": CORR_SQL, "stats_top_feature": TOP_FEATURE, "stats_histogram": HIST_SQL,
    "stats_scott_histogram": SCOTT_SQL, "stats_ratios": RATIOS_SQL, "stats_missing": MISSING_SQL, "stats_missing_argmax": MISSING_BY, "stats_linear_model": LINEAR_SQL, "stats_f1_sweep": F1_SQL,
    "stats_spearman": SPEARMAN_SQL, "stats_nearest_to_mean": NEAREST_SQL, "stats_value_counts": VALUE_SQL, "stats_monthly_totals": MONTHLY_SQL, "stats_rank_pair_ratio": RANK_PAIR_SQL,
    "stats_growth": GROWTH_SQL, "stats_pivot_leaf": PIVOT_SQL, "stats_pivot_source": PIVOT_SOURCE_SQL, "stats_gap_clusters": CLUSTER_SQL, "stats_low_cardinality": LOW_SQL, "stats_numeric_columns": NUMERIC_SQL,
}
