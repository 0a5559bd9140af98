"""Queries over answers, numbers and rates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftdocs.functions import forms as N
from weftdocs.functions import values as V
from weftdocs.plans.forms import ITEMS
from weftdocs.plans.search import LINES, doc_lines
from weftdocs.session import table

SPACED = ITEMS.replace("trim(x)", "regexp_replace(x, '^ +| +$', '', 'g')")
NUMS = "list_transform(regexp_extract_all({c}, '[0-9]+(?:,[0-9]{{3}})*(?:\\.[0-9]+)?'), lambda x: replace(x, ',', ''))"


def reviewed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "gold_100_review").filter("system_answer IS NOT NULL AND gold_v3 IS NOT NULL")


def number_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Answers with one number against those expected, by archetype."""
    v = reviewed(spark, folder).select("archetype", V.number_verdict("system_answer", "gold_v3").alias("verdict"), V.same_numbers("system_answer", "gold_v3").alias("same"))
    return v.groupBy("archetype", "verdict").agg(F.count("*").alias("n"), F.count_if("same").alias("same_numbers"))


NUMBER_CTE = f"""g AS (SELECT *, {NUMS.format(c='system_answer')} AS a, {NUMS.format(c='gold_v3')} AS b FROM gold_100_review WHERE system_answer IS NOT NULL AND gold_v3 IS NOT NULL),
n AS (SELECT *, CASE WHEN len(a) = 1 THEN a[1] END AS x, CASE WHEN len(b) = 1 THEN b[1] END AS y FROM g), d AS (SELECT *, length(regexp_extract(x, '\\.([0-9]+)$', 1)) AS dx, length(regexp_extract(y, '\\.([0-9]+)$', 1)) AS dy FROM n),
v AS (SELECT *, CASE WHEN x IS NULL OR y IS NULL THEN 'no' WHEN x::DECIMAL(30,10) = y::DECIMAL(30,10) THEN 'exact'
  WHEN dx <> dy AND floor(x::DECIMAL(30,10) * pow(10, least(dx, dy))::DECIMAL(6,0) + 0.5) = floor(y::DECIMAL(30,10) * pow(10, least(dx, dy))::DECIMAL(6,0) + 0.5) THEN 'rounded' ELSE 'no' END AS verdict FROM d)"""
NUMBER_SQL = f"WITH {NUMBER_CTE} SELECT archetype, verdict, count(*) AS n, count(*) FILTER (list_sort(a) = list_sort(b)) AS same_numbers FROM v GROUP BY 1, 2"


def answer_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """How answers agree with those expected, by status."""
    return reviewed(spark, folder).select("status", V.answer_verdict("system_answer", "gold_v3").alias("verdict")).groupBy("status", "verdict").agg(F.count("*").alias("n"))


NORMAL = "regexp_replace(lower(regexp_replace({c}, '[\\s　,，\"''「」]+', '', 'g')), '(?:です|である)?[。.]*$', '')"
VERDICT_SQL = f"""
WITH {NUMBER_CTE}, t AS (SELECT status, verdict AS numeric_verdict, {NORMAL.format(c='system_answer')} AS s, {NORMAL.format(c='gold_v3')} AS w FROM v)
SELECT status, CASE WHEN s = w THEN 'same' WHEN numeric_verdict <> 'no' THEN 'number' WHEN s <> '' AND w <> '' AND (contains(s, w) OR contains(w, s)) THEN 'contains' ELSE 'different' END AS verdict, count(*) AS n FROM t GROUP BY 1, 2"""


def list_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Whether all items expected are named, containment allowed, by archetype."""
    v = reviewed(spark, folder).select("archetype", N.listed("system_answer").alias("a"), N.listed("gold_v3").alias("b")).filter("size(b) > 0")
    return v.groupBy("archetype").agg(F.count("*").alias("n"), F.count_if(V.set_contained(F.col("a"), F.col("b"))).alias("held"))


LIST_SQL = f"""
WITH v AS (SELECT archetype, {SPACED.format(c='system_answer')} AS a, {SPACED.format(c='gold_v3')} AS b FROM gold_100_review WHERE system_answer IS NOT NULL AND gold_v3 IS NOT NULL)
SELECT archetype, count(*) AS n, count(*) FILTER (len(list_filter(b, lambda w: len(list_filter(a, lambda f: contains(f, w) OR contains(w, f))) = 0)) = 0) AS held FROM v WHERE len(b) > 0 GROUP BY 1"""


def line_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts and rates of answers as low and high ends, summed by archetype: lows with lows, highs with highs."""
    r = table(spark, folder, "gold_100_review").select("archetype", V.rate("gold_v3").alias("r")).filter("r IS NOT NULL")
    return r.groupBy("archetype").agg(F.count("*").alias("n"), F.round(F.sum(F.col("r.low").cast("decimal(30,6)")), 4).cast("double").alias("low"), F.round(F.sum(F.col("r.high").cast("decimal(30,6)")), 4).cast("double").alias("high"), F.max("r.mid").alias("largest_mid"))


RATE_SQL = f"""
WITH g AS (SELECT archetype, list_transform({NUMS.format(c='gold_v3')}, lambda x: x::DOUBLE) AS n FROM gold_100_review), r AS (SELECT archetype, least(n[1], n[-1]) AS low, greatest(n[1], n[-1]) AS high FROM g WHERE len(n) BETWEEN 1 AND 2)
SELECT archetype, count(*) AS n, round(sum(low::DECIMAL(30,6)), 4)::DOUBLE AS low, round(sum(high::DECIMAL(30,6)), 4)::DOUBLE AS high, max((low + high) / 2) AS largest_mid FROM r GROUP BY 1"""


def metric_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics named with a value in texts: how often, and the first and last value of each document."""
    word = "再現率|適合率|歩留まり|到着遅延|解約率|欠損率|在庫回転率|平均絶対誤差|単価差異|応答時間"
    m = doc_lines(spark, folder).select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(f"(?:{word})は[0-9]+(?:\\.[0-9]+)?[%％]"), F.lit(0))).alias("k", "m"))
    v = m.select("doc_id", F.regexp_extract("m", f"({word})", 1).alias("metric"), F.regexp_extract("m", r"([0-9]+(?:\.[0-9]+)?)", 1).cast("double").alias("v"), F.struct("line_no", "k").alias("at"))
    return v.groupBy("doc_id", "metric").agg(F.count("*").alias("n"), F.min_by("v", "at").alias("first"), F.max_by("v", "at").alias("last"), F.round(F.abs(F.max_by("v", "at") - F.min_by("v", "at")), 6).alias("difference"))


METRIC_WORDS = "再現率|適合率|歩留まり|到着遅延|解約率|欠損率|在庫回転率|平均絶対誤差|単価差異|応答時間"
METRIC_SQL = f"""
WITH {LINES}, l AS (SELECT doc_id, line_no, regexp_extract_all(line, '(?:{METRIC_WORDS})は[0-9]+(?:\\.[0-9]+)?[%％]') AS ms FROM lines), m AS (SELECT doc_id, line_no, k, ms[k] AS m FROM l, LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS k)),
v AS (SELECT doc_id, regexp_extract(m, '({METRIC_WORDS})', 1) AS metric, regexp_extract(m, '([0-9]+(?:\\.[0-9]+)?)', 1)::DOUBLE AS v, line_no * 100000 + k AS place FROM m)
SELECT doc_id, metric, count(*) AS n, arg_min(v, place) AS first, arg_max(v, place) AS last, round(abs(arg_max(v, place) - arg_min(v, place)), 6) AS difference FROM v GROUP BY 1, 2"""


def bare_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as written, without closing brackets, and in normal form: how many different ones, by archetype."""
    g = table(spark, folder, "gold_100_review").filter("gold_v3 IS NOT NULL").select("archetype", "gold_v3", V.without_bracket("gold_v3").alias("b"), V.normal_answer("gold_v3").alias("n"))
    return g.groupBy("archetype").agg(F.count_distinct("gold_v3").alias("written"), F.count_distinct("b").alias("bare"), F.count_distinct("n").alias("normal"), F.count_if(F.col("b") != F.col("gold_v3")).alias("changed"))


CORE = "regexp_replace(regexp_replace({c}, '[（(\\[][^（）()\\[\\]]*[）)\\]] *$', ''), '^ +| +$', '', 'g')"  # DuckDB's trim takes more than spaces away
BARE_SQL = f"""
WITH g AS (SELECT archetype, gold_v3, {CORE.format(c='gold_v3')} AS c, {NORMAL.format(c='gold_v3')} AS n FROM gold_100_review WHERE gold_v3 IS NOT NULL),
b AS (SELECT *, CASE WHEN list_sort({NUMS.format(c='c')}) = list_sort({NUMS.format(c='gold_v3')}) THEN c ELSE gold_v3 END AS b FROM g)
SELECT archetype, count(DISTINCT gold_v3) AS written, count(DISTINCT b) AS bare, count(DISTINCT n) AS normal, count(*) FILTER (b <> gold_v3) AS changed FROM b GROUP BY 1"""


def wordings(spark: SparkSession, folder: str) -> DataFrame:
    """Paraphrases of the questions, and conditions they state, by archetype."""
    q = table(spark, folder, "gold_100_review").filter("question IS NOT NULL").select("archetype", F.size(V.paraphrases("question")).alias("k"), V.condition_of("question").alias("c"))
    return q.groupBy("archetype").agg(F.sum("k").alias("variants"), F.count_if(F.col("k") == 0).alias("without"), F.count("c").alias("conditional"))


WORDING_SQL = r"""
WITH q AS (SELECT archetype, question, list_distinct([regexp_replace(question, 'を?教えてください。?$', 'は何ですか。'), regexp_replace(question, 'は何ですか。?$', 'を教えてください。'), regexp_replace(question, 'を?答えてください。?$', 'を示してください。'), regexp_replace(question, '^What is ', 'Tell me '), regexp_replace(question, '\?$', '.')]) AS v,
  regexp_matches(question, 'もし(.{1,80}?)(?:たら|なら|れば)') OR regexp_matches(question, '([^。、]{1,80})場合') OR regexp_matches(question, '(?i)\bif ([^,?]{1,80})') AS c FROM gold_100_review WHERE question IS NOT NULL),
k AS (SELECT archetype, c, len(list_filter(v, lambda x: x <> question)) AS k FROM q) SELECT archetype, sum(k)::BIGINT AS variants, count(*) FILTER (k = 0) AS without, count(*) FILTER (c) AS conditional FROM k GROUP BY 1"""


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence by kind of status word and by hours written."""
    e = table(spark, folder, "evidence_rows").dropDuplicates(["ev_id"]).select("ev_type", V.status_kind("ev_value").alias("status"), V.hours("ev_value").alias("h"), V.header_core("ev_value").alias("core"))
    return e.groupBy("ev_type", "status").agg(F.count("*").alias("n"), F.count("h").alias("hours"), F.count_distinct("core").alias("cores"))


STATUS_SQL = f"""
WITH e AS (SELECT DISTINCT ON (ev_id) * FROM evidence_rows), s AS (SELECT ev_type, {CORE.format(c='ev_value')} AS core, try_cast(regexp_extract(trim(ev_value), '(?i)^([0-9]+(?:\\.[0-9]+)?) ?(?:h|hours?|時間)?$', 1) AS DOUBLE) AS h,
  CASE WHEN regexp_matches(lower(ev_value), '未完了|未着手|対応中|進行中|移行|open|pending') THEN 'open' WHEN regexp_matches(lower(ev_value), '完了|済|確認|done|closed|review') THEN 'done' ELSE 'unknown' END AS status FROM e)
SELECT ev_type, status, count(*) AS n, count(h) AS hours, count(DISTINCT core) AS cores FROM s GROUP BY 1, 2"""


def stage_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Share of matches in the first and in the last run of each archetype, and their difference."""
    g = table(spark, folder, "gold_100_review").filter("archetype IS NOT NULL AND status IS NOT NULL AND run_no IS NOT NULL")
    per = g.groupBy("archetype", "run_no").agg(F.avg((F.col("status") == "MATCH").cast("double")).alias("share"))
    ends = per.groupBy("archetype").agg(F.min_by("share", "run_no").alias("interim"), F.max_by("share", "run_no").alias("final"))
    return ends.select("archetype", F.round("interim", 9).alias("interim"), F.round("final", 9).alias("final"), F.round(F.abs(F.col("final") - F.col("interim")), 9).alias("difference"))


STAGE_SQL = """
WITH p AS (SELECT archetype, run_no, avg((status = 'MATCH')::INT::DOUBLE) AS share FROM gold_100_review WHERE archetype IS NOT NULL AND status IS NOT NULL AND run_no IS NOT NULL GROUP BY 1, 2), e AS (SELECT archetype, arg_min(share, run_no) AS i, arg_max(share, run_no) AS f FROM p GROUP BY 1)
SELECT archetype, round(i, 9) AS interim, round(f, 9) AS final, round(abs(f - i), 9) AS difference FROM e"""


def shared_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Runs in pairs that follow each other: how many questions they share; a held-out run shares none."""
    q = table(spark, folder, "gold_100_review").filter("question IS NOT NULL AND run_no IS NOT NULL").select("run_no", F.md5("question").alias("h")).distinct()
    runs = q.select("run_no").distinct()
    pairs = runs.withColumn("next_run", F.lead("run_no").over(Window.partitionBy(F.lit(1)).orderBy("run_no"))).filter("next_run IS NOT NULL")  # one row for each run
    both = pairs.join(q, "run_no").join(q.select(F.col("run_no").alias("next_run"), "h"), ["next_run", "h"]).groupBy("run_no", "next_run").agg(F.count("*").alias("shared"))
    return pairs.join(both, ["run_no", "next_run"], "left").select("run_no", "next_run", F.coalesce("shared", F.lit(0)).alias("shared"), F.col("shared").isNull().alias("isolated"))


SHARED_SQL = """
WITH q AS (SELECT DISTINCT run_no, question FROM gold_100_review WHERE question IS NOT NULL AND run_no IS NOT NULL), p AS (SELECT run_no, lead(run_no) OVER (ORDER BY run_no) AS next_run FROM (SELECT DISTINCT run_no FROM q)),
s AS (SELECT p.run_no, p.next_run, count(*) AS shared FROM p JOIN q a ON a.run_no = p.run_no JOIN q b ON b.run_no = p.next_run AND a.question = b.question GROUP BY 1, 2)
SELECT p.run_no, p.next_run, coalesce(shared, 0) AS shared, shared IS NULL AS isolated FROM p LEFT JOIN s USING (run_no, next_run) WHERE p.next_run IS NOT NULL"""


def left_out_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """Points that every threshold of confidence earns in its archetype when one record is left out: the least and the most over all records."""
    g = table(spark, folder, "gold_100_review").select("archetype", F.col("confidence").try_cast("double").alias("c"), F.expr("CASE status WHEN 'MATCH' THEN 1 WHEN 'WRONG' THEN -1 ELSE 0 END").alias("p")).filter("c IS NOT NULL AND archetype IS NOT NULL")
    # all records of one confidence and points behave alike, so they are counted first
    by = g.groupBy("archetype", "c").agg(F.sum("p").alias("p"), F.min("p").alias("low"), F.max("p").alias("high"), F.count("*").alias("n"))
    above = Window.partitionBy("archetype").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("archetype").orderBy(F.desc("c")).rowsBetween(1, Window.unboundedFollowing)
    swept = by.select("archetype", F.col("c").alias("threshold"), F.sum("p").over(above).alias("total"), F.max("high").over(above).alias("h"), F.min("low").over(above).alias("l"), F.coalesce(F.count("*").over(below), F.lit(0)).alias("others"))
    outside = F.when(F.col("others") > 0, F.lit(0))  # a record below the threshold takes nothing away
    return swept.select("archetype", "threshold", "total", (F.col("total") - F.greatest("h", outside)).alias("least"), (F.col("total") - F.least("l", outside)).alias("most"))


LEFT_OUT_SQL = """
WITH g AS (SELECT review_id, archetype, try_cast(confidence AS DOUBLE) AS c, CASE status WHEN 'MATCH' THEN 1 WHEN 'WRONG' THEN -1 ELSE 0 END AS p FROM gold_100_review WHERE archetype IS NOT NULL), r AS (SELECT * FROM g WHERE c IS NOT NULL),
t AS (SELECT DISTINCT archetype, c AS threshold FROM r), s AS (SELECT t.archetype, t.threshold, sum(p) FILTER (c >= threshold) AS total FROM t JOIN r USING (archetype) GROUP BY 1, 2),
o AS (SELECT s.*, total - CASE WHEN r.c >= threshold THEN r.p ELSE 0 END AS v FROM s JOIN r USING (archetype)) SELECT archetype, threshold, any_value(total)::BIGINT AS total, min(v)::BIGINT AS least, max(v)::BIGINT AS most FROM o GROUP BY 1, 2"""


def best_two(spark: SparkSession, folder: str) -> DataFrame:
    """Of each archetype, the two records of highest confidence and the fields in which they differ."""
    fields = ["state_code", "difficulty", "status", "reason"]
    g = table(spark, folder, "gold_100_review").withColumn("c", F.col("confidence").try_cast("double")).filter("c IS NOT NULL AND archetype IS NOT NULL")
    r = g.withColumn("k", F.row_number().over(Window.partitionBy("archetype").orderBy(F.desc("c"), "review_id"))).filter("k <= 2")
    pick = lambda f, k: F.max(F.when(F.col("k") == k, F.col(f)))
    two = r.groupBy("archetype").agg(F.count("*").alias("n"), *[pick(f, k).alias(f"{f}_{k}") for f in fields for k in (1, 2)]).filter("n = 2")
    turned = two.select("archetype", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_1").alias("first"), F.col(f"{f}_2").alias("second")) for f in fields])).alias("d")).select("archetype", "d.*")
    return turned.filter(~F.col("first").eqNullSafe(F.col("second")))


BEST_TWO_SQL = """
WITH g AS (SELECT *, try_cast(confidence AS DOUBLE) AS c FROM gold_100_review WHERE archetype IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY archetype ORDER BY c DESC, review_id) AS k FROM g WHERE c IS NOT NULL),
t AS (SELECT a.archetype, unnest([{'f': 'state_code', 'a': a.state_code, 'b': b.state_code}, {'f': 'difficulty', 'a': a.difficulty, 'b': b.difficulty}, {'f': 'status', 'a': a.status, 'b': b.status}, {'f': 'reason', 'a': a.reason, 'b': b.reason}]) AS d FROM r a JOIN r b ON a.archetype = b.archetype AND a.k = 1 AND b.k = 2)
SELECT archetype, d.f AS field, d.a AS first, d.b AS second FROM t WHERE d.a IS DISTINCT FROM d.b"""


def distilled(spark: SparkSession, folder: str) -> DataFrame:
    """Questions without file names and set phrases; never empty, identifiers stay."""
    q = table(spark, folder, "gold_100_review").filter("question IS NOT NULL").select("review_id", "question")
    short = F.regexp_replace("question", r"[^\s　のでが]*_?[0-9]{9}\.[A-Za-z]{2,5}|\(file [^)]*\)", " ")
    short = F.regexp_replace(short, "を?(?:教えて|答えて)ください。?|は(?:何|いくら|いくつ)ですか。?|^(?:What|Which|According to|Who|When) |英語で", " ")
    short = F.trim(F.regexp_replace(short, " +", " "))
    return q.select("review_id", F.coalesce(F.nullif(short, F.lit("")), "question").alias("query"))


DISTILLED_SQL = r"""
WITH q AS (SELECT review_id, question, trim(regexp_replace(regexp_replace(regexp_replace(question, '[^\s　のでが]*_?[0-9]{9}\.[A-Za-z]{2,5}|\(file [^)]*\)', ' ', 'g'), 'を?(?:教えて|答えて)ください。?|は(?:何|いくら|いくつ)ですか。?|^(?:What|Which|According to|Who|When) |英語で', ' ', 'g'), ' +', ' ', 'g')) AS s FROM gold_100_review WHERE question IS NOT NULL)
SELECT review_id, coalesce(nullif(s, ''), question) AS query FROM q"""

QUERIES = {
    "score_numbers": number_scores, "score_answer_verdicts": answer_verdicts, "score_lists": list_scores, "forms_rates": line_rates, "lines_metric_mentions": metric_mentions, "forms_bare_answers": bare_answers,
    "forms_wordings": wordings, "evidence_statuses": statuses, "score_stage_differences": stage_differences, "score_shared_questions": shared_questions, "score_left_out_thresholds": left_out_thresholds,
    "score_best_two": best_two, "search_distilled": distilled,
}
ORACLE = {
    "score_numbers": NUMBER_SQL, "score_answer_verdicts": VERDICT_SQL, "score_lists": LIST_SQL, "forms_rates": RATE_SQL, "lines_metric_mentions": METRIC_SQL, "forms_bare_answers": BARE_SQL,
    "forms_wordings": WORDING_SQL, "evidence_statuses": STATUS_SQL, "score_stage_differences": STAGE_SQL, "score_shared_questions": SHARED_SQL, "score_left_out_thresholds": LEFT_OUT_SQL,
    "score_best_two": BEST_TWO_SQL, "search_distilled": DISTILLED_SQL,
}
