"""Queries that put several lists, flags or defaults together, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftdocs.functions import values as V
from weftdocs.functions.text import round_up_to
from weftdocs.operators import joins as J
from weftdocs.operators import search as S
from weftdocs.operators import stats as M
from weftdocs.plans.answers import NORMAL
from weftdocs.plans.search import ASKED, BM25_ALL, LINES, QUERY, TOK, composed_chunks, doc_lines
from weftdocs.session import table


def id_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers by the strongest kind of place they stand in: a heading, behind a label, at the start of a line, or elsewhere."""
    line = F.col("line")
    rows = doc_lines(spark, folder).filter(line.rlike("T[0-9]{2}"))
    head = line.rlike("^#+ ")
    hits = rows.select("doc_id", "line", head.alias("head"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("T[0-9]{2}"), F.lit(0)))).alias("id"))
    kind = F.when(F.col("head"), 3).when(F.col("line").rlike("(?:ID|No|task|タスク)[.: ]*T[0-9]{2}"), 2).when(F.expr("startswith(line, id)"), 1).otherwise(0)
    best = hits.withColumn("k", kind).groupBy("doc_id", "id").agg(F.max("k").alias("k"))
    return best.groupBy("id", F.element_at(F.array(*[F.lit(x) for x in ("elsewhere", "prefix", "label", "header")]), F.col("k") + 1).alias("kind")).agg(F.count("*").alias("docs"))


ID_KINDS = f"""
WITH {LINES}, h AS (SELECT doc_id, line, unnest(list_distinct(regexp_extract_all(line, 'T[0-9]{{2}}'))) AS id FROM lines),
k AS (SELECT doc_id, id, max(CASE WHEN regexp_matches(line, '^#+ ') THEN 3 WHEN regexp_matches(line, '(?:ID|No|task|タスク)[.: ]*T[0-9]{{2}}') THEN 2 WHEN starts_with(line, id) THEN 1 ELSE 0 END) AS k FROM h GROUP BY 1, 2)
SELECT id, ['elsewhere', 'prefix', 'label', 'header'][k + 1] AS kind, count(*) AS docs FROM k GROUP BY 1, 2"""


def asked_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers of each question, separators aside, each once and five at most, in order."""
    p = "[A-Za-z]{1,4}[-_]?[0-9]{1,9}"
    q = table(spark, folder, "gold_100_review").filter("question IS NOT NULL").select("review_id", F.posexplode(F.regexp_extract_all("question", F.lit(p), F.lit(0))).alias("at", "raw"))
    ids = q.groupBy("review_id", F.upper(F.regexp_replace("raw", "[-_]", "")).alias("id")).agg(F.min("at").alias("at"))
    return ids.withColumn("place", F.row_number().over(Window.partitionBy("review_id").orderBy("at"))).filter("place <= 5").select("review_id", "place", "id")


ASKED_IDS = """
WITH q AS (SELECT review_id, regexp_extract_all(question, '[A-Za-z]{1,4}[-_]?[0-9]{1,9}') AS ids FROM gold_100_review WHERE question IS NOT NULL), e AS (SELECT review_id, k, upper(regexp_replace(ids[k], '[-_]', '', 'g')) AS id FROM q, LATERAL (SELECT unnest(range(1, len(ids) + 1)) AS k)), d AS (SELECT review_id, id, min(k) AS k FROM e GROUP BY 1, 2)
SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY k) AS place, id FROM d QUALIFY place <= 5"""


def fan_out(spark: SparkSession, folder: str) -> DataFrame:
    """The best ten places of five searches, side by side, and how much each of them found."""
    order = [F.desc("score"), "doc"]
    evidence = table(spark, folder, "evidence_rows").dropDuplicates(["ev_id"])
    value, key = F.coalesce("ev_value", F.lit("")), F.coalesce("ev_key", F.lit(""))
    lists = {
        "lines": S.idf_search(doc_lines(spark, folder), ["doc_id", "line_no"], "line", QUERY).groupBy(F.col("doc_id").cast("string").alias("doc")).agg(F.max("score").alias("score")),
        "chunks": S.bm25(composed_chunks(spark, folder), ["id"], "text", QUERY).select(F.col("id").cast("string").alias("doc"), "score"),
        "values": evidence.filter(value.contains("予測モデル")).groupBy(F.col("rel").alias("doc")).agg(F.count("*").cast("double").alias("score")),
        "keys": evidence.filter(key == "load_ratio").groupBy(F.col("rel").alias("doc")).agg(F.count("*").cast("double").alias("score")),
        "names": table(spark, folder, "extracted_docs").filter(F.lower("name").contains("audit")).select(F.col("rel").alias("doc"), F.lit(1.0).alias("score")).distinct(),
    }
    out = None
    for name, found in lists.items():
        best = S.ranked(S.top(found, 10, *order), order, 1).select(F.lit(name).alias("source"), "rank", "doc", "score")
        out = best if out is None else out.unionByName(best)
    return out


FAN_OUT = f"""
WITH {LINES}, asked AS (SELECT list_distinct({ASKED}) AS q), hits AS (SELECT doc_id, line_no, unnest(list_intersect(list_distinct({TOK.format(c='line')}), (SELECT q FROM asked))) AS token FROM lines),
w AS (SELECT token, ln(((SELECT count(*) FROM lines) + 1) / (count(*) + 1)) + 1 AS idf FROM hits GROUP BY token), ls AS (SELECT doc_id, line_no, round(sum(idf), 6) AS score FROM hits JOIN w USING (token) GROUP BY 1, 2), b AS ({BM25_ALL}), e AS (SELECT DISTINCT ON (ev_id) * FROM evidence_rows),
u AS (SELECT 'lines' AS source, doc_id::VARCHAR AS doc, max(score) AS score FROM ls GROUP BY 2 UNION ALL SELECT 'chunks', id::VARCHAR, score FROM b UNION ALL SELECT 'values', rel, count(*)::DOUBLE FROM e WHERE contains(ev_value, '予測モデル') GROUP BY 2 UNION ALL SELECT 'keys', rel, count(*)::DOUBLE FROM e WHERE ev_key = 'load_ratio' GROUP BY 2
  UNION ALL SELECT DISTINCT 'names', rel, 1.0::DOUBLE FROM extracted_docs WHERE contains(lower(name), 'audit'))
SELECT source, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc) AS rank, doc, score FROM u QUALIFY rank <= 10"""


def reranked(spark: SparkSession, folder: str) -> DataFrame:
    """The 4,000 best chunks by BM25, in the order of their summed rarities, ties by BM25; the first 20."""
    chunks = composed_chunks(spark, folder)
    pool = S.top(S.bm25(chunks, ["id"], "text", QUERY), 4000, F.desc("score"), "id").withColumnRenamed("score", "bm25")
    rare = S.idf_search(chunks, ["id"], "text", QUERY).select("id", F.col("score").alias("rarity"))
    return S.top(pool.join(rare, "id"), 20, F.desc("rarity"), F.desc("bm25"), "id")


RERANKED = f"""
WITH b AS ({BM25_ALL}), p AS (SELECT id, score AS bm25 FROM b ORDER BY score DESC, id LIMIT 4000), h AS (SELECT id, unnest(list_intersect(list_distinct({TOK.format(c='nfc_normalize(text)')}), list_distinct({ASKED}))) AS token FROM chunks),
w AS (SELECT token, ln(((SELECT count(*) FROM chunks) + 1) / (count(*) + 1)) + 1 AS idf FROM h GROUP BY 1), r AS (SELECT id, round(sum(idf), 6) AS rarity FROM h JOIN w USING (token) GROUP BY 1) SELECT id, bm25, rarity FROM p JOIN r USING (id) ORDER BY rarity DESC, bm25 DESC, id LIMIT 20"""

FLAGS = ["unmet_obligation", "state_code", "reason", "confidence"]


def fired_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Which fields were filled, against verdicts; zeros kept."""
    g = table(spark, folder, "gold_100_review")
    fired = g.select("status", F.explode(F.array_compact(F.array(*[F.when(F.trim(F.col(c)) != "", F.lit(c)) for c in FLAGS]))).alias("flag"))
    return J.crosstab(fired, "flag", "status", ["MATCH", "WRONG", "ABSTAIN"])


FIRED = "WITH f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS flag, status FROM gold_100_review WHERE regexp_replace({c}, '^ +| +$', '', 'g') <> ''" for c in FLAGS) + """)
SELECT flag, count(*) FILTER (status = 'MATCH') AS "MATCH", count(*) FILTER (status = 'WRONG') AS "WRONG", count(*) FILTER (status = 'ABSTAIN') AS "ABSTAIN" FROM f GROUP BY 1"""


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """By archetype, from a confidence of 0.7 on: share answered, precision of what was answered, null under ten, and how often status agrees with the comparison of the answers."""
    g = table(spark, folder, "gold_100_review").filter("archetype IS NOT NULL").select("archetype", "status", (F.col("confidence").try_cast("double") >= 0.7).alias("sure"), (V.answer_verdict("system_answer", "gold_v3").isin("same", "number")).alias("equal"))
    sure = F.coalesce("sure", F.lit(False))
    by = g.groupBy("archetype").agg(F.count("*").alias("n"), F.count_if(sure).alias("answered"), F.count_if(sure & (F.col("status") == "MATCH")).alias("right"), F.avg((F.col("equal") == (F.col("status") == "MATCH")).cast("double")).alias("agreement"))
    return by.select("archetype", "n", F.round(F.col("answered") / F.col("n"), 6).alias("coverage"), F.when(F.col("answered") >= 10, F.round(F.col("right") / F.col("answered"), 6)).alias("precision"), F.round("agreement", 6).alias("agreement"))


def committed_sql() -> str:
    from weftdocs.plans.answers import NUMBER_CTE

    cte = NUMBER_CTE.replace("WHERE system_answer IS NOT NULL AND gold_v3 IS NOT NULL", "")
    return f"""
WITH {cte}, t AS (SELECT archetype, status, coalesce(try_cast(confidence AS DOUBLE) >= 0.7, false) AS sure, CASE WHEN {NORMAL.format(c='system_answer')} = {NORMAL.format(c='gold_v3')} THEN true WHEN verdict <> 'no' THEN true ELSE false END AS equal FROM v WHERE archetype IS NOT NULL)
SELECT archetype, count(*) AS n, round(count(*) FILTER (sure) / count(*), 6) AS coverage, CASE WHEN count(*) FILTER (sure) >= 10 THEN round(count(*) FILTER (sure AND status = 'MATCH') / count(*) FILTER (sure), 6) END AS precision, round(avg((equal = (status = 'MATCH'))::INT), 6) AS agreement FROM t GROUP BY 1"""


def extremes(spark: SparkSession, folder: str) -> DataFrame:
    """Projects by their mean number of evidence rows a file, rounded up to tens: the eight first, ties by name."""
    e = table(spark, folder, "evidence_rows").filter("project IS NOT NULL").groupBy("project").agg(F.count("*").alias("rows"), F.count_distinct("rel").alias("files"))
    m = e.select("project", "rows", "files", F.round(F.col("rows") / F.col("files"), 6).alias("mean"), round_up_to("rows", 10.0).cast("long").alias("rounded"))
    return S.ranked(S.top(m, 8, F.desc("mean"), "project"), [F.desc("mean"), "project"], 1)


EXTREMES = "WITH e AS (SELECT project, count(*) AS rows, count(DISTINCT rel) AS files FROM evidence_rows WHERE project IS NOT NULL GROUP BY 1) SELECT project, rows, files, round(rows / files, 6) AS mean, (ceil(rows / 10) * 10)::BIGINT AS rounded, row_number() OVER (ORDER BY round(rows / files, 6) DESC, project) AS rank FROM e QUALIFY rank <= 8"


def nth_bin(spark: SparkSession, folder: str) -> DataFrame:
    """The second most frequent bin of the events' values, of ten; the lower bin on a tie."""
    h = M.histogram(table(spark, folder, "events"), "value", 10)
    return S.ranked(S.top(h, 2, F.desc("n"), "bin"), [F.desc("n"), "bin"], 1).filter("rank = 2").select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


NTH_BIN = """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT least(floor((value - lo) / ((hi - lo) / 10))::INT, 9) AS bin, count(*) AS n FROM events, s WHERE value IS NOT NULL GROUP BY 1)
SELECT bin, round(lo + bin * ((hi - lo) / 10), 4) AS low, round(lo + (bin + 1) * ((hi - lo) / 10), 4) AS high, n FROM c, s ORDER BY n DESC, bin LIMIT 1 OFFSET 1"""


def merged_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters of each document over the defaults of the evidence table: a document's own value counts first."""
    p = "^([a-z_0-9]+) = (.*)$"
    own = doc_lines(spark, folder).filter(F.col("line").rlike("^[a-z_0-9]+ = ")).select("doc_id", "line_no", F.regexp_extract("line", p, 1).alias("k"), F.regexp_extract("line", p, 2).alias("v"))
    last = own.groupBy("doc_id", "k").agg(F.max_by("v", "line_no").alias("own"))
    defaults = table(spark, folder, "evidence_rows").filter("ev_type = 'param' AND ev_key IS NOT NULL").groupBy(F.col("ev_key").alias("k")).agg(F.min_by("ev_value", "ev_id").alias("default"))
    every = last.select("doc_id").distinct().crossJoin(F.broadcast(defaults.filter(F.col("k").isin("load_ratio", "tenure_m"))))  # two rows at most
    merged = every.join(last, ["doc_id", "k"], "left").select("doc_id", "k", F.coalesce("own", "default").alias("value"), F.col("own").isNull().alias("default"))
    return merged.groupBy("k", "default").agg(F.count("*").alias("docs"), F.min("value").alias("least"), F.max("value").alias("most"))


MERGED = f"""
WITH {LINES}, o AS (SELECT doc_id, regexp_extract(line, '^([a-z_0-9]+) = (.*)$', 1) AS k, arg_max(regexp_extract(line, '^([a-z_0-9]+) = (.*)$', 2), line_no) AS own FROM lines WHERE regexp_matches(line, '^[a-z_0-9]+ = ') GROUP BY 1, 2),
d AS (SELECT ev_key AS k, arg_min(ev_value, ev_id) AS def FROM evidence_rows WHERE ev_type = 'param' AND ev_key IN ('load_ratio', 'tenure_m') GROUP BY 1), m AS (SELECT x.doc_id, d.k, coalesce(own, def) AS value, own IS NULL AS "default" FROM (SELECT DISTINCT doc_id FROM o) x CROSS JOIN d LEFT JOIN o ON o.doc_id = x.doc_id AND o.k = d.k)
SELECT k, "default", count(*) AS docs, min(value) AS least, max(value) AS most FROM m GROUP BY 1, 2"""


def signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Questions whose runs agree on answer, unit and archetype in at least two records, more than on any other signature."""
    g = table(spark, folder, "gold_100_review").filter("question IS NOT NULL AND system_answer IS NOT NULL")
    unit = F.regexp_extract("system_answer", "[0-9](円|%|％|件|時間| yen)", 1)
    s = g.groupBy("question", V.normal_answer("system_answer").alias("answer"), unit.alias("unit"), F.coalesce("archetype", F.lit("")).alias("branch")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("question")
    best = s.withColumn("m", F.max("n").over(w)).filter("n = m AND n >= 2").withColumn("k", F.count("*").over(w)).filter("k = 1")
    return best.groupBy("branch", "unit").agg(F.count("*").alias("questions"), F.sum("n").alias("records"))


SIGNATURES = f"""
WITH s AS (SELECT question, {NORMAL.format(c='system_answer')} AS answer, regexp_extract(system_answer, '[0-9](円|%|％|件|時間| yen)', 1) AS unit, coalesce(archetype, '') AS branch, count(*) AS n FROM gold_100_review WHERE question IS NOT NULL AND system_answer IS NOT NULL GROUP BY 1, 2, 3, 4),
m AS (SELECT * FROM s QUALIFY n = max(n) OVER (PARTITION BY question) AND n >= 2), b AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY question) = 1) SELECT branch, unit, count(*) AS questions, sum(n)::BIGINT AS records FROM b GROUP BY 1, 2"""


def model_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Price by quantity over complete rows, of each flag: rows, slope, r2 and adjusted r2; null unless there are more than two more rows than coefficients."""
    li = table(spark, folder, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y")).dropna()
    s = li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    enough = F.when((F.col("n") > 3) & (F.col("vx") > 0) & (F.col("vy") > 0), F.pow("c", F.lit(2)) / (F.col("vx") * F.col("vy")))
    return s.withColumn("r2", enough).select("l_returnflag", "n", F.round(F.when(F.col("r2").isNotNull(), F.col("c") / F.col("vx")), 4).alias("slope"), F.round("r2", 6).alias("r2"), F.round(1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 2), 6).alias("adjusted"))


METRICS = "SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(1 - (1 - regr_r2(l_extendedprice, l_quantity)) * (count(*) - 1) / (count(*) - 2), 6) AS adjusted FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1"

QUERIES = {
    "search_id_kinds": id_kinds, "search_asked_ids": asked_ids, "search_fan_out": fan_out, "search_reranked": reranked, "score_fired_flags": fired_flags, "score_committed": committed, "entity_extremes": extremes,
    "stats_nth_bin": nth_bin, "lines_merged_parameters": merged_parameters, "score_signatures": signatures, "stats_model_metrics": model_metrics,
}
ORACLE = {
    "search_id_kinds": ID_KINDS, "search_asked_ids": ASKED_IDS, "search_fan_out": FAN_OUT, "search_reranked": RERANKED, "score_fired_flags": FIRED, "score_committed": committed_sql(), "entity_extremes": EXTREMES,
    "stats_nth_bin": NTH_BIN, "lines_merged_parameters": MERGED, "score_signatures": SIGNATURES, "stats_model_metrics": METRICS,
}
