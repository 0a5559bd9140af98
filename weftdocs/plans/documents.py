"""Queries over lines, evidence, versions, formulas and scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftdocs.functions.text import version_base, version_rank
from weftdocs.operators import diff as D
from weftdocs.operators import evidence as E
from weftdocs.operators import formula as X
from weftdocs.operators import joins as J
from weftdocs.operators import lines as L
from weftdocs.operators import scoring as C
from weftdocs.plans.search import LINES, doc_lines
from weftdocs.session import table


def line_context(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by the page, sheet or slide mark that holds for them."""
    c = L.carried_context(doc_lines(spark, folder), "doc_id")
    return c.groupBy("doc_id", "marker", "marker_no").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"))


CONTEXT = f"""
WITH {LINES}, m AS (SELECT *, CASE WHEN regexp_matches(line, '^\\[(page|sheet|slide)([0-9]+)\\]') THEN regexp_extract(line, '^\\[(page|sheet|slide)([0-9]+)\\]', ['k', 'n']) END AS mark FROM lines),
c AS (SELECT doc_id, line_no, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS m FROM m)
SELECT doc_id, m.k AS marker, m.n::INT AS marker_no, count(*) AS lines, min(line_no)::INT AS first_line FROM c GROUP BY 1, 2, 3"""


def grep_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that name a yellow cell or an owner; the first three of each document, with its number of hits."""
    return L.grep(doc_lines(spark, folder), "doc_id", r"\(yellow\)|owner", 3).select("doc_id", "line_no", "hit_no", "hits")


GREP = f"WITH {LINES}, h AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS hit_no, count(*) OVER (PARTITION BY doc_id) AS hits FROM lines WHERE regexp_matches(line, '\\(yellow\\)|owner')) SELECT * FROM h WHERE hit_no <= 3"


def typed_evidence(spark: SparkSession, folder: str) -> DataFrame:
    e = E.extract(doc_lines(spark, folder), ["doc_id", "line_no"])
    return e.groupBy("ev_type", "ev_key").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.min("ev_value").alias("least"), F.max("ev_value").alias("most"))


TYPED = (
    f"WITH {LINES}, e AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS ev_type, regexp_extract(line, '{p}', {a}) AS ev_key, regexp_extract(line, '{p}', {b}) AS ev_value FROM lines WHERE regexp_matches(line, '{p}')" for k, (p, a, b) in E.WHOLE.items())
    + "".join(f" UNION ALL SELECT doc_id, '{k}', regexp_extract(t, '{q}', {a}), regexp_extract(t, '{q}', {b}) FROM (SELECT doc_id, unnest(regexp_extract_all(line, '{p}')) AS t FROM lines) WHERE regexp_matches(t, '{q}')" for k, (p, q, a, b) in E.WITHIN.items())
    + f" UNION ALL SELECT doc_id, 'bold', trim(w), trim(w) FROM (SELECT doc_id, unnest(string_split(replace(line, '{E.BOLD}', ''), ' / ')) AS w FROM lines WHERE starts_with(line, '{E.BOLD}')) WHERE trim(w) <> ''"
    + " UNION ALL SELECT doc_id, 'column', trim(w), trim(w) FROM (SELECT doc_id, unnest(string_split(line, ' | ')) AS w FROM lines WHERE contains(line, ' | ') AND NOT regexp_matches(line, '[0-9]'))"
    + ") SELECT ev_type, ev_key, count(*) AS n, count(DISTINCT doc_id) AS docs, min(ev_value) AS least, max(ev_value) AS most FROM e GROUP BY 1, 2"
)


def evidence_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence whose key or value matches, once each, two of a file at most."""
    e = table(spark, folder, "evidence_rows").filter(F.coalesce("ev_value", F.lit("")).rlike("レビュー|review") | F.coalesce("ev_key", F.lit("")).rlike("owner")).dropDuplicates(["ev_id"])
    return L.capped(e, ["file"], ["ev_id"], 2).select("ev_id", "file", "ev_type")


LOOKUP = "WITH e AS (SELECT DISTINCT ON (ev_id) * FROM evidence_rows WHERE regexp_matches(coalesce(ev_value, ''), 'レビュー|review') OR regexp_matches(coalesce(ev_key, ''), 'owner')) SELECT ev_id, file, ev_type FROM e QUALIFY row_number() OVER (PARTITION BY file ORDER BY ev_id) <= 2"


def scan_certificate(spark: SparkSession, folder: str) -> DataFrame:
    """How complete a scan of all registered files for highlights is."""
    docs = table(spark, folder, "extracted_docs")
    readable = (F.coalesce(F.col("encrypted"), F.lit(False)) == False) & (F.coalesce("error", F.lit("")) == "")  # noqa: E712
    scanned = docs.filter(F.length("text") > 0)
    hits = scanned.filter(F.col("text").rlike(r"\(yellow\)|黄色"))
    return E.certificate(docs, "rel", readable, scanned, hits)


CERTIFICATE = r"""
WITH u AS (SELECT rel, coalesce(bool_or(NOT coalesce(encrypted, false) AND coalesce(error, '') = ''), false) AS ok, bool_or(coalesce(length(text), 0) > 0) AS seen, bool_or(coalesce(regexp_matches(text, '\(yellow\)|黄色'), false)) AS hit FROM extracted_docs GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (ok) AS applicable, count(*) FILTER (ok AND seen) AS scanned, count(*) FILTER (NOT ok) AS unsupported, count(*) FILTER (hit) AS hits, count(*) FILTER (ok) > 0 AND count(*) FILTER (ok AND NOT seen) = 0 AS complete FROM u"""


def filled_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence without a sheet takes the sheet before it in its file; a heading starts anew."""
    e = table(spark, folder, "evidence_rows").dropDuplicates(["ev_id"])
    f = L.forward_fill(e, ["rel"], ["ev_id"], "sheet", F.col("ev_type") == "heading")
    return f.filter("sheet IS NULL AND sheet_filled IS NOT NULL").select("ev_id", "sheet_filled")


FILLED = """
WITH e AS (SELECT DISTINCT ON (ev_id) * FROM evidence_rows), i AS (SELECT *, sum((ev_type = 'heading')::INT) OVER (PARTITION BY rel ORDER BY ev_id) AS island FROM e),
f AS (SELECT *, last_value(sheet IGNORE NULLS) OVER (PARTITION BY rel, island ORDER BY ev_id ROWS UNBOUNDED PRECEDING) AS sheet_filled FROM i)
SELECT ev_id, sheet_filled FROM f WHERE sheet IS NULL AND sheet_filled IS NOT NULL"""


def tagged_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Lines tagged by what they hold; those with a number and no date."""
    line = F.col("line")
    tags = F.array_compact(F.array(F.when(line.rlike("[0-9]"), "number"), F.when(line.rlike("[0-9]{4}(年|-[0-9])"), "date"), F.when(line.rlike("[%％]"), "rate"), F.when(line.contains("|"), "table")))
    t = E.exclude_any_require_all(doc_lines(spark, folder).withColumn("tags", tags), "tags", ["date", "table"], ["number", "rate"])
    return t.groupBy("doc_id").agg(F.count("*").alias("lines"))


TAGGED = f"WITH {LINES} SELECT doc_id, count(*) AS lines FROM lines WHERE regexp_matches(line, '[0-9]') AND regexp_matches(line, '[%％]') AND NOT regexp_matches(line, '[0-9]{{4}}(年|-[0-9])') AND NOT contains(line, '|') GROUP BY 1"


def last_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters of documents: the value written last, and how many different ones there were."""
    p = doc_lines(spark, folder).filter(F.col("line").rlike("^[a-z_0-9]+ = "))
    kv = p.select("doc_id", "line_no", F.regexp_extract("line", "^([a-z_0-9]+) = (.*)$", 1).alias("k"), F.regexp_extract("line", "^([a-z_0-9]+) = (.*)$", 2).alias("v"))
    return kv.groupBy("doc_id", "k").agg(F.max_by("v", "line_no").alias("value"), F.count_distinct("v").alias("values"))


LAST_PARAMS = f"WITH {LINES} SELECT doc_id, regexp_extract(line, '^([a-z_0-9]+) = (.*)$', 1) AS k, arg_max(regexp_extract(line, '^([a-z_0-9]+) = (.*)$', 2), line_no) AS value, count(DISTINCT regexp_extract(line, '^([a-z_0-9]+) = (.*)$', 2)) AS values FROM lines WHERE regexp_matches(line, '^[a-z_0-9]+ = ') GROUP BY 1, 2"


def table_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of pipe tables as columns; days summed by owner, multiple owners split."""
    rows = doc_lines(spark, folder).select("doc_id", F.split("line", r" \| ").alias("c")).filter("size(c) = 4 AND c[0] RLIKE '^T[0-9]+$'")
    typed = rows.select("doc_id", F.explode(F.split(F.col("c")[2], "、")).alias("owner"), F.trim(F.col("c")[3]).try_cast("int").alias("days"))
    return typed.groupBy("owner").agg(F.count("*").alias("tasks"), F.sum("days").alias("days"), F.round(F.try_divide(F.sum("days"), F.count("*")), 2).alias("per_task"))


TABLE_ROWS = f"""
WITH {LINES}, r AS (SELECT string_split(line, ' | ') AS c FROM lines), t AS (SELECT unnest(string_split(c[3], '、')) AS owner, try_cast(trim(c[4]) AS INT) AS days FROM r WHERE len(c) = 4 AND regexp_matches(c[1], '^T[0-9]+$'))
SELECT owner, count(*) AS tasks, sum(days)::BIGINT AS days, round(sum(days) / count(*), 2) AS per_task FROM t GROUP BY 1"""


def version_pairs_of(docs: DataFrame) -> DataFrame:
    """(old, new): extractions of one file, and the newest extractions of the files of one version family, each with the one before."""
    some = docs.filter("text <> ''").select("ext_id", "rel", "project", "category", "name")
    again = D.version_pairs(some, ["rel"], "ext_id", "ext_id").select("old", "new")
    newest = some.groupBy("rel").agg(F.max(F.struct("ext_id", "project", "category", "name")).alias("r")).select("rel", "r.*").filter("project IS NOT NULL")
    family = F.regexp_replace(version_base("name"), "[_ ]?[0-9]{9}", "")
    return again.unionByName(D.version_pairs(newest.withColumn("family", family).withColumn("rank", version_rank("name")), ["project", "category", "family"], "ext_id", "rank", "rel").select("old", "new"))


PAIRS = r"""s AS (SELECT ext_id, rel, project, category, name, lower(regexp_replace(name, '\.[A-Za-z0-9]+$', '')) AS st FROM extracted_docs WHERE text <> ''),
newest AS (SELECT *, regexp_replace(trim(regexp_replace(st, '(_old|_final|_v[0-9]+|[ _]?改訂-[0-9]+| rev-[0-9]+)', '', 'g')), '[_ ]?[0-9]{9}', '', 'g') AS family,
  CASE WHEN contains(st, '_old') THEN -1 WHEN contains(st, '_final') THEN 10000 ELSE coalesce(try_cast(regexp_extract(st, '(?:_v|改訂-| rev-)([0-9]+)', 1) AS INT), 0) END AS rank
  FROM s WHERE project IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rel ORDER BY ext_id DESC) = 1),
p AS (SELECT lag(ext_id) OVER (PARTITION BY rel ORDER BY ext_id) AS old, ext_id AS new FROM s
  UNION ALL SELECT lag(ext_id) OVER (PARTITION BY project, category, family ORDER BY rank, rel), ext_id FROM newest)"""


def version_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Lines added and removed between consecutive versions; moved ones apart."""
    docs = table(spark, folder, "extracted_docs")
    c = D.moved(D.changed_lines(version_pairs_of(docs), docs, "ext_id", "text"), ["old", "new"])
    return c.groupBy("old", "new", "change", "moved").agg(F.sum("times").alias("lines"))


CHANGES = "WITH " + PAIRS + r""",
t AS (SELECT ext_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM extracted_docs), l AS (SELECT ext_id, unnest(parts) AS line FROM t), n AS (SELECT ext_id, line, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY 1, 2),
u AS (SELECT old, new, line, -n AS d FROM p JOIN n ON n.ext_id = old UNION ALL SELECT old, new, line, n FROM p JOIN n ON n.ext_id = new WHERE old IS NOT NULL),
d AS (SELECT old, new, line, sum(d) AS d FROM u GROUP BY 1, 2, 3 HAVING sum(d) <> 0), m AS (SELECT *, lower(regexp_replace(line, '\s+', '', 'g')) AS shape FROM d),
k AS (SELECT *, max((d > 0)::INT) OVER w = 1 AND max((d < 0)::INT) OVER w = 1 AS moved FROM m WINDOW w AS (PARTITION BY old, new, shape))
SELECT old, new, CASE WHEN d > 0 THEN 'add' ELSE 'remove' END AS change, moved, sum(abs(d))::BIGINT AS lines FROM k GROUP BY 1, 2, 3, 4"""


def edit_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Edit blocks in order between consecutive versions."""
    docs = table(spark, folder, "extracted_docs")
    return D.edit_blocks(version_pairs_of(docs), docs, "ext_id", "text")


EDITS = "WITH " + PAIRS + r""",
t AS (SELECT ext_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM extracted_docs WHERE text <> ''),
l AS (SELECT ext_id, i AS no, parts[i] AS line, len(parts) AS n FROM t, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
o AS (SELECT *, row_number() OVER (PARTITION BY ext_id, line ORDER BY no) AS k FROM l),
m AS (SELECT p.old, p.new, a.no AS i, b.no AS j FROM p JOIN o a ON a.ext_id = p.old JOIN o b ON b.ext_id = p.new AND a.line = b.line AND a.k = b.k),
x AS (SELECT *, max(j) OVER (PARTITION BY old, new ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(j) OVER (PARTITION BY old, new ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM m),
c AS (SELECT old, new, i, j FROM x WHERE coalesce(before, 0) < j AND coalesce(after, j + 1) > j
  UNION ALL SELECT p.old, p.new, (SELECT len(parts) + 1 FROM t WHERE ext_id = p.old), (SELECT len(parts) + 1 FROM t WHERE ext_id = p.new) FROM p WHERE p.old IS NOT NULL),
g AS (SELECT *, coalesce(lag(i) OVER w, 0) AS i0, coalesce(lag(j) OVER w, 0) AS j0 FROM c WINDOW w AS (PARTITION BY old, new ORDER BY i))
SELECT old, new, CASE WHEN i - i0 = 1 THEN 'insert' WHEN j - j0 = 1 THEN 'delete' ELSE 'replace' END AS op, i0::INT AS old_from, (i - 1)::INT AS old_to, j0::INT AS new_from, (j - 1)::INT AS new_to
FROM g WHERE i - i0 > 1 OR j - j0 > 1"""


MARGIN = {"op": "round", "args": [{"op": "percent_change", "args": [{"op": "mul", "args": [{"ref": "l_extendedprice"}, {"op": "sub", "args": [{"const": 1}, {"ref": "l_discount"}]}]}, {"ref": "l_extendedprice"}]}, {"const": 3}]}


def formula_column(spark: SparkSession, folder: str) -> DataFrame:
    """A formula tree over line items, summed up by flag."""
    li = table(spark, folder, "lineitem")
    v = li.select("l_returnflag", X.to_column(MARGIN, {"l_extendedprice", "l_discount"}).alias("v"))
    return v.groupBy("l_returnflag").agg(F.count("v").alias("n"), F.round(F.avg("v"), 5).alias("average"), F.max("v").alias("most"))


FORMULA = "WITH v AS (SELECT l_returnflag, round(((l_extendedprice - l_extendedprice * (1 - l_discount)) * 100 / nullif(l_extendedprice * (1 - l_discount), 0))::DECIMAL(38,10), 3)::DOUBLE AS v FROM lineitem) SELECT l_returnflag, count(v) AS n, round(avg(v), 5) AS average, max(v) AS most FROM v GROUP BY 1"


def formula_verified(spark: SparkSession, folder: str) -> DataFrame:
    """Orders' prices by formula and by exact fractions: how many agree."""
    spec = {"op": "weighted_sum", "args": [{"ref": "o_totalprice"}, {"const": 0.1}, {"ref": "o_orderkey"}, {"const": 2}]}
    o = table(spark, folder, "orders")
    both = o.select("o_orderstatus", X.to_column(spec, {"o_totalprice", "o_orderkey"}).alias("a"), X.exact_value(spec, ["o_totalprice", "o_orderkey"]).alias("b"))
    return both.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("a") - F.col("b")) <= 1e-6).alias("agree"))


VERIFIED = "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (abs((o_totalprice * 0.1::DOUBLE + o_orderkey * 2) - (o_totalprice::DECIMAL(18, 4) * 0.1 + o_orderkey * 2)::DOUBLE) <= 1e-6) AS agree FROM orders GROUP BY 1"


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts by archetype, zeros kept."""
    return J.crosstab(table(spark, folder, "gold_100_review").filter("archetype IS NOT NULL"), "archetype", "status", ["MATCH", "WRONG", "ABSTAIN"])


VERDICTS = "SELECT archetype, count(*) FILTER (status = 'MATCH') AS \"MATCH\", count(*) FILTER (status = 'WRONG') AS \"WRONG\", count(*) FILTER (status = 'ABSTAIN') AS \"ABSTAIN\" FROM gold_100_review WHERE archetype IS NOT NULL GROUP BY 1"


def transitions(spark: SparkSession, folder: str) -> DataFrame:
    """From which verdict to which a question went, run by run."""
    g = J.latest(table(spark, folder, "gold_100_review").filter("status IS NOT NULL"), ["run_no", "item_index"], F.desc("review_id"))
    w = Window.partitionBy("item_index").orderBy("run_no")
    return g.select(F.lag("status").over(w).alias("before"), F.col("status").alias("after")).filter("before IS NOT NULL").groupBy("before", "after").agg(F.count("*").alias("n"))


TRANSITIONS = "WITH g AS (SELECT * FROM gold_100_review WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_no, item_index ORDER BY review_id DESC) = 1), t AS (SELECT lag(status) OVER (PARTITION BY item_index ORDER BY run_no) AS before, status AS after FROM g) SELECT before, after, count(*) AS n FROM t WHERE before IS NOT NULL GROUP BY 1, 2"

POINTS = "CASE status WHEN 'MATCH' THEN 1.0 WHEN 'WRONG' THEN -1.0 ELSE 0.0 END"


def thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence from which answering pays, by archetype."""
    g = table(spark, folder, "gold_100_review").withColumn("c", F.col("confidence").try_cast("double")).filter("c IS NOT NULL AND archetype IS NOT NULL")
    return C.best_threshold(g, "c", F.expr(POINTS).cast("double"), ["archetype"])


THRESHOLDS = f"""
WITH g AS (SELECT archetype, try_cast(confidence AS DOUBLE) AS c, ({POINTS})::DOUBLE AS p FROM gold_100_review WHERE archetype IS NOT NULL), b AS (SELECT archetype, c, sum(p) AS p, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY 1, 2),
s AS (SELECT archetype, c, sum(p) OVER w AS ev, sum(n) OVER w AS committed FROM b WINDOW w AS (PARTITION BY archetype ORDER BY c DESC)), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY archetype ORDER BY ev DESC, c DESC) = 1)
SELECT archetype, CASE WHEN ev > 0 THEN c END AS threshold, CASE WHEN ev > 0 THEN ev ELSE 0.0 END::DOUBLE AS ev, CASE WHEN ev > 0 THEN committed ELSE 0 END::BIGINT AS committed FROM t"""


def answers_by_majority(spark: SparkSession, folder: str) -> DataFrame:
    """Recurring questions: the answer that most runs agree on, at least two of them."""
    return C.majority(table(spark, folder, "gold_100_review").filter("question IS NOT NULL"), ["question"], "system_answer", 2)


MAJORITY = "WITH c AS (SELECT question, system_answer, count(*) AS n FROM gold_100_review WHERE question IS NOT NULL AND system_answer IS NOT NULL GROUP BY 1, 2), m AS (SELECT * FROM c QUALIFY n = max(n) OVER (PARTITION BY question) AND n >= 2) SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY question) = 1"


def stability(spark: SparkSession, folder: str) -> DataFrame:
    """Share of recurring questions that always got the same answer, by archetype."""
    g = table(spark, folder, "gold_100_review").filter("question IS NOT NULL AND archetype IS NOT NULL")
    q = g.groupBy("archetype", "question").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("system_answer", F.lit(""))).alias("k")).filter("n > 1")
    return q.groupBy("archetype").agg(F.count("*").alias("questions"), F.round(F.avg((F.col("k") == 1).cast("double")), 6).alias("stable"))


STABILITY = "WITH q AS (SELECT archetype, question, count(DISTINCT coalesce(system_answer, '')) AS k FROM gold_100_review WHERE question IS NOT NULL AND archetype IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) SELECT archetype, count(*) AS questions, round(avg((k = 1)::INT), 6) AS stable FROM q GROUP BY 1"


def weighted_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy when every difficulty had the same share."""
    g = table(spark, folder, "gold_100_review").filter("difficulty IS NOT NULL")
    w = C.mean_one_weights(g, "difficulty")
    return w.agg(F.round(F.try_divide(F.sum(F.col("weight") * (F.col("status") == "MATCH").cast("int")), F.sum("weight")), 6).alias("weighted"), F.round(F.avg((F.col("status") == "MATCH").cast("int")), 6).alias("plain"))


WEIGHTED = """
WITH g AS (SELECT * FROM gold_100_review WHERE difficulty IS NOT NULL), d AS (SELECT difficulty, count(*) AS c FROM g GROUP BY 1), w AS (SELECT g.status, (SELECT count(*) FROM g) / (c * (SELECT count(*) FROM d)) AS weight FROM g JOIN d USING (difficulty))
SELECT round(sum(weight * (status = 'MATCH')::INT) FILTER (status IS NOT NULL) / sum(weight), 6) AS weighted, round(avg((status = 'MATCH')::INT), 6) AS plain FROM w"""


def highlight_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Highlights found in texts against those in the evidence table, by file number and value."""
    docs = table(spark, folder, "extracted_docs").filter("text IS NOT NULL")
    found = E.extract(L.lines(docs, "ext_id", "text", "name"), ["name"]).filter("ev_type = 'highlight'").select(F.col("name").alias("file"), F.trim("ev_value").alias("v"))
    truth = table(spark, folder, "evidence_rows").filter("ev_type = 'highlight'").select("file", F.trim("ev_value").alias("v"))
    return C.micro_pr(found, truth, ["file", "v"])


RECALL = r"""
WITH s AS (SELECT name, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM extracted_docs WHERE text IS NOT NULL),
f AS (SELECT DISTINCT name AS file, trim(regexp_extract(line, '^([A-Z]{1,2}[0-9]+)\((yellow|red|green|blue|orange)\): (.+)$', 3)) AS v, 1 AS a FROM s WHERE regexp_matches(line, '^([A-Z]{1,2}[0-9]+)\((yellow|red|green|blue|orange)\): (.+)$')),
t AS (SELECT DISTINCT file, trim(ev_value) AS v, 1 AS b FROM evidence_rows WHERE ev_type = 'highlight'), j AS (SELECT a, b FROM f FULL JOIN t USING (file, v)), c AS (SELECT count(*) FILTER (a = 1 AND b = 1) AS tp, count(*) FILTER (b IS NULL) AS fp, count(*) FILTER (a IS NULL) AS fn FROM j)
SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c"""


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """A content hash of each project's documents that does not depend on their order."""
    d = table(spark, folder, "documents").select("project", F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 12), 16, 10).cast("decimal(20,0)").alias("h"))
    return d.groupBy("project").agg(F.count("*").alias("docs"), (F.sum("h") % F.lit(2**48)).cast("bigint").alias("fingerprint"))


FINGERPRINTS = "SELECT project, count(*) AS docs, (sum(('0x' || md5(coalesce(text, ''))[:12])::BIGINT::HUGEINT) % 281474976710656)::BIGINT AS fingerprint FROM documents GROUP BY 1"


def registry_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Files by folder category and type, from their paths."""
    d = table(spark, folder, "extracted_docs").select(F.regexp_extract("rel", r"/(0[0-9])\.([^/]*)/", 1).alias("no"), F.lower(F.regexp_extract("rel", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), "encrypted", "error")
    return d.groupBy("no", "ext").agg(F.count("*").alias("files"), F.count_if(F.col("encrypted")).alias("encrypted"), F.count("error").alias("errors"))


PATHS = r"SELECT regexp_extract(rel, '/(0[0-9])\.([^/]*)/', 1) AS no, lower(regexp_extract(rel, '\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS files, count(*) FILTER (encrypted) AS encrypted, count(error) AS errors FROM extracted_docs GROUP BY 1, 2"

QUERIES = {
    "lines_context": line_context, "lines_grep": grep_lines, "lines_tagged": tagged_changes, "lines_last_parameters": last_parameters, "lines_table_rows": table_rows, "evidence_typed": typed_evidence,
    "evidence_lookup": evidence_lookup, "evidence_certificate": scan_certificate, "evidence_filled_sheets": filled_sheets, "diff_version_changes": version_changes, "diff_edit_blocks": edit_blocks,
    "formula_column": formula_column, "formula_verified": formula_verified, "score_verdicts": verdicts, "score_transitions": transitions, "score_thresholds": thresholds, "score_majority": answers_by_majority,
    "score_stability": stability, "score_weighted": weighted_accuracy, "score_highlight_recall": highlight_recall, "source_fingerprints": fingerprints, "source_paths": registry_paths,
}
ORACLE = {
    "lines_context": CONTEXT, "lines_grep": GREP, "lines_tagged": TAGGED, "lines_last_parameters": LAST_PARAMS, "lines_table_rows": TABLE_ROWS, "evidence_typed": TYPED, "evidence_lookup": LOOKUP,
    "evidence_certificate": CERTIFICATE, "evidence_filled_sheets": FILLED, "diff_version_changes": CHANGES, "diff_edit_blocks": EDITS, "formula_column": FORMULA, "formula_verified": VERIFIED, "score_verdicts": VERDICTS,
    "score_transitions": TRANSITIONS, "score_thresholds": THRESHOLDS, "score_majority": MAJORITY, "score_stability": STABILITY, "score_weighted": WEIGHTED, "score_highlight_recall": RECALL,
    "source_fingerprints": FINGERPRINTS, "source_paths": PATHS,
}
