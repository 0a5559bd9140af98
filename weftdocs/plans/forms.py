"""Queries over lists, ranges, windows, chunks and file manifests, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftdocs.functions import forms as N
from weftdocs.functions.text import clip, half_up, round_up_to, version_rank
from weftdocs.plans.search import LINES, doc_lines
from weftdocs.session import spread, table


def unicode_forms(spark: SparkSession, folder: str) -> DataFrame:
    """How many questions change under composition, and how many different ones are left."""
    q = table(spark, folder, "gold_100_review").filter("question IS NOT NULL").select("archetype", "question", N.normal_form("question").alias("n"))
    return q.groupBy("archetype").agg(F.count_if(F.col("question") != F.col("n")).alias("changed"), F.count_distinct("n").alias("distinct_forms"))


UNICODE = "SELECT archetype, count(*) FILTER (question <> nfc_normalize(question)) AS changed, count(DISTINCT nfc_normalize(question)) AS distinct_forms FROM gold_100_review WHERE question IS NOT NULL GROUP BY 1"


def id_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Task pairs named together, with all tasks between them."""
    p = doc_lines(spark, folder).select("doc_id", F.explode(F.regexp_extract_all("line", F.lit("(T[0-9]{2}と)T[0-9]{2}"), F.lit(0))).alias("m"))
    r = p.select("doc_id", N.id_range(F.substring("m", 1, 3), F.substring("m", 5, 3)).alias("ids")).filter("ids IS NOT NULL")
    return r.select("doc_id", F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


ID_RANGES = f"""
WITH {LINES}, m AS (SELECT doc_id, unnest(regexp_extract_all(line, 'T[0-9]{{2}}とT[0-9]{{2}}')) AS m FROM lines), r AS (SELECT doc_id, substr(m, 2, 2)::INT AS a, substr(m, 6, 2)::INT AS b FROM m),
e AS (SELECT doc_id, unnest(range(a, b + 1)) AS n FROM r WHERE b >= a AND b - a < 60) SELECT 'T' || lpad(n::VARCHAR, 2, '0') AS id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM e GROUP BY 1"""


def list_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Lists in answers against the lists expected: same members, only more, missing and extra."""
    g = table(spark, folder, "gold_100_review").filter("archetype = 'highlight_set' AND gold_v3 IS NOT NULL AND system_answer IS NOT NULL")
    v = g.select("review_id", N.listed("gold_v3").alias("a"), N.listed("system_answer").alias("b"))
    same = F.array_sort(F.array_distinct("a")) == F.array_sort(F.array_distinct("b"))
    return v.select("review_id", same.alias("same"), N.appended(F.col("a"), F.col("b")).isNotNull().alias("only_more"), F.size(F.array_except("a", "b")).alias("missing"), F.size(F.array_except("b", "a")).alias("extra"))


ITEMS = "list_filter(list_transform(regexp_split_to_array({c}, '、|, | / |・'), lambda x: trim(x)), lambda x: x <> '')"
LIST_ANSWERS = f"""
WITH v AS (SELECT review_id, {ITEMS.format(c='gold_v3')} AS a, {ITEMS.format(c='system_answer')} AS b FROM gold_100_review WHERE archetype = 'highlight_set' AND gold_v3 IS NOT NULL AND system_answer IS NOT NULL),
d AS (SELECT *, list_distinct(list_filter(a, lambda x: NOT list_contains(b, x))) AS m, list_distinct(list_filter(b, lambda x: NOT list_contains(a, x))) AS e FROM v)
SELECT review_id, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS same, len(m) = 0 AND len(e) > 0 AS only_more, len(m)::INT AS missing, len(e)::INT AS extra FROM d"""


def filtered_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files by a predicate written as k=v;k=v, with the size of the universe beside each."""
    wanted = F.str_to_map(F.lit("kind=pdf;category=report"), F.lit(";"), F.lit("="))
    d = table(spark, folder, "extracted_docs").select("ext_id", "project", "kind", "category")
    ok = F.forall(F.map_entries(wanted), lambda e: F.element_at(F.create_map(F.lit("kind"), F.col("kind"), F.lit("category"), F.col("category")), e["key"]) == e["value"])
    n = d.agg(F.count("*").alias("universe"))
    return d.filter(ok).crossJoin(F.broadcast(n)).groupBy("project", "universe").agg(F.count("*").alias("files"))  # n is one row


FILTERED = "SELECT project, (SELECT count(*) FROM extracted_docs) AS universe, count(*) AS files FROM extracted_docs WHERE kind = 'pdf' AND category = 'report' GROUP BY 1"


def keyword_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Places of a word in documents with the text around them, none inside the window before."""
    d = spread(table(spark, folder, "documents")).filter(F.contains("text", F.lit("監査証跡")))
    w = d.select("doc_id", F.posexplode(N.windows("text", "監査証跡", 20)).alias("n", "snippet"))
    return w.select("doc_id", "n", F.md5("snippet").alias("snippet"))


WINDOWS = """
WITH w AS (SELECT doc_id, regexp_extract_all(text, '(?s).{0,20}監査証跡.{0,20}') AS w FROM documents WHERE contains(text, '監査証跡'))
SELECT doc_id, (i - 1)::INT AS n, md5(w[i]) AS snippet FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)"""


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical file of each project and category: later versions first, then short paths."""
    d = table(spark, folder, "extracted_docs").filter("project IS NOT NULL").select("project", "category", "name", "rel").distinct()
    w = Window.partitionBy("project", "category").orderBy(F.desc(version_rank("name")), F.length("rel"), "rel")
    return d.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("project", "category", "place", "rel")


MANIFEST = r"""
WITH f AS (SELECT DISTINCT project, category, name, rel FROM extracted_docs WHERE project IS NOT NULL), s AS (SELECT *, lower(regexp_replace(name, '\.[A-Za-z0-9]+$', '')) AS st FROM f),
k AS (SELECT *, CASE WHEN contains(st, '_old') THEN -1 WHEN contains(st, '_final') THEN 10000 ELSE coalesce(try_cast(regexp_extract(st, '(?:_v|改訂-| rev-)([0-9]+)', 1) AS INT), 0) END AS rank FROM s)
SELECT project, category, (row_number() OVER w)::INT AS place, rel FROM k QUALIFY place <= 3 WINDOW w AS (PARTITION BY project, category ORDER BY rank DESC, length(rel), rel)"""
MANIFEST = MANIFEST.replace("SELECT project, category, (row_number() OVER w)::INT AS place, rel FROM k QUALIFY place <= 3 WINDOW w AS (PARTITION BY project, category ORDER BY rank DESC, length(rel), rel)", ", r AS (SELECT project, category, (row_number() OVER (PARTITION BY project, category ORDER BY rank DESC, length(rel), rel))::INT AS place, rel FROM k) SELECT * FROM r WHERE place <= 3").replace(")\n, r AS", "),\nr AS")


def chunked(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of at most 1,200 characters that prefer line ends. Each start depends on the end before it."""
    d = spread(table(spark, folder, "documents")).filter("text <> ''").select("doc_id", F.explode(N.chunk_starts("text")).alias("c"))
    return d.select("doc_id", "c.start", "c.end")


# Blanks as Python strips them.
BLANK = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CHUNKED = rf"""
WITH RECURSIVE t AS (SELECT doc_id, text, length(regexp_extract(text, '^{BLANK}*')) AS lead, length(regexp_replace(text, '{BLANK}+$', '')) AS n FROM documents WHERE text <> ''),
p(doc_id, text, n, piece, s, e, done) AS (
  SELECT doc_id, text, n, 0, 0::BIGINT, (lead + 180)::BIGINT, n <= lead FROM t
  UNION ALL
  SELECT doc_id, text, n, piece + 1, s, CASE WHEN n - s <= 1200 THEN n WHEN line > 0 THEN s + 599 + line ELSE s + 1200 END, n - s <= 1200
  FROM (SELECT doc_id, text, n, piece, e - 180 AS s, length(regexp_extract(substr(text, (e - 180 + 601)::BIGINT, 600), '(?s)^.*\n')) AS line FROM p WHERE NOT done)),
c AS (SELECT doc_id, s, e, substr(text, (s + 1)::BIGINT, (e - s)::BIGINT) AS part FROM p WHERE piece > 0),
i AS (SELECT doc_id, s + length(regexp_extract(part, '^{BLANK}*')) AS s2, s + length(regexp_replace(part, '{BLANK}+$', '')) AS e2 FROM c)
SELECT doc_id, s2::INT AS start, e2::INT AS "end" FROM i WHERE e2 > s2"""



def answer_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a whole sentence of an expected answer."""
    sentence = F.explode(F.split("text", "[。\n]"))
    s = spread(table(spark, folder, "extracted_docs")).select("rel", sentence.alias("s")).filter("length(s) >= 15").select("rel", F.trim("s").alias("s")).distinct()
    g = table(spark, folder, "gold_100_review").select("review_id", F.explode(F.split("gold_v3", "[。\n]")).alias("s")).filter("length(s) >= 15").select("review_id", F.trim("s").alias("s")).distinct()
    return g.join(s, "s").groupBy("review_id").agg(F.count_distinct("rel").alias("files"), F.count_distinct("s").alias("sentences"))


SOURCES = """
WITH s AS (SELECT DISTINCT rel, trim(s) AS s FROM (SELECT rel, unnest(regexp_split_to_array(text, '[。\\n]')) AS s FROM extracted_docs) WHERE length(s) >= 15),
g AS (SELECT DISTINCT review_id, trim(s) AS s FROM (SELECT review_id, unnest(regexp_split_to_array(gold_v3, '[。\\n]')) AS s FROM gold_100_review) WHERE length(s) >= 15)
SELECT review_id, count(DISTINCT rel) AS files, count(DISTINCT s) AS sentences FROM g JOIN s USING (s) GROUP BY 1"""


def expanded_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Other names of the projects that a question names."""
    names = table(spark, folder, "case_master").select("case_id", F.explode(F.array_distinct(F.concat(F.array("project", "abbrev"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name")).filter("length(name) > 2")
    asked = table(spark, folder, "gold_100_review").select("review_id", "question").filter("question IS NOT NULL")
    hits = asked.join(F.broadcast(names), F.contains("question", "name")).select("review_id", "question", "case_id").distinct()  # 40 projects at every size
    other = hits.join(F.broadcast(names), "case_id").filter(~F.contains("question", "name"))
    return other.groupBy("review_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("terms"))


EXPANDED = """
WITH n AS (SELECT case_id, name FROM (SELECT case_id, unnest(list_distinct(list_concat([project, abbrev], coalesce(aliases, [])))) AS name FROM case_master) WHERE length(name) > 2),
h AS (SELECT DISTINCT review_id, question, case_id FROM gold_100_review JOIN n ON contains(question, name))
SELECT review_id, array_to_string(list_sort(list_distinct(list(name))), '|') AS terms FROM h JOIN n USING (case_id) WHERE NOT contains(question, name) GROUP BY 1"""


def ordered_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Task ids of each document, each once, by number."""
    p = doc_lines(spark, folder).filter(F.contains("line", F.lit("|"))).select("doc_id", F.regexp_extract("line", r"^(T[0-9]+) \|", 1).alias("id")).filter("id <> ''").distinct()
    order = F.sort_array(F.collect_list(F.struct(F.substring("id", 2, 9).cast("bigint").alias("n"), "id")))
    return p.groupBy("doc_id").agg(F.array_join(F.transform(order, lambda x: x["id"]), ",").alias("ids"))


ORDERED_IDS = f"WITH {LINES}, p AS (SELECT DISTINCT doc_id, regexp_extract(line, '^(T[0-9]+) \\|', 1) AS id FROM lines WHERE contains(line, '|')) SELECT doc_id, string_agg(id, ',' ORDER BY substr(id, 2)::BIGINT, id) AS ids FROM p WHERE id <> '' GROUP BY 1"


def labelled_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers on one of the two lines after a label, where a document has one such value only."""
    from weftdocs.operators.lines import lines

    rows = lines(spread(table(spark, folder, "extracted_docs")).filter("text IS NOT NULL"), "ext_id", "text")
    w = Window.partitionBy("ext_id").orderBy("line_no")
    number = lambda c: F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).try_cast("bigint"))
    near = rows.select("ext_id", F.trim("line").alias("label"), F.coalesce(number(F.lead("line", 1).over(w)), number(F.lead("line", 2).over(w))).alias("v"))
    hit = near.filter(F.col("label").isin("件数", "数量", "Qty", "Count", "Items") & F.col("v").isNotNull())
    return hit.groupBy("ext_id").agg(F.count_distinct("v").alias("k"), F.min("v").alias("value")).filter("k = 1").select("ext_id", "value")


LABELLED = r"""
WITH s AS (SELECT ext_id, i, parts[i] AS line FROM (SELECT ext_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM extracted_docs WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) WHERE trim(parts[i]) <> ''),
n AS (SELECT ext_id, i, trim(line) AS label, CASE WHEN regexp_matches(trim(line), '^[0-9]+$') THEN trim(line)::BIGINT END AS v FROM s),
w AS (SELECT ext_id, label, coalesce(lead(v, 1) OVER (PARTITION BY ext_id ORDER BY i), lead(v, 2) OVER (PARTITION BY ext_id ORDER BY i)) AS v FROM n)
SELECT ext_id, min(v) AS value FROM w WHERE label IN ('件数', '数量', 'Qty', 'Count', 'Items') AND v IS NOT NULL GROUP BY 1 HAVING count(DISTINCT v) = 1"""


def rounded(spark: SparkSession, folder: str) -> DataFrame:
    """Rounding rules over line items: half up, and up to the next half."""
    li = table(spark, folder, "lineitem")
    v = li.select("l_linestatus", half_up("l_tax", 1).cast("double").alias("a"), round_up_to(F.col("l_discount") * 10, 0.5).alias("b"), clip("l_shipdate", 9).alias("c"))
    return v.groupBy("l_linestatus").agg(F.round(F.sum("a"), 3).alias("half_up"), F.round(F.sum("b"), 3).alias("up"), F.count_distinct("c").alias("clipped"))


ROUNDED = "WITH v AS (SELECT l_linestatus, round(l_tax::DECIMAL(38,10), 1)::DOUBLE AS a, ceil(round(l_discount * 10 / 0.5, 9)) * 0.5 AS b, strftime(l_shipdate, '%Y-%m-%d')[:8] AS c FROM lineitem) SELECT l_linestatus, round(sum(a), 3) AS half_up, round(sum(b), 3) AS up, count(DISTINCT c) AS clipped FROM v GROUP BY 1"

QUERIES = {
    "forms_unicode": unicode_forms, "forms_id_ranges": id_ranges, "forms_list_answers": list_answers, "source_filtered_files": filtered_files, "lines_keyword_windows": keyword_windows, "source_manifest": manifest,
    "search_chunked": chunked, "search_answer_sources": answer_sources, "search_expanded_terms": expanded_terms, "lines_ordered_ids": ordered_ids, "lines_labelled_numbers": labelled_numbers, "forms_rounded": rounded,
}
ORACLE = {
    "search_chunked": CHUNKED, 
    "forms_unicode": UNICODE, "forms_id_ranges": ID_RANGES, "forms_list_answers": LIST_ANSWERS, "source_filtered_files": FILTERED, "lines_keyword_windows": WINDOWS, "source_manifest": MANIFEST,
    "search_answer_sources": SOURCES, "search_expanded_terms": EXPANDED, "lines_ordered_ids": ORDERED_IDS, "lines_labelled_numbers": LABELLED, "forms_rounded": ROUNDED,
}
