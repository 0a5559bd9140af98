"""Queries over table cells, marked cells, sections and result files, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftdocs.functions import values as V
from weftdocs.functions.text import locator, parse_numeric
from weftdocs.operators import evidence as E
from weftdocs.operators import joins as J
from weftdocs.operators import lines as L
from weftdocs.plans.answers import NUMS
from weftdocs.plans.documents import PAIRS, version_pairs_of
from weftdocs.plans.search import LINES, doc_lines
from weftdocs.session import shared_folder, spread, table
from weftdocs.sources import files


def keyed_cells(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, row_id, header, value, line_no): cells of pipe tables, keyed by the first cell of their row and the header above. Rows of another width than their header are left out."""
    rows = lines.filter(F.col("line").contains(E.CELL_MARK))
    head = F.when(~F.col("line").rlike("[0-9]"), F.col("line"))
    under = rows.withColumn("_head", F.last(head, ignorenulls=True).over(Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    split = under.filter(F.col("line") != F.col("_head")).select(doc, "line_no", F.split("_head", r" \| ").alias("h"), F.split("line", r" \| ").alias("c")).filter("size(h) = size(c)")
    cells = split.select(doc, "line_no", F.col("c")[0].alias("row_id"), F.explode(F.slice(F.arrays_zip("h", "c"), 2, F.size("c"))).alias("z"))
    return cells.select(doc, "row_id", F.col("z.h").alias("header"), F.col("z.c").alias("value"), "line_no")


def extracted_cells(spark: SparkSession, folder: str) -> DataFrame:
    return keyed_cells(L.lines(spread(table(spark, folder, "extracted_docs")), "ext_id", "text"), "ext_id")


def cells_by_header(spark: SparkSession, folder: str) -> DataFrame:
    """Cells by their header: how many, in how many rows and files, and the numbers among them."""
    return extracted_cells(spark, folder).groupBy("header").agg(F.count("*").alias("cells"), F.count_distinct("row_id").alias("row_ids"), F.count_distinct("ext_id").alias("files"), F.count(parse_numeric("value")).alias("numbers"))


CELLS = r"""t AS (SELECT ext_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM extracted_docs), l AS (SELECT ext_id, i AS line_no, parts[i] AS line FROM t, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
r AS (SELECT *, last_value(CASE WHEN NOT regexp_matches(line, '[0-9]') THEN line END IGNORE NULLS) OVER (PARTITION BY ext_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS head FROM l WHERE contains(line, ' | ')),
w AS (SELECT ext_id, line_no, string_split(head, ' | ') AS h, string_split(line, ' | ') AS c FROM r WHERE line <> head),
cells AS (SELECT ext_id, c[1] AS row_id, h[k] AS header, c[k] AS value, line_no FROM w, LATERAL (SELECT unnest(range(2, len(c) + 1)) AS k) WHERE len(h) = len(c))"""
BY_HEADER = f"WITH {CELLS} SELECT header, count(*) AS cells, count(DISTINCT row_id) AS row_ids, count(DISTINCT ext_id) AS files, count(*) FILTER (regexp_matches(trim(value), '^[+-]?([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)(\\.[0-9]+)?[%％]?$')) AS numbers FROM cells GROUP BY 1"


def cell_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of one key in consecutive versions: added, removed or modified. Of a key that stands twice in a version, the first cell counts."""
    first = extracted_cells(spark, folder).groupBy("ext_id", "row_id", "header").agg(F.min_by("value", "line_no").alias("value"))
    pairs = version_pairs_of(table(spark, folder, "extracted_docs"))
    side = lambda c: pairs.join(first.withColumnRenamed("ext_id", c), c)
    return J.compare(side("old"), side("new"), ["old", "new", "row_id", "header"], "value").groupBy("old", "new", "change").agg(F.count("*").alias("cells"))


CELL_CHANGES = f"""
WITH {PAIRS}, {CELLS}, f AS (SELECT ext_id, row_id, header, arg_min(value, line_no) AS value FROM cells GROUP BY 1, 2, 3), a AS (SELECT p.old, p.new, row_id, header, value, true AS a FROM p JOIN f ON f.ext_id = p.old), b AS (SELECT p.old, p.new, row_id, header, value, true AS b FROM p JOIN f ON f.ext_id = p.new WHERE p.old IS NOT NULL),
j AS (SELECT coalesce(a.old, b.old) AS old, coalesce(a.new, b.new) AS new, CASE WHEN a IS NULL THEN 'add' WHEN b IS NULL THEN 'remove' WHEN a.value IS DISTINCT FROM b.value THEN 'modify' END AS change FROM a FULL JOIN b ON a.old = b.old AND a.new = b.new AND a.row_id = b.row_id AND a.header = b.header)
SELECT old, new, change, count(*) AS cells FROM j WHERE change IS NOT NULL GROUP BY 1, 2, 3"""


def by_colour(spark: SparkSession, folder: str) -> DataFrame:
    """Cells marked in yellow or red in the texts, by colour, with those that hold a number."""
    p = r"^([A-Z]{1,2}[0-9]+)\((yellow|red)\): (.+)$"
    h = L.lines(spread(table(spark, folder, "extracted_docs")), "ext_id", "text").filter(F.col("line").rlike(p)).select("ext_id", F.regexp_extract("line", p, 1).alias("cell"), F.regexp_extract("line", p, 2).alias("colour"), F.regexp_extract("line", p, 3).alias("value"))
    return h.groupBy("colour").agg(F.count("*").alias("cells"), F.count_distinct("ext_id").alias("files"), F.count_distinct("value").alias("values"), F.count(parse_numeric("value")).alias("numbers"))


BY_COLOUR = r"""
WITH l AS (SELECT ext_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM extracted_docs), h AS (SELECT ext_id, regexp_extract(line, '^([A-Z]{1,2}[0-9]+)\((yellow|red)\): (.+)$', 2) AS colour, regexp_extract(line, '^([A-Z]{1,2}[0-9]+)\((yellow|red)\): (.+)$', 3) AS value FROM l WHERE regexp_matches(line, '^([A-Z]{1,2}[0-9]+)\((yellow|red)\): (.+)$'))
SELECT colour, count(*) AS cells, count(DISTINCT ext_id) AS files, count(DISTINCT value) AS values, count(*) FILTER (regexp_matches(trim(value), '^[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]+)?[%％]?$')) AS numbers FROM h GROUP BY 1"""


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "evidence_rows").dropDuplicates(["ev_id"])


def decorated(spark: SparkSession, folder: str) -> DataFrame:
    """Projects by the number of their columns in which both bold and highlighted cells stand, and in which all of the two and a heading do."""
    e = _evidence(spark, folder).filter("cell IS NOT NULL AND project IS NOT NULL AND ev_type IN ('bold', 'highlight', 'heading')")
    per = e.groupBy("project", F.regexp_extract("cell", "^([A-Z]+)", 1).alias("col")).agg(F.collect_set("ev_type").alias("tags"))
    both = E.exclude_any_require_all(per, "tags", [], ["bold", "highlight"])
    return both.groupBy("project").agg(F.count("*").alias("both"), F.count_if(F.array_contains("tags", "heading")).alias("all_three"))


DECORATED = """
WITH e AS (SELECT DISTINCT ON (ev_id) * FROM evidence_rows), p AS (SELECT project, regexp_extract(cell, '^([A-Z]+)', 1) AS col, bool_or(ev_type = 'bold') AS b, bool_or(ev_type = 'highlight') AS h, bool_or(ev_type = 'heading') AS d FROM e WHERE cell IS NOT NULL AND project IS NOT NULL AND ev_type IN ('bold', 'highlight', 'heading') GROUP BY 1, 2)
SELECT project, count(*) AS both, count(*) FILTER (d) AS all_three FROM p WHERE b AND h GROUP BY 1"""


def crossings(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of a project that lie where a row with a highlight and a column with a highlight cross, without being highlighted themselves."""
    column, row = J.grid_place("cell")
    e = _evidence(spark, folder).filter("cell IS NOT NULL AND project IS NOT NULL").select("project", "ev_id", "ev_type", column.alias("c"), row.alias("r"))
    lit = e.filter("ev_type = 'highlight'")
    hit = e.filter("ev_type <> 'highlight'").join(lit.select("project", "c").distinct(), ["project", "c"], "left_semi").join(lit.select("project", "r").distinct(), ["project", "r"], "left_semi")
    return hit.join(lit.select("project", "c", "r").distinct(), ["project", "c", "r"], "left_anti").groupBy("project").agg(F.count("*").alias("cells"), F.min("ev_id").alias("first"))


CROSSINGS = """
WITH e AS (SELECT DISTINCT ON (ev_id) ev_id, project, ev_type, regexp_extract(cell, '^([A-Z]+)', 1) AS c, regexp_extract(cell, '([0-9]+)$', 1) AS r FROM evidence_rows WHERE cell IS NOT NULL AND project IS NOT NULL), h AS (SELECT DISTINCT project, c, r FROM e WHERE ev_type = 'highlight')
SELECT project, count(*) AS cells, min(ev_id) AS first FROM e WHERE ev_type <> 'highlight' AND (project, c) IN (SELECT (project, c) FROM h) AND (project, r) IN (SELECT (project, r) FROM h) AND (project, c, r) NOT IN (SELECT (project, c, r) FROM h) GROUP BY 1"""


def over_average(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers that a rule "above average" would mark, by key: how many, and the largest."""
    e = _evidence(spark, folder).filter("ev_type = 'number' AND ev_key IS NOT NULL").select("ev_key", parse_numeric("ev_value").alias("v")).filter("v IS NOT NULL")
    mean = e.groupBy("ev_key").agg(F.avg("v").alias("mean"))  # one row for each key
    return e.join(F.broadcast(mean), "ev_key").groupBy("ev_key").agg(F.count("*").alias("n"), F.count_if(F.col("v") > F.col("mean")).alias("over"), F.max("v").alias("most"))


OVER = r"""
WITH e AS (SELECT DISTINCT ON (ev_id) * FROM evidence_rows), v AS (SELECT ev_key, try_cast(replace(regexp_replace(trim(ev_value), '[%％]$', ''), ',', '') AS DOUBLE) AS v FROM e WHERE ev_type = 'number' AND ev_key IS NOT NULL AND regexp_matches(trim(ev_value), '^[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]+)?[%％]?$')), m AS (SELECT ev_key, avg(v) AS mean FROM v GROUP BY 1)
SELECT ev_key, count(*) AS n, count(*) FILTER (v > mean) AS over, max(v) AS most FROM v JOIN m USING (ev_key) GROUP BY 1"""


def series_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Of the numbers of each key, the two largest and the two smallest records, ties by id."""
    e = _evidence(spark, folder).filter("ev_type = 'number' AND ev_key IS NOT NULL").select("ev_key", "ev_id", parse_numeric("ev_value").alias("v")).filter("v IS NOT NULL")
    w = Window.partitionBy("ev_key")
    up = e.withColumn("place", F.row_number().over(w.orderBy("v", "ev_id"))).filter("place <= 2").withColumn("end", F.lit("low"))
    down = e.withColumn("place", F.row_number().over(w.orderBy(F.desc("v"), "ev_id"))).filter("place <= 2").withColumn("end", F.lit("high"))
    return up.unionByName(down).select("ev_key", "end", "place", "ev_id", "v")


ENDS = OVER.split("m AS (SELECT")[0].replace("v AS (SELECT ev_key, try_cast", "v AS (SELECT ev_key, ev_id, try_cast").rstrip(", ") + """
SELECT ev_key, 'low' AS "end", row_number() OVER (PARTITION BY ev_key ORDER BY v, ev_id) AS place, ev_id, v FROM v QUALIFY place <= 2 UNION ALL SELECT ev_key, 'high', row_number() OVER (PARTITION BY ev_key ORDER BY v DESC, ev_id) AS place, ev_id, v FROM v QUALIFY place <= 2"""


def section_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers listed under each heading, up to the next one: how many different ones, by heading."""
    rows = doc_lines(spark, folder)
    head = F.when(F.col("line").rlike("^#+ "), F.regexp_extract("line", "^#+ (.*)$", 1))
    under = rows.withColumn("heading", F.last(head, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))).filter("heading IS NOT NULL")
    ids = under.select("doc_id", "heading", F.explode(F.regexp_extract_all("line", F.lit("T[0-9]{2}"), F.lit(0))).alias("id"))
    return ids.groupBy("heading").agg(F.count_distinct("doc_id", "id").alias("ids"), F.count_distinct("doc_id").alias("docs"))


SECTION_IDS = f"""
WITH {LINES}, u AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^#+ ') THEN regexp_extract(line, '^#+ (.*)$', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading FROM lines), i AS (SELECT DISTINCT doc_id, heading, unnest(regexp_extract_all(line, 'T[0-9]{{2}}')) AS id FROM u WHERE heading IS NOT NULL)
SELECT heading, count(*) AS ids, count(DISTINCT doc_id) AS docs FROM i GROUP BY 1"""


def fact_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One line of text for each marked cell, bold word and parameter, ready to be searched."""
    e = _evidence(spark, folder).filter("ev_type IN ('highlight', 'bold', 'param') AND trim(coalesce(ev_value, '')) <> ''")
    fact = F.concat_ws(" ", F.concat(F.lit("["), "file", F.lit("]")), locator("cell", "sheet", "paragraph"), F.concat("ev_key", F.lit(" =")), F.trim("ev_value"))
    return e.select("ev_id", "ev_type", fact.alias("fact"))


FACTS = """
WITH e AS (SELECT DISTINCT ON (ev_id) *, regexp_replace(ev_value, '^ +| +$', '', 'g') AS v FROM evidence_rows)
SELECT ev_id, ev_type, concat_ws(' ', '[' || file || ']', coalesce('cell:' || cell, 'sheet:' || sheet, 'par:' || paragraph::VARCHAR, '-'), ev_key || ' =', v) AS fact FROM e WHERE ev_type IN ('highlight', 'bold', 'param') AND v <> ''"""


def amount_per_file(spark: SparkSession, folder: str) -> DataFrame:
    """Deposit over files of each project; null without a deposit or without files."""
    n = table(spark, folder, "extracted_docs").filter("project IS NOT NULL").groupBy("project").agg(F.count_distinct("rel").alias("files"))
    c = table(spark, folder, "case_master").select("case_id", "project", "deposit")
    return c.join(n, "project", "left").select("case_id", F.coalesce("files", F.lit(0)).alias("files"), F.round(F.try_divide(F.col("deposit"), F.col("files")), 4).alias("per_file"))


PER_FILE = "WITH n AS (SELECT project, count(DISTINCT rel) AS files FROM extracted_docs WHERE project IS NOT NULL GROUP BY 1) SELECT case_id, coalesce(files, 0) AS files, round(deposit / nullif(files, 0), 4) AS per_file FROM case_master LEFT JOIN n USING (project)"


def unequal(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews whose answer and expected answer hold one number each, and not the same: the difference."""
    g = table(spark, folder, "gold_100_review").select("review_id", V.only_number("system_answer").cast("decimal(30,6)").alias("a"), V.only_number("gold_v3").cast("decimal(30,6)").alias("b"))
    return g.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("review_id", F.col("a").cast("double").alias("answered"), F.col("b").cast("double").alias("expected"), F.abs(F.col("a") - F.col("b")).cast("double").alias("difference"))


UNEQUAL = f"""
WITH g AS (SELECT review_id, {NUMS.format(c='system_answer')} AS x, {NUMS.format(c='gold_v3')} AS y FROM gold_100_review), n AS (SELECT review_id, x[1]::DECIMAL(30,6) AS a, y[1]::DECIMAL(30,6) AS b FROM g WHERE len(x) = 1 AND len(y) = 1)
SELECT review_id, a::DOUBLE AS answered, b::DOUBLE AS expected, abs(a - b)::DOUBLE AS difference FROM n WHERE a <> b"""


def follow_ups(spark: SparkSession, folder: str) -> DataFrame:
    """Items that were answered wrongly on a day on which the same item was answered rightly in another record, by day."""
    g = table(spark, folder, "gold_100_review").filter("item_index IS NOT NULL AND run_at IS NOT NULL AND status IS NOT NULL").select("item_index", F.to_date("run_at").alias("day"), "status")
    per = g.groupBy("item_index", "day").agg(F.bool_or(F.col("status") == "WRONG").alias("wrong"), F.bool_or(F.col("status") == "MATCH").alias("right"))
    return per.filter("wrong").groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("items"), F.count_if("right").alias("also_right"), F.count_if(~F.col("right")).alias("still_open"))


FOLLOW_UPS = """
WITH p AS (SELECT item_index, strftime(run_at, '%Y-%m-%d') AS day, bool_or(status = 'WRONG') AS w, bool_or(status = 'MATCH') AS r FROM gold_100_review WHERE item_index IS NOT NULL AND run_at IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2)
SELECT day, count(*) AS items, count(*) FILTER (r) AS also_right, count(*) FILTER (NOT r) AS still_open FROM p WHERE w GROUP BY 1"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Answers written as a CSV of predictions and JSON lines of details, read again, and judged against what was expected."""
    out = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    g = table(spark, folder, "gold_100_review").select("review_id", "system_answer", "confidence", "status")
    g.select("review_id", F.coalesce("system_answer", F.lit("")).alias("answer")).write.option("header", "true").option("escape", '"').csv(f"{out}/predictions")
    g.select("review_id", "confidence", "status").write.json(f"{out}/details")
    p = files.delimited(spark, f"{out}/predictions").select(F.col("review_id").try_cast("long").alias("review_id"))
    d = spark.read.schema("review_id long, confidence string, status string").json(f"{out}/details")
    gold = table(spark, folder, "gold_100_review").select("review_id", "archetype")
    return p.filter("review_id IS NOT NULL").join(d, "review_id").join(gold, "review_id").groupBy("archetype", "status").agg(F.count("*").alias("n"), F.count("confidence").alias("with_confidence"))


PREDICTIONS = "SELECT archetype, status, count(*) AS n, count(confidence) AS with_confidence FROM gold_100_review GROUP BY 1, 2"


def text_store(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the documents written as a store, one part for each language, and read again by language."""
    out = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    d = spread(table(spark, folder, "documents")).select("doc_id", "lang", "text")
    rows = L.lines(d, "doc_id", "text", "lang")
    files.write_version(rows, out, ["doc_id", "line_no"], ["lang"])
    return files.read_latest(spark, out, rows.schema).groupBy("lang").agg(F.count("*").alias("lines"), F.count_distinct("doc_id").alias("docs"), F.max("line_no").alias("longest"))


TEXT_STORE = f"WITH {LINES.replace('nfc_normalize(text)', 'text')} SELECT lang, count(*) AS lines, count(DISTINCT doc_id) AS docs, max(line_no)::INT AS longest FROM lines JOIN documents USING (doc_id) GROUP BY 1"

QUERIES = {
    "cells_by_header": cells_by_header, "cells_changes": cell_changes, "evidence_by_colour": by_colour, "evidence_decorated": decorated, "evidence_crossings": crossings, "evidence_over_average": over_average,
    "stats_series_ends": series_ends, "lines_section_ids": section_ids, "search_fact_rows": fact_rows, "entity_amount_per_file": amount_per_file, "score_unequal": unequal, "entity_follow_ups": follow_ups,
    "source_predictions": predictions, "source_text_store": text_store,
}
ORACLE = {
    "cells_by_header": BY_HEADER, "cells_changes": CELL_CHANGES, "evidence_by_colour": BY_COLOUR, "evidence_decorated": DECORATED, "evidence_crossings": CROSSINGS, "evidence_over_average": OVER,
    "stats_series_ends": ENDS, "lines_section_ids": SECTION_IDS, "search_fact_rows": FACTS, "entity_amount_per_file": PER_FILE, "score_unequal": UNEQUAL, "entity_follow_ups": FOLLOW_UPS,
    "source_predictions": PREDICTIONS, "source_text_store": TEXT_STORE,
}
