"""Queries over projects, people, registrations and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftdocs.functions.text import iso_date, version_base, version_rank
from weftdocs.operators import joins as J
from weftdocs.operators.search import top
from weftdocs.operators.stats import unique_best
from weftdocs.session import table


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id, files, extension): registered files of each project by type, each once."""
    reg = table(spark, folder, "doc_registry").filter("case_id IS NOT NULL AND ext_id IS NOT NULL").select("case_id", "ext_id", F.lower("extension").alias("extension")).distinct()
    return reg.groupBy("case_id", "extension").agg(F.count("*").alias("files"))


def _staff(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "case_master").select("case_id", F.explode("staff").alias("role", "person"))


def people(spark: SparkSession, folder: str) -> DataFrame:
    """Projects and registered files of each person by way of the staff map, with roles in order."""
    files = _files(spark, folder).groupBy("case_id").agg(F.sum("files").alias("files"))
    staff = _staff(spark, folder)
    held = staff.select("case_id", "person").distinct().join(files, "case_id", "left").groupBy("person").agg(F.count("*").alias("cases"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))
    return held.join(staff.groupBy("person").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles")), "person")


STAFF_CTE = """s AS (SELECT case_id, unnest(map_entries(staff)) AS e FROM case_master), r AS (SELECT DISTINCT case_id, ext_id, lower(extension) AS extension FROM doc_registry WHERE case_id IS NOT NULL AND ext_id IS NOT NULL), x AS (SELECT case_id, extension, count(*) AS files FROM r GROUP BY 1, 2), f AS (SELECT case_id, sum(files) AS files FROM x GROUP BY 1)"""
PEOPLE = f"""
WITH {STAFF_CTE}, d AS (SELECT DISTINCT case_id, e.value AS person FROM s), h AS (SELECT person, count(*) AS cases, coalesce(sum(files), 0)::BIGINT AS files FROM d LEFT JOIN f USING (case_id) GROUP BY 1)
SELECT * FROM h JOIN (SELECT e.value AS person, array_to_string(list_sort(list_distinct(list(e.key))), ',') AS roles FROM s GROUP BY 1) USING (person)"""


def registered_text(spark: SparkSession, folder: str) -> DataFrame:
    """Extractions with their registration, only where they were registered once."""
    docs = table(spark, folder, "extracted_docs").select("ext_id", "kind")
    reg = table(spark, folder, "doc_registry").select("ext_id", "case_id", F.lower("extension").alias("extension"))
    return J.join_unique(docs, reg, ["ext_id"]).select("ext_id", "kind", "case_id", "extension")


REGISTERED = "WITH u AS (SELECT ext_id, any_value(case_id) AS case_id, any_value(lower(extension)) AS extension FROM doc_registry WHERE ext_id IS NOT NULL GROUP BY 1 HAVING count(*) = 1) SELECT ext_id, kind, case_id, extension FROM extracted_docs LEFT JOIN u USING (ext_id)"


def busiest_person(spark: SparkSession, folder: str) -> DataFrame:
    """Of each role, the person with most registered files in projects, and the type most of them have; none where two share the place."""
    owned = _staff(spark, folder).join(_files(spark, folder), "case_id")
    best = unique_best(owned.groupBy("role", "person").agg(F.sum("files").alias("files")), ["role"], "files")
    kinds = owned.groupBy("role", "person", "extension").agg(F.sum("files").alias("n")).groupBy("role", "person").agg(F.max_by("extension", F.struct("n", "extension")).alias("extension"))
    return best.join(kinds, ["role", "person"])


BUSIEST = f"""
WITH {STAFF_CTE}, o AS (SELECT e.key AS role, e.value AS person, extension, sum(files) AS n FROM s JOIN x USING (case_id) GROUP BY 1, 2, 3), p AS (SELECT role, person, sum(n) AS files FROM o GROUP BY 1, 2), m AS (SELECT * FROM p QUALIFY files = max(files) OVER (PARTITION BY role)),
u AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY role) = 1), k AS (SELECT role, person, extension FROM o QUALIFY row_number() OVER (PARTITION BY role, person ORDER BY n DESC, extension DESC) = 1)
SELECT role, person, files::BIGINT AS files, extension FROM u JOIN k USING (role, person)"""


def long_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose shipping period meets the first half of 1995 and lasts more than 30 days."""
    li = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("s"), F.max("l_shipdate").alias("e"))
    hit = J.overlapping(li, "s", "e", F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-06-30").cast("timestamp_ntz"), 30)
    return hit.select("l_orderkey", F.datediff("e", "s").alias("days"))


LONG_ORDERS = "WITH p AS (SELECT l_orderkey, min(l_shipdate) AS s, max(l_shipdate) AS e FROM lineitem GROUP BY 1) SELECT l_orderkey, date_diff('day', s, e)::INT AS days FROM p WHERE s <= TIMESTAMP '1995-06-30' AND e >= TIMESTAMP '1995-01-01' AND date_diff('day', s, e) > 30"


def largest_deposit_contact(spark: SparkSession, folder: str) -> DataFrame:
    """Of each type of file, the project of the largest deposit that has registered one, and its people, by a chained look-up; nothing on a tie."""
    cases = table(spark, folder, "case_master").filter("deposit IS NOT NULL").select("case_id", "deposit")
    best = unique_best(_files(spark, folder).join(cases, "case_id"), ["extension"], "deposit")
    return best.join(_staff(spark, folder), "case_id").select("extension", "case_id", "deposit", "files", "role", "person")


DEPOSIT = f"""
WITH {STAFF_CTE}, c AS (SELECT x.*, deposit FROM x JOIN case_master USING (case_id) WHERE deposit IS NOT NULL), m AS (SELECT * FROM c QUALIFY deposit = max(deposit) OVER (PARTITION BY extension)), u AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY extension) = 1)
SELECT extension, case_id, deposit, files, e.key AS role, e.value AS person FROM u JOIN s USING (case_id)"""


def regions_reached(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of a customer's nation and of the nations of its suppliers, once each, counted by segment."""
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment", F.col("c_nationkey").alias("nation"))
    own = c.join(F.broadcast(nation), "nation").select("key", F.lit(None).cast("int").alias("nation"), "region")
    o = table(spark, folder, "orders").join(table(spark, folder, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    through = o.select(F.col("o_custkey").alias("key"), F.col("s_nationkey").alias("nation"), F.lit(None).cast("int").alias("region")).distinct()
    reached = J.two_hops(c.select("key"), own.unionByName(through), F.broadcast(nation), "key", "nation", "region")
    return reached.join(c, "key").groupBy("c_mktsegment", "region").agg(F.count("*").alias("customers"))


REGIONS = """
WITH own AS (SELECT c_custkey AS key, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT DISTINCT o_custkey AS key, n_regionkey AS region FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT key, region FROM own UNION SELECT t.key, t.region FROM t JOIN customer ON t.key = c_custkey)
SELECT c_mktsegment, region, count(*) AS customers FROM r JOIN customer ON key = c_custkey GROUP BY 1, 2"""


def cell_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence cells of one file right beside or below each other."""
    e = table(spark, folder, "evidence_rows").filter("cell IS NOT NULL AND file IS NOT NULL").dropDuplicates(["ev_id"])
    c, r = J.grid_place("cell")
    cells = e.select("file", "ev_id", c.alias("c"), r.alias("r")).filter("c > 0 AND r IS NOT NULL")
    return J.beside(cells, ["file"], "ev_id", [(1, 0), (0, 1)])


CELL_NEIGHBOURS = """
WITH e AS (SELECT DISTINCT ON (ev_id) file, ev_id, upper(cell) AS cell FROM evidence_rows WHERE cell IS NOT NULL AND file IS NOT NULL),
c AS (SELECT file, ev_id, regexp_extract(cell, '^([A-Z]{1,3})[0-9]+$', 1) AS l, regexp_extract(cell, '([0-9]+)$', 1)::INT AS r FROM e WHERE regexp_matches(cell, '^[A-Z]{1,3}[0-9]+$')),
p AS (SELECT file, ev_id, r, list_reduce(list_prepend(0, list_transform(string_split(l, ''), lambda x: ascii(x) - 64)), lambda s, d: s * 26 + d) AS c FROM c)
SELECT a.file, a.ev_id, b.ev_id AS neighbour FROM p a JOIN p b ON a.file = b.file AND ((b.c = a.c + 1 AND b.r = a.r) OR (b.c = a.c AND b.r = a.r + 1))"""


def file_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Families of files that differ in their version mark only: first and last version of each."""
    files = table(spark, folder, "extracted_docs").filter("project IS NOT NULL").select("project", "name", "rel").distinct()
    keyed = files.withColumn("base", F.regexp_replace(version_base("name"), "[0-9]{9}", "")).withColumn("rank", version_rank("name"))
    fam = keyed.groupBy("project", "base").agg(F.count("*").alias("files"), F.min(F.struct("rank", "rel")).alias("a"), F.max(F.struct("rank", "rel")).alias("b"))
    return fam.filter("a.rank < b.rank").select("project", "base", "files", F.col("a.rel").alias("first_rel"), F.col("b.rel").alias("last_rel"))


FILE_VERSIONS = r"""
WITH f AS (SELECT DISTINCT project, name, rel FROM extracted_docs WHERE project IS NOT NULL), s AS (SELECT *, lower(regexp_replace(name, '\.[A-Za-z0-9]+$', '')) AS st FROM f),
k AS (SELECT *, regexp_replace(trim(regexp_replace(st, '(_old|_final|_v[0-9]+|[ _]?改訂-[0-9]+| rev-[0-9]+)', '', 'g')), '[0-9]{9}', '', 'g') AS base,
  CASE WHEN contains(st, '_old') THEN -1 WHEN contains(st, '_final') THEN 10000 ELSE coalesce(try_cast(regexp_extract(st, '(?:_v|改訂-| rev-)([0-9]+)', 1) AS INT), 0) END AS rank FROM s),
g AS (SELECT project, base, count(*) AS files, min({'rank': rank, 'rel': rel}) AS a, max({'rank': rank, 'rel': rel}) AS b FROM k GROUP BY 1, 2)
SELECT project, base, files, a.rel AS first_rel, b.rel AS last_rel FROM g WHERE a.rank < b.rank"""


def run_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Statuses of one review run against the one before, by question: added, removed, modified."""
    g = J.latest(table(spark, folder, "gold_100_review"), ["run_no", "item_index"], F.desc("review_id")).select("run_no", "item_index", "status")
    old = g.withColumn("run_no", F.col("run_no") + 1)
    runs = g.agg(F.min("run_no").alias("lo"), F.max("run_no").alias("hi"))  # one row
    return J.compare(old, g, ["run_no", "item_index"], "status").join(F.broadcast(runs), (F.col("run_no") > F.col("lo")) & (F.col("run_no") <= F.col("hi"))).groupBy("run_no", "change").agg(F.count("*").alias("n"))


RUN_CHANGES = """
WITH g AS (SELECT run_no, item_index, status FROM gold_100_review QUALIFY row_number() OVER (PARTITION BY run_no, item_index ORDER BY review_id DESC) = 1),
o AS (SELECT run_no + 1 AS run_no, item_index, status, 1 AS a FROM g), n AS (SELECT *, 1 AS b FROM g),
c AS (SELECT run_no, CASE WHEN a IS NULL THEN 'add' WHEN b IS NULL THEN 'remove' WHEN o.status IS DISTINCT FROM n.status THEN 'modify' END AS change FROM o FULL JOIN n USING (run_no, item_index))
SELECT run_no, change, count(*) AS n FROM c WHERE change IS NOT NULL AND run_no > (SELECT min(run_no) FROM g) AND run_no <= (SELECT max(run_no) FROM g) GROUP BY 1, 2"""


def solved_between_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Questions wrong in one run and right in the next, by run."""
    g = J.latest(table(spark, folder, "gold_100_review"), ["run_no", "item_index"], F.desc("review_id")).select("run_no", "item_index", "status")
    wrong = g.filter("status = 'WRONG'").select((F.col("run_no") + 1).alias("run_no"), "item_index")
    return g.filter("status = 'MATCH'").join(wrong, ["run_no", "item_index"], "left_semi").groupBy("run_no").agg(F.count("*").alias("solved"))


SOLVED = "WITH g AS (SELECT run_no, item_index, status FROM gold_100_review QUALIFY row_number() OVER (PARTITION BY run_no, item_index ORDER BY review_id DESC) = 1) SELECT a.run_no, count(*) AS solved FROM g a JOIN g b ON b.run_no + 1 = a.run_no AND b.item_index = a.item_index WHERE a.status = 'MATCH' AND b.status = 'WRONG' GROUP BY 1"


def reloaded_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Files extracted again: how often, and whether the text stayed the same."""
    d = table(spark, folder, "extracted_docs").select("rel", "ext_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    g = d.groupBy("rel").agg(F.count("*").alias("times"), F.count_distinct("h").alias("texts"), F.max("ext_id").alias("last_id"))
    return g.filter("times > 1").select("rel", "times", (F.col("texts") == 1).alias("same"), "last_id")


RELOADED = "SELECT rel, count(*) AS times, count(DISTINCT md5(coalesce(text, ''))) = 1 AS same, max(ext_id) AS last_id FROM extracted_docs GROUP BY 1 HAVING count(*) > 1"


def dated_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by the month of the first full date in their text."""
    d = table(spark, folder, "documents").select("doc_id", iso_date("text").alias("d")).filter("d IS NOT NULL")
    return d.groupBy(F.year("d").alias("y"), F.month("d").alias("m")).agg(F.count("*").alias("docs"))


DATED = """
WITH d AS (SELECT regexp_extract(text, '([0-9]{4})[-/年]([0-9]{1,2})[-/月]([0-9]{1,2})', ['y', 'm', 'd']) AS p FROM documents), t AS (SELECT try_cast(p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') AS DATE) AS d FROM d WHERE p.y <> '')
SELECT year(d)::INT AS y, month(d)::INT AS m, count(*) AS docs FROM t WHERE d IS NOT NULL GROUP BY 1, 2"""


def ordered_union(spark: SparkSession, folder: str) -> DataFrame:
    """Owners named in evidence and staff lists, each once, in order of first appearance by source."""
    e = table(spark, folder, "evidence_rows").filter("ev_type = 'person' AND trim(ev_value) <> ''").select(F.trim("ev_value").alias("name"), F.lit(1).alias("source"), F.col("ev_id").alias("place"))
    s = table(spark, folder, "case_master").select(F.explode(F.map_values("staff")).alias("name"), F.lit(2).alias("source"), F.lit(0).cast("bigint").alias("place"))
    return e.unionByName(s).groupBy("name").agg(F.min(F.struct("source", "place")).alias("f")).select("name", F.col("f.source").alias("source"), F.col("f.place").alias("place"))


ORDERED_UNION = """
WITH e AS (SELECT trim(ev_value) AS name, 1 AS source, ev_id AS place FROM evidence_rows WHERE ev_type = 'person' AND trim(ev_value) <> ''), s AS (SELECT unnest(map_values(staff)) AS name, 2 AS source, 0::BIGINT AS place FROM case_master),
u AS (SELECT * FROM e UNION ALL SELECT * FROM s) SELECT name, source, place FROM u QUALIFY row_number() OVER (PARTITION BY name ORDER BY source, place) = 1"""


def round_robin(spark: SparkSession, folder: str) -> DataFrame:
    """A balanced sample of 60 reviewed questions: archetypes take turns."""
    g = table(spark, folder, "gold_100_review").filter("archetype IS NOT NULL")
    turn = F.row_number().over(Window.partitionBy("archetype").orderBy("review_id"))
    return top(g.select("archetype", "review_id", turn.alias("turn")), 60, "turn", "archetype")


ROUND_ROBIN = "SELECT archetype, review_id, row_number() OVER (PARTITION BY archetype ORDER BY review_id)::INT AS turn FROM gold_100_review WHERE archetype IS NOT NULL ORDER BY turn, archetype LIMIT 60"

QUERIES = {
    "entity_people": people, "entity_registered_text": registered_text, "entity_busiest_person": busiest_person, "entity_interval_overlap": long_orders, "entity_deposit_chain": largest_deposit_contact,
    "entity_two_hops": regions_reached, "entity_cell_neighbours": cell_neighbours, "entity_file_versions": file_versions, "entity_run_changes": run_changes, "entity_solved_between_runs": solved_between_runs,
    "entity_reloaded_texts": reloaded_texts, "entity_dated_documents": dated_lines, "entity_ordered_union": ordered_union, "entity_round_robin": round_robin,
}
ORACLE = {
    "entity_people": PEOPLE, "entity_registered_text": REGISTERED, "entity_busiest_person": BUSIEST, "entity_interval_overlap": LONG_ORDERS, "entity_deposit_chain": DEPOSIT, "entity_two_hops": REGIONS,
    "entity_cell_neighbours": CELL_NEIGHBOURS, "entity_file_versions": FILE_VERSIONS, "entity_run_changes": RUN_CHANGES, "entity_solved_between_runs": SOLVED, "entity_reloaded_texts": RELOADED,
    "entity_dated_documents": DATED, "entity_ordered_union": ORDERED_UNION, "entity_round_robin": ROUND_ROBIN,
}
