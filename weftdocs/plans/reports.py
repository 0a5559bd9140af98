"""Queries over changes, scopes, contexts, tables in texts, bands and spans, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftdocs.functions import values as V
from weftdocs.functions.text import version_rank
from weftdocs.operators import diff as D
from weftdocs.operators import lines as L
from weftdocs.operators import search as S
from weftdocs.operators import stats as M
from weftdocs.plans.documents import PAIRS, version_pairs_of
from weftdocs.plans.search import BM25_ALL, DENSE_CTE, LINES, QUERY, composed_chunks, dense_lists, doc_lines
from weftdocs.session import spread, table

CHANGE_CTE = (
    PAIRS
    + r""", t AS (SELECT ext_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM extracted_docs), l AS (SELECT ext_id, unnest(parts) AS line FROM t), n AS (SELECT ext_id, line, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY 1, 2),
u AS (SELECT old, new, line, -n AS d FROM p JOIN n ON n.ext_id = old UNION ALL SELECT old, new, line, n FROM p JOIN n ON n.ext_id = new WHERE old IS NOT NULL),
d AS (SELECT old, new, line, sum(d) AS d FROM u GROUP BY 1, 2, 3 HAVING sum(d) <> 0)"""
)


def _changes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "extracted_docs")
    pairs = version_pairs_of(docs)
    return pairs, D.changed_lines(pairs, docs, "ext_id", "text")


def ranked_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changed lines of each pair of versions, substantive ones first; how long a line is does not matter. The first five of each pair."""
    _, c = _changes(spark, folder)
    scored = c.select("old", "new", "line", "change", V.change_score("line").alias("s")).select("old", "new", "line", "change", "s.*")
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("old", "new").orderBy(F.desc("rank"), F.desc("score"), "line", "change")))
    return ranked.filter("place <= 5").select("old", "new", "place", "change", "intent", "score", F.md5("line").alias("line"))


SCORED = (
    "x AS (SELECT old, new, line, CASE WHEN d > 0 THEN 'add' ELSE 'remove' END AS change, regexp_matches(trim(line), '" + V.BOILERPLATE + "') AS b, "
    + " + ".join(f"regexp_matches(line, '{p}')::INT" for p in V.TAGS.values())
    + " AS k FROM d), y AS (SELECT *, CASE WHEN b THEN 'boilerplate' WHEN k > 0 THEN 'substantive' ELSE 'wording' END AS intent, CASE WHEN b THEN 0 WHEN k > 0 THEN 2 ELSE 1 END AS rank, CASE WHEN b THEN 0 ELSE k END AS score FROM x)"
)
RANKED = f"""
WITH {CHANGE_CTE}, {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY old, new ORDER BY rank DESC, score DESC, line, change) AS place FROM y)
SELECT old, new, place, change, intent, score, md5(line) AS line FROM r WHERE place <= 5"""


def pair_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each pair of versions: lines added and removed, substantive ones, whether the versions are next to each other, and whether one change is all."""
    pairs, c = _changes(spark, folder)
    docs = table(spark, folder, "extracted_docs").select("ext_id", version_rank("name").alias("rank"))
    per = c.select("old", "new", "change", "times", V.change_score("line").alias("s")).groupBy("old", "new").agg(
        F.sum(F.when(F.col("change") == "add", F.col("times")).otherwise(0)).alias("added"), F.sum(F.when(F.col("change") == "remove", F.col("times")).otherwise(0)).alias("removed"), F.count_if(F.col("s.intent") == "substantive").alias("substantive")
    )
    ranked = pairs.join(docs.select(F.col("ext_id").alias("old"), F.col("rank").alias("a")), "old").join(docs.select(F.col("ext_id").alias("new"), F.col("rank").alias("b")), "new")
    r = ranked.join(per, ["old", "new"], "left")
    n = lambda x: F.coalesce(F.col(x), F.lit(0))
    return r.select("old", "new", n("added").alias("added"), n("removed").alias("removed"), n("substantive").alias("substantive"), (F.col("b") - F.col("a") <= 1).alias("adjacent"), (n("substantive") == 1).alias("single"))


RANK_SQL = "CASE WHEN contains({c}, '_old') THEN -1 WHEN contains({c}, '_final') THEN 10000 ELSE coalesce(try_cast(regexp_extract({c}, '(?:_v|改訂-| rev-)([0-9]+)', 1) AS INT), 0) END"
RECORDS = f"""
WITH {CHANGE_CTE}, {SCORED}, g AS (SELECT old, new, sum(CASE WHEN change = 'add' THEN abs(z.d) ELSE 0 END) AS added, sum(CASE WHEN change = 'remove' THEN abs(z.d) ELSE 0 END) AS removed, count(*) FILTER (intent = 'substantive') AS substantive
  FROM y JOIN d z USING (old, new, line) GROUP BY 1, 2), k AS (SELECT ext_id, {RANK_SQL.format(c='st')} AS rank FROM s)
SELECT p.old, p.new, coalesce(added, 0)::BIGINT AS added, coalesce(removed, 0)::BIGINT AS removed, coalesce(substantive, 0) AS substantive, b.rank - a.rank <= 1 AS adjacent, coalesce(substantive, 0) = 1 AS single
FROM p JOIN k a ON a.ext_id = p.old JOIN k b ON b.ext_id = p.new LEFT JOIN g ON g.old = p.old AND g.new = p.new"""


def lost_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of versions in which all table rows of the older one are gone, four cells or more: one record instead of a change for each row."""
    docs = table(spark, folder, "extracted_docs")
    cells = L.lines(docs, "ext_id", "text").filter(F.col("line").contains(" | ")).select("ext_id", F.md5("line").alias("h"), F.size(F.split("line", r" \| ")).alias("cells"))
    pairs = version_pairs_of(docs)
    before = pairs.join(cells.withColumnRenamed("ext_id", "old"), "old")
    kept = before.join(cells.select(F.col("ext_id").alias("new"), "h").distinct(), ["new", "h"], "left_semi").select("old", "new").distinct()
    return before.groupBy("old", "new").agg(F.count("*").alias("rows"), F.sum("cells").alias("cells")).join(kept, ["old", "new"], "left_anti").filter("cells >= 4")


LOST = f"""
WITH {PAIRS}, t AS (SELECT ext_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM extracted_docs), c AS (SELECT ext_id, line, len(string_split(line, ' | ')) AS cells FROM t WHERE contains(line, ' | ')),
b AS (SELECT p.old, p.new, c.line, c.cells, EXISTS (SELECT 1 FROM c e WHERE e.ext_id = p.new AND e.line = c.line) AS kept FROM p JOIN c ON c.ext_id = p.old)
SELECT old, new, count(*) AS rows, sum(cells)::BIGINT AS cells FROM b GROUP BY 1, 2 HAVING NOT bool_or(kept) AND sum(cells) >= 4"""


def header_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The first header row after each sheet mark: its columns, in order."""
    rows = L.carried_context(doc_lines(spark, folder), "doc_id").filter("marker = 'sheet'")
    head = rows.filter(F.col("line").contains(" | ") & ~F.col("line").rlike("[0-9]"))
    return head.groupBy("doc_id", "marker_no").agg(F.min_by("line", "line_no").alias("header"), F.min("line_no").alias("line_no")).select("doc_id", "marker_no", "line_no", F.size(F.split("header", r" \| ")).alias("columns"), "header")


HEADERS = f"""
WITH {LINES}, m AS (SELECT *, CASE WHEN regexp_matches(line, '^\\[(page|sheet|slide)([0-9]+)\\]') THEN regexp_extract(line, '^\\[(page|sheet|slide)([0-9]+)\\]', ['k', 'n']) END AS mark FROM lines),
c AS (SELECT doc_id, line_no, line, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS m FROM m),
h AS (SELECT doc_id, m.n::INT AS marker_no, min(line_no)::INT AS line_no, arg_min(line, line_no) AS header FROM c WHERE m.k = 'sheet' AND contains(line, ' | ') AND NOT regexp_matches(line, '[0-9]') GROUP BY 1, 2)
SELECT doc_id, marker_no, line_no, len(string_split(header, ' | '))::INT AS columns, header FROM h"""


def _tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Task rows of pipe tables: (doc_id, line_no, task, item, third, number)."""
    return _task_rows(doc_lines(spark, folder))


def _task_rows(lines: DataFrame) -> DataFrame:
    rows = lines.select("doc_id", "line_no", F.split("line", r" \| ").alias("c")).filter("size(c) = 4 AND c[0] RLIKE '^T[0-9]+$'")
    return rows.select("doc_id", "line_no", F.col("c")[0].alias("task"), F.col("c")[1].alias("item"), F.col("c")[2].alias("third"), F.col("c")[3].alias("number"))


TASKS = f"{LINES}, r AS (SELECT doc_id, line_no, string_split(line, ' | ') AS c FROM lines), tasks AS (SELECT doc_id, line_no, c[1] AS task, c[2] AS item, c[3] AS third, c[4] AS number FROM r WHERE len(c) = 4 AND regexp_matches(c[1], '^T[0-9]+$'))"


def last_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Of each item, the task that starts last, the later row on a tie."""
    rows = L.lines(spread(table(spark, folder, "extracted_docs")), "ext_id", "text").withColumnRenamed("ext_id", "doc_id")
    t = _task_rows(rows).withColumn("m", F.regexp_extract("third", "([0-9]{1,2})月([0-9]{1,2})日", 1).try_cast("int")).withColumn("d", F.regexp_extract("third", "([0-9]{1,2})月([0-9]{1,2})日", 2).try_cast("int"))
    start = F.col("m") * 100 + F.col("d")
    return t.filter("m IS NOT NULL").withColumn("start", start).groupBy("item").agg(F.max_by("task", F.struct("start", "doc_id", "line_no")).alias("task"), F.max("start").alias("start"), F.count("*").alias("tasks"))


LAST_TASKS = rf"""
WITH {TASKS.replace("documents", "extracted_docs").replace("doc_id", "ext_id")}, d AS (SELECT *, try_cast(regexp_extract(third, '([0-9]{{1,2}})月([0-9]{{1,2}})日', 1) AS INT) * 100 + try_cast(regexp_extract(third, '([0-9]{{1,2}})月([0-9]{{1,2}})日', 2) AS INT) AS start FROM tasks)
SELECT item, arg_max(task, start * 100000000000000::HUGEINT + ext_id * 1000000 + line_no) AS task, max(start) AS start, count(*) AS tasks FROM d WHERE start IS NOT NULL GROUP BY 1"""


def role_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks whose owner holds the role 監査 or レビュー in some project, by owner."""
    holders = table(spark, folder, "case_master").select(F.explode("staff").alias("role", "person")).filter(F.col("role").isin("監査", "レビュー")).select(F.concat("person", F.lit("さん")).alias("owner")).distinct()
    owned = _tasks(spark, folder).select("doc_id", "task", F.explode(F.split("third", "、")).alias("owner"))
    return owned.join(F.broadcast(holders), "owner", "left_semi").groupBy("owner").agg(F.count("*").alias("tasks"), F.count_distinct("doc_id").alias("docs"))  # a person has one row


ROLE_TASKS = f"""
WITH {TASKS}, h AS (SELECT DISTINCT e.value || 'さん' AS owner FROM (SELECT unnest(map_entries(staff)) AS e FROM case_master) WHERE e.key IN ('監査', 'レビュー')), o AS (SELECT doc_id, unnest(string_split(third, '、')) AS owner FROM tasks)
SELECT owner, count(*) AS tasks, count(DISTINCT doc_id) AS docs FROM o SEMI JOIN h USING (owner) GROUP BY 1"""


def owner_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by the set of owners that their tasks have, in order of name."""
    owners = _tasks(spark, folder).filter(F.col("third").endswith("さん")).select("doc_id", F.explode(F.split("third", "、")).alias("owner")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("owner")), "+").alias("owners"))
    return owners.groupBy("owners").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


OWNER_SETS = f"""
WITH {TASKS}, o AS (SELECT doc_id, unnest(string_split(third, '、')) AS owner FROM tasks WHERE ends_with(third, 'さん')), s AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(owner))), '+') AS owners FROM o GROUP BY 1)
SELECT owners, count(*) AS docs, min(doc_id) AS first_doc FROM s GROUP BY 1"""


def parameters_without_column(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters set in a document that no table header of the same document names as a column."""
    p = doc_lines(spark, folder).select("doc_id", F.regexp_extract("line", "^([A-Za-z_][A-Za-z0-9_]*) = ", 1).alias("name")).filter("name <> ''").distinct()
    heads = doc_lines(spark, folder).filter(F.col("line").contains(" | ") & ~F.col("line").rlike("[0-9]"))
    columns = heads.select("doc_id", F.explode(F.split("line", r" \| ")).alias("name")).distinct()
    return p.join(columns, ["doc_id", "name"], "left_anti").groupBy("name").agg(F.count("*").alias("docs"))


WITHOUT_COLUMN = f"""
WITH {LINES}, p AS (SELECT DISTINCT doc_id, regexp_extract(line, '^([A-Za-z_][A-Za-z0-9_]*) = ', 1) AS name FROM lines)
SELECT name, count(*) AS docs FROM p ANTI JOIN (SELECT DISTINCT doc_id, unnest(string_split(line, ' | ')) AS name FROM lines WHERE contains(line, ' | ') AND NOT regexp_matches(line, '[0-9]')) USING (doc_id, name) WHERE name <> '' GROUP BY 1"""


def scopes(spark: SparkSession, folder: str) -> DataFrame:
    """What a question is about: the file it names by number, else the project it names, either way round or by an alias, if it is one only, else all; and how many files that are."""
    q = table(spark, folder, "gold_100_review").filter("question IS NOT NULL").select("review_id", "question", F.regexp_extract("question", "([0-9]{9})", 1).alias("number"))
    files = table(spark, folder, "extracted_docs").select("rel", "project", F.regexp_extract("name", "([0-9]{9})", 1).alias("number")).distinct()
    by_number = files.filter("number <> ''").groupBy("number").agg(F.count_distinct("rel").alias("named"))
    names = table(spark, folder, "case_master").select("project", F.explode(F.concat(F.array("project"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))  # 40 projects at every size
    one = q.join(F.broadcast(names), F.contains("question", "alias") | F.contains("alias", "question")).groupBy("review_id").agg(F.count_distinct("project").alias("k"), F.min("project").alias("project")).filter("k = 1").drop("k")
    by_project = files.filter("project IS NOT NULL").groupBy("project").agg(F.count_distinct("rel").alias("held"))
    every = files.agg(F.count_distinct("rel").alias("all_files"))  # one row
    found = q.join(by_number, "number", "left").join(one, "review_id", "left").join(by_project, "project", "left").crossJoin(F.broadcast(every))
    return found.select("review_id", F.when(F.col("named").isNotNull(), "file").when(F.col("held").isNotNull(), "project").otherwise("all").alias("scope"), F.coalesce("named", "held", "all_files").alias("files"))


SCOPES = """
WITH q AS (SELECT review_id, question, regexp_extract(question, '([0-9]{9})', 1) AS number FROM gold_100_review WHERE question IS NOT NULL), f AS (SELECT DISTINCT rel, project, regexp_extract(name, '([0-9]{9})', 1) AS number FROM extracted_docs),
n AS (SELECT number, count(DISTINCT rel) AS named FROM f WHERE number <> '' GROUP BY 1), a AS (SELECT project, unnest(list_concat([project], coalesce(aliases, []))) AS alias FROM case_master),
o AS (SELECT review_id, min(project) AS project FROM q JOIN a ON contains(question, alias) OR contains(alias, question) GROUP BY 1 HAVING count(DISTINCT project) = 1), p AS (SELECT project, count(DISTINCT rel) AS held FROM f WHERE project IS NOT NULL GROUP BY 1)
SELECT review_id, CASE WHEN named IS NOT NULL THEN 'file' WHEN held IS NOT NULL THEN 'project' ELSE 'all' END AS scope, coalesce(named, held, (SELECT count(DISTINCT rel) FROM f)) AS files FROM q LEFT JOIN n USING (number) LEFT JOIN o USING (review_id) LEFT JOIN p ON p.project = o.project"""


def found_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files by a part of the name, a type and a project, the first 30."""
    d = table(spark, folder, "extracted_docs").filter(F.contains(F.lower("name"), F.lit("notes")) & (F.lower("ext") == "docx") & F.col("project").isNotNull())
    return S.top(d.select("project", "rel").distinct(), 30, "project", "rel")


FOUND_FILES = "SELECT DISTINCT project, rel FROM extracted_docs WHERE contains(lower(name), 'notes') AND lower(ext) = 'docx' AND project IS NOT NULL ORDER BY project, rel LIMIT 30"


def with_context(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best chunks, the chunks next to them, each once, and of each found file its two next best chunks."""
    chunks = composed_chunks(spark, folder)
    scored = S.bm25(chunks, ["id"], "text", QUERY).join(table(spark, folder, "chunks").select("id", "rel"), "id").filter("rel IS NOT NULL")
    chosen = S.top(scored, 20, F.desc("score"), "id")
    beside = S.neighbours(table(spark, folder, "chunks").filter("rel IS NOT NULL"), "id", "rel", F.col("kind") == "fact")
    near = chosen.join(beside, "id").select(F.explode(F.array("before", "after")).alias("id")).filter("id IS NOT NULL").distinct().join(chosen, "id", "left_anti")
    rest = scored.join(chosen.select("rel").distinct(), "rel", "left_semi").join(chosen.select("id"), "id", "left_anti")
    siblings = L.capped(rest, ["rel"], [F.desc("score"), "id"], 2)
    part = lambda df, role: df.select("id", F.lit(role).alias("role"))
    return part(chosen, "hit").unionByName(part(near, "beside")).unionByName(part(siblings, "sibling"))


def context_sql(bm25: str) -> str:
    return f"""
WITH b AS ({bm25}), s AS (SELECT b.id, score, rel FROM b JOIN chunks USING (id) WHERE rel IS NOT NULL), c AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 20),
r AS (SELECT *, sum((kind = 'fact')::INT) OVER (PARTITION BY rel ORDER BY id) AS run FROM chunks WHERE rel IS NOT NULL), n AS (SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after FROM r WHERE kind <> 'fact' WINDOW w AS (PARTITION BY rel, run ORDER BY id)),
e AS (SELECT DISTINCT unnest([before, after]) AS id FROM n SEMI JOIN c USING (id)), g AS (SELECT id FROM s WHERE rel IN (SELECT rel FROM c) AND id NOT IN (SELECT id FROM c) QUALIFY row_number() OVER (PARTITION BY rel ORDER BY score DESC, id) <= 2)
SELECT id, 'hit' AS role FROM c UNION ALL SELECT id, 'beside' FROM e WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM c) UNION ALL SELECT id, 'sibling' FROM g"""


def recall_at(spark: SparkSession, folder: str) -> DataFrame:
    """For how many of the asked chunks a chunk of the same project is among the first k of their list, for some k."""
    about = table(spark, folder, "chunks").select("id", "project").filter("project IS NOT NULL")
    lists = dense_lists(spark, folder, 21).filter("query <> id")
    judged = lists.join(about, "id").join(about.select(F.col("id").alias("query"), F.col("project").alias("own")), "query").withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank")))
    first = judged.groupBy("query").agg(F.min(F.when(F.col("project") == F.col("own"), F.col("place"))).alias("first"))
    ks = F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10)])).alias("k")
    return first.select("query", "first", ks).groupBy("k").agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(F.col("first") <= F.col("k"), F.lit(False)).cast("double")), 6).alias("recall"))


RECALL_AT = f"""
WITH {DENSE_CTE.format(k=21)}, j AS (SELECT query, dense.id, c.project = o.project AS same, row_number() OVER (PARTITION BY query ORDER BY dense.rank) AS place FROM dense JOIN chunks c ON c.id = dense.id JOIN chunks o ON o.id = query WHERE query <> dense.id AND c.project IS NOT NULL AND o.project IS NOT NULL),
f AS (SELECT query, min(place) FILTER (same) AS first FROM j GROUP BY 1) SELECT k, count(*) AS queries, round(avg(coalesce(first <= k, false)::INT), 6) AS recall FROM f, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY 1"""


def grounded(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence whose value stands in the text of its file, by type; the rest is not supported by its source."""
    e = table(spark, folder, "evidence_rows").dropDuplicates(["ev_id"]).select("ev_id", "ev_type", "rel", F.trim("ev_value").alias("v")).filter("v <> ''")
    texts = table(spark, folder, "extracted_docs").filter("text <> ''").groupBy("rel").agg(F.max_by("text", "ext_id").alias("text"))
    j = e.join(texts, "rel", "left").withColumn("held", F.coalesce(F.contains("text", "v"), F.lit(False)))
    return j.groupBy("ev_type").agg(F.count("*").alias("n"), F.count("text").alias("with_text"), F.count_if("held").alias("held"))


GROUNDED = """
WITH e AS (SELECT DISTINCT ON (ev_id) ev_id, ev_type, rel, regexp_replace(ev_value, '^ +| +$', '', 'g') AS v FROM evidence_rows), t AS (SELECT rel, arg_max(text, ext_id) AS text FROM extracted_docs WHERE text <> '' GROUP BY 1)
SELECT ev_type, count(*) AS n, count(text) AS with_text, count(*) FILTER (coalesce(contains(text, v), false)) AS held FROM e LEFT JOIN t USING (rel) WHERE v <> '' GROUP BY 1"""


def image_only(spark: SparkSession, folder: str) -> DataFrame:
    """Files of pages whose text layer is nearly empty: fewer than 20 letters or digits once marks of pages are gone."""
    d = table(spark, folder, "extracted_docs").filter(F.col("kind").isin("pdf", "image"))
    n = F.length(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\[(?:ページ ?|page|slide)[0-9]+\]", ""), r"[\s|]+", ""))
    return d.groupBy("kind").agg(F.count("*").alias("files"), F.count_if(n < 20).alias("image_only"))


IMAGE_ONLY = r"SELECT kind, count(*) AS files, count(*) FILTER (length(regexp_replace(regexp_replace(coalesce(text, ''), '\[(?:ページ ?|page|slide)[0-9]+\]', '', 'g'), '[\s|]+', '', 'g')) < 20) AS image_only FROM extracted_docs WHERE kind IN ('pdf', 'image') GROUP BY 1"


def ids_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Different identifiers by kind and in all, only where every kind occurs."""
    kinds = {"task": "T[0-9]{2}", "record": "KR-[0-9]{9}", "cell": "[A-Z][0-9]{1,3}\\("}
    rows = L.lines(spread(table(spark, folder, "extracted_docs")), "ext_id", "text")
    found = F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*[F.regexp_extract_all("line", F.lit(p), F.lit(0)) for p in kinds.values()])))
    ids = rows.select(found.alias("kind", "found")).select("kind", F.explode("found").alias("id")).distinct()
    per = ids.rollup("kind").agg(F.count("*").alias("ids"))
    seen = per.filter("kind IS NOT NULL").agg(F.count("*").alias("k"))  # one row
    return per.crossJoin(F.broadcast(seen)).filter(F.col("k") == len(kinds)).select(F.coalesce("kind", F.lit("total")).alias("kind"), "ids")


IDS_BY_KIND = f"""
WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM extracted_docs), i AS (SELECT DISTINCT 'task' AS kind, unnest(regexp_extract_all(line, 'T[0-9]{{2}}')) AS id FROM lines UNION SELECT 'record', unnest(regexp_extract_all(line, 'KR-[0-9]{{9}}')) FROM lines UNION SELECT 'cell', unnest(regexp_extract_all(line, '[A-Z][0-9]{{1,3}}\\(')) FROM lines)
SELECT coalesce(kind, 'total') AS kind, count(*) AS ids FROM i WHERE (SELECT count(DISTINCT kind) FROM i) = 3 GROUP BY ROLLUP (kind) HAVING count(*) > 0"""


def votes(spark: SparkSession, folder: str) -> DataFrame:
    """People by the number of projects that name them, one vote for each project; ties by who was seen first."""
    e = table(spark, folder, "evidence_rows").filter("ev_type = 'person' AND project IS NOT NULL AND trim(ev_value) <> ''").withColumn("person", F.trim("ev_value"))
    v = e.groupBy("person").agg(F.count_distinct("project").alias("projects"), F.min("ev_id").alias("first_seen"))
    return S.top(v, 10, F.desc("projects"), "first_seen")


VOTES = "SELECT regexp_replace(ev_value, '^ +| +$', '', 'g') AS person, count(DISTINCT project) AS projects, min(ev_id) AS first_seen FROM evidence_rows WHERE ev_type = 'person' AND project IS NOT NULL AND regexp_replace(ev_value, '^ +| +$', '', 'g') <> '' GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10"


def signed_features(spark: SparkSession, folder: str) -> DataFrame:
    """The columns most strongly correlated with the price, upwards and downwards; none where two share the place."""
    r = M.correlations(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"]).filter("r IS NOT NULL AND r <> 0")
    signed = r.select("column", F.round("r", 6).alias("r"), F.when(F.col("r") > 0, "up").otherwise("down").alias("sign"))
    return M.unique_best(signed.withColumn("strength", F.abs("r")), ["sign"], "strength").select("sign", "column", "r")


SIGNED = (
    "WITH r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr({c}, l_extendedprice), 6) AS r FROM lineitem" for c in ["l_quantity", "l_discount", "l_tax", "l_linenumber"])
    + "), s AS (SELECT *, CASE WHEN r > 0 THEN 'up' ELSE 'down' END AS sign FROM r WHERE r <> 0) SELECT sign, \"column\", r FROM s QUALIFY abs(r) = max(abs(r)) OVER (PARTITION BY sign) AND count(*) OVER (PARTITION BY sign, abs(r)) = 1"
)


def missing_table(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that miss a key, a cell or a sheet, by project, most first."""
    e = table(spark, folder, "evidence_rows").filter("project IS NOT NULL")
    per = e.groupBy("project").agg(F.count("*").alias("rows"), F.count_if(F.col("ev_key").isNull() | F.col("cell").isNull() | F.col("sheet").isNull()).alias("missing"))
    return per.select("project", "rows", "missing", F.round(F.col("missing") / F.col("rows"), 6).alias("share"))


MISSING_TABLE = "SELECT project, count(*) AS rows, count(*) FILTER (ev_key IS NULL OR cell IS NULL OR sheet IS NULL) AS missing, round(count(*) FILTER (ev_key IS NULL OR cell IS NULL OR sheet IS NULL) / count(*), 6) AS share FROM evidence_rows WHERE project IS NOT NULL GROUP BY 1"


def band_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Mean discount of bands of ten pieces in the first and the last year, bands by their middle; those of the least and the largest difference are marked."""
    li = table(spark, folder, "lineitem").withColumn("band", F.floor((F.col("l_quantity") - 1) / 10).cast("int")).withColumn("y", F.year("l_shipdate"))
    per = li.groupBy("band", "y").agg(F.avg("l_discount").alias("rate"))
    ends = per.groupBy("band").agg(F.min_by("rate", "y").alias("before"), F.max_by("rate", "y").alias("after"))
    d = ends.select((F.col("band") * 10 + 5.5).alias("middle"), F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round(F.abs(F.col("after") - F.col("before")), 6).alias("difference"))
    span = d.agg(F.min("difference").alias("lo"), F.max("difference").alias("hi"))  # one row
    return d.crossJoin(F.broadcast(span)).select("middle", "before", "after", "difference", F.when(F.col("difference") == F.col("hi"), "largest").when(F.col("difference") == F.col("lo"), "least").alias("mark"))


BAND_RATES = """
WITH p AS (SELECT floor((l_quantity - 1) / 10)::INT AS band, year(l_shipdate) AS y, avg(l_discount) AS rate FROM lineitem GROUP BY 1, 2), e AS (SELECT band, arg_min(rate, y) AS b, arg_max(rate, y) AS a FROM p GROUP BY 1),
d AS (SELECT band * 10 + 5.5::DOUBLE AS middle, round(b, 6) AS before, round(a, 6) AS after, round(abs(a - b), 6) AS difference FROM e)
SELECT *, CASE WHEN difference = max(difference) OVER () THEN 'largest' WHEN difference = min(difference) OVER () THEN 'least' END AS mark FROM d"""


def week_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by the first week cell their shipping period covers, and by how many cells it covers; a cell that is covered by less than a day does not count."""
    o = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("s"), F.to_date(F.max("l_shipdate")).alias("e")).filter("e > s")
    week = lambda d: F.floor(F.datediff(d, F.lit("1992-01-06").cast("date")) / 7)
    w = o.select(week(F.col("s")).alias("first"), week(F.date_sub("e", 1)).alias("last"))
    return w.groupBy("first", (F.col("last") - F.col("first") + 1).alias("cells")).agg(F.count("*").alias("orders"))


WEEK_SPANS = """
WITH o AS (SELECT l_orderkey, min(l_shipdate)::DATE AS s, max(l_shipdate)::DATE AS e FROM lineitem GROUP BY 1), w AS (SELECT floor(date_diff('day', DATE '1992-01-06', s) / 7)::BIGINT AS a, floor(date_diff('day', DATE '1992-01-06', e - 1) / 7)::BIGINT AS b FROM o WHERE e > s)
SELECT a AS first, b - a + 1 AS cells, count(*) AS orders FROM w GROUP BY 1, 2"""


def bound_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Two conditions bound to columns, then mean, largest and number, by line status."""
    li = table(spark, folder, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 30))
    return li.groupBy("l_linestatus").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.max("l_extendedprice").alias("most"), F.count("*").alias("n"))


BOUND = "SELECT l_linestatus, round(avg(l_extendedprice), 4) AS mean, max(l_extendedprice) AS most, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 30 GROUP BY 1"


def interval_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Bins of quantities, written as ranges."""
    h = M.histogram(table(spark, folder, "lineitem"), "l_quantity", 7)
    return h.select("bin", V.tilde_range(F.concat(F.lit("["), F.col("low").cast("string"), F.lit(", "), F.col("high").cast("string"), F.lit(")"))).alias("label"), "n")


LABELS = """
WITH s AS (SELECT min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi FROM lineitem), c AS (SELECT least(floor((l_quantity - lo) / ((hi - lo) / 7)), 6)::INT AS bin, count(*) AS n FROM lineitem, s GROUP BY 1)
SELECT bin, (lo + bin * ((hi - lo) / 7))::VARCHAR || '〜' || (lo + (bin + 1) * ((hi - lo) / 7))::VARCHAR AS label, n FROM c, s"""


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """What is known of each project: facts of the extractions, completed by those of the documents where missing."""
    own = table(spark, folder, "extracted_docs").filter("project IS NOT NULL").groupBy("project").agg(F.count("*").alias("files"), F.max("category").alias("category"))
    more = table(spark, folder, "documents").filter("project IS NOT NULL").groupBy("project").agg(F.count("*").alias("files2"), F.max("lang").alias("lang"))
    return own.join(more, "project", "full_outer").select("project", F.coalesce("files", "files2").alias("files"), "category", "lang", F.col("files").isNull().alias("added"))


PROFILES = """
WITH a AS (SELECT project, count(*) AS files, max(category) AS category FROM extracted_docs WHERE project IS NOT NULL GROUP BY 1), b AS (SELECT project, count(*) AS files2, max(lang) AS lang FROM documents WHERE project IS NOT NULL GROUP BY 1)
SELECT project, coalesce(files, files2) AS files, category, lang, files IS NULL AS added FROM a FULL JOIN b USING (project)"""


def renamed_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Names with an underscore that one version has and the other has not: equal ones once underscores and case are gone count as renamed."""
    docs = spread(table(spark, folder, "extracted_docs")).filter("text <> ''")
    names = docs.select("ext_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+(?:_[A-Za-z0-9]+)+"), F.lit(0)))).alias("name"))
    pairs = version_pairs_of(docs)
    before = pairs.join(names.select(F.col("ext_id").alias("old"), "name"), "old")
    after = pairs.join(names.select(F.col("ext_id").alias("new"), "name"), "new")
    gone, came = before.join(after, ["old", "new", "name"], "left_anti"), after.join(before, ["old", "new", "name"], "left_anti")
    core = F.lower(F.regexp_replace("name", "_", ""))
    renamed = gone.withColumn("core", core).withColumnRenamed("name", "was").join(came.withColumn("core", core), ["old", "new", "core"]).groupBy("old", "new").agg(F.count("*").alias("renamed"))
    count = lambda df, c: df.groupBy("old", "new").agg(F.count("*").alias(c))
    every = count(gone, "gone").join(count(came, "came"), ["old", "new"], "full_outer").join(renamed, ["old", "new"], "left")
    return every.select("old", "new", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gone", "came", "renamed")])


RENAMED = f"""
WITH {PAIRS}, t AS (SELECT ext_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+(?:_[A-Za-z0-9]+)+'))) AS name FROM extracted_docs WHERE text <> ''), b AS (SELECT p.old, p.new, name FROM p JOIN t ON t.ext_id = p.old), a AS (SELECT p.old, p.new, name FROM p JOIN t ON t.ext_id = p.new WHERE p.old IS NOT NULL),
g AS (SELECT * FROM b ANTI JOIN a USING (old, new, name)), c AS (SELECT * FROM a ANTI JOIN b USING (old, new, name)), k AS (SELECT old, new, count(*) AS gone FROM g GROUP BY 1, 2), m AS (SELECT old, new, count(*) AS came FROM c GROUP BY 1, 2),
r AS (SELECT g.old, g.new, count(*) AS renamed FROM g JOIN c ON g.old = c.old AND g.new = c.new AND lower(replace(g.name, '_', '')) = lower(replace(c.name, '_', '')) GROUP BY 1, 2)
SELECT old, new, coalesce(gone, 0) AS gone, coalesce(came, 0) AS came, coalesce(renamed, 0) AS renamed FROM k FULL JOIN m USING (old, new) LEFT JOIN r USING (old, new)"""

QUERIES = {
    "diff_ranked_changes": ranked_changes, "diff_pair_records": pair_records, "diff_lost_tables": lost_tables, "diff_renamed_columns": renamed_columns, "lines_header_rows": header_rows, "lines_last_tasks": last_tasks,
    "lines_parameters_without_column": parameters_without_column, "entity_role_tasks": role_tasks, "entity_owner_sets": owner_sets, "entity_votes": votes, "entity_profiles": profiles, "search_scopes": scopes,
    "search_found_files": found_files, "search_with_context": with_context, "search_recall_at": recall_at, "evidence_grounded": grounded, "evidence_image_only": image_only, "evidence_ids_by_kind": ids_by_kind,
    "stats_signed_features": signed_features, "stats_missing_table": missing_table, "stats_band_rates": band_rates, "stats_week_spans": week_spans, "stats_bound_filter": bound_filter, "stats_interval_labels": interval_labels,
}
ORACLE = {
    "diff_ranked_changes": RANKED, "diff_pair_records": RECORDS, "diff_lost_tables": LOST, "diff_renamed_columns": RENAMED, "lines_header_rows": HEADERS, "lines_last_tasks": LAST_TASKS,
    "lines_parameters_without_column": WITHOUT_COLUMN, "entity_role_tasks": ROLE_TASKS, "entity_owner_sets": OWNER_SETS, "entity_votes": VOTES, "entity_profiles": PROFILES, "search_scopes": SCOPES,
    "search_found_files": FOUND_FILES, "search_with_context": context_sql(BM25_ALL), "search_recall_at": RECALL_AT, "evidence_grounded": GROUNDED, "evidence_image_only": IMAGE_ONLY, "evidence_ids_by_kind": IDS_BY_KIND,
    "stats_signed_features": SIGNED, "stats_missing_table": MISSING_TABLE, "stats_band_rates": BAND_RATES, "stats_week_spans": WEEK_SPANS, "stats_bound_filter": BOUND, "stats_interval_labels": LABELS,
}
