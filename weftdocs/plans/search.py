"""Search queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftdocs.functions.text import ID_PATTERN, bag_tokens, canonical_id, composed, locator, search_tokens, stem, strong_weak, trigrams, version_base
from weftdocs.operators import lines as L
from weftdocs.operators import search as S
from weftdocs.session import cut, spread, table

QUERY = "予測モデル 欠損率 load_ratio audit trail"

# DuckDB forms of the token functions
TOK = "list_concat(list_transform(regexp_extract_all({c}, '[A-Za-z0-9][A-Za-z0-9_.-]*[A-Za-z0-9]'), lambda w: lower(w)), flatten(list_transform(regexp_extract_all({c}, '[぀-ヿ㐀-鿿豈-﫿々〆ヶー]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_concat([r], list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) END)))"
LINES = "lines AS (SELECT doc_id, i AS line_no, parts[i] AS line FROM (SELECT doc_id, string_split(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) WHERE trim(parts[i]) <> '')"
ASKED = TOK.format(c=f"'{QUERY}'")


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    return L.lines(spread(table(spark, folder, "documents")).select("doc_id", composed("text").alias("text")), "doc_id", "text")


def composed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "chunks")).withColumn("text", composed("text"))


def line_search(spark: SparkSession, folder: str) -> DataFrame:
    """Top 20 lines of all documents by summed rarity of the query's tokens."""
    return S.top(S.idf_search(doc_lines(spark, folder), ["doc_id", "line_no"], "line", QUERY), 20, F.desc("score"), "doc_id", "line_no")


LINE_SEARCH = f"""
WITH {LINES}, asked AS (SELECT list_distinct({ASKED}) AS q),
hits AS (SELECT doc_id, line_no, unnest(list_intersect(list_distinct({TOK.format(c='line')}), (SELECT q FROM asked))) AS token FROM lines),
w AS (SELECT token, ln(((SELECT count(*) FROM lines) + 1) / (count(*) + 1)) + 1 AS idf FROM hits GROUP BY token)
SELECT doc_id, line_no, round(sum(idf), 6) AS score, round(count(*) / (SELECT len(q) FROM asked), 6) AS coverage
FROM hits JOIN w USING (token) GROUP BY doc_id, line_no ORDER BY score DESC, doc_id, line_no LIMIT 20"""


def idf_table(spark: SparkSession, folder: str) -> DataFrame:
    chunks = composed_chunks(spark, folder)
    posts = chunks.select("id", F.explode(F.array_distinct(search_tokens("text"))).alias("token"))
    weights = S.idf(posts, chunks.count())
    return weights.select("token", "df", F.round("idf", 6).alias("idf"))


IDF_TABLE = f"""
WITH p AS (SELECT id, unnest(list_distinct({TOK.format(c='nfc_normalize(text)')})) AS token FROM chunks)
SELECT token, count(*) AS df, round(ln(((SELECT count(*) FROM chunks) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM p GROUP BY token"""


def bm25_top(spark: SparkSession, folder: str) -> DataFrame:
    return S.top(S.bm25(composed_chunks(spark, folder), ["id"], "text", QUERY), 50, F.desc("score"), "id")


BM25_SQL = f"""
WITH t AS (SELECT id, unnest({TOK.format(c='nfc_normalize(text)')}) AS token FROM chunks), p AS (SELECT id, token, count(*) AS tf FROM t GROUP BY id, token),
len AS (SELECT id, sum(tf) AS n FROM p GROUP BY id), a AS (SELECT count(*) AS n, avg(n) AS avg_len FROM len),
q AS (SELECT unnest(list_distinct({ASKED})) AS token), m AS (SELECT p.* FROM p SEMI JOIN q USING (token)), d AS (SELECT token, count(*) AS df FROM m GROUP BY token),
s AS (SELECT m.id, sum(ln((a.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len.n / avg_len))) AS score FROM m JOIN d USING (token) JOIN len USING (id) CROSS JOIN a GROUP BY m.id)
SELECT id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, id LIMIT 50"""


BM25_ALL = BM25_SQL.replace("ORDER BY round(score, 6) DESC, id LIMIT 50", "")

ASKING = "id % 50 = 0"  # the queries of a search


def dense_lists(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """(query, id, score, rank): of every asked chunk, the k most similar ones."""
    vectors = table(spark, folder, "chunk_vectors").withColumnRenamed("chunk_id", "id")
    return S.nearest_all(spread(vectors), "id", "embedding", F.expr(ASKING), k)


def dense_top(spark: SparkSession, folder: str) -> DataFrame:
    """Of every chunk whose id is divisible by 50, the 20 most similar chunks."""
    return dense_lists(spark, folder, 20)


DENSE_CTE = """u AS (SELECT chunk_id AS id, embedding::DOUBLE[] AS v FROM chunk_vectors WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0),
near AS (SELECT q.id AS query, u.id, round(list_cosine_similarity(u.v, q.v), 6) AS score FROM u JOIN u q ON q.id % 50 = 0 AND len(q.v) = len(u.v)),
dense AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) - 1 AS rank FROM near QUALIFY rank < {k})"""
DENSE_SQL = f"WITH {DENSE_CTE.format(k=20)} SELECT * FROM dense"

RARE = 4.0  # least weight of a rare token


def _rare(bags: DataFrame, least: float) -> DataFrame:
    """(token, weight) of tokens that are rare in the collection."""
    n = bags.agg(F.count("*").alias("units"))
    frequent = bags.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # one row
    return frequent.select("token", (F.log((F.col("units") + 1) / (F.col("df") + 1)) + 1).alias("weight")).filter(F.col("weight") >= least)


def hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """For every chunk whose id is divisible by 50: the list by vectors and the list by rare tokens shared with it, fused by rank from 0.

    Chunks of the query's project and file weigh more, as do facts; old versions weigh less.
    """
    chunks = composed_chunks(spark, folder)
    about = chunks.select("id", "kind", "file", "project")
    dense = dense_lists(spark, folder, 90).select("query", "id", "rank")
    bags = chunks.select("id", F.array_distinct(bag_tokens("text")).alias("tokens"))
    asked = bags.filter(ASKING).select(F.col("id").alias("query"), F.explode("tokens").alias("token"))
    sparse = S.sharing_all(bags, "id", "tokens", cut(asked.join(_rare(bags, RARE), "token")), 90).select("query", "id", "rank")
    fused = S.fuse([(dense, "dense", 1.0), (sparse, "rare", 1.0)], ["query", "id"], digits=15)
    of_query = about.filter(ASKING).select(F.col("id").alias("query"), F.col("project").alias("own_project"), F.col("file").alias("own_file"))
    near = fused.filter("query <> id").join(about, "id").join(of_query, "query")
    boost = (
        F.when(F.col("project") == F.col("own_project"), 1.6).otherwise(1.0) * F.when(F.col("file") == F.col("own_file"), 2.2).otherwise(1.0)
        * F.when(F.col("kind") == "fact", 1.25).otherwise(1.0) * F.when(F.col("file").contains("_old"), 0.8).otherwise(1.0)
    )
    boosted = near.withColumn("score", F.round(F.col("score") * boost, 9))
    return L.capped(boosted.select("query", "id", "score", "sources"), ["query"], [F.desc("score"), "id"], 16)


HYBRID_SQL = f"""
WITH {DENSE_CTE.format(k=90)}, t AS (SELECT id, unnest(list_distinct({{BAG}})) AS token FROM (SELECT id, nfc_normalize(text) AS text FROM chunks)),
w AS (SELECT token, ln(((SELECT count(*) FROM chunks) + 1) / (count(*) + 1)) + 1 AS idf FROM t GROUP BY token HAVING idf >= {RARE}), r AS (SELECT * FROM t JOIN w USING (token)),
s AS (SELECT q.id AS query, r.id, round(sum(r.idf), 6) AS rarity FROM r q JOIN r USING (token) WHERE q.id % 50 = 0 GROUP BY 1, 2),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rarity DESC, id) - 1 AS rank FROM s QUALIFY rank < 90),
l AS (SELECT query, id, rank, 'dense' AS source FROM dense UNION ALL SELECT query, id, rank, 'rare' FROM sparse),
f AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 15) AS score, string_agg(source, '+' ORDER BY source) AS sources FROM l WHERE query <> id GROUP BY 1, 2),
b AS (SELECT f.query, f.id, round(score * CASE WHEN c.project = o.project THEN 1.6 ELSE 1.0 END::DOUBLE * CASE WHEN c.file = o.file THEN 2.2 ELSE 1.0 END::DOUBLE * CASE WHEN c.kind = 'fact' THEN 1.25 ELSE 1.0 END::DOUBLE * CASE WHEN contains(c.file, '_old') THEN 0.8 ELSE 1.0 END::DOUBLE, 9) AS score, sources
  FROM f JOIN chunks c ON c.id = f.id JOIN chunks o ON o.id = f.query)
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 16"""


def fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence and registry lists merged on (file, locator) with weights, rank from 1, at most 3 places of a file."""
    rows = table(spark, folder, "evidence_rows").dropDuplicates(["ev_id"])
    place = rows.select("ev_id", "file", locator("cell", "sheet", "paragraph").alias("loc"), "ev_type", "ev_value", "ev_key")
    order = [F.desc("n"), "file", "loc"]
    by_value = place.filter("ev_value LIKE '%予測モデル%'").groupBy("file", "loc").agg(F.count("*").alias("n"))
    by_key = place.filter("ev_key = 'owner'").groupBy("file", "loc").agg(F.count("*").alias("n"))
    lists = [(S.ranked(S.top(x, 100, *order), order, 1), name, w) for x, name, w in ((by_value, "value", 1.0), (by_key, "key", 0.7))]
    fused = S.fuse(lists, ["file", "loc"])
    return S.top(L.capped(fused, ["file"], [F.desc("score"), "loc"], 3), 50, F.desc("score"), "file", "loc")


FUSION_SQL = """
WITH e AS (SELECT DISTINCT ON (ev_id) * FROM evidence_rows),
p AS (SELECT file, coalesce('cell:' || cell, 'sheet:' || sheet, 'par:' || paragraph::VARCHAR, '-') AS loc, ev_value, ev_key FROM e),
a AS (SELECT file, loc, count(*) AS n FROM p WHERE ev_value LIKE '%予測モデル%' GROUP BY ALL ORDER BY n DESC, file, loc LIMIT 100),
b AS (SELECT file, loc, count(*) AS n FROM p WHERE ev_key = 'owner' GROUP BY ALL ORDER BY n DESC, file, loc LIMIT 100),
r AS (SELECT file, loc, 'value' AS source, 1.0::DOUBLE AS w, row_number() OVER (ORDER BY n DESC, file, loc) AS rank FROM a
      UNION ALL SELECT file, loc, 'key', 0.7, row_number() OVER (ORDER BY n DESC, file, loc) FROM b),
f AS (SELECT file, loc, round(sum(w / (60.0::DOUBLE + rank)), 9) AS score, string_agg(source, '+' ORDER BY source) AS sources FROM r GROUP BY file, loc)
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, loc) <= 3 ORDER BY score DESC, file, loc LIMIT 50"""


def diversified(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks")
    scored = S.bm25(spread(chunks), ["id"], "text", QUERY).join(chunks.select("id", "file", "text"), "id")
    return S.diversify(scored, "id", "file", "text", 2, 24).select("id", "file", "score", "over_cap")


DIVERSIFIED_SQL = f"""
WITH s AS ({BM25_SQL.replace('ORDER BY round(score, 6) DESC, id LIMIT 50', '')}),
c AS (SELECT s.*, file, text FROM s JOIN chunks USING (id)),
once AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY regexp_replace(text, '\\s+', '', 'g') ORDER BY score DESC, id) = 1),
o AS (SELECT id, file, score, (row_number() OVER (PARTITION BY file ORDER BY score DESC, id) > 2)::INT AS over_cap FROM once)
SELECT * FROM o ORDER BY over_cap, score DESC, id LIMIT 24"""


def chunk_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return S.neighbours(table(spark, folder, "chunks").filter("rel IS NOT NULL"), "id", "rel", F.col("kind") == "fact")


NEIGHBOURS_SQL = """
WITH r AS (SELECT *, sum((kind = 'fact')::INT) OVER (PARTITION BY rel ORDER BY id) AS run FROM chunks WHERE rel IS NOT NULL)
SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after FROM r WHERE kind <> 'fact' WINDOW w AS (PARTITION BY rel, run ORDER BY id)"""


def candidate_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files by matched strong tokens (their lengths, 5 more for one in the name); windows count only without those."""
    strong, weak = strong_weak(F.lit("予測モデル notes 000000"))
    rows = table(spark, folder, "evidence_rows").select("file", "ev_value").distinct()
    low_name, low_value = F.lower("file"), F.lower(F.coalesce("ev_value", F.lit("")))
    in_value = lambda tokens, weight: F.filter(tokens, lambda t: F.contains(low_value, t) | F.contains(low_name, t))  # noqa: E731, ARG005
    found = rows.select("file", F.explode_outer(in_value(F.concat(strong, weak), 1)).alias("token")).filter("token IS NOT NULL").distinct()
    marked = found.withColumn("strong", F.array_contains(strong, F.col("token"))).withColumn("named", F.contains(F.lower("file"), F.col("token")))
    per_file = marked.groupBy("file").agg(
        F.sum(F.when(F.col("strong"), F.length("token"))).alias("s"), F.max(F.when(F.col("strong") & F.col("named"), 5)).alias("bonus"), F.sum(F.when(~F.col("strong"), F.length("token") * 0.25)).alias("w")
    )
    score = F.when(F.col("s").isNotNull(), F.col("s") + F.coalesce("bonus", F.lit(0))).otherwise(F.col("w"))
    return S.top(per_file.select("file", score.cast("double").alias("score")), 12, F.desc("score"), "file")


CANDIDATE_SQL = """
WITH q AS (SELECT unnest(['notes', '000000', '予測モデル', '予測モ', '測モデ', 'モデル', '予測', '測モ', 'モデ', 'デル']) AS token), st AS (SELECT ['notes', '000000', '予測モデル'] AS s),
f AS (SELECT DISTINCT file, token FROM evidence_rows, q WHERE contains(lower(coalesce(ev_value, '')), token) OR contains(lower(file), token)),
m AS (SELECT *, list_contains((SELECT s FROM st), token) AS strong, contains(lower(file), token) AS named FROM f),
g AS (SELECT file, sum(length(token)) FILTER (strong) AS s, max(5) FILTER (strong AND named) AS bonus, sum(length(token) * 0.25) FILTER (NOT strong) AS w FROM m GROUP BY file)
SELECT file, (CASE WHEN s IS NOT NULL THEN s + coalesce(bonus, 0) ELSE w END)::DOUBLE AS score FROM g ORDER BY score DESC, file LIMIT 12"""


def id_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers such as T19 by canonical key: documents, lines, first place."""
    rows = doc_lines(spark, folder)
    hits = rows.select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit("T[0-9]{2}"), F.lit(0))).alias("raw"))
    keyed = hits.select("doc_id", "line_no", canonical_id(F.substring("raw", 1, 1), F.substring("raw", 2, 9)).alias("id"))
    return keyed.groupBy("id").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("places"), F.min("doc_id").alias("first_doc"))


ID_SQL = f"""
WITH {LINES}, h AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, 'T[0-9]{{2}}')) AS id FROM lines)
SELECT upper(id) AS id, count(DISTINCT doc_id) AS docs, count(*) AS places, min(doc_id) AS first_doc FROM h GROUP BY 1"""


def id_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that hold the identifier T-07 in any spelling."""
    rows = doc_lines(spark, folder).filter(F.col("line").rlike("[Tt][-_]?07"))
    key = canonical_id(F.regexp_extract("line", ID_PATTERN.replace("[A-Za-z]{1,4}", "[Tt]").replace("[0-9]{1,4}", "07"), 1), F.lit("07"))
    return rows.withColumn("key", key).filter("key = 'T07'").select("doc_id", "line_no", "key")


ID_LOOKUP_SQL = f"""
WITH {LINES} SELECT doc_id, line_no, 'T07' AS key FROM lines WHERE regexp_matches(line, '(?:^|[^A-Za-z0-9-])([Tt])[-_]?(07)(?:[^A-Za-z0-9]|$)')"""


def resolve_files(spark: SparkSession, folder: str) -> DataFrame:
    """File names in questions to files, by tiers: whole name, stem, version family."""
    asked = table(spark, folder, "gold_100_review").select(F.regexp_extract("question", r"([^\s]*[0-9]{9}\.[a-z]{2,5})", 1).alias("asked")).filter("asked <> ''").distinct()
    asked = asked.select("asked", F.lower(F.regexp_extract("asked", "([^の]*)$", 1)).alias("q"))
    files = table(spark, folder, "extracted_docs").select("rel", F.lower("name").alias("name")).distinct()
    tier = lambda n, a, b: asked.join(files, a == b).select("asked", "rel", F.lit(n).alias("tier"))
    number = lambda c: F.regexp_extract(c, "([0-9]{9})", 1)
    found = tier(1, F.col("q"), F.col("name")).unionByName(tier(2, stem("q"), stem("name"))).unionByName(tier(3, F.concat(version_base("q"), number("q")), F.concat(version_base("name"), number("name"))))
    return S.first_tier(found.distinct(), "asked", "tier")


RESOLVE_SQL = r"""
WITH a AS (SELECT DISTINCT regexp_extract(question, '([^\s]*[0-9]{9}\.[a-z]{2,5})', 1) AS asked FROM gold_100_review), q AS (SELECT asked, lower(regexp_extract(asked, '([^の]*)$', 1)) AS q FROM a WHERE asked <> ''),
f AS (SELECT DISTINCT rel, lower(name) AS name FROM extracted_docs),
s AS (SELECT *, regexp_replace(q, '\.[A-Za-z0-9]+$', '') AS st FROM q), g AS (SELECT *, regexp_replace(name, '\.[A-Za-z0-9]+$', '') AS st FROM f),
b AS (SELECT *, trim(regexp_replace(lower(st), '(_old|_final|_v[0-9]+|[ _]?改訂-[0-9]+| rev-[0-9]+)', '', 'g')) || regexp_extract(q, '([0-9]{9})', 1) AS base FROM s),
h AS (SELECT *, trim(regexp_replace(lower(st), '(_old|_final|_v[0-9]+|[ _]?改訂-[0-9]+| rev-[0-9]+)', '', 'g')) || regexp_extract(name, '([0-9]{9})', 1) AS base FROM g),
t AS (SELECT asked, rel, 1 AS tier FROM b JOIN h ON q = name UNION SELECT asked, rel, 2 FROM b JOIN h ON b.st = h.st UNION SELECT asked, rel, 3 FROM b JOIN h ON b.base = h.base)
SELECT * FROM t QUALIFY tier = min(tier) OVER (PARTITION BY asked)"""


def bind_alias(spark: SparkSession, folder: str) -> DataFrame:
    """Project names and aliases in questions: the longest wins, and it must name one project."""
    dims = table(spark, folder, "case_master")  # 40 rows at every size
    names = dims.select("case_id", F.explode(F.concat(F.array("project"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).filter("alias <> ''")
    asked = table(spark, folder, "gold_100_review").select("review_id", "question").filter("question IS NOT NULL")
    hits = asked.join(F.broadcast(names), F.contains("question", "alias"))
    longest = hits.withColumn("_long", F.max(F.length("alias")).over(Window.partitionBy("review_id"))).filter(F.length("alias") == F.col("_long"))
    bound = longest.groupBy("review_id").agg(F.count_distinct("case_id").alias("n"), F.min("case_id").alias("case_id"), F.min("alias").alias("alias"))
    return bound.filter("n = 1").select("review_id", "case_id", "alias")


BIND_SQL = """
WITH n AS (SELECT case_id, unnest(list_concat([project], coalesce(aliases, []))) AS alias FROM case_master),
h AS (SELECT review_id, case_id, alias FROM gold_100_review JOIN n ON contains(question, alias) WHERE alias <> ''),
l AS (SELECT * FROM h QUALIFY length(alias) = max(length(alias)) OVER (PARTITION BY review_id))
SELECT review_id, min(case_id) AS case_id, min(alias) AS alias FROM l GROUP BY review_id HAVING count(DISTINCT case_id) = 1"""


def vocabulary_retry(spark: SparkSession, folder: str) -> DataFrame:
    """For misspelt query words, corpus tokens that share most of their trigrams, the rarest first."""
    posts = composed_chunks(spark, folder).select("id", F.explode(F.array_distinct(search_tokens("text"))).alias("token"))
    frequencies = posts.filter(F.length("token") >= 4).groupBy("token").agg(F.count("*").alias("df"))
    asked = trigrams(F.lit("load_ratoi"))
    shared = F.size(F.array_intersect(trigrams("token"), asked)) / F.size(asked)
    return S.top(frequencies.select("token", "df", F.round(shared, 6).alias("overlap")).filter("overlap >= 0.4"), 10, F.desc("overlap"), "df", "token")


RETRY_SQL = f"""
WITH p AS (SELECT id, unnest(list_distinct({TOK.format(c='nfc_normalize(text)')})) AS token FROM chunks), f AS (SELECT token, count(*) AS df FROM p WHERE length(token) >= 4 GROUP BY token),
g AS (SELECT token, df, list_distinct(list_transform(range(1, length(token) - 1), lambda i: substr(token, i, 3))) AS t FROM f), q AS (SELECT list_transform(range(1, 9), lambda i: substr('load_ratoi', i, 3)) AS t)
SELECT token, df, round(len(list_intersect(g.t, q.t)) / len(q.t), 6) AS overlap FROM g, q WHERE len(list_intersect(g.t, q.t)) / len(q.t) >= 0.4 ORDER BY overlap DESC, df, token LIMIT 10"""


def bag_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of the bag tokenizer by project."""
    bag = table(spark, folder, "chunks").select("project", F.size(bag_tokens("text")).alias("n"), F.size(F.array_distinct(bag_tokens("text"))).alias("d"))
    return bag.groupBy("project").agg(F.sum("n").alias("tokens"), F.sum("d").alias("distinct_tokens"))


BAG = "list_concat(regexp_extract_all(lower(text), '[a-z0-9_]+'), list_transform(range(1, len(regexp_extract_all(lower(text), '[぀-ヿ一-鿿]'))), lambda i: list_aggregate(regexp_extract_all(lower(text), '[぀-ヿ一-鿿]')[i:i+1], 'string_agg', '')), regexp_extract_all(lower(text), '[぀-ヿ一-鿿]'))"
BAG_SQL = f"SELECT project, sum(len({BAG}))::BIGINT AS tokens, sum(len(list_distinct({BAG})))::BIGINT AS distinct_tokens FROM chunks GROUP BY project"

QUERIES = {
    "search_lines_by_idf": line_search, "search_idf_table": idf_table, "search_bm25_top": bm25_top, "search_dense_top": dense_top, "search_hybrid_rrf": hybrid, "search_weighted_fusion": fusion,
    "search_diversified": diversified, "search_chunk_neighbours": chunk_neighbours, "search_candidate_files": candidate_files, "search_id_occurrences": id_occurrences, "search_id_lookup": id_lookup,
    "search_resolve_files": resolve_files, "search_bind_alias": bind_alias, "search_vocabulary_retry": vocabulary_retry, "search_bag_profile": bag_profile,
}
ORACLE = {
    "search_lines_by_idf": LINE_SEARCH, "search_idf_table": IDF_TABLE, "search_bm25_top": BM25_SQL, "search_dense_top": DENSE_SQL, "search_hybrid_rrf": HYBRID_SQL.replace("{BAG}", BAG), "search_weighted_fusion": FUSION_SQL,
    "search_diversified": DIVERSIFIED_SQL, "search_chunk_neighbours": NEIGHBOURS_SQL, "search_candidate_files": CANDIDATE_SQL, "search_id_occurrences": ID_SQL, "search_id_lookup": ID_LOOKUP_SQL,
    "search_resolve_files": RESOLVE_SQL, "search_bind_alias": BIND_SQL, "search_vocabulary_retry": RETRY_SQL, "search_bag_profile": BAG_SQL,
}
