"""Queries over the event stream, run on the whole table, and their SQL. Additions of this library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftdocs.operators import joins as J
from weftdocs.sources import files
from weftdocs.streaming import events as V
from weftdocs.session import shared_folder, table


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Hours as a stream over the events' files leaves them; late rows correct the hour they belong to."""
    rows = V.run_to_version(V.hourly(V.read_stream(spark, f"{folder}/events.parquet"), None), _folder(spark))
    return rows.select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "total")


HOURLY = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions as a stream over the events' files leaves them."""
    s = V.run_to_version(V.sessions(V.read_stream(spark, f"{folder}/events.parquet"), "30 minutes", None), _folder(spark))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


SESSIONS = """
WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT AS step FROM events), s AS (SELECT user_id, sum(coalesce(step, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1"""


def last_records(spark: SparkSession, folder: str) -> DataFrame:
    """The last evidence of each file and type."""
    e = table(spark, folder, "evidence_rows").dropDuplicates(["ev_id"])
    return J.latest(e, ["file", "ev_type"], F.desc("loaded_at"), F.desc("ev_id")).select("file", "ev_type", "ev_id")


LAST = "WITH e AS (SELECT DISTINCT ON (ev_id) * FROM evidence_rows) SELECT file, ev_type, ev_id FROM e QUALIFY row_number() OVER (PARTITION BY file, ev_type ORDER BY loaded_at DESC, ev_id DESC) = 1"


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence that was loaded days after it was seen, by lateness."""
    e = table(spark, folder, "evidence_rows").dropDuplicates(["ev_id"]).withColumn("days", F.datediff("loaded_at", "seen_at"))
    return e.groupBy("days").agg(F.count("*").alias("n"))


LATE = "WITH e AS (SELECT DISTINCT ON (ev_id) * FROM evidence_rows) SELECT date_diff('day', seen_at, loaded_at)::INT AS days, count(*) AS n FROM e GROUP BY 1"


def event_properties(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON property of events, summed by type."""
    e = files.json_paths(table(spark, folder, "events"), "props", {"k": "k"})
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum(F.col("k").try_cast("int")).alias("total"))


PROPERTIES = "SELECT event_type, count(json_extract_string(props, '$.k')) AS n, sum(try_cast(json_extract_string(props, '$.k') AS INT))::BIGINT AS total FROM events GROUP BY 1"


def changed_since(spark: SparkSession, folder: str) -> DataFrame:
    """What an incremental build would redo: extractions whose text the earlier ones of the file did not have."""
    d = table(spark, folder, "extracted_docs")
    newest = J.latest(d, ["rel"], F.desc("ext_id"))
    old = d.join(newest.select("ext_id"), "ext_id", "left_anti")
    redo, keep = files.unchanged(newest, old, "rel", "text")
    return redo.agg(F.count("*").alias("redo")).crossJoin(keep.agg(F.count("*").alias("keep")))  # one row each


CHANGED = """
WITH n AS (SELECT * FROM extracted_docs QUALIFY row_number() OVER (PARTITION BY rel ORDER BY ext_id DESC) = 1), o AS (SELECT DISTINCT rel, coalesce(text, '') AS t FROM extracted_docs WHERE ext_id NOT IN (SELECT ext_id FROM n)),
m AS (SELECT n.rel, o.rel IS NOT NULL AS same FROM n LEFT JOIN o ON n.rel = o.rel AND coalesce(n.text, '') = o.t) SELECT count(*) FILTER (NOT same) AS redo, count(*) FILTER (same) AS keep FROM m"""


def totals_by_grouping(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by flag and status with subtotals."""
    li = table(spark, folder, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.grouping_id().alias("level"))


CUBE = "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, grouping(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"

def versioned(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence written as two versions of a table, the second one whole; read again, the last version counts."""
    out = _folder(spark)
    e = table(spark, folder, "evidence_rows").dropDuplicates(["ev_id"]).select("ev_id", "ev_type", "file")
    files.write_version(e.filter("ev_type = 'person'"), out, ["ev_id"], ["ev_type"])
    files.write_version(e, out, ["ev_id"], ["ev_type"])
    return files.read_latest(spark, out, e.schema).groupBy("ev_type").agg(F.count("*").alias("n"), F.min("ev_id").alias("first"), F.count_distinct("file").alias("files"))


VERSIONED = "WITH e AS (SELECT DISTINCT ON (ev_id) * FROM evidence_rows) SELECT ev_type, count(*) AS n, min(ev_id) AS first, count(DISTINCT file) AS files FROM e GROUP BY 1"


def delimited_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews written as a delimited file and read as text: which columns hold numbers only, and their totals."""
    out = f"{_folder(spark)}/reviews"
    g = table(spark, folder, "gold_100_review").select("review_id", "item_index", "status", "confidence", "question")
    g.write.option("header", "true").option("escape", '"').csv(out)
    typed, numbers = files.numeric_where_whole(files.delimited(spark, out))
    return typed.agg(*[F.round(F.sum(F.col(c).cast("decimal(20,4)")), 4).cast("double").alias(c) for c in sorted(numbers)], F.count("*").alias("rows"))


DELIMITED = "SELECT sum(review_id)::DOUBLE AS review_id, sum(item_index)::DOUBLE AS item_index, round(sum(try_cast(confidence AS DECIMAL(20,4))), 4)::DOUBLE AS confidence, count(*) AS rows FROM gold_100_review"


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as text files, one folder for each language; found by a walk and decoded again."""
    out = f"{_folder(spark)}/texts"
    d = table(spark, folder, "documents").filter("text IS NOT NULL AND lang IS NOT NULL")
    d.select("lang", F.regexp_replace("text", "[\\r\\n]", " ").alias("value")).write.option("maxRecordsPerFile", 10_000).partitionBy("lang").text(out)
    t = files.texts(spark, out).select(F.regexp_extract("rel", "lang=([^/]*)/", 1).alias("lang"), F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return t.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("line")).alias("characters"))


TEXT_FILES = "SELECT lang, count(*) AS docs, sum(length(text))::BIGINT AS characters FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND text <> '' GROUP BY 1"

QUERIES = {
    "source_versioned": versioned, "source_delimited": delimited_numbers, "source_text_files": text_files,
    "stream_hourly": hourly, "stream_sessions": user_sessions, "stream_last_records": last_records, "stream_late_rows": late_rows, "source_json_properties": event_properties,
    "source_incremental": changed_since, "stats_cube": totals_by_grouping,
}
ORACLE = {"source_versioned": VERSIONED, "source_delimited": DELIMITED, "source_text_files": TEXT_FILES, "stream_hourly": HOURLY, "stream_sessions": SESSIONS, "stream_last_records": LAST, "stream_late_rows": LATE, "source_json_properties": PROPERTIES, "source_incremental": CHANGED, "stats_cube": CUBE}
