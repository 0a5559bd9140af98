"""Streams: windows, sessions, late rows, repeats, and a ledger in which the last record wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def timed(events: DataFrame) -> DataFrame:
    """Event time as a timestamp: watermarks refuse the type without zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def marked(events: DataFrame, late: str | None) -> DataFrame:
    """Event time, and for a stream the watermark; without one, no row comes too late and no group is closed."""
    e = timed(events)
    return e.withWatermark("ts", late) if events.isStreaming and late else e


def hourly(events: DataFrame, late: str | None = "2 hours") -> DataFrame:
    """Counts and sums by hour and type, for a batch or a stream; rows later than `late` are dropped by a stream."""
    e = marked(events, late)
    g = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, late: str | None = "2 hours") -> DataFrame:
    e = marked(events, late)
    g = e.groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return g.select(F.col("window.start").alias("start"), "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    e = marked(events, late)
    g = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.unix_timestamp(F.col("session_window.end")).alias("_e"), "n").select("user_id", "start", "n", (F.col("_e") - F.unix_timestamp("start")).alias("seconds"))


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event id once."""
    e = timed(events)
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else e.dropDuplicates(["event_id"])


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that is there, then stops; started again, it goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()


def run_to_version(stream: DataFrame, folder: str) -> DataFrame:
    """Processes all that is there and gives the result table as the last batch left it. A batch that is run again writes its version again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number:06d}")

    query = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{folder}/_state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = (query.lastProgress or {}).get("batchId") if query.recentProgress else None
    if last is None:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/batch={last:06d}")


BUCKETS = 64  # parts of a ledger; a batch rewrites those that its keys fall into


def upsert_ledger(stream: DataFrame, keys: list[str], order: str, folder: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Keeps the last record of each key in a table of versioned buckets; `read_ledger` reads it.

    A batch rewrites the buckets of its keys only. A batch that is run again writes its version again, from
    the versions before it.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        rows = batch.withColumn("bucket", bucket)
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # as many as there are buckets
        before = _newest(spark, folder, number)
        paths = [before[b] for b in touched if b in before]
        if paths:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*paths).withColumn("bucket", bucket))
        last = rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("r"))
        last.select("bucket", *keys, "r.*").select("bucket", *batch.columns).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={number:06d}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _newest(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, str]:
    """The folder of the newest whole version of each bucket, of batches before the given one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, str] = {}
    batches = sorted((s.getPath() for s in fs.listStatus(path)), key=str) if fs.exists(path) else []
    for b in batches:
        name = b.getName()
        if name.startswith("batch=") and (before is None or int(name[6:]) < before) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(b, "_SUCCESS")):
            out.update({int(p.getPath().getName()[7:]): str(p.getPath()) for p in fs.listStatus(b) if p.getPath().getName().startswith("bucket=")})
    return out


def read_ledger(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The last record of each key; empty where nothing was written."""
    paths = sorted(_newest(spark, folder).values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
