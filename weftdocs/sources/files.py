"""Readers of files as they lie in a shared drive, and sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftdocs.functions.text import parse_numeric

JUNK = r"(^|/)(\.[^/]*|~\$[^/]*|Thumbs\.db|desktop\.ini)$"
# How bytes of unknown encoding are tried, in this order.
CHARSETS = ("utf-8-sig", "cp932", "cp1252")


def walk(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """(path, rel, name, stem, ext, folder_no, size, modified): all files below a folder but junk, by listing.

    With content, their bytes and content hash too; else the bytes are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^.*?" + root.replace(".", r"\."), "")
    named = files.withColumn("rel", rel).withColumn("name", F.regexp_extract("rel", "([^/]*)$", 1)).filter(~F.col("rel").rlike(JUNK))
    cols = [
        "path", "rel", "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).alias("ext"),
        F.regexp_extract("rel", r"(?:^|/)(0[0-9])\.[^/]*/", 1).alias("folder_no"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
    ]
    return named.select(*cols, *(["content", F.sha2("content", 256).alias("hash")] if content else []))


def decoded(content: str | Column) -> Column:
    """Bytes as text: the first encoding that reads them without loss. SQL's decode knows Unicode and Latin-1 only."""

    def read(b: bytes | None) -> str | None:
        for charset in CHARSETS if b is not None else ():
            try:
                return b.decode(charset)
            except UnicodeDecodeError:
                pass
        return None if b is None else b.decode("latin-1")

    def each(batch: pd.Series) -> pd.Series:
        return batch.map(read)

    return F.pandas_udf(each, T.StringType())(F.col(content) if isinstance(content, str) else content)


def texts(spark: SparkSession, folder: str, exts: tuple[str, ...] = ("txt", "md", "py", "toml", "log")) -> DataFrame:
    """(rel, ext, text) of text files of any encoding."""
    return walk(spark, folder, content=True).filter(F.col("ext").isin(*exts)).select("rel", "ext", decoded("content").alias("text"))


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table with a header row, all columns text; bad rows stay, with nulls."""
    return spark.read.option("header", "true").option("sep", sep).option("mode", "PERMISSIVE").option("multiLine", "true").csv(path)


def numeric_where_whole(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Columns that hold numbers only become doubles, all or nothing for each column; one pass of counts."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df, []
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    row = df.agg(*[F.count(filled(c)).alias(f"n{i}") for i, c in enumerate(text)], *[F.count(parse_numeric(c)).alias(f"k{i}") for i, c in enumerate(text)]).first()
    numbers = [c for i, c in enumerate(text) if row[f"n{i}"] and row[f"n{i}"] == row[f"k{i}"]]
    return df.select(*[parse_numeric(c).alias(c) if c in numbers else F.col(c) for c in df.columns]), numbers


NOTEBOOK = "cells array<struct<cell_type:string,source:array<string>,outputs:array<struct<text:array<string>>>>>"


def notebook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(rel, cell_no from 1, cell_type, source, output) of notebooks."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_name").alias("rel"), F.from_json("value", NOTEBOOK).alias("nb"))
    cells = raw.select("rel", F.posexplode("nb.cells").alias("pos", "c"))
    output = F.array_join(F.flatten(F.transform(F.coalesce("c.outputs", F.array().cast("array<struct<text:array<string>>>")), lambda o: F.coalesce(o.text, F.array().cast("array<string>")))), "")
    return cells.select("rel", (F.col("pos") + 1).alias("cell_no"), "c.cell_type", F.array_join("c.source", "").alias("source"), output.alias("output"))


def json_paths(df: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """Adds text columns of dotted JSON paths; a missing path or bad JSON gives null."""
    return df.select("*", *[F.get_json_object(column, f"$.{p}").alias(name) for name, p in paths.items()])


def write_version(df: DataFrame, folder: str, keys: list[str], partition_by: list[str] | None = None) -> str:
    """Writes a new version of a table next to the old ones and returns its folder.

    The folder's name comes from the content of the schema and the number of versions, and readers take
    the last one that has a _SUCCESS mark: a write that broke off is never read.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    n = len(fs.listStatus(path)) if fs.exists(path) else 0
    out = f"{folder}/v{n:06d}"
    writer = df.sortWithinPartitions(*keys).write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(out)
    return out


def read_latest(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The last whole version; an empty table where there is none or its schema differs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(str(s.getPath()) for s in fs.listStatus(path)) if fs.exists(path) else []
    whole = [v for v in versions if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(v + "/_SUCCESS"))]
    if whole:
        df = spark.read.parquet(whole[-1])
        if {(f.name, f.dataType) for f in df.schema.fields} == {(f.name, f.dataType) for f in schema.fields}:
            return df.select(*[f.name for f in schema.fields])
    return spark.createDataFrame([], schema)


def unchanged(new: DataFrame, old: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(rows to rebuild, keys that stay): by content hash, for an incremental build."""
    h = F.sha2(F.coalesce(F.col(content), F.lit("")), 256)
    before = old.select(key, h.alias("_h")).distinct()
    now = new.withColumn("_h", h)
    return now.join(before, [key, "_h"], "left_anti").drop("_h"), now.join(before, [key, "_h"], "left_semi").select(key)
