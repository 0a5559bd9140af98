"""Problem 6: fill containers of fixed capacity with items of varying length.

Bounded-space online best-fit. A task holds a fixed number of open containers. A bitset keyed by free
space (bit f is set when an open container has exactly f free) answers "the tightest container that
still takes this item" with one shift and one lowest-set-bit. When all places are taken, the fullest
container closes first. Only an item larger than a container is cut: into full containers and a rest
that is packed like any other item.

Every partition packs its own rows, so there is no shuffle and the number of containers left open is
bounded by the number of tasks times `open_bins`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftdocs.session import table

CAPACITY, OPEN_BINS = 2048, 128


class Bins:
    """Open containers of one task."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.room = capacity, open_bins
        self.mask, self.by_free, self.count, self.made = 0, {}, 0, 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            del self.by_free[free]
            self.mask ^= 1 << free
        self.count -= 1
        return number

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def put(self, size: int) -> tuple[int, int]:
        """(container, its offset) for an item of size 1..capacity."""
        fits = self.mask >> size
        if fits:
            free = (fits & -fits).bit_length() - 1 + size
            number = self._take(free)
        else:
            if self.count == self.room:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            free, number = self.capacity, self.new()
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(number)
            self.mask |= 1 << left
            self.count += 1
        return number, self.capacity - free


def rule_tokens(text: str | Column) -> Column:
    """Tokens by rule: a longest run of A-Z a-z 0-9 _, or any other character but space, tab, CR, LF."""
    packed = F.regexp_replace(text, "[A-Za-z0-9_]+", "x")
    return F.length(F.translate(packed, " \t\r\n", "")).cast("long")


def file_tokens(path: str):
    """Column function: tokens by a public vocabulary file (a tokenizers .json), read on each executor."""

    @F.pandas_udf("long")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for texts in batches:
            known = texts.dropna()
            yield pd.Series([len(e.ids) for e in tok.encode_batch(known.tolist(), add_special_tokens=False)], index=known.index, dtype="Int64").reindex(texts.index)

    return measure


def pack(df: DataFrame, key: str, size: str | Column, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per placed part: key, part_no, parts, start, tokens, container_id, at.

    `start` is the part's first token in its item, `at` its first token in the container; container_id
    is unique over the whole job. Items of size null, zero or less take no space and give no row; an
    item of exactly `capacity` fills one container and is not cut. Repeated rows are packed again, ties
    go to the container that got that free space last. Other columns are ignored.
    """

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, base = Bins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[tuple] = []
            for i, n in enumerate(batch["_size"].to_numpy()):
                full, rest = divmod(int(n), capacity)
                parts = full + (rest > 0)
                for k in range(full):
                    rows.append((i, k + 1, parts, k * capacity, capacity, base + bins.new(), 0))
                if rest:
                    number, at = bins.put(rest)
                    rows.append((i, parts, parts, full * capacity, rest, base + number, at))
            if rows:
                at = np.array(rows, dtype="int64")
                out = pd.DataFrame(at[:, 1:], columns=["part_no", "parts", "start", "tokens", "container_id", "at"])
                out.insert(0, key, batch[key].to_numpy()[at[:, 0]])
                yield out

    sized = df.select(F.col(key), (F.col(size) if isinstance(size, str) else size).cast("long").alias("_size"))
    kind = sized.schema[key].dataType.simpleString()
    return sized.filter(F.col("_size") > 0).mapInPandas(fill, f"`{key}` {kind}, part_no long, parts long, start long, tokens long, container_id long, at long")


def _sizes(spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    return table(spark, folder, "documents"), F.coalesce(F.col("n_tokens").cast("long"), rule_tokens("text"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that had to be cut."""
    docs, size = _sizes(spark, folder)
    return pack(docs, "doc_id", size).filter("part_no = 1 AND parts > 1").select("doc_id")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are: containers by tenths of fill, with tokens and free space."""
    docs, size = _sizes(spark, folder)
    bins = pack(docs, "doc_id", size).groupBy("container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    return bins.groupBy(F.least(F.floor(F.col("tokens") * 10 / CAPACITY), F.lit(9)).alias("tenth")).agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.sum(CAPACITY - F.col("tokens")).alias("free")
    )


P6_SQL = r"""
SELECT doc_id FROM documents
WHERE length(translate(regexp_replace(text, '[A-Za-z0-9_]+', 'x', 'g'), ' ' || chr(9) || chr(13) || chr(10), '')) > 2048"""
