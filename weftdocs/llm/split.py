"""Problem 1: cut oversized texts into overlapping pieces at natural boundaries.

A piece [s, e) must be at most `limit` characters and at least `least` unless it ends the text. Every
end e has a penalty by the kind of boundary it stands on (new line 0, end of sentence 1, blank 2,
nowhere 3) and an imbalance, the room it leaves unused. The next piece starts at e - overlap, so the
best plan from a start depends on that start only.

`best_plan` is dynamic programming over all boundary positions of a text, from the last to the first:
the cost of a start is the least, over all ends within reach, of the cost of that piece plus the
discounted cost of the start after it. Two objectives differ in cost and discount:

* `ordered`: penalty and then unused room, discounted so strongly that no later piece outweighs a
  difference in an earlier one. Plans are compared piece by piece. This is the objective of p1_found.
* `total`: penalty + (unused / limit) ** 2, without discount: the least sum over all pieces.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftdocs.session import table

LIMIT, OVERLAP, LEAST = 1200, 180, 601

NOWHERE = 3  # penalty of an end that is no boundary


@lru_cache(1)
def marks() -> np.ndarray:
    """Penalty of an end behind each character of the Basic Multilingual Plane; . ! and ? count as NOWHERE + 1."""
    out = np.full(1 << 16, NOWHERE, "i1")
    for penalty, chars in ((2, " \u3000"), (1, "。！？"), (0, "\n"), (NOWHERE + 1, ".!?")):
        out[[ord(c) for c in chars]] = penalty
    return out


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(ends, penalties) of all natural boundaries, in order; an end lies right after its mark."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4")
    penalty = marks()[np.minimum(codes, 0xFFFF)]
    at = np.flatnonzero(penalty != NOWHERE)
    kind = penalty[at].astype("i8")
    stop = kind == NOWHERE + 1
    before_blank = np.append(codes[1:], 0)[at] == ord(" ")
    kind[stop] = 1
    kept = ~stop | before_blank
    return at[kept] + 1, kind[kept]


def best_plan(text: str, limit: int, overlap: int, least: int, objective: str) -> list[tuple[int, int]]:
    """(start, end) of the pieces of the cheapest plan. A piece without a boundary in reach ends at the limit."""
    n = len(text)
    ends, penalty = boundaries(text)
    ordered = objective == "ordered"
    # ordered: a step costs a whole number below 1 / discount, so that all later steps together cost less than one
    discount = 1 / ((NOWHERE + 2) * (limit + 1)) if ordered else 1.0
    steps = penalty * float(limit + 1) if ordered else penalty * 1.0

    def last(start: int) -> float:
        return 0.0 if ordered else ((limit - n + start) / limit) ** 2

    def options(high: np.ndarray, part: slice) -> np.ndarray:
        room = high - ends[part]
        return steps[part] + (room if ordered else (room / limit) ** 2)

    starts = ends - overlap
    low, high = np.searchsorted(ends, starts + least), np.searchsorted(ends, starts + limit, side="right")
    after = np.zeros(len(ends))  # least cost from the start that follows each end
    chosen: dict[int, int] = {}  # start -> end
    cost: dict[int, float] = {}  # of starts that follow a cut at no boundary

    def settle(start: int, a: int, b: int) -> float:
        """Least cost from a start, all starts behind it being settled."""
        chain = []
        while n - start > limit and a == b and start not in cost:
            chain.append(start)
            chosen[start] = start + limit
            start += limit - overlap
            a, b = np.searchsorted(ends, start + least), np.searchsorted(ends, start + limit, side="right")
        if start in cost:
            value = cost[start]
        elif n - start <= limit:
            chosen[start], value = n, last(start)
        else:
            part = slice(a, b)
            values = options(start + limit, part) + discount * after[part]
            best = len(values) - 1 - int(values[::-1].argmin())  # of equals the latest
            chosen[start], value = int(ends[a + best]), float(values[best])
        for s in reversed(chain):
            value = NOWHERE * (limit + 1 if ordered else 1) + discount * value
            cost[s] = value
        return value

    # Starts less than least - overlap apart do not follow each other, so a block of them is settled at once.
    end_of = np.zeros(len(ends), "i8")
    begin, j = (int(np.searchsorted(starts, x, side="right")) for x in (0, max(0, n - limit - 1)))
    if not ordered:
        after[j:] = ((limit - n + starts[j:]) / limit) ** 2
    end_of[j:] = n  # what is left from these starts is the last piece
    while j > begin:
        i = max(begin, int(np.searchsorted(starts, starts[j - 1] - (least - overlap), side="right")))
        plain = low[i:j] < high[i:j]
        for k in i + np.flatnonzero(~plain):
            after[k] = settle(int(starts[k]), low[k], high[k])
            end_of[k] = chosen[int(starts[k])]
        some = i + np.flatnonzero(plain)
        if len(some):
            width = int((high[some] - low[some]).max())
            at = high[some][:, None] - 1 - np.arange(width)  # from the latest end on, so that it wins a tie
            within = at >= low[some][:, None]
            at = np.maximum(at, 0)
            room = (starts[some] + limit)[:, None] - ends[at]
            values = np.where(within, steps[at] + (room if ordered else (room / limit) ** 2) + discount * after[at], np.inf)
            best = values.argmin(1)
            rows = np.arange(len(some))
            after[some], end_of[some] = values[rows, best], ends[at[rows, best]]
        j = i
    settle(0, np.searchsorted(ends, least), np.searchsorted(ends, limit, side="right"))
    pieces, start = [], 0
    while True:
        end = chosen[start] if start in chosen else int(end_of[np.searchsorted(starts, start)])
        pieces.append((start, end))
        if end == n:
            return pieces
        start = end - overlap


def split_oversized(
    df: DataFrame, keys: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP,
    least: int = LEAST, objective: str = "ordered",
) -> DataFrame:
    """Pieces of every text longer than `limit`: the key columns, piece_no, start_pos and end_pos.

    Null, empty and short texts give no rows. Repeated rows give repeated pieces. Columns other than
    the keys and the text are ignored. A text without any boundary in reach is cut at `limit`. Positions count
    code points from 0. Narrow: no shuffle, and one text at a time in memory.
    """
    if not overlap < least <= limit:
        raise ValueError("overlap < least <= limit must hold")
    if objective not in ("ordered", "total"):
        raise ValueError("objective must be ordered or total")

    @F.pandas_udf("array<struct<piece_no:int,start_pos:int,end_pos:int>>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(i, s, e) for i, (s, e) in enumerate(best_plan(t, limit, overlap, least, objective), 1)])

    return (
        df.select(*keys, F.col(text).alias("_text"))
        .filter(F.length("_text") > limit)
        .select(*keys, F.explode(pieces("_text")).alias("_piece"))
        .select(*keys, "_piece.piece_no", "_piece.start_pos", "_piece.end_pos")
    )


def sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "extracted_docs").select(F.lit("extracted_docs").alias("src"), F.col("ext_id").alias("item_id"), "text")
    chunks = table(spark, folder, "chunks").select(F.lit("chunks").alias("src"), F.col("id").alias("item_id"), "text")
    return docs.unionByName(chunks)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(sources(spark, folder), ["src", "item_id"])


def p1_balanced(spark: SparkSession, folder: str) -> DataFrame:
    """The same texts under the total objective: fewer bad cuts and more even pieces."""
    return split_oversized(sources(spark, folder), ["src", "item_id"], objective="total")


# w holds the 600 characters after which a piece may end, and the one that follows them.
P1_SQL = r"""
WITH RECURSIVE src AS (
  SELECT 'extracted_docs' AS src, ext_id AS item_id, text FROM extracted_docs WHERE length(text) > 1200
  UNION ALL SELECT 'chunks', id, text FROM chunks WHERE length(text) > 1200),
p(src, item_id, text, piece_no, s, e) AS (
  SELECT src, item_id, text, 0, 0::BIGINT, 180::BIGINT FROM src
  UNION ALL
  SELECT src, item_id, text, piece_no + 1, s, CASE
    WHEN n - s <= 1200 THEN n
    WHEN line > 0 THEN s + 600 + line
    WHEN greatest(stop, dot - 1) > 0 THEN s + 600 + greatest(stop, dot - 1)
    WHEN blank > 0 THEN s + 600 + blank
    ELSE s + 1200 END
  FROM (SELECT src, item_id, text, piece_no, s, n, length(regexp_extract(w[:600], '(?s)^.*\n')) AS line,
          length(regexp_extract(w[:600], '(?s)^.*[。！？]')) AS stop, length(regexp_extract(w, '(?s)^.*[.!?] ')) AS dot,
          length(regexp_extract(w[:600], '(?s)^.*[ 　]')) AS blank
        FROM (SELECT src, item_id, text, piece_no, e - 180 AS s, length(text) AS n, substr(text, (e + 421)::BIGINT, 601) AS w
              FROM p WHERE e < length(text))))
SELECT src, item_id, piece_no, s::INT AS start_pos, e::INT AS end_pos FROM p WHERE piece_no > 0"""
