"""Problem 7: find corpus documents that contain passages of evaluation items.

A distributed positional inverted index. It is partitioned by document: each task indexes the documents of its
batch, term by term and place by place, and meets the test items there, so that no posting is ever shuffled.

1. Texts are brought to one form: NFKC, lower case, only letters and digits. A term is a window of 6
   characters with CJK in it, or of 12 without. `Terms` lists the terms of all items with
   their offsets.
2. A text is hashed with numpy, a batch at a time. The test set is broadcast in blocks of bounded size
   (`ITEM_CHARS`), and the corpus is scanned once for each. Every posting of a test term counts, however
   frequent the term is. Items shorter than a term are single terms of their own length.
3. `candidates`: postings, shifted by the term's offset in the item, say where the item would start in the
   document. Every such place is a candidate; those near each other, as in altered text, are one.
4. `hopeful`: an upper bound on what an alignment can reach, so that nothing is lost by it.
5. `aligned`: a banded local alignment over the whole item decides, in the same task. Altered characters
   cost `PENALTY`, so a passage ends where more than about one character in ten is altered. A passage without
   any altered character is an exact phrase, any other one a proximity match.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftdocs.session import spread, table

SHORT, LONG = 6, 12
BUCKET, SLACK, STEP = 64, 16, 16
GRAM = 3  # characters of a start counted by the bound
SHARE, PENALTY = 0.5, 4.0
BASE = np.uint64(0x9E3779B97F4A7C15)
END = 1  # stands between texts
ITEM_CHARS = 4_000_000  # characters of the test items that are broadcast at a time
BATCH_ROWS, BLOCK = 256, 1 << 20  # texts hashed and uses of terms expanded at a time, for memory only


@lru_cache(None)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per UTF-16 unit: its form (0 where dropped), whether it needs full normalisation, whether it is CJK."""
    form, hard, cjk = np.zeros(65536, "u2"), np.zeros(65536, bool), np.zeros(65536, bool)
    for c in range(65536):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        n = unicodedata.normalize("NFKC", ch).lower()
        if len(n) == 1 and ord(n) < 65536:
            if n.isalnum():
                form[c] = ord(n)
        elif any(x.isalnum() for x in n):
            hard[c] = True
        if unicodedata.combining(ch) or 0xFF9E <= c <= 0xFF9F:
            hard[c] = True
        cjk[c] = 0x3040 <= c < 0x3100 or 0x3400 <= c < 0xA000
    form[END] = END
    return form, hard, cjk


def normal(texts: list[str]) -> np.ndarray:
    """One array of UTF-16 units: every text in its one form, END after each."""
    form, hard, _ = tables()
    raw = np.frombuffer((chr(END).join(texts) + chr(END)).encode("utf-16-le", "replace"), "u2")
    if hard[raw].any():
        texts = [unicodedata.normalize("NFKC", t).replace(chr(END), " ") if hard[np.frombuffer(t.encode("utf-16-le", "replace"), "u2")].any() else t for t in texts]
        raw = np.frombuffer((chr(END).join(texts) + chr(END)).encode("utf-16-le", "replace"), "u2")
    out = form[raw]
    return out[out != 0]


@lru_cache(None)
def powers() -> list[np.uint64]:
    out = [np.uint64(1)]
    with np.errstate(over="ignore"):
        for _ in range(SHORT):
            out.append(out[-1] * BASE)
    return out


def hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, usable) of the term that starts at each position."""
    _, _, cjk = tables()
    n = len(codes) - LONG + 1
    if n <= 0:
        codes = np.append(codes, np.full(LONG - len(codes), END, "u2"))
        n = 1
    codes = np.append(codes, np.full(LONG, END, "u2"))
    n = len(codes) - LONG + 1
    wide, p = codes.astype("u8"), powers()
    with np.errstate(over="ignore"):
        short = np.zeros(len(codes) - SHORT + 1, "u8")
        for k in range(SHORT):
            short += wide[k : k + len(short)] * p[k]
        both = short[:n] + short[SHORT : SHORT + n] * p[SHORT]
        is_cjk = np.concatenate([[0], np.cumsum(cjk[codes])])
        ends = np.concatenate([[0], np.cumsum(codes == END)])
        with_cjk = is_cjk[SHORT : SHORT + n] > is_cjk[:n]
        value = np.where(with_cjk, short[:n] * np.uint64(3), both * np.uint64(5))
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        free = np.where(with_cjk, ends[SHORT : SHORT + n] == ends[:n], ends[LONG : LONG + n] == ends[:n])
    return value, free


def forms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, form): each item's text in its one form, once per key."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: normal([t.replace(chr(END), " ")])[:-1].tobytes().decode("utf-16-le"))

    return items.filter(F.length(text) > 0).select(F.col(item).alias("item"), form(text).alias("form")).dropDuplicates(["item"])


class Terms:
    """Positional index of the test items: each term with all its places (item, offset)."""

    def __init__(self, texts: list[str]):
        self.codes = [np.frombuffer(t.encode("utf-16-le"), "u2") for t in texts]
        self.size = np.array([len(c) for c in self.codes], dtype="i8")
        first = np.cumsum(self.size + 1) - self.size - 1
        joined = np.concatenate([x for c in self.codes for x in (c, np.array([END], "u2"))] or [np.array([END], "u2")])
        value, free = hashes(joined)
        at = np.flatnonzero(free)
        at = at[np.argsort(value[at], kind="stable")]
        self.term, self.first, self.uses = np.unique(value[at], return_index=True, return_counts=True)
        self.item = np.searchsorted(first, at, side="right") - 1
        self.offset = at - first[self.item] if len(at) else at
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.term >> np.uint64(42)).astype("i8")] = True

    def postings(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, k): the positions of test terms, and which term."""
        value, free = hashes(codes)
        at = np.flatnonzero(self.sieve[(value >> np.uint64(42)).astype("i8")] & free)
        k = np.minimum(np.searchsorted(self.term, value[at]), len(self.term) - 1)
        same = self.term[k] == value[at]
        return at[same], k[same]

    def starts(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(posting, item, start): where each item that has the term would start, for every place of the term."""
        n = self.uses[k]
        source = np.repeat(np.arange(len(at)), n)
        place = np.arange(len(source)) + np.repeat(self.first[k] - np.cumsum(n) + n, n)
        return source, self.item[place], at[source] - self.offset[place]


def candidates(doc: np.ndarray, item: np.ndarray, start: np.ndarray, items: int) -> np.ndarray:
    """Rows (doc, item, low, high): starts of the item in the document, those near each other as one candidate."""
    if not len(start):
        return np.zeros((0, 4), "i8")
    bucket, least = start // BUCKET, start.min() // BUCKET - 1
    wide = bucket.max() - least + 1
    # overlapping buckets, so that starts near each other always share one
    pair = (doc * items + item) * wide - least
    key, start = np.concatenate([pair + bucket, pair + bucket - 1]), np.concatenate([start, start])
    order = np.argsort(key, kind="stable")
    key, start = key[order], start[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    low, high = np.minimum.reduceat(start, first), np.maximum.reduceat(start, first)
    pair = key[first] // wide
    # what lies within its neighbour is left to that one
    inside = lambda i, j: (pair[i] == pair[j]) & (low[i] >= low[j]) & (high[i] <= high[j])
    kept = np.ones(len(first), bool)
    kept[1:] &= ~inside(slice(1, None), slice(None, -1))
    kept[:-1] &= ~(inside(slice(None, -1), slice(1, None)) & ~inside(slice(1, None), slice(None, -1)))
    pair, low, high = pair[kept], low[kept], high[kept]
    high = low + (high - low) // STEP * STEP + STEP - 1  # widths of few sizes
    return np.stack([pair // items, pair % items, low, high], 1)


def grams(codes: np.ndarray) -> np.ndarray:
    """A number from 1 for the GRAM characters from each place on; different ones seldom share it."""
    n = codes.shape[1] - GRAM + 1
    mixed = np.zeros((len(codes), n), "u4")
    for g in range(GRAM):
        mixed = mixed * np.uint32(0x01000193) + codes[:, g : g + n]
    return ((mixed * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("u2") | np.uint16(1)


def hopeful(left: np.ndarray, right: np.ndarray, size: np.ndarray, share: float) -> np.ndarray:
    """Whether an alignment in the band can reach the share: an upper bound, nothing that reaches it is refused.

    All scores on the way of a local alignment are positive, so its first n offsets, n being the share, hold
    less than n / (1 + PENALTY) altered ones. Each takes at most GRAM of the n - GRAM + 1 starts of GRAM equal
    characters, so more than n - GRAM + 1 - GRAM * n / (1 + PENALTY) starts are left on some diagonal of the band.
    """
    a, b = grams(left), grams(right)
    starts = a.shape[1]
    a[np.arange(starts) > (size - GRAM)[:, None]] = 0  # no gram
    hit = np.zeros(a.shape, bool)
    for d in range(right.shape[1] - left.shape[1] + 1):
        hit |= b[:, d : d + starts] == a
    total = np.zeros((len(left), starts + 1), "i4")
    np.cumsum(hit, axis=1, out=total[:, 1:])
    n = np.ceil(size * share - 1e-9).astype("i8")
    ends = np.minimum(np.arange(total.shape[1]) + np.maximum(n - GRAM + 1, 0)[:, None], total.shape[1] - 1)
    most = (np.take_along_axis(total, ends, 1) - total).max(1)
    return most > n - GRAM + 1 - GRAM * n / (1 + PENALTY) - 1e-9


def found_in(codes: np.ndarray, terms: Terms, share: float) -> list[tuple[int, int, np.ndarray, int, int]]:
    """(document, item, part, low, high): the places of the texts that have to be aligned, and the text around them."""
    at, k = terms.postings(codes)
    ends = np.flatnonzero(codes == END)
    first = np.concatenate([[0], ends[:-1] + 1])
    of = np.searchsorted(ends, at)
    out = []
    # memory only: whole documents, about BLOCK uses of terms at a time
    uses = np.concatenate([[0], np.cumsum(np.bincount(of, terms.uses[k], len(ends)))])
    block = (uses[:-1] // BLOCK).astype("i8")
    for b in np.unique(block[of]):
        own = block[of] == b
        source, item, start = terms.starts((at - first[of])[own], k[own])
        rows = candidates(of[own][source], item, start, len(terms.size))
        group = (rows[:, 3] - rows[:, 2]) * (1 << 32) + terms.size[rows[:, 1]] // 64
        order = np.argsort(group, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            for i in range(0, len(part), 256):
                some = rows[part[i : i + 256]]
                if not len(some):
                    continue
                doc, item, low = some[:, 0], some[:, 1], some[:, 2]
                size, wide = terms.size[item], int(some[0, 3] - some[0, 2]) + 2 * SLACK
                left = np.zeros((len(some), max(int(size.max()), GRAM)), "u2")
                for r, x in enumerate(item):
                    left[r, : size[r]] = terms.codes[x]
                place = (low - SLACK)[:, None] + np.arange(left.shape[1] + wide)
                within = (place >= 0) & (place < (ends - first)[doc][:, None])
                right = np.where(within, codes[np.clip(place + first[doc][:, None], 0, len(codes) - 1)], np.uint16(END))
                for r in np.flatnonzero(hopeful(left, right, size, share)):
                    out.append((int(doc[r]), int(item[r]), right[r], SLACK, SLACK + int(some[r, 3] - low[r])))
    return out


def aligned(pairs: list[tuple[str | np.ndarray, str | np.ndarray, int, int]]) -> np.ndarray:
    """For (item, document, low, high): first and last offset of the item's best passage and its score, by banded local alignment.

    A cell holds the score and, below it, how early its passage starts, so that of equal scores the longer passage is taken.
    """
    n = len(pairs)
    a, b = ([np.frombuffer(x.encode("utf-16-le"), "u2") if isinstance(x, str) else x for x in side] for side in list(zip(*pairs, strict=True))[:2])
    low = np.array([p[2] - SLACK for p in pairs])
    width = max(p[3] - p[2] for p in pairs) + 2 * SLACK + 1
    rows = max(map(len, a))
    left = np.zeros((rows, n), "u2")
    right = np.zeros((rows + width, n), "u2")  # line i + k holds the document at low + i + k
    for i in range(n):
        left[: len(a[i]), i] = a[i]
        s = low[i]
        part = b[i][max(0, s) : max(0, s + rows + width)]
        right[max(0, -s) : max(0, -s) + len(part), i] = part
    left[left == 0] = END  # the document's part has no END within
    right[right == END] = 0
    bits = rows.bit_length()
    kind = np.int32 if (rows + PENALTY * width) * 2 ** (bits + 1) < 2**31 else np.int64
    one, cost = kind(1 << bits), kind(int(PENALTY) << bits)
    score = np.full((width + 1, n), rows, kind)
    score[width] = 0
    steps = (np.arange(width, dtype=kind) * cost)[:, None]
    best, last = np.full(n, rows, kind), np.zeros(n, "i4")
    for r in range(rows):
        same = right[r : r + width] == left[r]
        cur = score[:width] - cost
        np.add(cur, one + cost, out=cur, where=same)
        np.maximum(cur, score[1:] - cost, out=cur)
        np.copyto(cur, kind(rows - r - 1), where=cur < one)
        cur += steps
        k = 1
        while k < width:
            cur[k:] = np.maximum(cur[k:], cur[:-k])
            k *= 2
        cur -= steps
        score[:width] = cur
        now = cur.max(0)
        better = now >> bits > best >> bits
        best = np.where(better, now, best)
        last = np.where(better, r + 1, last)
    first = np.where(last > 0, rows - (best & (one - 1)), 0)
    return np.stack([first, last, best >> bits], 1)


def short_items(codes: np.ndarray, items: list[np.ndarray]) -> list[tuple[int, int]]:
    """(document, number of the item): texts that hold an item shorter than a term, as it is."""
    out = []
    ends = np.flatnonzero(codes == END)
    for size in sorted({len(x) for x in items}):
        windows = np.lib.stride_tricks.sliding_window_view(codes, size) if len(codes) >= size else np.zeros((0, size), "u2")
        key = np.zeros(len(windows), "u8")
        with np.errstate(over="ignore"):
            for k in range(size):
                key = key * BASE + windows[:, k]
            for i, x in enumerate(items):
                if len(x) == size:
                    mine = np.uint64(0)
                    for c in x:
                        mine = mine * BASE + np.uint64(c)
                    at = np.flatnonzero(key == mine)
                    at = at[(windows[at] == x).all(1)]
                    out += [(int(d), i) for d in np.unique(np.searchsorted(ends, at))]
    return out


def blocks_of(held: DataFrame) -> list[tuple[int, int]]:
    """Ranges of hashes (low, high) of items with about ITEM_CHARS characters each: one range for a test set of usual size."""
    n = held.agg(F.coalesce(F.sum(F.length("form")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-n // ITEM_CHARS))
    step = (1 << 30) // parts + 1
    return [(k * step, (k + 1) * step) for k in range(parts)]


def find(docs: DataFrame, doc: str, items: DataFrame, item: str, text: str = "text", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc, item, share, exact): documents that hold at least `share` of an item as one passage, once per pair.

    Texts that are null, empty or without letters and digits match nothing. Repeated documents and
    items are each reported under their own key; rows that repeat a key count once. Other columns are
    ignored. Without items or without documents there are no rows. An item shorter than a term is found
    where a document holds all of it unaltered. exact: the passage is a phrase without altered characters.
    """
    source = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).filter(F.length("_text") > 0)
    schema = f"doc {source.schema['_doc'].dataType.simpleString()}, item {items.schema[item].dataType.simpleString()}, share double, exact boolean"

    def scanned(held: list) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(([r["item"] for r in held], Terms([r["form"] for r in held])))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, terms = shared.value
            known = set(terms.item.tolist())
            short = [i for i, n in enumerate(terms.size) if n and i not in known]
            for big in batches:
                places, rows = [], []
                for at_row in range(0, len(big), BATCH_ROWS):
                    batch = big.iloc[at_row : at_row + BATCH_ROWS]
                    codes = normal([t.replace(chr(END), " ") for t in batch["_text"]])
                    if len(terms.term):
                        places += [(at_row + d, *rest) for d, *rest in found_in(codes, terms, share)]
                    rows += [(at_row + d, short[i], 1.0, True) for d, i in short_items(codes, [terms.codes[i] for i in short])]
                places.sort(key=lambda p: (p[4] - p[3], terms.size[p[1]]))
                for i in range(0, len(places), 256):
                    some = places[i : i + 256]
                    span = aligned([(terms.codes[k], part, low, high) for _, k, part, low, high in some])
                    reached = (span[:, 1] - span[:, 0]) / terms.size[[p[1] for p in some]]
                    rows += [(some[g][0], some[g][1], float(reached[g]), bool(span[g, 2] == span[g, 1] - span[g, 0])) for g in np.flatnonzero(reached >= share)]
                if rows:
                    d, i, reached, exact = zip(*rows, strict=True)
                    yield pd.DataFrame({"doc": big["_doc"].iloc[list(d)].to_numpy(), "item": [names[k] for k in i], "share": reached, "exact": exact})

        return source.mapInPandas(scan, schema)

    held = forms(items, item, item_text).withColumn("_h", F.pmod(F.xxhash64("item"), F.lit(1 << 30)))
    passed = None
    for low, high in blocks_of(held):
        part = scanned(held.filter((F.col("_h") >= low) & (F.col("_h") < high)).select("item", "form").collect())  # ITEM_CHARS characters
        passed = part if passed is None else passed.unionByName(part)
    best = passed.groupBy("doc", "item").agg(F.max(F.struct("share", "exact")).alias("best"))
    return best.select(F.col("doc").alias(doc), F.col("item").alias(item), "best.share", "best.exact")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = spread(table(spark, folder, "documents")), table(spark, folder, "eval_items")
    return find(docs, "doc_id", items, "item_id").select("doc_id", "item_id")


def p7_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks with the share of the item that the document holds, and whether it holds it as an exact phrase."""
    docs, items = spread(table(spark, folder, "documents")), table(spark, folder, "eval_items")
    return find(docs, "doc_id", items, "item_id").withColumn("share", F.round("share", 4))
