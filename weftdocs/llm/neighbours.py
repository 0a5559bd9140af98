"""Problem 3: for every vector, the most similar vectors of the collection.

1. Directions are spread over cells by a tree of centres. Of the root's centres, from spherical k-means on
   a bounded sample, a vector belongs to the OVERLAP nearest ones. A cell that turns out too large, however
   crowded its place is, gets finer centres from a bounded sample of its own vectors, and its vectors go to
   the SPLIT nearest of those; and so on, LEVELS deep. k-means runs in tasks, one group for each cell. The
   tree is as large as the number of cells, about one centre for each CELL / OVERLAP vectors.
2. In each cell a robust-pruned directed graph is built. Vectors are inserted in rounds; a greedy beam
   search over the graph so far proposes neighbours, and relaxed pruning keeps those that no kept
   neighbour is RELAX times closer to. Edges back are added and pruned alike.
3. A beam search answers each vector's own query in each of its cells. The similarities of what
   it returns are exact, and the answers of all cells are merged.

A cell that no finer centres can part is a shard by hash; its vectors ask all shards, in bounded blocks of
queries. Vectors of different lengths have trees of their own. Copies of a vector, scaled ones too, would
crowd one place of the graph; they are searched once and joined again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftdocs.session import cut, table

SAMPLE, ROUNDS = 20_000, 6  # vectors of one k-means, and its rounds
CELL, OVERLAP, SPLIT = 4_000, 4, 2  # vectors of a cell; cells of a vector; finer cells of a vector, for each of its cells
FANOUT, LEVELS = 1_000, 4  # centres of a node; depth of the tree
CHUNK = 1_024  # vectors compared with centres at a time, for memory only
DEGREE, BEAM, RELAX, FIRST = 24, 40, 1.2, 256  # edges of a vertex, width of the search, pruning, first round
K, LEAST = 5, 0.85


class Graph:
    """A robust-pruned directed graph over unit vectors."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX):
        self.x, self.degree, self.beam, self.relax = x, degree, beam, relax
        n = len(x)
        self.edges = np.full((n, degree), -1, "i4")
        self.entry = np.arange(min(n, 16))
        order = np.random.default_rng(5).permutation(n)
        self.entry = order[: min(n, 16)]
        # the first vectors are few and see each other
        first = order[: min(n, FIRST)]
        self._connect(first, np.broadcast_to(first, (len(first), len(first))))
        at = len(first)
        while at < n:
            batch = order[at : min(n, 2 * at, at + 2048)]
            for s in range(0, len(batch), 512):
                part = batch[s : s + 512]
                self._connect(part, self.search(x[part], beam)[0])
            at += len(batch)

    def _prune(self, points: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Of the proposed vertices, the kept edges: nearest first, without those nearer to a kept one."""
        x = self.x
        sims = np.einsum("bd,bcd->bc", x[points], x[found])
        sims[(found == points[:, None]) | (found < 0)] = -9
        order = np.argsort(-sims, axis=1)
        found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
        twice = np.zeros(found.shape, bool)
        twice[:, 1:] = (found[:, 1:] == found[:, :-1]) & (sims[:, 1:] == sims[:, :-1])
        far = 2 - 2 * sims  # squared distances
        alive = (sims > -9) & ~twice
        kept = np.full((len(points), self.degree), -1, "i4")
        rows = np.arange(len(points))
        vectors = x[found]
        for k in range(self.degree):
            some = alive.any(1)
            if not some.any():
                break
            pick = alive.argmax(1)
            kept[some, k] = found[rows[some], pick[some]]
            near = 2 - 2 * np.einsum("bd,bcd->bc", vectors[rows, pick], vectors)
            alive &= ~((self.relax**2 * near <= far) & some[:, None])
            alive[rows, pick] = False
        return kept

    def _connect(self, points: np.ndarray, found: np.ndarray) -> None:
        self.edges[points] = self._prune(points, found)
        # edges back
        src = np.repeat(points, self.degree)
        dst = self.edges[points].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, size = np.unique(dst, return_index=True, return_counts=True)
        free = (self.edges[targets] < 0).sum(1)
        fits = size <= free
        for t, f, n in zip(targets[fits], first[fits], size[fits], strict=True):
            own = self.edges[t]
            own[np.flatnonzero(own < 0)[:n]] = src[f : f + n]
        full = np.flatnonzero(~fits)
        for s in range(0, len(full), 512):
            some = full[s : s + 512]
            width = int(size[some].max())
            more = np.full((len(some), width), -1, "i4")
            for k, i in enumerate(some):
                more[k, : size[i]] = src[first[i] : first[i] + size[i]]
            self.edges[targets[some]] = self._prune(targets[some], np.concatenate([self.edges[targets[some]], more], 1))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(vertices, similarities) of each query's beam, best first."""
        x, b = self.x, len(q)
        seen = np.zeros((b, len(x)), bool)
        rows = np.arange(b)[:, None]
        ids = np.full((b, beam), -1, "i4")
        sims = np.full((b, beam), -9.0, "f4")
        done = np.ones((b, beam), bool)
        start = np.broadcast_to(self.entry, (b, len(self.entry)))
        seen[rows, start] = True
        m = min(beam, start.shape[1])
        ids[:, :m], sims[:, :m], done[:, :m] = start[:, :m], (q @ x[self.entry].T)[:, :m], False
        active = np.arange(b)
        while len(active):
            open_sims = np.where(done[active], -9, sims[active])
            pick = open_sims.argmax(1)
            going = open_sims[np.arange(len(active)), pick] > -9
            active, pick = active[going], pick[going]
            if not len(active):
                break
            vertex = ids[active, pick]
            done[active, pick] = True
            around = self.edges[vertex]
            known = (around < 0) | seen[active[:, None], np.maximum(around, 0)]
            seen[active[:, None], np.maximum(around, 0)] |= around >= 0
            fresh = np.einsum("bd,brd->br", q[active], x[np.maximum(around, 0)])
            fresh[known] = -9
            all_sims = np.concatenate([sims[active], fresh], 1)
            all_ids = np.concatenate([ids[active], np.where(known, -1, around)], 1)
            all_done = np.concatenate([done[active], known], 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(all_ids, top, 1)
            sims[active] = np.take_along_axis(all_sims, top, 1)
            done[active] = np.take_along_axis(all_done, top, 1) | (np.take_along_axis(all_ids, top, 1) < 0)
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each vector, a chunk at a time."""
    k = min(k, len(c))
    out = np.empty((len(x), k), "i4")
    for s in range(0, len(x), CHUNK):
        sims = x[s : s + CHUNK] @ c.T
        out[s : s + CHUNK] = sims.argmax(1)[:, None] if k == 1 else np.argpartition(sims, len(c) - k, axis=1)[:, len(c) - k :]
    return out


def centres(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = nearest(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c.astype("f4")


Tree = dict[int, tuple[int, np.ndarray]]  # node -> (number of its first child, centres of its children)


def leaves(x: np.ndarray, root: int, tree: Tree, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of vectors of one length. Node numbers below zero are roots."""
    rows, nodes = np.arange(len(x)), np.full(len(x), root, "i8")
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(rows):
        order = np.argsort(nodes, kind="stable")
        rows, nodes = rows[order], nodes[order]
        next_rows, next_nodes = [], []
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(nodes)) + 1):
            node = int(nodes[part[0]])
            if node not in tree:
                done.append((rows[part], nodes[part]))
                continue
            first, c = tree[node]
            near = nearest(x[rows[part]], c, overlap if node < 0 else SPLIT)
            next_rows.append(np.repeat(rows[part], near.shape[1]))
            next_nodes.append(first + near.ravel().astype("i8"))
        if not next_rows:
            break
        rows, nodes = np.concatenate(next_rows), np.concatenate(next_nodes)
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def placed(vertices: DataFrame, tree: Tree, overlap: int, vectors: bool) -> DataFrame:
    """(node, id, v) of each vector and each of its leaves; or just (node), to be counted."""
    shared = vertices.sparkSession.sparkContext.broadcast(tree)
    kind = vertices.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby(batch["v"].map(len)):
                x = np.stack(part["v"].to_numpy()).astype("f4")
                rows, nodes = leaves(x, -int(size), shared.value, overlap)
                out = pd.DataFrame({"node": nodes})
                if vectors:
                    out["id"], out["v"] = part["id"].to_numpy()[rows], part["v"].to_numpy()[rows]
                yield out

    return vertices.mapInPandas(place, f"node long, id {kind}, v array<float>" if vectors else "node long")


def fitted(wanted: dict[int, int]):
    """For applyInPandas: the centres of one node, from its sample."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        node = int(part["node"].iloc[0])
        part = part.sort_values("id")  # the same centres however the rows arrive
        return pd.DataFrame({"node": node, "c": list(centres(np.stack(part["v"].to_numpy()).astype("f4"), wanted[node]))})

    return fit


def grown(vertices: DataFrame, cell: int, overlap: int) -> tuple[Tree, dict[int, int]]:
    """The tree of centres, and the leaves that are still too large, with the number of their vectors."""
    tree: Tree = {}
    children = 0
    large: dict[int, int] = {}
    for level in range(LEVELS):
        if level:
            counts = placed(vertices, tree, overlap, False).groupBy("node").count().filter(F.col("count") > 2 * cell).collect()  # of large leaves only
        else:
            counts = vertices.groupBy((-F.size("v")).cast("long").alias("node")).count().collect()  # one root for each length
        wanted = {r["node"]: math.ceil(r["count"] * (overlap if r["node"] < 0 else SPLIT) / cell) for r in counts}
        wanted = {n: min(FANOUT, k) for n, k in wanted.items() if k > (overlap if n < 0 else 1)}  # else one cell holds them all
        large = {r["node"]: r["count"] for r in counts if r["node"] in wanted and level}
        if not wanted:
            break
        share = {r["node"]: min(1.0, SAMPLE / r["count"]) for r in counts if r["node"] in wanted}
        rows = placed(vertices, tree, overlap, True).filter(F.col("node").isin(*wanted))
        chance = F.element_at(F.create_map(*[F.lit(v) for kv in share.items() for v in kv]), F.col("node"))
        sample = rows.filter(F.pmod(F.xxhash64("id", "node"), F.lit(1 << 30)) < chance * (1 << 30)).select("node", "id", "v")

        found: dict[int, list] = {}
        for r in sample.groupBy("node").applyInPandas(fitted(wanted), "node long, c array<float>").collect():  # as large as the tree
            found.setdefault(r["node"], []).append(r["c"])
        for node in sorted(found):
            tree[node] = (children, np.array(found[node], "f4"))
            children += len(found[node])
    else:
        counts = placed(vertices, tree, overlap, False).groupBy("node").count().filter(F.col("count") > 2 * cell).collect()
        large = {r["node"]: r["count"] for r in counts}
    return tree, {n: k for n, k in large.items() if n not in tree}


def unit(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, copy, v): vectors that have a direction, scaled to length one; copy names the exact vector."""
    v = F.col(vector).cast("array<double>")
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return (
        vectors.select(F.col(key).alias("id"), v.alias("raw"), square.alias("sq"))
        .filter(F.col("sq").isNotNull() & ~F.isnan("sq") & (F.col("sq") > 0) & (F.col("sq") < float("inf")))
        .withColumn("v", F.transform("raw", lambda x: (x / F.sqrt("sq")).cast("float")))
        .withColumn("shape", F.transform("v", lambda x: F.round(x * 1e6).cast("int")))  # the same for scaled copies
        .select("id", F.xxhash64("shape").alias("h1"), F.hash("shape").alias("h2"), "v")
    )


def top_pairs(df: DataFrame, key: str, vector: str, k: int = K, least: float = LEAST, cell: int = CELL, overlap: int = OVERLAP) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which one is among the k most similar to the other, from `least` on.

    Vectors that are null, empty, all zero, or that hold null, NaN or infinite values have no neighbours, and
    vectors of different lengths are no neighbours of each other. Of equally similar vectors those with
    smaller ids come first. Copies of one vector are neighbours of similarity one. Rows must have unique keys;
    other columns are ignored. An empty table gives no rows.
    """
    rows = cut(unit(df, key, vector))
    kind = rows.schema["id"].dataType.simpleString()
    vertices = cut(rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v")).select("id", "v"))
    tree, large = grown(vertices, cell, overlap)
    spread = placed(vertices, tree, overlap, True)
    # leaves that centres could not part: shards by hash, each asked by all of the leaf, a block of queries at a time
    shards = df.sparkSession.createDataFrame([(n, math.ceil(c / (2 * cell))) for n, c in large.items()] or [(None, 1)], "node long, shards int")
    spread = spread.join(F.broadcast(shards), "node", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), "shards").cast("int")
    every = F.sequence(F.lit(0), F.col("shards") - 1)
    # (shard, block): a vector is indexed in its own shard for all blocks of queries, and asks, in its own block, all shards
    roles = F.transform(every, lambda b: F.struct(own.alias("shard"), b.alias("block"), F.lit(True).alias("indexed"), (b == own).alias("asks")))
    asked = F.transform(F.filter(every, lambda s: s != own), lambda s: F.struct(s.alias("shard"), own.alias("block"), F.lit(False).alias("indexed"), F.lit(True).alias("asks")))
    visits = spread.withColumn("r", F.explode(F.concat(roles, asked))).select("node", "id", "v", "r.*")

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x = np.stack(part["v"].to_numpy()).astype("f4")
        indexed, asks = np.flatnonzero(part["indexed"].to_numpy()), np.flatnonzero(part["asks"].to_numpy())
        if not len(indexed):
            return pd.DataFrame({"id": [], "other": [], "sim": []})
        graph = Graph(x[indexed])
        own_, out = part["id"].to_numpy(), []
        names = own_[indexed]
        for s in range(0, len(asks), 512):
            at = asks[s : s + 512]
            found, sims = graph.search(x[at], graph.beam)
            a, b = np.nonzero((found >= 0) & (sims >= least - 1e-3))
            q, r = own_[at[a]], names[found[a, b]]
            exact = np.einsum("nd,nd->n", x[at[a]].astype("f8"), x[indexed[found[a, b]]].astype("f8"))
            good = (q != r) & (exact >= least)
            out.append(pd.DataFrame({"id": q[good], "other": r[good], "sim": exact[good]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "sim": []})

    found = visits.groupBy("node", "shard", "block").applyInPandas(ask, f"id {kind}, other {kind}, sim double").distinct()
    return merged(rows, found, k)


def merged(rows: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Pairs of rows from the links of distinct vectors; copies count as neighbours of similarity one."""
    groups = rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    several = groups.filter("n > 1")
    by_id = Window.partitionBy("h1", "h2").orderBy("id")
    # of a group of copies only the k + 1 first ids can be anyone's nearest
    heads = rows.select("h1", "h2", "id").withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1)
    reps = heads.join(groups.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", F.col("id").alias("other"), "r")
    of_copies = rows.join(several, ["h1", "h2"]).select("id", "rep")
    inside = of_copies.join(reps, "rep").filter("id <> other").select("id", "other", F.lit(1.0).alias("sim"))
    # a link of distinct vectors holds for all copies of its first vector and the heads of its second
    firsts = rows.select("h1", "h2", "id").join(groups.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "id")
    links = found.select(F.col("id").alias("rep"), F.col("other").alias("rep2"), "sim").join(firsts, "rep")
    links = links.join(reps.select(F.col("rep").alias("rep2"), "other"), "rep2").select("id", "other", "sim")
    best = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    top = links.unionByName(inside).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    return top.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_pairs(table(spark, folder, "chunk_vectors"), "chunk_id", "embedding")
