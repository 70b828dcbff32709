"""Approximate nearest neighbours by a forest of random-projection trees.

Every tree halves the space ``depth`` times: level by level the vectors are projected on one
random direction and split at the median (of a bounded sample).  All rows are indexed: each lies in
one leaf of each tree.  A query walks all trees through one shared priority queue, nearest
boundary first, until the leaves it has reached hold enough rows.  Those leaves are reranked by
exact distance in double precision.

How many rows are enough is measured at fit time: the smallest share of the sample at which the
forest finds ``recall`` of the sample's true neighbours.  Data without structure needs a large
share, clustered data a small one.

Distribution: rows and queries meet in a join by (tree, leaf); leaves with many rows are split
into slices of ``LEAF_ROWS``, to each of which its queries are sent.  Equal vectors are one row
with the smallest ids (only those can be among the nearest), so a vector that a third of the rows
share makes no large leaf, and equal queries are searched once.  Each query carries a radius beyond
which leaves report nothing: the distance of the (k+1)-th nearest of those sample vectors that lie in
the leaves it reaches.  They are rows there, so the nearest rows reached all lie within it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import cut

TREES = 8
#: Rows a leaf holds at the planned depth; the depth follows the number of rows.
LEAF_TARGET = 256
#: The trees are fitted on at most this many distinct vectors (those with the smallest hash).
FIT_ROWS = 4096
#: Rows of a leaf that one task reads together.
LEAF_ROWS = 8192
RECALL = 0.96
#: More distinct lengths of vectors than this are an error, as each has a forest of its own.
MAX_LENGTHS = 64
_SHARES = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


class Forest:
    """Directions [tree, level, dim], split values [tree, inner node], rows by leaf, and the share
    of rows to reach.  Nodes are numbered as in a heap; leaves from 0."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.depth, self.sample = trees, depth, sample
        self.directions = rng.normal(size=(trees, depth, sample.shape[1]))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.splits = np.zeros((trees, 2**depth - 1))
        flat = self.project(sample)
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                for v in range(2**level - 1, 2 ** (level + 1) - 1):
                    own = flat[node == v, t, level]
                    self.splits[t, v] = np.median(own) if len(own) else 0.0
                node = 2 * node + 1 + (flat[:, t, level] > self.splits[t, node])
        self.counts = np.zeros((trees, 2**depth), np.int64)
        self.share = 1.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.directions.reshape(self.trees * self.depth, self.directions.shape[2]).T).reshape(len(x), self.trees, self.depth)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        flat, node = self.project(x), np.zeros((len(x), self.trees), np.int64)
        tree = np.arange(self.trees)
        for level in range(self.depth):
            node = 2 * node + 1 + (flat[:, :, level] > self.splits[tree, node])
        return node - (2**self.depth - 1)

    def reached(self, projected: np.ndarray, budget: float) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) in the order of the shared queue until ``budget`` rows of one tree's
        count are reached; the same row met in several trees counts by chance of overlap."""
        heap, out = [(-np.inf, t, 0) for t in range(self.trees)], []
        first, total = 2**self.depth - 1, max(1, int(self.counts[0].sum()))
        missed = 1.0  # chance that a row has not been met: trees are independent
        met = np.zeros(self.trees)
        while heap and (1 - missed) * total < budget:
            bound, t, v = heapq.heappop(heap)
            if v >= first:
                out.append((t, v - first))
                met[t] += self.counts[t, v - first]
                missed = float(np.prod(1 - met / total))
                continue
            gap = projected[t, (v + 1).bit_length() - 1] - self.splits[t, v]
            heapq.heappush(heap, (max(bound, -gap), t, 2 * v + 2))
            heapq.heappush(heap, (max(bound, gap), t, 2 * v + 1))
        return out

    def sure(self) -> tuple[np.ndarray, np.ndarray]:
        """Leaves of the sample, and whether each is certain: vectors on a split may fall to either
        side, as products of other batches round otherwise."""
        flat, node = self.project(self.sample), np.zeros((len(self.sample), self.trees), np.int64)
        tree, clear = np.arange(self.trees), np.ones((len(self.sample), self.trees), bool)
        for level in range(self.depth):
            gap = flat[:, :, level] - self.splits[tree, node]
            clear &= np.abs(gap) > 1e-9 * (1 + np.abs(flat[:, :, level]))
            node = 2 * node + 1 + (gap > 0)
        return node - (2**self.depth - 1), clear

    def calibrate(self, k: int, recall: float, queries: int = 64) -> None:
        """Smallest share of the sample that finds ``recall`` of its true neighbours."""
        x = self.sample
        if len(x) <= 20 * k:
            return
        own, counts = self.leaves(x), self.counts
        self.counts = np.stack([np.bincount(own[:, t], minlength=2**self.depth) for t in range(self.trees)])
        asked = np.linspace(0, len(x) - 1, queries).astype(int)
        d = ((x[asked] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[asked] @ x.T)
        d[np.arange(queries), asked] = np.inf
        true = np.argpartition(d, k, axis=1)[:, :k]
        flat = self.project(x[asked])
        for share in _SHARES:
            found = 0
            for i in range(queries):
                visited = np.zeros((self.trees, 2**self.depth), bool)
                for t, leaf in self.reached(flat[i], share * len(x)):
                    visited[t, leaf] = True
                found += visited[np.arange(self.trees), own[true[i]]].any(axis=1).sum()
            if found >= recall * k * queries:
                self.share = share
                break
        self.counts = counts


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that take part: non-null id; a vector that is neither null, empty nor zero and holds
    neither nulls nor non-finite numbers; repeated rows once.  Vectors keep their type."""
    x = F.col(vector)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = df.select(F.col(key).alias("vec_id"), x.alias("vector")).where("vec_id is not null and vector is not null")
    return good.where(F.forall("vector", finite) & F.exists("vector", lambda v: v != 0)).distinct()


def nearest(
    df: DataFrame,
    is_query,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    trees: int = TREES,
    leaf_target: int = LEAF_TARGET,
    fit_rows: int = FIT_ROWS,
    recall: float = RECALL,
    exact: bool = False,
) -> DataFrame:
    """The k nearest found for each row where ``is_query`` (a condition on ``vec_id``): query_id,
    rank, vec_id, score (Euclidean distance), nearest first, ties to the smaller id.

    Null, zero and non-finite vectors take no part.  A vector's candidates are those of its own
    length.  A query's own id is no candidate.  With fewer than k candidates all are returned; an
    empty table gives an empty result.  ``exact`` reaches all rows: one tree of one leaf.
    """
    rows = usable(df, key, vector)
    lengths = [r["n"] for r in rows.select(F.size("vector").alias("n")).distinct().orderBy("n").limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n in lengths:
        own = _nearest(rows.where(F.size("vector") == n), is_query, k, trees, leaf_target, fit_rows, recall, exact)
        out = own if len(lengths) == 1 else out.unionByName(own)
    return out


def _nearest(rows: DataFrame, is_query, k: int, trees: int, leaf_target: int, fit_rows: int, recall: float, exact: bool) -> DataFrame:
    """:func:`nearest` among vectors of one length."""
    kind = dict(rows.dtypes)["vector"]
    most = k + 1
    # One row a distinct vector, with its smallest ids: no other copy can be among the nearest.
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("r") <= most)
    distinct = cut(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = distinct.count()
    sample = np.array([r["vector"] for r in distinct.select("vector").orderBy(F.xxhash64("vector", F.lit(3)), "vector").limit(fit_rows).collect()], dtype=float)
    depth = int(min(np.ceil(np.log2(max(1.0, n / leaf_target))), np.floor(np.log2(max(1.0, len(sample) / 4)))))
    depth = 0 if exact else depth
    forest = Forest(sample, trees if depth else 1, depth)
    spark = rows.sparkSession
    sc = spark.sparkContext
    fitted = sc.broadcast(forest)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                own = fitted.value.leaves(np.stack(pdf["vector"].to_numpy()).astype(float))
                yield pd.DataFrame({"leaves": list(own.astype(np.int32)), "vector": pdf["vector"], "ids": pdf["ids"]})

    indexed = distinct.mapInPandas(placed, f"leaves array<int>, vector {kind}, ids array<long>")
    by_leaf = indexed.select(F.posexplode("leaves").alias("tree", "leaf"), "vector", "ids")
    for r in indexed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():
        forest.counts[r["tree"], r["leaf"]] = r["count"]
    if depth:
        forest.calibrate(k, recall)
    ready = sc.broadcast(forest)
    slices = -(-forest.counts // LEAF_ROWS)

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = ready.value
        own_leaves, clear = f.sure()
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                own_rows = pdf["vector"].to_numpy()[at : at + 256]
                x = np.stack(own_rows).astype(float)
                flat = f.project(x)
                d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (f.sample**2).sum(1)[None] - 2 * x @ f.sample.T))
                for i, own in enumerate(own_rows):
                    leaves = f.reached(flat[i], max(f.share * f.counts[0].sum(), most))
                    visited = np.zeros((f.trees, 2**f.depth), bool)
                    visited[tuple(np.array(leaves).T)] = True
                    near = d[i][(visited[np.arange(f.trees), own_leaves] & clear).any(axis=1)]
                    radius = np.partition(near, most - 1)[most - 1] * (1 + 1e-6) + 1e-6 if len(near) >= most else np.inf
                    hit = [(t, leaf, s) for t, leaf in leaves for s in range(slices[t, leaf])]
                    t, leaf, s = (np.array(c, np.int32) for c in zip(*hit, strict=True))
                    yield pd.DataFrame({"tree": t, "leaf": leaf, "slice": s, "q": [own] * len(t), "radius": radius})

    # ids holds only the smallest ids of a vector, so queries are taken from all rows
    queries = rows.where(is_query(F.col("vec_id")))
    probes = queries.select("vector").distinct().mapInPandas(asked, f"tree int, leaf int, slice int, q {kind}, radius double")
    sizes = spark.createDataFrame([(int(t), int(x), int(slices[t, x])) for t, x in zip(*np.nonzero(slices), strict=True)], "tree int, leaf int, n int")
    stored = by_leaf.join(F.broadcast(sizes), ["tree", "leaf"]).withColumn("slice", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("n")).cast("int")).drop("n")

    def reranked(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            x, ids = np.stack(left["vector"].to_numpy()).astype(float), left["ids"].to_numpy()
            xx = (x**2).sum(1)
            for at in range(0, len(right), 256):
                sent = right["q"].to_numpy()[at : at + 256]
                q = np.stack(sent).astype(float)
                d = np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + xx[None] - 2 * q @ x.T))
                for i, radius in enumerate(right["radius"].to_numpy()[at : at + 256]):
                    near = np.flatnonzero(d[i] <= radius)
                    if len(near) > most:
                        far = np.partition(d[i][near], most - 1)[most - 1]
                        near = near[d[i][near] <= far * (1 + 1e-6) + 1e-6]
                    exact = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
                    best = sorted((s, v) for s, row in zip(exact.tolist(), near, strict=True) for v in ids[row])[:most]
                    out["q"] += [sent[i]] * len(best)
                    out["vec_id"] += [v for _, v in best]
                    out["score"] += [s for s, _ in best]
        return pd.DataFrame({"q": pd.Series(out["q"], dtype=object), "vec_id": pd.Series(out["vec_id"], dtype="int64"), "score": pd.Series(out["score"], dtype="float64")})

    by = ["tree", "leaf", "slice"]
    found = stored.groupBy(*by).cogroup(probes.groupBy(*by)).applyInPandas(reranked, f"q {kind}, vec_id long, score double").distinct()
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("r") <= most).drop("r")
    answered = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q")).join(best, "q").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("score", "vec_id"))
    return answered.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
