"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are complete and fit on a bounded sample: each node projects on the
difference of two random sample vectors and splits at the median.  Every vector
is indexed, in one leaf of each tree.  A query walks all trees through one
priority queue, ordered by how far it lies on the wrong side of a split at
worst, and takes leaves until they hold enough vectors, a vector counting once
for each tree.  Queries and vectors meet by leaf, every candidate there is
scored exactly, and each query's best candidates of all leaves are merged.

How many are enough is measured: for about ``TRIALS`` queries the exact answer
is found by brute force, and so many are taken as reach ``RECALL`` of it.
Vectors of high dimension without structure have no shortcuts, and most of the
index must be seen; structured vectors need far less.  Leaves with more than ``BLOCK`` vectors, or asked by more than
``BLOCK`` queries, are split into blocks that are searched apart, each of the
queries against each of the vectors.  Of equal vectors only the ``k + 1`` smallest ids can be among
anyone's nearest, as ties go to smaller ids, so only these are indexed; this
drops no answer.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do rows without an id; of
rows that repeat an id the least vector counts; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tidemark.llm.common import bound_batches, cut

TREES = 8
#: Rows that fit the trees, about, chosen by a hash of their ids.
SAMPLE = 16_384
#: Vectors in a leaf, about, and levels at most (more would leave a leaf too few of the sample).
LEAF, DEEPEST = 512, 10
BLOCK = 8192
#: Queries whose exact answers tell how far to search, about, and the recall aimed at.
TRIALS, RECALL = 256, 0.95


class Forest:
    """Complete trees over levels of splits; nodes are numbered as in a heap."""

    def __init__(self, depth: int, planes: np.ndarray, cuts: np.ndarray):
        self.depth, self.planes, self.cuts, self.trees = depth, planes, cuts, len(planes)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf codes of each vector, one per tree."""
        found = np.zeros((len(vectors), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", vectors, self.planes[t, node]) > self.cuts[t, node]
                node = 2 * node + 1 + right
            found[:, t] = t * 2**self.depth + node - (2**self.depth - 1)
        return found

    def needed(self, query: np.ndarray, sizes: dict[int, int], leaves: np.ndarray) -> list[int]:
        """For each row of leaf codes how many vectors are held by the leaves visited before one of the row."""
        order = self.search(query, sizes, math.inf)
        before = dict(zip(order, np.cumsum([0, *(sizes[code] for code in order)]).tolist()))
        return [min(before[code] for code in row) for row in leaves.tolist()]

    def search(self, query: np.ndarray, sizes: dict[int, int], enough: float) -> list[int]:
        """Codes of leaves, nearest first, that hold ``enough`` vectors together; all if they don't."""
        sides = (self.planes @ query - self.cuts).tolist()
        inner, width = 2**self.depth - 1, 2**self.depth
        queue, found, held = [(0.0, t, 0) for t in range(self.trees)], [], 0
        while queue and held < enough:
            worst, t, node = heapq.heappop(queue)
            while node < inner:
                side = sides[t][node]
                heapq.heappush(queue, (max(worst, abs(side)), t, 2 * node + 1 + (side <= 0)))
                node = 2 * node + 1 + (side > 0)
            code = t * width + node - inner
            if code in sizes:
                found.append(code)
                held += sizes[code]
        return found


def fit(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 4) -> tuple[int, np.ndarray, np.ndarray]:
    """The parts of a forest: its depth, and the plane and the cut of every node."""
    rng = np.random.default_rng(seed)
    nodes, dimension = 2**depth - 1, sample.shape[1]
    planes, cuts = np.zeros((trees, nodes, dimension)), np.zeros((trees, nodes))
    for t in range(trees):
        inside = [np.arange(len(sample))] + [None] * (2 * nodes)
        for n in range(nodes):
            rows = inside[n]
            plane = np.subtract(*sample[rng.choice(rows, 2, replace=False)]) if len(rows) > 1 else np.zeros(dimension)
            if not np.any(plane):
                plane = rng.normal(size=dimension)
            planes[t, n] = plane = plane / np.linalg.norm(plane)
            along = sample[rows] @ plane
            cuts[t, n] = np.median(along) if len(rows) else 0.0
            right = along > cuts[t, n]
            inside[2 * n + 1], inside[2 * n + 2] = rows[~right], rows[right]
    return depth, planes, cuts


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed pairwise in one order whatever the block, so equal vectors score equally."""
    products = a * b
    while (width := products.shape[1]) > 1:
        half = width // 2
        summed = products[:, :half] + products[:, half : 2 * half]
        products = np.concatenate([summed, products[:, 2 * half :]], axis=1) if width % 2 else summed
    return products[:, 0]


def _best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[list, list]:
    """Ids and scores of each query's k best vectors by (score, smaller id)."""
    k = min(k, len(ids))
    spare = min(len(ids), k + 3)  # rounding may swap neighbours in the first ranking
    rough = queries @ vectors.T
    near = np.argpartition(-rough, spare - 1, axis=1)[:, :spare] if spare < len(ids) else np.broadcast_to(np.arange(len(ids)), rough.shape)
    scores = _exact(np.repeat(queries, spare, axis=0), vectors[near.ravel()]).reshape(near.shape)
    order = np.lexsort((ids[near], -scores), axis=1)[:, :k]
    best, score = list(np.take_along_axis(ids[near], order, 1)), list(np.take_along_axis(scores, order, 1))
    if spare < len(ids):  # all that tie with the last place belong to the choice
        size = np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max()
        last = np.take_along_axis(rough, near, 1).min(1) - 1e-12 * np.maximum(size, 1e-300)
        for i in np.flatnonzero((rough >= last[:, None]).sum(1) > spare):
            at = np.flatnonzero(rough[i] >= last[i])
            exact = _exact(np.repeat(queries[i : i + 1], len(at), axis=0), vectors[at])
            order = np.lexsort((ids[at], -exact))[:k]
            best[i], score[i] = ids[at][order], exact[order]
    return best, score


def _enough(indexed: DataFrame, queries: DataFrame, k: int, forest: Broadcast, sizes: dict[int, int]) -> float:
    """How many vectors the visited leaves must hold, by the exact answers of some queries (``query_id``, ``q``)."""
    total = queries.count()
    share = int((1 << 30) * min(1.0, TRIALS / max(total, 1)))
    trials = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(1 << 30)) < share).orderBy("query_id").collect()
    if not trials:
        return math.inf
    asked, names = np.array([r.q for r in trials], float), [r.query_id for r in trials]

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, kept = Forest(*forest.value), [[] for _ in names]  # of each trial the k best of the task, with their leaves
        for batch in batches:
            found, ids = np.stack(batch["v"].to_numpy()), batch["vec_id"].to_numpy()
            leaves = trees.leaves(found)
            for i, near in enumerate(_best(asked, found, ids, k + 1)[0]):
                at = np.flatnonzero(np.isin(ids, near) & (ids != names[i]))
                kept[i] = sorted([*kept[i], *zip((-(found[at] @ asked[i])).tolist(), ids[at].tolist(), leaves[at].tolist())])[:k]
        rows = [(i, name, below, codes) for i, own in enumerate(kept) for below, name, codes in own]
        yield pd.DataFrame(rows, columns=["trial", "vec_id", "below", "leaves"])

    found = indexed.select("vec_id", "v").mapInPandas(best, "trial int, vec_id long, below double, leaves array<int>")
    place = F.row_number().over(Window.partitionBy("trial").orderBy("below", "vec_id"))
    nearest = found.withColumn("place", place).filter(F.col("place") <= k).select("trial", "leaves").collect()  # TRIALS * k rows, about
    trees, needs = Forest(*forest.value), []
    codes = np.array([r.leaves for r in nearest], np.int64)
    for i in range(len(trials)):
        needs += trees.needed(asked[i], sizes, codes[[r.trial == i for r in nearest]]) if nearest else []
    return float(np.quantile(needs, RECALL, method="higher")) + 1 if needs else math.inf


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k nearest found, by inner product, for the rows that are queries."""
    spark = vectors.sparkSession
    bound_batches(spark, 8192)
    points = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asked"))
    points = points.filter(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    points = cut(points.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asked").alias("asked")))
    lengths = points.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimension = lengths.n if lengths else 0
    points = points.filter(F.size("v") == dimension)
    alike = Window.partitionBy("v").orderBy("vec_id")
    indexed = cut(points.withColumn("place", F.row_number().over(alike)).filter(F.col("place") <= k + 1).select("vec_id", "v"))
    total = indexed.count()
    share = F.lit(int((1 << 30) * min(1.0, SAMPLE / max(total, 1))))
    sample = indexed.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).orderBy("vec_id").select("v").collect()
    rows = np.array([r.v for r in sample], float).reshape(len(sample), dimension)
    depth = min(DEEPEST, max(0, math.ceil(math.log2(max(total, 1) / LEAF))))
    forest = spark.sparkContext.broadcast(fit(rows, depth))  # TREES * 2**DEEPEST planes at most

    @F.pandas_udf(ArrayType(IntegerType()))
    def leaves(batch: pd.Series) -> pd.Series:
        found = Forest(*forest.value).leaves(np.array(batch.tolist(), float).reshape(len(batch), dimension))
        return pd.Series(list(found), dtype=object)

    posted = cut(indexed.select("vec_id", "v", F.explode(leaves("v")).alias("leaf")))
    sizes = {r.leaf: r["count"] for r in posted.groupBy("leaf").count().collect()}  # TREES * 2**DEEPEST at most
    asked = points.filter("asked").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    enough = _enough(indexed, asked, k, forest, sizes)
    held = spark.sparkContext.broadcast(sizes)

    @F.pandas_udf(ArrayType(IntegerType()))
    def visits(batch: pd.Series) -> pd.Series:
        trees = Forest(*forest.value)
        return pd.Series([trees.search(np.asarray(q, float), held.value, enough) for q in batch], dtype=object)

    asked = cut(asked.select("query_id", "q", visits("q").alias("leaves")))
    askers = {r.leaf: r["count"] for r in asked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}
    parts = [(leaf, math.ceil(n / BLOCK), math.ceil(askers.get(leaf, 0) / BLOCK)) for leaf, n in sizes.items()]
    parts = F.broadcast(spark.createDataFrame(parts, "leaf int, blocks int, shifts int"))  # a row for each leaf
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    asked = asked.select("query_id", "q", F.explode("leaves").alias("leaf")).join(parts, "leaf")
    asked = asked.select("query_id", "q", "leaf", one_of("query_id", "shifts").alias("shift"), all_of("blocks").alias("block"))
    posted = posted.join(parts, "leaf").filter("shifts > 0")
    posted = posted.select("vec_id", "v", "leaf", one_of("vec_id", "blocks").alias("block"), all_of("shifts").alias("shift"))

    def meet(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        best, scores = [], []
        if len(queries) and len(held):
            data, ids = np.stack(held["v"].to_numpy()), held["vec_id"].to_numpy()
            for at in range(0, len(queries), 512):
                for all_, part in zip((best, scores), _best(np.stack(queries["q"].to_numpy()[at : at + 512]), data, ids, k + 1)):
                    all_ += part
        asked_ids = queries["query_id"].to_numpy()[: len(best)].astype("int64")
        return pd.DataFrame({"query_id": asked_ids, "ids": pd.Series(best, dtype=object), "scores": pd.Series(scores, dtype=object)})

    met = asked.groupBy("leaf", "block", "shift").cogroup(posted.groupBy("leaf", "block", "shift")).applyInPandas(meet, "query_id long, ids array<long>, scores array<double>")
    # at most k + 1 from each leaf that a query visits, its own among them; a vector is in one leaf of each tree, so the k best are among the first k * TREES
    each = F.filter(F.zip_with("ids", "scores", lambda i, s: F.struct((-s).alias("below"), i.alias("vec_id"))), lambda x: x["vec_id"] != F.col("query_id"))
    merged = met.groupBy("query_id").agg(F.slice(F.array_distinct(F.slice(F.sort_array(F.flatten(F.collect_list(each))), 1, k * TREES)), 1, k).alias("best"))
    ranked = merged.select("query_id", F.posexplode("best").alias("at", "one"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.below")).alias("score"))
