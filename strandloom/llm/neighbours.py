"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

Vectors get one more component that makes all their lengths equal, so that the
largest inner product is the least Euclidean distance. A tree of k-means splits
is fitted on a sample; every vector goes down it to a leaf. Leaves grow with the
square root of the table (to at most `LEAVES`, for which `SAMPLE_PER_LEAF` vectors each are
sampled, a bounded number), so a leaf's rows and the queries that visit it grow alike.

A query pops nodes from a priority queue, the nearest centre first, and visits the
leaves it meets. How many is calibrated: for `CALIBRATION` queries the true
neighbours are found by brute force over all rows, and visits are widened until
the mean recall reaches `RECALL`. Every query goes on beyond that until the leaves it
has visited hold k candidates (all of them, if there are fewer), so each gets min(k, rows - 1) results.

Leaves are kept in about `BUNDLES` bundles (neighbours in the tree, at most 60 leaves each, so that rows per query do
not grow with the table) and each bundle is one group; one with more than `BLOCK` vectors or queries is dealt out in blocks of so many, so a leaf with any share of all rows
falls into many tasks, and only such bundles are copied. Each block gives at most k rows
per query. The tree and the counts of its leaves are sent to all tasks.

Vectors that are null, zero, of another dimension than most, or that hold null or
non-finite components take no part. Rows that repeat a vec_id count once (the
least vector). Equal scores: the smaller vec_id first. Null vec_ids take no part.
Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

K = 20
LEAVES, SAMPLE_PER_LEAF, FANOUT, BUNDLES, BLOCK = 4096, 64, 8, 32, 8192
CALIBRATION, RECALL = 200, 0.96


def leaves_for(rows: int) -> int:
    """The square root of the rows, between 16 and LEAVES."""
    return min(LEAVES, max(16, math.isqrt(rows)))


class Tree:
    """Nodes in arrays; a leaf's number is its place from left to right."""

    def __init__(self, sample: np.ndarray, leaves: int, fanout: int = FANOUT, seed: int = 11):
        self.centres: list[np.ndarray] = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        rng = np.random.default_rng(seed)
        heap = [(-len(sample), 0, np.arange(len(sample)))]
        n_leaves = 1
        while heap and n_leaves < leaves:  # the fullest node is split next
            size, node, rows = heapq.heappop(heap)
            if -size < 2 * fanout:
                break
            parts = self._split(sample[rows], min(fanout, leaves - n_leaves + 1), rng)
            if len(parts) < 2:
                continue
            n_leaves += len(parts) - 1
            for centre, at in parts:
                self.children[node].append(len(self.centres))
                self.centres.append(centre)
                self.children.append([])
                self.leaf.append(-1)
                heapq.heappush(heap, (-len(at), len(self.centres) - 1, rows[at]))
        self.n_leaves = 0
        stack = [0]
        while stack:
            node = stack.pop()
            if self.children[node]:
                stack += reversed(self.children[node])
            else:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
        self.centres = np.array(self.centres)

    @staticmethod
    def _split(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
        centres = x[rng.choice(len(x), k, replace=False)]
        of = np.zeros(len(x), int)
        for _ in range(rounds):
            of = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, 1)
            used = np.unique(of)
            centres = np.array([x[of == c].mean(0) for c in used])
            of = np.searchsorted(used, of)
        of = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, 1)
        return [(centres[c], np.flatnonzero(of == c)) for c in np.unique(of)]

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        work = [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf[node]
            elif len(rows):
                c = self.centres[below]
                of = np.argmin((c * c).sum(1) - 2 * x[rows] @ c.T, 1)
                work += [(child, rows[of == i]) for i, child in enumerate(below)]
        return out

    def visit(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, enough: int = 0) -> list[int]:
        """Leaves in the order in which best-bin-first search meets them: `most`, and on until they hold `enough` rows."""
        out: list[int] = []
        held = 0
        queue = [(0.0, 0)]
        while queue and (len(out) < most or held < enough):
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not below:
                out.append(self.leaf[node])
                if sizes is not None:
                    held += int(sizes[self.leaf[node]])
                continue
            d = ((self.centres[below] - q) ** 2).sum(1)
            for child, x in zip(below, d.tolist()):
                heapq.heappush(queue, (x, child))
        return out


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)


def augmented(x: np.ndarray, square: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, square - (x * x).sum(1)))[:, None]])


def best(scores: np.ndarray, ids: np.ndarray, q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query, scores taken anew in one fixed order of addition so that equal vectors tie."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge - 1e-9 * (1 + abs(edge)))
    else:
        at = np.arange(len(scores))
    at = at[np.isfinite(scores[at])]
    exact = (x[at] * q).sum(1)
    order = np.lexsort((ids[at], -exact))[:k]
    return ids[at][order], exact[order]


def usable(vectors: DataFrame, id_column: str, column: str) -> tuple[DataFrame, int, float]:
    """id and vector of the rows that take part, their dimension, and the square of the largest length."""
    df = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v")).filter(
        "id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    )
    df = df.groupBy("id").agg(F.min("v").alias("v"))
    top = df.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if top is None:
        return df, 0, 0.0
    df = df.filter(F.size("v") == top.d)
    square = df.agg(F.max(F.expr("aggregate(v, 0D, (s, x) -> s + double(x) * double(x))"))).first()[0]
    return df, top.d, square


def search(vectors: DataFrame, queries: DataFrame, k: int = K, leaves: int | None = None, recall: float = RECALL, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score; `queries` (query_id) names rows of `vectors`."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    df, dimension, square = usable(vectors, id_column, column)
    if not dimension:
        return spark.createDataFrame([], empty)
    leaves = leaves or leaves_for(vectors.count())
    sample = df.orderBy(F.xxhash64("id"), "id").limit(leaves * SAMPLE_PER_LEAF).select("v").toArrow()  # a bounded number of vectors
    tree = spark.sparkContext.broadcast(Tree(augmented(matrix(sample.column(0).combine_chunks(), dimension), square), leaves))
    n_leaves = tree.value.n_leaves
    per_bundle = min(60, -(-n_leaves // BUNDLES))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.value.leaves_of(augmented(matrix(batch.column(1), dimension), square))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["id", "v", "leaf"])

    indexed = written(df.mapInArrow(place, f"id long, v {df.schema['v'].dataType.simpleString()}, leaf int"), "leaves")
    asked = indexed.join(queries.select(F.col("query_id").alias("id")).distinct(), "id").select("id", "v")

    # calibration: the true neighbours of some queries
    some = asked.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).toArrow()
    some_ids, some_q = some.column("id").to_numpy(), matrix(some.column("v").combine_chunks(), dimension)
    if not len(some_ids):
        return spark.createDataFrame([], empty)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32))] * len(some_ids)  # the k best of the task so far
        for batch in batches:
            ids, x, leaf = batch.column(0).to_numpy(), matrix(batch.column(1), dimension), batch.column(2).to_numpy()
            number = dict(zip(ids.tolist(), leaf.tolist()))
            scores = some_q @ x.T
            for q in range(len(some_ids)):
                scores[q, ids == some_ids[q]] = -np.inf
                got, exact = best(scores[q], ids, some_q[q], x, k)
                both = [np.concatenate(z) for z in zip(held[q], (got, exact, np.array([number[i] for i in got.tolist()], np.int32)))]
                order = np.lexsort((both[0], -both[1]))[:k]
                held[q] = tuple(z[order] for z in both)
        q = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q), *(pa.array(np.concatenate([h[i] for h in held])) for i in range(3))], names=["q", "id", "score", "leaf"])

    per_query = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    truth = indexed.mapInArrow(brute, "q long, id long, score double, leaf int").withColumn("r", F.row_number().over(per_query)).filter(F.col("r") <= k).select("q", "leaf").toPandas()
    met = np.zeros((len(some_ids), n_leaves), int)
    for q, x in enumerate(augmented(some_q, square) * np.append(np.ones(dimension), 0)):
        met[q, tree.value.visit(x, n_leaves)] = np.arange(n_leaves)
    needed = met[truth.q.to_numpy(), truth.leaf.to_numpy()]
    visits = 1
    while visits < n_leaves and (needed < visits).mean() < recall:
        visits += 1

    # the leaves of each query, and blocks
    sizes = np.zeros(n_leaves, np.int64)  # a number for each leaf
    for r in indexed.groupBy("leaf").count().collect():
        sizes[r.leaf] = r["count"]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dimension)
            x = np.hstack([x, np.zeros((len(x), 1))])
            bundles: list[dict[int, int]] = []
            for q in x:
                own: dict[int, int] = {}
                for leaf in tree.value.visit(q, visits, sizes, k + 1):  # one of them may be the query itself
                    own[leaf // per_bundle] = own.get(leaf // per_bundle, 0) | 1 << leaf % per_bundle
                bundles.append(own)
            at = np.repeat(np.arange(len(x)), [len(b) for b in bundles])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array([b for own in bundles for b in own], pa.int32()), pa.array([m for own in bundles for m in own.values()], pa.int64())],
                names=["id", "v", "bundle", "mask"],
            )

    kind = df.schema["v"].dataType.simpleString()
    planned = written(asked.repartition("id").mapInArrow(plan, f"id long, v {kind}, bundle int, mask long"), "visits")
    held = indexed.withColumn("bundle", F.floor(F.col("leaf") / per_bundle).cast("int"))
    # blocks of rows and of queries of each bundle: 1 but for those with more than BLOCK; at most a row for each bundle
    counts = held.groupBy("bundle").count().select("bundle", F.ceil(F.col("count") / BLOCK).cast("int").alias("row_blocks"))
    counts = counts.join(planned.groupBy("bundle").count().select("bundle", F.ceil(F.col("count") / BLOCK).cast("int").alias("query_blocks")), "bundle")
    counts = F.broadcast(written(counts, "blocks"))

    def dealt(frame: DataFrame, own: str, other: str) -> DataFrame:
        return (
            frame.join(counts, "bundle")
            .withColumn("own", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        )

    left = dealt(held, "row_blocks", "query_blocks").select("bundle", F.col("own").alias("row_block"), F.col("other").alias("query_block"), "id", "v", "leaf")
    right = dealt(planned, "query_blocks", "row_blocks").select("bundle", F.col("other").alias("row_block"), F.col("own").alias("query_block"), "id", "v", "mask")
    key = ["bundle", "row_block", "query_block"]

    def block(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(asks):
            x, ids, bit = np.stack(rows.v.to_numpy()).astype(np.float64), rows.id.to_numpy(), np.int64(1) << (rows.leaf.to_numpy() % per_bundle).astype(np.int64)
            q_all = np.stack(asks.v.to_numpy()).astype(np.float64)
            for low in range(0, len(asks), 512):
                scores = q_all[low : low + 512] @ x.T
                for i in range(len(scores)):
                    me = asks.id.iat[low + i]
                    scores[i, ((bit & asks["mask"].iat[low + i]) == 0) | (ids == me)] = -np.inf
                    got, exact = best(scores[i], ids, q_all[low + i], x, k)
                    out["query_id"].append(np.full(len(got), me))
                    out["vec_id"].append(got)
                    out["score"].append(exact)
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, float if c == "score" else np.int64) for c, v in out.items()})

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(block, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")))
