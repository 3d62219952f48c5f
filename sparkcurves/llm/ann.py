"""Approximate nearest neighbours by a forest of random-projection trees.

* Trees are grown on a bounded sample, as deep as leaves about sqrt(rows) / `few` leaves a tree (a very small table is one leaf). Every node splits
  its sample at the median of a random projection, turned towards the directions in which the sample varies. Every row is then sent down every
  tree to a leaf.
* A query searches all trees through one priority queue: the branch whose splitting planes lie nearest to the query is opened next, whatever
  tree it belongs to. It opens `effort` leaves.
* The effort is measured, not guessed: some queries are answered by brute force, and the leaves that hold their true neighbours tell how many
  must be opened for the wanted recall.
* Leaf candidates are ranked exactly, in double precision, leaf by leaf against the queries that opened the leaf and no others. Blocks of rows and
  of queries are bounded, so a leaf that a third of all (equal) vectors fall into is many blocks. A query's first leaves, one a tree on average, give it a floor, the k-th best score so far; blocks
  hand on their best k a query, and of the other leaves only rows that reach the floor.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcurves.llm import shared as S

SAMPLE = 20_000  # vectors that the trees are grown on, at most
TREES = 6
FEW = 3  # a tree has about sqrt(rows) / FEW leaves
GROWN = 8  # vectors of the sample in a leaf, at least; with `SAMPLE` it bounds the depth at 11 levels
PROBES = 96  # queries answered by brute force to measure recall
RECALL = 0.95
BLOCK = 4096  # rows or queries in a block, about


@dataclass
class Forest:
    """Complete binary trees: the node at place i has its children at 2 i + 1 and 2 i + 2."""

    directions: np.ndarray  # trees, nodes, dimensions
    cuts: np.ndarray  # trees, nodes
    depth: int

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors, trees) leaf numbers."""
        out = np.empty((len(vectors), len(self.cuts)), np.int64)
        for t in range(len(self.cuts)):
            side = vectors @ self.directions[t].T > self.cuts[t]
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + side[np.arange(len(vectors)), node]
            out[:, t] = node - len(self.cuts[t])
        return out

    def visits(self, vector: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) from the most to the least promising, over all trees."""
        margin = self.directions @ vector - self.cuts
        nodes = margin.shape[1]
        heap = [(0.0, t, 0) for t in range(len(margin))]
        while heap:
            far, t, node = heapq.heappop(heap)
            while node < nodes:
                m = margin[t, node]
                near = 2 * node + 1 + (m > 0)
                heapq.heappush(heap, (far + m * m, t, 4 * node + 3 - near))
                node = near
            yield t, node - nodes


def depth_for(rows: int, sampled: int, few: float = FEW) -> int:
    """Levels of splits that make about sqrt(rows) / `few` leaves, with at least `GROWN` of the sampled rows in a leaf."""
    return max(0, int(np.floor(min(np.log2(max(rows, 1)) / 2 - np.log2(few) + 0.5, np.log2(max(sampled, 1) / GROWN)))))


def grow(sample: np.ndarray, trees: int, depth: int, seed: int = 0, turns: int = 2) -> Forest:
    rng = np.random.Generator(np.random.PCG64(seed))
    nodes = (1 << depth) - 1
    directions, cuts = np.zeros((trees, nodes, sample.shape[1])), np.zeros((trees, nodes))
    for t in range(trees):
        held = {0: np.arange(len(sample))}
        for node in range(nodes):
            own = held.pop(node, np.zeros(0, np.int64))
            w = rng.standard_normal(sample.shape[1])
            if len(own) > 1:
                part = sample[own] - sample[own].mean(axis=0)
                for _ in range(turns):
                    turned = part.T @ (part @ w)
                    if np.linalg.norm(turned) > 0:
                        w = turned / np.linalg.norm(turned)
            w /= np.linalg.norm(w)
            at = sample[own] @ w
            directions[t, node], cuts[t, node] = w, np.median(at) if len(own) else 0.0
            held[2 * node + 1], held[2 * node + 2] = own[at <= cuts[t, node]], own[at > cuts[t, node]]
    return Forest(directions, cuts, depth)


def _usable(vector: Column, dimensions: int) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(vector) == dimensions) & ~odd & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimensions)


def _best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int,
          floor: np.ndarray | float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the k nearest rows of each query that reach its floor; equal vectors have equal scores, ties go to the smaller id."""
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    score = np.einsum("qd,vd->qv", queries, rows)  # one fixed order of summation, unlike a blocked product
    score[query_ids[:, None] == row_ids[None, :]] = -np.inf
    have = min(k, len(rows))
    least = np.partition(score, len(rows) - have, axis=1)[:, len(rows) - have]
    q, v = np.nonzero((score >= np.maximum(least, floor)[:, None]) & (score > -np.inf))
    order = np.lexsort((row_ids[v], -score[q, v], q))
    q, v = q[order], v[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    q, v = q[rank < k], v[rank < k]
    return query_ids[q], row_ids[v], score[q, v]


def nearest(embeddings: DataFrame, query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = TREES, few: float = FEW,
            sample: int = SAMPLE, recall: float = RECALL, probes: int = PROBES, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """embeddings(vec_id, embedding), a condition on its columns that makes a row a query -> query_id, rank, vec_id, score.

    Score is the inner product in double precision; the k best found of all rows but the query's own id, ties to the smaller id. Rows take no part
    whose id or vector is null, or whose vector is zero, has null or non-finite numbers, or another length than most have. Rows that repeat an
    id and vector count once; an id with several vectors counts by its best one. An empty table gives an empty result; other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(embeddings[f"`{vec_id}`"].cast("long").alias("id"), embeddings[f"`{embedding}`"].cast("array<double>").alias("vector"), query.alias("asks"))
    rows = rows.where("id is not null and vector is not null")
    sizes = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dimensions = sizes["d"]
    rows = rows.where(_usable(F.col("vector"), dimensions))
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()  # at most `sample` vectors
    if not taken.num_rows:
        return spark.createDataFrame([], schema)
    depth = depth_for(rows.count(), taken.num_rows, few)
    forest = grow(_matrix(taken.column("vector").combine_chunks(), dimensions), trees, depth, seed)

    def send(batch: pa.RecordBatch) -> pa.RecordBatch:
        leaves = forest.leaves(_matrix(batch.column("vector"), dimensions))
        return pa.record_batch({"id": batch.column("id"), "vector": batch.column("vector"), "asks": batch.column("asks"),
                                "leaves": pa.ListArray.from_arrays(np.arange(0, leaves.size + 1, trees, dtype=np.int32), leaves.ravel())})

    index = S.store(S.map_arrow(rows, S.arrow_map(send), "id long, vector array<double>, asks boolean, leaves array<long>"), "forest")
    placed = index.select("id", "vector", F.posexplode("leaves").alias("tree", "leaf"))
    counts = {(r["tree"], r["leaf"]): r["n"] for r in index.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").agg(
        F.count("*").alias("n")).collect()}  # trees * leaves rows
    asking = index.where("asks").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    effort = _effort(index, asking, forest, counts, k, recall, probes, dimensions)
    row_blocks = {key: -(-n // block) for key, n in counts.items()}
    least = 2 * (k + 1) * trees

    def open_leaves(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, tree, leaf, part, turn = [], [], [], [], []
        for i, vector in enumerate(_matrix(batch.column("query"), dimensions)):
            opened = reached = 0
            for t, x in forest.visits(vector):
                if opened >= effort and reached >= least:
                    break
                opened += 1
                reached += counts.get((t, x), 0)
                for p in range(row_blocks.get((t, x), 0)):
                    at.append(i), tree.append(t), leaf.append(x), part.append(p), turn.append(opened)
        picked = pa.array(at, pa.int64())
        return pa.record_batch({"query_id": batch.column("query_id").take(picked), "query": batch.column("query").take(picked),
                                "tree": pa.array(tree, pa.int32()), "leaf": pa.array(leaf, pa.int64()), "part": pa.array(part, pa.int64()), "turn": pa.array(turn, pa.int32())})

    visits = S.store(S.map_arrow(asking, S.arrow_map(open_leaves), "query_id long, query array<double>, tree int, leaf long, part long, turn int"), "visits")
    # one row a leaf: into how many blocks its rows, and the queries that opened it, are split
    lookup = visits.where("part = 0").groupBy("tree", "leaf").agg(F.ceil(F.count("*") / block).cast("long").alias("groups"))
    parts = spark.createDataFrame([(t, x, n) for (t, x), n in row_blocks.items()], "tree int, leaf long, parts long")  # trees * leaves rows
    lookup = F.broadcast(lookup.join(F.broadcast(parts), ["tree", "leaf"]))
    visits = visits.join(lookup.drop("parts"), ["tree", "leaf"]).withColumn("group", F.pmod(F.xxhash64("query_id"), "groups"))
    held = placed.join(lookup, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "id"), "parts"))
    held = held.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    keys = ["tree", "leaf", "part", "group"]

    def rank_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        out = []
        own, ids = np.vstack(left["vector"].to_numpy()), left["id"].to_numpy()
        ask, ask_ids, floor = np.vstack(right["query"].to_numpy()), right["query_id"].to_numpy(), right["floor"].to_numpy()
        for i in range(0, len(ask), 512):
            out.append(_best(ask[i : i + 512], ask_ids[i : i + 512], own, ids, k, floor[i : i + 512]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    S.ship(spark)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def compare(visits: DataFrame) -> DataFrame:
        asks = visits.select(*keys, "query_id", "query", "floor").groupBy(*keys)
        return held.select(*keys, "id", "vector").groupBy(*keys).cogroup(asks).applyInPandas(rank_block, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    first = S.store(ranked(compare(visits.where(F.col("turn") <= trees).withColumn("floor", F.lit(float("-inf"))))), "first-leaves")
    floors = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    others = visits.where(F.col("turn") > trees).join(floors, "query_id", "left").fillna(float("-inf"), "floor")
    return ranked(first.select("query_id", "vec_id", "score").unionByName(compare(others)))


def _effort(index: DataFrame, asking: DataFrame, forest: Forest, counts: dict, k: int, recall: float, probes: int, dimensions: int) -> int:
    """Leaves to open for the wanted recall, by `probes` queries answered by brute force."""
    chosen = asking.orderBy(F.xxhash64("query_id"), "query_id").limit(probes).toArrow()
    if not chosen.num_rows:
        return 1
    vectors, ids = _matrix(chosen.column("query").combine_chunks(), dimensions), chosen.column("query_id").to_numpy()

    def brute(batch: pa.RecordBatch) -> pa.RecordBatch:
        q, v, score = _best(vectors, ids, _matrix(batch.column("vector"), dimensions), batch.column("id").to_numpy(), k)
        leaves = dict(zip(batch.column("id").to_pylist(), batch.column("leaves").to_pylist(), strict=True))
        return pa.record_batch({"query_id": pa.array(q), "vec_id": pa.array(v), "score": pa.array(score), "leaves": pa.array([leaves[x] for x in v.tolist()], pa.list_(pa.int64()))})

    best = S.map_arrow(index.select("id", "vector", "leaves"), S.arrow_map(brute), "query_id long, vec_id long, score double, leaves array<long>")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    true: dict[int, list] = {}
    for row in best.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", rank).where(F.col("rank") <= k).collect():  # probes * k rows
        true.setdefault(row["query_id"], []).append(row["leaves"])
    needed = []
    for i, vector in zip(ids.tolist(), vectors, strict=True):
        order = {key: place for place, key in enumerate(forest.visits(vector))}
        needed += [min(order[(t, x)] for t, x in enumerate(leaves)) + 1 for leaves in true.get(i, [])]
    if not needed:
        return 1
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
