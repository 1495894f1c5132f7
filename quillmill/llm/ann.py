"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample of `sample_rows` vectors (all of them while there are
fewer); every vector is then indexed under its leaf. A query walks the tree best bin first: a
priority queue holds nodes by distance from the query to their centre, and leaves are visited
in that order. How many leaves is calibrated: visits are widened until queries drawn from the
sample find `recall` of their true neighbours in it; a query goes on beyond that while the
leaves it visited hold too few vectors. Distances are Euclidean, in double precision, on the
original vectors.

Equal vectors are one entry that keeps its k + 1 smallest ids: no query can return more of
them. Leaves are dealt in chunks of about CHUNK_ROWS entries and queries in blocks of about
QUERY_BLOCK, so neither a crowded leaf nor many queries meet in one task.

Rows with a null id, and vectors that are null, zero, of another length than most, or that hold
null or non-finite components take no part. Rows that repeat id and vector are one candidate.
Fewer candidates than k are all returned; ties go to the smaller id; an empty table gives an
empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SAMPLE_ROWS = 20_000
BRANCHES = 8
LEAF_SAMPLES = 64
RECALL = 0.98
CALIBRATION_QUERIES = 200
CHUNK_ROWS = 2_048
QUERY_BLOCK = 20_000
SALTS = 64


@dataclass
class Tree:
    """Nodes 0 up, the root first: centres, children (empty for a leaf), number of a leaf or -1."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    n_leaves: int
    visits: int = 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: down the nearest centres."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                kids = self.children[node]
                near = squared(x[rows], self.centres[kids]).argmin(axis=1)
                todo += [(kid, rows[near == i]) for i, kid in enumerate(kids)]
        return out

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield int(self.leaf[node])
            elif len(kids := self.children[node]):
                for d, kid in zip(((self.centres[kids] - q) ** 2).sum(axis=1), kids, strict=True):
                    heapq.heappush(queue, (float(d), int(kid)))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = squared(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres, squared(x, centres).argmin(axis=1)


def fit_tree(x: np.ndarray, k: int, recall: float = RECALL, seed: int = 7) -> Tree:
    rng = np.random.default_rng(seed)
    centres, children, leaf, n_leaves = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [np.empty(0, np.int64)], [-1], 0
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        near = np.zeros(len(rows), np.int64)
        if len(rows) > LEAF_SAMPLES:
            own, near = k_means(x[rows], BRANCHES, rng)
        if near.max(initial=0) == near.min(initial=0):
            leaf[node], n_leaves = n_leaves, n_leaves + 1
            continue
        used = np.unique(near)
        children[node] = np.arange(len(centres), len(centres) + len(used))
        for i in used:
            todo.append((len(centres), rows[near == i]))
            centres.append(own[i])
            children.append(np.empty(0, np.int64))
            leaf.append(-1)
    tree = Tree(np.array(centres), children, np.array(leaf), n_leaves)
    tree.visits = calibrate(tree, x, k, recall, rng)
    return tree


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float, rng: np.random.Generator) -> int:
    """Leaves to visit so that sample queries find `recall` of their k nearest in the sample."""
    if len(x) <= k + 1:
        return tree.n_leaves
    home, found = tree.assign(x), []
    for i in rng.choice(len(x), min(CALIBRATION_QUERIES, len(x)), replace=False):
        d = squared(x[i : i + 1], x)[0]
        d[i] = np.inf
        order = {leaf: r for r, leaf in enumerate(tree.walk(x[i]))}
        found += [order[int(home[j])] for j in np.argpartition(d, k)[:k]]
    return int(np.sort(found)[int(np.ceil(recall * len(found))) - 1]) + 1


def usable(vec: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest_in(x: np.ndarray, ids: list, q: np.ndarray, keys: np.ndarray, most: int) -> pd.DataFrame:
    """For each query the `most` nearest (distance, id) of entries x with their ids."""
    out = []
    rough = squared(q, x)
    scale = 1e-9 * (1 + (x * x).sum(axis=1).max() + (q * q).sum(axis=1).max())
    for i, key in enumerate(keys):
        bound = np.partition(rough[i], most - 1)[most - 1] if len(x) > most else np.inf
        near = np.flatnonzero(rough[i] <= bound + scale)
        exact = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
        rows = sorted((float(d), int(v)) for d, j in zip(exact, near, strict=True) for v in ids[j])[:most]
        out += [(key, d, v) for d, v in rows]
    return pd.DataFrame(out, columns=["q", "score", "vec_id"])


def search(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 10,
    recall: float = RECALL,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest vectors but those with its own id.

    queries: rows with the same columns, usually of the same table.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 1
    base, asked = base.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)

    # Equal vectors: k + 1 smallest ids, first within a salt, so that many copies meet nowhere.
    by = lambda *c: F.dense_rank().over(Window.partitionBy(*c).orderBy("id"))
    few = base.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = few.withColumn("_r", by("v", "_salt")).filter(F.col("_r") <= k + 1).withColumn("_r", by("v")).filter(F.col("_r") <= k + 1)
    entries = cut(few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    n_entries = entries.count()

    share = min(1.0, sample_rows / max(1, n_entries))
    draw = F.pmod(F.xxhash64("v", F.lit("tree")), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = entries.filter(draw).select("v").limit(sample_rows * 2).toArrow().to_pandas()["v"]
    tree = fit_tree(np.array(sample.tolist(), np.float64).reshape(len(sample), dim), k, recall)
    sent = vectors.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.assign(matrix(b.column(0)))), *b.columns], names=["leaf", "v", "ids"])

    indexed = cut(entries.mapInArrow(place, entries.select(F.lit(0).cast("long").alias("leaf"), "v", "ids").schema))
    held = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # at most a row for each leaf of the tree
    chunks = {leaf: -(-n // CHUNK_ROWS) for leaf, n in held.items()}
    n_blocks = -(-asked.count() // QUERY_BLOCK) or 1

    # Equal query vectors are searched once.
    distinct = cut(asked.groupBy("v").agg(F.min("id").alias("q")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, leaves, parts, x = [], [], [], matrix(b.column(0))
            for i, q in enumerate(x):
                seen, n = 0, 0
                for leaf in sent.value.walk(q):
                    if leaf in held:
                        for c in range(chunks[leaf]):
                            take.append(i), leaves.append(leaf), parts.append(c)
                        n += held[leaf]
                    seen += 1
                    if seen >= sent.value.visits and n > k + 1:
                        break
            rows = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(leaves, pa.int64()), pa.array(parts, pa.int64())], names=["v", "q", "leaf", "chunk"])

    zero = F.lit(0).cast("long")
    probes = distinct.select("v", "q").mapInArrow(probe, distinct.select("v", "q", zero.alias("leaf"), zero.alias("chunk")).schema)
    probes = probes.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(n_blocks)))
    n_chunks = F.create_map(*[F.lit(x) for p in chunks.items() for x in p]) if chunks else F.create_map(zero, zero)
    parts = indexed.withColumn("chunk", F.pmod(F.xxhash64("v"), n_chunks[F.col("leaf")].cast("long")))
    parts = parts.withColumn("block", F.explode(F.sequence(zero, F.lit(n_blocks - 1).cast("long"))))

    def meet(entries: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        if entries.empty or probes.empty:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "vec_id": pd.Series(dtype="int64")})
        x, q = np.array(entries["v"].tolist(), np.float64), np.array(probes["v"].tolist(), np.float64)
        step = max(1, 4_000_000 // len(x))
        return pd.concat([nearest_in(x, entries["ids"].tolist(), q[i : i + step], probes["q"].to_numpy()[i : i + step], k + 1) for i in range(0, len(q), step)])

    keys = ["leaf", "chunk", "block"]
    met = parts.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(meet, "q long, score double, vec_id long")
    order = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("score", "vec_id"))
    best = met.withColumn("_r", order("q")).filter(F.col("_r") <= k + 1).drop("_r")
    out = asked.select(F.col("id").alias("query_id"), "v").distinct().join(distinct, "v").select("query_id", "q").join(best, "q")
    out = out.filter(F.col("vec_id") != F.col("query_id")).withColumn("rank", order("query_id")).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
