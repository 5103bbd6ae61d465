"""Nearest neighbours by inner product: vantage-point trees per shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import stored

LEAF = 128
SLACK = 1e-9  # relative, so that rounding never prunes a neighbour


class _Tree:
    """Vectors in a vantage-point tree. Inner products become distances by one more coordinate, which gives all vectors
    the same length ``reach`` while queries have zero there."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reach: float, seed: int):
        order = np.argsort(ids)
        self.ids, self.vectors, self.reach = ids[order], vectors[order], reach
        self.last = np.sqrt(np.maximum(reach * reach - (vectors[order] ** 2).sum(axis=1), 0.0))
        self.random = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return np.sort(rows)
        v = int(self.random.choice(rows))
        inner = self.vectors[rows] @ self.vectors[v] + self.last[rows] * self.last[v]
        d = np.sqrt(np.maximum(2 * (self.reach * self.reach - inner), 0.0))
        by = np.argsort(d, kind="stable")
        half = len(rows) // 2
        radius = (d[by[half - 1]] + d[by[half]]) / 2
        return v, radius, self._build(rows[by[:half]]), self._build(rows[by[half:]])


class _Search:
    """The k best vectors for many queries at once; at a node the queries take the nearer side first."""

    def __init__(self, tree: _Tree, ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.tree, self.ids, self.queries, self.k, self.factor = tree, ids, queries, k, factor
        self.square = (queries ** 2).sum(axis=1) + tree.reach ** 2
        self.slack = SLACK * (np.sqrt((queries ** 2).sum(axis=1)) + tree.reach)
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self._visit(tree.root, np.arange(len(ids)))

    def _visit(self, node, q: np.ndarray) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            self._leaf(node, q)
            return
        v, radius, inside, outside = node
        inner = self.queries[q] @ self.tree.vectors[v]
        beyond = np.sqrt(np.maximum(self.square[q] - 2 * inner, 0.0)) - radius  # how far outside the ball
        near = beyond <= 0
        self._visit(inside, q[near])
        self._visit(outside, q[~near | (-beyond <= self._reach(q))])
        far = q[~near]
        self._visit(inside, far[beyond[~near] <= self._reach(far)])

    def _reach(self, q: np.ndarray) -> np.ndarray:
        """How near a better vector must be, times the factor; anything is better while k are not found."""
        worst = self.score[q, -1]
        with np.errstate(invalid="ignore"):
            d = np.sqrt(np.maximum(self.square[q] - 2 * worst, 0.0))
        return np.where(np.isinf(worst), np.inf, self.factor * d + self.slack[q])

    def _leaf(self, rows: np.ndarray, q: np.ndarray) -> None:
        x, y = self.tree.vectors[rows].T.copy(), self.queries[q].T.copy()
        s = np.zeros((len(q), len(rows)))
        for j in range(len(x)):  # in order of components, so that equal vectors score equally everywhere
            s += y[j][:, None] * x[j][None, :]
        own = self.tree.ids[rows]
        s[self.ids[q][:, None] == own[None, :]] = -np.inf
        better = s.max(axis=1) >= self.score[q, -1]
        q, s = q[better], s[better]
        score = np.concatenate([self.score[q], s], axis=1)
        found = np.concatenate([self.found[q], np.broadcast_to(own, s.shape)], axis=1)
        by = np.argsort(found, axis=1, kind="stable")
        score, found = np.take_along_axis(score, by, 1), np.take_along_axis(found, by, 1)
        by = np.argsort(-score, axis=1, kind="stable")[:, :self.k]
        self.score[q], self.found[q] = np.take_along_axis(score, by, 1), np.take_along_axis(found, by, 1)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, query_ids, k: int = 20, factor: float = 1.0, shard_rows: int = 8192,
            query_rows: int = 512, seed: int = 13, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), the id and ``score`` of the ``k`` vectors with the largest inner product for every vector
    whose id satisfies the condition ``query_ids``; equal scores go to the smaller id.

    Rows are dealt to shards of about ``shard_rows`` by a hash of the id, and each shard is one vantage-point tree. Queries
    go in blocks of about ``query_rows`` to every shard, where a branch is left out if the triangle inequality says
    that it lies farther than ``factor`` times the k-th best distance so far. Factor one is exact; smaller is faster and
    may miss neighbours. The best of all shards are merged. Scores are sums in double precision in order of components.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows without id, take no part. Of
    rows with one id the smallest vector counts. Vectors meet those of their own length only. A query with fewer than ``k``
    partners returns all. Empty in, empty out; other columns are not read.
    """
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = stored(vectors.where(F.col(id_col).isNotNull() & (F.size(v) > 0) & fine)
                  .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v).alias("v")), "vectors")
    is_query = F.expr(query_ids.replace(id_col, "id")) if isinstance(query_ids, str) else query_ids(F.col("id"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sized = kept.groupBy(F.size("v").alias("dim")).agg(
        F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"),
        F.ceil(F.greatest(F.sum(is_query.cast("int")), F.lit(1)) / query_rows).cast("int").alias("blocks"),
        F.sqrt(F.max(norm)).alias("reach"))
    rows = kept.withColumn("dim", F.size("v")).join(sized, "dim")
    shard = F.pmod(F.xxhash64("id"), "shards").cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(seed)), "blocks").cast("int")
    held = rows.select("id", "v", "dim", "reach", shard.alias("shard"),
                       F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = rows.where(is_query).select(
        F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("dim").alias("of_dim"), block.alias("of_block"),
        F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("of_shard"))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("found", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        reach = left["reach"][0].as_py()
        tree = _Tree(left["id"].to_numpy(), _matrix(left["v"]), reach, seed)
        s = _Search(tree, right["query_id"].to_numpy(), _matrix(right["q"]), k, factor)
        some = np.isfinite(s.score)
        return pa.table([right["query_id"], pa.array([f[m] for f, m in zip(s.found, some)], kind.field(1).type),
                         pa.array([f[m] for f, m in zip(s.score, some)], kind.field(2).type)], schema=kind)

    parts = held.groupBy("dim", "shard", "block").cogroup(asked.groupBy("of_dim", "of_shard", "of_block")).applyInArrow(
        search, "query_id long, found array<long>, scores array<double>")
    each = parts.select("query_id", F.explode(F.arrays_zip("found", "scores")).alias("r")).select(
        "query_id", F.col("r.found").alias(id_col), F.col("r.scores").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", id_col, "score")
