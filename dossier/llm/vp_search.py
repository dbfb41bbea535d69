"""Largest inner products by vantage-point trees, one per shard, with relaxed pruning.

The vectors are dealt to shards by a hash of their id, so shards are even whatever the vectors look
like. A task builds its shard's tree and lets the queries run through it in batches. The tree needs
a metric: within a shard every vector gets one more component, the root of what its squared length
lacks to the largest one, and queries get a zero there. Then the nearest by distance are those of
the largest inner product.

A branch is skipped if the triangle inequality, its bound times ``factor``, keeps it further than
the worst of the neighbours found. Factor 1 gives exactly the nearest; a larger one skips more.

Equal vectors of a shard are one point of the tree, so any number of copies costs one distance, and
of a point only the smallest ids can be among the nearest. Scores are computed from the original
vectors in double precision, the same way for every pair; ties go to the smaller id.

Rows whose id or vector is null, and vectors that are zero or hold null or non-finite components or
another number of components than most, take no part. A query row is not its own neighbour; rows
that repeat an id count as that same vector's row and are left out together. With fewer candidates,
all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import stored

NEIGHBOURS = 20
#: Relaxation of the triangle inequality; recall is measured in the tests and the README.
FACTOR = 1.6
SHARD_ROWS = 16_384
LEAF = 256
QUERY_BATCH = 512
_SLACK = 1e-9


class Tree:
    """A vantage-point tree over distinct points, split at the median distance."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.norms = (points**2).sum(axis=1)
        self._leaf = leaf
        self._generator = np.random.default_rng(0)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self._leaf:
            return rows
        vantage = rows[self._generator.integers(len(rows))]
        d = np.sqrt(self._squares(self.points[vantage : vantage + 1], rows)[0])
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        inner, outer = order[:half], order[half:]
        bounds = (d[inner[0]], d[inner[-1]], d[outer[0]], d[outer[-1]])
        return vantage, bounds, self._build(rows[inner]), self._build(rows[outer])

    def _squares(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        products = queries @ self.points[rows].T
        squares = (queries**2).sum(axis=1)[:, None] + self.norms[rows] - 2 * products
        return np.maximum(squares, 0)

    def search(self, queries: np.ndarray, k: int, factor: float) -> list[np.ndarray]:
        """For each query the points that may be among its ``k`` nearest, the found ones' all."""
        best = np.full((len(queries), k), np.inf)
        found: list[list[np.ndarray]] = [[] for _ in queries]

        def scan(rows: np.ndarray, mine: np.ndarray) -> None:
            squares = self._squares(queries[mine], rows)
            joined = np.concatenate([best[mine], squares], axis=1)
            best[mine] = np.partition(joined, k - 1, axis=1)[:, :k]
            limit = best[mine].max(axis=1) + _SLACK
            q, r = np.nonzero(squares <= limit[:, None])
            for i, part in zip(mine, np.split(rows[r], np.searchsorted(q, np.arange(1, len(mine)))), strict=True):
                if len(part):
                    found[i].append(part)

        def visit(node, mine: np.ndarray) -> None:
            if not len(mine):
                return
            if isinstance(node, np.ndarray):
                scan(node, mine)
                return
            vantage, (a, b, c, e), inner, outer = node
            d = np.sqrt(self._squares(queries[mine], np.array([vantage]))[:, 0])
            # The least distance to any point of either half, by the triangle inequality.
            least_inner = np.maximum(np.maximum(a - d, d - b), 0)
            least_outer = np.maximum(np.maximum(c - d, d - e), 0)
            first_inner = least_inner <= least_outer

            def go(side, least: np.ndarray, chosen: np.ndarray) -> None:
                worst = np.sqrt(best[mine[chosen]].max(axis=1))
                visit(side, mine[chosen][least[chosen] * factor <= worst + _SLACK])

            into, out_of = np.flatnonzero(first_inner), np.flatnonzero(~first_inner)
            go(inner, least_inner, into)
            go(outer, least_outer, out_of)
            go(outer, least_outer, into)
            go(inner, least_inner, out_of)

        visit(self.root, np.arange(len(queries)))
        return [np.concatenate(f) if f else np.empty(0, np.int64) for f in found]


def _lifted(vectors: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(axis=1)
    return np.c_[vectors, np.sqrt(np.maximum(squares.max() - squares, 0))]


class Shard:
    """A shard's vectors: the tree over distinct ones, and the ids of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.vectors, member = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, member.ravel()))
        self._ids = ids[order]
        self._ends = np.cumsum(np.bincount(member.ravel(), minlength=len(self.vectors)))
        self.tree = Tree(_lifted(self.vectors))

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        """Rows (query id, id, score): each query's ``k`` nearest of the shard but itself."""
        # A copy of the query's own vector and the query itself take up to two of the places.
        points = self.tree.search(np.c_[queries, np.zeros(len(queries))], k + 1, factor)
        rows = []
        for q, query, found in zip(ids.tolist(), queries, points, strict=True):
            scores = (self.vectors[found] * query).sum(axis=1)
            order = np.argsort(-scores, kind="stable")
            least = scores[order[k]] if len(order) > k else -np.inf
            near = []
            for p, s in zip(found[order].tolist(), scores[order].tolist(), strict=True):
                if s < least:
                    break
                start = self._ends[p - 1] if p else 0
                near += [(-s, i) for i in self._ids[start : min(self._ends[p], start + k + 1)].tolist() if i != q]
            near.sort()
            rows += [(q, i, -s) for s, i in near[:k]]
        return rows


def _search(dimensions: int, k: int, factor: float):
    """Rows sorted by (shard, is_query): a shard's vectors, then the queries that run through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard = None, None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []

        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            queries = batch.column(1).to_numpy(zero_copy_only=False)
            names = batch.column(2).to_numpy(zero_copy_only=False)
            values = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            change = (numbers[1:] != numbers[:-1]) | (queries[1:] != queries[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if numbers[a] != current:
                    current, shard, ids, vectors = numbers[a], None, [], []
                if not queries[a]:
                    ids.append(names[a:b])
                    vectors.append(values[a:b])
                    continue
                if shard is None:
                    if not ids:
                        continue
                    shard = Shard(np.concatenate(ids), np.concatenate(vectors))
                for start in range(a, b, QUERY_BATCH):
                    end = min(b, start + QUERY_BATCH)
                    rows = shard.nearest(names[start:end], values[start:end], k, factor)
                    columns = list(zip(*rows, strict=True)) or [[], [], []]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(list(columns[0]), pa.int64()),
                            pa.array(list(columns[1]), pa.int64()),
                            pa.array(list(columns[2]), pa.float64()),
                        ],
                        names=["query_id", "vec_id", "score"],
                    )

    return run


def usable(rows: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, int]:
    """The rows that take part (id, vector as doubles), written, and their number of components."""
    doubles = F.col(vector).cast("array<double>")
    finite = F.forall(
        doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    some = F.exists(doubles, lambda x: x != 0)
    kept = rows.select(F.col(id_column).cast("long").alias("id"), doubles.alias("vector")).filter(
        F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & some
    )
    table = stored(kept, "vectors")
    sizes = table.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    n = sizes["n"] if sizes else 0
    return table.filter(F.size("vector") == n), n


def nearest(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    every: int = 20,
    k: int = NEIGHBOURS,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The ``k`` rows of largest inner product for each row whose id is divisible by ``every``:
    ``query_id``, ``rank`` (from 1), the id, ``score``.
    """
    table, dimensions = usable(rows, id_column, vector)
    shards = max(1, math.ceil(table.count() / shard_rows))
    data = table.select(
        F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).alias("shard"),
        F.lit(False).alias("is_query"),
        "id",
        "vector",
    )
    queries = table.filter(F.col("id") % every == 0).dropDuplicates(["id"])
    asked = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        F.lit(True).alias("is_query"),
        "id",
        "vector",
    )
    ordered = data.unionByName(asked).repartition(shards, "shard").sortWithinPartitions(
        "shard", "is_query"
    )
    found = ordered.mapInArrow(
        _search(max(1, dimensions), k, factor), "query_id long, vec_id long, score double"
    ).distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_column), "score")
