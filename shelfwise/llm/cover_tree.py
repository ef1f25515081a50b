"""Exact top-k search by inner product with cover trees over queries and data.

Vectors are cut into blocks of bounded size and each block gets a cover tree: a node
has a centre (one of its vectors) and a covering radius, and the centres below it stand
closer than half of that. Queries are blocks with trees as well. A block of queries
meets every block of data; the two trees are descended together, and a pair of nodes
is left out when the largest product that the centres and radii allow is below the worst
k-th score that any query of the group has so far. The best of the blocks are merged.

Blocks of data are dealt to groups of a few blocks, and each block of queries travels
to every group, so neither the driver nor a task holds all queries or much data.

Defined results: a vector that is null, empty, or holds a null or non-finite component
takes no part; so does a row without id. Only vectors of equal length have a product.
The rows that share a query's id are its own and never its answers. Ties go to the
smaller id, repeated ids count once per row. A query without candidates has no answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .batches import map_rows

BLOCK_ROWS, QUERY_ROWS, LEAF, GROUP_BLOCKS = 4096, 1024, 48, 2
QUERY_EVERY, K, SCALE = 50, 5, 256
#: Score of an answer that is not there.
NONE = np.int64(-(2 ** 63 - 1))


def scaled(embedding: Column, scale: int = SCALE) -> Column:
    """Whole components floor(scale * x)."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~bad


class CoverTree:
    """Nodes of a cover tree over the rows of a matrix; ``bucket`` holds rows that are covered by no child."""

    __slots__ = ("centre", "norm", "radius", "rows", "children", "bucket")

    def __init__(self, points: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.centre = points[rows[0]]
        self.norm = float(np.sqrt((self.centre * self.centre).sum()))
        far = np.sqrt(((points[rows] - self.centre) ** 2).sum(axis=1))
        self.radius, self.rows = float(far.max()) * (1 + 1e-9) + 1e-6, rows
        self.children: list[CoverTree] = []
        self.bucket = rows
        if len(rows) <= leaf or far.max() == 0:
            return
        limit, alone = far.max() / 2, []
        nearest, open_ = far.copy(), rows
        while len(open_):
            near = nearest <= limit
            group = open_[near]
            if len(group) > leaf // 4:
                self.children.append(CoverTree(points, group, leaf))
            else:
                alone.append(group)
            open_ = open_[~near]
            if len(alone) > 8 and sum(map(len, alone)) > 8 * len(self.children) * leaf + 64:
                alone.append(open_)  # points that stand far apart gain nothing from nodes of their own
                break
            if len(open_):
                nearest = np.sqrt(((points[open_] - points[open_[0]]) ** 2).sum(axis=1))
        self.bucket = np.concatenate(alone) if alone else rows[:0]


class TopK:
    """The k best answers of each query so far; ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((queries, k), NONE), np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        reach = np.flatnonzero((scores >= self.scores[rows, -1][:, None]).any(axis=1))
        if not len(reach):
            return
        rows, scores = rows[reach], scores[reach]
        all_scores = np.concatenate((self.scores[rows], scores), axis=1)
        all_ids = np.concatenate((self.ids[rows], np.broadcast_to(ids, scores.shape)), axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :self.k]
        self.scores[rows] = np.take_along_axis(all_scores, order, 1)
        self.ids[rows] = np.take_along_axis(all_ids, order, 1)


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, leaf: int = LEAF) -> TopK:
    """Dual-tree search of all queries against all points; whole numbers throughout, as doubles where those are exact."""
    best = TopK(len(queries), k)
    exact = np.abs(queries).max() * np.abs(points).max() * queries.shape[1] < 2 ** 52
    q, p = (queries.astype(np.float64), points.astype(np.float64)) if exact else (queries, points)
    q_tree, p_tree = CoverTree(queries.astype(np.float64), np.arange(len(queries)), leaf), CoverTree(points.astype(np.float64), np.arange(len(points)), leaf)

    def bound(a: CoverTree, b: CoverTree) -> float:
        most = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return most + abs(most) * 1e-9 + 1e-3

    def meet(rows: np.ndarray, others: np.ndarray) -> None:
        if len(rows) and len(others):
            scores = (q[rows] @ p[others].T).astype(np.int64)
            best.offer(rows, np.where(query_ids[rows][:, None] == ids[others][None, :], NONE, scores), ids[others])

    def descend(a: CoverTree, b: CoverTree) -> None:
        if bound(a, b) < best.scores[a.rows, -1].min():
            return
        if not a.children and not b.children:
            meet(a.rows, b.rows)
        elif a.children and (not b.children or a.radius >= b.radius):
            for child in a.children:
                descend(child, b)
            if len(a.bucket):
                below(a, a.bucket, b)
        else:
            for child in sorted(b.children, key=lambda child: -bound(a, child)):
                descend(a, child)
            meet(a.rows, b.bucket)

    def below(a: CoverTree, rows: np.ndarray, b: CoverTree) -> None:
        """Queries of ``a`` outside its children, as one group, against the whole of ``b``."""
        if bound(a, b) < best.scores[rows, -1].min():
            return
        for child in sorted(b.children, key=lambda child: -bound(a, child)):
            below(a, rows, child)
        meet(rows, b.bucket)

    descend(q_tree, p_tree)
    return best


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one length: (block, dims, ids, components)."""
    def pack(part: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[int, list] = {}
        for vec_id, components in part:
            own = held.setdefault(len(components), [])
            own.append((vec_id, components))
            if len(own) == rows:
                yield done(len(components), held.pop(len(components)))
        for dims, own in held.items():
            yield done(dims, own)

    def done(dims: int, own: list) -> tuple:
        return dims, np.array([i for i, _ in own], np.int64).tobytes(), np.array([c for _, c in own], np.int64).tobytes()

    return map_rows(vectors, pack, "dims int, ids binary, components binary")


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = SCALE,
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest products of each row that ``is_query`` (a column over vec_id) picks, with all other rows."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select("vec_id", scaled(F.col("embedding"), scale).alias("components"))
    data = stage(_blocks(rows, block_rows), "data_blocks")
    queries = _blocks(rows.filter(is_query), query_rows)
    groups = max(1, data.count() // GROUP_BLOCKS)
    asked = queries.select(F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("components").alias("q_components"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    pairs = (data.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")).join(asked, "group").filter(F.col("dims") == F.col("q_dims")))

    def find(part: Iterator[tuple]) -> Iterator[tuple]:
        for dims, ids, components, q_ids, q_components in part:
            own_ids, query_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
            best = search(np.frombuffer(q_components, np.int64).reshape(-1, dims), query_ids, np.frombuffer(components, np.int64).reshape(-1, dims), own_ids, k)
            for row, query_id in enumerate(query_ids.tolist()):
                for score, found in zip(best.scores[row].tolist(), best.ids[row].tolist()):
                    if score > NONE:
                        yield query_id, found, score

    found = map_rows(pairs.select("dims", "ids", "components", "q_ids", "q_components"), find, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
