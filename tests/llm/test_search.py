import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from shelfwise.llm import cover_tree


def brute(rows, every=50, k=5):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for q, a in usable:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(b) == len(a))[:k]
            found += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(found)


@pytest.mark.parametrize("clusters, spread", [(1, 1.0), (8, 0.01), (40, 0.2)])
def test_table_against_brute_force(spark, clusters, spread):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 12))
    rows = [(i, (centres[i % clusters] + spread * rng.normal(size=12)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5] * 12) for i in range(60)] + [(5000, None), (5050, []), (5100, [1.0, None] * 6), (5150, [float("nan")] * 12), (None, [1.0] * 12), (5200, [1.0, 2.0]), (5201, [3.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    got = cover_tree.top_k(table, F.col("vec_id") % 50 == 0, block_rows=150, query_rows=7)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert cover_tree.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_nodes_cover_their_rows_and_split_clusters():
    rng = np.random.default_rng(3)
    points = (rng.normal(size=(20, 4))[np.arange(1500) % 20] + 1e-3 * rng.normal(size=(1500, 4))) * 1000
    tree = cover_tree.CoverTree(points, np.arange(1500))
    todo, nodes = [tree], 0
    while todo:
        node = todo.pop()
        nodes += 1
        assert np.sqrt(((points[node.rows] - node.centre) ** 2).sum(1)).max() <= node.radius
        if node.children:
            parts = [c.rows for c in node.children] + [node.bucket]
            assert sorted(np.concatenate(parts).tolist()) == sorted(node.rows.tolist())
        todo += node.children
    assert nodes > 10
