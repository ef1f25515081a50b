import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from shelfwise.llm import feistel_shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 97, 1000, 4097])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(feistel_shards.permuted(F.col("id"), n).alias("p")).collect()]
    assert sorted(got) == list(range(n)) and (n < 97 or got != list(range(n)))


def test_shards_are_even_gapless_and_reproducible(spark):
    rows = [(i % 40 if i % 9 else None, None if i % 7 == 0 else "ü" * (i % 5) + ("copy" if i % 3 else str(i)), i) for i in range(500)] + [(1, "same", 0)] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = feistel_shards.shard(docs).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and set(slots) == set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = sorted((repr(k), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, _ in rows)
    assert sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    again = feistel_shards.shard(docs.repartition(7)).collect()
    key = lambda r: (repr(r.doc_id), r["size"], r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert feistel_shards.shard(docs.limit(0)).count() == 0
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
