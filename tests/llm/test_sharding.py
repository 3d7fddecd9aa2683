import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.llm import sharding

from .helpers import SCHEMA, documents, odd_rows


def test_odd_rows(spark):
    got = sharding.shard(documents(spark)).collect()
    data = lambda t: (t or "").encode()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(d), len(data(t)) + 1, zlib.crc32(data(t))) for d, t, *_ in odd_rows())
    assert all(len({r.shard for r in got if r.doc_id == d}) == 1 for d in {r.doc_id for r in got})
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_shard(key, weights):
    """Lowest score by a plain loop over hashes that Spark gives for (key, shard)."""
    return min(range(len(weights)), key=lambda i: (-math.log(((key[i] % 2**64 >> 11) + 0.5) / 2.0**53) / weights[i], i))


def test_plain_rendezvous(spark):
    weights = [1.0, 2.0, 0.5, 1.0]
    keys = spark.createDataFrame([(None,), *[(i * 7919,) for i in range(300)]], "doc_id long").withColumn("text", F.lit("t"))
    hashes = F.array(*[F.xxhash64("doc_id", F.lit(i)) for i in range(5)]).alias("hashes")
    want = {r.doc_id: (plain_shard(r.hashes, weights), plain_shard(r.hashes, [*weights, 1.0])) for r in keys.select("doc_id", hashes).collect()}
    assert {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard(keys, weights).collect()} == want


def test_a_repeated_key_is_spread_over_buckets(spark):
    docs = spark.range(5_000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = sharding.shard(docs)
    assert len({r.shard for r in rows.collect()}) == 1 and sorted(r.slot for r in rows.collect()) == list(range(5_000))
    sizes = docs.select(F.pmod(F.xxhash64("doc_id", F.octet_length("text").cast("long") + 1, F.crc32(F.col("text").cast("binary"))),
                               F.lit(sharding.BUCKETS)).alias("b")).groupBy("b").count()
    assert sizes.agg(F.max("count")).first()[0] < 20


def test_even_stable_and_growing(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard(docs).collect()
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) < 1.1 * 40_000 / 16 and min(sizes.values()) > 0.9 * 40_000 / 16
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert all(r.grown_shard == 16 for r in moved) and 0.8 / 17 < len(moved) / 40_000 < 1.2 / 17
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs.repartition(7)).collect()}
    assert all(again[r.doc_id] == (r.shard, r.slot) for r in rows)


def test_weights(spark):
    rows = spark.range(30_000).select(sharding.assign(F.col("id"), [1.0, 2.0, 3.0]).alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 30_000 for r in rows}
    assert all(abs(share[i] - (i + 1) / 6) < 0.02 for i in range(3))
    with pytest.raises(ValueError):
        sharding.assign(F.col("id"), [1.0, 0.0])


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0
