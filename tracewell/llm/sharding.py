"""Sharding by weighted rendezvous hashing.

Every (record key, shard) pair has a score, -ln(u) / weight with u a hash of the pair as a number in (0, 1);
the record goes to its lowest score.  A shard is chosen in proportion to its weight, and only the key and the
set of shards decide: one more shard wins only the records that now score lowest there, and takes none
from one old shard into another.  Scores are computed in the row; nothing is gathered.

Records of a shard are numbered without a gap and without one task per shard: each shard is cut into ``BUCKETS``
buckets by a hash of key and text, which spreads rows of one repeated key too; rows are numbered inside a bucket, and
the counts of earlier buckets (a table of at most shards x BUCKETS rows) are added.

Defined results: a null text has no bytes; rows without a key share one shard; rows that repeat key and text
get slots of their own, in either order; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
BUCKETS = 4096


def score(key: Column, shard: int, weight: float) -> Column:
    """The rendezvous score of a key for one shard; the lowest wins."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)  # 53 bits
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def assign(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that a key belongs to."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    scores = F.array(*[F.struct(score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)])
    return F.array_min(scores)["shard"]


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, added: float = 1.0) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``; ``added`` is the weight of the one more shard."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"), assign(F.col("doc_id"), weights).alias("shard"),
        assign(F.col("doc_id"), [*weights, added]).alias("grown_shard"),
    ).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(BUCKETS)).cast("int"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows")).select(
        "shard", "bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    return (
        rows.withColumn("within", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("within")).alias("slot"), "grown_shard")
    )
