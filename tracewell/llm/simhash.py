"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: 64 bits; a bit is set if it is set in over half of the XXH64 hashes (seed 42) of the text's
four-word shingles.  Two fingerprints are linked if they differ in at most ``RADIUS`` bits.

Candidates: each bit position gets a random vector of RADIUS+1 bits.  Table v (every vector but zero) keeps the
positions whose vector has an odd product with v.  RADIUS positions span at most RADIUS dimensions, so some v is
orthogonal to the vectors of all positions in which a pair differs: in that table the pair agrees on every kept
bit.  So *every* pair within the radius shares a bucket in one of the 31 tables, and about half of the bits are kept.

Everything after the fingerprints works on distinct ones, so exact and very near copies weigh nothing:
buckets with one member are dropped by a map-side count; buckets of up to ``BUCKET`` members are linked in
the task; the members of larger ones are linked, without pairs, over midpoints: two fingerprints within the radius
share a point that is within RADIUS/2 of both, and any two that share one are within the radius.  That is
exact, takes a fixed number of rows per fingerprint, and combines map-side.  Exploded rows are joined by sort and merge:
Spark takes them for as few bytes as the rows they come from and would send 31 or 2,081 times as many through the driver.

Defined results: a null or empty text has the fingerprint zero and is linked like any other; rows with a
null id are grouped too, but their id is never the smallest unless all are null; rows that repeat an id are
rows of their own; an empty table gives an empty result; other columns pass through where documents are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType

from tracewell.llm import words
from tracewell.llm.components import components
from tracewell.llm.tables import free_name, written

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Members up to which a bucket is compared inside one task: at most BUCKET**2 / 2 comparisons of words.
BUCKET = 1024
#: Stands for a null id where rows are joined by id.
NO_ID = (1 << 63) - 1
#: Shingles whose bits are counted at once.
STEP = 1 << 14


def fingerprint(data: bytes, starts: list[int], ends: list[int]) -> int:
    """The fingerprint of one text from the single-spaced bytes of its words."""
    count = len(starts)
    if not count:
        return 0
    width = min(SHINGLE, count)
    total = count - width + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, STEP):
        stop = min(at + STEP, total)
        hashed = np.array([digest(data[a:b], SEED) for a, b in zip(starts[at:stop], ends[at + width - 1:stop + width - 1])], ">u8")
        ones += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1).sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


@arrow_udf(LongType())
def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The 64 bits of each text's fingerprint, as a signed number."""
    for texts in batches:
        out = []
        for _, data, offsets in words.pieces(texts):
            data = words.lower_ascii(data)
            starts, ends, first = words.spans(data, offsets)
            lengths = ends - starts
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                # single-spaced: each word moves to the sum of the lengths before it, plus one space each
                size = lengths[a:b] + 1
                to = np.cumsum(size) - size
                joined = np.full(int(size.sum()), 32, np.uint8)
                within = np.arange(int(lengths[a:b].sum())) - np.repeat(np.cumsum(lengths[a:b]) - lengths[a:b], lengths[a:b])
                joined[np.repeat(to, lengths[a:b]) + within] = data[np.repeat(starts[a:b], lengths[a:b]) + within]
                out.append(fingerprint(joined.tobytes(), to.tolist(), (to + lengths[a:b]).tolist()))
        yield pa.array(np.array(out, np.uint64).view(np.int64))


def masks(radius: int = RADIUS, seed: int = 20240229) -> list[int]:
    """The kept bits of every table, as signed 64-bit numbers.

    The vectors are dealt evenly, so that every table keeps close to half of the bits.
    """
    count = 1 << (radius + 1)
    vectors = np.random.default_rng(seed).permutation(np.arange(64) % count)
    kept = [sum(1 << i for i in range(64) if bin(v & int(vectors[i])).count("1") & 1) for v in range(1, count)]
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def _near(members: np.ndarray, radius: int) -> np.ndarray:
    """For each member of a small bucket the smallest one it is connected to inside the bucket."""
    root = np.arange(len(members))
    bits = members.view(np.uint64)  # the count of a signed number is that of its absolute value
    close = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    while True:
        new = np.where(close, root[None, :], len(members)).min(1)
        if (new == root).all():
            return members[root]
        root = new


@arrow_udf(ArrayType(LongType()))
def _linked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for buckets in batches:
        yield pa.array([_near(np.sort(np.array(m, np.int64)), RADIUS).tolist() for m in buckets.to_pylist()], pa.list_(pa.int64()))


def _ball(value: Column) -> Column:
    """All points within RADIUS/2 bits of a fingerprint."""
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    flips = [0]
    for n in range(1, RADIUS // 2 + 1):
        flips += [int(np.bitwise_xor.reduce(np.array(c, np.int64))) for c in combinations(bits, n)]
    return F.transform(F.lit(np.array(flips, np.int64)), lambda f: value.bitwiseXOR(f))


def links(values: DataFrame) -> DataFrame:
    """``a, b``: links between distinct ``fp`` that connect exactly what pairs within the radius connect."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("mask")) for i, m in enumerate(masks())])
    keyed = values.select("fp", F.explode(tables).alias("x")).select(
        "fp", F.xxhash64(F.col("x.t"), F.col("fp").bitwiseAND(F.col("x.mask"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(keyed.join(sizes.hint("merge"), "key"), "buckets")
    small = shared.filter(F.col("n") <= BUCKET).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("members"))
    inside = small.select("members", _linked("members").alias("to")).select(
        F.explode(F.arrays_zip("members", "to")).alias("x")).select(F.col("x.members").alias("a"), F.col("x.to").alias("b"))
    crowded = shared.filter(F.col("n") > BUCKET).select("fp").distinct()
    points = crowded.select("fp", F.explode(_ball(F.col("fp"))).alias("point"))
    centre = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a < b").select("point", "a")
    around = points.join(centre.hint("merge"), "point").select("a", F.col("fp").alias("b"))
    return inside.union(around).filter("a <> b").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id``, the smallest id that is linked."""
    rows = written(docs.select("doc_id", fingerprints(F.coalesce("text", F.lit(""))).alias("fp")), "fingerprints")
    values = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = written(components(links(values.select("fp"))), "components")
    named = values.join(found, values["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    named = written(named, "classes")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(smallest, "component").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = groups) -> DataFrame:
    """The rows of ``docs`` without those that are linked to a smaller id; of rows that repeat an id one is kept.

    ``grouped`` gives ``doc_id, component_id`` of every row.
    """
    key, rank = free_name(docs, "simhash_key"), free_name(docs, "simhash_rank")
    keep = grouped(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias(key)).distinct()
    # the window asks for the partitioning and order that the join has made
    return (
        docs.withColumn(key, F.coalesce("doc_id", F.lit(NO_ID))).join(keep, key, "left_semi")
        .withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(key))).filter(F.col(rank) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
