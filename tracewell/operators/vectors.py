"""Exact nearest vectors by a metric index: clusters with radii, and the triangle inequality of angles.

A library vector belongs to the nearest of at most ``CENTRES`` centres; a cluster's radius is the largest angle between
a member and its centre, so no member is nearer to a query than ``angle(query, centre) - radius``.  Queries first meet
the clusters nearest to them; the k-th best score found there then rules out every cluster whose best possible score
is lower.  Only the (query, cluster) pairs that are left are joined, so the result equals that of scoring all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tracewell.session import cut

#: Clusters of a library at most; centres are fitted on at most ``SAMPLE`` vectors for each, which pass the driver.
CENTRES, SAMPLE, STEPS = 1024, 16, 5
#: Clusters that a query meets before any is ruled out.
PROBES = 2
#: What rounding may add to an angle and to a score.
ANGLE_ERROR, SCORE_ERROR = 1e-6, 1e-9


@dataclass
class Index:
    """A clustered library: ``rows(record_id, embedding, _cluster, _piece)``, and what is known of each cluster.

    Vectors of length 0 have no direction; they are a cluster of their own, the last one, which is never ruled out.
    """

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray


def matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """Equally long lists of numbers as the rows of a matrix; ``width`` is that of a matrix without rows."""
    if not len(vectors):
        return np.zeros((0, width))
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(vectors), -1)


def _directions(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _fit(sample: np.ndarray, number: int) -> np.ndarray:
    """``number`` directions that a sample gathers around, by a few rounds of means."""
    unit = _directions(sample)
    unit = unit[unit.any(1)]
    centres = unit[:number]
    for _ in range(STEPS):
        nearest = (unit @ centres.T).argmax(1) if len(unit) else np.empty(0, int)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        centres = np.where(sums.any(1, keepdims=True), _directions(sums), centres)
    return centres


def build(library: DataFrame, block_rows: int) -> Index:
    """Cluster ``library(record_id, embedding)``; blocks of a cluster hold about ``block_rows`` vectors."""
    known = library.select("record_id", "embedding").filter("embedding IS NOT NULL")
    place = F.xxhash64("record_id", "embedding")
    number = min(CENTRES, -(-known.count() // block_rows))
    sample = known.select("embedding").orderBy(place, "embedding").limit(number * SAMPLE).collect() if number else []
    centres = _fit(np.array([r["embedding"] for r in sample], "float64") if sample else np.zeros((0, 0)), number)

    @arrow_udf("struct<cluster:int,angle:double>")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            unit = _directions(matrix(vectors, centres.shape[1]))
            flat = ~unit.any(1)
            if len(centres):
                cosine = unit @ centres.T
                best = cosine.argmax(1)
                angle = np.arccos(np.clip(cosine[np.arange(len(best)), best], -1, 1))
            else:
                best, angle = np.zeros(len(unit), int), np.zeros(len(unit))
            yield pa.StructArray.from_arrays([
                pa.array(np.where(flat, len(centres), best), pa.int32()), pa.array(np.where(flat, np.pi, angle))], ["cluster", "angle"])

    placed = cut(known.withColumn("_at", nearest("embedding")).select(
        "record_id", "embedding", F.col("_at.cluster").alias("_cluster"), F.col("_at.angle").alias("_angle")))
    radii, pieces = np.full(len(centres) + 1, -np.inf), [1] * (len(centres) + 1)
    for row in placed.groupBy("_cluster").agg(F.max("_angle").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # one row per cluster
        radii[row["_cluster"]], pieces[row["_cluster"]] = row["r"], -(-row["n"] // block_rows)
    count = F.element_at(F.array(*[F.lit(n) for n in pieces]), F.col("_cluster") + 1)
    return Index(placed.select("record_id", "embedding", "_cluster", F.pmod(place, count).cast("int").alias("_piece")), centres, radii)


def clusters_of(index: Index, vector: Column, limit: Column | None = None) -> Column:
    """The clusters that a query must meet: its nearest ones, or beyond those the ones that can still reach ``limit``."""
    centres, radii = index.centres, index.radii
    first = limit is None

    @arrow_udf("array<int>")
    def choose(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, limits in batches:
            unit = _directions(matrix(vectors, centres.shape[1]))
            angle = np.arccos(np.clip(unit @ centres.T, -1, 1)) if len(centres) else np.empty((len(unit), 0))
            near = np.c_[angle - radii[:-1] - ANGLE_ERROR, np.zeros(len(unit))]  # the smallest angle a member may have
            near[:, np.isneginf(radii)] = np.inf  # clusters without a member
            met = np.zeros(near.shape, bool)
            np.put_along_axis(met, np.argsort(near, axis=1, kind="stable")[:, :PROBES], True, axis=1)
            if not first:
                reach = np.cos(np.clip(near, 0, np.pi)) + SCORE_ERROR
                met = ~met & (reach >= limits.to_numpy(zero_copy_only=False)[:, None])
            met &= np.isfinite(near)
            yield pa.array([np.flatnonzero(row).tolist() for row in met], pa.list_(pa.int32()))

    return choose(vector, F.lit(0.0) if limit is None else limit)


def _score(k: int):
    def score(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not len(asked) or not len(known):
            return pa.table({"claim_id": asked["claim_id"][:0], "record_id": known["record_id"][:0], "semantic": pa.array([], pa.float64())})
        names = known["record_id"].to_numpy()
        order = np.argsort(names, kind="stable")
        names, m, q = names[order], matrix(known["embedding"])[order], matrix(asked["embedding"])
        scale = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(m, axis=1))
        cosine = np.divide(q @ m.T, scale, out=np.zeros_like(scale), where=scale > 0)
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        best, names = np.maximum.reduceat(cosine, starts, axis=1), names[starts]
        wanted = np.zeros(best.shape, bool)
        np.put_along_axis(wanted, np.argsort(-best, axis=1, kind="stable")[:, :k], True, axis=1)
        place = {n: i for i, n in enumerate(names.tolist())}
        for i, also in enumerate(asked["also"].to_pylist()):
            for name in also or ():
                if name in place:
                    wanted[i, place[name]] = True
        rows, columns = np.nonzero(wanted)
        return pa.table({
            "claim_id": asked["claim_id"].take(pa.array(rows)), "record_id": pa.array(names[columns], known.schema.field("record_id").type),
            "semantic": best[rows, columns]})

    return score


def scored(pairs: DataFrame, index: Index, k: int, block_rows: int) -> DataFrame:
    """``claim_id, record_id, semantic`` of the best ``k`` records of each pair ``(claim_id, embedding, also, _cluster, _piece)``.

    A block is copied once for every ``block_rows`` queries that meet it, and not at all where none does.
    """
    block = ["_cluster", "_piece"]
    parts = pairs.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))).cast("int").alias("_parts"))
    left = pairs.join(parts, block).withColumn("_part", F.pmod(F.xxhash64("claim_id"), F.col("_parts")).cast("int"))
    right = index.rows.join(parts, block).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    types = {c: f.schema[c].dataType.simpleString() for c, f in (("claim_id", pairs), ("record_id", index.rows))}
    key = F.struct(*block, "_part").alias("_key")
    left, right = left.select(key, "claim_id", "embedding", "also"), right.select(key, "record_id", "embedding")
    return left.groupBy("_key").cogroup(right.groupBy("_key")).applyInArrow(
        _score(k), f"claim_id {types['claim_id']}, record_id {types['record_id']}, semantic double"
    ).groupBy("claim_id", "record_id").agg(F.max("semantic").alias("semantic"))


def nearest(queries: DataFrame, library: DataFrame, k: int, block_rows: int) -> DataFrame:
    """``claim_id, record_id, semantic, rank`` of the records that are among a query's best ``k``, or named in ``also``.

    Other records may be in the result with a rank above ``k``; ranks up to ``k`` and scores of named records are exact.
    """
    index = build(library, block_rows)
    asked = queries.select("claim_id", "embedding", "also").filter("embedding IS NOT NULL")
    blocks = index.rows.select("_cluster", "_piece").distinct()
    columns = ["claim_id", "embedding", "also", "_cluster", "_piece"]
    meets = lambda rows, clusters: rows.withColumn("_cluster", F.explode(clusters)).join(blocks, "_cluster").select(*columns)
    near = meets(asked, clusters_of(index, F.col("embedding")))
    named = asked.withColumn("record_id", F.explode("also")).join(
        index.rows.select("record_id", "_cluster", "_piece").distinct(), "record_id").select(*columns)
    found = scored(near.unionByName(named).dropDuplicates(["claim_id", "_cluster", "_piece"]), index, k, block_rows)
    order = Window.partitionBy("claim_id").orderBy(F.desc("semantic"), F.asc("record_id"))
    if np.isfinite(index.radii).sum() > PROBES:
        found = cut(found)
        limits = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(
            "claim_id", F.col("semantic").alias("_limit"))
        rest = asked.join(limits, "claim_id", "left").withColumn("_limit", F.coalesce("_limit", F.lit(-2.0)))
        more = scored(meets(rest, clusters_of(index, F.col("embedding"), F.col("_limit"))), index, k, block_rows)
        found = found.unionByName(more).groupBy("claim_id", "record_id").agg(F.max("semantic").alias("semantic"))
    return found.withColumn("rank", F.row_number().over(order))
