"""Ordering within keys, written so that no key has to fit into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import new_folder


def in_range(name: str, value: int, most: int, least: int = 1) -> int:
    """The parameter itself; a value out of range is an error, never changed silently."""
    if not least <= value <= most:
        raise ValueError(f"{name} must lie between {least} and {most}, not {value}")
    return value


def top_k(frame: DataFrame, keys, order, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key.

    A filter right on ``row_number`` lets Spark keep only ``k`` rows per key and task
    *before* the shuffle, so a key with very many rows costs ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def best_row(frame: DataFrame, keys, order: Column, columns=None) -> DataFrame:
    """One row per key, the one with the greatest ``order``; combines map-side."""
    names = [c for c in (columns or frame.columns) if c not in keys]
    picked = F.max_by(F.struct(*names), order).alias("_best")
    return frame.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_best.{n}").alias(n) for n in names])


def ordinals(frame: DataFrame, keys, order, bucket, name: str = "ordinal") -> DataFrame:
    """Exact ``row_number`` per key for keys of any size.

    ``bucket`` columns must agree with the order (rows of an earlier bucket come first),
    for instance the day of a time.  Rows are numbered inside (key, bucket); the number of
    rows in earlier buckets, a small aggregate, is added.  No task sees a whole key.
    """
    keys = list(keys)
    names = [f"_b{i}" for i in range(len(bucket))]
    rows = frame.withColumns(dict(zip(names, bucket)))
    slot = keys + names
    inner = Window.partitionBy(*slot).orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy(*[F.col(n).asc_nulls_last() for n in names]).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        rows.groupBy(*slot).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select(*[F.col(c).alias(f"_o{c}") for c in slot], "_before")
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in slot])
    return (
        rows.withColumn("_inner", F.row_number().over(inner))
        .join(offsets, same)
        .withColumn(name, (F.col("_inner") + F.col("_before")).cast("bigint"))
        .select(*frame.columns, name)
    )


def range_ordinals(frame: DataFrame, keys, order, name: str = "ordinal") -> DataFrame:
    """Exact ``row_number`` per key for keys of any size, where no bucket is known that agrees with the order.

    Rows are dealt by ranges of (key, order), so a hot key lies in several partitions, one range after the other,
    and written once: a partition's number must not change when a lost task is run again.  Rows are numbered inside
    (key, partition), and the rows of the key's earlier partitions are added; that table has one row per partition
    and key in it.  ``order`` should tell all rows of a key apart, or equal ones stay together.
    """
    keys, spark = list(keys), frame.sparkSession
    folder = new_folder(spark, "ranges")
    frame.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    slot = [*keys, "_part"]
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*slot).agg(F.count(F.lit(1)).alias("_n"))
        .select(*[F.col(c).alias(f"_o{c}") for c in slot], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in slot])
    inner = F.row_number().over(Window.partitionBy(*slot).orderBy(*order))
    return rows.withColumn("_inner", inner).join(offsets, same).select(
        *frame.columns, (F.col("_inner") + F.col("_before")).cast("bigint").alias(name))
