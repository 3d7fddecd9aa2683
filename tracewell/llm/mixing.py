"""Mixing sources to target weights, in built-in functions only.

Words are summed per source (map-side first, so that a hot source costs one row per task) and written: the table of
targets then has a known size, by which Spark decides whether it is broadcast, and documents need not move.  The sources,
in code point order and null last, weigh 5, 2, 1, 5, 2, 1, ...; a source's target is its share of all words,
at most ``MOST_REPEATS`` times its own words, and what it cannot take goes to the others by weight.  With the
sources ordered by cap / weight, the common level is the largest of (words left) / (weights left), so no loop
is needed.  A document is then emitted floor(rate) times, plus once more if a number made from its source's seed
and its id falls below the fraction; no state and no order is involved, so reruns agree.

Defined results: a null text has no words; null is a source like any other; a source without words has the
target 0, and its documents are emitted once, adding no words; rows that repeat an id get the same number of
copies; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.tables import WORD, free_name, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"
#: Seeds that every source tries.
DRAWS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size, weight, target`` from rows of ``source, size``.

    One row per source is left when the windows over all sources run; they order sources, not documents.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    everything = Window.partitionBy()
    filled = Window.orderBy((F.lit(repeats) * F.col("source_size") / F.col("weight")).asc(), "rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.lit(repeats) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left.cast("double") / F.sum("weight").over(after)
    cap = (F.lit(repeats) * F.col("source_size")).cast("double")
    return (
        sums.withColumn("rank", rank)
        .withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("level", level)
        .withColumn("target", F.least(cap, F.max("level").over(everything) * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def chance(identity: Column, seed: Column) -> Column:
    """A number in [0, 1) with 52 random bits, made from the seed and an id."""
    digits = F.md5(F.concat(seed, F.lit(":"), F.coalesce(identity.cast("string"), F.lit(""))))
    return F.conv(F.substring(digits, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def _copies(identity: Column, rate: Column, seed: Column) -> Column:
    """floor(rate), plus one with the probability of the fraction."""
    whole = F.floor(rate)
    return (whole + F.when(chance(identity, seed) < rate - whole, 1).otherwise(0)).cast("int")


def source_plan(sizes: DataFrame, seed: str = SEED, weights=WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size, target, rate, seed`` from rows of ``doc_id, source, size``.

    Draws of few or very unequal documents scatter widely, so each source tries ``DRAWS`` seeds, all in one sum
    per source, and takes the one whose words come nearest to its target, the first on a tie.
    """
    targets = written(source_targets(sizes.select("source", "size"), weights, repeats), "targets").withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0))
    named = [F.lit(f"{seed}:{k}") for k in range(DRAWS)]
    drawn = sizes.join(targets.select(F.col("source").alias("_source"), "rate"), F.col("source").eqNullSafe(F.col("_source"))).groupBy(
        "source").agg(*[F.sum(F.col("size") * _copies(F.col("doc_id"), F.col("rate"), name)).alias(f"d{k}") for k, name in enumerate(named)])
    away = F.array_min(F.array(*[F.struct(F.abs(F.col(f"d{k}") - F.col("target")).alias("away"), F.lit(k).alias("k")) for k in range(DRAWS)]))
    chosen = targets.join(drawn.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    return written(chosen.select(
        "source", "source_size", "target", "rate", F.concat(F.lit(seed + ":"), away["k"].cast("string")).alias("seed")), "sources")


def _sizes(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")


def plan(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``."""
    sizes = _sizes(docs)
    sources = source_plan(sizes, seed, weights, repeats).withColumnRenamed("source", "_source")
    return (
        sizes.join(sources, F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "source", "size", "source_size", "target",
                _copies(F.col("doc_id"), F.col("rate"), F.col("seed")).alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def emit(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    source, rate, name = (free_name(docs, n) for n in ("mix_source", "mix_rate", "mix_seed"))
    sources = source_plan(_sizes(docs), seed, weights, repeats).select(
        F.col("source").alias(source), F.col("rate").alias(rate), F.col("seed").alias(name))
    copies = _copies(F.col("doc_id"), F.col(rate), F.col(name))
    return (
        docs.join(sources, F.col("source").eqNullSafe(F.col(source))).filter(copies > 0)
        .withColumn(rate, F.explode(F.sequence(F.lit(1), copies)))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
