"""Saved analyses: append, list, read, delete, and activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ranking import ordinals
from tracewell.session import cut

HISTORY = (
    "analysis_id string, user_id string, input_type string, original_input string, extracted_claim string, "
    "trace_status string, confidence double, record_id string, created_at timestamp"
)


def saveable(analyses: DataFrame) -> DataFrame:
    """Analyses somebody owns; anonymous ones are never stored, image bytes neither."""
    return analyses.filter(F.col("user_id").isNotNull()).drop("content")


def append_history(analyses: DataFrame, path: str) -> None:
    """Append owned analyses, partitioned by day so that reads prune."""
    saveable(analyses).withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def list_history(history: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Every user's analyses, newest first, numbered.  A very active user is numbered by day."""
    day = F.to_date("created_at") if bucket is None else bucket
    return ordinals(
        history, ["user_id"], [F.desc("created_at"), F.desc("analysis_id")], [-F.unix_date(day)], "position")


def owned(history: DataFrame, requests: DataFrame) -> DataFrame:
    """Analyses asked for by their owners; other people's look absent."""
    return history.join(requests.select("user_id", "analysis_id"), ["user_id", "analysis_id"], "left_semi")


def without_owned(history: DataFrame, requests: DataFrame) -> DataFrame:
    """History after owner-scoped deletes."""
    return history.join(requests.select("user_id", "analysis_id"), ["user_id", "analysis_id"], "left_anti")


def activity(events: DataFrame) -> DataFrame:
    """First and last time a user was seen."""
    return events.groupBy("user_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("requests"))


def outcome_counts(analyses: DataFrame) -> DataFrame:
    """Counts by status, strategy and band with their roll-ups (allow-listed columns only)."""
    return analyses.rollup("trace_status", "strategy", "band").agg(F.count(F.lit(1)).alias("analyses"))


def latest_per_user(history: DataFrame) -> DataFrame:
    return history.groupBy("user_id").agg(F.max_by("analysis_id", F.struct("created_at", "analysis_id")).alias("analysis_id"))


def _successors(times: DataFrame, width: int) -> DataFrame:
    """``k, us, to``: of every time the first one of its key that is at least ``width`` later, if there is any.

    That one lies in the time slot (as wide as the window) behind the time's own, or is the first of a later slot.
    Both are running minima: over one slot's times, and over a key's slots.
    """
    slot = F.floor(F.col("us") / F.lit(width)).cast("bigint")
    given = times.select("k", slot.alias("slot"), F.col("us").alias("at"), F.lit(None).cast("bigint").alias("us"))
    asked = times.select("k", (slot + 1).alias("slot"), (F.col("us") + width).alias("at"), "us")
    both = given.union(asked)
    time = F.when(F.col("us").isNull(), F.col("at"))
    backwards = Window.partitionBy("k", "slot").orderBy(F.desc("at"), F.col("us").isNotNull())
    near = both.withColumn("near", F.min(time).over(backwards.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("us").isNotNull())
    later = Window.partitionBy("k").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    far = both.groupBy("k", "slot").agg(F.min(time).alias("low")).withColumn("far", F.min("low").over(later)).select(
        F.col("k").alias("fk"), F.col("slot").alias("fs"), "far")
    return near.join(far, F.col("k").eqNullSafe(F.col("fk")) & (F.col("slot") == F.col("fs"))).select(
        "k", "us", F.coalesce("near", "far").alias("to")).filter(F.col("to").isNotNull())


def window_starts(times: DataFrame, width: int) -> DataFrame:
    """``k, us``: the times at which a key's windows open, of distinct ``k, us`` (a key and microseconds).

    A window opens at the key's first time, and then at the first one at least ``width`` after the last opening.
    Every time points to its successor, the one that opens the next window if it opens one itself.  Times after a pause as
    long as the window open one whatever came before; from there the pointers are followed 1, 2, 4, ... steps at once, so the
    number of rounds is the logarithm of the longest run of windows without a pause.
    """
    times = cut(times)
    slots = times.groupBy("k", F.floor(F.col("us") / F.lit(width)).alias("slot")).agg(F.min("us").alias("us"), F.max("us").alias("last"))
    before = F.lag("last").over(Window.partitionBy("k").orderBy("slot"))
    roots = cut(slots.withColumn("before", before).filter(F.coalesce(F.col("us") - F.col("before") >= width, F.lit(True))).select("k", "us"))
    ends = roots.select(F.col("k").alias("ek"), F.col("us").alias("eu"))
    jumps = cut(_successors(times, width).join(ends, F.col("k").eqNullSafe(F.col("ek")) & (F.col("to") == F.col("eu")), "left_anti"))
    starts = roots
    while True:
        ahead = jumps.select(F.col("k").alias("jk"), F.col("us").alias("ju"), F.col("to").alias("next"))
        new = cut(starts.join(ahead, F.col("k").eqNullSafe(F.col("jk")) & (F.col("us") == F.col("ju"))).select("k", F.col("next").alias("us")))
        if new.isEmpty():
            return starts
        starts = cut(starts.union(new))
        jumps = cut(jumps.join(ahead, F.col("k").eqNullSafe(F.col("jk")) & (F.col("to") == F.col("ju"))).select("k", "us", F.col("next").alias("to")))


def limited_requests(events: DataFrame, window_seconds: int = 60, limit: int = 60) -> DataFrame:
    """Admit or reject requests with a window that opens at a key's first request.

    The openings are found by pointer doubling (``window_starts``); in a time slot as wide as the window there is one at
    most, so a request's window is looked up by its slot and the one before.  Requests are numbered inside their window.
    No task needs more of a key than one window.

    ``events(key, ts, event_id)``; result adds ``allowed`` and ``retry_after``.
    """
    width = window_seconds * 1_000_000
    slot = lambda us: F.floor(us / F.lit(width)).cast("bigint")
    rows = events.select("key", "event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("us", F.unix_micros("ts"))
    starts = window_starts(rows.select(F.col("key").alias("k"), "us").distinct(), width)
    # an opening counts for its own slot, and for the next one until that has an opening of its own or before it
    opened = starts.select("k", F.explode(F.array(slot(F.col("us")), slot(F.col("us")) + 1)).alias("slot"), "us").groupBy("k", "slot").agg(
        F.array_sort(F.collect_list("us")).alias("openings"))
    placed = rows.withColumn("at", slot(F.col("us"))).join(opened, F.col("key").eqNullSafe(F.col("k")) & (F.col("at") == F.col("slot"))).withColumn(
        "opened", F.array_max(F.filter("openings", lambda o: o <= F.col("us"))))
    number = F.row_number().over(Window.partitionBy("key", "opened").orderBy("us", "event_id"))
    wait = F.ceil((F.col("opened") + width - F.col("us")) / F.lit(1_000_000)).cast("bigint")
    return placed.withColumn("n", number).select(
        "key", "event_id", "ts", (F.col("n") <= limit).alias("allowed"), F.when(F.col("n") <= limit, F.lit(0).cast("bigint")).otherwise(wait).alias("retry_after"))
