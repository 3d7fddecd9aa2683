"""Streams: limiter, activity, and claims matched as they arrive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.functions.text import extract_claim
from tracewell.operators import index, matching
from tracewell.session import new_folder, table


def activity_stream(events: DataFrame) -> DataFrame:
    """First and last sighting per user; run it in update mode."""
    return events.groupBy("user_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("requests"))


class Limiter(StatefulProcessor):
    """A window that opens at a key's first request; two numbers of state per key."""

    def __init__(self, window_seconds: int, limit: int):
        self.width, self.limit = window_seconds * 1_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "opened bigint, used int")

    def handleInputRows(self, key, rows, timer_values):
        opened, used = self.window.get() if self.window.exists() else (None, 0)
        events = pd.concat(list(rows)).sort_values(["us", "event_id"])  # one key's share of a micro-batch
        allowed, retry = [], []
        for now in events["us"]:
            if opened is None or now >= opened + self.width:
                opened, used = int(now), 0
            ok = used < self.limit
            used += int(ok)
            allowed.append(ok)
            retry.append(0 if ok else -(-(opened + self.width - int(now)) // 1_000_000))
        self.window.update((opened, used))
        yield pd.DataFrame({
            "key": key[0], "event_id": events["event_id"].to_numpy(), "allowed": allowed, "retry_after": retry})

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, window_seconds: int = 60, limit: int = 60) -> DataFrame:
    """Admit or reject a stream of ``(key, ts, event_id)``; needs the RocksDB state store."""
    rows = events.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    key_type = events.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Limiter(window_seconds, limit),
        outputStructType=f"key {key_type}, event_id bigint, allowed boolean, retry_after bigint",
        outputMode="Append", timeMode="None")


def match_stream(claims: DataFrame, records: DataFrame, target: str, checkpoint: str, library: str):
    """Match arriving ``(claim_id, claim)`` rows to a static library and append them to a table.

    ``library`` is the folder of one version of the library's index: the first run writes it, every micro-batch and
    every later run only reads it.  Each micro-batch is an ordinary batch job; the batch number is a partition that
    a repeated batch overwrites, so a restart after a lost driver leaves no duplicates.
    """
    known = index.kept_index(records, library)

    def append(batch: DataFrame, number: int) -> None:
        best = index.best_records(batch, known, 2)  # the record and its runner-up
        matching.deterministic_matches(batch, best).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        claims.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def match_conversations(spark: SparkSession, directory: str) -> DataFrame:
    """Conversation turns as a file stream, worked off once; the result is the written table."""
    folder = new_folder(spark, "claims")
    turns = table(spark, directory, "conversations")
    # a glob: the table may be one file or a folder of files, and a stream takes a plain path for a folder
    stream = spark.readStream.schema(turns.schema).parquet(f"{directory}/conversations.parque[t]")
    claims = stream.select(F.concat_ws("-", "conv_id", "turn").alias("claim_id"), extract_claim(F.col("text")).alias("claim"))
    records = table(spark, directory, "benchmark").select(
        F.col("item_id").alias("record_id"), F.col("text").alias("canonical_claim"),
        F.array().cast("array<string>").alias("aliases"))
    match_stream(claims, records, f"{folder}/table", f"{folder}/checkpoint", f"{folder}/library").awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("claim_id", "record_id", "confidence", "strategy")
