"""Substring de-duplication with difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document; a word goes if a window that covers it also starts
in a document with a smaller id.  Two equal windows at word positions i and j: for the difference cover
``COVER`` modulo ``PERIOD`` there is a shift below ``PERIOD`` that takes both i and j to cover positions.  The
``ANCHOR = WINDOW - PERIOD + 1`` words from there lie inside both windows, so hashing anchors at cover
positions alone (6 of 31) finds every match.

1. Anchors are hashed at cover positions and counted, map-side first; those that occur once are done with.
2. Whole texts that are copies of one with a smaller id are set aside: all their windows occur there.
3. Anchors that occur again are extended: each possible window around one is hashed to 128 bits, and the
   smallest id per window is found, map-side first.  No pairs are made; a hot passage is one row per task in
   the count and is split by Spark in the join back.
4. Windows that start in a smaller id mark their words; the rest of the text is kept.

Equality of windows rests on 128 hash bits.  Words are separated by ASCII white space and compared unchanged.

Defined results: a null or empty text has no words and the hash of the empty string; rows that repeat an id
are judged each, and never against rows of the same id; rows with a null id come after every other id and
are never compared with each other; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType

from tracewell.llm import words
from tracewell.llm.tables import discard, free_name, kind, settings, written, written_at

WINDOW = 50
PERIOD = 31
#: Every difference modulo 31 is a difference of two of these (a perfect difference set).
COVER = (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1
NO_ID = (1 << 63) - 1
#: Let Spark filter texts by the ids of the places, from this size of the texts and up to that of the places.
FILTERED_JOIN = {
    "spark__sql__optimizer__runtime__bloomFilter__enabled": "true",
    "spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "16MB",
    "spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold": "1GB",
}

INTS, LONGS = ArrayType(IntegerType()), ArrayType(LongType())
KEPT = kind(n_removed=LongType(), kept=StringType())
_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True


def _lists(values: list[np.ndarray], of: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, of))


def kept_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> bytes:
    """The kept words of one text, joined by single spaces."""
    raw = data.tobytes()
    pairs = zip(starts.tolist(), ends.tolist()) if keep is None else zip(starts[keep].tolist(), ends[keep].tolist())
    return b" ".join([raw[a:b] for a, b in pairs])


def cover_positions(count: int) -> np.ndarray:
    """The cover positions at which an anchor fits into ``count`` words."""
    return np.flatnonzero(_IN_COVER[np.arange(max(count - ANCHOR + 1, 0)) % PERIOD])


@arrow_udf(kind(n_words=LongType(), words_sha256=StringType(), anchors=LONGS))
def _anchors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        counts, digests, found = [], [], []
        for _, data, offsets in words.pieces(texts):
            starts, ends, first = words.spans(data, offsets)
            hashed = words.windows(words.hashes(data, starts, ends), ANCHOR)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                counts.append(b - a)
                digests.append(hashlib.sha256(kept_words(data[starts[a]:ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a])
                                              if b > a else b"").hexdigest())
                found.append(hashed[a + cover_positions(b - a)].view(np.int64))
        yield pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), _lists(found, pa.int64())],
            ["n_words", "words_sha256", "anchors"])


@arrow_udf(BinaryType())
def _packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts compressed for the way through the shuffle."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for texts in batches:
        yield pa.array([pack(t.encode()) for t in texts.to_pylist()], pa.binary())


def _unpacked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Packed texts as texts, in runs of about ``words.BATCH_BYTES``."""
    unpack = zstandard.ZstdDecompressor().decompress
    for packed, lists in batches:
        texts, first, size = [], 0, 0
        for row, one in enumerate(packed.to_pylist()):
            texts.append(unpack(one).decode())
            size += len(texts[-1])
            if size >= words.BATCH_BYTES or row == len(packed) - 1:
                yield pa.array(texts, pa.large_string()), lists.slice(first, len(texts))
                texts, first, size = [], row + 1, 0


def _covered(places: np.ndarray, before: int, after: int, count: int) -> np.ndarray:
    """Which of ``count`` positions lie in [place - before, place + after] of some place."""
    change = np.bincount(np.clip(places - before, 0, count), minlength=count + 1)
    change -= np.bincount(np.clip(places + after + 1, 0, count), minlength=count + 1)
    return np.cumsum(change[:-1]) > 0


def _texts_with(batches, work) -> Iterator[list]:
    """``work(data, starts, ends, places)`` of each packed text and its list of positions, batch by batch."""
    for packed, lists in batches:
        out = []
        for texts, some in _unpacked([(packed, lists)]):
            some = some.to_pylist()
            for row, data, offsets in words.pieces(texts):
                starts, ends, first = words.spans(data, offsets)
                for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    out.append(work(data, starts[a:b], ends[a:b], np.array(some[row + k] or [], np.int64)))
        yield out


def _possible_windows(data, starts, ends, numbers):
    """Windows around shared anchors, which are named by their number among the cover positions."""
    count = max(len(starts) - WINDOW + 1, 0)
    if not count or not len(numbers):
        return [np.empty(0, np.int64)] * 3
    places = cover_positions(len(starts))
    at = np.flatnonzero(_covered(places[numbers[numbers < len(places)]], PERIOD - 1, 0, count))
    return [at] + [words.windows(words.hashes(data, starts, ends, which), WINDOW, which)[at].view(np.int64) for which in (0, 1)]


@arrow_udf(kind(at=INTS, high=LONGS, low=LONGS))
def _windows(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for rows in _texts_with(batches, _possible_windows):
        yield pa.StructArray.from_arrays(
            [_lists([r[0].astype(np.int32) for r in rows], pa.int32()), _lists([r[1] for r in rows], pa.int64()),
             _lists([r[2] for r in rows], pa.int64())], ["at", "high", "low"])


def _kept(data, starts, ends, places):
    gone = _covered(places, 0, WINDOW - 1, len(starts))
    return int(gone.sum()), kept_words(data, starts, ends, ~gone)


def _kept_rows(batches, last) -> Iterator[pa.Array]:
    for rows in _texts_with(batches, _kept):
        yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([last(r[1]) for r in rows], pa.string())],
                                         ["n_removed", "kept"])


@arrow_udf(KEPT)
def _kept_text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    yield from _kept_rows(batches, lambda kept: kept.decode())


@arrow_udf(KEPT)
def _kept_digest(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    yield from _kept_rows(batches, lambda kept: hashlib.sha256(kept).hexdigest())


def _keyed(docs: DataFrame) -> DataFrame:
    """``order, row, text``: the id to compare by, and a key of the row (rows that repeat id and text share it)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("order"), F.xxhash64("doc_id", text).alias("row"),
                       "doc_id", text.alias("text"))


def _found(docs: DataFrame, kept_udf) -> tuple[DataFrame, DataFrame]:
    """A row for every input row, and ``order, row, n_removed, kept`` for those that lose words to extended anchors."""
    texts = _keyed(docs)
    scanned, folder = written_at(
        texts.select("doc_id", "order", "row", F.sha2("text", 256).alias("digest"), _anchors("text").alias("a"))
        .select("doc_id", "order", "row", "digest", "a.*"), "anchors")
    first = scanned.groupBy("digest").agg(F.min("order").alias("earliest"))
    copy = (F.col("order") > F.col("earliest")) & (F.col("n_words") >= WINDOW)
    rows = written(scanned.drop("anchors").join(first, "digest").select(
        "doc_id", "order", "row", "n_words", "words_sha256", copy.alias("copy")), "rows")
    copies = written(rows.groupBy("order").agg(F.min("copy").alias("copy")).filter("copy").select("order"), "copies")

    anchors = scanned.select("order", "anchors").join(copies, "order", "left_anti").select(
        "order", F.posexplode("anchors").alias("number", "anchor"))
    # what is counted is written before it is joined back: both sides of the join are then plain exchanges, and
    # Spark splits a hot key
    shared = written(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "shared")
    # rows that repeat an id share their places: more windows are looked at, and judged by their own words
    places = written(anchors.join(shared, "anchor").groupBy("order").agg(F.collect_set("number").alias("places")), "places")
    discard(folder)

    # Texts move once, here.  Spark drops most of those without shared anchors before the exchange, by a Bloom filter
    # of bounded size over the ids of the places; what it lets through is dropped by the join.
    with settings(docs.sparkSession, **FILTERED_JOIN):
        near = written(texts.select("order", "row", _packed("text").alias("text"))
                       .join(places.filter(F.size("places") > 0), "order")
                       .select("order", "row", "text", _windows("text", "places").alias("w")), "windows")
    each = near.select("order", "row", F.explode(F.arrays_zip("w.at", "w.high", "w.low")).alias("x")).select(
        "order", "row", F.col("x.at").alias("at"), F.col("x.high").alias("high"), F.col("x.low").alias("low"))
    least = written(each.groupBy("high", "low").agg(F.min("order").alias("a"), F.max("order").alias("b")).filter("a < b").select(
        "high", "low", "a"), "least")
    repeats = each.join(least, ["high", "low"]).filter(F.col("order") > F.col("a")).groupBy("order", "row").agg(
        F.collect_set("at").alias("places"))
    lost = (
        near.select("order", "row", "text").join(repeats, ["order", "row"])
        .select("order", "row", kept_udf("text", "places").alias("k")).select("order", "row", "k.*")
        .dropDuplicates(["order", "row"])
    )
    return rows, lost


def removals(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256``."""
    rows, lost = _found(docs, _kept_digest)
    none = hashlib.sha256(b"").hexdigest()
    return rows.join(lost, ["order", "row"], "left").select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("copy"), F.lit(none)).otherwise(F.coalesce("kept", "words_sha256")).alias("kept_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs``; a text that loses words becomes its kept words joined by single spaces."""
    rows, lost = _found(docs, _kept_text)
    changed = rows.join(lost, ["order", "row"], "left").filter(F.col("copy") | F.col("kept").isNotNull()).select(
        "order", "row", F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept")).dropDuplicates(["order", "row"])
    order, row, kept = (free_name(docs, n) for n in ("dedup_order", "dedup_row", "dedup_kept"))
    keyed = docs.withColumns({order: F.coalesce("doc_id", F.lit(NO_ID)), row: F.xxhash64("doc_id", F.coalesce("text", F.lit("")))})
    return keyed.join(changed.toDF(order, row, kept), [order, row], "left").withColumn(
        "text", F.coalesce(kept, "text")).select(*[F.col(f"`{c}`") for c in docs.columns])
