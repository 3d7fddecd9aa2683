"""Rows of conversations in order, cut into blocks of bounded size, so that one conversation may be of any length.

Rows are dealt by ranges of (conversation, turn, role), so a conversation of very many rows is spread over several
tasks.  A task walks over its sorted rows and cuts them into blocks.  A block is ``whole`` if it surely holds all rows of
its conversation; the others are put together afterwards, in order of (``part``, ``block``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A block ends after so many rows, or with the row that brings its characters to the second number.
ROWS, CHARS = 1024, 1 << 20
_NONE = object()


def dealt(rows: DataFrame, *ties: str) -> DataFrame:
    """Rows in order of ``conv_id, turn, role`` and then of ``ties``, nulls first."""
    return rows.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", *ties)


def in_order(blocks: DataFrame) -> DataFrame:
    """The blocks of every conversation in order, each conversation in one task, one block at a time."""
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def cut(rows: Iterator[dict], size) -> Iterator[tuple[object, int, bool, list[dict]]]:
    """``conv_id, number of the block, whole, rows`` of every block; ``size`` gives a row's characters.

    Numbers run through all blocks of a task.
    """
    key, held, chars, number, begun, opened = _NONE, [], 0, 0, 0, 0
    for row in rows:
        new = key is _NONE or row["conv_id"] != key
        if held and (new or len(held) >= ROWS or chars >= CHARS):
            yield key, number, new and number == begun and opened > 1, held
            number, held, chars = number + 1, [], 0
        if new:
            key, begun, opened = row["conv_id"], number, opened + 1
        held.append(row)
        chars += size(row)
    if held:
        yield key, number, False, held


def grouped(rows: Iterator[dict]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Runs of rows of one conversation, one row at a time; a run must be used up before the next."""
    waiting: list[dict] = []

    def run(key) -> Iterator[dict]:
        yield waiting.pop()
        for row in rows:
            if row["conv_id"] != key:
                waiting.append(row)
                return
            yield row

    first = next(rows, None)
    if first is not None:
        waiting.append(first)
    while waiting:
        key = waiting[0]["conv_id"]
        yield key, run(key)
