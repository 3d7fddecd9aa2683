"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items become lower-case words (runs of ASCII letters, digits and bytes above 127).  An item of n
words may differ in ``budget = floor(ERRORS * n)`` words: replaced, missing or added ones.  Cut into budget+1
pieces, at least one piece stands unchanged in any such copy.  Pieces are found by rolling hashes, one pass per
piece length; each hit names a stretch of the text, where Myers' bit-parallel algorithm finds the smallest
distance of the whole item to any part of it.  A hit within the budget is a match.

Test items are a stated query set: they go to the tasks in blocks of at most ``BLOCK_WORDS`` words, one job over the
documents for each block, whose result is written before the next block is read; driver and tasks hold one block at a
time.  Documents are never shuffled, and a text is handled by itself.

Defined results: null or empty texts and items match nothing; equal items all match; an item of fewer words than
1 / ERRORS has no budget and must occur exactly; rows that repeat an id are judged each; an empty table on
either side gives no match; other columns pass through where documents are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tracewell.llm import words
from tracewell.llm.tables import free_name, written

#: Share of an item's words that may differ (similarity 0.8).
ERRORS = 0.2
#: Words of test items that one pass carries; a longer item is a block of its own.
BLOCK_WORDS = 1_000_000
MATCHES = "array<struct<item_id:bigint,distance:int,first_word:bigint,last_word:bigint>>"

_BREAKS = np.ones(256, bool)
_BREAKS[48:58] = _BREAKS[65:91] = _BREAKS[97:123] = _BREAKS[128:] = False


def tokens(data: np.ndarray, offsets: np.ndarray):
    """A hash of each word of each text, and the number of each text's first word."""
    starts, ends, first = words.spans(data, offsets, _BREAKS)
    return words.hashes(words.lower_ascii(data), starts, ends), first


def budget(count: int, errors: float = ERRORS) -> int:
    return int(count * errors + 1e-9)


def myers(item: list[int], text: list[int]) -> tuple[int, int]:
    """The smallest edit distance of ``item`` to any part of ``text``, and where the first such part ends.

    One bit of a whole number stands for one word of the item; each word of the text is a few operations.
    """
    size = len(item)
    full, high = (1 << size) - 1, 1 << (size - 1)
    peq: dict[int, int] = {}
    for i, word in enumerate(item):
        peq[word] = peq.get(word, 0) | 1 << i
    plus, minus, score = full, 0, size
    best, end = size, 0
    for at, word in enumerate(text):
        eq = peq.get(word, 0)
        across = ((eq & plus) + plus ^ plus) | eq | minus
        up, down = minus | ~(across | plus) & full, plus & across
        score += 1 if up & high else -1 if down & high else 0
        up, down = up << 1, down << 1
        sideways = eq | minus
        plus, minus = (down | ~(sideways | up)) & full, up & sideways
        if score < best:
            best, end = score, at + 1
    return best, end


class Items:
    """The pieces of a block of test items, by length, with their items and places."""

    def __init__(self, rows: list[tuple[int, str]], errors: float = ERRORS):
        self.items: list[tuple[int, list[int], int]] = []
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for number, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            hashed, _ = tokens(raw, np.array([0, len(raw)]))
            if not len(hashed):
                continue
            allowed = budget(len(hashed), errors)
            cuts = [len(hashed) * k // (allowed + 1) for k in range(allowed + 2)]
            for a, b in zip(cuts, cuts[1:]):
                key = int(words.windows(hashed[a:b], b - a)[0])
                found.setdefault(b - a, {}).setdefault(key, []).append((len(self.items), a))
            self.items.append((number, hashed.tolist(), allowed))
        self.pieces = {size: (np.array(sorted(by), np.uint64), by) for size, by in found.items()}

    def matches(self, hashed: np.ndarray, first: np.ndarray) -> list[list[dict]]:
        """The matches of each text, from the hashes of its words."""
        places: dict[tuple[int, int], set[int]] = {}
        for size, (keys, by) in self.pieces.items():
            rolling = words.windows(hashed, size)
            if not len(rolling):
                continue
            hits = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, rolling), len(keys) - 1)] == rolling)
            texts = np.searchsorted(first, hits, "right") - 1
            inside = hits + size <= first[texts + 1]
            for at, text in zip(hits[inside].tolist(), texts[inside].tolist()):
                for item, offset in by[int(rolling[at])]:
                    places.setdefault((text, item), set()).add(at - offset)
        out: list[list[dict]] = [[] for _ in range(len(first) - 1)]
        for (text, item), begins in sorted(places.items()):
            number, pattern, allowed = self.items[item]
            a, b = int(first[text]), int(first[text + 1])
            best = None
            for low, high in _stretches(sorted(begins), len(pattern), allowed):
                low, high = max(low, a), min(high, b)
                distance, end = myers(pattern, hashed[low:high].tolist())
                if distance <= allowed and (best is None or distance < best[0]):
                    back, length = myers(pattern[::-1], hashed[low:low + end][::-1].tolist())
                    best = (distance, low + end - length - a, low + end - 1 - a)
            if best:
                out[text].append({"item_id": number, "distance": best[0], "first_word": best[1], "last_word": best[2]})
        return out


def _stretches(begins: list[int], size: int, allowed: int) -> Iterator[tuple[int, int]]:
    """Stretches of the text around the possible beginnings of an item, joined where they overlap.

    A joined stretch is cut at ``16 * size`` words; the next one begins early enough to hold whole copies.
    """
    low = high = None
    for begin in begins:
        if low is not None and begin - allowed <= high and high - low < 16 * size:
            high = begin + size + allowed
            continue
        if low is not None:
            yield low, high
        low, high = begin - allowed, begin + size + allowed
    if low is not None:
        yield low, high


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of at most ``BLOCK_WORDS`` words, in the order of their ids."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select("item_id", "text").filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        count = len(row["text"].split())
        if block and size + count > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += count
    if block:
        yield block


def _matcher(shared, errors: float):
    @arrow_udf(MATCHES)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(shared.value, errors)
        for texts in batches:
            out: list[list[dict]] = []
            for _, data, offsets in words.pieces(texts):
                out += items.matches(*tokens(data, offsets))
            yield pa.array(out, pa.list_(pa.struct(
                [("item_id", pa.int64()), ("distance", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())])))

    return match


def _jobs(benchmark: DataFrame, errors: float) -> Iterator[tuple[Column, bool]]:
    """For each block of test items the matches of a document's text, and whether another block follows.

    What is made of a column must be written before the next one is asked for, which frees the block.
    """
    context = benchmark.sparkSession.sparkContext
    blocks = _blocks(benchmark)
    block = next(blocks, None)
    while block is not None:
        shared = context.broadcast(block)
        block = next(blocks, None)
        yield _matcher(shared, errors)(F.coalesce("text", F.lit(""))), block is not None
        if block is not None:
            shared.destroy()


def contaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """``doc_id, item_id, distance, first_word, last_word`` for every document and test item found in it."""
    found = None
    for matches, more in _jobs(benchmark, errors):
        rows = docs.select("doc_id", matches.alias("found")).select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")
        rows = written(rows, "matches") if more else rows
        found = rows if found is None else found.union(rows)
    if found is None:  # no test item
        return docs.select("doc_id", F.explode(F.array().cast(MATCHES)).alias("m")).select("doc_id", "m.*")
    return found


def clean(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The rows and columns of ``docs`` in which no test item is found; each block judges what the others kept."""
    name = free_name(docs, "found_items")
    for matches, more in _jobs(benchmark, errors):
        kept = docs.withColumn(name, matches).filter(F.size(name) == 0).drop(name)
        docs = written(kept, "clean") if more else kept
    return docs
