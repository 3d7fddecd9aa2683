"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled together up to this many bytes; a longer text is handled alone.
BATCH_BYTES = 4 << 20
#: Bytes whose hash terms are held at once.
STEP_BYTES = 1 << 20

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229)
_BYTE_VALUES = _RANDOM.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_WINDOW_BASES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; every other byte unchanged."""
    return _LOWER[data]


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` for runs of rows of at most ``BATCH_BYTES``; null is empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + BATCH_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACES):
    """Starts and ends of all words, and for each text the number of its first word.

    A word never reaches over the border between two texts.
    """
    inside = ~separators[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    borders = offsets[:-1][offsets[:-1] < offsets[1:]]  # first bytes of texts that have any
    begins[borders] = inside[borders]
    borders = borders[borders > 0] - 1
    stops[borders] = inside[borders]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x7FB5D329728EA185)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def powers(base: np.uint64, count: int) -> np.ndarray:
    """base**0 .. base**(count-1) modulo 2**64."""
    out = np.full(max(count, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; ``which`` (0 or 1) chooses one of two independent functions."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    lengths = ends - starts
    table = powers(_BASES[which], int(lengths.max()))
    done = 0
    while done < len(starts):
        stop = max(int(np.searchsorted(ends, starts[done] + STEP_BYTES, "right")), done + 1)
        size = lengths[done:stop]
        at = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(at, size)
        terms = _BYTE_VALUES[which][data[np.repeat(starts[done:stop], size) + within]] * table[within]
        out[done:stop] = mix(np.add.reduceat(terms, at) + size.astype(np.uint64))
        done = stop
    return out


def windows(values: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """The hash of every ``width`` consecutive values, by doubling; windows are at all starts."""
    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total, covered, block, size, base = np.zeros(len(values), np.uint64), 0, values, 1, _WINDOW_BASES[which]
    shift = np.array([base])  # an array: it wraps around without a warning
    while True:
        if width & size:
            # what is covered so far stands before the block: multiply the block by base**covered
            length = len(values) - covered - size + 1
            total = total[:length] + block[covered:covered + length] * powers(base, covered + 1)[covered]
            covered += size
        if covered == width:
            return mix(total[:count])
        block = block[:len(block) - size] + block[size:] * shift
        shift = shift * shift
        size *= 2
