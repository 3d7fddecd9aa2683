"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes ``FEATURES`` numbers about its characters, words, lines and repetition, computed once per document
over the whole text.  The model is a sum of lookup tables: one per feature over its bins, and one per chosen pair of
features.  They are learned by cyclic boosting: in each round every feature in turn gets a tree of at most four
leaves fitted to the current gradient, added with a small rate; pairs are then ranked by how much a four-quadrant
split would gain and boosted the same way.  Scoring a document is a few binary searches and additions.

The model is fitted on a sample of labelled rows: at most about ``MOST_ROWS``, chosen by a hash of the id at the
rate that the count of labelled rows asks for.  Only their numbers come to the driver, never texts.

Defined results: a null or empty text has the numbers of a text without words; rows without a label teach nothing;
without any label, or with one class only, the score is the smoothed share of label 1 (one half if there is
none); rows that repeat an id are scored each; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

from tracewell.llm import words
from tracewell.llm.tables import crc, written

FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "digits", "capitals", "stops", "symbols", "line_ends",
    "bare_words", "short_words", "same_as_before", "distinct_words", "distinct_pairs", "commonest_word", "distinct_lines", "line_words",
)
#: Labelled rows of the sample, and what the boosting may use.
MOST_ROWS = 20_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE, COARSE = 48, 120, 60, 6, 0.15, 4.0, 12

_CLASSES = {name: np.zeros(256, np.uint8) for name in ("letters", "digits", "capitals", "stops", "line_ends", "spaces")}
_CLASSES["letters"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASSES["digits"][48:58] = 1
_CLASSES["capitals"][65:91] = 1
_CLASSES["stops"][[ord(c) for c in ".,;:?'\"()-"]] = 1
_CLASSES["line_ends"][10] = 1
_CLASSES["spaces"][[9, 10, 11, 12, 13, 32]] = 1
_LINES = np.zeros(256, bool)
_LINES[[10, 13]] = True


def _per_text(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive borders; an empty stretch sums to 0."""
    out = np.zeros(len(borders) - 1)
    some = borders[:-1] < borders[1:]
    if some.any():
        out[some] = np.add.reduceat(values, borders[:-1][some], dtype=np.int64)
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The numbers of every text, one row each, in the order of ``FEATURES``."""
    size = np.diff(offsets).astype(float)
    counts = {name: _per_text(table[data], offsets) for name, table in _CLASSES.items()}
    starts, ends, first = words.spans(data, offsets)
    hashed = words.hashes(data, starts, ends)
    lengths = ends - starts
    n = np.diff(first).astype(float)
    letter_sum = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CLASSES["letters"][data], out=letter_sum[1:])
    bare = (letter_sum[ends] == letter_sum[starts]).astype(np.int64)
    same = np.zeros(len(hashed), np.int64)
    same[1:] = hashed[1:] == hashed[:-1]
    same[first[:-1][first[:-1] < first[1:]]] = 0
    pairs = words.windows(hashed, 2)
    line_starts, line_ends, line_first = words.spans(data, offsets, _LINES)
    lines = words.hashes(data, line_starts, line_ends)
    distinct, distinct_pairs, commonest, distinct_lines = (np.ones(len(n)) for _ in range(4))
    for k, (a, b, c, d) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), line_first[:-1].tolist(), line_first[1:].tolist())):
        if b > a:
            uses = np.unique(hashed[a:b], return_counts=True)[1]
            distinct[k], commonest[k] = len(uses) / (b - a), uses.max() / (b - a)
        if b > a + 1:
            distinct_pairs[k] = len(np.unique(pairs[a:b - 1])) / (b - a - 1)
        if d > c:
            distinct_lines[k] = len(np.unique(lines[c:d])) / (d - c)
    known = counts["letters"] + counts["digits"] + counts["stops"] + counts["spaces"]
    some, bytes_ = np.maximum(n, 1), np.maximum(size, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(n), _per_text(lengths, first) / some, counts["letters"] / bytes_, counts["digits"] / bytes_,
        counts["capitals"] / bytes_, counts["stops"] / bytes_, (size - known) / bytes_, counts["line_ends"] / bytes_,
        _per_text(bare, first) / some, _per_text((lengths <= 3).astype(np.int64), first) / some, _per_text(same, first) / some,
        distinct, distinct_pairs, commonest, distinct_lines, n / np.maximum(np.diff(line_first), 1),
    ])


@arrow_udf(ArrayType(DoubleType()))
def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = [measure(data, offsets) for _, data, offsets in words.pieces(texts)]
        flat = np.concatenate(rows) if rows else np.empty((0, len(FEATURES)))
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(FEATURES)), pa.array(flat.ravel()))


@dataclass
class Model:
    """Additive lookup tables over binned features."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        total = np.full(len(rows), self.base)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, rows[:, i], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], rows[:, a], "right"), np.searchsorted(self.coarse[b], rows[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Edges between bins of about equal counts, halfway between two values that occur."""
    sorted_ = np.unique(values)
    between = (sorted_[1:] + sorted_[:-1]) / 2
    if len(between) < bins:
        return between
    at = np.searchsorted(between, np.quantile(values, np.arange(1, bins) / bins))
    return np.unique(between[np.minimum(at, len(between) - 1)])


def _gain(g, h):
    return g * g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best cut of a run of bins: its gain, and the number of bins left of it (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(gain.argmax())
    return float(gain[at]), at + 1 if gain[at] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step of a tree of at most four leaves for each bin."""
    step = np.zeros(len(g))
    _, cut = _split(g, h)
    for a, b in ((0, cut), (cut, len(g))) if cut else ((0, len(g)),):
        _, inner = _split(g[a:b], h[a:b])
        for c, d in ((a, a + inner), (a + inner, b)) if inner else ((a, b),):
            step[c:d] = g[c:d].sum() / (h[c:d].sum() + RIDGE)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid in four: its gain, and the step for each cell."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(s):
        a = s[:-1, :-1]
        b, c = s[:-1, -1:] - a, s[-1:, :-1] - a
        return a, b, c, s[-1, -1] - a - b - c

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    corner_g, corner_h = parts(G), parts(H)
    gain = sum(_gain(x, y) for x, y in zip(corner_g, corner_h)) - _gain(G[-1, -1], H[-1, -1])
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = np.empty_like(g)
    for k, (rows, columns) in enumerate(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)),
                                         (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        step[rows, columns] = corner_g[k][i, j] / (corner_h[k][i, j] + RIDGE)
    return float(gain[i, j]), step


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Boost the model on the rows of the sample."""
    positive = float((labels == 1).sum())
    share = (positive + 1) / (len(labels) + 2)
    model = Model(base=float(np.log(share / (1 - share))))
    if len(labels) == 0 or positive in (0, len(labels)):
        return model
    model.edges = [_cuts(rows[:, i], BINS) for i in range(rows.shape[1])]
    model.coarse = [_cuts(rows[:, i], COARSE) for i in range(rows.shape[1])]
    fine = [np.searchsorted(e, rows[:, i], "right") for i, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, rows[:, i], "right") for i, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(rows), model.base)

    def gradient():
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, bins in enumerate(fine):
            g, h = gradient()
            size = len(model.tables[i])
            step = RATE * _tree(np.bincount(bins, g, size), np.bincount(bins, h, size))
            model.tables[i] += step
            total += step[bins]

    def grid(a, b):
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        cells = rough[a] * shape[1] + rough[b]
        g, h = gradient()
        return cells, *(np.bincount(cells, x, shape[0] * shape[1]).reshape(shape) for x in (g, h))

    ranked = sorted(combinations(range(rows.shape[1]), 2), key=lambda p: (-_quadrants(*grid(*p)[1:])[0], p))[:PAIRS]
    tables = {p: np.zeros((len(model.coarse[p[0]]) + 1, len(model.coarse[p[1]]) + 1)) for p in ranked}
    for _ in range(PAIR_ROUNDS):
        for p in ranked:
            cells, g, h = grid(*p)
            step = RATE * _quadrants(g, h)[1]
            tables[p] += step
            total += step.ravel()[cells]
    model.pairs = [(*p, t) for p, t in tables.items()]
    return model


def sample(features: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and labels of about ``most`` labelled rows at most, the same ones in each run."""
    known = labels.filter(F.col(label).isNotNull() & learn).select("doc_id", F.col(label).cast("int").alias("label"))
    rate = most / max(known.count(), most)
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    rows = known.filter(place < rate).join(features, "doc_id").select("features", "label").toPandas()
    flat = np.array(rows["features"].tolist(), float).reshape(len(rows), len(FEATURES))
    order = np.lexsort((rows["label"], *flat.T))  # the same sums in each run
    return flat[order], rows["label"].to_numpy(float)[order]


def scorer(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf(DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array(shared.value.score(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(FEATURES))))

    return score


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``; a third of the ids is held out."""
    part = F.pmod(crc("doc_id"), F.lit(3))
    features = written(docs.select("doc_id", measured(F.coalesce("text", F.lit(""))).alias("features")), "features")
    model = fit(*sample(features, labels, label, part != 1))
    return features.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"),
                           scorer(docs.sparkSession, model)("features").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
