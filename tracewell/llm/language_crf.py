"""Language identification by a linear-chain conditional random field over the words of a text.

Every word (a run of letters, lower-cased) has features: its first and last one to four bytes, the byte
trigrams inside it, whether it stands in the lexicon of frequent words and which one, and its length.  The field
adds their learned weights per language and learned transitions between languages of neighbouring words, so that
texts which switch languages are labelled word by word.  Probabilities come from the forward-backward algorithm,
over whole texts: words are cut into blocks, the transfer matrices of all blocks are multiplied at once, carried
along each text, and opened again, which gives exactly the sums of one long pass.

A text's language is the one with the most expected words; the score is its share of the words.

Training: about ``MOST_TEXTS`` texts per language at most, chosen by a hash of the id, whole.  Half of them are
cut into short runs and dealt together, so that transitions between languages are seen; the gradient of the
likelihood is followed for ``EPOCHS`` passes.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing can be
learned; a language without text in the sample can not be predicted; ties go to the first name; rows that repeat
an id are judged each; an empty table gives an empty result; other columns pass through where documents are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tracewell.llm import words
from tracewell.llm.tables import crc, free_name

UNKNOWN = "und"
#: Training texts per language at most (about), passes over them, and words of one training sequence.
MOST_TEXTS, EPOCHS, SEQUENCE, STEP_RATE = 400, 2, 64, 0.5
#: Slots of the hashed weights, words of a language's lexicon, mean length of a dealt run.
SLOTS, LEXICON, RUN = 1 << 16, 1500, 10
#: Words of a block of the forward-backward pass; bytes whose trigrams are held at once.
BLOCK, STEP_BYTES = 32, 1 << 19

_NOT_LETTERS = np.ones(256, bool)
_NOT_LETTERS[65:91] = _NOT_LETTERS[97:123] = _NOT_LETTERS[128:] = False


def _slot(values: np.ndarray, kind: int) -> np.ndarray:
    salted = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0xC2B2AE3D27D4EB4F % (1 << 64))
    return (words.mix(salted) >> np.uint64(48)).astype(np.int32)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """One row of ten slots per word; slot ``SLOTS`` carries no weight."""
    lengths = ends - starts
    padded = np.concatenate([np.zeros(4, np.uint8), data, np.zeros(4, np.uint8)]).astype(np.uint64)
    head, tail = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    out = np.empty((len(starts), 10), np.int32)
    for k in range(4):
        inside = (lengths > k).astype(np.uint64)
        head |= padded[starts + 4 + k] * inside << np.uint64(8 * k)
        tail |= padded[ends + 3 - k] * inside << np.uint64(8 * k)
        out[:, k], out[:, 4 + k] = _slot(head, 1 + k), _slot(tail, 5 + k)
    hashed = words.hashes(data, starts, ends)
    known = lexicon[np.minimum(np.searchsorted(lexicon, hashed), len(lexicon) - 1)] == hashed if len(lexicon) else np.zeros(len(hashed), bool)
    out[:, 8] = np.where(known, _slot(hashed, 9), SLOTS)
    out[:, 9] = _slot(np.minimum(lengths, 24), 10)
    return out


def trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all trigrams of the words, in order, and how many each word has."""
    counts = np.maximum(ends - starts - 2, 0)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    wide = data.astype(np.uint64)
    return _slot(wide[at] | wide[at + 1] << np.uint64(8) | wide[at + 2] << np.uint64(16), 11), counts


def _by_word(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means of consecutive rows, ``counts`` rows for each word; 0 where there are none."""
    out = np.zeros((len(counts), values.shape[1]), values.dtype)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0) / counts[some, None]
    return out


@dataclass
class Field:
    """Languages, the weights of the slots (the last row is zero), transition and start scores, and the lexicon."""

    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray
    begin: np.ndarray
    lexicon: np.ndarray

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts), len(self.languages)), np.float32)
        done = 0
        while done < len(starts):
            stop = max(int(np.searchsorted(ends, starts[done] + STEP_BYTES, "right")), done + 1)
            low = int(starts[done])
            part = data[low:int(ends[stop - 1])]
            a, b = starts[done:stop] - low, ends[done:stop] - low
            slots = word_features(part, a, b, self.lexicon)
            total = self.weights[slots[:, 0]]
            for k in range(1, slots.shape[1]):
                total += self.weights[slots[:, k]]
            inner, counts = trigrams(part, a, b)
            out[done:stop] = total + _by_word(self.weights[inner], counts)
            done = stop
        return out

    def posteriors(self, emissions: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For every word the probability of each language, given its whole text."""
        count, kinds = emissions.shape
        if not count:
            return emissions
        sizes = np.diff(first)
        blocks = -(-sizes // BLOCK)
        base = np.cumsum(blocks) - blocks  # first block of each text
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(count) - first[text_of]
        cell = (base[text_of] + within // BLOCK) * BLOCK + within % BLOCK
        total = int(blocks.sum())
        local = np.ones((total * BLOCK, kinds), np.float32)
        local[cell] = np.exp(emissions - emissions.max(1, keepdims=True))
        there = np.zeros(total * BLOCK, bool)
        there[cell] = True
        local, there = local.reshape(total, BLOCK, kinds), there.reshape(total, BLOCK)
        opening = np.zeros(total, bool)
        opening[base[sizes > 0]] = True
        moves, begin = np.exp(self.moves).astype(np.float32), np.exp(self.begin - self.begin.max()).astype(np.float32)

        def onward(rows, t):  # rows (blocks, n, kinds) over one more word
            new = rows @ moves
            if t == 0:
                new[opening] = begin * rows[opening].sum(-1, keepdims=True)
            new = new * local[:, t, None, :]
            new /= np.maximum(new.max((1, 2), keepdims=True), 1e-30)
            return np.where(there[:, t, None, None], new, rows)

        transfer = np.broadcast_to(np.eye(kinds, dtype=np.float32), (total, kinds, kinds)).copy()
        for t in range(BLOCK):
            transfer = onward(transfer, t)
        ahead, back = np.full((total, kinds), 1 / kinds, np.float32), np.ones((total, kinds), np.float32)
        by_length = np.argsort(-blocks, kind="stable")
        longer = np.sort(blocks)
        for k in range(1, int(blocks.max())):
            texts = by_length[:len(blocks) - int(np.searchsorted(longer, k, "right"))]  # those with more than k blocks
            at = base[texts] + k
            carried = np.matmul(ahead[at - 1, None, :], transfer[at - 1])[:, 0]
            ahead[at] = carried / carried.sum(1, keepdims=True)
            at = base[texts] + blocks[texts] - k
            carried = np.matmul(transfer[at], back[at, :, None])[:, :, 0]
            back[at - 1] = carried / carried.sum(1, keepdims=True)
        forward = np.empty((total, BLOCK, kinds), np.float32)
        state = ahead[:, None, :]
        for t in range(BLOCK):
            state = onward(state, t)
            forward[:, t] = state[:, 0]
        for t in range(BLOCK - 1, -1, -1):
            forward[:, t] *= back
            new = (back * local[:, t]) @ moves.T
            new /= np.maximum(new.max(1, keepdims=True), 1e-30)
            back = np.where(there[:, t, None], new, back)
        out = forward.reshape(-1, kinds)[cell]
        return out / np.maximum(out.sum(1, keepdims=True), 1e-30)

    def label(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts: the words' probabilities, and the number of each text's first word."""
        for _, data, offsets in words.pieces(pc.utf8_lower(texts)):
            starts, ends, first = words.spans(data, offsets, _NOT_LETTERS)
            yield self.posteriors(self.emissions(data, starts, ends), first), first


def _likelihood_step(local, moves, begin, truth):
    """Gradients of the likelihood of a batch of sequences: by word, by transition, by start."""
    count, length, kinds = local.shape
    forward, scale = np.empty_like(local), None
    state = begin * local[:, 0]
    forward[:, 0] = state / state.sum(1, keepdims=True)
    for t in range(1, length):
        state = (forward[:, t - 1] @ moves) * local[:, t]
        forward[:, t] = state / state.sum(1, keepdims=True)
    back = np.ones((count, kinds), local.dtype)
    by_word = np.empty_like(local)
    by_move = np.zeros_like(moves)
    for t in range(length - 1, -1, -1):
        scale = forward[:, t] * back
        by_word[:, t] = scale / scale.sum(1, keepdims=True)
        behind = back * local[:, t]
        if t:
            joint = forward[:, t - 1, :, None] * moves * behind[:, None, :]
            by_move -= (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            back = behind @ moves.T
            back /= back.sum(1, keepdims=True)
    by_word *= -1
    np.put_along_axis(by_word, truth[..., None], np.take_along_axis(by_word, truth[..., None], 2) + 1, 2)
    np.add.at(by_move, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
    return by_word, by_move, by_word[:, 0].sum(0)


def train(texts: list[str], labels: list[str], seed: int = 20240229) -> Field | None:
    """Fit the field; None if there is no labelled word."""
    languages = sorted(set(labels))
    order = {name: i for i, name in enumerate(languages)}
    data, starts, ends, first = [], [], [], [0]
    at = 0
    for _, part, offsets in words.pieces(pc.utf8_lower(pa.array(texts, pa.string()))):
        a, b, f = words.spans(part, offsets, _NOT_LETTERS)
        data.append(part)
        starts.append(a + at)
        ends.append(b + at)
        first += (f[1:] + first[-1]).tolist()
        at += len(part)
    if not languages or first[-1] == 0:
        return None
    data, starts, ends = np.concatenate(data), np.concatenate(starts), np.concatenate(ends)
    truth = np.repeat([order[x] for x in labels], np.diff(first))
    hashed = words.hashes(data, starts, ends)
    lexicon = []
    for k in range(len(languages)):
        values, uses = np.unique(hashed[truth == k], return_counts=True)
        lexicon.append(values[np.lexsort((values, -uses))][:LEXICON])
    lexicon = np.unique(np.concatenate(lexicon))
    slots = word_features(data, starts, ends, lexicon)
    inner, counts = trigrams(data, starts, ends)
    inner_first = np.cumsum(counts) - counts
    kinds = len(languages)
    field = Field(languages, np.zeros((SLOTS + 1, kinds), np.float32), np.zeros((kinds, kinds), np.float32),
                  np.zeros(kinds, np.float32), lexicon)
    rng = np.random.default_rng(seed)
    runs = []
    for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
        if k % 2:
            runs.append((a, b))
            continue
        while a < b:
            stop = min(a + int(rng.geometric(1 / RUN)), b)
            runs.append((a, stop))
            a = stop
    squares = [np.full_like(x, 1.0) for x in (field.weights, field.moves, field.begin)]

    def climb(values, square, gradient):
        square += gradient * gradient
        values += STEP_RATE * gradient / np.sqrt(square)

    for _ in range(EPOCHS):
        stream = np.concatenate([np.arange(*runs[i]) for i in rng.permutation(len(runs))])
        if len(stream) < SEQUENCE:
            stream = np.resize(stream, SEQUENCE)
        stream = stream[:len(stream) // SEQUENCE * SEQUENCE].reshape(-1, SEQUENCE)
        for batch in np.array_split(stream, max(len(stream) // 64, 1)):
            flat = batch.ravel()
            size = counts[flat]
            places = np.repeat(inner_first[flat] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            found = inner[places]
            scores = field.weights[slots[flat]].sum(1) + _by_word(field.weights[found], size)
            local = np.exp(scores - scores.max(1, keepdims=True)).reshape(*batch.shape, kinds)
            by_word, by_move, by_begin = _likelihood_step(local, np.exp(field.moves), np.exp(field.begin), truth[batch])
            by_word = by_word.reshape(-1, kinds) / 8
            every = np.concatenate([slots[flat].ravel(), found])
            step = np.empty_like(field.weights)
            for k in range(kinds):
                share = np.concatenate([np.repeat(by_word[:, k], slots.shape[1]), np.repeat(by_word[:, k] / np.maximum(size, 1), size)])
                step[:, k] = np.bincount(every, share, SLOTS + 1)
            step[SLOTS] = 0
            climb(field.weights, squares[0], step)
            climb(field.moves, squares[1], by_move / 64)
            climb(field.begin, squares[2], by_begin / 8)
    return field


def sample(docs: DataFrame, learn: Column, most: int = MOST_TEXTS) -> tuple[list[str], list[str]]:
    """About ``most`` whole texts per language at most, the same ones in each run, in the order of their ids."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    rates = F.create_map(*[F.lit(x) for name, n in sorted(sizes.items()) for x in (name, most / max(n, most))]) if sizes else None
    if rates is None:
        return [], []
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    rows = known.filter(place < rates[F.col("lang")]).select("doc_id", "lang", "text").collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def _predictor(spark, field: Field):
    shared = spark.sparkContext.broadcast(field)

    @arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        field = shared.value
        for texts in batches:
            names, scores = [], []
            for found, first in field.label(texts):
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    mean = found[a:b].mean(0, dtype=float) if b > a else np.zeros(len(field.languages))
                    best = int(mean.argmax())
                    names.append(field.languages[best] if b > a else UNKNOWN)
                    scores.append(min(float(mean[best]), 1.0))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict


def _span_labeller(spark, field: Field):
    shared = spark.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    @arrow_udf("array<struct<lang:string,first_word:bigint,last_word:bigint>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        field = shared.value
        for texts in batches:
            rows = []
            for found, first in field.label(texts):
                best = found.argmax(1) if len(found) else np.empty(0, int)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    cuts = [0, *(np.flatnonzero(np.diff(best[a:b])) + 1).tolist(), b - a]
                    rows.append([{"lang": field.languages[best[a + x]], "first_word": x, "last_word": y - 1}
                                 for x, y in zip(cuts, cuts[1:]) if y > x])
            yield pa.array(rows, kind)

    return spans


def language_of(text: Column, spark, field: Field | None) -> Column:
    """``struct(lang, score)`` of a text."""
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if field is None:
        return unknown
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), _predictor(spark, field)(F.coalesce(text, F.lit("")))).otherwise(unknown)


def language_spans(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, spans``: runs of words with one language, for text that switches between languages."""
    return docs.select("doc_id", _span_labeller(docs.sparkSession, field)(F.coalesce("text", F.lit(""))).alias("spans"))


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score``; a quarter of the ids is held out."""
    part = F.pmod(crc("doc_id"), F.lit(4))
    field = train(*sample(docs, part != 2))
    found = language_of(F.col("text"), docs.sparkSession, field)
    return docs.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def known_language(docs: DataFrame, least: float) -> DataFrame:
    """The rows and columns of ``docs`` whose language is known with a score of at least ``least``.

    Where no row has a language to learn from, no text can be rejected for its language: those with a letter stay.
    """
    field = train(*sample(docs, F.lit(True)))
    if field is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    name = free_name(docs, "found_language")
    return docs.withColumn(name, language_of(F.col("text"), docs.sparkSession, field)).filter(
        (F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.score") >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
