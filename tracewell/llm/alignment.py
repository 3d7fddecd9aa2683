"""Tokens of two tokenizers of the same text, aligned by pointer jumping, and how often their ids meet in a corpus.

1. Space and text is encoded by a byte-level model (A); the text by a model of pieces (B), which puts the space there
   itself.  Every token has a range of bytes.
2. Every token points to the farthest-right token of the other side that overlaps it, or to itself if both end there.
   The pointers are doubled (``next = next[next]``) until nothing changes: each token then points to the last
   token of its component, which is the component's label.  Components are the groups between bytes where tokens of both
   end.  All tokens of all new words are labelled together, in numpy.
3. Each pair of an A and a B token in one group is a link; a pair of ids counts in how many documents it is linked.
   Those counts are a table; tasks read it in slices of at most about ``SLICE`` pairs, by A id, and score the links of
   every document, which were written with it.

Both models leave a text cut before a single space or newline between two printing characters: no token of either
reaches over it (``Aligner`` checks the vocabulary of B for that).  So the text's tokens and groups are those of its
words in a row, and a word is encoded and aligned once and remembered, in tables that start anew after
``REMEMBERED`` words.

Defined results: null and empty texts have no tokens, nor have texts whose A or B tokens do not spell space and text
(as texts with U+2581); they keep their row with zeros and an empty string.  Rows that repeat an id or a text are
documents each.  An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.records import tokenizer_path
from tracewell.llm.tables import files_of, settings, written, written_at

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Words that a worker remembers, and their characters.
REMEMBERED, REMEMBERED_CHARS = 400_000, 16 << 20
#: Characters that are encoded together, and about those of texts that are aligned together.
TOGETHER = 1 << 18
#: Pairs of ids whose counts a worker holds at once.
SLICE = 4_000_000
SPACE = "▁"
#: Characters that print and that neither tokenizer takes for white space.
_PRINTS = "!-~¡-ᙿᚁ-᠍᠏-῿⁰-⿿、-﻾＀-\U0010ffff"
_CUT = re.compile(rf"(?<=[{_PRINTS}])(?=[ \n][{_PRINTS}])")
_PRINTING = re.compile(rf"\n?[{_PRINTS}](?:.*[{_PRINTS}])?", re.DOTALL).fullmatch
#: Numbers of words in a worker's tables: one that can not stand alone, and one whose tokens do not spell it.
_ODD, _BROKEN = 0, 1

ROW = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<int>"
_ROW = pa.schema([
    ("doc_id", pa.int64()), ("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("keys", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
SCORED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_SCORED = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printing ones for themselves, the others
    for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def labels(a_end: np.ndarray, a_size: np.ndarray, b_end: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last B token of the component of every A and every B token; ranges cover the same bytes without gaps."""
    n = len(a_end)
    last_b = np.searchsorted(b_end - b_size, a_end, "left") - 1
    last_a = np.searchsorted(a_end - a_size, b_end, "left") - 1
    own = n + np.arange(len(b_end))
    successor = np.concatenate([n + last_b, np.where(a_end[last_a] > b_end, last_a, own)]) if n else own
    while True:
        farther = successor[successor]
        if (farther == successor).all():
            return successor[:n] - n, successor[n:] - n
        successor = farther


class Aligner:
    """Words to tokens of both models, their groups and links; lives as long as a worker process."""

    def __init__(self, first: str, second: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        of = _byte_of_character()
        added = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        names = sorted((i, t) for t, i in self.a.get_vocab().items())
        spelled = {i: added[i].encode() if i in added else bytes(of[c] for c in t) for i, t in names}
        self.a_bytes = [spelled.get(i, b"") for i in range(names[-1][0] + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b_bytes)) if not self.b.is_byte(i)]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError(f"{second}: pieces reach over words")
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id(SPACE)
        self.forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": _ODD}
        self.chars = 0
        self.groups: list[str] = ["", ""]
        self.numbers = np.zeros((1 << 12, 4), np.int64)  # A tokens, B tokens, groups, links of a word
        self.first = np.zeros((1 << 12) + 1, np.int64)  # where a word's pairs begin
        self.keys, self.times = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def full(self) -> bool:
        return len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS

    def _second(self, words: list[str]) -> list[list[int]]:
        """B tokens of words that begin with a space or a newline."""
        plain = self.b.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        # before a newline the model has put a space that is not there
        return [ids if w[0] == " " else ids[1:] if ids[:1] == [self.blank] else [] for w, ids in zip(words, plain)]

    def _learn(self, names: list[str], words: list[str]) -> None:
        """Encode and align words; names are the keys under which they will be known."""
        whole = "".join(words)
        raw = [w.encode() for w in words]
        joined, ends = b"".join(raw), np.cumsum([len(r) for r in raw])
        a = np.array(self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.int64)
        a_end = np.cumsum(self.a_size[a])
        cuts = np.searchsorted(a_end, ends)
        if not len(a_end) or a_end[-1] != ends[-1] or (a_end[cuts] != ends).any():
            raise ValueError("the first tokenizer's tokens reach over words")
        a_count = np.diff(cuts, prepend=-1)
        lists = self._second(words)
        b = list(chain.from_iterable(lists))
        b_count = np.array([len(x) for x in lists])
        spelled = all(b"".join([of[i] for i in x]) == joined for of, x in ((self.a_bytes, a.tolist()), (self.b_bytes, b)))
        b_end = np.append(0, np.cumsum(self.b_size[b]))
        if not spelled or (b_end[np.cumsum(b_count)] != ends).any():
            # some word differs: look at each
            starts = (np.cumsum(a_count) - a_count).tolist()
            good = np.array([b"".join([self.b_bytes[i] for i in x]) == r and b"".join([self.a_bytes[i] for i in a[at:at + n].tolist()]) == r
                             for x, r, at, n in zip(lists, raw, starts, a_count.tolist())])
            self.known.update(dict.fromkeys((n for n, g in zip(names, good) if not g), _BROKEN))
            a, b = a[np.repeat(good, a_count)], [i for x, g in zip(lists, good) if g for i in x]
            a_count, b_count, names = a_count[good], b_count[good], [n for n, g in zip(names, good) if g]
        if names:
            self._align(names, a, a_count, np.array(b, np.int64), b_count)
        self.chars += len(whole)

    def _align(self, names: list[str], a: np.ndarray, a_count: np.ndarray, b: np.ndarray, b_count: np.ndarray) -> None:
        a_label, b_label = labels(np.cumsum(self.a_size[a]), self.a_size[a], np.cumsum(self.b_size[b]), self.b_size[b])
        terminal = b_label == np.arange(len(b))
        order = np.cumsum(terminal) - 1  # of groups, at their last B token
        a_group, b_group = order[a_label], order[b_label]
        a_in, b_in = np.bincount(a_group), np.bincount(b_group)
        word = np.repeat(np.arange(len(names)), a_count)
        links = b_in[a_group]
        at = np.repeat((np.cumsum(b_in) - b_in)[a_group] - (np.cumsum(links) - links), links) + np.arange(int(links.sum()))
        width = len(self.a_bytes) * len(self.b_bytes)
        pair = np.repeat(a, links) * len(self.b_bytes) + b[at]
        pair, times = np.unique(np.repeat(word, links) * width + pair, return_counts=True)
        group_word = word[np.cumsum(a_in) - a_in]
        numbers = np.stack([a_count, b_count, np.bincount(group_word, minlength=len(names)),
                            np.bincount(word, weights=links, minlength=len(names)).astype(np.int64)], 1)
        have = len(self.groups)
        self._store(numbers, np.bincount(pair // width, minlength=len(names)), pair % width, times)
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        shown, i, j = [], 0, 0
        for p, q in zip(np.cumsum(a_in).tolist(), np.cumsum(b_in).tolist()):
            shown.append(f"{a_text[i] if p == i + 1 else ','.join(a_text[i:p])}|{b_text[j] if q == j + 1 else ','.join(b_text[j:q])}")
            i, j = p, q
        g = 0
        for of in numbers[:, 2].tolist():
            self.groups.append(shown[g] if of == 1 else ";".join(shown[g:g + of]))
            g += of
        self.known.update(zip(names, range(have, have + len(names))))

    def _store(self, numbers: np.ndarray, pairs: np.ndarray, keys: np.ndarray, times: np.ndarray) -> None:
        have, more, used = len(self.groups), len(numbers), int(self.first[len(self.groups)])
        while have + more > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
            self.first = np.concatenate([self.first, np.zeros(len(self.first) - 1, np.int64)])
        while used + len(keys) > len(self.keys):
            self.keys, self.times = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.times))
        self.numbers[have:have + more] = numbers
        self.first[have + 1:have + more + 1] = used + np.cumsum(pairs)
        self.keys[used:used + len(keys)], self.times[used:used + len(keys)] = keys, times

    def words(self, chunks: list[str]) -> list[list[int]]:
        """The numbers of each chunk's words; a chunk begins with a space or a newline before which a text can be cut."""
        pieces = [c.replace("\n", " \n")[1:].split(" ") for c in chunks]
        found = [list(map(self.known.get, p)) for p in pieces]
        new = list({p for ps, ns in zip(pieces, found) if None in ns for p, n in zip(ps, ns) if n is None})
        plain = [p for p in new if _PRINTING(p)]
        self.known.update(dict.fromkeys(set(new).difference(plain), _ODD))
        self._in_steps(plain, [p if p[0] == "\n" else " " + p for p in plain])
        found = [list(map(self.known.__getitem__, p)) if None in n else n for p, n in zip(pieces, found)]
        return [self._odd(c) if _ODD in n else n for c, n in zip(chunks, found)]

    def _odd(self, chunk: str) -> list[int]:
        """Double spaces, other white space at a border and the like: cut by the rule itself."""
        pieces = _CUT.split(chunk)
        names = ["\0" + p for p in pieces]
        for name, piece in dict(zip(names, pieces)).items():
            if name not in self.known:
                self._learn([name], [piece])
        return [self.known[n] for n in names]

    def _in_steps(self, names: list[str], words: list[str]) -> None:
        at, size = 0, 0
        for i, word in enumerate(words):
            size += len(word)
            if size >= TOGETHER or i + 1 == len(words):
                self._learn(names[at:i + 1], words[at:i + 1])
                at, size = i + 1, 0

    def links(self, owner: np.ndarray, word: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and times of the id pairs of ``count`` texts, and where each text's begin."""
        many = len(self.groups)
        code, repeats = np.unique(owner * many + word, return_counts=True)
        owner, word = code // many, code % many
        size = self.first[word + 1] - self.first[word]
        at = np.repeat(self.first[word] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        width = len(self.a_bytes) * len(self.b_bytes)
        return summed(np.repeat(owner, size) * width + self.keys[at], self.times[at] * np.repeat(repeats, size), width, count)


def summed(codes: np.ndarray, times: np.ndarray, width: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal codes put together: keys, times, and where each owner's begin; a code is ``owner * width + key``."""
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    begins = np.flatnonzero(np.concatenate([np.ones(min(len(codes), 1), bool), codes[1:] != codes[:-1]]))
    total = np.add.reduceat(times, begins) if len(begins) else times
    codes = codes[begins]
    return codes % width, total, np.searchsorted(codes, np.arange(count + 1) * width)


@lru_cache(maxsize=1)
def aligner_of(first: str, second: str) -> Aligner:
    return Aligner(first, second)


def _chunks(text: str) -> Iterator[str]:
    """Space and text in chunks of about ``TOGETHER`` characters, cut where it can be."""
    whole, at = " " + text, 0
    while len(whole) - at > 2 * TOGETHER and (cut := _CUT.search(whole, at + TOGETHER)):
        yield whole[at:cut.start()]
        at = cut.start()
    yield whole[at:]


class _Text:
    """What is known of one text so far."""

    def __init__(self) -> None:
        self.numbers, self.hash, self.begun, self.broken = np.zeros(4, np.int64), hashlib.sha256(), False, False
        self.keys, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, aligner: Aligner, words: list[int], keys: np.ndarray, times: np.ndarray) -> None:
        self.numbers += aligner.numbers[words].sum(0)
        self.hash.update(((";" if self.begun else "") + ";".join(map(aligner.groups.__getitem__, words))).encode())
        self.begun = True
        if len(self.keys):
            keys, times, _ = summed(np.concatenate([self.keys, keys]), np.concatenate([self.times, times]), 1 << 62, 1)
        self.keys, self.times = keys, times


def _aligned(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(first, second)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [_Text() for _ in texts]
            held, size = [], 0  # chunks that are aligned together

            def align() -> None:
                parts = list(zip([i for i, _ in held], aligner.words([c for _, c in held])))
                for i, words in parts:
                    if _BROKEN in words:
                        found[i].broken = True
                good = [(i, words) for i, words in parts if not found[i].broken]
                owner = np.repeat(np.arange(len(good)), [len(w) for _, w in good])
                keys, times, at = aligner.links(owner, np.array([x for _, w in good for x in w], np.int64), len(good))
                for n, (i, words) in enumerate(good):
                    found[i].add(aligner, words, keys[at[n]:at[n + 1]], times[at[n]:at[n + 1]])
                held.clear()
                if aligner.full():
                    aligner.forget()

            for i, text in enumerate(texts):
                for chunk in _chunks(text) if text else ():
                    held.append((i, chunk))
                    size += len(chunk)
                    if size >= TOGETHER:
                        align()
                        size = 0
            if held:
                align()
            yield _rows(batch, found)

    return run


def _rows(batch: pa.RecordBatch, found: list[_Text]) -> pa.RecordBatch:
    some = [t.begun and not t.broken for t in found]
    numbers = np.array([t.numbers if s else np.zeros(4, np.int64) for t, s in zip(found, some)]).reshape(-1, 4)
    keys = [t.keys if s else t.keys[:0] for t, s in zip(found, some)]
    times = [t.times if s else t.times[:0] for t, s in zip(found, some)]
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(kind)))
             for x, kind in ((keys, np.int64), (times, np.int32))]
    return pa.RecordBatch.from_arrays([
        batch.column("doc_id").cast(pa.int64()), batch.column("row"), *[pa.array(numbers[:, i]) for i in range(4)],
        pa.array([t.hash.hexdigest() if s else "" for t, s in zip(found, some)], pa.string()), *lists], schema=_ROW)


@lru_cache(maxsize=1)
def _counts(folder: str, width: int, slices: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of one slice in order, their counts, and whether a count is the highest of its A id."""
    from pyarrow import dataset

    files, base = files_of(folder)
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in dataset.dataset(base, filesystem=files, format="parquet").to_batches(columns=["key", "n"], batch_size=1 << 16):
        key, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
        here = key // width % slices == number
        keys.append(key[here])
        counts.append(n[here])
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    of = key // width
    begins = np.flatnonzero(np.concatenate([np.ones(min(len(of), 1), bool), of[1:] != of[:-1]]))
    most = np.maximum.reduceat(n, begins) if len(begins) else n
    return key, n, n == np.repeat(most, np.diff(np.append(begins, len(of))))


def _scored(folder: str, width: int, slices: int, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, best = _counts(folder, width, slices, number)
        for batch in batches:
            lists, times = batch.column("keys"), batch.column("times").flatten().to_numpy()
            keys = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            here = keys // width % slices == number
            at = np.searchsorted(key, keys[here])
            # whole numbers as doubles are exact up to 2**53
            n_best = np.bincount(owner[here], weights=times[here] * best[at], minlength=len(sizes)).astype(np.int64)
            total = np.zeros(len(sizes), np.int64)
            np.add.at(total, owner[here], times[here].astype(np.int64) * n[at])
            kept = [batch.column(c) for c in _SCORED]
            yield pa.RecordBatch.from_arrays([*kept[:6], pa.array(n_best), pa.array(total), kept[6]],
                                             names=[*_SCORED[:6], "n_best", "count_sum", "groups_sha256"])

    return run


def align(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """Every document's tokens aligned, written to the shared folder; ``keys`` and ``times`` are its links by pair of ids.

    A key is A id times the size of B's vocabulary plus B id.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    with settings(docs.sparkSession, spark__sql__parquet__compression__codec="zstd"):
        return written(rows.mapInArrow(_aligned(first or tokenizer_path(FIRST), second or tokenizer_path(SECOND)), ROW), "aligned")


def scores(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=second or tokenizer_path(SECOND)).get_piece_size()
    aligned = align(docs, first, second)
    pairs, folder = written_at(aligned.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "pair_counts")
    slices = max(-(-pairs.count() // SLICE), 1)
    scored = None
    for number in range(slices):
        part = aligned.mapInArrow(_scored(folder, width, slices, number), SCORED)
        scored = part if scored is None else scored.union(part)
    if slices > 1:
        same = [F.first(c).alias(c) for c in _SCORED[1:]]
        scored = scored.groupBy("row").agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
