"""Token ids as length-delimited binary records with an offset index, written and read on the executors.

A part file is a run of records.  A record is

    length   unsigned 64-bit, little endian: bytes of the payload
    check    masked CRC-32 of those eight bytes
    payload  the id of the document (signed 64-bit) and its token ids, as unsigned 16-bit numbers if the
             vocabulary allows it, else 32-bit, little endian
    check    masked CRC-32 of the payload

and a mask turns a checksum by 15 bits and adds a constant, so that a checksum over data that holds
checksums stays useful.  Beside a part lies its index: the byte offset of every record, the sum of tokens before
it, and the file's end, so that any record can be read by itself and records can be read in shuffled order.

Parts follow the order of ids: texts are dealt out by ranges of ids and sorted inside a part, where ids repeat by
text.  A task writes to a name of its own and renames it when complete, so a task that is run again, or twice,
leaves the same files.  Files are reached through their URI, local or remote.

The tokenizer's words are separated by white space, so a text's ids are those of its white-space separated
words in a row; a word is encoded by the tokenizer and remembered in a table of at most ``REMEMBERED`` words, which
those leave first that were not met for longest.  A
text in which the name of a special token occurs is encoded whole.

Defined results: a null or empty text is a record with the end id alone; a null id is written as ``NO_ID`` and
read as null, and comes last; rows that repeat an id are records each; an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.tables import files_of, new_folder

TOKENIZER = "word_bpe_49k.json"
END = 1
NO_ID = (1 << 63) - 1
MASK = 0xA282EAD8
#: Words, and parts of words, whose ids a worker remembers.
REMEMBERED = 250_000
#: Bytes of texts whose words are looked up together.
TOGETHER = 1 << 20
#: Words that are looked up at once.
STEP = 1 << 16
#: Words encoded in one call.
ENCODED = 1024
#: Bytes that a writer gathers before it appends them.
BUFFER = 4 << 20
#: Words in lines: Latin letters, all of which have a simple lower case, and signs that can not begin a contraction
#: behind them; or anything else.
_PARTS = re.compile("^(?:([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)|(.+))$", re.MULTILINE).findall


def masked(data: bytes) -> int:
    check = zlib.crc32(data)
    return ((check >> 15 | check << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int, where: str) -> tuple[bytes, int]:
    """The payload of the record at an offset, checked, and the offset behind it."""
    length = data[at:at + 8]
    if len(data) < at + 12 or struct.unpack_from("<I", data, at + 8)[0] != masked(length):
        raise ValueError(f"{where}: damaged length at byte {at}")
    size = struct.unpack("<Q", length)[0]
    payload = data[at + 12:at + 12 + size]
    if len(data) < at + 16 + size or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload):
        raise ValueError(f"{where}: damaged record at byte {at}")
    return payload, at + 16 + size


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to bytes of little-endian ids, with the end id.

    Words are known at two levels: as they stand, and by their parts.  A word of Latin letters with other signs
    behind it is lower-cased and cut in two, as the tokenizer itself does, so that capitals and punctuation need
    no calls of their own.  Both tables are bounded, and live as long as the worker process.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.known, self.parts = Remembered(), Remembered()
        self.end = self._bytes([END])
        # ids of tokens that end a word, where the vocabulary marks them
        self.ending = np.zeros(self.model.get_vocab_size(), bool)
        self.ending[[i for token, i in self.model.get_vocab().items() if token.endswith("</w>")]] = True

    def _bytes(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Put the ids of unknown words into the table."""
        found = _PARTS("\n".join(words))
        heads = "\n".join([f[0] for f in found]).lower().split("\n")
        tails, others = [f[1] for f in found], [f[2] for f in found]
        whole = {*heads, *tails}
        new = self.parts.missing({*whole, *others})
        for some, is_whole in (([p for p in new if p in whole], True), ([p for p in new if p not in whole], False)):
            for at in range(0, len(some), ENCODED):
                self._encode(some[at:at + ENCODED], is_whole)
        parts = self.parts.young
        self.known.young.update(zip(words, [parts[o] if o else parts[h] + parts[t] for h, t, o in zip(heads, tails, others)]))

    def _encode(self, parts: list[str], whole: bool) -> None:
        """Encode parts; ``whole`` ones are one word each to the tokenizer and go in one text, whose ids are cut
        behind those that end a word."""
        if whole:
            ids = np.array(self.model.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(parts) == len(ends) and ends[-1] == len(ids):
                raw, size = ids.tobytes(), self.kind.itemsize
                ends = (ends * size).tolist()
                self.parts.young.update(zip(parts, [raw[begin:end] for begin, end in zip([0, *ends], ends)]))
                return
        for part, out in zip(parts, self.model.encode_batch_fast(parts, add_special_tokens=False)):
            self.parts.young[part] = self._bytes(out.ids)

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids; texts are looked up together, about ``TOGETHER`` bytes at once, a longer one alone."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(texts):
            last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TOGETHER, "right")), first + 1)
            yield from self._together(pc.fill_null(texts.slice(first, last - first), ""))
            first = last

    def _together(self, texts: pa.Array) -> Iterator[bytes]:
        special = pa.array(np.zeros(len(texts), bool))
        for name in self.special:
            special = pc.or_(special, pc.match_substring(texts, name))
        lists = pc.ascii_split_whitespace(pc.if_else(special, "", texts))
        words, sizes, ids = lists.flatten(), [np.zeros(1, np.int64)], [np.zeros(0, self.kind)]
        for at in range(0, len(words), STEP):
            few = words.slice(at, STEP).dictionary_encode()
            known = self._know(_listed(few.dictionary))
            held = np.frombuffer(b"".join(known), self.kind)
            size = np.array(list(map(len, known)), np.int64) // self.kind.itemsize
            number = few.indices.to_numpy()
            many = size[number]
            begin = (np.cumsum(size) - size)[number] - (np.cumsum(many) - many)
            ids.append(held[np.repeat(begin, many) + np.arange(int(many.sum()))])
            sizes.append(many)
        found = np.concatenate(ids)
        ends = np.cumsum(np.concatenate(sizes))[lists.offsets.to_numpy()].tolist()
        for begin, end, whole, text in zip(ends, ends[1:], special.to_pylist(), texts):
            if whole:
                yield self._bytes(self.model.encode(text.as_py(), add_special_tokens=False).ids) + self.end
            else:
                yield found[begin:end].tobytes() + self.end

    def _know(self, words: list[str]) -> list[bytes]:
        """The ids of different words, at most ``STEP``."""
        new = self.known.missing(set(words).difference(("",)))
        if new:
            self._learn(new)
        self.known.young[""] = b""
        return list(map(self.known.young.__getitem__, words))


class Remembered:
    """A bounded table in two generations: what is asked for goes on from the old one to the young one, and when that is
    half full, it becomes the old one.  So what is asked for again and again stays.  One call may go beyond the bound."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """Keys that neither has.  The others are in the young one from here until the next call."""
        new = keys.difference(self.young)
        if len(self.young) + len(new) > REMEMBERED // 2:
            self.old, self.young = self.young, {}
            new = keys
        still = {k: self.old[k] for k in new if k in self.old}
        self.young.update(still)
        return [k for k in new if k not in still]


def _listed(words: pa.Array) -> list[str]:
    """Words without line ends as Python strings, made from one string, which is faster than one by one."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py().split("\n")


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The worker process's encoder; what it knows serves all tasks of the process."""
    return Encoder(path)


def _writer(folder: str, path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        files, base = files_of(folder)
        files.create_dir(base, recursive=True)
        name = f"{base}/part-{part:08d}"
        own = f"{name}.{context.taskAttemptId()}"
        encoder, offsets, tokens, at, total = encoder_of(path), [], [], 0, 0
        stream = None
        for batch in batches:
            if stream is None:
                stream = files.open_output_stream(own + ".bin")
            gathered: list[bytes] = []
            size = 0
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            texts = batch.column("text")
            for number, encoded in zip(ids.tolist(), encoder(texts)):
                record = frame(struct.pack("<q", number) + encoded)
                offsets.append(at)
                tokens.append(total)
                at += len(record)
                total += len(encoded) // encoder.kind.itemsize
                gathered.append(record)
                size += len(record)
                if size >= BUFFER:
                    stream.write(b"".join(gathered))
                    gathered, size = [], 0
            stream.write(b"".join(gathered))
        if stream is None:
            return
        stream.close()
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages
        with files.open_output_stream(own + ".idx") as out:
            out.write(np.array([offsets + [at], tokens + [total]], "<u8").T.tobytes())
        for end in (".bin", ".idx"):
            files.move(own + end, name + end)
        yield pa.RecordBatch.from_pylist([{
            "part": part, "records": len(offsets), "tokens": total, "bytes": at, "width": encoder.kind.itemsize}])

    return write


def write(docs: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    """Write the records of all rows; returns the manifest, one row per part: ``part, records, tokens, bytes, width, folder``.

    The manifest lies as Parquet in the folder ``manifest`` beside the parts.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "records")
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # rows of one repeated or null id are dealt by how their texts begin, which agrees with the order, so that no part
    # file takes all of them; bounds between parts stay short
    dealt = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    manifest = dealt.mapInArrow(_writer(folder, path or tokenizer_path()), "part long, records long, tokens long, bytes long, width long")
    manifest.withColumn("folder", F.lit(folder)).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            files, base = files_of(row["folder"])
            name = f"{base}/part-{row['part']:08d}"
            with files.open_input_file(name + ".idx") as source:
                index = np.frombuffer(source.read(), "<u8").reshape(-1, 2).astype(np.int64)
            if len(index) != row["records"] + 1:
                raise ValueError(f"{name}.idx: {len(index) - 1} records, {row['records']} expected")
            with files.open_input_file(name + ".bin") as source:
                first = 0
                while first < row["records"]:
                    # records up to about BUFFER bytes, at least one
                    last = max(int(np.searchsorted(index[:, 0], index[first, 0] + BUFFER, "right")) - 1, first + 1)
                    data = source.read_at(int(index[last, 0] - index[first, 0]), int(index[first, 0]))
                    ids, crcs, counts = [], [], []
                    for at in (index[first:last, 0] - index[first, 0]).tolist():
                        payload, _ = unframe(data, at, name)
                        tokens = np.frombuffer(payload, f"<u{row['width']}", offset=8)
                        ids.append(struct.unpack_from("<q", payload)[0])
                        counts.append(len(tokens))
                        crcs.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                    if (np.diff(index[first:last + 1, 1]) != counts).any():
                        raise ValueError(f"{name}: the index and the records disagree")
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(ids, pa.int64()), "start": pa.array(index[first:last, 1] + row["begin"]),
                        "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})
                    first = last


def read_digests(manifest: DataFrame) -> DataFrame:
    """Read every record back: ``doc_id, start, n_tokens, ids_crc32``.

    Tokens of earlier parts are summed over the manifest, which has one row per part file.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.select("part", "records", "width", "folder", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("begin"))
    # one task for each part file: the rows of the manifest are small, the files are not
    dealt = parts.repartition(max(manifest.count(), 1), "part")
    read = dealt.mapInArrow(_read_part, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def read_record(folder: str, part: int, number: int, width: int = 2) -> tuple[int, np.ndarray]:
    """One record by its place: a shuffled read.  The document's id and its token ids."""
    files, base = files_of(folder)
    name = f"{base}/part-{part:08d}"
    with files.open_input_file(name + ".idx") as source:
        begin, end = np.frombuffer(source.read_at(32, 16 * number), "<u8")[::2].astype(int).tolist()
    with files.open_input_file(name + ".bin") as source:
        payload, _ = unframe(source.read_at(end - begin, begin), 0, name)
    return struct.unpack_from("<q", payload)[0], np.frombuffer(payload, f"<u{width}", offset=8)


def token_records(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write all rows as records and read the files back: ``doc_id, start, n_tokens, ids_crc32``."""
    return read_digests(write(docs, path=path))
