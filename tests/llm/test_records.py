import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import records
from tracewell.llm.tables import settings

from .helpers import SCHEMA, documents, odd_rows


def test_frames_and_damage():
    payload = bytes(range(256)) * 3
    data = records.frame(b"") + records.frame(payload)
    first, at = records.unframe(data, 0, "here")
    assert first == b"" and records.unframe(data, at, "here") == (payload, len(data))
    for spoiled in (3, 9, at + 20, len(data) - 1):
        wrong = bytearray(data)
        wrong[spoiled] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(wrong), 0 if spoiled < at else at, "here")
    with pytest.raises(ValueError):
        records.unframe(data[:-1], at, "here")


def plain(rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(records.tokenizer_path())
    out, start = [], 0
    for d, t in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode())):
        ids = model.encode(t, add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


TRICKY = ["Don't STOP now\x1c\x1dnext", "é ́x ﬁ", "<|endoftext|> and <|startoftext|>word", "a b\u0085c", "ΑΣ Σ", "日本語 текст 😀", "'s 't're", "  "]


def test_round_trip(spark):
    rows = odd_rows() + [(100 + i, t, "en", "a", 0) for i, t in enumerate(TRICKY)]
    got = records.token_records(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == plain(rows)


def test_files_and_shuffled_reads(spark, tmp_path):
    rows = odd_rows()
    manifest = records.write(documents(spark, rows), folder=str(tmp_path / "out"))
    parts = manifest.orderBy("part").collect()
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    assert names == sorted(f"part-{r.part:08d}.{e}" for r in parts for e in ("bin", "idx"))
    assert sum(r.records for r in parts) == len(rows)
    want = plain(rows)
    at = 0
    for r in parts:
        for number in reversed(range(r.records)):
            doc, ids = records.read_record(r.folder, r.part, number, r.width)
            d, _, n, check = want[at + number]
            assert (doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) == (records.NO_ID if d is None else d, n, check)
        at += r.records
    again = records.write(documents(spark, rows), folder=str(tmp_path / "again"))
    same = [(tmp_path / x / n).read_bytes() for n in names for x in ("out", "again")]
    assert same[::2] == same[1::2] and again.count() == len(parts)


def test_a_repeated_id_fills_several_parts(spark, tmp_path):
    rows = [(None if i % 2 else 5, f"{i * 37 % 211} text {i}", "en", "a", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8)
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        parts = records.write(docs, folder=str(tmp_path / "out")).collect()
    assert len(parts) > 2 and max(r.records for r in parts) < 200
    assert sorted(map(tuple, records.token_records(docs).collect()), key=lambda r: r[1]) == plain(rows)


def test_small_word_tables_and_steps(spark, monkeypatch):
    import pyarrow as pa

    encoder = records.Encoder(records.tokenizer_path())
    texts = [t for _, t, *_ in odd_rows()] + TRICKY
    want = [np.array(encoder.model.encode(t or "", add_special_tokens=False).ids + [1], "<u2").tobytes() for t in texts]
    assert list(encoder(pa.array(texts, pa.string()))) == want
    for name, value in (("REMEMBERED", 6), ("STEP", 7), ("TOGETHER", 50)):
        monkeypatch.setattr(records, name, value)
        assert list(encoder(pa.array(texts[::-1], pa.string()))) == want[::-1]
    assert list(encoder(pa.array([], pa.string()))) == []
    assert records.token_records(spark.createDataFrame([], SCHEMA)).count() == 0
