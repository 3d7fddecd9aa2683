import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewell.llm import alignment, catalog
from tracewell.llm.records import tokenizer_path

from .helpers import SCHEMA, counted, documents, odd_rows
from .test_records import TRICKY

MORE = ["a\n\nb", "a  b   c", " lead", "trail ", "\n", " ", "\t x\ty", "x\x00y \x00z", "it's we'll don't", "a▁b", "▁", "a　b c d", "12345 67,890.12",
        "नमस्ते दुनिया", "한국어 텍스트", "é ﬁ ½", "﻿bom ﻿", "<s> </s> <unk> <0x41>", "🧑‍💻 code 👩🏽", "\r\nline\r\n", "foo \nbar", "foo\n bar", "¨ ­"]


def tokens(text, a, b, of):
    """Ids and ends in bytes of both sides, or None where they do not spell space and text."""
    if not text:
        return None
    whole = (" " + text).encode()
    ea, eb = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    names = [a.id_to_token(i) for i in ea.ids]
    sa = [bytes(of[c] for c in t) for t in names]
    sb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in eb]
    if b"".join(sa) != whole or b"".join(sb) != whole:
        return None
    return ea.ids, np.cumsum([len(x) for x in sa]).tolist(), eb, np.cumsum([len(x) for x in sb]).tolist()


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(alignment.FIRST))
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.SECOND)), of


def expected(rows, models):
    groups = []
    for _, text in rows:
        found, of = tokens(text, *models), []
        if found:
            a, a_end, b, b_end = found
            i = j = 0
            a_at, b_at = ({e: n + 1 for n, e in enumerate(x)} for x in (a_end, b_end))
            for cut in sorted(set(a_end) & set(b_end)):
                p, q = a_at[cut], b_at[cut]
                of.append((a[i:p], b[j:q]))
                i, j = p, q
        groups.append(of)
    counts, best = Counter(), defaultdict(int)
    for of in groups:
        counts.update({(x, y) for g in of for x in g[0] for y in g[1]})
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (doc, _), of in zip(rows, groups):
        links = [(x, y) for g in of for x in g[0] for y in g[1]]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in of)
        out.append((doc, sum(len(g[0]) for g in of), sum(len(g[1]) for g in of), len(of), len(links), sum(counts[k] == best[k[0]] for k in links),
                    sum(counts[k] for k in links), hashlib.sha256(shown.encode()).hexdigest() if of else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_odd_texts_and_slices(spark, monkeypatch, models):
    rows = odd_rows() + [(100 + i, t, "en", "a", len(t)) for i, t in enumerate(TRICKY + MORE)]
    want = counted(expected([r[:2] for r in rows], models))
    frame = documents(spark, rows)
    got = alignment.scores(frame)
    assert got.columns == COLUMNS and counted(got.collect()) == want
    assert any(r[1] == 0 and r[0] is not None and r[0] >= 100 for r in want)  # texts with U+2581
    monkeypatch.setattr(alignment, "SLICE", 3000)
    assert counted(alignment.scores(frame).collect()) == want
    assert alignment.scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark, models):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert counted(catalog.op12_token_alignment(spark, "/root/testdata/sf0.001").collect()) == counted(expected(rows, models))


def test_pointers_find_components():
    rng = np.random.default_rng(3)
    for _ in range(50):
        total = int(rng.integers(1, 200))
        ends = [np.unique(np.append(rng.integers(1, total + 1, rng.integers(1, 60)), total)) for _ in range(2)]
        sizes = [np.diff(np.append(0, e)) for e in ends]
        a, b = alignment.labels(ends[0], sizes[0], ends[1], sizes[1])
        cuts = np.intersect1d(*ends)
        for label, end in ((a, ends[0]), (b, ends[1])):
            assert (ends[1][label] == cuts[np.searchsorted(cuts, end)]).all()


def test_small_tables_and_chunks(monkeypatch, models):
    texts = [t or "" for _, t, *_ in odd_rows()] + TRICKY + MORE
    for name, value in (("REMEMBERED", 3), ("TOGETHER", 40)):
        monkeypatch.setattr(alignment, name, value)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "row": pa.array(range(len(texts)), pa.int64()), "text": texts})
    out, = alignment._aligned(tokenizer_path(alignment.FIRST), tokenizer_path(alignment.SECOND))([batch])
    want = expected(list(enumerate(texts)), models)
    assert [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in out.to_pylist()] == [(*w[1:5], w[7]) for w in want]
    alignment.aligner_of.cache_clear()
