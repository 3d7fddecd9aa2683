import hashlib
import random

from tracewell.llm import substring_dedup
from tracewell.llm.substring_dedup import COVER, PERIOD, WINDOW

from .helpers import SCHEMA, counted, documents, odd_rows, sentence, words_of

LAST = 1 << 62


def plain(rows):
    first = {}
    cut = [(r[0], words_of(r[1])) for r in rows]
    for doc, ws in cut:
        for i in range(len(ws) - WINDOW + 1):
            key = tuple(ws[i:i + WINDOW])
            first[key] = min(first.get(key, LAST), LAST if doc is None else doc)
    out = []
    for doc, ws in cut:
        gone = set()
        for i in range(len(ws) - WINDOW + 1):
            if first[tuple(ws[i:i + WINDOW])] < (LAST if doc is None else doc):
                gone.update(range(i, i + WINDOW))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_every_shift_is_covered():
    for i in range(PERIOD):
        for j in range(PERIOD):
            assert any((i + s) % PERIOD in COVER and (j + s) % PERIOD in COVER for s in range(PERIOD))


def test_odd_rows(spark):
    got = substring_dedup.removals(documents(spark)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert counted(got.collect()) == counted(plain(odd_rows()))


def test_passages_at_all_offsets(spark):
    rng = random.Random(3)
    passage = [sentence(rng, n).split() for n in (49, 50, 51, 80, 120)]
    rows = []
    for doc in range(60):
        parts = []
        for _ in range(3):
            parts += sentence(rng, rng.randint(0, 70)).split() + rng.choice(passage)[:rng.choice([49, 50, 51, 200])]
        rows.append((doc * 7 % 61, " ".join(parts), "en", "a", 0))
    got = substring_dedup.removals(spark.createDataFrame(rows, SCHEMA))
    assert counted(got.collect()) == counted(plain(rows))


def test_deduplicated_texts(spark):
    docs = documents(spark)
    got = substring_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    digests = {(r[0], r[3]) for r in plain(odd_rows())}
    assert got.count() == len(odd_rows())
    for r in got.collect():
        assert (r.doc_id, hashlib.sha256(" ".join(words_of(r.text)).encode()).hexdigest()) in digests


def test_empty(spark):
    assert substring_dedup.removals(spark.createDataFrame([], SCHEMA)).count() == 0
