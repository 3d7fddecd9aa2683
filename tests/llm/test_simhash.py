import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import simhash
from tracewell.llm.components import components

from .helpers import SCHEMA, counted, documents, odd_rows, sentence, words_of

LAST = 1 << 64


def plain_fingerprint(text):
    ws = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(ws[i:i + 4]) for i in range(max(len(ws) - 3, 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        k = find(i)
        least[k] = min(least.get(k, LAST), LAST if d is None else d)
    return [(d, prints[i], None if least[find(i)] == LAST else least[find(i)]) for i, d in enumerate(ids)]


def unsigned(rows):
    return [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows]


def test_odd_rows(spark):
    rows = odd_rows()
    got = simhash.groups(documents(spark)).collect()
    assert counted(unsigned(got)) == counted(plain_groups([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]))


def test_keep_one(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = odd_rows()
    expected = {d for d, _, c in plain_groups([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]) if d == c}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, expected))


def test_masks_cover_every_pair_within_the_radius():
    kept = [m % (1 << 64) for m in simhash.masks()]
    assert len(kept) == 31
    rng = random.Random(1)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & m == 0 for m in kept)


def test_links_of_crowds_and_chains(spark, monkeypatch):
    """A dense ball, a long chain of four-bit steps, and strangers; also with buckets that are too small for them."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(150)]
    step = rng.getrandbits(64)
    for i in range(15):
        values.append(step)
        step ^= sum(1 << (4 * i + k) for k in range(4))
    values = sorted({*values, *(rng.getrandbits(64) for _ in range(50)), 0, 1, (1 << 63) | 1, 1 << 63})
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    expected = plain_groups(signed, values)
    for bucket in (1024, 4):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        found = {r.node: r.component for r in components(simhash.links(
            spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
        assert [found.get(v, v) for v in signed] == [c for _, _, c in expected]


def test_components_of_a_long_path(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.component) for r in components(links).collect()} == {(i, 0) for i in range(301)}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """Few fingerprints, but 31 keys each and 2,081 points: neither side goes through the driver, whatever its estimate."""
    monkeypatch.setattr(simhash, "BUCKET", 4)
    plans, written = [], simhash.written
    plan_of = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash, "written", lambda frame, what: plans.append(plan_of(frame)) or written(frame, what))
    rng = random.Random(9)
    centre = rng.getrandbits(62)
    values = sorted({centre ^ sum(1 << b for b in rng.sample(range(62), rng.randint(0, 3))) for _ in range(60)})
    linked = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    plans.append(plan_of(linked))
    assert linked.count() > 0
    assert sum(p.count("SortMergeJoin") for p in plans) == 2 and not any("Broadcast" in p for p in plans)
