"""Language field and quality model: exactness of their sums, held-out accuracy, odd rows."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import language_crf, quality_gam
from tracewell.llm.language_crf import Field
from tracewell.llm.tables import table

from .helpers import SCHEMA, crc, documents, odd_rows

DIRECTORY = "/root/testdata/sf0.01"


def plain_posteriors(emissions, first, moves, begin):
    out = np.zeros_like(emissions, float)
    for a, b in zip(first[:-1], first[1:]):
        local, n = np.exp(emissions[a:b].astype(float)), b - a
        if not n:
            continue
        forward, back = np.zeros_like(local), np.ones_like(local)
        for t in range(n):
            forward[t] = (np.exp(begin) if t == 0 else forward[t - 1] @ np.exp(moves)) * local[t]
            forward[t] /= forward[t].sum()
        for t in range(n - 2, -1, -1):
            back[t] = np.exp(moves) @ (back[t + 1] * local[t + 1])
            back[t] /= back[t].sum()
        out[a:b] = forward * back / (forward * back).sum(1, keepdims=True)
    return out


def test_blocks_give_the_sums_of_one_pass():
    rng = np.random.default_rng(3)
    for kinds in (1, 2, 5):
        sizes = [0, 1, 31, 32, 33, 64, 200, 0, 1000, 3]
        first = np.concatenate([[0], np.cumsum(sizes)])
        emissions = rng.normal(0, 3, (first[-1], kinds)).astype(np.float32)
        moves, begin = rng.normal(0, 2, (kinds, kinds)).astype(np.float32), rng.normal(0, 1, kinds).astype(np.float32)
        field = Field([str(i) for i in range(kinds)], None, moves, begin, None)
        assert np.allclose(field.posteriors(emissions, first), plain_posteriors(emissions, first, moves, begin), atol=2e-4)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    kinds, length = 3, 5
    emissions, moves, begin = rng.normal(size=(1, length, kinds)), rng.normal(size=(kinds, kinds)), rng.normal(size=kinds)
    truth = rng.integers(0, kinds, (1, length))

    def likelihood(e, m, b):
        def value(path):
            return b[path[0]] + sum(e[0, t, k] for t, k in enumerate(path)) + sum(m[x, y] for x, y in zip(path, path[1:]))
        return value(truth[0]) - np.log(sum(np.exp(value(p)) for p in itertools.product(range(kinds), repeat=length)))

    by_word, by_move, by_begin = language_crf._likelihood_step(np.exp(emissions), np.exp(moves), np.exp(begin), truth)
    for values, gradient, at in ((emissions, by_word, 0), (moves, by_move, 1), (begin, by_begin, 2)):
        for i in np.ndindex(*values.shape):
            up, down = [emissions.copy(), moves.copy(), begin.copy()], [emissions.copy(), moves.copy(), begin.copy()]
            up[at][i] += 1e-5
            down[at][i] -= 1e-5
            assert abs((likelihood(*up) - likelihood(*down)) / 2e-5 - gradient[i]) < 1e-5


def test_language_held_out(spark):
    docs = table(spark, DIRECTORY, "documents")
    rows = language_crf.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_code_switched_words(spark):
    docs = table(spark, DIRECTORY, "documents")
    field = language_crf.train(*language_crf.sample(docs, F.lit(True), most=100))
    long = {r.lang: r.text for r in docs.filter("n_chars > 2000 AND text NOT LIKE '%***%'").select("lang", "text").collect()}
    parts = [long["de"].split()[:40], long["es"].split()[:40], long["fr"].split()[:40]]
    mixed = spark.createDataFrame([(1, " ".join(sum(parts, []))), (2, None), (3, "...")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in language_crf.language_spans(mixed, field).collect()}
    assert [s.lang for s in spans[1] if s.last_word - s.first_word > 15] == ["de", "es", "fr"]
    assert spans[2] == spans[3] == []


def test_language_odd_rows(spark):
    docs = documents(spark)
    got = language_crf.identify(docs).collect()
    rows = odd_rows()
    assert len(got) == len(rows)
    text = {}
    for d, t, *_ in rows:
        text.setdefault(d, []).append(t)
    for r in got:
        if r.lang_pred == "und":
            assert r.score == 0 and any(not t or not any(c.isalpha() for c in t) for t in text[r.doc_id])
        else:
            assert r.lang_pred in {"en", "de", "fr", "es"}
    kept = language_crf.known_language(docs, 0.0)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in got if r.lang_pred != "und")
    # nothing to learn from
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language_crf.identify(bare).collect()} == {("und", 0.0)}
    assert language_crf.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quality_held_out(spark):
    docs, labels = table(spark, DIRECTORY, "documents"), table(spark, DIRECTORY, "labels")
    rows = quality_gam.classify(docs, labels).join(labels, "doc_id", "left").collect()
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93


def test_quality_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(10, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 1), (8, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0), labels.filter("quality = 1")):
        got = quality_gam.classify(docs, some).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_gam.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_gam.classify(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_pairs_learn_what_no_single_feature_shows():
    rng = np.random.default_rng(2)
    rows = rng.random((4000, 3))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(rows[:3000], labels[:3000])
    assert np.mean((model.score(rows[3000:]) >= 0.5) == labels[3000:]) > 0.93


@pytest.mark.parametrize("text", ["", "a", "a b a b", "x\ny\nx\n", "é é", "!! ??"])
def test_measures_of_small_texts(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    got = dict(zip(quality_gam.FEATURES, quality_gam.measure(raw, np.array([0, len(raw)]))[0]))
    ws, lines = text.split(), [x for x in text.splitlines() if x]
    assert got["log_words"] == np.log1p(len(ws)) and got["distinct_words"] == (len(set(ws)) / len(ws) if ws else 1)
    assert got["distinct_lines"] == (len(set(lines)) / len(lines) if lines else 1)


def test_no_language_to_learn_from(spark):
    rows = [(d, t, None, s, n) for d, t, _, s, n in odd_rows()]
    kept = language_crf.known_language(documents(spark, rows), 0.4)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t, *_ in rows if any(c.isalpha() for c in t or ""))
    assert kept.columns == documents(spark, rows).columns
