"""Registered queries against their SQL, and the pipeline's stages against plain versions."""

import math
import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tracewell.llm import mixing
from tracewell.llm.catalog import ORACLES, QUERIES
from tracewell.llm.tables import table, written

from .helpers import counted, words_of
from .test_decontaminate import budget, words
from .test_near_copies import kept, plain_kept
from .test_records import plain as plain_records

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in sorted(os.listdir(DIRECTORY)):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{DIRECTORY}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    frame = QUERIES[name](spark, DIRECTORY)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    near = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    got = [tuple(near(r[c]) for c in columns) for r in frame.collect()]
    assert counted(got) == counted(tuple(map(near, r)) for r in result.fetchall())


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "test_items", "mixture", "token_records"]
    docs = table(spark, DIRECTORY, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, DIRECTORY), "stage")
        after = docs.collect()
        if name != "token_records":
            assert docs.columns == columns
        if name == "language":
            assert {r.doc_id for r in after} == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
        elif name == "near_copies":
            assert kept(docs) == plain_kept([(r.doc_id, r.text) for r in before])
        elif name == "test_items":
            items = [(i.item_id, words(i.text)) for i in table(spark, DIRECTORY, "benchmark").collect()]
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            exact = {r.doc_id for r in before for _, p in items if b" " + b" ".join(p) + b" " in b" " + b" ".join(words(r.text)) + b" "}
            assert exact and exact <= gone
        elif name == "mixture":
            sizes = Counter()
            for r in after:
                sizes[r.source] += len(words_of(r.text))
            copies = Counter(r.doc_id for r in after)
            assert copies == +Counter({r.doc_id: r.copies for r in mixing.plan(spark.createDataFrame(before, docs.schema)).collect()})
        else:
            assert sorted(map(tuple, after), key=lambda r: r[1]) == plain_records([(r.doc_id, r.text) for r in before])


def test_run(spark):
    rows = corpus_pipeline.run(spark, DIRECTORY).orderBy("start").collect()
    assert rows and rows[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
