import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tracewell.llm import exact_dedup, mixing

from .helpers import SCHEMA, documents, odd_rows, words_of


def check_groups(got, rows):
    by = defaultdict(list)
    for d, t, *_ in rows:
        by[t or ""].append(d)
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in rows)
    sizes = {hashlib.sha256(t.encode()).hexdigest(): ds for t, ds in by.items()}
    kept = Counter()
    for r in got:
        ds = sizes[r.text_sha256]
        known = [d for d in ds if d is not None]
        assert r.group_size == len(ds) and r.keep_id == (max(known) if known else None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) <= {1}


def test_exact_odd_rows(spark):
    check_groups(exact_dedup.deduplicate(documents(spark)).collect(), odd_rows())
    assert exact_dedup.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunks_are_the_text_and_follow_its_content(spark):
    long = max((r[1] for r in odd_rows() if r[1]), key=len).replace(" alpha", ". alpha")
    texts = [long, "X" + long, "", "no end" * 3000, "\n.\n" * 2000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact_dedup.chunks(F.col("t")).alias("c")).collect()
    assert all("".join(r.c) == r.t for r in rows)
    a, b = rows[0].c, rows[1].c
    assert len(a) > 50 and len(set(a) & set(b)) > 0.9 * len(a)


def test_identifiers_with_two_contents(spark, monkeypatch):
    """A dictionary that doubts identifiers makes recipes wide, and groups stay the same."""
    real = exact_dedup.chunk_dictionary
    monkeypatch.setattr(exact_dedup, "chunk_dictionary", lambda t: real(t).withColumn("verified", F.col("id") % 2 == 0))
    for most in (1000, 1):
        monkeypatch.setattr(exact_dedup, "MOST_UNVERIFIED", most)
        check_groups(exact_dedup.deduplicate(documents(spark)).collect(), odd_rows())


def test_dictionary_finds_two_contents(spark):
    table = spark.createDataFrame([([(1, b"a", 1), (2, b"b", 1)],), ([(1, b"c", 1)],)], "chunks array<struct<id:long,check:binary,size:int>>")
    assert {(r.id, r.uses, r.verified) for r in exact_dedup.chunk_dictionary(table).collect()} == {(1, 2, False), (2, 1, True)}


def test_main_paths_run_no_python(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    for frame in (exact_dedup.deduplicate(docs), mixing.plan(docs), mixing.emit(docs)):
        plan = frame._jdf.queryExecution().toString()
        assert "EvalPython" not in plan and "MapIn" not in plan


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left = {}, float(sum(sizes.values()))
    open_ = set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= most * sizes[s]
        open_ -= over
    return target


def test_mixing_odd_rows(spark):
    rows = odd_rows()
    docs = documents(spark)
    got = mixing.plan(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(words_of(t))
    targets = plain_targets(sizes)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, len(words_of(t))) for d, t, _, s, _ in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6
        rate = r.target / r.source_size if r.source_size else 1
        assert r.taken == r.copies * r.size and rate - 1 < r.copies < rate + 1 and r.copies <= 3
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +Counter({d: n for d, n in Counter(
        {}).items()}) + sum((Counter({r.doc_id: r.copies}) for r in got), Counter())
    assert mixing.plan(spark.createDataFrame([], SCHEMA)).count() == 0 and mixing.emit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sources_come_near_their_targets(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 1 + cast(id % 50 AS int))").alias("text"),
                                      F.expr("CASE WHEN id % 3 = 0 THEN 'big' WHEN id % 100 = 1 THEN 'small' ELSE concat('s', id % 7) END").alias("source"))
    rows = mixing.plan(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.06 * r.target for r in rows)
    assert abs(sum(r.target for r in rows) - mixing.plan(docs).agg(F.sum("size")).first()[0]) < 1
