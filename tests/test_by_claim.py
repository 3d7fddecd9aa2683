"""What lies by claim is not moved again: counted in the plans."""

import re

import pytest
from pyspark.sql import functions as F

from tracewell.catalog import trail
from tracewell.catalog.registry import Inputs
from tracewell.operators import compare, graph
from tracewell.session import by_claim, configure, kept, spread


@pytest.fixture
def unbroadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    configure(spark)


def moved(frame):
    """What Spark itself moves, beside the rows that a query deals: the keys of every such step."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\), ENSURE", frame._jdf.queryExecution().executedPlan().toString())


def events(spark, tmp_path):
    """Two hundred events, one of them twice, one without a time."""
    rows = spark.range(200).select(
        F.col("id").alias("event_id"), F.when(F.col("id") != 3, F.timestamp_seconds(F.col("id") * 40000 + 1_700_000_000)).alias("ts"))
    rows.union(rows.filter("event_id = 7")).write.parquet(f"{tmp_path}/events.parquet")
    return Inputs(configure(spark), str(tmp_path))


def test_kept_rows_are_the_same_and_lie_by_their_keys(unbroadcast):
    spark = by_claim(unbroadcast)
    frame = spark.createDataFrame([(1, "a", [1.5]), (1, "a", [1.5]), (1, None, None), (None, "b", []), (2, "b", [None])], "k long, s string, v array<double>")
    table = kept(spread(frame, "k"), "k")
    assert sorted(map(str, table.collect())) == sorted(map(str, frame.collect()))
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("kept_")]
    best = table.groupBy("k", "s").agg(F.max(F.size("v")).alias("n"))
    joined = table.join(best, ["k", "s"]).groupBy("k").agg(F.count("*").alias("n"))
    assert not moved(joined) and sorted(map(tuple, joined.collect())) == [(1, 2), (2, 1)]


def test_bound_versions_and_pairs_stay_where_their_claims_are(unbroadcast, tmp_path):
    given = events(unbroadcast, tmp_path)
    paired = compare.pairs(trail.bound(given))
    assert not moved(paired)
    assert not moved(compare.compare_pairs(paired)) and paired.count() > 200


def test_trail_moves_only_ends_of_edges(unbroadcast, tmp_path):
    """Comparisons and mutations stay; of the nodes two narrow columns may be moved to them."""
    made = trail.Trail(events(unbroadcast, tmp_path)).compared()
    assert not moved(made.mutations()) and not moved(graph.derive_edges(made.comparisons, made.mutations()))
    assert not moved(graph.source_nodes(made.versions, made.snaps))
    edges = kept(made.edges(), "claim_id")
    assert edges.count() > 0 and not moved(edges.groupBy("claim_id").count())
    assert "proposition_terms" not in made.versions.columns and "published_ts" in made.bound.columns


def test_latest_versions_are_made_ready_by_themselves(spark, tmp_path):
    """Comparing with an occurrence needs keys and terms of one version a claim, not of all."""
    given = events(spark, tmp_path)
    bound = trail.bound(given)
    seen = trail.occurrences(given, bound).filter(compare.valid_occurrence())
    rows = compare.compare_occurrences(bound, seen)
    same = compare.compare_occurrences(bound.drop(*compare._MADE), seen)
    assert sorted(map(str, rows.collect())) == sorted(map(str, same.collect())) and rows.count() > 0
    configure(spark)
