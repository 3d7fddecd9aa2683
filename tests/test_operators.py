"""Whole operators: invariants, brute force on small fixtures, and order independence."""

import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tracewell.catalog import trail
from tracewell.catalog.registry import Inputs
from tracewell.functions import patterns
from tracewell.operators import compare, graph, history, index, matching, ranking, records, vectors, versions
from tracewell.sources import images
from tracewell.session import TABLE_PARTITIONS
from tracewell.streaming import jobs


def test_library_routes_its_own_wordings(spark):
    library = spark.createDataFrame([
        (1, "The blackout was caused by European sanctions on Russia", ["Sanctions blamed for blackout"]),
        (2, "Whales were found covered in barnacles", ["Barnacles on whales"])], "record_id long, canonical_claim string, aliases array<string>")
    claims = spark.createDataFrame([
        (1, "The blackout was caused by European sanctions on Russia"), (2, "Barnacles on whales"),
        (3, "The blackout was not caused by European sanctions on Russia"), (4, "A bakery sells bread")], "claim_id long, claim string")
    found = matching.deterministic_matches(claims, matching.lexical_only(matching.lexical_scores(claims, library)))
    got = {r["claim_id"]: (r["record_id"], r["confidence"]) for r in found.collect()}
    assert got[1] == (1, 1.0) and got[2] == (2, 1.0)
    assert got[3][1] < 0.34 and got[4] == (None, 0.0)


def test_scores_do_not_depend_on_partitioning(spark):
    library = spark.createDataFrame([(i, f"w{i} w{i % 3} shared words here", ["shared w1"]) for i in range(20)],
                                    "record_id long, canonical_claim string, aliases array<string>")
    claims = spark.createDataFrame([(i, f"shared w{i % 7} here") for i in range(40)], "claim_id long, claim string")
    once = sorted(map(tuple, matching.lexical_scores(claims, library).collect()))
    again = sorted(map(tuple, matching.lexical_scores(claims.orderBy(F.rand(1)).repartition(5), library.repartition(3)).collect()))
    assert once == again


def test_claims_are_dealt_by_the_pairs_they_can_make(spark, monkeypatch):
    """Narrow claims with many pairs: the parts grow with the claims, and their number is one that AQE leaves alone."""
    library = spark.createDataFrame([(i, f"w{i} shared words here", ["shared w1"]) for i in range(20)],
                                    "record_id long, canonical_claim string, aliases array<string>")
    claims = spark.createDataFrame([(i, f"shared w{i % 7} here") for i in range(60)], "claim_id long, claim string")
    want = sorted(map(tuple, matching.lexical_scores(claims, library).collect()))
    monkeypatch.setattr(matching, "PART_CLAIMS", 2)
    monkeypatch.setattr(matching, "PART_PAIRS", 80)
    assert matching.claim_parts(claims, library) == 30  # 60 claims, 40 wordings
    found = matching.lexical_scores(claims, library)
    assert ", 30), REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == want


def test_ordinals_equal_row_number_on_a_hot_key(spark):
    random.seed(1)
    rows = [(random.choice([1, 1, 1, 2]), random.randint(0, 500), i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "k int, v int, i int")
    got = {(r["i"]): r["ordinal"] for r in ranking.ordinals(
        frame, ["k"], [F.desc("v"), F.asc("i")], [F.floor(-F.col("v") / 50)]).collect()}
    for key in (1, 2):
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in ordered] == list(range(1, len(ordered) + 1))


def some_library(spark):
    """3,000 records that all hold one term, a third of them nothing else; negations, aliases, repeated wordings."""
    random.seed(21)
    words = [f"word{i}" for i in range(300)]
    text = lambda i: " ".join(["common", *random.sample(words, random.randint(1, 6)), *(["never", random.choice(words)] if i % 11 == 0 else [])])
    rows = [(i, "common" if i % 3 == 0 else text(i), [text(i)] if i % 5 == 1 else None) for i in range(3000)]
    library = spark.createDataFrame(rows, "record_id long, canonical_claim string, aliases array<string>")
    asked = [(i, text(i)) for i in range(60)] + [(100, "common"), (101, "common unheard"), (102, "never common"), (103, ""), (104, None), (105, "common " + words[0])]
    return library, spark.createDataFrame(asked, "claim_id long, claim string")


def test_index_equals_scoring_all_and_prunes(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 64)
    library, claims = some_library(spark)
    known = index.library_index(library)
    every = matching.candidates(matching.lexical_only(matching.lexical_scores(claims, library)))
    want = sorted((r["claim_id"], r["record_id"], r["rank"], r["score"]) for r in every.collect())
    found = matching.candidates(index.best_records(claims, known, 4))
    assert sorted((r["claim_id"], r["record_id"], r["rank"], r["score"]) for r in found.collect()) == want
    pairs = {r["claim_id"]: r["count"] for r in index.promising(index.profiles(claims, known), known, 4).groupBy("claim_id").count().collect()}
    assert pairs[100] == pairs[101] == 4  # a term in every record, a thousand of them with equal scores
    assert sum(pairs.values()) < 0.1 * sum(1 for _ in claims.collect()) * 3000
    assert known.blocks.filter("term = 'common'").count() == -(-3000 // 64)
    nothing = index.library_index(library.limit(0))
    assert index.best_records(claims, nothing, 4).count() == 0 and index.best_records(claims.limit(0), known, 4).count() == 0


def test_pieces_of_the_index_are_scored_without_a_table_of_pairs(spark, monkeypatch):
    """Small pieces met by few claims at a time, repeated claims and null ids; no plan moves pairs of a claim and a record."""
    monkeypatch.setattr(index, "PIECE", 200)
    monkeypatch.setattr(index, "PIECE_CLAIMS", 7)
    library, claims = some_library(spark)
    library = library.union(library.limit(5).withColumn("record_id", F.lit(None).cast("long")))
    claims = claims.union(claims.filter("claim_id % 5 = 0"))
    known = index.library_index(library)
    asked = index.profiles(claims, known)
    every = library.filter("record_id IS NOT NULL").select("record_id").distinct().crossJoin(asked.select("claim_id"))
    want = matching.top_k(index.pair_scores(every, asked, known), ["claim_id"], [F.desc("score"), F.asc("record_id")], 4)
    best = index.best_records(claims, known, 4)
    columns = ["claim_id", "record_id", "score"]
    assert known.pieces.select("piece").distinct().count() == 15
    assert sorted(map(str, best.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert "FlatMapCoGroupsInArrow" in best._jdf.queryExecution().optimizedPlan().toString()


def test_stream_reads_one_index_and_repeats_no_batch(spark, tmp_path, monkeypatch):
    """Two runs with one checkpoint: the index is written once, and each claim is in the table once."""
    library, claims = some_library(spark)
    built = []
    monkeypatch.setattr(index, "write_index", lambda r, f, w=index.write_index: built.append(f) or w(r, f))
    folder = {n: str(tmp_path / n) for n in ("in", "table", "checkpoint", "library")}
    for part in (claims.filter("claim_id < 30"), claims.filter("claim_id >= 30")):
        part.coalesce(1).write.mode("append").parquet(folder["in"])
        stream = spark.readStream.schema(claims.schema).parquet(folder["in"])
        jobs.match_stream(stream, library, folder["table"], folder["checkpoint"], folder["library"]).awaitTermination()
    assert len(built) == 1
    got = spark.read.parquet(folder["table"])
    want = matching.deterministic_matches(claims, matching.lexical_only(matching.lexical_scores(claims, library)))
    columns = ["claim_id", "record_id", "confidence", "ambiguous"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert got.select("batch").distinct().count() == 2


def test_shortlists_are_filled_past_denied_records(spark):
    """Brute force: the best, then the library's ids in order without the best and the denied, however many those are."""
    random.seed(5)
    library = spark.createDataFrame([(i, "x", None) for i in range(0, 400, 2)], "record_id long, canonical_claim string, aliases array<string>")
    pairs = {(c, r): (random.random(), random.random() < 0.5) for c in range(12) for r in random.sample(range(0, 400, 2), 3 * c)}
    pairs |= {(20, r): (0.5, True) for r in range(0, 398, 2)} | {(21, r): (0.5, True) for r in range(0, 400, 2)} | {(22, r): (0.5, False) for r in range(0, 400, 2)}
    scores = spark.createDataFrame([(c, r, s, d) for (c, r), (s, d) in pairs.items()], "claim_id long, record_id long, score double, conflict boolean")
    asked = [*range(12), 20, 21, 22, 30]
    claims = spark.createDataFrame([(c,) for c in asked], "claim_id long")
    want = {}
    for c in asked:
        best = [r for _, r in sorted((-s, r) for (q, r), (s, d) in pairs.items() if q == c and not d)][:6]
        want[c] = (best + [r for r in range(0, 400, 2) if r not in best and not pairs.get((c, r), (0, False))[1]])[:6]
    got = {r["claim_id"]: r["shortlist"] for r in matching.shortlists(claims, scores, library, 6).collect()}
    assert got == {c: ids for c, ids in want.items() if ids} and 21 not in got


def test_range_ordinals_on_a_hot_key(spark):
    """Undated rows and one hot user on one day, spread over several ranges."""
    rows = [(None if i % 50 == 0 else 1 if i % 9 else 2, None if i % 3 == 0 else i % 4, i) for i in range(6000)]
    frame = spark.createDataFrame(rows, "k int, v int, i int")
    got = ranking.range_ordinals(frame, ["k"], [F.asc_nulls_last("v"), F.asc("i")])
    found = {r["i"]: r["ordinal"] for r in got.collect()}
    for key in (None, 1, 2):
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        assert [found[r[2]] for r in ordered] == list(range(1, len(ordered) + 1))
    assert ranking.range_ordinals(frame.limit(0), ["k"], [F.asc("i")]).count() == 0


def test_clusters_out_of_reach_are_not_joined(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(20, 8))
    around = lambda n: (middles[rng.integers(0, 20, n)] + rng.normal(scale=0.02, size=(n, 8))) * rng.uniform(0.5, 3, (n, 1))
    known, asked = np.vstack([around(900), np.zeros((2, 8))]), np.vstack([around(60), np.zeros((1, 8))])
    library = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(known)], "record_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "claim_id long, embedding array<double>")
    found = vectors.nearest(queries.withColumn("also", F.array(F.lit(901).cast("long"))), library, 3, 40).filter("rank <= 3").collect()
    length = lambda m: np.linalg.norm(m, axis=1)
    scale = np.outer(length(asked), length(known))
    cosine = np.divide(asked @ known.T, scale, out=np.zeros_like(scale), where=scale > 0)
    for i, row in enumerate(cosine):
        best = sorted((-round(s, 9), j) for j, s in enumerate(row))[:3]
        got = sorted((-round(r.semantic, 9), r.record_id) for r in found if r.claim_id == i)
        assert [s for s, _ in got] == [s for s, _ in best] and (i == 60 or got == best)
    index = vectors.build(library, 40)
    members = sum(np.isfinite(index.radii))
    limits = queries.filter("claim_id < 60").join(spark.createDataFrame(
        [(i, float(np.sort(r)[-3])) for i, r in enumerate(cosine)], "claim_id long, third double"), "claim_id")
    left = limits.select(F.explode(vectors.clusters_of(index, F.col("embedding"), F.col("third")))).count()
    assert members > 10 and left < 0.3 * 60 * (members - vectors.PROBES)
    for few in (library.limit(0), library.filter("record_id >= 900")):
        assert vectors.nearest(queries.withColumn("also", F.array().cast("array<long>")), few, 3, 40).count() == 61 * few.count()


def test_vector_blocks_give_the_same_result(spark, monkeypatch):
    random.seed(2)
    vector = lambda: [random.uniform(-1, 1) for _ in range(4)]
    queries = spark.createDataFrame([(i, vector()) for i in range(20)], "claim_id long, embedding array<double>")
    library = spark.createDataFrame([(i // 2, vector()) for i in range(30)], "record_id long, embedding array<double>")
    rows = lambda q: sorted((r["claim_id"], r["record_id"], round(r["semantic"], 9)) for r in matching.vector_scores(q, library, 3).collect())
    whole = rows(queries)
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    known = library.collect()
    expected = []
    for q in queries.collect():
        best = {}
        for v in known:
            best[v["record_id"]] = max(best.get(v["record_id"], -2), cosine(q["embedding"], v["embedding"]))
        expected += [(q["claim_id"], k, round(s, 9)) for k, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:3]]
    assert whole == sorted(expected)
    monkeypatch.setattr(matching, "BLOCK_ROWS", 4)
    assert rows(queries) == whole
    named = rows(queries.withColumn("also", F.array(F.lit(14).cast("long"))))  # asked for by name, whatever its rank
    assert set(whole) < set(named) and {q for q, r, _ in named if r == 14} == set(range(20))


def brute_limiter(events, width, limit):
    out, opened, used = {}, {}, {}
    for key, ts, number in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if key not in opened or ts - opened[key] >= width:
            opened[key], used[key] = ts, 0
        out[number] = used[key] < limit
        used[key] += out[number]
    return out


def some_events():
    random.seed(3)
    start = dt.datetime(2024, 1, 1)
    return [(random.choice("aab"), start + dt.timedelta(seconds=random.randint(0, 4000)), i) for i in range(800)]


def test_limiter_equals_brute_force(spark):
    events = some_events()
    frame = spark.createDataFrame(events, "key string, ts timestamp, event_id long")
    got = {r["event_id"]: r["allowed"] for r in history.limited_requests(frame, 60, 4).collect()}
    assert got == brute_limiter(events, dt.timedelta(seconds=60), 4)


def test_limiter_of_a_key_that_never_pauses(spark):
    """Some thousand windows in a row, null keys and repeated times; pointer doubling and no Python in the plan."""
    start = dt.datetime(2024, 1, 1)
    random.seed(9)
    events = [("busy", start + dt.timedelta(seconds=7 * i + random.random()), i) for i in range(6000)]
    events += [("busy", events[i][1], 10_000 + i) for i in range(0, 6000, 9)] + [("exact", start + dt.timedelta(seconds=60 * i), 20_000 + i) for i in range(50)]
    frame = spark.createDataFrame([*events, *[(None, start + dt.timedelta(seconds=i), 30_000 + i) for i in range(100)]], "key string, ts timestamp, event_id long")
    got = history.limited_requests(frame, 60, 4)
    plan = got._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Arrow" not in plan
    found = {r["event_id"]: r["allowed"] for r in got.collect()}
    events += [("", start + dt.timedelta(seconds=i), 30_000 + i) for i in range(100)]
    assert found == brute_limiter(events, dt.timedelta(seconds=60), 4)


def test_image_files_are_read_from_a_folder(spark, tmp_path):
    """Files on disk, a copy among them, through the binary source."""
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\0" * 9
    bmp = b"BM" + b"\0" * 16 + (70).to_bytes(4, "little") + (50).to_bytes(4, "little")
    (tmp_path / "deep").mkdir()
    for name, content in {"a.png": png, "b.png": png, "c.bmp": bmp, "deep/d.png": png + b"x", "e.txt": b"no image", "f.png": b""}.items():
        (tmp_path / name).write_bytes(content)
    found = images.image_ledger(images.read_images(spark, str(tmp_path)))
    got = {r["path"].rsplit("/", 1)[1]: r for r in found.collect()}
    assert {n: (r["format"], r["width"], r["height"], r["byte_length"]) for n, r in got.items() if r["format"]} == {
        "a.png": ("png", 640, 480, len(png)), "b.png": ("png", 640, 480, len(png)), "c.bmp": ("bmp", 70, 50, len(bmp)), "d.png": ("png", 640, 480, len(png) + 1)}
    assert {n: r["verdict"] for n, r in got.items()} == {
        "a.png": "accepted", "b.png": "accepted", "c.bmp": "accepted", "d.png": "accepted", "e.txt": "unsupported"}  # Spark skips files without bytes
    assert [tuple(r)[1:] for r in images.duplicate_images(found).filter("copies > 1").collect()] == [(2, got["a.png"]["path"])]
    pruned = images.read_images(spark, str(tmp_path), names="*.png", most_bytes=len(png), since="2000-01-01")
    assert "GreaterThanOrEqual(m" in pruned._jdf.queryExecution().toString()  # a pushed filter, as the plan shortens it
    assert sorted(r["path"].rsplit("/", 1)[1] for r in pruned.collect()) == ["a.png", "b.png"]
    assert images.read_images(spark, str(tmp_path), since="2999-01-01").count() == 0


def test_reachability_handles_cycles(spark):
    links = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "c", "b"), ("g", "x", "y")], "graph_id string, source string, target string")
    seeds = spark.createDataFrame([("g", "c")], "graph_id string, node string")
    assert {(r["node"], r["hop"]) for r in graph.reachable(links, seeds).collect()} == {("c", 0), ("b", 1), ("a", 2)}


def test_levels_stop_on_cycles(spark):
    links = spark.createDataFrame([("g", "a", "b"), ("g", "b", "a")], "graph_id string, source string, target string")
    nodes = spark.createDataFrame([("g", "a"), ("g", "b")], "graph_id string, node string")
    assert graph.levels(nodes, links).count() == 2


def test_levels_by_peeling_equal_rounds(spark, monkeypatch):
    """Random graphs with and without cycles, a deep chain, self-loops, unknown ends: as many rounds as levels."""
    random.seed(12)
    links = [(f"g{g}", random.randint(0, 11), random.randint(0, 11)) for g in range(12) for _ in range(g + 4)]
    links = [(g, a, b) if int(g[1:]) % 2 else (g, min(a, b), max(a, b) + 1) for g, a, b in links]  # even graphs have no cycle
    links += [("deep", i, i + 1) for i in range(30)] + [("deep", 0, 30), ("deep", 5, 99), ("loop", 1, 1), ("loop", 1, 2)]
    nodes = {(g, x) for g, *ends in links for x in ends if x != 99} | {("alone", 1)}
    link_frame = spark.createDataFrame(links, "graph_id string, source long, target long")
    node_frame = spark.createDataFrame(sorted(nodes), "graph_id string, node long")
    want = {tuple(r) for r in graph.levels_in_rounds(node_frame, link_frame).collect()}
    rounds = []
    monkeypatch.setattr(graph, "levels_in_rounds", lambda n, e, f=graph.levels_in_rounds: rounds.append(n.select("graph_id").distinct().count()) or f(n, e))
    assert {tuple(r) for r in graph.levels(node_frame, link_frame).collect()} == want
    assert rounds and rounds[0] <= 7 and ("deep", 30, 30) in want


def test_broken_records_are_reported(spark):
    hop = "array<struct<type: string>>"
    rel = "array<struct<from_node_id: string, to_node_id: string>>"
    rows = spark.createDataFrame([
        ("a", [("original_event",)], [("origin", "hop-1"), ("hop-1", "hop-1"), ("hop-5", "hop-1"), ("origin", "hop-4")]),
        ("b", [("original_event",)], []), ("b", [("original_event",)], [])], f"record_id string, hops {hop}, relationships {rel}")
    got = {(r["record_id"], r["position"], r["violation"]) for r in records.validate_records(rows).collect()}
    assert got == {("a", 2, "self_loop"), ("a", 3, "missing_source"), ("a", 4, "missing_target"), ("b", 0, "duplicate_id")}


def test_activity_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(k, t, i) for k, t, i in some_events()], "user_id string, ts timestamp, event_id long")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = (jobs.activity_stream(stream).writeStream.outputMode("complete").format("memory").queryName("activity")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("activity").collect())) == sorted(map(tuple, history.activity(events).collect()))


def test_limiter_stream_equals_brute_force(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = some_events()
    frame = spark.createDataFrame(events, "key string, ts timestamp, event_id long")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    run = (jobs.limited_stream(stream, 60, 4).writeStream.outputMode("append").format("memory").queryName("limited")
           .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    run.awaitTermination()
    got = {r["event_id"]: r["allowed"] for r in spark.table("limited").collect()}
    assert got == brute_limiter(events, dt.timedelta(seconds=60), 4)


def test_an_investigation_of_given_pages(spark):
    """From hits and pages to one row per claim, all on the given text."""
    from tracewell.catalog import QUERIES

    rows = QUERIES["results"](spark, "/root/testdata/sf0.001").collect()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert sorted(r.claim_id for r in rows) == list(range((pages + 9) // 10))
    for r in rows:
        assert [s.stage_id for s in r.stages] == [
            "claim_extracted", "live_search", "source_discovery", "earliest_source", "context_comparison", "mutation_detection",
            "origin_assessment", "lineage"]
        assert r.trace_status in ("UNTRACED", "PARTIALLY_TRACED", "TRACED") and len(r.candidates) <= 4
        assert [c.confidence for c in r.candidates] == sorted((c.confidence for c in r.candidates), reverse=True)
    assert any(f.startswith("comparisons:") for r in rows for f in r.found)


def events_table(spark, tmp_path, number):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 20)) for i in range(number)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return Inputs(spark, str(tmp_path))


def test_sources_of_one_file_are_dealt_over_all_partitions_of_a_shuffle(spark, tmp_path):
    t = events_table(spark, tmp_path, 400)
    kept = spark.conf.get(TABLE_PARTITIONS)
    spark.conf.unset(TABLE_PARTITIONS)
    try:
        sizes = trail.snapshots(t).rdd.glom().map(len).collect()
    finally:
        spark.conf.set(TABLE_PARTITIONS, kept)
    assert sum(sizes) == 400 and sum(n > 0 for n in sizes) >= 6


def test_pairs_are_made_from_one_reading_of_the_versions(spark, tmp_path):
    bound = trail.bound(events_table(spark, tmp_path, 100))
    paired = compare.pairs(bound)
    plan = paired._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("events.parquet") == bound._jdf.queryExecution().optimizedPlan().toString().count("events.parquet")
    rows = bound.select("claim_id", "source_id", "ordinal").collect()
    expected = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2])
    assert expected and sorted(map(tuple, paired.select("claim_id", "l.source_id", "r.source_id").collect())) == expected


def test_a_comparison_is_worked_out_once_for_its_changes(spark, tmp_path):
    """A condition that the list of changes is not empty would be pushed below the comparison, with all that makes it."""
    compared = compare.compare_pairs(compare.pairs(trail.bound(events_table(spark, tmp_path, 100))))
    changes = compare.changes_of(compared)
    assert changes._jdf.queryExecution().optimizedPlan().toString().count("context_removed") == 1
    rows = compared.select("claim_id", "from_source_id", "to_source_id", "changes").collect()
    expected = sorted((r[0], r[1], r[2], i, c["type"]) for r in rows for i, c in enumerate(r[3]))
    assert expected and any(not r[3] for r in rows)
    assert sorted(map(tuple, changes.select("claim_id", "from_source_id", "to_source_id", "ord", "type").collect())) == expected


def test_passages_are_scored_once(spark, tmp_path):
    """A filter on the chosen passage would be pushed below it, with all that chooses it."""
    t = events_table(spark, tmp_path, 10)
    plan = versions.select_passages(trail.snapshots(t), trail.claims(t))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort") == 1


def test_patterns_mean_the_same_with_and_without_other_alphabets(spark):
    random.seed(5)
    pieces = ["may", "É", "été", "_", " ", "\t", " ", " ", "\x1f", "maybe", "AND may", "mayé", "3may", "ſ", "K", "at least", "-", "\n"]
    texts = ["".join(random.choices(pieces, k=random.randint(0, 6))) for _ in range(600)] + [None, ""]
    frame = spark.createDataFrame([(x,) for x in texts], "x string")
    x = F.col("x")
    for pattern in (r"\bmay\b", r"\bat\s+least\b", r"^\S+\s", r"\b(?:may|and)\s*\b"):
        for ignore_case in (True, False):
            general = x.rlike(patterns.java(pattern, ignore_case))
            assert frame.filter(~patterns.found(x, pattern, ignore_case).eqNullSafe(general)).count() == 0
            taken = F.regexp_extract(x, patterns.java(pattern, ignore_case), 0)
            fast = patterns.by_alphabet(x, pattern, ignore_case, lambda p: F.regexp_extract(x, p, 0))
            assert frame.filter(~taken.eqNullSafe(fast)).count() == 0


def test_claim_stream_reads_a_table_of_several_files(spark, tmp_path):
    turns = [(i, 0, "user", f"The bridge number {i} was closed by a storm.") for i in range(20)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    items = spark.createDataFrame([(1, "The bridge number 3 was closed by a storm."), (2, "Bread is sold.")], "item_id long, text string")
    for name, parts in (("one", 1), ("folder", 4)):
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        frame.repartition(parts).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    file = next((tmp_path / "one" / "conversations.parquet").glob("*.parquet"))
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "conversations.parquet").write_bytes(file.read_bytes())
    items.write.parquet(f"{tmp_path}/file/benchmark.parquet")
    got = [sorted(map(tuple, jobs.match_conversations(spark, f"{tmp_path}/{name}").collect())) for name in ("file", "one", "folder")]
    assert got[0] == got[1] == got[2] and len(got[0]) == 20
