"""One investigation, from the sources found for claims to a result row per claim."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import confidence_band
from tracewell.operators import compare, graph, matching, mutations, origin, rollup, versions
from tracewell.session import cut

#: What a submitter may say about the source an occurrence came from.
RELATIONSHIP = (
    "struct<from_source_id: string, relationship: string, status: string, confidence: double, "
    "evidence: array<struct<source_id: string, passage_id: string, exact_text: string, role: string>>>"
)


def investigate(claims: DataFrame, snaps: DataFrame, occurrences: DataFrame) -> dict[str, DataFrame]:
    """Versions, comparisons, mutations, graph, origins and stages of every claim.

    ``claims`` carries what the stages need (``evidence_id``, ``search_status``, ``search_ids``,
    ``acquisition_failed``); ``snaps`` are the snapshots of its sources; ``occurrences`` come from
    ``build_occurrences``, with a ``source_relationship`` if one was supplied.  A claim without any source keeps
    its rows: every step is a join per claim, and what is read several times is written once.
    """
    if "source_relationship" not in occurrences.columns:
        occurrences = occurrences.withColumn("source_relationship", F.lit(None).cast(RELATIONSHIP))
    snaps, occurrences = cut(snaps), cut(occurrences)
    made = cut(versions.extract_versions(snaps, claims))
    bound = cut(compare.bound_versions(made, snaps))
    compared = cut(compare.compare_pairs(compare.pairs(bound)).unionByName(
        compare.compare_occurrences(bound, occurrences.filter(compare.valid_occurrence()))))
    changed = cut(mutations.detect_mutations(compared))
    node_table = cut(graph.nodes(claims, made, snaps, occurrences))
    edge_table = cut(graph.edges(compared, changed, node_table))
    summary = cut(graph.summarize(node_table, edge_table, graph.ancestors(edge_table, node_table)))
    origins = cut(origin.assess_origin(origin.sourced_versions(made, snaps), claims))
    return dict(
        claims=claims, snaps=snaps, occurrences=occurrences, versions=made, comparisons=compared, mutations=changed,
        nodes=node_table, edges=edge_table, graph=summary, origins=origins,
        stages=cut(rollup.stage_table(claims, snaps, compared, changed, origins, summary)))


def results(tables: dict[str, DataFrame], records: DataFrame) -> DataFrame:
    """One row per claim: status, match and candidates, scores, findings, graph, origin and stages.

    ``records`` is the library; ``complete`` says which records have a path of their own (none, if absent).
    """
    claims = tables["claims"]
    scores = cut(matching.lexical_only(matching.lexical_scores(claims, records)))
    known = matching.known_record_matches(matching.deterministic_matches(claims, scores), records)
    curated = records.select("record_id", F.col("complete") if "complete" in records.columns else F.lit(False).alias("complete"))
    status = cut(rollup.trace_status(claims, tables["graph"], known, curated))
    found = rollup.findings(
        status, claims, tables["snaps"], tables["versions"], tables["comparisons"], tables["mutations"], tables["stages"],
        tables["graph"])
    candidates = matching.candidates(scores).groupBy("claim_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "record_id", "confidence"))),
        lambda c: F.struct(c["record_id"].alias("record_id"), c["confidence"].alias("confidence"))).alias("candidates"))
    stages = tables["stages"].groupBy("claim_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("stage_ord", "stage_id", "status", "confidence"))),
        lambda s: F.struct(s["stage_id"].alias("stage_id"), s["status"].alias("status"), s["confidence"].alias("confidence")),
    ).alias("stages"))
    parts = [
        known.select("claim_id", "matched", "similarity", confidence_band(F.col("similarity")).alias("band")),
        candidates, rollup.score_table(tables["snaps"], tables["mutations"], tables["origins"], tables["graph"]),
        tables["graph"].select("claim_id", F.struct("nodes", "edges", "status", "confidence", "connected").alias("graph")),
        tables["origins"].select("claim_id", "earliest_source.source_id", "likely_origin.status").toDF(
            "claim_id", "earliest_source_id", "origin_status"),
        stages,
    ]
    rows = reduce(lambda a, b: a.join(b, "claim_id", "left"), parts, claims.select("claim_id", "claim").join(
        found, "claim_id").join(status.select("claim_id", "record_id", "live_status", "known_status"), "claim_id"))
    empty = F.array().cast(rows.schema["candidates"].dataType)
    return rows.withColumn("candidates", F.coalesce("candidates", empty))
