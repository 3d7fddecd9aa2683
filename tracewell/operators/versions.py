"""Claim versions: what each source's own passage says about the claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import fields
from tracewell.functions.text import clamp, clean, dice, has_text, let, round3, version_terms
from tracewell.operators.ranking import best_row, in_range, top_k

EVIDENCE = "struct<source_id: string, passage_id: string, exact_text: string, role: string>"
VERSION_COLUMNS = (
    "claim_id version_id source_id claim normalized_proposition narrator quoted_speaker source_stance "
    "correction_verdict claim_type evidence_passage_id subject event event_date location actor attribution "
    "causal_language certainty caption_context qualifiers evidence_ids confidence extraction_method"
).split()


def readable_source() -> Column:
    """Acquired, or partial with enough extraction confidence."""
    return (F.col("acquisition_status") == "acquired") | (
        (F.col("acquisition_status") == "partial")
        & (F.col("extraction_confidence") >= K.PARTIAL_MIN_EXTRACTION)
    )


def _scored_passages(passages: Column, claim_terms: Column, wanted) -> Column:
    """Passages with their overlap with the claim and a sort key (best first), of those ``wanted`` whatever their text."""
    def scored(p: Column) -> Column:
        weight = F.when(p["kind"] == "claim", 1.0).otherwise(K.OTHER_KIND_WEIGHT)
        overlap = let(version_terms(p["text"]), lambda terms: dice(terms, claim_terms))
        return let(overlap, lambda d: F.struct(
            (-weight * (F.lit(0.65) * clamp(p["relevance"]) + F.lit(0.35) * d)).alias("sort"),
            p["passage_id"].alias("passage_id"), p["text"].alias("text"), p["kind"].alias("kind"),
            p["relevance"].alias("relevance"), d.alias("overlap"),
        ))

    return F.transform(F.filter(passages, lambda p: wanted(p) & has_text(p["text"])), scored)


def _asked(claims: DataFrame) -> DataFrame:
    """Claims as passages are compared with them; their terms are found once, not once a passage."""
    text = clean(F.col("claim"))
    return claims.select("claim_id", text.alias("_claim"), version_terms(text).alias("_terms"))


def select_passages(snaps: DataFrame, claims: DataFrame, minimum: float = K.VERSION_MIN_RELEVANCE) -> DataFrame:
    """The one passage per source that states the claim, if any (ranked inside the row)."""
    rows = snaps.filter(readable_source()).join(_asked(claims).filter(F.col("_claim") != ""), "claim_id")
    wanted = lambda p: (p["relevance"] >= minimum) & p["kind"].isin("claim", "provenance")
    fits = lambda p: (
        ((p["kind"] == "claim") & (p["overlap"] >= K.VERSION_MIN_DICE["claim"]))
        | ((p["kind"] == "provenance") & (p["overlap"] >= K.VERSION_MIN_DICE["provenance"]))
    )
    eligible = F.filter(_scored_passages(F.col("passages"), F.col("_terms"), wanted), fits)
    # exploding one passage at most: a filter on it would be pushed down and score every passage twice
    return rows.withColumn("_passage", F.explode(F.slice(F.array_sort(eligible), 1, 1)))


def _build(rows: DataFrame, confidence: Column, method: str) -> DataFrame:
    """Derive every version field from the chosen passage."""
    with_claim = rows.withColumn("claim", clean(F.col("_passage.text")))
    return fields.with_fields(with_claim).select(
        "claim_id",
        F.concat_ws(":", F.lit("version"), "source_id", "_passage.passage_id").alias("version_id"),
        "source_id", "claim", "normalized_proposition",
        F.coalesce("publisher", "author", "domain").alias("narrator"),
        "quoted_speaker", "source_stance", "correction_verdict", "claim_type",
        F.col("_passage.passage_id").alias("evidence_passage_id"),
        "subject", "event", "event_date", "location", "actor", "attribution", "causal_language",
        "certainty", "caption_context", "qualifiers",
        F.array("_passage.passage_id").alias("evidence_ids"),
        confidence.alias("confidence"), F.lit(method).alias("extraction_method"),
    )


def extract_versions(snaps: DataFrame, claims: DataFrame, minimum: float = K.VERSION_MIN_RELEVANCE) -> DataFrame:
    """One evidence-grounded version per readable source that states the claim."""
    confidence = round3(
        F.lit(0.42) * clamp(F.col("extraction_confidence")) + F.lit(0.43) * clamp(F.col("_passage.relevance"))
        + F.lit(0.1) * F.col("_passage.overlap")
        + F.lit(0.05) * F.least(F.lit(1.0), fields.filled_fields() / 4)
    )
    return _build(select_passages(snaps, claims, minimum), confidence, "deterministic")


def aid_candidates(snaps: DataFrame, claims: DataFrame, versions: DataFrame, sources: int = 6) -> DataFrame:
    """Passages an external selector may choose from: up to three per unresolved source."""
    unresolved = snaps.filter(readable_source()).join(
        versions.select("claim_id", "source_id"), ["claim_id", "source_id"], "left_anti"
    )
    first = top_k(unresolved, ["claim_id"], [F.asc("idx")], in_range("sources", sources, 10), "_n").drop("_n")
    wanted = lambda p: p["kind"].isin("claim", "context", "provenance")
    near = lambda p: (p["overlap"] >= 0.16) & ((p["relevance"] >= 0.32) | (p["overlap"] >= 0.22))
    scored = F.filter(_scored_passages(F.col("passages"), F.col("_terms"), wanted), near)
    return first.join(_asked(claims), "claim_id").withColumn(
        "_passage", F.explode(F.slice(F.array_sort(scored), 1, 3))
    )


def merge_selections(candidates: DataFrame, selections: DataFrame) -> DataFrame:
    """Versions from externally selected passages.

    ``selections(claim_id, ord, source_id, passage_id, confidence)``: only offered passages
    count, the first acceptable one per source, and confidence stays bounded.
    """
    chosen = selections.filter(F.col("confidence") >= 0.65).select(
        "claim_id", "ord", "source_id", F.col("passage_id").alias("_pid"), F.col("confidence").alias("_sure")
    )
    offered = candidates.withColumn("_pid", F.col("_passage.passage_id"))
    confidence = round3(F.least(
        F.lit(0.85),
        F.lit(0.5) * clamp(F.col("extraction_confidence"))
        + F.lit(0.2) * F.greatest(F.lit(0.35), clamp(F.col("_passage.relevance")))
        + F.lit(0.15) * F.col("_passage.overlap") + F.lit(0.15) * F.col("_sure"),
    ))
    accepted = offered.join(chosen, ["claim_id", "source_id", "_pid"]).withColumn(
        "_conf", confidence).filter(F.col("_conf") >= 0.6)
    first = best_row(accepted, ["claim_id", "source_id"], -F.col("ord"))
    return _build(first, F.col("_conf"), "llm_assisted")


def best_versions(versions: DataFrame, grounded: bool = True) -> DataFrame:
    """The most confident version per source, the first on a tie.

    ``grounded`` keeps only versions whose own passage is among their evidence.
    """
    rows = versions
    if grounded:
        rows = rows.filter(F.array_contains("evidence_ids", F.col("evidence_passage_id")))
    if "version_ord" not in rows.columns:
        names = [c for c in rows.columns if c not in ("claim_id", "source_id")]
        first = F.min_by(F.struct(*names), F.struct(-F.col("confidence"), F.col("version_id"))).alias("_first")
        return rows.groupBy("claim_id", "source_id").agg(first).select("claim_id", "source_id", "_first.*")
    return best_row(rows, ["claim_id", "source_id"], F.struct(F.col("confidence"), -F.col("version_ord")))


def occurrence_versions(occurrences: DataFrame) -> DataFrame:
    """The same fields for a submitted occurrence."""
    own = F.get(F.filter("evidence", lambda e: e["role"] == "occurrence"), F.lit(0))["passage_id"]
    rows = occurrences.withColumns({
        "claim": clean(F.col("exact_text")),
        "title": F.lit(""),
        "_given": F.nullif(F.trim("normalized_proposition"), F.lit("")),
        "evidence_passage_id": F.coalesce(
            own, F.get("evidence_ids", F.lit(0)), F.concat(F.lit("occurrence:"), "occurrence_id")),
    }).drop("normalized_proposition")
    built = fields.with_fields(rows)
    kind = (
        F.when(F.col("evidence_type") == "quoted_context", "quotation")
        .when(F.col("evidence_type").isin("screenshot", "image"), "caption")
        .when(fields.has_finite_verb(F.col("claim")), "claim").otherwise("unknown")
    )
    return built.select(
        "claim_id",
        F.concat_ws(":", F.lit("version"), "occurrence_id", "evidence_passage_id").alias("version_id"),
        F.col("occurrence_id").alias("source_id"), "claim",
        F.coalesce("_given", "normalized_proposition").alias("normalized_proposition"),
        F.col("source_identifier").alias("narrator"), "quoted_speaker", "source_stance", "correction_verdict",
        kind.alias("claim_type"), "evidence_passage_id", "subject", "event", "event_date", "location", "actor",
        "attribution", "causal_language", "certainty", "caption_context", "qualifiers",
        F.array_distinct("evidence_ids").alias("evidence_ids"),
        round3(F.col("confidence")).alias("confidence"), F.lit("deterministic").alias("extraction_method"),
    )
