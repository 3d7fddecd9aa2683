"""Search hits: merging, ranking, and choosing which pages to acquire.

Hits per claim are few by construction (at most three queries of at most ten hits, see
``sources.hits``), so windows per claim stay small however many claims there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions.text import clamp, discovery_queries, text_relevance
from tracewell.functions.urls import url_key
from tracewell.operators.ranking import best_row, in_range, top_k


def query_table(claims: DataFrame, claim: str = "claim") -> DataFrame:
    """One row per search query of a claim, in order."""
    return claims.select(
        "claim_id", F.posexplode(discovery_queries(F.col(claim))).alias("query_ord", "query")
    )


def merge_hits(hits: DataFrame) -> DataFrame:
    """One row per claim and page.

    URL, publisher and domain come from the first sighting; title, description and score
    from the first best-scored one; result id and date from the last hit that beat all
    earlier scores and has one; queries keep their order of discovery.
    """
    order = [F.col("query_ord"), F.col("hit_ord")]
    earlier = Window.partitionBy("claim_id", "key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.struct(*order)
    score = F.coalesce("provider_score", F.lit(-1.0))
    rows = (
        hits.withColumns({"key": url_key(F.col("url")), "_score": score})
        .withColumn("_record", F.coalesce(F.col("_score") > F.max("_score").over(earlier), F.lit(True)))
    )
    best = F.max_by(
        F.struct("title", "description", "provider_score"),
        F.struct(F.col("_score"), -F.col("query_ord"), -F.col("hit_ord")),
    )
    last = lambda c: F.max_by(F.col(c), F.when(F.col("_record") & F.col(c).isNotNull(), seen))
    queries = F.array_distinct(F.transform(
        F.array_sort(F.collect_list(F.struct(*order, "query"))), lambda h: h["query"]
    ))
    return (
        rows.groupBy("claim_id", "key")
        .agg(
            F.min_by(F.struct("url", "publisher", "domain"), seen).alias("_first"), best.alias("_best"),
            last("provider_result_id").alias("provider_result_id"),
            last("published_date").alias("published_date"),
            queries.alias("discovered_by_queries"), F.min(seen).alias("_seen"),
        )
        .select(
            "claim_id", "key", "_first.*", "_best.*", "provider_result_id", "published_date",
            "discovered_by_queries",
            (F.row_number().over(Window.partitionBy("claim_id").orderBy("_seen")) - 1).alias("idx"),
        )
    )


def scored_hits(hits: DataFrame, claims: DataFrame, claim: str = "claim") -> DataFrame:
    """Add retrieval relevance: wording first, the provider's score second."""
    lexical = text_relevance(F.col("_claim"), F.concat_ws("\n", "title", "description"))
    joined = hits.join(claims.select("claim_id", F.col(claim).alias("_claim")), "claim_id")
    blended = clamp(
        F.col("_lexical") * F.lit(K.RETRIEVAL_LEXICAL_WEIGHT)
        + clamp(F.col("provider_score")) * F.lit(K.RETRIEVAL_PROVIDER_WEIGHT)
    )
    return (
        joined.withColumn("_lexical", lexical)
        .withColumn(
            "retrieval_relevance",
            F.when(F.col("provider_score").isNull(), F.col("_lexical")).otherwise(blended),
        )
        .withColumn("key", F.col("key") if "key" in hits.columns else url_key(F.col("url")))
        .drop("_claim", "_lexical")
    )


def deduplicate_hits(scored: DataFrame) -> DataFrame:
    """The most relevant hit of every page, the earliest on a tie."""
    return best_row(scored, ["claim_id", "key"], F.struct(F.col("retrieval_relevance"), -F.col("idx")))


def rank_hits(scored: DataFrame, limit: int = K.HITS_TOTAL) -> DataFrame:
    """Distinct pages of a claim, best first, at most ``limit`` (20 at most)."""
    order = [F.desc("retrieval_relevance"), F.asc("idx"), F.asc("key")]
    return top_k(deduplicate_hits(scored), ["claim_id"], order, in_range("limit", limit, K.HITS_TOTAL_MAX))


def select_sources(
    ranked: DataFrame, limit: int = K.ACQUISITION_LIMIT, per_domain: int = K.SOURCES_PER_DOMAIN
) -> DataFrame:
    """Pages to acquire: at most two per domain in rank order, then the first ``limit``."""
    bounded = in_range("limit", limit, K.ACQUISITION_LIMIT_MAX)
    varied = top_k(
        ranked.withColumn("_domain", F.lower("domain")), ["claim_id", "_domain"], [F.asc("rank")],
        per_domain, "_in_domain",
    )
    return (
        top_k(varied, ["claim_id"], [F.asc("rank")], bounded, "selected")
        .drop("_domain", "_in_domain")
    )


def claim_evidence_id(claim: Column, image_id: Column | None = None) -> Column:
    """Stable evidence id of a submission: its image's, else a hash of the claim's text."""
    told = F.concat(F.lit("submission:text:"), F.substring(F.sha2(claim.cast("binary"), 256), 1, 24))
    return told if image_id is None else F.coalesce(image_id, told)


def search_evidence_ids(hits: DataFrame, provider: str) -> DataFrame:
    """Stable evidence id of a search lead: the provider's id, else a hash of the URL."""
    fallback = F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 24)
    named = F.nullif(F.col("provider_result_id"), F.lit(""))
    return hits.withColumn(
        "evidence_id", F.concat(F.lit(f"search:{provider}:"), F.coalesce(named, fallback))
    )
