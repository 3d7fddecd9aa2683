"""The whole investigation on given tables: pages found for claims, and a library of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.catalog import lexical, web
from tracewell.catalog.registry import query
from tracewell.operators import discovery, investigation
from tracewell.sources.occurrences import build_occurrences


def claims(t) -> DataFrame:
    """The claims of the pages, with the ids of what was searched for them."""
    leads = discovery.search_evidence_ids(web.hits(t), "web").groupBy("claim_id").agg(
        F.array_sort(F.collect_set("evidence_id")).alias("search_ids"))
    return web.claims(t).join(leads, "claim_id", "left").select(
        "claim_id", "claim", discovery.claim_evidence_id(F.col("claim")).alias("evidence_id"),
        F.when(F.col("search_ids").isNotNull(), "searched").otherwise("not_configured").alias("search_status"),
        F.coalesce("search_ids", F.array().cast("array<string>")).alias("search_ids"), F.lit(False).alias("acquisition_failed"))


def occurrences(t) -> DataFrame:
    """Each claim was seen on the first page of its block, in that page's words."""
    none = F.lit(None).cast("string")
    first = web.pages(t).groupBy("claim_id").agg(
        F.min_by("page_title", "page_id").alias("claim"), F.min_by("url", "page_id").alias("source_url"))
    return build_occurrences(first.select(
        "claim_id", "claim", F.col("claim").alias("raw_text"), "source_url",
        *[none.alias(c) for c in ("source_name", "source_post_id", "observed_at", "exact_quote", "context", "image_id",
                                  "image_sha256", "image_text", "image_filename")]))


def investigated(t) -> dict[str, DataFrame]:
    return investigation.investigate(claims(t), web.snapshots(t), occurrences(t))


@query("results")
def results(t):
    """A result row per claim, from hits and pages to stages, matched to the library."""
    return investigation.results(investigated(t), lexical.records(t))
