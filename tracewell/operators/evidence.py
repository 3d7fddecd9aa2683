"""Fetched pages as dated, ranked evidence snapshots.

A snapshot keeps its passages (at most six) as a nested array: every later step that needs
a source's passages reads them in place, without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import pages as P
from tracewell.functions.text import clamp, clean_lines, let, text_relevance
from tracewell.functions.urls import domain, url_key
from tracewell.session import new_folder


PASSAGE = "struct<passage_id: string, text: string, kind: string, relevance: double>"


def page_facts(fetched: DataFrame, as_of: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per fetched page: its outcome, its text, and what it says about itself; and columns to ``keep``.

    A page is parsed where it is read, once, however many claims found it; its HTML goes no further than
    this.  One projection per step, so that nothing is parsed twice.
    """
    html = F.col("html")
    usable = F.col("acquisition_status").isin(*K.ACQUIRED_STATUSES)
    json = {k: F.get("_json", F.lit(i)) for i, k in enumerate(P.JSON_KEYS)}
    rows = fetched.withColumn("html", F.coalesce("html", F.lit(""))).withColumns({
        "_base": F.coalesce("final_url", "url"),
        "_entries": P.meta_entries(html),
        "_article": F.when(html.contains("ld+json"), P.article_object(P.json_ld_objects(html))),
        "_readable": P.readable_text(html),
        "_html_title": clean_lines(P.decode_entities(P.inner(html, "title"))),
        "_times": P.time_elements(html),
    }).withColumns({
        "_json": P.json_scalars(F.col("_article")),
        "_canonical": P.canonical_url(html, F.col("_base")),
        "_article_like": F.col("_article").isNotNull() | html.rlike(r"(?i)<article(?![A-Za-z0-9_])"),
    })
    return rows.select(
        *keep, "url", "final_url", "acquisition_status", "acquisition_error", F.length(html).cast("bigint").alias("html_size"),
        F.when(usable, F.col("_readable")).otherwise("").alias("text"), "_canonical", "_article_like",
        F.coalesce(
            json["headline"], json["name"], P.first_meta(F.col("_entries"), K.META_TITLE), F.col("_html_title")).alias("_meta_title"),
        F.coalesce(json["publisher"], P.first_meta(F.col("_entries"), K.META_PUBLISHER)).alias("_meta_publisher"),
        F.coalesce(json["author"], json["creator"], P.first_meta(F.col("_entries"), K.META_AUTHOR)).alias("_meta_author"),
        P.first_dates(P.page_dates(F.col("_readable"), F.col("_entries"), json, F.col("_times")), as_of).alias("_said_dates"),
    )


def acquire(selected: DataFrame, pages: DataFrame) -> DataFrame:
    """Attach the page facts to every selected source; sources without a page stay.

    A URL shared by many claims is one row of the page table, so a hot page only skews the
    (small) selected side, which AQE splits.
    """
    return selected.join(pages, "url", "left").withColumns({
        "acquisition_status": F.coalesce("acquisition_status", F.lit("not_attempted")),
        "html_size": F.coalesce("html_size", F.lit(0)), "text": F.coalesce("text", F.lit("")),
        "_article_like": F.coalesce("_article_like", F.lit(False)),
    })


def snapshots(acquired: DataFrame, as_of: int) -> DataFrame:
    """One evidence snapshot per selected source.

    Needs ``claim_id, claim, idx``, the hit columns and the page facts; only relevance and passages depend on
    the claim.  ``published_date`` is the search provider's, used only as an index date.  Search snippets never
    become passages; a page that was not acquired has neither text nor passages.
    """
    usable = F.col("acquisition_status").isin(*K.ACQUIRED_STATUSES)
    label = lambda c, n: F.substring(clean_lines(c), 1, n)
    text_size = F.length("text")
    empty = F.array().cast(f"array<{PASSAGE}>")
    said = lambda i: F.get("_said_dates", F.lit(i))
    rows = (
        acquired.withColumns({
            "_identity": F.coalesce("_canonical", "final_url", "url"),
            "title": F.coalesce(label(F.col("_meta_title"), 300), F.col("title")),
            "publisher": F.coalesce(label(F.col("_meta_publisher"), 200), F.col("publisher")),
            "author": label(F.col("_meta_author"), 200),
            "_published": said(0),
            "_modified": said(1),
            "_indexed": F.get(P.first_dates(P.provider_dates(F.col("published_date")), as_of), F.lit(0)),
        })
        .withColumn("_date", F.coalesce("_published", "_modified", "_indexed"))
        .withColumns({
            "source_id": P.source_id(F.col("_identity")),
            "domain": domain(F.col("_identity"), F.col("domain")),
        })
        .withColumn("source_type", P.source_type(F.col("domain"), F.col("title"), F.col("_article_like")))
        .withColumn(
            "passages",
            F.when(usable, P.with_date_passage(
                F.col("source_id"),
                P.relevant_passages(F.col("source_id"), F.col("claim"), F.col("text")), F.col("_date"),
            )).otherwise(empty),
        )
    )
    strongest = F.array_max(F.transform(
        F.filter("passages", lambda p: p["kind"] != "date"), lambda p: p["relevance"]))
    dated = F.get(F.filter("passages", lambda p: p["kind"] == "date"), F.lit(0))["passage_id"]
    return rows.select(
        "claim_id", "source_id", "idx", "provider_result_id",
        F.col("url").alias("original_url"), "final_url", F.col("_canonical").alias("canonical_url"),
        "title", "domain", "publisher", "author",
        F.col("_published.value").alias("published_at"), F.col("_modified.value").alias("modified_at"),
        F.coalesce("_date.type", F.lit("unknown")).alias("date_type"),
        F.coalesce("_date.confidence", F.lit(0.0)).alias("date_confidence"),
        F.col("_date.evidence").alias("date_evidence"),
        F.coalesce("_date.source", F.lit("unknown")).alias("date_source"),
        dated.alias("date_passage_id"),
        "text", "passages", "source_type", "provider_score", "retrieval_relevance",
        F.when(usable, text_relevance(F.col("claim"), F.concat_ws("\n", "title", "text"), normalize=False))
        .alias("claim_relevance"),
        F.when(usable, F.coalesce(strongest, F.lit(0.0))).alias("evidence_relevance"),
        "acquisition_status", "acquisition_error",
        P.extraction_confidence(
            F.col("acquisition_status"), text_size, F.col("_published").isNotNull(),
            F.col("_canonical").isNotNull(), F.col("author").isNotNull(),
        ).alias("extraction_confidence"),
        "discovered_by_queries",
    )


def deduplicate_snapshots(snaps: DataFrame) -> DataFrame:
    """One snapshot per page identity: the best acquired, the earliest on a tie.

    The queries of all copies are kept in order.  Copies are written once and judged on their narrow columns; only
    the rows that stay are then looked up in full, so no page text enters the aggregation.
    """
    status = F.when(F.col("acquisition_status") == "acquired", 3.0).when(
        F.col("acquisition_status") == "partial", 2.0).otherwise(1.0)
    quality = status + F.col("extraction_confidence") + F.coalesce("provider_score", F.lit(0.0)) / 10
    folder = new_folder(snaps.sparkSession, "copies")
    snaps.withColumns({
        "_key": url_key(F.coalesce("canonical_url", "final_url", "original_url")), "_row": F.monotonically_increasing_id(),
    }).write.parquet(folder)
    copies = snaps.sparkSession.read.parquet(folder)
    queries = F.array_distinct(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("idx", "discovered_by_queries"))),  # a claim's sources, at most ten
        lambda s: s["discovered_by_queries"],
    )))
    stays = copies.groupBy("claim_id", "_key").agg(
        F.max_by("_row", F.struct(quality, -F.col("idx"), -F.col("_row"))).alias("_row"), queries.alias("discovered_by_queries"))
    wide = copies.drop("claim_id", "_key", "discovered_by_queries")
    return wide.join(stays, "_row").select(*snaps.columns)


def rank_snapshots(snaps: DataFrame) -> DataFrame:
    """Order the sources of a claim by what their pages say (at most ten per claim)."""
    usable = F.col("acquisition_status").isin(*K.ACQUIRED_STATUSES)
    measured = F.array_max(F.transform(
        F.filter("passages", lambda p: ~p["kind"].isin("date", "metadata")), lambda p: p["relevance"]))
    claim_part = F.when(usable, F.coalesce("claim_relevance", F.lit(0.0))).otherwise(0.0)
    evidence_part = F.when(usable, F.coalesce("evidence_relevance", measured, F.lit(0.0))).otherwise(0.0)
    scored = snaps.withColumn(
        "relevance", clamp(evidence_part * F.lit(K.EVIDENCE_WEIGHT) + claim_part * F.lit(K.CLAIM_WEIGHT))
    )
    order = [F.desc("relevance"), F.asc("idx"), F.asc("source_id")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("claim_id").orderBy(*order)))


def mean_relevance(ranked: DataFrame, strongest: int = 5) -> DataFrame:
    """Mean relevance of a claim's strongest sources."""
    micro = F.sum(F.round(F.col("relevance") * F.lit(1e6)).cast("bigint"))  # exact in any order
    return ranked.filter(F.col("rank") <= strongest).groupBy("claim_id").agg(
        (micro / (F.count(F.lit(1)) * F.lit(1e6))).alias("mean_relevance"), F.count(F.lit(1)).alias("sources")
    )


def public(snaps: DataFrame) -> DataFrame:
    """Snapshots without the internal full text."""
    return snaps.drop("text")


def passages_of(snaps: DataFrame) -> DataFrame:
    """The passages as a table of their own.

    An outer explode, then a filter: an inner one makes Spark repeat the whole passage
    expression as an inferred filter below it.
    """
    rows = snaps.select("claim_id", "source_id", F.posexplode_outer("passages").alias("ord", "_p"))
    return rows.filter(F.col("ord").isNotNull()).select("claim_id", "source_id", "ord", "_p.*")


def acquisition_counts(snaps: DataFrame) -> DataFrame:
    """Attempted, acquired, partial and blocked sources per claim, and the all-blocked gate."""
    status = F.col("acquisition_status")
    attempted = F.count_if(status != "not_attempted")
    blocked = F.count_if(status == "blocked")
    return snaps.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("sources"), attempted.alias("attempted"),
        F.count_if(status == "acquired").alias("acquired"), F.count_if(status == "partial").alias("partial"),
        blocked.alias("blocked"), ((attempted > 0) & (attempted == blocked)).alias("all_blocked"),
    )


def evidence_texts(references: DataFrame, snaps: DataFrame) -> DataFrame:
    """Distinct passage texts behind lists of evidence ids: ``(claim_id, item_id, evidence_ids)``."""
    wanted = references.select("claim_id", "item_id", F.posexplode("evidence_ids").alias("_at", "passage_id"))
    found = wanted.join(passages_of(snaps).select("claim_id", "passage_id", "text"), ["claim_id", "passage_id"])
    first = found.groupBy("claim_id", "item_id", "text").agg(F.min("_at").alias("_at"))
    return first.groupBy("claim_id", "item_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda r: r["text"]).alias("texts")
    )


def unique_evidence(evidence: Column) -> Column:
    """Evidence entries distinct by source, passage and role; the first of each stays."""
    ident = lambda e: F.struct(e["source_id"], e["passage_id"], e["role"])
    return let(evidence, lambda all_: let(F.transform(all_, ident), lambda ids: F.filter(
        all_, lambda e, i: F.array_position(ids, ident(e)) == i + 1)))


