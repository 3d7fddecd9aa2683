"""Submitted occurrences: where a claim was seen, as far as the submitter says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.dates import ISO_INSTANT
from tracewell.functions.fields import normalized_proposition, quoted_speaker
from tracewell.functions.patterns import SOFT_CONTROL
from tracewell.functions.text import clean, let, squeeze
from tracewell.functions.urls import has_credentials, normal_url


def one_line(text: Column) -> Column:
    """The whole text on one line; blank becomes null."""
    return F.nullif(squeeze(F.regexp_replace(text, SOFT_CONTROL, " ")), F.lit(""))


def occurrence_url(url: Column) -> Column:
    """The normalized URL, null unless it is http(s) without credentials."""
    text = one_line(url)
    return F.when(~has_credentials(text), normal_url(text))


def proposition(text: Column) -> Column:
    return let(clean(text), lambda c: normalized_proposition(c, quoted_speaker(c)))


def evidence_type(url, name, post, observed, quote, context) -> Column:
    """What kind of evidence the supplied fields amount to; null when they amount to none."""
    someone = name.isNotNull() | post.isNotNull() | context.isNotNull()
    return (
        F.when(url.isNotNull(), "supplied_url")
        .when(post.isNotNull() & name.isNotNull(), "source_post")
        .when(quote.isNotNull() & someone, "quoted_context")
        .when(observed.isNotNull() & someone, "source_metadata")
    )


def build_occurrences(claims: DataFrame) -> DataFrame:
    """Occurrences of submissions that say where the claim was seen.

    ``claims(claim_id, claim, raw_text, source_url, source_name, source_post_id, observed_at,
    exact_quote, context, image_id, image_sha256, image_text, image_filename)``.  Claim text
    alone yields no row.
    """
    rows = claims.select(
        "claim_id",
        one_line(F.col("claim")).alias("claim"),
        one_line(F.col("raw_text")).alias("_raw"),
        F.when(F.col("image_id").isNull(), occurrence_url(F.col("source_url"))).alias("_url"),
        one_line(F.col("source_name")).alias("_name"),
        one_line(F.col("source_post_id")).alias("_post"),
        F.date_format(one_line(F.col("observed_at")).try_cast("timestamp"), ISO_INSTANT).alias("_seen"),
        one_line(F.col("exact_quote")).alias("_quote"),
        one_line(F.col("context")).alias("_context"),
        F.col("image_id").alias("_image"), F.col("image_sha256").alias("_sha"),
        one_line(F.col("image_text")).alias("_ocr"),
        one_line(F.col("image_filename")).alias("_file"),
    ).filter(F.col("claim").isNotNull())
    image = F.col("_image").isNotNull()
    kind = F.when(image, "screenshot").otherwise(evidence_type(
        *[F.col(c) for c in ("_url", "_name", "_post", "_seen", "_quote", "_context")]))
    rows = rows.withColumn("evidence_type", kind).filter(F.col("evidence_type").isNotNull())
    rows = rows.withColumns({
        "exact_text": F.when(image, F.coalesce("_ocr", "claim")).otherwise(F.coalesce("_quote", "_raw", "claim")),
        "source_identifier": F.when(image, F.col("_image")).otherwise(F.coalesce("_post", "_name")),
        "source_context": F.when(image, F.col("_file")).otherwise(F.coalesce("_context", "_name")),
        "observed_at": F.when(~image, F.col("_seen")),
    })
    identity = F.when(
        image, F.to_json(F.array("_image", "_sha", "exact_text"))
    ).otherwise(F.to_json(F.array("_url", "source_identifier", "observed_at", "exact_text", "source_context")))
    rows = rows.withColumn("occurrence_id", F.concat(
        F.lit("submitted-occurrence:"), F.substring(F.sha2(identity.cast("binary"), 256), 1, 24)))
    passage = F.concat("occurrence_id", F.lit(":occurrence"))
    shown = F.concat_ws(
        "\n", "exact_text", F.concat(F.lit("URL: "), "_url"), F.concat(F.lit("Source: "), "source_identifier"),
        F.concat(F.lit("Observed: "), "observed_at"), F.concat(F.lit("Context: "), "source_context"),
    )
    evidence = F.struct(
        F.col("occurrence_id").alias("source_id"), passage.alias("passage_id"),
        shown.alias("exact_text"), F.lit("occurrence").alias("role"),
    )
    ids = F.when(image, F.array("_image", F.concat("_image", F.lit(":ocr")), passage)).otherwise(F.array(passage))
    confidence = F.when(image, 1.0).when(
        F.col("_url").isNotNull() | (F.col("_post").isNotNull() & F.col("_name").isNotNull()), 0.8
    ).otherwise(0.65)
    return rows.select(
        "claim_id", "occurrence_id", "claim", "exact_text",
        proposition(F.col("exact_text")).alias("normalized_proposition"), "evidence_type",
        F.col("_url").alias("source_url"), "source_identifier", "observed_at", "source_context",
        ids.alias("evidence_ids"), F.array(evidence).alias("evidence"), confidence.alias("confidence"),
    )
