"""Fetched pages: what each fetch is worth as evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions.pages import with_integrity
from tracewell.functions.urls import url_policy

FETCHED = (
    "url string, final_url string, redirect_chain array<string>, http_status int, content_type string, "
    "html string, byte_length bigint, truncated boolean, fetch_error string"
)
_BARRIERS = (
    "captcha", "cloudflare_challenge", "bot_verification", "access_denied", "login_wall",
    "consent_interstitial",
)


def read_fetched(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FETCHED).parquet(path)


def classify_fetches(fetched: DataFrame) -> DataFrame:
    """Status and reason of every fetch; the HTML of refused pages is blanked."""
    media = F.lower(F.trim(F.get(F.split("content_type", ";"), F.lit(0))))
    judged = with_integrity(fetched.withColumn("html", F.coalesce("html", F.lit(""))))
    policy = url_policy(F.col("url"), F.coalesce("final_url", "url"))
    status = F.col("http_status")
    reason = (
        F.when(F.col("_policy").isNotNull(), F.concat(F.lit("url_policy:"), "_policy"))
        .when(F.col("fetch_error").isNotNull(), F.lit("fetch_error"))
        .when(status.isNull(), F.lit("fetch_error"))
        .when(status.isin(*K.REDIRECT_HTTP_STATUSES), F.lit("redirect"))
        .when(~status.between(200, 299), F.concat(F.lit("http_"), status.cast("string")))
        .when(F.coalesce(~media.isin(*K.HTML_MEDIA_TYPES), F.lit(True)), F.lit("not_html"))
        .when(F.col("integrity") != "content", F.col("integrity"))
        .when(F.coalesce("truncated", F.lit(False)), F.lit("truncated"))
    )
    outcome = (
        F.when(F.col("acquisition_error").isNull(), "acquired")
        .when(F.col("acquisition_error") == "truncated", "partial")
        .when(F.col("acquisition_error").startswith("url_policy:"), "blocked")
        .when(status.isin(*K.BLOCKED_HTTP_STATUSES) & F.col("acquisition_error").startswith("http_"), "blocked")
        .when(F.col("acquisition_error") == "not_html", "unsupported")
        .when(F.col("acquisition_error").isin(*_BARRIERS), "blocked")
        .otherwise("failed")
    )
    usable = F.col("acquisition_status").isin(*K.ACQUIRED_STATUSES)
    return (
        judged.withColumn("_policy", policy).withColumn("acquisition_error", reason)
        .withColumn("acquisition_status", outcome)
        .withColumn("html", F.when(usable, F.col("html")).otherwise(F.lit("")))
        .drop("_policy")
    )
