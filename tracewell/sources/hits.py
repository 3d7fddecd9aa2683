"""Search results in two provider dialects, brought to one hit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions.text import clean_label
from tracewell.functions.urls import domain, normal_url
from tracewell.operators.ranking import in_range, top_k

_BRAVE = (
    "web struct<results: array<struct<title: string, url: string, description: string, age: string, "
    "id: string, score: double, profile: struct<long_name: string>>>>"
)
_TAVILY = (
    "results array<struct<title: string, url: string, content: string, published_date: string, "
    "id: string, score: double>>"
)
_REQUEST = "claim_id string, query string, query_ord int, provider string"


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored responses, one JSON object per query, with the request next to the response."""
    return spark.read.schema(f"{_REQUEST}, {_BRAVE}, {_TAVILY}").json(path)


def explode_results(responses: DataFrame) -> DataFrame:
    """One row per result with the fields both dialects can give."""
    brave = F.transform(F.col("web.results"), lambda r: F.struct(
        r["title"].alias("title"), r["url"].alias("url"), r["description"].alias("description"),
        r["profile"]["long_name"].alias("publisher"), r["age"].alias("published_date"),
        r["id"].alias("provider_result_id"), r["score"].alias("provider_score"),
    ))
    tavily = F.transform(F.col("results"), lambda r: F.struct(
        r["title"].alias("title"), r["url"].alias("url"), r["content"].alias("description"),
        F.lit(None).cast("string").alias("publisher"), r["published_date"].alias("published_date"),
        r["id"].alias("provider_result_id"), r["score"].alias("provider_score"),
    ))
    results = F.when(F.col("provider") == "brave", brave).otherwise(tavily)
    return responses.select(
        "claim_id", "query", "query_ord", F.posexplode(results).alias("hit_ord", "_r")
    ).select("claim_id", "query", "query_ord", "hit_ord", "_r.*")


def normalize_hits(raw: DataFrame, per_query: int = K.HITS_PER_QUERY) -> DataFrame:
    """Clean labels, drop hits without a title or web URL, keep the first ``per_query``."""
    cleaned = raw.select(
        "claim_id", "query", "query_ord", "hit_ord",
        clean_label(F.col("title"), 300).alias("title"),
        normal_url(F.col("url")).alias("url"),
        F.coalesce(clean_label(F.col("description"), 4000), F.lit(K.MISSING_DESCRIPTION)).alias("description"),
        clean_label(F.col("publisher"), 200).alias("publisher"),
        clean_label(F.col("published_date"), 100).alias("published_date"),
        clean_label(F.col("provider_result_id"), 300).alias("provider_result_id"),
        F.when(~F.isnan("provider_score"), F.col("provider_score")).alias("provider_score"),
    ).filter(F.col("title").isNotNull() & F.col("url").isNotNull())
    kept = top_k(
        cleaned, ["claim_id", "query_ord"], [F.asc("hit_ord")], in_range("per_query", per_query, K.HITS_PER_QUERY_MAX), "_n"
    )
    return kept.drop("_n").withColumn("domain", domain(F.col("url")))
