"""Exact de-duplication by content-defined chunk recipes, in built-in functions only.

A text is cut where its own content says so: a chunk ends at the first full stop or line end after
``CHUNK_LEAST`` characters, or after ``CHUNK_MOST`` without one.  An edit therefore moves only the cuts
near it, and copies inside different texts share chunks.  A chunk's identifier is its 64-bit hash,
*verified* against the SHA-256 of its content over all chunks of the corpus: an identifier that stands
for two contents is replaced by the SHA-256 itself.  Two texts are equal exactly if their ordered lists
of identifiers are.  Texts are read once and never shuffled; only identifiers move.

Defined results: a null text is an empty one (an empty list, equal to other empty texts); a null id
loses to every other id; of rows that repeat id and text exactly one is kept; an empty table gives an
empty result; other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import written

CHUNK_LEAST, CHUNK_MOST = 512, 4096
#: Identifiers with two contents that are listed in the plan.  About n*n/2**65 of n chunks are expected;
#: beyond the list every recipe uses the wide identifiers, which is as exact.
MOST_UNVERIFIED = 1000


def chunks(text: Column) -> Column:
    """The consecutive chunks of a text; joined they are the text."""
    pattern = rf"(?s).{{{CHUNK_LEAST},{CHUNK_MOST}}}?[.\n]|.{{1,{CHUNK_MOST}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_table(docs: DataFrame) -> DataFrame:
    """``doc_id, row, text_sha256, chunks``: for each row its chunks' identifiers and digests in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.sha2(text, 256).alias("text_sha256"),
        F.transform(chunks(text), lambda c: F.struct(
            F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("check"), F.length(c).alias("size"))).alias("chunks"),
    )


def chunk_dictionary(table: DataFrame) -> DataFrame:
    """``id, uses, size, verified``: every distinct identifier; verified if it stands for one content."""
    return (
        table.select(F.explode("chunks").alias("c"))
        .groupBy(F.col("c.id").alias("id"))
        .agg(F.count(F.lit(1)).alias("uses"), F.max("c.size").alias("size"),
             F.min("c.check").alias("_low"), F.max("c.check").alias("_high"))
        .select("id", "uses", "size", (F.col("_low") == F.col("_high")).alias("verified"))
    )


def recipes(table: DataFrame) -> DataFrame:
    """The chunk table with each row's ``recipe`` (identifiers in order) and ``wide`` (digests of unverified ones)."""
    doubtful = [r["id"] for r in chunk_dictionary(table).filter(~F.col("verified")).select("id")
                .limit(MOST_UNVERIFIED + 1).collect()]
    if not doubtful:
        wide = F.array().cast("array<binary>")
    else:
        suspects = F.filter("chunks", lambda c: c["id"].isin(doubtful)) if len(doubtful) <= MOST_UNVERIFIED else F.col("chunks")
        wide = F.transform(suspects, lambda c: c["check"])
    return table.select("doc_id", "row", "text_sha256", F.col("chunks.id").alias("recipe"), wide.alias("wide"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, n_chunks``.

    A group is all rows with equal texts; the one with the largest id is kept.  Groups are counted
    map-side before the shuffle, and joined back by their recipe, where Spark splits a hot group.
    """
    rows = recipes(written(chunk_table(docs), "chunks"))
    best = F.struct(F.col("doc_id").isNotNull(), "doc_id", "row")
    groups = rows.groupBy("recipe", "wide").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["recipe", "wide"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"))
