"""Match claims to a library of records: lexical, semantic and adjudicated layers.

Claims and records meet on their terms, never as a cross join.  Claims are hashed by
``claim_id`` once, into as many parts as the pairs they can make need; term explosion, scoring, ranking and adjudication then stay in place
whenever the library's postings are small enough for Spark to broadcast them (AQE decides
from the measured size; a large library is joined by shuffle with skew splitting).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tracewell import constants as K
from tracewell.functions.text import confidence_band, match_terms, negated_terms, round3
from tracewell.operators import vectors
from tracewell.operators.ranking import range_ordinals, top_k

#: Squared weights are kept as whole numbers: sums do not depend on the order of rows.
SCALE = 1_000_000_000
_CLAIM_ROW, _CONFLICT_ROW = -1, -2
#: Pairs of a claim and a wording that the claims of one part can make, about, and the fewest claims worth a part.
PART_PAIRS, PART_CLAIMS = 1 << 19, 256


def library_texts(records: DataFrame) -> DataFrame:
    """One row per wording of a record: the canonical claim is number 0, aliases follow."""
    wordings = F.concat(F.array("canonical_claim"), F.coalesce("aliases", F.array().cast("array<string>")))
    return records.select("record_id", F.posexplode(wordings).alias("text_no", "text"))


def _square(value: Column) -> Column:
    return F.floor(value * value * F.lit(float(SCALE)) + F.lit(0.5)).cast("bigint")


def text_count(texts: DataFrame) -> Column:
    return texts.select(F.count(F.lit(1)).cast("double")).scalar()


def weigh_terms(terms: DataFrame, texts: Column) -> DataFrame:
    """``term, df, idf, w2`` of a table with one row per text and term, for a number of texts."""
    idf = F.log((texts + F.lit(1.0)) / (F.col("df") + F.lit(0.5)))
    return (
        terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        .withColumn("idf", idf)
        .withColumn("w2", _square(F.col("idf")))
    )


def term_weights(texts: DataFrame) -> DataFrame:
    """Document frequency, IDF and squared weight of every library term."""
    return weigh_terms(texts.select(F.explode(match_terms(F.col("text"))).alias("term")), text_count(texts))


def unseen_weight(texts: DataFrame) -> Column:
    """Squared weight of a term the library does not know."""
    return _square(F.log((text_count(texts) + F.lit(1.0)) / F.lit(0.5)))


def postings(records: DataFrame) -> DataFrame:
    """The inverted index of a library, flat: no posting list is ever collected.

    Kinds: ``term`` rows name the wordings a term occurs in; one more row per term (number
    -1) lets a claim add up its own norm in the same join; ``denied`` rows (number -2) name
    the records that assert a term which a claim may deny.
    """
    texts = library_texts(records)
    weights = term_weights(texts).select("term", "w2")
    spread = texts.select("record_id", "text_no", F.explode(match_terms(F.col("text"))).alias("term"))
    weighted = spread.join(weights, "term")
    norms = weighted.groupBy("record_id", "text_no").agg(F.sum("w2").alias("norm"))
    term_rows = weighted.join(norms, ["record_id", "text_no"]).select(
        F.lit("term").alias("kind"), "term", "w2", "record_id", "text_no", "norm"
    )
    none = F.lit(0).cast("bigint")
    claim_rows = weights.select(
        F.lit("term").alias("kind"), "term", "w2",
        F.lit(None).cast(records.schema["record_id"].dataType).alias("record_id"),
        F.lit(_CLAIM_ROW).alias("text_no"), none.alias("norm"),
    )
    asserted = F.array_except(match_terms(F.col("canonical_claim")), negated_terms(F.col("canonical_claim")))
    denied_rows = records.select(
        F.lit("denied").alias("kind"), F.explode(asserted).alias("term"), none.alias("w2"),
        "record_id", F.lit(_CONFLICT_ROW).alias("text_no"), none.alias("norm"),
    )
    return term_rows.unionByName(claim_rows).unionByName(denied_rows)


def claim_parts(claims: DataFrame, records: DataFrame) -> int:
    """Into how many parts claims are dealt, so that a part's pairs stay the same however many claims there are.

    Claims are narrow and their pairs many: the size of the claims, which AQE goes by, tells nothing about a task's memory.
    """
    spark = claims.sparkSession
    asked = claims.count()
    pairs = asked * library_texts(records).count()
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(least, min(-(-pairs // PART_PAIRS), -(-asked // PART_CLAIMS)))


def lexical_scores(claims: DataFrame, records: DataFrame, claim: str = "claim") -> DataFrame:
    """IDF-weighted cosine of each claim and each record sharing a term with it.

    Result: ``claim_id, record_id, lexical, conflict``.  A record's score is that of its
    best wording; ``conflict`` says that the claim denies what the record asserts.
    """
    tag = lambda kind: lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term"))
    spread = (
        claims.select("claim_id", match_terms(F.col(claim)).alias("_t"), negated_terms(F.col(claim)).alias("_d"))
        .repartition(claim_parts(claims, records), "claim_id")
        .select(
            "claim_id", F.size("_t").alias("_n"),
            F.explode(F.concat(F.transform("_t", tag("term")), F.transform("_d", tag("denied")))).alias("_p"),
        )
        .select("claim_id", "_n", F.col("_p.kind").alias("kind"), F.col("_p.term").alias("term"))
    )
    unseen = unseen_weight(library_texts(records))
    sums = (
        spread.join(postings(records), ["kind", "term"])
        .groupBy("claim_id", "record_id", "text_no")
        .agg(
            F.sum("w2").alias("dot"), F.max("norm").alias("norm"),
            F.count(F.lit(1)).alias("shared"), F.max("_n").alias("_n"),
        )
    )
    own = F.when(
        F.col("text_no") == _CLAIM_ROW, F.col("dot") + (F.col("_n") - F.col("shared")) * F.col("_unseen")
    )
    cosine = F.col("dot") / F.sqrt(F.col("norm").cast("double") * F.col("claim_norm").cast("double"))
    return (
        sums.withColumn("_unseen", unseen)
        .withColumn("claim_norm", F.max(own).over(Window.partitionBy("claim_id")))
        .filter(F.col("record_id").isNotNull())
        .groupBy("claim_id", "record_id")
        .agg(
            F.coalesce(F.max(F.when(F.col("text_no") >= 0, cosine)), F.lit(0.0)).alias("lexical"),
            F.max(F.col("text_no") == _CONFLICT_ROW).alias("conflict"),
        )
    )


def polarity_conflicts(claims: DataFrame, records: DataFrame, claim: str = "claim") -> DataFrame:
    """The (claim, record) pairs where the claim denies a term the record asserts."""
    denied = claims.select("claim_id", F.explode(negated_terms(F.col(claim))).alias("term"))
    asserted = records.select("record_id", F.explode(F.array_except(
        match_terms(F.col("canonical_claim")), negated_terms(F.col("canonical_claim")))).alias("term"))
    return denied.join(asserted, "term").select("claim_id", "record_id").distinct()


# ---------------------------------------------------------------- semantic layer

#: Vectors of the library in one block, on average, and queries that meet it in one task.
BLOCK_ROWS = 2048


def vector_scores(queries: DataFrame, library: DataFrame, k: int) -> DataFrame:
    """``claim_id, record_id, semantic``: the records of the ``k`` best cosines of each query vector.

    ``queries(claim_id, embedding[, also])``, ``library(record_id, embedding)``; a record's score is the best
    over its vectors.  Records named in ``also`` are scored too, whatever their rank.  Clusters that can not hold any of
    them are never read for a query; every block of a cluster and the queries that meet it are one matrix product on an
    executor, and only ``k`` records per query (and those asked for) leave it.  A record's vectors may lie in several
    blocks: a record among the best has its best vector in one of them, where it is among the best too, so the maxima
    over blocks are exact.
    """
    record_type = library.schema["record_id"].dataType.simpleString()
    if "also" not in queries.columns:
        queries = queries.withColumn("also", F.array().cast(f"array<{record_type}>"))
    found = vectors.nearest(queries, library, k, BLOCK_ROWS)
    asked = queries.select("claim_id", F.explode("also").alias("record_id")).distinct().withColumn("_asked", F.lit(True))
    return found.join(asked, ["claim_id", "record_id"], "left").filter(
        (F.col("rank") <= k) | F.col("_asked")).select("claim_id", "record_id", "semantic")


def hybrid_scores(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Weighted sum of both layers; a missing layer counts 0, a polarity conflict gives 0."""
    score = (
        F.lit(K.SEMANTIC_WEIGHT) * F.coalesce("semantic", F.lit(0.0))
        + F.lit(K.LEXICAL_WEIGHT) * F.coalesce("lexical", F.lit(0.0))
    )
    return lexical.join(semantic, ["claim_id", "record_id"], "full").select(
        "claim_id", "record_id",
        F.when(F.coalesce("conflict", F.lit(False)), 0.0).otherwise(score).alias("score"),
        F.coalesce("conflict", F.lit(False)).alias("conflict"),
    )


def lexical_only(lexical: DataFrame) -> DataFrame:
    return lexical.select(
        "claim_id", "record_id",
        F.when(F.col("conflict"), 0.0).otherwise(F.col("lexical")).alias("score"), "conflict",
    )


# ---------------------------------------------------------------- candidates and matches

def candidates(scores: DataFrame, k: int = K.CANDIDATES_KEPT) -> DataFrame:
    """The best records per claim; ties go to the earlier record id."""
    order = [F.desc("score"), F.asc("record_id")]
    kept = top_k(scores.filter(F.col("score") > 0), ["claim_id"], order, k)
    return kept.select("claim_id", "record_id", "rank", "score", round3(F.col("score")).alias("confidence"))


def ambiguity(scores: DataFrame) -> DataFrame:
    """Top record per claim, its lead over the runner-up, and whether that is decisive."""
    order = [F.desc("score"), F.asc("record_id")]
    ranked = top_k(scores.filter(F.col("score") > 0), ["claim_id"], order, 2)
    pick = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    top = ranked.groupBy("claim_id").agg(
        pick(1, "record_id").alias("record_id"), pick(1, "score").alias("score"),
        F.coalesce(pick(2, "score"), F.lit(0.0)).alias("runner_up"),
    )
    unclear = F.col("score").between(K.AMBIGUITY_FLOOR, K.AMBIGUITY_CEILING) | (
        F.col("score") - F.col("runner_up") < K.RUNNER_UP_MARGIN
    )
    return top.withColumn("margin", F.col("score") - F.col("runner_up")).withColumn("ambiguous", unclear)


def shortlists(claims: DataFrame, scores: DataFrame, records: DataFrame, k: int = K.SHORTLIST_SIZE) -> DataFrame:
    """The record ids an adjudicator may choose from, best first; never one that the claim denies.

    Records without any common term score 0 and follow in the order of their ids, so that a reworded claim has
    a shortlist too.  Of the numbered library a claim takes the first numbers it does not use yet: when ``m`` counts the
    used ones (best or denied) in order, ``number - m`` unused ones lie before each, so the j-th unused number is j plus
    the count of used ones with fewer than j before them.  Those are k counts per claim, however many records it denies.
    """
    order = [F.desc("score"), F.asc("record_id")]
    ranked = top_k(scores.filter((F.col("score") > 0) & ~F.col("conflict")), ["claim_id"], order, k)
    in_order = lambda place: F.transform(
        F.array_sort(F.collect_list(F.struct(place, "record_id"))), lambda r: r["record_id"])  # at most k
    best = ranked.groupBy("claim_id").agg(in_order("rank").alias("_best"))
    numbered = range_ordinals(records.select("record_id"), [], [F.asc("record_id")], "_at")
    used = ranked.select("claim_id", "record_id").unionByName(scores.filter("conflict").select("claim_id", "record_id"))
    placed = range_ordinals(used.join(numbered, "record_id").select("claim_id", "_at"), ["claim_id"], [F.asc("_at")], "_m")
    passed = placed.groupBy("claim_id").agg(
        F.array(*[F.count_if(F.col("_at") - F.col("_m") < j) for j in range(1, k + 1)]).alias("_passed"))
    listed = claims.select("claim_id").join(best, "claim_id", "left").withColumn(
        "_best", F.coalesce("_best", F.array().cast(ArrayType(records.schema["record_id"].dataType))))
    wanted = listed.filter(F.size("_best") < k).join(passed, "claim_id", "left").select(
        "claim_id", "_passed", F.explode(F.sequence(F.lit(1), F.lit(k) - F.size("_best"))).alias("_j"))
    fill = wanted.select("claim_id", "_j", (F.col("_j") + F.coalesce(F.get("_passed", F.col("_j") - 1), F.lit(0))).alias("_at")).join(
        numbered, "_at").groupBy("claim_id").agg(in_order("_j").alias("_more"))
    whole = F.when(F.col("_more").isNull(), F.col("_best")).otherwise(F.concat("_best", "_more"))
    return listed.join(fill, "claim_id", "left").select("claim_id", whole.alias("shortlist")).filter(F.size("shortlist") > 0)


def deterministic_matches(claims: DataFrame, scores: DataFrame, strategy: str = "lexical") -> DataFrame:
    """The top record of every claim; claims without any keep a null record at 0."""
    return claims.select("claim_id").join(ambiguity(scores), "claim_id", "left").select(
        "claim_id", "record_id",
        round3(F.coalesce("score", F.lit(0.0))).alias("confidence"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("ambiguous", F.lit(True)).alias("ambiguous"),
        F.lit(strategy).alias("strategy"),
    )


def adjudicate(matches: DataFrame, shortlist: DataFrame, decisions: DataFrame) -> DataFrame:
    """Merge external decisions into ambiguous matches.

    ``decisions(claim_id, record_id, confidence)``: a record is accepted only from the
    shortlist; a null record means "none of these"; anything else leaves the match alone.
    """
    given = decisions.select(
        "claim_id", F.col("record_id").alias("_chosen"), F.col("confidence").alias("_sure"),
        F.lit(True).alias("_decided"),
    )
    joined = matches.join(shortlist, "claim_id", "left").join(given, "claim_id", "left")
    open_ = F.col("ambiguous") & F.coalesce("_decided", F.lit(False))
    empty = open_ & F.col("shortlist").isNull()
    none = open_ & F.col("shortlist").isNotNull() & F.col("_chosen").isNull()
    accepted = open_ & F.coalesce(F.array_contains("shortlist", F.col("_chosen")), F.lit(False))
    return joined.select(
        "claim_id",
        F.when(empty | none, None).when(accepted, F.col("_chosen")).otherwise(F.col("record_id")).alias("record_id"),
        F.when(empty, 0.0)
        .when(none, F.least(F.col("score"), F.lit(1.0) - F.col("_sure")))
        .when(accepted, round3(F.col("_sure")))
        .otherwise(F.col("confidence")).alias("confidence"),
        F.when(none | accepted, "llm_adjudicated").otherwise(F.col("strategy")).alias("strategy"),
    )


def known_record_matches(matches: DataFrame, records: DataFrame, threshold: float = K.TRACE_THRESHOLD) -> DataFrame:
    """Whether a match clears the gate, and whether its record is externally verified."""
    joined = matches.join(records.select("record_id", "dataset_provenance"), "record_id", "left")
    similarity = round3(F.col("confidence"))
    matched = F.col("record_id").isNotNull() & (similarity >= threshold)
    return joined.select(
        "claim_id", matched.alias("matched"),
        F.when(matched, F.col("record_id")).alias("record_id"),
        F.when(matched, F.col("dataset_provenance")).alias("dataset_provenance"),
        similarity.alias("similarity"),
        (matched & F.coalesce(F.col("dataset_provenance") == "externally_verified", F.lit(False))).alias("verified"),
        confidence_band(similarity).alias("band"),
    )


def evaluate(predictions: DataFrame, threshold: float = K.TRACE_THRESHOLD) -> DataFrame:
    """Routing accuracy per kind of wording.

    ``predictions(kind, expected, record_id, confidence)``; a null ``expected`` marks an
    unrelated text, which must not be traced.
    """
    right = F.col("record_id").eqNullSafe(F.col("expected"))
    traced = F.col("confidence") >= threshold
    related = F.col("expected").isNotNull()
    return predictions.groupBy("kind").agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(related & right).alias("routed"),
        F.count_if(related & right & traced).alias("routed_and_traced"),
        F.count_if(related & ~traced).alias("below_threshold"),
        F.count_if(~related & traced).alias("falsely_traced"),
        round3(F.avg(F.when(related, right.cast("double")))).alias("accuracy"),
    )
