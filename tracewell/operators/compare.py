"""Compare the versions of a claim, two at a time, in the order they were published.

A claim has at most ten sources (the acquisition limit), so pairs per claim are bounded by
45 whatever the number of claims; pairs are an equi-join on ``claim_id``.  Everything a
pair needs (terms, keys, the source's passages) is prepared once per version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions.dates import instant_of
from tracewell.functions.fields import relationship_type
from tracewell.functions.patterns import found
from tracewell.functions.text import (
    compare_key, compare_terms, keyed_dice, let, round3, terms_of_key,
)
from tracewell.operators.evidence import unique_evidence
from tracewell.operators.ranking import best_row
from tracewell.operators.versions import best_versions, occurrence_versions, readable_source

EVIDENCE = "array<struct<source_id: string, passage_id: string, exact_text: string, role: string>>"


_COMPARED = ("causal_language", "location", "quoted_speaker", "caption_context")


def prepared(frame: DataFrame, texts: dict[str, Column], **also: Column) -> DataFrame:
    """What comparing two versions needs of each: keys and terms of its fields and of ``texts``, made once per version.

    Terms are read off the keys, which are columns by then.
    """
    texts = {**{name: F.col(name) for name in _COMPARED}, **texts}
    # Attribution is presentation, not a qualifier of the claim.
    meaningful = F.filter("qualifiers", lambda x: ~found(x, r"^according to\s+"))
    meant = F.transform(meaningful, lambda x: let(compare_key(x), lambda key: F.struct(
        x.alias("label"), key.alias("key"), terms_of_key(key).alias("terms"))))
    return frame.withColumns({**{f"{name}_key": compare_key(text) for name, text in texts.items()}, "meant": meant, **also}).withColumns(
        {f"{name}_terms": terms_of_key(F.col(f"{name}_key")) for name in texts})


_PREPARED = [f"{n}_{part}" for n in _COMPARED for part in ("key", "terms")] + ["meant"]


def _alike(a_key: Column, a_terms: Column, b_key: Column, b_terms: Column) -> Column:
    return (a_key == b_key) | (keyed_dice(a_key, a_terms, b_key, b_terms) >= K.EQUAL_DICE)


def same_field(name: str) -> Column:
    """The field of ``l`` and ``r`` means the same; null when either is missing."""
    return _alike(*[F.col(f"{side}.{name}_{part}") for side in "lr" for part in ("key", "terms")])


def passage_for(passages: Column, version_passage: Column, evidence_ids: Column) -> Column:
    """The version's own passage, else the first one among its evidence, else null."""
    own = F.get(F.filter(passages, lambda p: p["passage_id"] == version_passage), F.lit(0))
    other = F.get(F.filter(passages, lambda p: F.array_contains(evidence_ids, p["passage_id"])), F.lit(0))
    return F.coalesce(own, other)


def numbered_versions(versions: DataFrame, snaps: DataFrame, most: int = K.ACQUISITION_LIMIT_MAX) -> DataFrame:
    """The best version per source, bound to its snapshot and passage, in time order.

    ``ordinal`` numbers a claim's versions: dated ones by instant, undated last, ties by
    source id.  A claim with more sources than ``most``, which ``select_sources`` never lets pass, is an error:
    every two versions of a claim are compared.
    """
    source = snaps.filter(readable_source()).select(
        "claim_id", "source_id", "title", "domain", "publisher", "author", "published_at", "date_confidence",
        "passages",
        F.array_compact(F.array("canonical_url", "final_url", "original_url")).alias("urls"),
    )
    rows = (
        best_versions(versions).join(source, ["claim_id", "source_id"])
        .withColumn("passage", passage_for(F.col("passages"), F.col("evidence_passage_id"), F.col("evidence_ids")))
        .filter(F.col("passage").isNotNull())
        .withColumn("published_ts", instant_of(F.col("published_at")))
    )
    order = Window.partitionBy("claim_id").orderBy(F.asc_nulls_last("published_ts"), F.asc("source_id"))
    too_many = F.raise_error(F.lit(f"a claim has more than {most} sources; select_sources bounds them")).cast("int")
    return rows.withColumn("ordinal", F.row_number().over(order)).withColumn(
        "ordinal", F.when(F.col("ordinal") <= most, F.col("ordinal")).otherwise(too_many))


def ready(numbered: DataFrame, **also: Column) -> DataFrame:
    """Numbered versions with what comparing them needs, which is much wider than they are: made after they were moved."""
    texts = {"proposition": F.col("normalized_proposition"), "event": F.coalesce("event", F.lit(""))}
    return prepared(numbered, texts, **also)


def ready_in_order(numbered: DataFrame) -> DataFrame:
    """:func:`ready`, with what pairs need besides.  Rows are sorted while they are narrow; ``pairs`` asks for this order."""
    return ready(numbered.sortWithinPartitions("claim_id", "ordinal"), names=names_of_source(), stated=stated_transmissions())


def bound_versions(versions: DataFrame, snaps: DataFrame, most: int = K.ACQUISITION_LIMIT_MAX) -> DataFrame:
    """:func:`numbered_versions`, ready to be compared."""
    return ready_in_order(numbered_versions(versions, snaps, most))


_VERSION_SIDE = (
    "source_id normalized_proposition quoted_speaker claim_type event_date location causal_language certainty "
    "caption_context qualifiers confidence passage published_ts proposition_key proposition_terms event_key "
    "event_terms date_confidence"
).split() + _PREPARED
#: Columns of bound versions that are made from the others.
_MADE = [f"{n}_{part}" for n in (*_COMPARED, "proposition", "event") for part in ("key", "terms")] + ["meant", "names", "stated"]


def pairs(bound: DataFrame) -> DataFrame:
    """Every two versions of a claim, earlier one left.

    A version meets the later ones of its claim, at most nine, in a frame of the window that numbers them: what a
    version is made from is worked out and moved once, not once for each side of a join.
    """
    left = F.struct(*_VERSION_SIDE, "names").alias("l")
    right = F.struct(*_VERSION_SIDE, "stated", "ordinal")
    following = Window.partitionBy("claim_id").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    rows = bound.filter(F.col("claim_id").isNotNull()).select(
        "claim_id", left, F.collect_list(right).over(following).alias("_later"))
    return rows.select("claim_id", "l", F.explode("_later").alias("r"))


def evidence(side: str, role: str) -> Column:
    return F.struct(
        F.col(f"{side}.source_id").alias("source_id"), F.col(f"{side}.passage.passage_id").alias("passage_id"),
        F.col(f"{side}.passage.text").alias("exact_text"), F.lit(role).alias("role"),
    )


# ---------------------------------------------------------------- relationships

def names_of_source() -> Column:
    """What a passage may call a source by, in the order of preference, lower-case; names too short to tell are left out."""
    name = lambda kind, value, fits=F.lit(True): let(F.lower(F.trim(value)), lambda n: F.when(
        fits & (F.length(n) >= 3),
        F.struct(F.lit(kind).alias("kind"), F.lit(K.REFERENCE_CONFIDENCE[kind]).alias("confidence"), n.alias("name"))))
    site = F.regexp_replace("domain", r"(?i)^www\.", "")
    return F.array_compact(F.concat(
        F.transform("urls", lambda u: name("url", u)),
        F.array(name("domain", site, F.length(site) >= 4), name("publisher", F.col("publisher")),
                name("author", F.col("author")), name("title", F.col("title"), F.size(compare_terms(F.col("title"))) >= 3))))


def stated_transmissions() -> Column:
    """Passages that state a transmission, whatever source they mean."""
    told = F.filter("passages", lambda p: p["kind"].isin("provenance", "context", "claim"))
    return F.filter(F.transform(told, lambda p: F.struct(
        relationship_type(p["text"]).alias("type"), F.lower(p["text"]).alias("lower"), p["passage_id"].alias("passage_id"),
        p["text"].alias("text"), p["relevance"].alias("relevance"))), lambda s: s["type"].isNotNull())


def reference_to(names: Column, lower: Column) -> Column:
    """How surely a lower-case passage names an earlier source: the first name it holds, null if it holds none."""
    return F.get(F.filter(names, lambda n: lower.contains(n["name"])), F.lit(0))


def _in_order() -> Column:
    """Not known to be out of order."""
    return F.coalesce(F.col("l.published_ts") <= F.col("r.published_ts"), F.lit(True))


def explicit_relationship() -> Column:
    """The first of the later source's passages that states a transmission from the earlier one."""
    naming = F.transform("r.stated", lambda s: F.struct(
        s["type"].alias("type"), reference_to(F.col("l.names"), s["lower"]).alias("ref"), s["passage_id"].alias("passage_id"),
        s["text"].alias("text"), s["relevance"].alias("relevance")))
    first = F.get(F.filter(naming, lambda s: s["ref"].isNotNull()), F.lit(0))

    def assessed(s: Column) -> Column:
        confidence = round3(
            F.least(
                s["ref"]["confidence"], F.greatest(F.lit(0.45), s["relevance"]),
                F.col("l.confidence"), F.col("r.confidence"),
            ) * F.when(_in_order(), 1.0).otherwise(0.7)
        )
        mention = F.struct(
            F.col("r.source_id").alias("source_id"), s["passage_id"].alias("passage_id"),
            s["text"].alias("exact_text"), F.lit("source_reference").alias("role"),
        )
        return F.when(s.isNotNull(), let(confidence, lambda c: F.struct(
            s["type"].alias("type"),
            F.when(_in_order() & (c >= 0.75), "established").when(c >= 0.5, "candidate")
            .otherwise("insufficient_evidence").alias("status"),
            c.alias("confidence"),
            unique_evidence(F.array(evidence("l", "before"), mention, evidence("r", "after"))).alias("evidence"),
        )))

    return let(first, assessed)


def proposition_dice() -> Column:
    return keyed_dice(*[F.col(c) for c in (
        "l.proposition_key", "l.proposition_terms", "r.proposition_key", "r.proposition_terms")])


def event_dice() -> Column:
    """Similarity of the events; two missing events count as the same event."""
    return keyed_dice(*[F.col(c) for c in ("l.event_key", "l.event_terms", "r.event_key", "r.event_terms")])


def descriptive_relationship() -> Column:
    """What two versions share when neither cites the other.  Needs ``_prop`` and ``_event``."""
    least = F.least(F.col("l.confidence"), F.col("r.confidence"))
    ordered = F.coalesce(F.col("l.published_ts") <= F.col("r.published_ts"), F.lit(False))
    both = F.array(evidence("l", "before"), evidence("r", "after"))
    make = lambda kind, status, confidence: F.struct(
        F.lit(kind).alias("type"), F.lit(status).alias("status"), confidence.alias("confidence"),
        both.alias("evidence"))
    return (
        F.when(F.col("_prop") >= K.EQUAL_DICE, make("same_claim", "established", round3(least)))
        .when(F.col("_event") >= K.SAME_EVENT_DICE, make("same_event", "candidate", round3(F.least(least, F.col("_event")))))
        .when(F.col("_prop") >= K.COMPARABLE_DICE, make("related_claim", "candidate", round3(F.least(least, F.col("_prop")))))
        .when(ordered, make("temporal_order", "established", round3(
            F.least(F.col("l.date_confidence"), F.col("r.date_confidence")))))
        .otherwise(make("temporal_order", "insufficient_evidence", F.lit(0.0)))
    )


# ---------------------------------------------------------------- changes

def change_list(confidence: Column) -> Column:
    """The changes between ``l`` and ``r``; needs ``_prop``, ``relationship``, ``evidence_ids``."""
    left, right = (lambda n: F.col(f"l.{n}")), (lambda n: F.col(f"r.{n}"))
    ids = F.col("evidence_ids")

    def change(condition, kind, before, after, sure) -> Column:
        return F.when(condition & (F.size(ids) >= 2), F.struct(
            F.lit(kind).alias("type"), before.cast("string").alias("before"), after.cast("string").alias("after"),
            ids.alias("evidence_ids"), round3(sure).alias("confidence"),
        ))

    none = F.lit(None)
    missing_from = lambda a, b: F.transform(
        F.filter(a, lambda x: ~F.exists(b, lambda y: _alike(x["key"], x["terms"], y["key"], y["terms"]))),
        lambda x: x["label"])
    removed = missing_from(left("meant"), right("meant"))
    added = missing_from(right("meant"), left("meant"))
    cause_l, cause_r = left("causal_language"), right("causal_language")
    cause_differs = cause_l.isNotNull() & cause_r.isNotNull() & ~same_field("causal_language")
    both_quoted = (
        (left("claim_type") == "quotation") & (right("claim_type") == "quotation")
        & left("quoted_speaker").isNotNull() & right("quoted_speaker").isNotNull()
    )
    same_speaker = same_field("quoted_speaker")
    ranks = F.create_map(*[F.lit(v) for pair in K.CERTAINTY_RANK.items() for v in pair])
    rank = lambda side: F.try_element_at(ranks, side("certainty"))
    same_media = F.col("relationship.type") == "same_media"
    bounded = F.least(confidence, F.col("relationship.confidence"))
    shown = lambda side: F.concat(
        side("event_date"), F.lit(": "), F.coalesce(side("caption_context"), side("normalized_proposition")))
    return F.array_compact(F.array(
        change(F.size(removed) > 0, "context_removed", F.array_join(removed, "; "), none, confidence),
        change(F.size(added) > 0, "context_added", none, F.array_join(added, "; "), confidence),
        change(cause_l.isNotNull() & cause_r.isNull(), "cause_removed", cause_l, none, confidence * 0.95),
        change(cause_differs, "cause_removed", cause_l, none, confidence * 0.9),
        change(cause_l.isNull() & cause_r.isNotNull(), "cause_introduced", none, cause_r, confidence * 0.95),
        change(cause_differs, "cause_introduced", none, cause_r, confidence * 0.9),
        change(both_quoted & ~same_speaker & (F.col("_prop") >= 0.72), "attribution_changed",
               left("quoted_speaker"), right("quoted_speaker"), confidence * 0.94),
        change(left("event_date") != right("event_date"), "date_changed",
               left("event_date"), right("event_date"), confidence * 0.96),
        change(left("location").isNotNull() & right("location").isNotNull()
               & ~same_field("location"), "location_changed",
               left("location"), right("location"), confidence * 0.92),
        change(rank(right) > rank(left), "certainty_strengthened", left("certainty"), right("certainty"), confidence),
        change(rank(right) < rank(left), "certainty_weakened", left("certainty"), right("certainty"), confidence),
        change(both_quoted & same_speaker & (F.col("_prop") >= 0.35) & (F.col("_prop") < 0.78), "quotation_changed",
               left("normalized_proposition"), right("normalized_proposition"), confidence * 0.9),
        change(same_media & left("caption_context").isNotNull() & right("caption_context").isNotNull()
               & ~same_field("caption_context"), "caption_changed",
               left("caption_context"), right("caption_context"), bounded),
        change(same_media & (F.col("relationship.status") != "insufficient_evidence")
               & (left("event_date") < right("event_date")), "old_media_reused",
               shown(left), shown(right), bounded),
    ))


_NO_CHANGES = (
    "array<struct<type: string, before: string, after: string, evidence_ids: array<string>, confidence: double>>"
)


def compare_pairs(paired: DataFrame) -> DataFrame:
    """One comparison per pair: relationship, changes, confidence and status.

    All in projections on the pair row; no step shuffles.
    """
    dated = F.coalesce(
        (F.col("l.published_ts") <= F.col("r.published_ts"))
        & (F.col("l.date_confidence") >= 0.5) & (F.col("r.date_confidence") >= 0.5), F.lit(False))
    confidence = round3(
        F.least(F.col("l.confidence"), F.col("r.confidence"))
        * F.when(F.col("_dated"), 1.0).otherwise(K.UNPROVEN_CHRONOLOGY_FACTOR))
    comparable = (F.size("evidence_ids") >= 2) & (F.col("_prop") >= K.COMPARABLE_DICE)
    rows = (
        paired.withColumns({
            "_prop": proposition_dice(), "_event": event_dice(), "_dated": dated,
            "_explicit": explicit_relationship(),
            "evidence_ids": F.array_distinct(F.array("l.passage.passage_id", "r.passage.passage_id")),
        })
        .withColumns({
            "relationship": F.coalesce(F.col("_explicit"), descriptive_relationship()),
            "_confidence": confidence, "_comparable": comparable,
        })
    )
    return rows.select(
        "claim_id",
        F.concat_ws(":", F.lit("comparison"), "l.source_id", "r.source_id").alias("comparison_id"),
        F.col("l.source_id").alias("from_source_id"), F.col("r.source_id").alias("to_source_id"),
        F.when(F.col("_comparable"), change_list(F.col("_confidence")))
        .otherwise(F.array().cast(_NO_CHANGES)).alias("changes"),
        "evidence_ids",
        F.when(F.col("_comparable"), F.col("_confidence")).otherwise(round3(F.col("_confidence") * 0.5)).alias("confidence"),
        F.when(~F.col("_comparable"), "insufficient_evidence")
        .when(F.col("_dated") & (F.col("_confidence") >= 0.65), "established").otherwise("candidate").alias("status"),
        "relationship", F.col("_prop").alias("similarity"),
    )


def compare_versions(versions: DataFrame, snaps: DataFrame) -> DataFrame:
    return compare_pairs(pairs(bound_versions(versions, snaps)))


def changes_of(comparisons: DataFrame) -> DataFrame:
    """The changes as a table of their own.

    The outer form: from a plain explode Spark infers that the array is not empty and works the whole comparison out
    once more, as a condition on the pair, before it is made.
    """
    return comparisons.select(
        "claim_id", "from_source_id", "to_source_id", F.posexplode_outer("changes").alias("ord", "_c")
    ).filter(F.col("_c").isNotNull()).select("claim_id", "from_source_id", "to_source_id", "ord", "_c.*")


# ---------------------------------------------------------------- occurrences

def _filled(item: Column) -> Column:
    return (F.trim(item["passage_id"]) != "") & (F.trim(item["exact_text"]) != "")


def valid_occurrence() -> Column:
    """The occurrence carries its own evidence of the kind its type promises."""
    own = F.filter("evidence", lambda e: (
        (e["source_id"] == F.col("occurrence_id")) & (e["role"] == "occurrence") & _filled(e)))
    present = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    somewhere = present("source_url") | present("source_identifier")
    kind = F.col("evidence_type")
    promised = (
        F.when(kind == "supplied_url", F.col("source_url").rlike("(?i)^https?://"))
        .when(kind.isin("screenshot", "image"), F.size("evidence_ids") > 0)
        .when(kind == "source_post", somewhere)
        .when(kind == "quoted_context", present("source_context") & (somewhere | present("observed_at")))
        .when(kind == "source_metadata", present("observed_at") & (somewhere | present("source_context")))
    )
    return F.coalesce(
        (F.trim("occurrence_id") != "") & (F.trim("exact_text") != "")
        & (F.size(own) > 0) & (F.size("evidence_ids") > 0)
        & F.forall(own, lambda e: F.array_contains("evidence_ids", e["passage_id"]))
        & promised,
        F.lit(False),
    )


def latest_versions(bound: DataFrame) -> DataFrame:
    """The last dated version of each claim, else the last undated one."""
    recent = F.struct(F.col("published_ts").isNotNull(), F.col("ordinal"))
    return best_row(bound, ["claim_id"], recent)


def supplied_relationship() -> Column:
    """The submitter's relationship, checked against the latest version ``l`` and the occurrence.

    Needs the occurrence columns and ``source_relationship``; fails closed at every gap.
    """
    given = F.col("source_relationship")
    claimed = given["relationship"]
    refuse = lambda kind, items: F.struct(
        kind.alias("type"), F.lit("insufficient_evidence").alias("status"), F.lit(0.0).alias("confidence"),
        items.alias("evidence"))
    live = F.transform(F.col("l.passages"), lambda p: p["passage_id"])
    before = F.exists(given["evidence"], lambda e: (
        (e["source_id"] == F.col("l.source_id")) & e["role"].isin("before", *K.RELATION_ROLES)
        & F.array_contains(live, e["passage_id"]) & (F.trim(e["exact_text"]) != "")))
    own = F.exists(given["evidence"], lambda e: (
        (e["source_id"] == F.col("occurrence_id")) & (e["role"] == "occurrence")
        & F.array_contains("evidence_ids", e["passage_id"]) & (F.trim(e["exact_text"]) != "")))
    stated = F.exists(given["evidence"], lambda e: e["role"].isin(*K.RELATION_ROLES) & _filled(e))
    sure = round3(F.least(given["confidence"], F.col("confidence")))
    accepted = F.struct(
        claimed.alias("type"),
        F.when((given["status"] == "established") & (sure >= 0.75), "established")
        .when(sure >= 0.5, "candidate").otherwise("insufficient_evidence").alias("status"),
        sure.alias("confidence"), unique_evidence(given["evidence"]).alias("evidence"),
    )
    usable = (given["from_source_id"] == F.col("l.source_id")) & claimed.isin(*K.TRANSMISSION_TYPES)
    return (
        F.when(given.isNull() | ~valid_occurrence(), refuse(F.lit("related_claim"), F.col("evidence")))
        .when(~F.coalesce(usable & before & own & stated, F.lit(False)), refuse(claimed, given["evidence"]))
        .otherwise(accepted)
    )


def compare_occurrences(bound: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Compare each claim's latest version with its submitted occurrence."""
    fields = prepared(occurrence_versions(occurrences), {"proposition": F.col("normalized_proposition")}).select("claim_id", F.struct(
        "source_id", "normalized_proposition", "quoted_speaker", "claim_type", "event_date", "location",
        "causal_language", "certainty", "caption_context", "qualifiers", "confidence", "proposition_key", "proposition_terms",
        *_PREPARED,
    ).alias("r"))
    latest = ready(latest_versions(bound.drop(*_MADE))).select("claim_id", F.struct(*_VERSION_SIDE, "passages").alias("l"))
    own = F.get(F.filter("evidence", lambda e: e["role"] == "occurrence"), F.lit(0))["passage_id"]
    after = F.coalesce(own, F.get("evidence_ids", F.lit(0)), F.concat(F.lit("occurrence:"), "occurrence_id"))
    rows = (
        latest.join(occurrences, "claim_id").join(fields, "claim_id")
        .withColumns({
            "relationship": supplied_relationship(),
            "_prop": proposition_dice(),
            "_ids": F.array_distinct(F.array(F.col("l.passage.passage_id"), after)),
            "_confidence": round3(F.least(F.col("l.confidence"), F.col("r.confidence"))),
        })
        .withColumn("evidence_ids", F.col("_ids"))
    )
    comparable = F.col("_prop") >= K.COMPARABLE_DICE
    refused = ~comparable | (F.col("relationship.status") == "insufficient_evidence")
    return rows.select(
        "claim_id",
        F.concat_ws(":", F.lit("comparison"), "l.source_id", "occurrence_id").alias("comparison_id"),
        F.col("l.source_id").alias("from_source_id"), F.col("occurrence_id").alias("to_source_id"),
        F.when(comparable, change_list(F.col("_confidence"))).otherwise(F.array().cast(_NO_CHANGES)).alias("changes"),
        "evidence_ids",
        F.when(refused, round3(F.col("_confidence") * 0.5))
        .otherwise(round3(F.least(F.col("_confidence"), F.col("relationship.confidence")))).alias("confidence"),
        F.when(refused, "insufficient_evidence").otherwise(F.col("relationship.status")).alias("status"),
        "relationship", F.col("_prop").alias("similarity"),
    )
