"""Structured fields of one claim sentence, each a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions.dates import event_date
from tracewell.functions.patterns import by_alphabet, captured, first_captured, first_label, found, java, removed
from tracewell.functions.text import clean, key_of_squeezed, let


def has_finite_verb(claim: Column) -> Column:
    return found(claim, K.FINITE_VERB)


def certainty(claim: Column) -> Column:
    return F.coalesce(
        first_label(F.lower(claim), K.CERTAINTY),
        F.when(has_finite_verb(claim), "asserted").otherwise("unknown"),
    )


def quote_segments(claim: Column) -> Column:
    """Double-quoted, then single-quoted segments, cleaned, blanks dropped."""
    both = F.concat(
        F.regexp_extract_all(claim, F.lit(java(K.DOUBLE_QUOTED)), 1),
        F.regexp_extract_all(claim, F.lit(java(K.SINGLE_QUOTED)), 1),
    )
    return F.filter(F.transform(both, clean), lambda q: q != "")


def quoted_speaker(claim: Column) -> Column:
    return F.when(F.size(quote_segments(claim)) > 0, first_captured(claim, K.SPEAKERS))


def correction_verdict(claim: Column) -> Column:
    return F.coalesce(first_label(F.lower(claim), K.VERDICT), F.lit("not_applicable"))


def source_stance(claim: Column, verdict: Column, speaker: Column) -> Column:
    return (
        F.when(
            verdict.isin("false", "misleading"),
            F.when(found(claim, K.CORRECTING), "corrects").otherwise("rejects"),
        )
        .when(verdict.isin("mixed", "unverified"), "corrects")
        .when(speaker.isNotNull(), "quotes")
        .when(F.trim(claim).endswith("?"), "questions")
        .when(found(claim, K.REPORTING), "reports")
        .when(has_finite_verb(claim), "asserts")
        .otherwise("unknown")
    )


def claim_type(claim: Column, title: Column, verdict: Column, speaker: Column) -> Column:
    return (
        F.when(found(claim, K.FACT_CHECK_LABEL), "fact_check_framing")
        .when((verdict != "not_applicable") & found(claim, K.CORRECTION_WORDS), "correction")
        .when(speaker.isNotNull(), "quotation")
        .when(found(claim, K.CAPTION_WORDS), "caption")
        .when(key_of_squeezed(clean(claim)) == key_of_squeezed(clean(title)), "headline")
        .when(has_finite_verb(claim), "claim")
        .otherwise("unknown")
    )


def normalized_proposition(claim: Column, speaker: Column) -> Column:
    """What is claimed, without narrator framing; a named speaker's longest quotation wins."""
    unframed = clean(claim)
    for pattern in K.FRAMING:
        unframed = let(unframed, lambda text: removed(text, pattern))
    longest = lambda bare: F.array_max(
        F.transform(
            quote_segments(bare),
            lambda q, i: F.struct(F.length(q).alias("size"), (-i).alias("earliest"), q.alias("text")),
        )
    )["text"]
    value = let(unframed, lambda bare: F.coalesce(
        F.when(speaker.isNotNull(), longest(bare)), removed(bare, K.NARRATION)
    ))
    plain = F.regexp_replace(F.regexp_replace(clean(value), "[“”]", '"'), "’", "'")
    return F.lower(F.regexp_replace(plain, r"[.!?]+\z", ""))


def subject(claim: Column) -> Column:
    """What stands before the first finite verb, 2 to 120 characters."""
    before = r"^([\x{0}-\x{10FFFF}]*?)" + K.FINITE_VERB
    head = by_alphabet(claim, before, True, lambda p: F.regexp_extract(claim, p, 1))
    named = lambda h: clean(F.regexp_replace(h, "^[\"'“”‘’]+|[\"'“”‘’]+\\z", ""))
    return let(head, lambda h: F.when(F.length(h) >= 2, let(named(h), lambda n: F.when(F.length(n).between(2, 120), n))))


def event(claim: Column) -> Column:
    """The first finite verb and all that follows."""
    value = clean(by_alphabet(claim, K.FINITE_VERB + r"[\x{0}-\x{10FFFF}]*", True, lambda p: F.regexp_extract(claim, p, 0)))
    return let(value, lambda v: F.when(F.length(v) >= 2, v))


def attribution(claim: Column) -> Column:
    return first_captured(claim, K.ATTRIBUTION)


def actor(claim: Column, source: Column) -> Column:
    return F.coalesce(captured(claim, K.ACTOR), source)


def location(claim: Column) -> Column:
    return captured(claim, K.LOCATION, ignore_case=False)


def causal_language(claim: Column) -> Column:
    return first_captured(claim, K.CAUSE)


def caption_context(claim: Column) -> Column:
    synthetic = found(claim, K.SYNTHETIC_MEDIA)
    genuine = found(claim, K.GENUINE_MEDIA) | (found(claim, K.WAS_PHOTOGRAPHED) & ~synthetic)
    contexts = F.array_compact(F.array(
        F.when(synthetic, K.SYNTHETIC_LABEL),
        F.when(genuine, K.GENUINE_LABEL),
        F.concat(F.lit("Presented as "), captured(claim, K.PRESENTED_AS)),
        F.concat(F.lit("Caption: "), captured(claim, K.QUOTED_CAPTION)),
    ))
    return F.when(
        found(claim, K.MEDIA_WORDS), F.nullif(F.array_join(F.array_distinct(contexts), "; "), F.lit(""))
    )


def qualifiers(claim: Column, source: Column) -> Column:
    labels = [F.when(found(claim, pattern), label) for pattern, label in K.QUALIFIERS]
    return F.array_distinct(
        F.array_compact(F.array(*labels, F.concat(F.lit("according to "), source)))
    )


def relationship_type(passage: Column) -> Column:
    """The transmission a passage states, null when it states none."""
    same_media = found(passage, K.SAME_MEDIA_NOUN) & found(passage, K.SAME_MEDIA_REUSE)
    return F.when(same_media, "same_media").otherwise(first_label(passage, K.RELATIONSHIP))


def passage_kind(passage: Column) -> Column:
    return F.coalesce(first_label(passage, K.PASSAGE_KIND), F.lit("claim"))



def with_fields(frame, claim: str = "claim", title: str = "title"):
    """Add every claim field to a frame that has a claim (and a title) column."""
    text = F.col(claim)
    return (
        frame.withColumns({
            "attribution": attribution(text),
            "quoted_speaker": quoted_speaker(text),
            "correction_verdict": correction_verdict(text),
        })
        .withColumns({
            "source_stance": source_stance(text, F.col("correction_verdict"), F.col("quoted_speaker")),
            "claim_type": claim_type(text, F.col(title), F.col("correction_verdict"), F.col("quoted_speaker")),
            "normalized_proposition": normalized_proposition(text, F.col("quoted_speaker")),
            "subject": subject(text),
            "event": event(text),
            "event_date": event_date(text),
            "location": location(text),
            "actor": actor(text, F.col("attribution")),
            "causal_language": causal_language(text),
            "certainty": certainty(text),
            "caption_context": caption_context(text),
            "qualifiers": qualifiers(text, F.col("attribution")),
        })
    )


def filled_fields() -> Column:
    """How many of the eight descriptive fields are present."""
    names = (
        "subject", "event", "event_date", "location", "actor", "attribution", "causal_language",
        "caption_context",
    )
    return sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
