"""Claim text: cleaning, tokenizers, negation, similarity."""

from __future__ import annotations

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracewell import constants as K
from tracewell.functions.patterns import CONTROL, JAVA_SPACES, SOFT_CONTROL, SPACE, SPACE_SET, java

_ALNUM = list(string.ascii_lowercase + string.digits)


def words(values) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body) -> Column:
    """Bind a value to a name: ``body`` may use it many times, it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---------------------------------------------------------------- cleaning

def squeeze(text: Column) -> Column:
    """White space runs become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, JAVA_SPACES, " "))


def clean(text: Column) -> Column:
    """Like :func:`squeeze`, with control characters as white space."""
    return squeeze(F.regexp_replace(text, CONTROL, " "))


def has_text(text: Column) -> Column:
    """The cleaned text is not empty."""
    return text.rlike(rf"[^\x00-\x1f\x7f{SPACE_SET}]")


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def clean_lines(text: Column) -> Column:
    """Squeeze inside lines, keep single line breaks; blank becomes null."""
    spaced = F.regexp_replace(F.regexp_replace(text, SOFT_CONTROL, " "), r"[ \t]+", " ")
    lines = F.regexp_replace(spaced, rf"{SPACE}*\n{SPACE}*", "\n")
    return F.nullif(strip_space(lines), F.lit(""))


def clean_label(text: Column, limit: int) -> Column:
    """A one-line label of bounded width; blank becomes null."""
    return F.substring(F.nullif(clean(text), F.lit("")), 1, limit)


# ---------------------------------------------------------------- numbers

def clamp(value: Column) -> Column:
    """Bound to [0, 1]; null stays null (``least`` and ``greatest`` would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def round3(value: Column) -> Column:
    """Clamp to [0, 1] and round half up to three places."""
    return F.floor(clamp(value) * F.lit(1000.0) + F.lit(0.5)) / F.lit(1000.0)


def mean3(value: Column) -> Column:
    """Mean of scores, rounded to three places.

    Scores are added up as whole millionths, so that the order of rows cannot matter.
    """
    total = F.sum(F.round(value * F.lit(1e6)).cast("bigint"))
    count = F.nullif(F.count(value), F.lit(0).cast("bigint"))
    return F.floor(total / (count * F.lit(1000)) + F.lit(0.5)) / F.lit(1000.0)


# ---------------------------------------------------------------- tokenizers

def match_terms(text: Column) -> Column:
    """Distinct ASCII terms for library matching, in order of first use."""
    dropped = words([""] + _ALNUM + K.MATCH_STOPWORDS)
    return F.array_except(F.split(F.lower(text), "[^a-z0-9]+"), dropped)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


# Text made only of these characters is already in NFKC form.
_NFKC_STABLE = (
    r"^[\x00-\x9f\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{131}"
    r"\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{2013}\x{2014}\x{2018}-\x{201e}\x{2022}]*\z"
)


def nfkc(text: Column) -> Column:
    """Unicode NFKC.  Spark has no such function, so the few texts that need it go
    through an Arrow batch; all others reach Python as nulls."""
    return F.coalesce(_nfkc(F.when(~text.rlike(_NFKC_STABLE), text)), text)


def _distinct_terms(pieces: Column, stopwords) -> Column:
    """Distinct pieces of two characters or more, in order; a test of membership, as ``array_except`` hashes the
    stop words anew for every text."""
    return F.array_distinct(F.filter(pieces, lambda t: (F.length(t) > 1) & ~t.isin(*stopwords)))


def _letter_terms(text: Column, stopwords) -> Column:
    return _distinct_terms(F.split(text, r"[^\p{L}\p{N}]+"), stopwords)


def rank_terms(text: Column, normalize: bool = True) -> Column:
    """Distinct Unicode terms for relevance ranking."""
    lowered = F.lower(text)
    return _letter_terms(nfkc(lowered) if normalize else lowered, K.RANK_STOPWORDS)


def version_terms(text: Column) -> Column:
    """Distinct Unicode terms for passage/claim overlap."""
    return _letter_terms(F.lower(text), K.RANK_STOPWORDS)


def key_of_squeezed(text: Column) -> Column:
    """:func:`compare_key` of a text whose spaces are squeezed already."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} ]", "")


def compare_key(text: Column) -> Column:
    """Lower-case text with punctuation deleted (not replaced), spaces squeezed first."""
    return key_of_squeezed(squeeze(text))


def terms_of_key(key: Column) -> Column:
    """:func:`compare_terms` of a text whose key is made already."""
    return _distinct_terms(F.split(key, " +"), K.COMPARE_STOPWORDS)


def compare_terms(text: Column) -> Column:
    """Distinct terms for comparing propositions ("AI-generated" is one term)."""
    return terms_of_key(compare_key(text))


# ---------------------------------------------------------------- claims

def sentences(text: Column) -> Column:
    return F.split(text, rf"(?<=[.!?]){SPACE}+")


def extract_claim(text: Column) -> Column:
    """The first longest sentence with a letter, without links and emoji."""
    bare = F.regexp_replace(F.regexp_replace(text, java(K.URL_IN_TEXT), " "), K.EMOJI, " ")
    longest = lambda cleaned: F.array_max(
        F.transform(
            F.filter(F.split(cleaned, r"(?<=[.!?]) +"), lambda s: s.rlike("[a-zA-Z]")),
            lambda s, i: F.struct(F.length(s).alias("size"), (-i).alias("earliest"), s.alias("text")),
        )
    )["text"]
    return let(squeeze(bare), lambda cleaned: F.coalesce(longest(cleaned), cleaned))


_SKIPPED = "|".join(K.MATCH_STOPWORDS + K.NEGATION_WORDS + K.NEGATION_MODIFIERS)
# A negation (unless "do" stands before it), any skipped words, then the denied word.
_NEGATED = (
    rf"(?<= )(?<! do )(?:{'|'.join(K.NEGATION_WORDS)}) "
    rf"(?:(?:[a-z0-9]|{_SKIPPED}) )*+([a-z0-9]+)(?= )"
)


def negated_terms(text: Column) -> Column:
    """Distinct terms that the text explicitly denies."""
    expanded = F.regexp_replace(F.lower(text), java(K.CONTRACTION), " not ")
    spaced = F.concat(F.lit(" "), F.regexp_replace(expanded, "[^a-z0-9]+", " "), F.lit(" "))
    padded = F.regexp_replace(spaced, " +", " ")
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(_NEGATED), 1))


def confidence_band(score: Column) -> Column:
    return (
        F.when(score >= K.TRACE_THRESHOLD, "high")
        .when(score >= K.PARTIAL_THRESHOLD, "medium")
        .otherwise("low")
    )


# ---------------------------------------------------------------- similarity

def dice(left: Column, right: Column) -> Column:
    """Dice overlap of two distinct-term arrays; 0 when either is empty."""
    total = F.size(left) + F.size(right)
    return F.when(
        (F.size(left) > 0) & (F.size(right) > 0),
        F.lit(2.0) * F.size(F.array_intersect(left, right)) / total,
    ).otherwise(0.0)


def keyed_dice(left_key: Column, left: Column, right_key: Column, right: Column) -> Column:
    """Dice overlap that falls back to key equality when either side has no terms."""
    return F.when(
        (F.size(left) > 0) & (F.size(right) > 0), dice(left, right)
    ).otherwise(F.when(left_key == right_key, 1.0).otherwise(0.0))


def compare_dice(left: Column, right: Column) -> Column:
    """:func:`keyed_dice` straight from two texts."""
    return keyed_dice(compare_key(left), compare_terms(left), compare_key(right), compare_terms(right))


def semantically_equal(left: Column, right: Column) -> Column:
    return (compare_key(left) == compare_key(right)) | (compare_dice(left, right) >= K.EQUAL_DICE)


def phrase_of(claim: Column) -> Column:
    """The claim as it is looked for inside a candidate."""
    return F.lower(squeeze(claim))


def overlap_relevance(
    claim_terms: Column, candidate_terms: Column, phrase: Column, candidate_lower: Column
) -> Column:
    """Bounded lexical relevance from prepared columns (see :func:`text_relevance`)."""
    overlap = F.size(F.array_intersect(claim_terms, candidate_terms)).cast("double")
    union = F.size(claim_terms) + F.size(candidate_terms) - overlap
    bonus = F.when(
        (F.length(phrase) >= K.PHRASE_MIN_CHARACTERS) & candidate_lower.contains(phrase),
        K.PHRASE_BONUS,
    ).otherwise(0.0)
    score = (
        overlap / F.size(claim_terms) * K.COVERAGE_WEIGHT
        + overlap / union * K.JACCARD_WEIGHT
        + bonus
    )
    return F.when(
        (F.size(claim_terms) > 0) & (F.size(candidate_terms) > 0), clamp(score)
    ).otherwise(0.0)


def text_relevance(claim: Column, candidate: Column, normalize: bool = True) -> Column:
    """Coverage, Jaccard and a whole-phrase bonus, within [0, 1]."""
    return overlap_relevance(
        rank_terms(claim, normalize), rank_terms(candidate, normalize),
        phrase_of(claim), F.lower(candidate),
    )


# ---------------------------------------------------------------- queries

def bounded_query(text: Column) -> Column:
    """At most 400 characters and 50 words on one line."""
    short = F.substring(clean(text), 1, K.MAX_QUERY_CHARACTERS)
    return F.array_join(F.slice(F.split(short, " "), 1, K.MAX_QUERY_WORDS), " ")


def discovery_queries(claim: Column) -> Column:
    """Up to three distinct search queries for a claim."""
    return let(bounded_query(claim), _query_variants)


def _query_variants(raw: Column) -> Column:
    quoted = F.when(
        F.length(raw) <= K.QUOTED_QUERY_CHARACTERS,
        F.concat(F.lit('"'), F.replace(raw, F.lit('"'), F.lit("")), F.lit('"')),
    ).otherwise(raw)
    variants = F.array(
        raw,
        bounded_query(F.concat(quoted, F.lit(" fact check context"))),
        bounded_query(F.concat(quoted, F.lit(' origin "first posted"'))),
    )
    distinct = let(
        variants,
        lambda all_: F.filter(
            all_,
            lambda q, i: (q != "")
            & (F.array_position(F.transform(all_, lambda v: F.lower(v)), F.lower(q)) == i + 1),
        ),
    )
    return F.when(raw != "", distinct).otherwise(F.array().cast("array<string>"))


