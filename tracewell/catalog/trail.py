"""Claim versions, comparisons, mutations, graphs and origins on ``events``.

Five consecutive events are the sources of one claim.  Their texts, dates and references are
put together from the event's own columns, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.catalog import sql as S
from tracewell.catalog.registry import query
from tracewell.functions import text as T
from tracewell.functions.fields import relationship_type, with_fields
from tracewell.operators import compare, evidence, graph, mutations, origin, ranking, rollup, versions
from tracewell.session import by_claim, kept, spread
from tracewell.sources import occurrences as occurrence_source

_TYPES = ("signup", "error", "click", "view", "purchase")
_CLAIM = ("The {} outage was caused by a storm in Madrid.", "The photo of the {} outage storm")
_TEXTS = (
    "The {} outage may have been caused by a storm in Madrid on March 3, 2024.",
    "The {} outage was caused by a storm in Madrid on March 3, 2024.",
    "According to Desk 7, the {} outage was caused by sabotage in Lisbon on March 5, 2024.",
    "Dr Vega said \"the {} outage was caused by a storm\" in Madrid.",
    "The {} outage was reportedly confirmed as a storm in Madrid on March 3, 2024 due to rain.",
    "Mayor Ruiz said \"the {} outage was caused by a storm and rain\" in Madrid.",
    "Mayor Ruiz said \"the {} outage came after rain and sabotage in Lisbon, not a storm\" on Monday.",
    "The {} outage was caused by a storm in Madrid on March 9, 2024, unless new data says otherwise.",
    "The photo of the {} outage storm was shared as a real photo of Madrid on March 3, 2024.",
    "The photo of the {} outage storm was described as AI-generated artwork on May 9, 2024.",
)
_REFERENCES = (
    "Reposted from Newsroom {} today.", "Originally posted by Newsroom {} as a hoax.", "As reported by Newsroom {}.",
    "This corrects the account of site{}.example.org.", "The same photo was reused from Newsroom {}.",
    "A local archive was first posted by fans of {}.", "Nothing more is known about it here {}.",
)
_SOURCES = ("official", "social", "news", "fact_check", "primary")


def _filled(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def _pick(options, index: Column) -> Column:
    return F.element_at(F.array(*options), (index + 1).cast("int"))


def _base(t) -> DataFrame:
    """Every event with its claim, dealt by claim: what is made from it is joined and grouped where it lies."""
    by_claim(t.spark)
    n = F.col("event_id")
    rows = spread(t.events.select("event_id", "ts", F.expr("event_id div 5").alias("claim_id")), "claim_id")
    return rows.withColumns({
        "kind": _pick([F.lit(x) for x in _TYPES], F.col("claim_id") % 5),
        "pictured": F.col("claim_id") % 4 == 3,
        "which": (n * 7 + F.col("claim_id") * 3) % 8,
        "source_id": F.concat(F.lit("s"), F.lpad(n.cast("string"), 12, "0")),
    })


def claims(t) -> DataFrame:
    rows = _base(t).groupBy("claim_id").agg(F.first("kind").alias("kind"), F.first("pictured").alias("pictured"))
    return rows.select(
        "claim_id", F.when(F.col("pictured"), _filled(_CLAIM[1], F.col("kind"))).otherwise(_filled(_CLAIM[0], F.col("kind"))).alias("claim"),
        F.concat(F.lit("submission:"), F.col("claim_id").cast("string")).alias("evidence_id"),
        F.when(F.col("claim_id") % 7 == 0, "failed").when(F.col("claim_id") % 7 == 1, "not_configured").otherwise("searched").alias("search_status"),
        F.array(F.concat(F.lit("search:"), F.col("claim_id").cast("string"))).alias("search_ids"),
        (F.col("claim_id") % 23 == 5).alias("acquisition_failed"))


def snapshots(t) -> DataFrame:
    n = F.col("event_id")
    number, previous = n.cast("string"), (n - 1).cast("string")
    which = F.when(F.col("pictured"), F.when(F.col("which") % 3 == 0, 8).otherwise(9)).otherwise(F.col("which"))
    told = _pick([_filled(x, F.col("kind")) for x in _TEXTS], which)
    passage = lambda suffix, text, kind, relevance: F.struct(
        F.concat(F.lit("p"), number, F.lit(suffix)).alias("passage_id"), text.alias("text"), F.lit(kind).alias("kind"),
        relevance.alias("relevance"))
    passages = F.array(
        passage("a", told, "claim", F.when(n % 11 == 0, 0.5).otherwise(0.9)),
        passage("b", _pick([_filled(x, previous) for x in _REFERENCES], n % 7), "provenance", F.when(n % 3 == 0, 0.6).otherwise(0.85)),
        passage("d", F.concat(F.lit("dated "), number), "date", F.lit(0.9)),
    )
    published = F.when(n % 9 != 0, F.date_format(F.date_add(F.to_date("ts"), ((n * 3) % 5).cast("int")), "yyyy-MM-dd"))
    return _base(t).select(
        "claim_id", "source_id", (n % 5).cast("int").alias("idx"),
        F.concat(F.lit("https://site"), number, F.lit(".example.org/a")).alias("original_url"),
        F.lit(None).cast("string").alias("final_url"), F.lit(None).cast("string").alias("canonical_url"),
        F.concat(F.lit("Report on the "), "kind", F.lit(" outage number "), number).alias("title"),
        F.concat(F.lit("site"), number, F.lit(".example.org")).alias("domain"),
        F.concat(F.lit("Newsroom "), number).alias("publisher"), F.lit(None).cast("string").alias("author"),
        published.alias("published_at"),
        F.when(n % 8 == 0, "modified").otherwise("publication").alias("date_type"),
        (F.lit(0.25) + (n % 4) * F.lit(0.25)).alias("date_confidence"),
        F.when(n % 2 == 0, F.concat(F.lit("p"), number, F.lit("d"))).alias("date_passage_id"),
        passages.alias("passages"), _pick([F.lit(x) for x in _SOURCES], n % 5).alias("source_type"),
        ((n % 10) / F.lit(10.0)).alias("retrieval_relevance"),
        F.when(n % 12 != 0, (n % 10) / F.lit(10.0)).alias("evidence_relevance"),
        F.when((F.col("claim_id") % 10 == 9) | (n % 13 == 0), "blocked").when(n % 17 == 0, "partial").otherwise("acquired").alias("acquisition_status"),
        (F.lit(0.5) + (n % 6) * F.lit(0.09)).alias("extraction_confidence"))


def made_versions(t) -> DataFrame:
    return versions.extract_versions(snapshots(t), claims(t))


def bound(t) -> DataFrame:
    return compare.bound_versions(made_versions(t), snapshots(t))


def occurrences(t, tied: DataFrame | None = None) -> DataFrame:
    """Where each claim was seen; every other one says which source it came from."""
    tied = tied if tied is not None else bound(t)
    latest = compare.latest_versions(tied.select("claim_id", "source_id", "passage", "published_ts", "ordinal")).select(
        "claim_id", F.col("source_id").alias("_source"), F.col("passage.passage_id").alias("_passage"),
        F.col("passage.text").alias("_text"))
    rows = claims(t).join(latest, "claim_id")
    number = F.col("claim_id").cast("string")
    own = F.concat(F.lit("o"), number)
    item = lambda source, passage, text, role: F.struct(
        source.alias("source_id"), passage.alias("passage_id"), text.alias("exact_text"), F.lit(role).alias("role"))
    seen = item(own, F.concat(own, F.lit(":occurrence")), F.col("claim"), "occurrence")
    before = lambda role: item(F.col("_source"), F.col("_passage"), F.col("_text"), role)
    given = F.struct(
        F.col("_source").alias("from_source_id"), F.lit("reposted_from").alias("relationship"),
        F.lit("established").alias("status"), F.lit(0.9).alias("confidence"),
        F.array(before("before"), before("source_reference"), seen).alias("evidence"))
    return rows.select(
        "claim_id", own.alias("occurrence_id"), F.col("claim").alias("exact_text"),
        F.lit("").alias("normalized_proposition"), F.lit("supplied_url").alias("evidence_type"),
        F.concat(F.when(F.col("claim_id") % 5 == 0, "ftp").otherwise("https"), F.lit("://posts.example.org/"), number).alias("source_url"),
        F.lit(None).cast("string").alias("source_identifier"), F.lit("2024-06-01T00:00:00.000Z").alias("observed_at"),
        F.lit(None).cast("string").alias("source_context"), F.array(F.concat(own, F.lit(":occurrence"))).alias("evidence_ids"),
        F.array(seen).alias("evidence"), F.lit(0.8).alias("confidence"),
        F.when(F.col("claim_id") % 2 == 0, given).alias("source_relationship"))


class Trail:
    """The tables of one investigation; what several steps read is written once.

    Versions, bound versions, occurrences, comparisons and edges lie by claim, as their sources do, so nothing but the
    events is moved.  Versions are kept as they are numbered: what comparing them needs is several times as large.
    """

    def __init__(self, t):
        self.claims, self.snaps = claims(t), snapshots(t)
        self.versions = kept(versions.extract_versions(self.snaps, self.claims), "claim_id")
        numbered = kept(compare.numbered_versions(self.versions, self.snaps), "claim_id")
        self.bound = compare.ready_in_order(numbered)
        self.occurrences = kept(occurrences(t, self.bound), "claim_id")
        self.comparisons = compare.compare_pairs(compare.pairs(self.bound)).unionByName(compare.compare_occurrences(
            self.bound, self.occurrences.filter(compare.valid_occurrence())))

    def compared(self) -> Trail:
        """With comparisons kept, for queries that read them more than once."""
        self.comparisons = kept(self.comparisons, "claim_id")
        return self

    def mutations(self) -> DataFrame:
        return mutations.detect_mutations(self.comparisons)

    def nodes(self) -> DataFrame:
        return graph.nodes(self.claims, self.versions, self.snaps, self.occurrences)

    def edges(self) -> DataFrame:
        return graph.edges(self.comparisons, self.mutations(), self.nodes())


# ---------------------------------------------------------------- the same in SQL


def _sql_pick(options, index: str) -> str:
    return "[" + ", ".join(options) + f"][({index}) + 1]"


def _sql_filled(template: str, value: str) -> str:
    before, after = template.split("{}")
    return f"({S.text(before)} || {value} || {S.text(after)})"


_BASE = f"""
base AS MATERIALIZED (SELECT event_id AS n, ts, event_id // 5 AS claim_id, {S.strings(_TYPES)}[(event_id // 5) % 5 + 1] AS kind,
  (event_id // 5) % 4 = 3 AS pictured, (event_id * 7 + event_id // 5 * 3) % 8 AS which, 's' || lpad(event_id::VARCHAR, 12, '0') AS source_id FROM events),
claims AS MATERIALIZED (SELECT DISTINCT claim_id, CASE WHEN pictured THEN {_sql_filled(_CLAIM[1], 'kind')} ELSE {_sql_filled(_CLAIM[0], 'kind')} END AS claim FROM base),
snaps AS MATERIALIZED (SELECT claim_id, source_id, n, n % 5 AS idx, 'Report on the ' || kind || ' outage number ' || n AS title,
  'Newsroom ' || n AS publisher, 'site' || n || '.example.org' AS domain, 'https://site' || n || '.example.org/a' AS url,
  {_sql_pick([_sql_filled(x, 'kind') for x in _TEXTS], 'CASE WHEN pictured THEN CASE WHEN which % 3 = 0 THEN 8 ELSE 9 END ELSE which END')} AS told,
  CASE WHEN n % 11 = 0 THEN 0.5e0 ELSE 0.9e0 END AS told_relevance,
  {_sql_pick([_sql_filled(x, '(n - 1)') for x in _REFERENCES], 'n % 7')} AS refers, CASE WHEN n % 3 = 0 THEN 0.6e0 ELSE 0.85e0 END AS refers_relevance,
  CASE WHEN n % 9 <> 0 THEN strftime(ts::DATE + ((n * 3) % 5)::INT, '%Y-%m-%d') END AS published_at,
  CASE WHEN n % 8 = 0 THEN 'modified' ELSE 'publication' END AS date_type, 0.25e0 + (n % 4) * 0.25e0 AS date_confidence,
  {S.strings(_SOURCES)}[n % 5 + 1] AS source_type, (n % 10) / 10e0 AS retrieval_relevance, CASE WHEN n % 12 <> 0 THEN (n % 10) / 10e0 END AS evidence_relevance,
  CASE WHEN claim_id % 10 = 9 OR n % 13 = 0 THEN 'blocked' WHEN n % 17 = 0 THEN 'partial' ELSE 'acquired' END AS status,
  0.5e0 + (n % 6) * 0.09e0 AS extraction_confidence FROM base)
"""
_VERSIONS = f"""{_BASE},
readable AS MATERIALIZED (SELECT s.*, claim AS asked, {S.letter_terms('claim')} AS ct FROM snaps s JOIN claims USING (claim_id)
  WHERE status = 'acquired' OR (status = 'partial' AND extraction_confidence >= 0.55e0)),
offered AS (
  SELECT *, 'p' || n || 'a' AS passage_id, told AS ptext, 'claim' AS pkind, told_relevance AS prel FROM readable
  UNION ALL SELECT *, 'p' || n || 'b', refers, 'provenance', refers_relevance FROM readable),
overlapped AS MATERIALIZED (SELECT *, {S.dice_of('pt', 'ct')} AS overlap FROM (SELECT *, {S.letter_terms('ptext')} AS pt FROM offered)),
eligible AS (SELECT *, row_number() OVER (PARTITION BY claim_id, source_id
    ORDER BY (CASE WHEN pkind = 'claim' THEN 1e0 ELSE 0.72e0 END) * (0.65e0 * prel + 0.35e0 * overlap) DESC, passage_id) AS place
  FROM overlapped WHERE prel >= 0.55e0 AND ((pkind = 'claim' AND overlap >= 0.28e0) OR (pkind = 'provenance' AND overlap >= 0.25e0))),
chosen AS MATERIALIZED (SELECT *, {S.clean('ptext')} AS claim FROM eligible WHERE place = 1),
{S.fields('chosen', 'fielded')},
versions AS MATERIALIZED (SELECT *, {S.round3("0.42e0 * " + S.clamp('extraction_confidence') + " + 0.43e0 * " + S.clamp('prel') + " + 0.1e0 * overlap + 0.05e0 * least(1e0, ((subject IS NOT NULL)::INT + (event IS NOT NULL)::INT + (event_date IS NOT NULL)::INT + (location IS NOT NULL)::INT + (actor IS NOT NULL)::INT + (attribution IS NOT NULL)::INT + (causal_language IS NOT NULL)::INT + (caption_context IS NOT NULL)::INT) / 4e0)")} AS confidence FROM fielded)
"""
_BOUND = f"""{_VERSIONS},
bound AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY published_at NULLS LAST, source_id) AS ordinal,
  {S.compare_key('normalized_proposition')} AS pk, {S.compare_terms('normalized_proposition')} AS pt2,
  {S.compare_key("coalesce(event, '')")} AS ek, {S.compare_terms("coalesce(event, '')")} AS et FROM versions)
"""


def _mentions(x: str, ident: str) -> str:
    return f"(length({ident}) >= 3 AND contains(lower({x}), lower({ident})))"


def _stated(p: str) -> str:
    media = f"{S.found(p, K.SAME_MEDIA_NOUN)} AND {S.found(p, K.SAME_MEDIA_REUSE)}"
    rest = " ".join(f"WHEN {S.found(p, x)} THEN {S.text(label)}" for label, x in K.RELATIONSHIP)
    return f"CASE WHEN {media} THEN 'same_media' {rest} END"


def _referred(p: str) -> str:
    return (
        f"CASE WHEN {_mentions(p, 'l.url')} THEN 0.99e0 WHEN {_mentions(p, 'l.domain')} THEN 0.94e0 "
        f"WHEN {_mentions(p, 'l.publisher')} THEN 0.84e0 WHEN {_mentions(p, 'l.title')} THEN 0.8e0 END")


_SIDE = (
    "n source_id normalized_proposition quoted_speaker claim_type event_date location causal_language certainty caption_context qualifiers "
    "confidence published_at date_confidence passage_id ptext told told_relevance refers refers_relevance url domain publisher title pk pt2 ek et"
).split()


def _changes(source: str, conf: str) -> str:
    """Change rows of pairs ``source`` with structs l and r, ``prop``, ``rtype``, ``rstatus``, ``rconf``."""
    plain = lambda q: f"list_filter({q}, lambda z: NOT regexp_matches(z, '(?i)^according to '))"
    # Qualifier labels are fixed one- or two-word values: equal labels are the same qualifier.
    minus = lambda a, b: f"list_filter({plain(a)}, lambda y: NOT list_contains({plain(b)}, y))"
    rank = lambda s: f"map {{'possibility': 1, 'uncertain': 2, 'probable': 3, 'asserted': 4, 'confirmed': 5}}[{s}.certainty]"
    same = lambda f: S.semantically_equal(f"l.{f}", f"r.{f}")
    quoted = "l.claim_type = 'quotation' AND r.claim_type = 'quotation' AND l.quoted_speaker IS NOT NULL AND r.quoted_speaker IS NOT NULL"
    rules = (
        ("context_removed", f"len({minus('l.qualifiers', 'r.qualifiers')}) > 0", f"{conf}"),
        ("context_added", f"len({minus('r.qualifiers', 'l.qualifiers')}) > 0", f"{conf}"),
        ("cause_removed", "l.causal_language IS NOT NULL AND r.causal_language IS NULL", f"{conf} * 0.95e0"),
        ("cause_introduced", "l.causal_language IS NULL AND r.causal_language IS NOT NULL", f"{conf} * 0.95e0"),
        ("cause_removed", f"NOT {same('causal_language')}", f"{conf} * 0.9e0"),
        ("cause_introduced", f"NOT {same('causal_language')}", f"{conf} * 0.9e0"),
        ("attribution_changed", f"{quoted} AND NOT {same('quoted_speaker')} AND prop >= 0.72e0", f"{conf} * 0.94e0"),
        ("date_changed", "l.event_date <> r.event_date", f"{conf} * 0.96e0"),
        ("location_changed", f"NOT {same('location')}", f"{conf} * 0.92e0"),
        ("certainty_strengthened", f"{rank('r')} > {rank('l')}", f"{conf}"),
        ("certainty_weakened", f"{rank('r')} < {rank('l')}", f"{conf}"),
        ("quotation_changed", f"{quoted} AND {same('quoted_speaker')} AND prop >= 0.35e0 AND prop < 0.78e0", f"{conf} * 0.9e0"),
        ("caption_changed", f"rtype = 'same_media' AND NOT {same('caption_context')}", f"least({conf}, rconf)"),
        ("old_media_reused", "rtype = 'same_media' AND rstatus <> 'insufficient_evidence' AND l.event_date < r.event_date", f"least({conf}, rconf)"),
    )
    return "\n  UNION ALL ".join(
        f"SELECT claim_id, from_id, to_id, {S.text(kind)} AS type, {S.round3(sure)} AS cconf FROM {source} WHERE prop >= 0.28e0 AND {when}"
        for kind, when, sure in rules)


_PAIRS = f"""{_BOUND},
sides AS (SELECT claim_id, ordinal, {{{', '.join(f"'{c}': {c}" for c in _SIDE)}}} AS v FROM bound),
paired AS MATERIALIZED (SELECT a.claim_id, a.v AS l, b.v AS r, a.v.source_id AS from_id, b.v.source_id AS to_id,
  {S.keyed_dice('a.v.pk', 'a.v.pt2', 'b.v.pk', 'b.v.pt2')} AS prop, {S.keyed_dice('a.v.ek', 'a.v.et', 'b.v.ek', 'b.v.et')} AS evt,
  coalesce(a.v.published_at <= b.v.published_at, true) AS in_order,
  coalesce(a.v.published_at <= b.v.published_at AND a.v.date_confidence >= 0.5e0 AND b.v.date_confidence >= 0.5e0, false) AS dated
  FROM sides a JOIN sides b ON a.claim_id = b.claim_id AND a.ordinal < b.ordinal),
said AS MATERIALIZED (SELECT *,
  {_stated('r.told')} AS t1, {_referred('r.told')} AS c1, {_stated('r.refers')} AS t2, {_referred('r.refers')} AS c2 FROM paired),
stated AS MATERIALIZED (SELECT *,
  CASE WHEN t1 IS NOT NULL AND c1 IS NOT NULL THEN t1 WHEN t2 IS NOT NULL AND c2 IS NOT NULL THEN t2 END AS stype,
  CASE WHEN t1 IS NOT NULL AND c1 IS NOT NULL THEN least(c1, greatest(0.45e0, r.told_relevance)) ELSE least(c2, greatest(0.45e0, r.refers_relevance)) END AS sref FROM said),
sure AS MATERIALIZED (SELECT *, {S.round3('least(sref, l.confidence, r.confidence) * CASE WHEN in_order THEN 1e0 ELSE 0.7e0 END')} AS sconf,
  least(l.confidence, r.confidence) AS lc FROM stated),
related AS MATERIALIZED (SELECT *,
  CASE WHEN stype IS NOT NULL THEN stype WHEN prop >= 0.86e0 THEN 'same_claim' WHEN evt >= 0.72e0 THEN 'same_event' WHEN prop >= 0.28e0 THEN 'related_claim' ELSE 'temporal_order' END AS rtype,
  CASE WHEN stype IS NOT NULL THEN CASE WHEN in_order AND sconf >= 0.75e0 THEN 'established' WHEN sconf >= 0.5e0 THEN 'candidate' ELSE 'insufficient_evidence' END
    WHEN prop >= 0.86e0 THEN 'established' WHEN evt >= 0.72e0 OR prop >= 0.28e0 THEN 'candidate'
    WHEN l.published_at <= r.published_at THEN 'established' ELSE 'insufficient_evidence' END AS rstatus,
  CASE WHEN stype IS NOT NULL THEN sconf WHEN prop >= 0.86e0 THEN {S.round3('lc')} WHEN evt >= 0.72e0 THEN {S.round3('least(lc, evt)')}
    WHEN prop >= 0.28e0 THEN {S.round3('least(lc, prop)')} WHEN l.published_at <= r.published_at THEN {S.round3('least(l.date_confidence, r.date_confidence)')} ELSE 0e0 END AS rconf,
  {S.round3('lc * CASE WHEN dated THEN 1e0 ELSE 0.78e0 END')} AS conf FROM sure),
live AS MATERIALIZED (SELECT *, CASE WHEN prop < 0.28e0 THEN 'insufficient_evidence' WHEN dated AND conf >= 0.65e0 THEN 'established' ELSE 'candidate' END AS status,
  CASE WHEN prop < 0.28e0 THEN {S.round3('conf * 0.5e0')} ELSE conf END AS confidence FROM related),
live_changes AS MATERIALIZED ({_changes('live', 'conf')})
"""
_OCCURRED = f"""{_PAIRS},
latest AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY published_at IS NOT NULL DESC, ordinal DESC) AS last FROM bound) WHERE last = 1),
seen AS MATERIALIZED (SELECT l.claim_id, 'o' || l.claim_id AS occurrence_id, c.claim, '' AS title, l.claim_id % 5 <> 0 AS valid, l.claim_id % 2 = 0 AS related
  FROM latest l JOIN claims c USING (claim_id)),
{S.fields('seen', 'seen_fields')},
seen_versions AS MATERIALIZED (SELECT *, {S.compare_key('normalized_proposition')} AS pk, {S.compare_terms('normalized_proposition')} AS pt2 FROM seen_fields),
met AS MATERIALIZED (SELECT sv.claim_id, s.v AS l, sv AS r, l2.source_id AS from_id, sv.occurrence_id AS to_id,
  {S.keyed_dice('l2.pk', 'l2.pt2', 'sv.pk', 'sv.pt2')} AS prop, sv.related AS linked, {S.round3('least(l2.confidence, 0.8e0)')} AS conf
  FROM seen_versions sv JOIN latest l2 USING (claim_id) JOIN sides s ON s.claim_id = sv.claim_id AND s.ordinal = l2.ordinal WHERE sv.valid),
met_related AS MATERIALIZED (SELECT *, CASE WHEN linked THEN 'reposted_from' ELSE 'related_claim' END AS rtype,
  CASE WHEN linked THEN 'established' ELSE 'insufficient_evidence' END AS rstatus, CASE WHEN linked THEN 0.8e0 ELSE 0e0 END AS rconf FROM met),
occurred AS MATERIALIZED (SELECT *, CASE WHEN prop < 0.28e0 OR NOT linked THEN 'insufficient_evidence' ELSE rstatus END AS status,
  CASE WHEN prop < 0.28e0 OR NOT linked THEN {S.round3('conf * 0.5e0')} ELSE {S.round3('least(conf, rconf)')} END AS confidence FROM met_related),
occurred_changes AS MATERIALIZED ({_changes('occurred', 'conf')}),
cmp AS MATERIALIZED (SELECT claim_id, from_id, to_id, prop, rtype, rstatus, rconf, status, confidence FROM live
  UNION ALL SELECT claim_id, from_id, to_id, prop, rtype, rstatus, rconf, status, confidence FROM occurred),
changes AS MATERIALIZED (SELECT * FROM live_changes UNION ALL SELECT * FROM occurred_changes)
"""
_MUTATED = f"""{_OCCURRED},
mapping(type, mutation_type, forced) AS (VALUES {', '.join(f"({S.text(a)}, {S.text(b)}, {str(c).lower()})" for a, b, c in K.CHANGE_TO_MUTATION)}),
mutated AS MATERIALIZED (SELECT claim_id, from_id, to_id, mutation_type, bool_or(forced) AS forced, min(cconf) AS least_conf, count(*) AS n
  FROM changes JOIN mapping USING (type) WHERE cconf >= 0.45e0 GROUP BY ALL),
mut AS MATERIALIZED (SELECT m.*, {S.round3('least(c.confidence, c.rconf, m.least_conf)')} AS confidence, c.status AS cstatus, c.rstatus FROM mutated m JOIN cmp c USING (claim_id, from_id, to_id)
  WHERE c.status <> 'insufficient_evidence' AND c.rstatus <> 'insufficient_evidence' AND c.rtype IN {S.members(K.TRANSMISSION_TYPES)}),
mutations AS MATERIALIZED (SELECT *, CASE WHEN NOT forced AND cstatus = 'established' AND rstatus = 'established' AND confidence >= 0.8e0 THEN 'established' ELSE 'candidate' END AS status FROM mut)
"""
_GRAPH = f"""{_MUTATED},
nodes AS MATERIALIZED (SELECT claim_id, source_id, 'source' AS kind FROM versions
  UNION ALL SELECT claim_id, coalesce(occurrence_id, 'submitted-claim'), CASE WHEN occurrence_id IS NULL THEN 'submitted_claim' ELSE 'submitted_occurrence' END
  FROM claims LEFT JOIN (SELECT claim_id, occurrence_id FROM seen WHERE valid) USING (claim_id)),
edges AS MATERIALIZED (SELECT c.claim_id, c.from_id, c.to_id, c.rtype AS relationship, m.mutation_type,
  {S.round3('least(c.rconf, c.confidence, coalesce(m.confidence, 1e0))')} AS confidence,
  CASE WHEN c.rstatus = 'established' AND c.status = 'established' AND coalesce(m.status = 'established', true) THEN 'established' ELSE 'candidate' END AS status
  FROM cmp c LEFT JOIN mutations m USING (claim_id, from_id, to_id)
  WHERE c.rtype IN {S.members(K.TRANSMISSION_TYPES)} AND c.rstatus <> 'insufficient_evidence'),
reach AS MATERIALIZED (WITH RECURSIVE walk AS (
    SELECT claim_id, source_id FROM nodes WHERE kind = 'submitted_occurrence'
    UNION SELECT e.claim_id, e.from_id FROM walk w JOIN edges e ON e.claim_id = w.claim_id AND e.to_id = w.source_id WHERE e.status = 'established')
  SELECT * FROM walk),
per_node AS (SELECT claim_id, count(*) AS nodes, bool_or(kind = 'submitted_occurrence') AS has_occurrence, count(r.source_id) AS reached
  FROM nodes n LEFT JOIN reach r USING (claim_id, source_id) GROUP BY claim_id),
marked AS (SELECT e.*, f.source_id IS NOT NULL AS from_in, t.source_id IS NOT NULL AS to_in FROM edges e
  LEFT JOIN reach f ON f.claim_id = e.claim_id AND f.source_id = e.from_id LEFT JOIN reach t ON t.claim_id = e.claim_id AND t.source_id = e.to_id),
per_edge AS (SELECT claim_id, count(*) AS edges, {S.mean3('confidence')} AS avg_all, {S.mean3('confidence', 'from_in AND to_in')} AS avg_in,
  count(DISTINCT from_id || ' ' || to_id) FILTER (status = 'established' AND to_in) AS transitions, bool_or(from_in AND status <> 'established') AS provisional FROM marked GROUP BY claim_id),
summed AS (SELECT *, has_occurrence AND reached > 1 AS connected, greatest(1, nodes - 1) AS required, coalesce(edges, 0) AS n_edges FROM per_node LEFT JOIN per_edge USING (claim_id)),
summary AS MATERIALIZED (SELECT claim_id, nodes, n_edges AS edges,
  CASE WHEN connected AND reached = nodes AND coalesce(transitions, 0) >= required AND NOT coalesce(provisional, false) THEN 'established' WHEN n_edges > 0 THEN 'candidate' ELSE 'insufficient_evidence' END AS status,
  CASE WHEN has_occurrence THEN avg_in ELSE avg_all END AS mean_conf, connected,
  CASE WHEN connected THEN coalesce(transitions, 0) ELSE 0 END AS established_transitions, required AS required_transitions FROM summed)
"""

# ---------------------------------------------------------------- fields and versions

_COLUMNS = ", ".join(S.FIELD_NAMES)


def _field_query(names: tuple[str, ...]):
    """Fields of every told text (whether or not it becomes a version)."""
    def build(t):
        rows = snapshots(t).select("source_id", "title", F.get("passages", F.lit(0))["text"].alias("claim"))
        return with_fields(rows).select("source_id", *[F.col(n) for n in names])

    return build


_TOLD = f"WITH {_BASE}, told AS (SELECT source_id, title, told AS claim FROM snaps), {S.fields('told', 'told_fields')}"
for _key, _names in {
    "b22_certainty": ("certainty",), "b23_quoted_speaker": ("quoted_speaker",), "b24_correction_verdict": ("correction_verdict",),
    "b25_source_stance": ("source_stance",), "b26_claim_type": ("claim_type",), "b27_proposition": ("normalized_proposition",),
    "b28_subject_event": ("subject", "event"), "b29_attribution_actor_location_cause": ("attribution", "actor", "location", "causal_language"),
    "b30_event_date": ("event_date",), "b31_caption_context": ("caption_context",),
}.items():
    query(_key, f"{_TOLD} SELECT source_id, {', '.join(_names)} FROM told_fields")(_field_query(_names))


@query("b32_qualifiers", f"{_TOLD} SELECT source_id, array_to_string(qualifiers, '|') AS qualifiers FROM told_fields")
def b32(t):
    return _field_query(("qualifiers",))(t).select("source_id", F.array_join("qualifiers", "|").alias("qualifiers"))


_DOC_FIELDS = ("certainty", "correction_verdict", "source_stance", "claim_type", "subject", "causal_language", "attribution", "location")


@query("b22_document_fields", f"""WITH docs AS (SELECT doc_id, '' AS title, {S.extract_claim('text')} AS claim FROM documents), {S.fields('docs', 'doc_fields')}
SELECT doc_id, {', '.join(_DOC_FIELDS)} FROM doc_fields""")
def b22_documents(t):
    """The same fields on the claim of every document."""
    rows = t.documents.select("doc_id", F.lit("").alias("title"), T.extract_claim(F.col("text")).alias("claim"))
    return with_fields(rows).select("doc_id", *_DOC_FIELDS)


@query("e09_select_passage", f"WITH {_VERSIONS} SELECT claim_id, source_id, passage_id, pkind AS kind, round(overlap, 6) AS overlap FROM chosen")
def e09(t):
    return versions.select_passages(snapshots(t), claims(t)).select(
        "claim_id", "source_id", F.col("_passage.passage_id").alias("passage_id"), F.col("_passage.kind").alias("kind"),
        F.round("_passage.overlap", 6).alias("overlap"))


@query("b33_versions", f"""WITH {_VERSIONS}
SELECT claim_id, 'version:' || source_id || ':' || passage_id AS version_id, source_id, claim, publisher AS narrator, confidence, {_COLUMNS} FROM versions""")
def b33(t):
    return made_versions(t).select(
        "claim_id", "version_id", "source_id", "claim", "narrator", "confidence", *S.FIELD_NAMES)


@query("b34_occurrence_versions", f"""WITH {_OCCURRED}
SELECT claim_id, 'version:' || occurrence_id || ':' || occurrence_id || ':occurrence' AS version_id, claim, 'claim' AS kind, normalized_proposition, subject, location, causal_language
FROM seen_fields WHERE claim LIKE '%caused%'
UNION ALL SELECT claim_id, 'version:' || occurrence_id || ':' || occurrence_id || ':occurrence', claim, 'unknown', normalized_proposition, subject, location, causal_language
FROM seen_fields WHERE claim NOT LIKE '%caused%'""")
def b34(t):
    return versions.occurrence_versions(occurrences(t)).select(
        "claim_id", "version_id", "claim", F.col("claim_type").alias("kind"), "normalized_proposition", "subject", "location",
        "causal_language")


@query("b35_relationship_type", f"WITH {_BASE} SELECT source_id, {_stated('refers')} AS stated, {_stated('told')} AS told FROM snaps")
def b35(t):
    text = lambda i: F.get("passages", F.lit(i))["text"]
    return snapshots(t).select("source_id", relationship_type(text(1)).alias("stated"), relationship_type(text(0)).alias("told"))


@query("b38_valid_occurrence", f"WITH {_OCCURRED} SELECT claim_id, occurrence_id, valid FROM seen")
def b38(t):
    return occurrences(t).select("claim_id", "occurrence_id", compare.valid_occurrence().alias("valid"))


@query("d06_best_version", """
WITH v AS (SELECT doc_id, quality, length(text) % 50 / 50e0 AS confidence, source FROM documents JOIN labels USING (doc_id))
SELECT source AS claim_id, quality AS source_id, arg_max(doc_id, confidence * 1e12 - doc_id) AS best, max(confidence) AS confidence FROM v GROUP BY ALL""")
def d06(t):
    rows = t.documents.join(t.labels, "doc_id").select(
        F.col("source").alias("claim_id"), F.col("quality").alias("source_id"), F.col("doc_id").alias("best"),
        ((F.length("text") % 50) / F.lit(50.0)).alias("confidence"), F.col("doc_id").alias("version_ord"))
    return versions.best_versions(rows, grounded=False).select("claim_id", "source_id", "best", "confidence")


_AID = f"""{_VERSIONS},
open AS (SELECT o.*, dense_rank() OVER (PARTITION BY o.claim_id ORDER BY o.idx) AS turn FROM overlapped o ANTI JOIN versions v USING (claim_id, source_id)),
near AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY claim_id, source_id
    ORDER BY (CASE WHEN pkind = 'claim' THEN 1e0 ELSE 0.72e0 END) * (0.65e0 * prel + 0.35e0 * overlap) DESC, passage_id) AS place
  FROM open WHERE turn <= 6 AND overlap >= 0.16e0 AND (prel >= 0.32e0 OR overlap >= 0.22e0))
"""


@query("e10_aid_candidates", f"WITH {_AID} SELECT claim_id, source_id, passage_id, round(overlap, 6) AS overlap FROM near WHERE place <= 3")
def e10(t):
    return versions.aid_candidates(snapshots(t), claims(t), made_versions(t)).select(
        "claim_id", "source_id", F.col("_passage.passage_id").alias("passage_id"), F.round("_passage.overlap", 6).alias("overlap"))


@query("c17_selection_merge", f"""WITH {_AID},
picked AS (SELECT *, 0.6e0 + (n % 5) / 10e0 AS sure FROM near WHERE place <= 3),
judged AS (SELECT *, {S.round3("least(0.85e0, 0.5e0 * extraction_confidence + 0.2e0 * greatest(0.35e0, prel) + 0.15e0 * overlap + 0.15e0 * sure)")} AS confidence FROM picked WHERE sure >= 0.65e0),
firsts AS (SELECT *, row_number() OVER (PARTITION BY claim_id, source_id ORDER BY passage_id) AS k FROM judged WHERE confidence >= 0.6e0)
SELECT claim_id, source_id, passage_id, confidence FROM firsts WHERE k = 1""")
def c17(t):
    """Every candidate is selected by name; sureness comes from the source's number."""
    offered = versions.aid_candidates(snapshots(t), claims(t), made_versions(t))
    number = F.substring("source_id", 2, 12).cast("bigint")
    chosen = offered.select(
        "claim_id", "source_id", F.col("_passage.passage_id").alias("passage_id"), F.ascii(F.substring(F.col("_passage.passage_id"), -1, 1)).alias("ord"),
        (F.lit(0.6) + (number % 5) / F.lit(10.0)).alias("confidence"))
    merged = versions.merge_selections(offered, chosen)
    return merged.select("claim_id", "source_id", F.col("evidence_passage_id").alias("passage_id"), "confidence")


@query("g05_union_versions", f"""WITH {_VERSIONS} SELECT claim_id, source_id, 'deterministic' AS extraction_method FROM versions
UNION ALL SELECT claim_id, occurrence_id, 'deterministic' FROM (SELECT DISTINCT claim_id, 'o' || claim_id AS occurrence_id FROM versions)""")
def g05(t):
    both = made_versions(t).unionByName(versions.occurrence_versions(occurrences(t)))
    return both.select("claim_id", "source_id", "extraction_method")


# ---------------------------------------------------------------- ordering and pairs

@query("e07_chronological_ordinal", """
WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 9 <> 0 THEN ts END AS ts FROM events)
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id) AS ordinal FROM e""")
def e07(t):
    """Undated events last; a user with very many events, on one day or undated, is numbered range by range."""
    rows = t.events.select("event_id", "user_id", F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("ts"))
    numbered = ranking.range_ordinals(rows, ["user_id"], [F.asc_nulls_last("ts"), F.asc("event_id")])
    return numbered.select("event_id", "ordinal")


@query("e08_latest_version", f"WITH {_OCCURRED} SELECT claim_id, source_id, ordinal FROM latest")
def e08(t):
    return compare.latest_versions(bound(t)).select("claim_id", "source_id", F.col("ordinal").cast("bigint"))


@query("c05_bound_versions", f"WITH {_BOUND} SELECT claim_id, source_id, passage_id, ordinal FROM bound")
def c05(t):
    return bound(t).select(
        "claim_id", "source_id", F.col("passage.passage_id").alias("passage_id"), F.col("ordinal").cast("bigint"))


@query("c06_version_pairs", f"WITH {_PAIRS} SELECT claim_id, from_id, to_id FROM paired")
def c06(t):
    return compare.pairs(bound(t)).select(
        "claim_id", F.col("l.source_id").alias("from_id"), F.col("r.source_id").alias("to_id"))


@query("c07_explicit_reference", f"WITH {_PAIRS} SELECT claim_id, from_id, to_id, stype AS type, sconf AS confidence FROM sure WHERE stype IS NOT NULL")
def c07(t):
    rows = compare.pairs(bound(t)).withColumn("_e", compare.explicit_relationship())
    return rows.select(
        "claim_id", F.col("l.source_id").alias("from_id"), F.col("r.source_id").alias("to_id"), F.col("_e.type").alias("type"),
        F.col("_e.confidence").alias("confidence")).filter(F.col("type").isNotNull())


@query("f10_similarity", f"WITH {_PAIRS} SELECT claim_id, from_id, to_id, round(prop, 6) AS prop, round(evt, 6) AS evt FROM paired")
def f10(t):
    return compare.pairs(bound(t)).select(
        "claim_id", F.col("l.source_id").alias("from_id"), F.col("r.source_id").alias("to_id"),
        F.round(compare.proposition_dice(), 6).alias("prop"), F.round(compare.event_dice(), 6).alias("evt"))


@query("f12_descriptive_relationship", f"WITH {_PAIRS} SELECT claim_id, from_id, to_id, rtype AS type, rstatus AS status, rconf AS confidence FROM related")
def f12(t):
    rows = compare.compare_pairs(compare.pairs(bound(t)))
    return rows.select(
        "claim_id", F.col("from_source_id").alias("from_id"), F.col("to_source_id").alias("to_id"), "relationship.type",
        "relationship.status", "relationship.confidence")


@query("f11_compare_pair", f"WITH {_PAIRS} SELECT claim_id, from_id, to_id, status, confidence FROM live")
def f11(t):
    rows = compare.compare_pairs(compare.pairs(bound(t)))
    return rows.select(
        "claim_id", F.col("from_source_id").alias("from_id"), F.col("to_source_id").alias("to_id"), "status", "confidence")


def _change_rows(t) -> DataFrame:
    return compare.changes_of(compare.compare_pairs(compare.pairs(bound(t)))).select(
        "claim_id", F.col("from_source_id").alias("from_id"), F.col("to_source_id").alias("to_id"), "type",
        F.col("confidence").alias("cconf"))


for _key, _kinds in {
    "f01_context_changes": ("context_removed", "context_added"), "f02_cause_changes": ("cause_introduced", "cause_removed"),
    "f03_attribution_changed": ("attribution_changed",), "f04_date_changed": ("date_changed",), "f05_location_changed": ("location_changed",),
    "f06_certainty_changes": ("certainty_strengthened", "certainty_weakened"), "f07_quotation_changed": ("quotation_changed",),
    "f08_caption_changed": ("caption_changed",), "f09_old_media_reused": ("old_media_reused",),
}.items():
    query(_key, f"WITH {_PAIRS} SELECT claim_id, from_id, to_id, type, cconf FROM live_changes WHERE type IN {S.members(_kinds)}")(
        lambda t, kinds=_kinds: _change_rows(t).filter(F.col("type").isin(*kinds)))


@query("c08_occurrence_comparison", f"WITH {_OCCURRED} SELECT claim_id, from_id, to_id, rtype AS type, status, confidence FROM occurred")
def c08(t):
    tied = kept(compare.numbered_versions(made_versions(t), snapshots(t)), "claim_id")
    rows = compare.compare_occurrences(tied, occurrences(t, tied).filter(compare.valid_occurrence()))
    return rows.select(
        "claim_id", F.col("from_source_id").alias("from_id"), F.col("to_source_id").alias("to_id"), "relationship.type", "status",
        "confidence")


@query("g04_union_comparisons", f"WITH {_OCCURRED} SELECT status, rtype AS type, count(*) AS n, sum(prop >= 0.28e0) AS comparable FROM cmp GROUP BY ALL")
def g04(t):
    return Trail(t).comparisons.groupBy("status", F.col("relationship.type").alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("similarity") >= 0.28).alias("comparable"))


@query("d11_mutations", f"WITH {_MUTATED} SELECT claim_id, from_id, to_id, mutation_type, n AS changes, confidence, status FROM mutations")
def d11(t):
    return Trail(t).mutations().select(
        "claim_id", F.col("from_source_id").alias("from_id"), F.col("to_source_id").alias("to_id"), "mutation_type",
        F.size("change_types").cast("bigint").alias("changes"), "confidence", "status")


# ---------------------------------------------------------------- graph

@query("h01_nodes", f"WITH {_GRAPH} SELECT claim_id, source_id, kind FROM nodes")
def h01(t):
    return Trail(t).nodes().select("claim_id", "source_id", "kind")


@query("h02_edges", f"WITH {_GRAPH} SELECT claim_id, from_id, to_id, relationship, mutation_type, confidence, status FROM edges")
def h02(t):
    """Comparisons fan out to mutations, and only edges between known nodes stay."""
    return Trail(t).compared().edges().select(
        "claim_id", F.col("from_source_id").alias("from_id"), F.col("to_source_id").alias("to_id"), "relationship", "mutation_type",
        "confidence", "status")


@query("b39_edge_evidence", f"WITH {_GRAPH} SELECT claim_id, from_id, to_id, rtype IN {S.members(K.TRANSMISSION_TYPES)} AS valid FROM cmp")
def b39(t):
    """Only stated transmissions carry relationship evidence."""
    rows = Trail(t).comparisons
    return rows.select(
        "claim_id", F.col("from_source_id").alias("from_id"), F.col("to_source_id").alias("to_id"),
        graph.evidence_valid(F.col("relationship.evidence"), F.col("from_source_id"), F.col("to_source_id")).alias("valid"))


@query("c09_mutation_fanout", f"WITH {_GRAPH} SELECT claim_id, count(*) AS edges, count(mutation_type) AS with_mutation FROM edges GROUP BY claim_id")
def c09(t):
    trail = Trail(t).compared()
    return graph.derive_edges(trail.comparisons, trail.mutations()).groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("edges"), F.count("mutation_type").alias("with_mutation"))


@query("c10_edges_to_known_nodes", f"WITH {_GRAPH} SELECT claim_id, from_id, to_id, relationship FROM edges e SEMI JOIN nodes a ON a.claim_id = e.claim_id AND a.source_id = e.from_id SEMI JOIN (SELECT * FROM nodes WHERE kind <> 'submitted_claim') b ON b.claim_id = e.claim_id AND b.source_id = e.to_id")
def c10(t):
    return Trail(t).compared().edges().select(
        "claim_id", F.col("from_source_id").alias("from_id"), F.col("to_source_id").alias("to_id"), "relationship")


@query("h03_backward_reachability", f"WITH {_GRAPH} SELECT claim_id, source_id FROM reach")
def h03(t):
    trail = Trail(t).compared()
    return graph.ancestors(trail.edges(), trail.nodes()).select("claim_id", "source_id")


@query("h04_graph_summary", f"""WITH {_GRAPH} SELECT claim_id, nodes, edges, status, mean_conf AS confidence, connected, established_transitions, required_transitions FROM summary""")
def h04(t):
    trail = Trail(t).compared()
    node_table, edge_table = trail.nodes(), kept(trail.edges(), "claim_id")
    return graph.summarize(node_table, edge_table, graph.ancestors(edge_table, node_table))


@query("h07_degrees", f"""WITH {_GRAPH}
SELECT n.claim_id, n.source_id, count(DISTINCT i) AS in_degree, count(DISTINCT o) AS out_degree, count(DISTINCT i) + count(DISTINCT o) = 0 AS isolated
FROM nodes n LEFT JOIN (SELECT *, row_number() OVER () AS i FROM edges) a ON a.claim_id = n.claim_id AND a.to_id = n.source_id
LEFT JOIN (SELECT *, row_number() OVER () AS o FROM edges) b ON b.claim_id = n.claim_id AND b.from_id = n.source_id GROUP BY ALL""")
def h07(t):
    trail = Trail(t).compared()
    return graph.degrees(trail.nodes(), kept(trail.edges(), "claim_id"))


# ---------------------------------------------------------------- chronology and origin

def _sourced(t) -> DataFrame:
    return origin.sourced_versions(made_versions(t), snapshots(t))


_FACTOR = "CASE source_type " + " ".join(f"WHEN {S.text(k)} THEN {v}e0" for k, v in K.SOURCE_TYPE_FACTOR.items()) + " ELSE 0.8e0 END"
_EARLIEST = f"""
dated AS (SELECT *, {S.round3(f'least(date_confidence, confidence) * {_FACTOR}')} AS dconf FROM versions
  WHERE confidence >= 0.35e0 AND date_type = 'publication' AND published_at IS NOT NULL AND date_confidence >= 0.3e0),
first_dated AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY published_at, dconf DESC, source_id) AS k, count(*) OVER (PARTITION BY claim_id) AS dated_sources FROM dated),
earliest AS MATERIALIZED (SELECT c.claim_id, CASE WHEN f.source_id IS NULL THEN 'insufficient_evidence' WHEN dconf >= 0.7e0 THEN 'established' ELSE 'candidate' END AS status,
  f.source_id, f.published_at AS date, dconf AS confidence, coalesce(dated_sources, 0) AS dated_sources FROM claims c LEFT JOIN (SELECT * FROM first_dated WHERE k = 1) f USING (claim_id))
"""
_ORIGIN = f"""{_EARLIEST},
told_origin AS (SELECT *, {S.found('refers', K.EXPLICIT_ORIGIN)} AND {S.found('refers', K.MISINFORMATION_CONTEXT)} AS says FROM versions),
orig AS (SELECT *, {S.round3('least(confidence, extraction_confidence, refers_relevance)')} AS oconf FROM told_origin),
official AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY oconf DESC, source_id) AS k FROM orig WHERE source_type IN ('primary', 'official')),
mis AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY oconf DESC, source_id) AS k FROM orig WHERE says),
original_event AS MATERIALIZED (SELECT claim_id, source_id, oconf AS confidence, CASE WHEN oconf >= 0.75e0 THEN 'established' ELSE 'candidate' END AS status FROM official WHERE k = 1),
misinformation AS MATERIALIZED (SELECT claim_id, source_id, oconf AS confidence, CASE WHEN source_type IN ('social', 'primary') AND oconf >= 0.8e0 THEN 'established' ELSE 'candidate' END AS status FROM mis WHERE k = 1),
likely AS MATERIALIZED (SELECT e.claim_id, coalesce(m.source_id, e.source_id) AS source_id,
  CASE WHEN m.source_id IS NOT NULL THEN m.confidence ELSE e.confidence END AS confidence,
  CASE WHEN m.source_id IS NOT NULL THEN m.status WHEN e.source_id IS NOT NULL THEN 'candidate' ELSE 'insufficient_evidence' END AS status
  FROM earliest e LEFT JOIN misinformation m USING (claim_id))
"""


@query("d07_earliest_source", f"WITH {_VERSIONS}, {_EARLIEST} SELECT claim_id, status, source_id, date, confidence, dated_sources FROM earliest")
def d07(t):
    return origin.earliest_sources(_sourced(t), claims(t)).select(
        "claim_id", "status", "source_id", "date", "confidence", "dated_sources")


@query("d08_original_event", f"WITH {_VERSIONS}, {_ORIGIN} SELECT claim_id, status, source_id, confidence FROM original_event")
def d08(t):
    return origin.original_events(_sourced(t)).drop("evidence_ids")


@query("d09_misinformation_origin", f"WITH {_VERSIONS}, {_ORIGIN} SELECT claim_id, status, source_id, confidence FROM misinformation")
def d09(t):
    return origin.misinformation_origins(_sourced(t)).drop("evidence_ids")


@query("d10_likely_origin", f"WITH {_VERSIONS}, {_ORIGIN} SELECT claim_id, status, source_id, confidence FROM likely")
def d10(t):
    return origin.assess_origin(_sourced(t), claims(t)).select(
        "claim_id", "likely_origin.status", "likely_origin.source_id", "likely_origin.confidence")


# ---------------------------------------------------------------- roll-ups

def _everything(t) -> dict[str, DataFrame]:
    """All tables of the investigation."""
    trail = Trail(t).compared()
    node_table, edge_table = kept(trail.nodes(), "claim_id"), kept(trail.edges(), "claim_id")
    summary = kept(graph.summarize(node_table, edge_table, graph.ancestors(edge_table, node_table)), "claim_id")
    sourced = origin.sourced_versions(trail.versions, trail.snaps)
    return dict(snaps=trail.snaps, claims=trail.claims, versions=trail.versions, comparisons=trail.comparisons,
                mutations=kept(trail.mutations(), "claim_id"), graph=summary,
                origins=kept(origin.assess_origin(sourced, trail.claims), "claim_id"))


def _tier(source: str, name: str) -> str:
    return f"""{name} AS (SELECT claim_id, CASE WHEN bool_or(status = 'established') THEN 'established' WHEN bool_or(status = 'candidate') THEN 'candidate' ELSE 'insufficient_evidence' END AS status,
  CASE WHEN bool_or(status = 'established') THEN {S.mean3('confidence', 'status = ' + S.text('established'))} WHEN bool_or(status = 'candidate') THEN {S.mean3('confidence', 'status = ' + S.text('candidate'))} END AS confidence,
  {S.mean3('confidence')} AS mean_conf FROM {source} GROUP BY claim_id)"""


_STAGES = f"""{_GRAPH}, {_ORIGIN}, {_tier('cmp', 'tier_cmp')}, {_tier('mutations', 'tier_mut')},
gate AS (SELECT claim_id, bool_and(status = 'blocked') AS blocked, {S.mean3('retrieval_relevance')} AS retrieval FROM snaps GROUP BY claim_id),
wide AS MATERIALIZED (SELECT c.claim_id, CASE c.claim_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'not_configured' ELSE 'searched' END AS search, c.claim_id % 23 = 5 AS failed,
  g.blocked, g.retrieval, tc.status AS cs, tc.confidence AS cc, tm.status AS ms, tm.confidence AS mc, e.status AS es, e.confidence AS ec, o.source_id AS osrc, o.status AS os, o.confidence AS oc,
  m.status AS mis, s.status AS gs, s.mean_conf AS gc
  FROM claims c JOIN gate g USING (claim_id) LEFT JOIN tier_cmp tc USING (claim_id) LEFT JOIN tier_mut tm USING (claim_id) LEFT JOIN earliest e USING (claim_id)
  LEFT JOIN likely o USING (claim_id) LEFT JOIN misinformation m USING (claim_id) LEFT JOIN summary s USING (claim_id)),
stages AS MATERIALIZED (
  SELECT claim_id, 'claim_extracted' AS stage_id, 'established' AS status, 1e0 AS confidence FROM wide
  UNION ALL SELECT claim_id, 'live_search', CASE search WHEN 'searched' THEN 'established' WHEN 'failed' THEN 'error' ELSE 'not_attempted' END, CASE WHEN search = 'searched' THEN 1e0 END FROM wide
  UNION ALL SELECT claim_id, 'source_discovery', CASE WHEN failed THEN 'error' WHEN blocked THEN 'blocked' ELSE 'established' END, CASE WHEN NOT failed AND NOT blocked THEN retrieval END FROM wide
  UNION ALL SELECT claim_id, 'earliest_source', CASE WHEN blocked THEN 'blocked' ELSE es END, CASE WHEN NOT blocked THEN ec END FROM wide
  UNION ALL SELECT claim_id, 'context_comparison', CASE WHEN blocked THEN 'blocked' ELSE coalesce(cs, 'insufficient_evidence') END, CASE WHEN NOT blocked THEN cc END FROM wide
  UNION ALL SELECT claim_id, 'mutation_detection', CASE WHEN blocked THEN 'blocked' ELSE coalesce(ms, 'insufficient_evidence') END, CASE WHEN NOT blocked THEN mc END FROM wide
  UNION ALL SELECT claim_id, 'origin_assessment', CASE WHEN blocked THEN 'blocked' WHEN mis = 'established' THEN 'established' WHEN osrc IS NOT NULL THEN 'candidate' ELSE 'insufficient_evidence' END, CASE WHEN NOT blocked THEN oc END FROM wide
  UNION ALL SELECT claim_id, 'lineage', CASE WHEN blocked THEN 'blocked' ELSE gs END, CASE WHEN NOT blocked THEN gc END FROM wide)
"""


def _stages(d: dict) -> DataFrame:
    return rollup.stage_table(d["claims"], d["snaps"], d["comparisons"], d["mutations"], d["origins"], d["graph"])


@query("d12_stages", f"WITH {_STAGES} SELECT claim_id, stage_id, status, confidence FROM stages")
def d12(t):
    return _stages(_everything(t)).select("claim_id", "stage_id", "status", "confidence")


@query("d14_scores", f"""WITH {_STAGES},
rel AS (SELECT claim_id, {S.mean3('coalesce(evidence_relevance, 0.9e0)')} AS r FROM snaps WHERE status IN ('acquired', 'partial') GROUP BY claim_id)
SELECT s.claim_id, r AS source_relevance, CASE WHEN s.connected THEN s.mean_conf END AS provenance_confidence,
  tm.mean_conf AS mutation_confidence, o.confidence AS origin_confidence,
  CASE WHEN s.status = 'established' AND s.connected THEN {S.round3('s.established_transitions / s.required_transitions')} ELSE 0e0 END AS completeness
FROM summary s LEFT JOIN rel USING (claim_id) LEFT JOIN tier_mut tm USING (claim_id) LEFT JOIN likely o USING (claim_id)""")
def d14(t):
    d = _everything(t)
    return rollup.score_table(d["snaps"], d["mutations"], d["origins"], d["graph"])


def _known(d: dict) -> tuple[DataFrame, DataFrame]:
    """Known-record matches by claim number: every fourth matched, half of those verified."""
    n = F.col("claim_id")
    known = d["claims"].select(
        "claim_id", F.when(n % 4 == 0, n % 16).alias("record_id"), (n % 4 == 0).alias("matched"),
        (n % 8 == 0).alias("verified"),
        F.when(n % 8 == 0, "externally_verified").when(n % 4 == 0, "illustrative").alias("dataset_provenance"))
    curated = d["claims"].select((n % 16).alias("record_id")).distinct().withColumn("complete", F.col("record_id") == 0)
    return known, curated


@query("d19_trace_status", f"""WITH {_GRAPH},
r AS (SELECT s.claim_id, CASE WHEN s.status = 'established' THEN 2 WHEN s.established_transitions > 0 THEN 1 ELSE 0 END AS live,
  CASE WHEN s.claim_id % 8 <> 0 THEN 0 WHEN s.claim_id % 16 = 0 THEN 2 ELSE 1 END AS known FROM summary s)
SELECT claim_id, ['UNTRACED', 'PARTIALLY_TRACED', 'TRACED'][live + 1] AS live_status, ['UNTRACED', 'PARTIALLY_TRACED', 'TRACED'][known + 1] AS known_status,
  ['UNTRACED', 'PARTIALLY_TRACED', 'TRACED'][greatest(live, known) + 1] AS trace_status FROM r""")
def d19(t):
    d = _everything(t)
    return rollup.trace_status(d["claims"], d["graph"], *_known(d)).select("claim_id", "live_status", "known_status", "trace_status")


_FINDINGS = f"""{_STAGES},
r AS (SELECT s.claim_id, s.status AS graph, CASE WHEN s.status = 'established' THEN 2 WHEN s.established_transitions > 0 THEN 1 ELSE 0 END AS live,
  CASE WHEN s.claim_id % 8 <> 0 THEN 0 WHEN s.claim_id % 16 = 0 THEN 2 ELSE 1 END AS known, s.claim_id % 4 = 0 AND s.claim_id % 8 <> 0 AS illustrative FROM summary s),
acq AS (SELECT claim_id, count(*) AS sources, count(*) FILTER (status = 'acquired') AS acquired, count(*) FILTER (status = 'partial') AS partial_ FROM snaps GROUP BY claim_id),
nv AS (SELECT claim_id, count(*) AS n FROM versions GROUP BY claim_id),
nc AS (SELECT claim_id, count(*) AS n FROM cmp GROUP BY claim_id),
nm AS (SELECT claim_id, count(*) AS n, count(*) FILTER (status = 'established') AS firm FROM mutations GROUP BY claim_id),
gaps AS (SELECT claim_id, list(stage_id || ':' || status ORDER BY list_position({S.strings(K.KNOWN_STAGE_IDS)}, stage_id)) AS g FROM stages
  WHERE stage_id IN {S.members(K.KNOWN_STAGE_IDS)} AND status <> 'established' GROUP BY claim_id),
f AS (SELECT r.*, NOT illustrative AND known = 0 AS neither, w.search, acq.sources, acq.acquired, acq.partial_, coalesce(nv.n, 0) AS nv, coalesce(nc.n, 0) AS nc,
  coalesce(nm.n, 0) AS nm, coalesce(nm.firm, 0) AS firm, coalesce(gaps.g, []) AS g
  FROM r JOIN wide w USING (claim_id) LEFT JOIN acq USING (claim_id) LEFT JOIN nv USING (claim_id) LEFT JOIN nc USING (claim_id) LEFT JOIN nm USING (claim_id) LEFT JOIN gaps USING (claim_id))
SELECT claim_id, ['UNTRACED', 'PARTIALLY_TRACED', 'TRACED'][greatest(live, known) + 1] AS trace_status,
  coalesce(array_to_string([CASE WHEN known = 2 THEN 'known_record:traced' WHEN known = 1 THEN 'known_record:partial' WHEN illustrative THEN 'known_record:illustrative' END,
    CASE WHEN search = 'searched' THEN 'search:' || coalesce(sources, 0) || ':' || coalesce(acquired, 0) || ':' || coalesce(partial_, 0) END,
    CASE WHEN nv > 0 THEN 'versions:' || nv END, CASE WHEN nc > 0 THEN 'comparisons:' || nc END,
    CASE WHEN nm > 0 THEN 'mutations:' || nm || ':' || firm END, CASE WHEN graph = 'established' THEN 'graph:established' END], '|'), '') AS found,
  coalesce(array_to_string(list_concat([CASE WHEN illustrative THEN 'known_record:verified' WHEN neither THEN 'known_record:none' END,
    CASE search WHEN 'failed' THEN 'search:failed' WHEN 'not_configured' THEN 'search:not_configured' END], g), '|'), '') AS not_found,
  coalesce(array_to_string([CASE WHEN known = 1 THEN 'known_record:incomplete_path' WHEN illustrative THEN 'known_record:illustrative' WHEN neither THEN 'absence_is_not_falsity' END,
    CASE WHEN graph = 'candidate' THEN 'graph:candidate' END, CASE WHEN search = 'failed' THEN 'search:failed' END], '|'), '') AS uncertain
FROM f"""


@query("d21_findings", f"WITH {_FINDINGS}")
def d21(t):
    d = _everything(t)
    status = rollup.trace_status(d["claims"], d["graph"], *_known(d))
    found = rollup.findings(
        status, d["claims"], d["snaps"], d["versions"], d["comparisons"], d["mutations"], _stages(d), d["graph"])
    joined = lambda c: F.array_join(c, "|").alias(c)
    return found.select("claim_id", "trace_status", joined("found"), joined("not_found"), joined("uncertain"))


# ---------------------------------------------------------------- occurrences and sets

_SUBMITTED = """
said AS (SELECT conv_id || '-' || turn AS claim_id, text,
  CASE WHEN turn % 5 = 0 THEN 'https://posts.example.org/c/' || conv_id || '/' || turn END AS url, CASE WHEN turn % 3 = 1 THEN 'User ' || role END AS name,
  CASE WHEN turn % 2 = 1 THEN 'post-' || conv_id || '-' || turn END AS post, CASE WHEN turn % 4 = 2 THEN '2024-03-0' || (turn % 9 + 1) || 'T10:00:00.000Z' END AS seen FROM conversations)
"""


@query("a06_build_occurrences", f"""WITH {_SUBMITTED},
k AS (SELECT *, {S.squeeze("regexp_replace(text, '[" + chr(92) + "x00-" + chr(92) + "x08" + chr(92) + "x0b" + chr(92) + "x0c" + chr(92) + "x0e-" + chr(92) + "x1f" + chr(92) + "x7f]', ' ', 'g')")} AS line,
  CASE WHEN url IS NOT NULL THEN 'supplied_url' WHEN post IS NOT NULL AND name IS NOT NULL THEN 'source_post'
    WHEN seen IS NOT NULL AND (name IS NOT NULL OR post IS NOT NULL) THEN 'source_metadata' END AS evidence_type FROM said)
SELECT claim_id, evidence_type, url AS source_url, coalesce(post, name) AS source_identifier, seen AS observed_at, length(line) AS size,
  CASE WHEN url IS NOT NULL OR (post IS NOT NULL AND name IS NOT NULL) THEN 0.8e0 ELSE 0.65e0 END AS confidence FROM k WHERE evidence_type IS NOT NULL AND line <> ''""")
def a06(t):
    turn, number = F.col("turn"), F.concat_ws("-", "conv_id", "turn")
    none = F.lit(None).cast("string")
    rows = t.conversations.select(
        number.alias("claim_id"), F.col("text").alias("claim"), F.col("text").alias("raw_text"),
        F.when(turn % 5 == 0, F.concat(F.lit("https://posts.example.org/c/"), F.concat_ws("/", "conv_id", "turn"))).alias("source_url"),
        F.when(turn % 3 == 1, F.concat(F.lit("User "), "role")).alias("source_name"),
        F.when(turn % 2 == 1, F.concat(F.lit("post-"), number)).alias("source_post_id"),
        F.when(turn % 4 == 2, F.concat(F.lit("2024-03-0"), (turn % 9 + 1).cast("string"), F.lit("T10:00:00.000Z"))).alias("observed_at"),
        none.alias("exact_quote"), none.alias("context"), none.alias("image_id"), none.alias("image_sha256"),
        none.alias("image_text"), none.alias("image_filename"))
    return occurrence_source.build_occurrences(rows).select(
        "claim_id", "evidence_type", "source_url", "source_identifier", "observed_at",
        F.length("exact_text").cast("bigint").alias("size"), "confidence")


@query("g01_evidence_union", f"""WITH {_BASE}
SELECT claim_id, string_agg(DISTINCT 'p' || (n % 3), '|' ORDER BY 'p' || (n % 3)) AS ids FROM snaps GROUP BY claim_id""")
def g01(t):
    """Distinct ids of a claim's sources, blanks dropped."""
    rows = snapshots(t).select("claim_id", F.array(
        F.concat(F.lit("p"), (F.substring("source_id", 2, 12).cast("bigint") % 3).cast("string")), F.lit("")).alias("_ids"))
    merged = rows.groupBy("claim_id").agg(F.array_distinct(F.filter(F.flatten(F.collect_list("_ids")), lambda x: x != "")).alias("_all"))
    return merged.select("claim_id", F.array_join(F.array_sort("_all"), "|").alias("ids"))


@query("g02_unique_evidence", f"WITH {_BASE} SELECT source_id, 2 AS kept FROM snaps")
def g02(t):
    """Four entries per source, two of them repeated in other words."""
    item = lambda role, text: F.struct(
        F.col("source_id").alias("source_id"), F.lit("p").alias("passage_id"), F.lit(text).alias("exact_text"), F.lit(role).alias("role"))
    rows = snapshots(t).select("source_id", F.array(item("before", "x"), item("after", "y"), item("before", "z"), item("after", "x")).alias("_e"))
    return rows.select("source_id", F.size(evidence.unique_evidence(F.col("_e"))).cast("bigint").alias("kept"))


@query("g03_distinct_queries", """
SELECT l_orderkey AS claim_id, count(DISTINCT lower(CASE WHEN l_linenumber % 2 = 0 THEN upper(l_returnflag) ELSE lower(l_returnflag) END)) AS queries FROM lineitem GROUP BY 1""")
def g03(t):
    """Queries that differ only in case count once; pre-aggregated before the shuffle."""
    text = F.when(F.col("l_linenumber") % 2 == 0, F.upper("l_returnflag")).otherwise(F.lower("l_returnflag"))
    return t.lineitem.select(F.col("l_orderkey").alias("claim_id"), F.lower(text).alias("q")).groupBy("claim_id").agg(
        F.count_distinct("q").alias("queries"))


@query("g06_term_difference", f"""
SELECT doc_id, array_to_string(list_sort(list_filter({S.negated_terms('text')}, lambda x: NOT list_contains({S.match_terms(S.extract_claim('text'))}, x))), ' ') AS outside FROM documents""")
def g06(t):
    """Denied terms of a document that its claim does not use."""
    x = F.col("text")
    left = F.array_except(T.negated_terms(x), T.match_terms(T.extract_claim(x)))
    return t.documents.select("doc_id", F.array_join(F.array_sort(left), " ").alias("outside"))
