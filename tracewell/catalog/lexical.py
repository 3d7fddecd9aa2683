"""Claim text and library matching on ``documents``, ``conversations`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.catalog import sql as S
from tracewell.catalog.registry import query
from tracewell.functions import pages as P
from tracewell.functions import text as T
from tracewell.operators import discovery, index, matching
from tracewell.operators.ranking import top_k

# ---------------------------------------------------------------- inputs


def claims(t) -> DataFrame:
    """Every document is a submission; its claim is the first longest sentence."""
    return t.documents.select(F.col("doc_id").alias("claim_id"), T.extract_claim(F.col("text")).alias("claim"))


def records(t) -> DataFrame:
    """Every benchmark text is a record; its longest sentence is an alias."""
    return t.benchmark.select(
        F.col("item_id").alias("record_id"), F.col("text").alias("canonical_claim"),
        F.array(T.extract_claim(F.col("text"))).alias("aliases"),
        F.when(F.col("item_id") % 3 == 0, "externally_verified").otherwise("illustrative").alias("dataset_provenance"),
    )


CLAIMS = f"claims AS MATERIALIZED (SELECT doc_id AS claim_id, {S.extract_claim('text')} AS claim FROM documents)"


def library_sql(aliases: bool = True) -> str:
    """The library's wordings, their terms and weights."""
    more = f" UNION ALL SELECT item_id, 1, {S.extract_claim('text')} FROM benchmark" if aliases else ""
    return f"""
library AS MATERIALIZED (
  SELECT item_id AS record_id, 0 AS text_no, text FROM benchmark{more}),
library_terms AS MATERIALIZED (
  SELECT record_id, text_no, unnest({S.match_terms('text')}) AS term FROM library),
weights AS MATERIALIZED (
  SELECT term, count(*) AS df, ln(((SELECT count(*) FROM library) + 1e0) / (count(*) + 0.5e0)) AS idf
  FROM library_terms GROUP BY term),
w AS MATERIALIZED (SELECT term, df, idf, floor(idf * idf * 1e9 + 0.5e0)::BIGINT AS w2 FROM weights),
unseen AS (SELECT floor(power(ln(((SELECT count(*) FROM library) + 1e0) / 0.5e0), 2) * 1e9 + 0.5e0)::BIGINT AS w2)
"""


LIBRARY = library_sql()
SCORES = f"""{CLAIMS}, {LIBRARY},
claim_terms AS MATERIALIZED (SELECT claim_id, unnest({S.match_terms('claim')}) AS term FROM claims),
claim_norm AS (SELECT claim_id, sum(coalesce(w.w2, unseen.w2))::BIGINT AS norm
  FROM claim_terms LEFT JOIN w USING (term) CROSS JOIN unseen GROUP BY claim_id),
text_norm AS (SELECT record_id, text_no, sum(w2)::BIGINT AS norm FROM library_terms JOIN w USING (term) GROUP BY ALL),
dots AS (SELECT claim_id, record_id, text_no, sum(w2)::BIGINT AS dot
  FROM claim_terms JOIN library_terms USING (term) JOIN w USING (term) GROUP BY ALL),
lexical AS (SELECT claim_id, record_id, max(dot / sqrt(t.norm::DOUBLE * c.norm::DOUBLE)) AS score
  FROM dots JOIN text_norm t USING (record_id, text_no) JOIN claim_norm c USING (claim_id) GROUP BY ALL),
denied AS (SELECT claim_id, unnest({S.negated_terms('claim')}) AS term FROM claims),
asserted AS (SELECT item_id AS record_id, unnest({S.match_terms('text')}) AS term FROM benchmark
  EXCEPT SELECT item_id, unnest({S.negated_terms('text')}) FROM benchmark),
conflicts AS MATERIALIZED (SELECT DISTINCT claim_id, record_id FROM denied JOIN asserted USING (term)),
scores AS MATERIALIZED (
  SELECT claim_id, record_id, CASE WHEN k.record_id IS NOT NULL THEN 0e0 ELSE coalesce(score, 0e0) END AS score,
    k.record_id IS NOT NULL AS conflict
  FROM lexical FULL JOIN conflicts k USING (claim_id, record_id)),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, record_id) AS rank
  FROM scores WHERE score > 0)
"""
TOP = f"""{SCORES},
top AS MATERIALIZED (
  SELECT claim_id, max(CASE WHEN rank = 1 THEN record_id END) AS record_id, max(CASE WHEN rank = 1 THEN score END) AS score,
    coalesce(max(CASE WHEN rank = 2 THEN score END), 0e0) AS runner_up
  FROM ranked WHERE rank <= 2 GROUP BY claim_id),
judged AS MATERIALIZED (SELECT *, score BETWEEN 0.28e0 AND 0.78e0 OR score - runner_up < 0.08e0 AS ambiguous FROM top),
matches AS MATERIALIZED (
  SELECT claim_id, record_id, {S.round3('coalesce(score, 0e0)')} AS confidence, coalesce(score, 0e0) AS score,
    coalesce(ambiguous, true) AS ambiguous FROM claims LEFT JOIN judged USING (claim_id))
"""


def scores(t) -> DataFrame:
    return matching.lexical_only(matching.lexical_scores(claims(t), records(t)))


# ---------------------------------------------------------------- claim text

@query("b01_extract_claim", f"""
SELECT 'd' || doc_id AS id, {S.extract_claim('text')} AS claim FROM documents
UNION ALL SELECT 'c' || conv_id || '-' || turn, {S.extract_claim('text')} FROM conversations""")
def b01(t):
    docs = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    turns = t.conversations.select(F.concat(F.lit("c"), F.concat_ws("-", "conv_id", "turn")).alias("id"), "text")
    return docs.unionByName(turns).select("id", T.extract_claim(F.col("text")).alias("claim"))


@query("b02_tokenizers", f"""
SELECT doc_id, array_to_string(list_sort({S.match_terms('text')}), ' ') AS match_terms,
  array_to_string(list_sort({S.letter_terms('text')}), ' ') AS version_terms,
  array_to_string(list_sort({S.compare_terms('text')}), ' ') AS compare_terms
FROM documents""")
def b02(t):
    shown = lambda c: F.array_join(F.array_sort(c), " ")
    x = F.col("text")
    return t.documents.select(
        "doc_id", shown(T.match_terms(x)).alias("match_terms"), shown(T.version_terms(x)).alias("version_terms"),
        shown(T.compare_terms(x)).alias("compare_terms"))


@query("b02_rank_terms", f"""
SELECT doc_id, array_to_string(list_sort({S.rank_terms('text')}), ' ') AS rank_terms FROM documents""")
def b02_rank(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(T.rank_terms(F.col("text"))), " ").alias("rank_terms"))


@query("b03_negated_terms", f"""
SELECT doc_id, array_to_string(list_sort({S.negated_terms('text')}), ' ') AS negated FROM documents""")
def b03(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(T.negated_terms(F.col("text"))), " ").alias("negated"))


_B04 = f"""
WITH denied AS (SELECT doc_id AS claim_id, unnest({S.negated_terms('text')}) AS term FROM documents),
asserted AS (SELECT item_id AS record_id, unnest({S.match_terms('text')}) AS term FROM benchmark
  EXCEPT SELECT item_id, unnest({S.negated_terms('text')}) FROM benchmark)
SELECT DISTINCT claim_id, record_id FROM denied JOIN asserted USING (term)"""


@query("b04_polarity_conflict", _B04)
def b04(t):
    whole = t.documents.select(F.col("doc_id").alias("claim_id"), F.col("text").alias("claim"))
    return matching.polarity_conflicts(whole, records(t))


def _bounded(x: str) -> str:
    return f"array_to_string(string_split({S.clean(x)}[:400], ' ')[:50], ' ')"


@query("b05_discovery_queries", f"""
WITH {CLAIMS},
raw AS (SELECT claim_id, {_bounded('claim')} AS q0 FROM claims),
quoted AS (SELECT *, CASE WHEN length(q0) <= 260 THEN '"' || replace(q0, '"', '') || '"' ELSE q0 END AS q FROM raw WHERE q0 <> ''),
three AS (
  SELECT claim_id, 0 AS ord, q0 AS query FROM quoted
  UNION ALL SELECT claim_id, 1, {_bounded("q || ' fact check context'")} FROM quoted
  UNION ALL SELECT claim_id, 2, {_bounded("q || ' origin " + chr(34) + "first posted" + chr(34) + "'")} FROM quoted),
firsts AS (SELECT *, row_number() OVER (PARTITION BY claim_id, lower(query) ORDER BY ord) AS n FROM three WHERE query <> '')
SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY ord) - 1 AS query_ord, query FROM firsts WHERE n = 1""")
def b05(t):
    return discovery.query_table(claims(t)).withColumn("query_ord", F.col("query_ord").cast("bigint"))


@query("b06_confidence_band", f"""
WITH {TOP} SELECT claim_id, confidence,
  CASE WHEN confidence >= 0.62e0 THEN 'high' WHEN confidence >= 0.34e0 THEN 'medium' ELSE 'low' END AS band FROM matches""")
def b06(t):
    found = matching.deterministic_matches(claims(t), scores(t))
    return found.select("claim_id", "confidence", T.confidence_band(F.col("confidence")).alias("band"))


_CANDIDATES = S.passages("documents", "doc_id", "text")


@query("b17_passage_candidates", f"WITH {_CANDIDATES} SELECT doc_id, ord, passage FROM passages")
def b17(t):
    return t.documents.select("doc_id", F.posexplode(P.passage_candidates(F.col("text"))).alias("ord", "passage")).withColumn(
        "ord", F.col("ord").cast("bigint"))


@query("b18_passage_kind", f"""
WITH all_text AS (
  SELECT 'd' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'o' || o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'The order was originally placed in person.'
    WHEN '2-HIGH' THEN 'According to the clerk it was late.' WHEN '3-MEDIUM' THEN 'First posted by the clerk.'
    WHEN '4-NOT SPECIFIED' THEN 'It was AI-generated.' ELSE 'Nothing to see.' END FROM orders)
SELECT id, {S.passage_kind('text')} AS kind FROM all_text""")
def b18(t):
    cue = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "The order was originally placed in person.")
        .when(F.col("o_orderpriority") == "2-HIGH", "According to the clerk it was late.")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "First posted by the clerk.")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "It was AI-generated.").otherwise("Nothing to see."))
    docs = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    cued = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), cue.alias("text"))
    return docs.unionByName(cued).select("id", P.passage_kind(F.col("text")).alias("kind"))


@query("b19_text_relevance", f"""
WITH pairs AS (
  SELECT doc_id, text, {S.extract_claim('text')} AS claim FROM documents),
terms AS (SELECT doc_id, {S.rank_terms('claim')} AS ct, {S.rank_terms('text')} AS dt, lower({S.squeeze('claim')}) AS phrase, lower(text) AS low FROM pairs)
SELECT doc_id, round({S.overlap_relevance('ct', 'dt', 'phrase', 'low')}, 6) AS relevance FROM terms""")
def b19(t):
    rows = t.documents.select("doc_id", "text", T.extract_claim(F.col("text")).alias("claim"))
    return rows.select("doc_id", F.round(T.text_relevance(F.col("claim"), F.col("text")), 6).alias("relevance"))


_E05 = f"""
WITH {_CANDIDATES},
heads AS (SELECT doc_id, {S.extract_claim('text')} AS claim FROM documents),
asked AS (SELECT doc_id, {S.letter_terms('claim')} AS ct, lower({S.squeeze('claim')}) AS phrase FROM heads),
scored AS (
  SELECT doc_id, ord, passage, {S.passage_kind('passage')} AS kind, {S.overlap_relevance('ct', 'pt', 'phrase', 'lower(passage)')} AS relevance
  FROM (SELECT *, {S.letter_terms('passage')} AS pt FROM passages JOIN asked USING (doc_id))),
kept_passages AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY relevance DESC, ord) AS rank FROM scored
  WHERE relevance > 0 OR ord = 0 OR kind <> 'claim')
SELECT doc_id, rank, kind, round(relevance, 6) AS relevance, 'ev_' || sha256(doc_id::VARCHAR || chr(0) || passage)[:16] AS passage_id
FROM kept_passages WHERE rank <= 6"""


@query("e05_top_passages", _E05)
def e05(t):
    rows = t.documents.select("doc_id", "text", T.extract_claim(F.col("text")).alias("claim"))
    best = rows.select("doc_id", F.posexplode(P.relevant_passages(
        F.col("doc_id").cast("string"), F.col("claim"), F.col("text"))).alias("rank", "_p"))
    return best.select(
        "doc_id", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("_p.kind").alias("kind"),
        F.round("_p.relevance", 6).alias("relevance"), F.col("_p.passage_id").alias("passage_id"))


# ---------------------------------------------------------------- matching

@query("d01_idf", f"WITH {LIBRARY} SELECT term, df, round(idf, 9) AS idf FROM w")
def d01(t):
    weights = matching.term_weights(matching.library_texts(records(t)))
    return weights.select("term", "df", F.round("idf", 9).alias("idf"))


@query("c01_similarity_join", f"WITH {SCORES} SELECT claim_id, record_id, {S.round3('score')} AS score, conflict FROM scores")
def c01(t):
    return scores(t).select("claim_id", "record_id", T.round3(F.col("score")).alias("score"), "conflict")


@query("d02_best_wording", f"""WITH {SCORES}
SELECT record_id, {S.round3('max(score)')} AS best, count(*) AS claims FROM lexical GROUP BY record_id""")
def d02(t):
    found = matching.lexical_scores(claims(t), records(t)).filter(F.col("lexical") > 0)
    return found.groupBy("record_id").agg(T.round3(F.max("lexical")).alias("best"), F.count(F.lit(1)).alias("claims"))


@query("e03_candidates", f"""WITH {SCORES}
SELECT claim_id, record_id, rank, {S.round3('score')} AS confidence FROM ranked WHERE rank <= 4""")
def e03(t):
    return matching.candidates(scores(t)).select(
        "claim_id", "record_id", F.col("rank").cast("bigint").alias("rank"), "confidence")


@query("e03_indexed_candidates", f"""WITH {CLAIMS},
terms AS MATERIALIZED (SELECT claim_id, unnest({S.match_terms('claim')}) AS term FROM claims),
w AS MATERIALIZED (SELECT term, floor(power(ln(((SELECT count(*) FROM claims) + 1e0) / (count(*) + 0.5e0)), 2) * 1e9 + 0.5e0)::BIGINT AS w2 FROM terms GROUP BY term),
norms AS MATERIALIZED (SELECT claim_id, sum(w2)::BIGINT AS norm FROM terms JOIN w USING (term) GROUP BY 1),
dots AS (SELECT a.claim_id, b.claim_id AS record_id, sum(w2)::BIGINT AS dot
  FROM terms a JOIN terms b USING (term) JOIN w USING (term) WHERE a.claim_id % 20 = 0 GROUP BY ALL),
asserted AS (SELECT claim_id, term FROM terms EXCEPT SELECT claim_id, unnest({S.negated_terms('claim')}) FROM claims),
denied AS (SELECT claim_id, unnest({S.negated_terms('claim')}) AS term FROM claims WHERE claim_id % 20 = 0),
refused AS (SELECT DISTINCT d.claim_id, a.claim_id AS record_id FROM denied d JOIN asserted a USING (term)),
scored AS (SELECT claim_id, record_id, dot / sqrt(r.norm::DOUBLE * q.norm::DOUBLE) AS score
  FROM dots ANTI JOIN refused USING (claim_id, record_id) JOIN norms q USING (claim_id) JOIN norms r ON r.claim_id = record_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, record_id) AS rank FROM scored WHERE score > 0)
SELECT claim_id, record_id, rank, {S.round3('score')} AS confidence FROM ranked WHERE rank <= 4""")
def e03_indexed(t):
    """The claims of all documents as a library; every document whose id is divisible by 20 asks for its best four."""
    library = claims(t).select(
        F.col("claim_id").alias("record_id"), F.col("claim").alias("canonical_claim"), F.array().cast("array<string>").alias("aliases"))
    best = index.best_records(claims(t).filter(F.col("claim_id") % 20 == 0), index.library_index(library), K.CANDIDATES_KEPT)
    return matching.candidates(best).select("claim_id", "record_id", F.col("rank").cast("bigint").alias("rank"), "confidence")


@query("e03_ambiguity", f"""WITH {TOP}
SELECT claim_id, record_id, {S.round3('score')} AS confidence, {S.round3('score - runner_up')} AS margin, ambiguous FROM judged""")
def e03_ambiguity(t):
    return matching.ambiguity(scores(t)).select(
        "claim_id", "record_id", T.round3(F.col("score")).alias("confidence"), T.round3(F.col("margin")).alias("margin"),
        "ambiguous")


@query("d18_known_record_match", f"""WITH {TOP}
SELECT claim_id, m.record_id IS NOT NULL AND confidence >= 0.62e0 AS matched,
  CASE WHEN confidence >= 0.62e0 THEN m.record_id END AS record_id,
  CASE WHEN confidence >= 0.62e0 THEN CASE WHEN m.record_id % 3 = 0 THEN 'externally_verified' ELSE 'illustrative' END END AS dataset_provenance,
  confidence AS similarity, coalesce(confidence >= 0.62e0 AND m.record_id % 3 = 0, false) AS verified,
  CASE WHEN confidence >= 0.62e0 THEN 'high' WHEN confidence >= 0.34e0 THEN 'medium' ELSE 'low' END AS band
FROM matches m""")
def d18(t):
    return matching.known_record_matches(matching.deterministic_matches(claims(t), scores(t)), records(t))


_DECISIONS = """
decisions AS MATERIALIZED (
  SELECT claim_id, CASE claim_id % 4 WHEN 0 THEN coalesce(record_id, 1) WHEN 1 THEN NULL WHEN 2 THEN coalesce(record_id + 1, 2) ELSE -1 END AS chosen,
    0.5e0 + (claim_id % 10) / 20e0 AS sure FROM matches WHERE ambiguous),
shortlist AS MATERIALIZED (
  SELECT claim_id, list(record_id) AS ids FROM (
    SELECT claim_id, record_id, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, record_id) AS n
    FROM (SELECT claims.claim_id, item_id, coalesce(s.score, 0e0) FROM claims CROSS JOIN benchmark
      LEFT JOIN scores s ON s.claim_id = claims.claim_id AND s.record_id = item_id WHERE NOT coalesce(s.conflict, false)) x(claim_id, record_id, score))
  WHERE n <= 6 GROUP BY claim_id)
"""


@query("c16_adjudication_merge", f"""WITH {TOP}, {_DECISIONS},
joined AS (SELECT m.*, s.ids, d.chosen, d.sure, m.ambiguous AND d.sure IS NOT NULL AS open FROM matches m
  LEFT JOIN shortlist s USING (claim_id) LEFT JOIN decisions d USING (claim_id))
SELECT claim_id,
  CASE WHEN open AND (ids IS NULL OR chosen IS NULL) THEN NULL WHEN open AND list_contains(ids, chosen) THEN chosen ELSE record_id END AS record_id,
  CASE WHEN open AND ids IS NULL THEN 0e0 WHEN open AND chosen IS NULL THEN {S.round3('least(score, 1e0 - sure)')}
    WHEN open AND list_contains(ids, chosen) THEN {S.round3('sure')} ELSE confidence END AS confidence,
  CASE WHEN open AND ids IS NOT NULL AND (chosen IS NULL OR list_contains(ids, chosen)) THEN 'llm_adjudicated' ELSE 'lexical' END AS strategy
FROM joined""")
def c16(t):
    """Decisions are derived from the matches: confirm, refuse, name the next record, name an unknown one.

    A claim without a common term is given a record of the library's first ones, which its shortlist holds.
    """
    found = scores(t)
    matches = matching.deterministic_matches(claims(t), found)
    turn = F.col("claim_id") % 4
    decisions = matches.filter("ambiguous").select(
        "claim_id",
        F.when(turn == 0, F.coalesce("record_id", F.lit(1))).when(turn == 1, None)
        .when(turn == 2, F.coalesce(F.col("record_id") + 1, F.lit(2))).otherwise(-1).alias("record_id"),
        (F.lit(0.5) + (F.col("claim_id") % 10) / F.lit(20.0)).alias("confidence"))
    merged = matching.adjudicate(matches, matching.shortlists(claims(t), found, records(t)), decisions)
    return merged.select("claim_id", "record_id", T.round3(F.col("confidence")).alias("confidence"), "strategy")


_EVAL = f"""WITH {LIBRARY},
asked AS (SELECT 'canonical' AS kind, record_id AS expected, text FROM library WHERE text_no = 0
  UNION ALL SELECT 'alias', record_id, text FROM library WHERE text_no = 1
  UNION ALL SELECT 'turn', NULL, text FROM conversations),
a AS MATERIALIZED (SELECT row_number() OVER (ORDER BY kind, expected, text) AS id, * FROM asked),
a_terms AS MATERIALIZED (SELECT id, unnest({S.match_terms('text')}) AS term FROM a),
an AS (SELECT id, sum(coalesce(w.w2, unseen.w2))::BIGINT AS norm FROM a_terms LEFT JOIN w USING (term) CROSS JOIN unseen GROUP BY id),
tn AS (SELECT record_id, text_no, sum(w2)::BIGINT AS norm FROM library_terms JOIN w USING (term) GROUP BY ALL),
dots AS (SELECT id, record_id, text_no, sum(w2)::BIGINT AS dot FROM a_terms JOIN library_terms USING (term) JOIN w USING (term) GROUP BY ALL),
lex AS (SELECT id, record_id, max(dot / sqrt(tn.norm::DOUBLE * an.norm::DOUBLE)) AS score FROM dots JOIN tn USING (record_id, text_no) JOIN an USING (id) GROUP BY ALL),
neg AS (SELECT DISTINCT id, record_id FROM (SELECT id, unnest({S.negated_terms('text')}) AS term FROM a) JOIN
  (SELECT item_id AS record_id, unnest({S.match_terms('text')}) AS term FROM benchmark
   EXCEPT SELECT item_id, unnest({S.negated_terms('text')}) FROM benchmark) USING (term)),
best AS (SELECT id, record_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, record_id) AS n
  FROM lex ANTI JOIN neg USING (id, record_id) WHERE score > 0),
p AS (SELECT kind, expected, record_id, {S.round3('coalesce(score, 0e0)')} AS confidence FROM a LEFT JOIN (SELECT * FROM best WHERE n = 1) USING (id))
SELECT kind, count(*) AS texts, count(*) FILTER (expected IS NOT NULL AND record_id = expected) AS routed,
  count(*) FILTER (expected IS NOT NULL AND record_id = expected AND confidence >= 0.62e0) AS routed_and_traced,
  count(*) FILTER (expected IS NOT NULL AND confidence < 0.62e0) AS below_threshold,
  count(*) FILTER (expected IS NULL AND confidence >= 0.62e0) AS falsely_traced,
  floor(avg(CASE WHEN expected IS NOT NULL THEN (CASE WHEN record_id = expected THEN 1e0 ELSE 0e0 END) END) * 1000e0 + 0.5e0) / 1000e0 AS accuracy
FROM p GROUP BY kind"""


@query("d23_match_evaluation", _EVAL)
def d23(t):
    """Every wording of the library, and every conversation turn as an unrelated text."""
    library = records(t)
    wordings = matching.library_texts(library).select(
        F.concat_ws("-", F.lit("r"), "record_id", "text_no").alias("claim_id"),
        F.when(F.col("text_no") == 0, "canonical").otherwise("alias").alias("kind"),
        F.col("record_id").alias("expected"), F.col("text").alias("claim"))
    turns = t.conversations.select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("claim_id"), F.lit("turn").alias("kind"),
        F.lit(None).cast("bigint").alias("expected"), F.col("text").alias("claim"))
    asked = wordings.unionByName(turns)
    found = matching.deterministic_matches(asked, matching.lexical_only(matching.lexical_scores(asked, library)))
    return matching.evaluate(asked.select("claim_id", "kind", "expected").join(found, "claim_id"))


# ---------------------------------------------------------------- vectors

def _vector_queries(t) -> DataFrame:
    """Every vector whose id is divisible by 20 is asked for, against all vectors."""
    return t.embeddings.filter(F.col("vec_id") % 20 == 0)


def _library_vectors(t) -> DataFrame:
    """All vectors of a label stand for its record's wordings."""
    return t.embeddings.select(F.col("label").cast("bigint").alias("record_id"), "embedding")


_VECTORS = """
semantic AS MATERIALIZED (
  SELECT q.vec_id AS claim_id, v.label::BIGINT AS record_id, max(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS semantic
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 GROUP BY ALL)
"""


@query("c03_vector_nearest", f"""WITH {_VECTORS}
SELECT claim_id, record_id, {S.round3('semantic')} AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY semantic DESC, record_id) AS n FROM semantic) WHERE n <= 4""")
def c03(t):
    vectors = _vector_queries(t).select(F.col("vec_id").alias("claim_id"), "embedding")
    best = matching.vector_scores(vectors, _library_vectors(t), k=4)
    return best.select("claim_id", "record_id", T.round3(F.col("semantic")).alias("confidence"))


@query("c02_hybrid_scores", f"""WITH {_VECTORS},
lex AS (SELECT vec_id AS claim_id, label::BIGINT AS record_id, (vec_id % 97) / 97e0 AS lexical, vec_id % 10 = 0 AS conflict FROM embeddings WHERE vec_id % 20 = 0),
both_ AS (SELECT claim_id, record_id, CASE WHEN coalesce(conflict, false) THEN 0e0 ELSE 0.65e0 * coalesce(semantic, 0e0) + 0.35e0 * coalesce(lexical, 0e0) END AS score,
  coalesce(conflict, false) AS conflict FROM lex FULL JOIN semantic USING (claim_id, record_id))
SELECT claim_id, record_id, {S.round3("score")} AS score, conflict FROM (
  SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, record_id) AS n FROM both_) WHERE n <= 4""")
def c02(t):
    """The best four records per claim under both layers.

    Pairs with a lexical score are asked for by name; among all others the semantic score alone ranks, so the
    best four of them are among the best four plus as many as a claim has lexical pairs (one, here).
    """
    label = F.col("label").cast("bigint")
    vectors = _vector_queries(t).select(F.col("vec_id").alias("claim_id"), "embedding", F.array(label).alias("also"))
    lexical = _vector_queries(t).select(
        F.col("vec_id").alias("claim_id"), label.alias("record_id"),
        ((F.col("vec_id") % 97) / F.lit(97.0)).alias("lexical"), (F.col("vec_id") % 10 == 0).alias("conflict"))
    both = matching.hybrid_scores(lexical, matching.vector_scores(vectors, _library_vectors(t), k=5))
    best = top_k(both, ["claim_id"], [F.desc("score"), F.asc("record_id")], 4)
    return best.select("claim_id", "record_id", T.round3(F.col("score")).alias("score"), "conflict")
