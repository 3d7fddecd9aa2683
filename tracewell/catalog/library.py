"""Library records, history, limiter and images on ``benchmark``, ``events`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.catalog import lexical
from tracewell.catalog import sql as S
from tracewell.catalog.registry import query
from tracewell.functions import text as T
from tracewell.operators import graph, history, records
from tracewell.session import new_folder
from tracewell.sources import images
from tracewell.streaming import jobs

# ---------------------------------------------------------------- authored records

_VERDICTS = ("false", "misleading", "missing_context", "true")
_HOPS = ("original_event", "stripped_context", "fabricated_cause", "recycled_old_media", "exaggeration", "false_caption")


def _source(publisher: Column, url: Column, primary: Column) -> Column:
    return F.struct(
        publisher.alias("publisher"), url.alias("url"), F.lit("2024-01-01").alias("published_date"),
        F.lit("news_report").alias("source_type"), F.lit(None).cast("string").alias("availability"),
        primary.alias("is_primary"), F.lit("what it shows").alias("evidence_description"))


def _cited(n: Column) -> Column:
    """Alternating: an item, a home page, nothing, an item with credentials."""
    site = F.concat(F.lit("https://desk"), n.cast("string"), F.lit(".example.org/"))
    return F.when(n % 4 == 0, F.concat(site, F.lit("item"))).when(n % 4 == 1, site).when(
        n % 4 == 3, F.concat(F.lit("https://u:p@desk"), n.cast("string"), F.lit(".example.org/item")))


def authored(t) -> DataFrame:
    """Every benchmark text as an authored record of four hops and four relationships."""
    n, number = F.col("item_id"), F.col("item_id").cast("string")
    kinds = F.array(*[F.lit(h) for h in _HOPS])
    hop = lambda i: F.struct(
        (F.lit("original_event") if i == 0 else F.element_at(kinds, ((n + i) % 6 + 1).cast("int"))).alias("type"),
        F.concat(F.lit(f"hop {i + 1} of "), number).alias("text"), F.lit("changed").alias("what_changed"),
        F.lit("matters").alias("why_it_matters"),
        F.array(_source(F.concat(F.lit("Desk "), number), _cited(n + i), F.lit(i == 0))).alias("sources"))
    rel = lambda source, target, kind, status, confidence: F.struct(
        source.alias("from_node_id"), F.lit(target).alias("to_node_id"), kind.alias("relationship"), status.alias("status"),
        F.lit(confidence).alias("confidence"), F.when(n % 2 == 0, "exaggeration").alias("mutation_type"), F.lit("stated").alias("reason"))
    lit = F.lit
    relationships = F.array(
        rel(lit("hop-1"), "hop-2", F.when(n % 3 == 0, "derived_from").otherwise("related_claim"), lit("established"), 0.9),
        rel(lit("origin"), "hop-1", lit("same_event"), lit("established"), 0.8),
        rel(lit("hop-2"), "hop-3", lit("reposted_from"), F.when(n % 5 == 0, "candidate").otherwise("established"), 0.7),
        rel(F.when(n % 7 == 0, lit("hop-9")).otherwise(lit("hop-3")), "hop-4", lit("quoted_from"), lit("established"), 0.6))
    scores = F.create_map(*[v for i, s in enumerate(K.SIGNAL_LABELS) for v in (lit(s), ((n * 13 + i * 29) % 101).cast("int"))])
    return t.benchmark.select(
        number.alias("record_id"), F.col("text").alias("canonical_claim"), F.array(T.extract_claim(F.col("text"))).alias("aliases"),
        F.element_at(F.array(*[lit(v) for v in _VERDICTS]), (n % 4 + 1).cast("int")).alias("verdict"),
        lit("science").alias("topic"), lit("global").alias("region"),
        F.when(n % 3 == 0, "externally_verified").otherwise("illustrative").alias("dataset_provenance"),
        F.struct(
            lit("Register").alias("source"), F.when(n % 6 == 0, lit("2024-02-30")).otherwise(lit("2024-02-28")).alias("date"),
            F.concat(lit("event "), number).alias("what_actually_happened"),
            F.array(_source(lit("Register"), F.concat(lit("https://register.example.org/"), number), n % 4 != 2)).alias("sources")).alias("origin"),
        F.array(*[hop(i) for i in range(4)]).alias("hops"), relationships.alias("relationships"), scores.alias("scores"),
        lit("look twice").alias("lesson"))


def loaded(t) -> DataFrame:
    return records.load_records(authored(t))


def from_files(t) -> DataFrame:
    """The records after a way through record files."""
    folder = new_folder(t.spark, "records")
    authored(t).write.json(folder)
    return records.load_records(records.read_records(t.spark, folder))


def _hop_type(i: str) -> str:
    return f"CASE WHEN {i} = 0 THEN 'original_event' ELSE {S.strings(_HOPS)}[(item_id + {i}) % 6 + 1] END"


_HOPS_SQL = f"hops AS MATERIALIZED (SELECT item_id, i, {_hop_type('i')} AS type FROM benchmark, (VALUES (0), (1), (2), (3)) AS h(i))"
_RELS = """
rels AS MATERIALIZED (
  SELECT item_id, 1 AS ord, 'hop-1' AS src, 'hop-2' AS dst, CASE WHEN item_id % 3 = 0 THEN 'derived_from' ELSE 'related_claim' END AS kind, 'established' AS status, 0.9e0 AS conf FROM benchmark
  UNION ALL SELECT item_id, 2, 'origin', 'hop-1', 'same_event', 'established', 0.8e0 FROM benchmark
  UNION ALL SELECT item_id, 3, 'hop-2', 'hop-3', 'reposted_from', CASE WHEN item_id % 5 = 0 THEN 'candidate' ELSE 'established' END, 0.7e0 FROM benchmark
  UNION ALL SELECT item_id, 4, CASE WHEN item_id % 7 = 0 THEN 'hop-9' ELSE 'hop-3' END, 'hop-4', 'quoted_from', 'established', 0.6e0 FROM benchmark)
"""


@query("a01_load_records", f"""WITH {_RELS}, h(i) AS (VALUES (1), (2), (3), (4))
SELECT item_id::VARCHAR AS record_id, i AS hop, 'hop ' || i || ' of ' || item_id AS now,
  CASE i WHEN 1 THEN 'event ' || item_id WHEN 2 THEN 'hop 1 of ' || item_id WHEN 3 THEN 'hop 2 of ' || item_id ELSE CASE WHEN item_id % 7 <> 0 THEN 'hop 3 of ' || item_id END END AS previously,
  ['linked', 'organisation_only', 'unavailable', 'linked'][(item_id + i - 1) % 4 + 1] AS availability FROM benchmark, h""")
def a01(t):
    rows = from_files(t).select("record_id", F.explode("hops").alias("_h"))
    return rows.select(
        "record_id", F.col("_h.hop").cast("bigint").alias("hop"), "_h.now", "_h.previously",
        F.get("_h.sources", F.lit(0))["availability"].alias("availability"))


@query("a02_validate_records", "SELECT item_id::VARCHAR AS record_id, 4 AS position, 'missing_source' AS violation FROM benchmark WHERE item_id % 7 = 0")
def a02(t):
    return records.validate_records(authored(t)).withColumn("position", F.col("position").cast("bigint"))


@query("a09_list_records", f"""SELECT item_id::VARCHAR AS record_id, text AS canonical_claim, {S.strings(_VERDICTS)}[item_id % 4 + 1] AS verdict,
  CASE WHEN item_id % 6 = 0 THEN '2024-02-30' ELSE '2024-02-28' END AS origin_date, 4 AS hop_count FROM benchmark""")
def a09(t):
    return records.list_records(loaded(t)).select("record_id", "canonical_claim", "verdict", "origin_date", "hop_count")


@query("a10_get_record", "SELECT event_id, item_id AS record_id, length(text) AS size FROM events LEFT JOIN benchmark ON item_id = user_id")
def a10(t):
    """Every event looks up the record of its user's number; most have none."""
    asked = t.events.select("event_id", F.col("user_id").alias("record_id"))
    library = t.benchmark.select(F.col("item_id").alias("record_id"), F.length("text").cast("bigint").alias("size"))
    return records.lookup_records(asked, library).select("event_id", "record_id", "size")


@query("b36_usable_citation", "SELECT item_id::VARCHAR AS record_id, i AS hop, (item_id + i) % 4 = 0 AS usable FROM benchmark, (VALUES (0), (1), (2), (3)) AS h(i)")
def b36(t):
    rows = loaded(t).select("record_id", F.explode("hops").alias("_h"))
    return rows.select("record_id", (F.col("_h.hop") - 1).cast("bigint").alias("hop"),
                       records.usable_citation(F.get("_h.sources", F.lit(0))).alias("usable"))


@query("b37_source_availability", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'unavailable' WHEN page_id % 3 = 1 THEN 'organisation_only' ELSE 'linked' END AS availability FROM pages")
def b37(t):
    n = F.col("page_id")
    url = F.when(n % 3 == 1, F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.lit("/"))).when(n % 3 == 2, F.col("url"))
    return t.pages.select("page_id", url.alias("u")).select("page_id", records.availability(F.col("u")).alias("availability"))


@query("c11_hop_predecessor", f"""WITH {_RELS}, h(i) AS (VALUES (1), (2), (3), (4)),
last AS (SELECT item_id, dst, arg_max(src, ord) AS src FROM rels GROUP BY ALL)
SELECT item_id::VARCHAR AS record_id, i AS hop, CASE WHEN src = 'origin' THEN 'event ' || item_id WHEN src IN ('hop-1', 'hop-2', 'hop-3', 'hop-4') THEN 'hop ' || src[5:] || ' of ' || item_id END AS previously,
  'hop ' || i || ' of ' || item_id AS now FROM benchmark JOIN h ON true LEFT JOIN last USING (item_id) WHERE last.dst = 'hop-' || i""")
def c11(t):
    rows = authored(t)
    hops = rows.select("record_id", F.posexplode("hops").alias("_i", "_h")).select(
        "record_id", (F.col("_i") + 1).cast("bigint").alias("hop"), F.col("_h.text").alias("text"))
    links = rows.select("record_id", F.posexplode("relationships").alias("ord", "_r")).select(
        "record_id", "ord", "_r.from_node_id", "_r.to_node_id")
    return records.hop_chain(hops, links, rows.select("record_id", "origin.what_actually_happened"))


_STEPS = "steps(type, step_id) AS (VALUES " + ", ".join(f"({S.text(a)}, {S.text(b)})" for a, b in K.CHECK_STEPS) + ")"


@query("c12_check_steps", f"""WITH {_HOPS_SQL}, {_STEPS},
s AS (SELECT item_id, step_id, min(3 - i) AS pos FROM hops JOIN steps USING (type) GROUP BY ALL),
o AS (SELECT item_id, step_id, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS step_no, count(*) OVER (PARTITION BY item_id) AS n FROM s)
SELECT item_id::VARCHAR AS record_id, step_no, step_id FROM o
UNION ALL SELECT item_id::VARCHAR, max(n) + 1, 'generic-pause' FROM o WHERE n < 4 GROUP BY item_id""")
def c12(t):
    return records.check_steps(loaded(t))


@query("c13_messenger_wording", f"""WITH openers(verdict, opener) AS (VALUES {', '.join(f"({S.text(a)}, {S.text(b)})" for a, b in K.VERDICT_OPENERS)})
SELECT event_id AS claim_id, item_id::VARCHAR AS record_id, opener || {S.text(K.MESSENGER_BRIDGE)} || 'event ' || item_id AS explanation
FROM events JOIN benchmark ON item_id = event_id % (SELECT count(*) FROM benchmark) JOIN openers ON verdict = {S.strings(_VERDICTS)}[item_id % 4 + 1]""")
def c13(t):
    """Every event is a traced claim of one of the records, all of which are used."""
    count = t.benchmark.select(F.count(F.lit(1))).scalar()
    traced = t.events.select(F.col("event_id").alias("claim_id"), (F.col("event_id") % count).cast("string").alias("record_id"))
    return records.messenger_explanations(traced, loaded(t))


_PATHS = f"""WITH {_RELS},
usable AS MATERIALIZED (SELECT *, (item_id + dst[5:]::INT - 1) % 4 = 0 AS cited, kind IN {S.members(K.TRANSMISSION_TYPES)} AS transmits FROM rels
  WHERE status = 'established' AND kind IN {S.members(K.TRANSMISSION_TYPES + K.IDENTITY_TYPES)}),
walk AS (WITH RECURSIVE w AS (SELECT item_id, 'origin' AS node FROM benchmark
  UNION SELECT u.item_id, u.dst FROM w JOIN usable u ON u.item_id = w.item_id AND u.src = w.node WHERE u.cited) SELECT * FROM w),
credited AS MATERIALIZED (SELECT u.* FROM usable u SEMI JOIN walk w ON w.item_id = u.item_id AND w.node = u.src WHERE u.cited AND u.transmits)
"""


@query("d16_curated_completeness", f"""{_PATHS}, {_HOPS_SQL},
required AS (SELECT item_id, 'hop-' || (i + 1) AS node FROM hops WHERE type <> 'original_event'),
per AS (SELECT r.item_id, count(*) AS n, count(c.dst) AS done, avg(c.conf) AS conf FROM required r LEFT JOIN credited c ON c.item_id = r.item_id AND c.dst = r.node GROUP BY 1)
SELECT item_id::VARCHAR AS record_id, round(coalesce(done / n, 0e0), 6) AS completeness, coalesce(n > 0 AND n = done, false) AS complete
FROM benchmark LEFT JOIN per USING (item_id)""")
def d16(t):
    return records.curated_completeness(loaded(t)).select("record_id", F.round("completeness", 6).alias("completeness"), "complete")


@query("h05_forward_reachability", f"{_PATHS} SELECT item_id::VARCHAR AS record_id, node FROM walk")
def h05(t):
    rows = loaded(t)
    path = records.curated_path(F.col("record_id"), F.col("hops"), F.col("relationships"))
    return rows.select("record_id", F.explode(path["reached"]).alias("node"))


@query("d17_curated_stages", f"""WITH {_HOPS_SQL},
v AS (SELECT *, item_id % 6 <> 0 AS dated, item_id % 4 <> 2 AS primary_source FROM benchmark WHERE item_id % 3 = 0),
c AS (SELECT v.item_id, bool_or(h.type <> 'original_event' AND (v.item_id + i) % 4 = 0 AND NOT (i = 3 AND v.item_id % 7 = 0)) AS comparable FROM v JOIN hops h USING (item_id) GROUP BY 1),
w AS (SELECT * FROM v JOIN c USING (item_id))
SELECT item_id::VARCHAR AS record_id, 'earliest_source' AS stage_id, CASE WHEN dated THEN 'established' ELSE 'insufficient_evidence' END AS status FROM w
UNION ALL SELECT item_id::VARCHAR, 'context_comparison', CASE WHEN comparable THEN 'established' ELSE 'insufficient_evidence' END FROM w
UNION ALL SELECT item_id::VARCHAR, 'mutation_detection', CASE WHEN comparable THEN 'established' ELSE 'insufficient_evidence' END FROM w
UNION ALL SELECT item_id::VARCHAR, 'origin_assessment', CASE WHEN dated AND primary_source THEN 'established' ELSE 'insufficient_evidence' END FROM w
UNION ALL SELECT item_id::VARCHAR, 'lineage', 'insufficient_evidence' FROM w""")
def d17(t):
    return records.curated_stages(loaded(t)).select("record_id", "stage_id", "status")


@query("d20_signals", f"""WITH {_HOPS_SQL},
clauses(type, signal_id, clause) AS (VALUES {', '.join(f"({S.text(a)}, {S.text(b)}, {S.text(c)})" for a, b, c in K.SIGNAL_CLAUSES)}),
named(signal_id, label, i) AS (VALUES {', '.join(f"({S.text(k)}, {S.text(v)}, {i})" for i, (k, v) in enumerate(K.SIGNAL_LABELS.items()))}),
r AS (SELECT item_id, signal_id, clause, min(hops.i) AS pos FROM hops JOIN clauses USING (type) GROUP BY ALL),
l AS (SELECT item_id, signal_id, list(clause ORDER BY pos) AS reasons FROM r GROUP BY ALL),
s AS (SELECT item_id, signal_id, label, (item_id * 13 + i * 29) % 101 AS score FROM benchmark, named)
SELECT s.item_id::VARCHAR AS record_id, s.signal_id, label, score,
  CASE WHEN CASE WHEN s.signal_id = 'evidence_quality' THEN 100 - score ELSE score END >= 66 THEN 'high' WHEN CASE WHEN s.signal_id = 'evidence_quality' THEN 100 - score ELSE score END >= 33 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN reasons IS NULL THEN 'No mutation in the recorded chain bears directly on this signal.'
    WHEN len(reasons) = 1 THEN 'In this lineage, ' || reasons[1] || '.'
    ELSE 'In this lineage, ' || array_to_string(reasons[:-2], ', ') || ', and ' || reasons[-1] || '.' END AS explanation
FROM s LEFT JOIN l ON l.item_id = s.item_id AND l.signal_id = s.signal_id""")
def d20(t):
    return records.signals(loaded(t)).withColumn("score", F.col("score").cast("bigint"))


@query("e11_hop_numbers", "SELECT item_id::VARCHAR AS record_id, i AS hop, 'hop ' || i || ' of ' || item_id AS text FROM benchmark, (VALUES (1), (2), (3), (4)) AS h(i)")
def e11(t):
    return loaded(t).select("record_id", F.explode("hops").alias("_h")).select(
        "record_id", F.col("_h.hop").cast("bigint").alias("hop"), "_h.text")


@query("h06_record_levels", """SELECT item_id::VARCHAR AS record_id, node_id, CASE WHEN item_id % 7 = 0 AND node_id = 'hop-4' THEN 1 ELSE level END AS level
FROM benchmark, (VALUES ('origin', 0), ('hop-1', 1), ('hop-2', 2), ('hop-3', 3), ('hop-4', 4)) AS l(node_id, level)""")
def h06(t):
    return records.record_levels(loaded(t))


_HIERARCHY = """links AS (SELECT 'o' || o_orderkey AS source, 'c' || o_custkey AS target FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def _hierarchy(t) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    links = (
        t.orders.select(name("o", "o_orderkey").alias("source"), name("c", "o_custkey").alias("target"))
        .unionByName(t.customer.select(name("c", "c_custkey").alias("source"), name("n", "c_nationkey").alias("target")))
        .unionByName(t.nation.select(name("n", "n_nationkey").alias("source"), name("r", "n_regionkey").alias("target"))))
    return links.withColumn("graph_id", F.lit("all"))


@query("h03_hierarchy_reach", f"""WITH {_HIERARCHY},
seeds AS (SELECT 'r' || r_regionkey AS node FROM region WHERE r_name <> 'ASIA'),
w AS (WITH RECURSIVE walk AS (SELECT node, 0 AS hop FROM seeds UNION ALL SELECT l.source, hop + 1 FROM walk JOIN links l ON l.target = walk.node) SELECT * FROM walk)
SELECT node, min(hop) AS hop FROM w GROUP BY node""")
def h03_hierarchy(t):
    """One graph of all orders: every round is a distributed join, whatever the graph's size."""
    seeds = t.region.filter(F.col("r_name") != "ASIA").select(
        F.lit("all").alias("graph_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.reachable(_hierarchy(t), seeds).select("node", F.col("hop").cast("bigint").alias("hop"))


@query("h06_hierarchy_levels", f"""WITH {_HIERARCHY},
nodes AS (SELECT source AS node FROM links UNION SELECT target FROM links),
w AS (WITH RECURSIVE walk AS (SELECT node, 0 AS level FROM nodes UNION SELECT l.target, level + 1 FROM walk JOIN links l ON l.source = walk.node) SELECT * FROM walk)
SELECT node, max(level) AS level FROM w GROUP BY node""")
def h06_hierarchy(t):
    links = _hierarchy(t)
    ends = links.select("graph_id", F.col("source").alias("node")).unionByName(links.select("graph_id", F.col("target").alias("node")))
    return graph.levels(ends.distinct(), links).select("node", "level")


# ---------------------------------------------------------------- history

def analyses(t) -> DataFrame:
    """Every event is an analysis; signups are anonymous."""
    return t.events.select(
        F.col("event_id").alias("analysis_id"), F.when(F.col("event_type") != "signup", F.col("user_id")).alias("user_id"),
        F.col("ts").alias("created_at"), F.lit(b"").alias("content"),
        F.when(F.col("value") > 60, "TRACED").when(F.col("value") > 30, "PARTIALLY_TRACED").otherwise("UNTRACED").alias("trace_status"),
        F.when(F.col("event_id") % 3 == 0, "semantic").otherwise("lexical").alias("strategy"),
        T.confidence_band(F.col("value") / 100).alias("band"))


@query("a07_history_rows", "SELECT event_id AS analysis_id, user_id FROM events WHERE event_type <> 'signup' AND user_id IS NOT NULL")
def a07(t):
    """Two appends to a stored history, read back."""
    folder = new_folder(t.spark, "history")
    rows = analyses(t)
    history.append_history(rows.filter(F.col("analysis_id") % 2 == 0), folder)
    history.append_history(rows.filter(F.col("analysis_id") % 2 == 1), folder)
    return t.spark.read.parquet(folder).select("analysis_id", "user_id")


@query("e12_history_list", """SELECT event_id AS analysis_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position
FROM events WHERE event_type <> 'signup' AND user_id IS NOT NULL""")
def e12(t):
    return history.list_history(history.saveable(analyses(t))).select("analysis_id", "user_id", "position")


_ASKED = "asked AS (SELECT user_id + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS user_id, event_id FROM events WHERE event_type = 'purchase')"


def _asked(t) -> DataFrame:
    """Purchases ask for their own event; odd ones pretend to be the next user."""
    return t.events.filter(F.col("event_type") == "purchase").select(
        (F.col("user_id") + F.when(F.col("event_id") % 2 == 0, 0).otherwise(1)).alias("user_id"), F.col("event_id").alias("analysis_id"))


@query("c14_owned_read", f"WITH {_ASKED} SELECT event_id AS analysis_id, user_id FROM events SEMI JOIN asked USING (user_id, event_id)")
def c14(t):
    return history.owned(history.saveable(analyses(t)), _asked(t)).select("analysis_id", "user_id")


@query("c14_owned_delete", f"WITH {_ASKED} SELECT event_id AS analysis_id, user_id FROM events ANTI JOIN asked USING (user_id, event_id) WHERE event_type <> 'signup'")
def c14_delete(t):
    return history.without_owned(history.saveable(analyses(t)), _asked(t)).select("analysis_id", "user_id")


@query("d22_outcome_counts", """WITH a AS (SELECT CASE WHEN value > 60 THEN 'TRACED' WHEN value > 30 THEN 'PARTIALLY_TRACED' ELSE 'UNTRACED' END AS trace_status,
  CASE WHEN event_id % 3 = 0 THEN 'semantic' ELSE 'lexical' END AS strategy, CASE WHEN value / 100 >= 0.62e0 THEN 'high' WHEN value / 100 >= 0.34e0 THEN 'medium' ELSE 'low' END AS band FROM events)
SELECT trace_status, strategy, band, count(*) AS analyses FROM a GROUP BY ROLLUP (trace_status, strategy, band)""")
def d22(t):
    return history.outcome_counts(analyses(t))


@query("j02_user_activity", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS requests FROM events GROUP BY user_id")
def j02(t):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return history.activity(t.events).select("user_id", shown("first_seen"), shown("last_seen"), "requests")


def _requests(t) -> DataFrame:
    return t.events.select(F.col("event_type").alias("key"), "ts", "event_id")


@query("j01_request_limiter", """WITH RECURSIVE e AS MATERIALIZED (SELECT event_type AS key, epoch_us(ts) AS us, event_id FROM events),
starts AS (SELECT key, min(us) AS opened FROM e GROUP BY key
  UNION ALL SELECT s.key, (SELECT min(us) FROM e WHERE e.key = s.key AND e.us >= s.opened + 600000000) FROM starts s
  WHERE EXISTS (SELECT 1 FROM e WHERE e.key = s.key AND e.us >= s.opened + 600000000)),
placed AS (SELECT e.*, s.opened, row_number() OVER (PARTITION BY e.key, s.opened ORDER BY us, event_id) AS n FROM e ASOF JOIN starts s ON e.key = s.key AND e.us >= s.opened)
SELECT key, event_id, n <= 3 AS allowed, CASE WHEN n <= 3 THEN 0 ELSE ceil((opened + 600000000 - us) / 1e6)::BIGINT END AS retry_after FROM placed""")
def j01(t):
    """Three requests per ten minutes and kind of event."""
    return history.limited_requests(_requests(t), 600, 3).select("key", "event_id", "allowed", "retry_after")


@query("j01_aligned_windows", """SELECT event_type AS key, epoch_us(ts) // 600000000 AS slot, count(*) AS requests, least(count(*), 3) AS allowed FROM events GROUP BY ALL""")
def j01_aligned(t):
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(600000000)).cast("bigint")
    return t.events.groupBy(F.col("event_type").alias("key"), slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("requests"), F.least(F.count(F.lit(1)), F.lit(3)).alias("allowed"))


# the library of the stream has no aliases, and its claims are the turns of conversations
_STREAM = lexical.TOP.replace(lexical.CLAIMS, f"""
claims AS MATERIALIZED (SELECT conv_id || '-' || turn AS claim_id, {S.extract_claim('text')} AS claim FROM conversations)""").replace(
    lexical.LIBRARY, lexical.library_sql(aliases=False))


@query("j03_claim_stream", f"WITH {_STREAM} SELECT claim_id, record_id, confidence, 'lexical' AS strategy FROM matches")
def j03(t):
    """Conversations as a stream of claims, matched to the library and appended to a table."""
    return jobs.match_conversations(t.spark, t.directory)


# ---------------------------------------------------------------- images

def _uploads(t) -> DataFrame:
    """Image files made of the page number: PNG, BMP, WebP, JPEG and junk headers, with copies."""
    n = F.expr("page_id div 2")
    be = lambda v, size: F.lpad(F.hex(v), size * 2, "0")
    le = lambda v, size: F.concat(*[F.lpad(F.hex(F.floor(v / (256 ** i)).cast("bigint") % 256), 2, "0") for i in range(size)])
    w, h = n % 5000 + 1, n % 3000 + 1
    made = (
        F.when(n % 5 == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(w, 4), be(h, 4), F.lit("00")))
        .when(n % 5 == 1, F.concat(F.lit("424D"), F.lit("00" * 16), le(w, 4), le(h, 4)))
        .when(n % 5 == 2, F.concat(F.lit("52494646000000005745425056503858" + "00" * 8), le(w - 1, 3), le(h - 1, 3)))
        .when(n % 5 == 3, F.concat(F.lit("FFD8FF00"), be(w, 4))).otherwise(F.concat(F.lit("00"), be(n, 4))))
    return t.pages.select(F.concat(F.lit("/up/"), F.col("page_id").cast("string")).alias("path"), F.unhex(made).alias("content"))


_IMAGES = """u AS (SELECT page_id, page_id // 2 AS n, (page_id // 2) % 5000 + 1 AS w, (page_id // 2) % 3000 + 1 AS h FROM pages)"""


@query("a05_image_ledger", f"""WITH {_IMAGES}
SELECT '/up/' || page_id AS path, ['png', 'bmp', 'webp', 'jpeg', NULL][n % 5 + 1] AS format, CASE WHEN n % 5 < 3 THEN w END AS width, CASE WHEN n % 5 < 3 THEN h END AS height,
  [25, 26, 30, 8, 5][n % 5 + 1] AS byte_length, CASE WHEN n % 5 = 4 THEN 'unsupported' WHEN n % 5 < 3 AND w * h > 12000000 THEN 'too_large' ELSE 'accepted' END AS verdict FROM u""")
def a05(t):
    return images.image_ledger(_uploads(t)).select("path", "format", "width", "height", "byte_length", "verdict")


@query("a05_duplicate_images", f"""WITH {_IMAGES} SELECT min('/up/' || page_id) AS first_path, count(*) AS copies FROM u GROUP BY n HAVING count(*) > 1""")
def a05_duplicates(t):
    return images.duplicate_images(images.image_ledger(_uploads(t))).select("first_path", "copies")
