"""The queries ``opN_<name>`` over whole tables, and DuckDB SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import (
    alignment, chat_format, decontaminate, exact_dedup, language_crf, mixing, quality_gam, records, sharding, simhash, substring_dedup,
    turn_repair, url_filter,
)
from tracewell.llm.tables import WORD, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint as 16 hexadecimal digits; the component is the smallest id."""
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item found in it."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("n_chunks")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold control strings.
TRICKY_ID, TRICKY = -7, "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(TRICKY_ID).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(TRICKY))
    return chat_format.read_digests(chat_format.format_turns(chat_format.plain_turns(given.union(more))))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scores(table(spark, sf_dir, "documents"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a rule and repaired."""
    return turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_substring_dedup, op3_sharding, op4_simhash, op5_decontamination, op6_quality, op7_exact_dedup,
    op8_language, op9_mixing, op10_token_records, op11_chat_format, op12_token_alignment, op13_turn_repair)}


def _rule_case(answer: int) -> str:
    """The longest rule that fits, or its verdict, as SQL."""
    lines = []
    for rule in sorted(url_filter.RULES, key=lambda r: (-len(r[0]), r[0])):
        domain, slash, start = rule[0].partition("/")
        lines.append(f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash}{start}') THEN '{rule[answer]}'")
    return "CASE " + " ".join(lines) + " END"


_U = url_filter
ORACLES = {
    "op1_url_filter": rf"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_U.URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '{_U.URL}', 2) AS path FROM pages),
rows_ AS (SELECT *, regexp_replace(path, '{_U.VARIABLE_NAMES}', '#', 'g') AS shape, {_rule_case(0)} AS rule, {_rule_case(1)} AS decided FROM cut),
counts AS (
  SELECT host, shape, count(*) AS pages, count(*) FILTER (WHERE decided = 'block') AS bad, count(*) FILTER (WHERE decided = 'allow') AS good
  FROM rows_ GROUP BY ALL),
prior AS (SELECT CASE WHEN sum(bad + good) > 0 THEN sum(bad)::DOUBLE / sum(bad + good)::DOUBLE ELSE 0.5 END AS p FROM counts),
steps AS (
  SELECT host, shape, pages, bad, good, i, names[i] AS name,
         array_to_string(list_concat(names[1:i - 1], ['']), '/') AS above,
         array_to_string(list_concat([''], names[i + 1:]), '/') AS below
  FROM (SELECT *, string_split(shape, '/') AS names FROM counts), unnest(range(1, len(names) + 1)) AS t(i)),
seen AS (
  SELECT host, i, above, name, below, label, sum(n)::BIGINT AS n FROM (
    SELECT *, 'bad' AS label, bad AS n FROM steps UNION ALL SELECT *, 'good', good FROM steps UNION ALL SELECT *, 'none', pages - bad - good FROM steps)
  WHERE n > 0 GROUP BY ALL),
branches AS (SELECT host, i, above, name, sum(n)::BIGINT AS branch FROM seen GROUP BY ALL),
nodes AS (SELECT host, i, above, count(*) AS children, sum(branch)::BIGINT AS node FROM branches GROUP BY ALL),
profile AS (SELECT host, i, above, below, label, sum(n)::BIGINT AS pooled FROM seen GROUP BY ALL),
kinds AS (SELECT host, i, above, count(*) - 1 AS freedom FROM profile GROUP BY ALL),
spread AS (
  SELECT host, i, above, name, sum((n * n)::DOUBLE / pooled) AS squares FROM seen JOIN profile USING (host, i, above, below, label) GROUP BY ALL),
decided AS (
  SELECT host, i, above, name, CASE
    WHEN children >= {_U.MANY_CHILDREN} AND node < {_U.FEW_PAGES} * children THEN '*'
    WHEN children > 1 AND (branch < {_U.LEAST_PAGES} OR squares * node / branch - branch <= freedom + {_U.ALIKE} * sqrt(2.0 * freedom)) THEN '~'
    ELSE name END AS token
  FROM branches JOIN nodes USING (host, i, above) JOIN kinds USING (host, i, above) JOIN spread USING (host, i, above, name)),
named AS (
  SELECT host, shape, string_agg(token, '/' ORDER BY i) AS template FROM steps JOIN decided USING (host, i, above, name) GROUP BY ALL),
judged AS (
  SELECT host, template, (sum(bad)::DOUBLE + {_U.PRIOR_PAGES} * any_value(p)) / (sum(bad + good)::DOUBLE + {_U.PRIOR_PAGES}) AS purity,
         sum(bad) > 0 AND sum(bad)::DOUBLE >= {_U.REJECT} * sum(bad + good)::DOUBLE AS own
  FROM counts JOIN named USING (host, shape) CROSS JOIN prior GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN own AND purity >= {_U.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM rows_ JOIN named USING (host, shape) JOIN judged USING (host, template)
""",
    "op2_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {substring_dedup.WINDOW - 1}], ' ')) AS k
        FROM w, unnest(range(1, len(ws) - {substring_dedup.WINDOW - 2})) AS t(i)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN least USING (k), unnest(range(0, {substring_dedup.WINDOW})) AS t(j) WHERE m < doc_id),
flat AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM flat ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op9_mixing": rf"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes GROUP BY source),
weighed AS (SELECT *, {list(mixing.WEIGHTS)}[(rank - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER () - {mixing.MOST_REPEATS} * coalesce(sum(source_size) OVER (filled ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (filled ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW filled AS (ORDER BY ({mixing.MOST_REPEATS} * source_size)::DOUBLE / weight, rank)),
targets AS (SELECT source, source_size, least(({mixing.MOST_REPEATS} * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
rates AS (
  SELECT doc_id, size, sizes.source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS rate
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source),
draws AS (
  SELECT *, (size * (floor(rate)::BIGINT + CASE WHEN
    ('0x' || md5('{mixing.SEED}:' || k || ':' || coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate)
    THEN 1 ELSE 0 END))::BIGINT AS taken FROM rates, range({mixing.DRAWS}) AS t(k)),
chosen AS (
  SELECT source, k FROM (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY abs(sum(taken)::BIGINT - max(target)), k) AS n
    FROM draws GROUP BY source, k) WHERE n = 1)
SELECT doc_id, size, source_size, target, taken FROM draws JOIN chosen ON draws.k = chosen.k AND draws.source IS NOT DISTINCT FROM chosen.source
""",
}
