"""Search hits, fetched pages and evidence snapshots on ``pages`` (and dates on ``orders``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.catalog import sql as S
from tracewell.catalog.registry import query
from tracewell.functions import dates as D
from tracewell.functions import pages as P
from tracewell.functions import text as T
from tracewell.functions import urls as U
from tracewell.operators import discovery, evidence
from tracewell.session import new_folder
from tracewell.sources import fetched as fetched_source
from tracewell.sources import hits as hits_source

AS_OF = 2026

# ---------------------------------------------------------------- inputs: ten pages are one claim's hits


def pages(t) -> DataFrame:
    return t.pages.select(
        "page_id", "url", "html", F.expr("page_id div 10").alias("claim_id"),
        F.regexp_extract("html", "(?i)<title>([^<]*)</title>", 1).alias("page_title"))


def claims(t) -> DataFrame:
    """The title of a block's first page is the claim its pages were found for."""
    return pages(t).groupBy("claim_id").agg(F.min_by("page_title", "page_id").alias("claim"))


def _tracked(url: Column) -> Column:
    bare = F.regexp_replace(url, "#.*$", "")
    return F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit("utm_medium=q1#x"))


def responses(t) -> DataFrame:
    """Two queries per claim return the same pages; even claims in one dialect, odd in the other."""
    hit = lambda q: F.struct(
        F.lit(q).alias("q"), (F.col("page_id") % 10).alias("n"),
        F.col("page_title") if q == 0 else F.concat(F.lit("Copy of "), F.col("page_title")),
        (F.col("url") if q == 0 else _tracked(F.col("url"))).alias("url"),
        F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("Desk "), (F.col("page_id") % 7).cast("string"))).alias("publisher"),
        F.concat(F.lit("2024-01-0"), (F.col("page_id") % 9 + 1).cast("string")).alias("date"),
        F.when(F.col("page_id") % 4 != q, F.concat_ws("-", F.lit("r"), "page_id", F.lit(str(q)))).alias("id"),
        F.when(F.col("page_id") % 7 != 0, ((F.col("page_id") * 37 + q * 53) % 100) / F.lit(100.0)).alias("score"),
    )
    rows = pages(t).select("claim_id", F.explode(F.array(*[hit(q).cast(_HIT) for q in (0, 1)])).alias("_h"))
    listed = rows.groupBy("claim_id", F.col("_h.q").cast("int").alias("query_ord")).agg(
        F.array_sort(F.collect_list("_h")).alias("_all"))
    about = lambda r: F.concat(F.lit("About "), r["title"])
    brave = F.transform("_all", lambda r: F.struct(
        r["title"].alias("title"), r["url"].alias("url"), about(r).alias("description"), r["date"].alias("age"),
        r["id"].alias("id"), r["score"].alias("score"), F.struct(r["publisher"].alias("long_name")).alias("profile")))
    tavily = F.transform("_all", lambda r: F.struct(
        r["title"].alias("title"), r["url"].alias("url"), about(r).alias("content"), r["date"].alias("published_date"),
        r["id"].alias("id"), r["score"].alias("score")))
    even = F.col("claim_id") % 2 == 0
    return listed.select(
        "claim_id", F.concat(F.lit("q"), F.col("query_ord").cast("string")).alias("query"), "query_ord",
        F.when(even, "brave").otherwise("tavily").alias("provider"),
        F.struct(F.when(even, brave).alias("results")).alias("web"), F.when(~even, tavily).alias("results"))


_HIT = (
    "struct<q: int, n: bigint, title: string, url: string, publisher: string, date: string, id: string, score: double>")


def hits(t) -> DataFrame:
    return hits_source.normalize_hits(hits_source.explode_results(responses(t)), per_query=10)


def ranked(t) -> DataFrame:
    return discovery.rank_hits(discovery.scored_hits(discovery.merge_hits(hits(t)), claims(t)))


def selected(t) -> DataFrame:
    return discovery.select_sources(ranked(t))


_BARRIERS = (
    # every seventeenth page is replaced by one of these
    "<html><title>Check</title><body><div class=\"g-recaptcha\"></div>Please complete the captcha</body></html>",
    "<html><title>Just a moment...</title><body>Checking your browser. Cloudflare</body></html>",
    "<html><title>Hello</title><body>We detected unusual traffic from your network</body></html>",
    "<html><title>Access Denied</title><body>no</body></html>",
    "<html><title>Sign in</title><body>members</body></html>",
    "<html><title>Before you continue</title><body>cookies</body></html>",
    "<html><title>404</title><body>gone</body></html>",
    "<html><title>App</title><body><div id=\"root\"></div><script>x()</script></body></html>",
)


def fetched(t) -> DataFrame:
    """The pages as fetches: some refused, cut, moved, of another type or behind a barrier."""
    number = F.col("page_id")
    barrier = F.element_at(F.array(*[F.lit(b) for b in _BARRIERS]), ((number / 17).cast("int") % 8 + 1).cast("int"))
    raw = pages(t).select(
        "page_id", U.normal_url(F.col("url")).alias("url"), U.normal_url(F.col("url")).alias("final_url"),
        F.when(number % 23 == 5, 403).when(number % 23 == 6, 500).when(number % 23 == 7, 301).otherwise(200).alias("http_status"),
        F.when(number % 19 == 3, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"),
        F.when(number % 17 == 0, barrier).otherwise(F.col("html")).alias("html"),
        (number % 9 == 4).alias("truncated"), F.when(number % 29 == 8, "timeout").alias("fetch_error"))
    return fetched_source.classify_fetches(raw)


def acquired(t) -> DataFrame:
    return evidence.acquire(selected(t).join(claims(t), "claim_id"), evidence.page_facts(fetched(t), AS_OF))


def snapshots(t) -> DataFrame:
    return evidence.snapshots(acquired(t), AS_OF)


_PAGES = """
p AS MATERIALIZED (SELECT page_id, url, html, page_id // 10 AS claim_id, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS page_title FROM pages),
claims AS MATERIALIZED (SELECT claim_id, arg_min(page_title, page_id) AS claim FROM p GROUP BY claim_id)
"""
_HITS = f"""{_PAGES},
tracked AS (SELECT *, regexp_replace(url, '#.*$', '') AS bare FROM p),
hits AS MATERIALIZED (
  SELECT claim_id, q AS query_ord, 'q' || q AS query, page_id % 10 AS hit_ord,
    {S.clean("CASE WHEN q = 0 THEN page_title ELSE 'Copy of ' || page_title END")} AS title,
    CASE WHEN q = 0 THEN url ELSE bare || CASE WHEN contains(bare, '?') THEN '&' ELSE '?' END || 'utm_medium=q1#x' END AS url,
    {S.clean("'About ' || CASE WHEN q = 0 THEN page_title ELSE 'Copy of ' || page_title END")} AS description,
    CASE WHEN claim_id % 2 = 0 AND page_id % 3 <> 0 THEN 'Desk ' || (page_id % 7) END AS publisher,
    '2024-01-0' || (page_id % 9 + 1) AS published_date,
    CASE WHEN page_id % 4 <> q THEN 'r-' || page_id || '-' || q END AS provider_result_id,
    CASE WHEN page_id % 7 <> 0 THEN ((page_id * 37 + q * 53) % 100) / 100e0 END AS provider_score,
    lower(regexp_extract(url, '//([^/?#:]+)', 1)) AS domain
  FROM tracked, (VALUES (0), (1)) AS two(q))
"""
_MERGED = f"""{_HITS},
keyed AS MATERIALIZED (SELECT *, {S.url_key('url')} AS key, coalesce(provider_score, -1e0) AS s FROM hits),
marked AS (SELECT *, coalesce(s > max(s) OVER (PARTITION BY claim_id, key ORDER BY query_ord, hit_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS record FROM keyed),
merged AS MATERIALIZED (
  SELECT claim_id, key, arg_min({{'url': url, 'publisher': publisher, 'domain': domain}}, query_ord * 100 + hit_ord) AS f,
    arg_max({{'title': title, 'description': description, 'score': provider_score}}, s * 100000 - query_ord * 100 - hit_ord) AS b,
    arg_max(provider_result_id, query_ord * 100 + hit_ord) FILTER (record AND provider_result_id IS NOT NULL) AS provider_result_id,
    arg_max(published_date, query_ord * 100 + hit_ord) FILTER (record AND published_date IS NOT NULL) AS published_date,
    string_agg(DISTINCT query, '|' ORDER BY query) AS queries, min(query_ord * 100 + hit_ord) AS seen
  FROM marked GROUP BY claim_id, key),
sources AS MATERIALIZED (
  SELECT claim_id, key, f.url AS url, f.publisher AS publisher, f.domain AS domain, b.title AS title, b.description AS description,
    b.score AS provider_score, provider_result_id, published_date, queries,
    row_number() OVER (PARTITION BY claim_id ORDER BY seen) - 1 AS idx FROM merged)
"""
_RANKED = f"""{_MERGED},
st AS MATERIALIZED (SELECT *, {S.rank_terms('claim')} AS ct, {S.rank_terms("title || chr(10) || description")} AS dt,
  lower({S.squeeze('claim')}) AS phrase, lower(title || chr(10) || description) AS low FROM sources JOIN claims USING (claim_id)),
lexed AS MATERIALIZED (SELECT *, {S.overlap_relevance('ct', 'dt', 'phrase', 'low')} AS lexical FROM st),
scored AS MATERIALIZED (SELECT *, CASE WHEN provider_score IS NULL THEN lexical ELSE {S.clamp('lexical * 0.72e0 + provider_score * 0.28e0')} END AS relevance FROM lexed),
one AS (SELECT *, row_number() OVER (PARTITION BY claim_id, key ORDER BY relevance DESC, idx) AS n FROM scored),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY relevance DESC, idx, key) AS rank FROM one WHERE n = 1),
varied AS (SELECT *, row_number() OVER (PARTITION BY claim_id, lower(domain) ORDER BY rank) AS in_domain FROM ranked WHERE rank <= 12),
selected AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY rank) AS place FROM varied WHERE in_domain <= 2) WHERE place <= 6)
"""
_FETCHED = f"""
raw AS (SELECT page_id, url,
  CASE page_id % 23 WHEN 5 THEN 403 WHEN 6 THEN 500 WHEN 7 THEN 301 ELSE 200 END AS http_status,
  CASE WHEN page_id % 19 = 3 THEN 'application/pdf' ELSE 'text/html' END AS media,
  CASE WHEN page_id % 17 = 0 THEN {S.strings(_BARRIERS)}[(page_id // 17) % 8 + 1] ELSE html END AS html,
  page_id % 9 = 4 AS truncated, page_id % 29 = 8 AS failed FROM pages),
looked AS MATERIALIZED (SELECT *, {S.page_text('html')} AS t, {S.page_text("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS ti,
  length({S.page_text("coalesce(" + S.element('html', 'body') + ", html)")}) AS bs,
  length({S.page_text("coalesce(" + S.element('html', 'article') + ", " + S.element('html', 'main') + ", '')")}) AS az FROM raw),
judged AS MATERIALIZED (SELECT *, {S.integrity('html')} AS integrity FROM looked),
fetched AS MATERIALIZED (SELECT page_id, url, html, integrity,
  CASE WHEN failed THEN 'failed' WHEN http_status = 301 THEN 'failed' WHEN http_status = 403 THEN 'blocked' WHEN http_status = 500 THEN 'failed'
    WHEN media <> 'text/html' THEN 'unsupported' WHEN integrity IN ('error_page', 'empty_application_shell') THEN 'failed'
    WHEN integrity <> 'content' THEN 'blocked' WHEN truncated THEN 'partial' ELSE 'acquired' END AS status FROM judged)
"""
_SNAP_HEAD = f"""{_RANKED}, {_FETCHED},
joined AS MATERIALIZED (SELECT s.claim_id, s.idx, s.url, s.title AS hit_title, s.domain, s.claim, s.publisher, s.published_date, s.queries, s.provider_score,
    s.relevance AS retrieval_relevance, coalesce(f.status, 'not_attempted') AS status,
    coalesce(f.status, '') IN ('acquired', 'partial') AS usable,
    CASE WHEN coalesce(f.status, '') IN ('acquired', 'partial') THEN f.html ELSE '' END AS html,
    'src_' || sha256({S.url_key('s.url')})[:16] AS source_id
  FROM selected s LEFT JOIN fetched f ON f.url = s.url),
texts AS MATERIALIZED (SELECT *, CASE WHEN usable THEN {S.readable('html')} ELSE '' END AS body,
  coalesce({S.clean_lines(S.decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, hit_title) AS title,
  regexp_matches(html, '(?i)<article\\b') AS article_like, claim_id || '/' || source_id AS sid FROM joined),
{S.passages('texts', 'sid', 'body')},
asked AS (SELECT sid, source_id, {S.letter_terms('claim')} AS ct, lower({S.squeeze('claim')}) AS phrase FROM texts),
pscored AS (
  SELECT sid, source_id, ord, passage, {S.passage_kind('passage')} AS kind, {S.overlap_relevance('ct', 'pt', 'phrase', 'lower(passage)')} AS relevance
  FROM (SELECT *, {S.letter_terms('passage')} AS pt FROM passages JOIN asked USING (sid))),
pranked AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY relevance DESC, ord) AS n FROM pscored WHERE relevance > 0 OR ord = 0 OR kind <> 'claim'),
kept_p AS MATERIALIZED (SELECT sid, n + 1 AS place, passage, kind, relevance, 'ev_' || sha256(source_id || chr(0) || passage)[:16] AS passage_id FROM pranked WHERE n <= 5),
best_p AS (SELECT sid, max(relevance) AS evidence, count(*) AS passages FROM kept_p GROUP BY sid),
ctext AS MATERIALIZED (SELECT *, {S.letter_terms('claim')} AS ct, {S.letter_terms("title || chr(10) || body")} AS dt,
  lower({S.squeeze('claim')}) AS phrase, lower(title || chr(10) || body) AS low FROM texts),
snaps AS MATERIALIZED (SELECT claim_id, source_id, sid, idx, url, left(title, 300) AS title, domain, status, usable, length(body) AS text_size, queries, provider_score, retrieval_relevance,
  {S.source_type('domain', 'left(title, 300)', 'article_like')} AS source_type,
  CASE WHEN usable THEN {S.overlap_relevance('ct', 'dt', 'phrase', 'low')} END AS claim_relevance,
  CASE WHEN usable THEN coalesce(evidence, 0e0) END AS evidence_relevance,
  CASE WHEN usable THEN coalesce(passages, 0) + 1 ELSE 0 END AS passages,
  CASE status WHEN 'acquired' THEN CASE WHEN length(body) >= 1000 THEN 0.82e0 WHEN length(body) >= 200 THEN 0.68e0 ELSE 0.45e0 END
    WHEN 'partial' THEN CASE WHEN length(body) >= 500 THEN 0.62e0 ELSE 0.42e0 END ELSE 0e0 END AS extraction_confidence
  FROM ctext LEFT JOIN best_p USING (sid))
"""

# ---------------------------------------------------------------- URLs


@query("b07_url_key", f"SELECT page_id, {S.url_key('url')} AS key FROM pages")
def b07(t):
    return t.pages.select("page_id", U.url_key(F.col("url")).alias("key"))


_POLICY_URLS = """
urls AS (
  SELECT 'p' || page_id AS id, url FROM pages
  UNION ALL SELECT 'e' || event_id, CASE event_id % 6
    WHEN 0 THEN 'http://' || (event_id % 256) || '.' || (event_id * 7 % 256) || '.' || (event_id * 13 % 256) || '.' || (event_id * 31 % 256) || '/x'
    WHEN 1 THEN 'http://user' || user_id || ':pw@' || event_type || '.example.org/' WHEN 2 THEN 'https://' || event_type || '.internal/'
    WHEN 3 THEN 'https://' || event_type || '.example.org:8443/' WHEN 4 THEN 'ftp://' || event_type || '.example.org/' ELSE event_type END FROM events),
parsed AS (SELECT *, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS authority FROM urls),
named AS (SELECT *, regexp_extract(regexp_replace(authority, '^.*@', ''), '^[^:]*') AS host, regexp_extract(authority, ':([0-9]+)$', 1) AS port FROM parsed),
numbered AS (SELECT *, CASE WHEN regexp_matches(host, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') THEN
  split_part(host, '.', 1)::BIGINT * 16777216 + split_part(host, '.', 2)::BIGINT * 65536 + split_part(host, '.', 3)::BIGINT * 256 + split_part(host, '.', 4)::BIGINT END AS ip FROM named)
"""


def _cidr(network: str, prefix: int) -> str:
    low, high = U._reserved_range(network, prefix)
    return f"({low}, {high})"


@query("b08_url_policy", f"""WITH {_POLICY_URLS},
reserved(lo, hi) AS (VALUES {', '.join(_cidr(*r) for r in K.RESERVED_IPV4)})
SELECT id, CASE WHEN scheme = '' THEN 'invalid' WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN contains(authority, '@') THEN 'credentials'
  WHEN host LIKE '%.internal' THEN 'local_host' WHEN port <> '' THEN 'port'
  WHEN EXISTS (SELECT 1 FROM reserved WHERE ip BETWEEN lo AND hi) THEN 'private_address' ELSE 'allowed' END AS policy FROM numbered""")
def b08(t):
    n, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id").cast("string")
    octet = lambda k: (n * k % 256).cast("string")
    made = (
        F.when(n % 6 == 0, F.concat(F.lit("http://"), F.concat_ws(".", octet(1), octet(7), octet(13), octet(31)), F.lit("/x")))
        .when(n % 6 == 1, F.concat(F.lit("http://user"), user, F.lit(":pw@"), kind, F.lit(".example.org/")))
        .when(n % 6 == 2, F.concat(F.lit("https://"), kind, F.lit(".internal/")))
        .when(n % 6 == 3, F.concat(F.lit("https://"), kind, F.lit(".example.org:8443/")))
        .when(n % 6 == 4, F.concat(F.lit("ftp://"), kind, F.lit(".example.org/"))).otherwise(kind))
    urls = t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "url").unionByName(
        t.events.select(F.concat(F.lit("e"), n.cast("string")).alias("id"), made.alias("url")))
    return urls.select("id", F.coalesce(U.url_policy(F.col("url")), F.lit("allowed")).alias("policy"))


# ---------------------------------------------------------------- hits

@query("a03_ingest_hits", f"WITH {_HITS} SELECT claim_id, query_ord, hit_ord, query, title, url, description, publisher, published_date, provider_result_id, provider_score, domain FROM hits")
def a03(t):
    """Responses stored as JSON, one object per query, read back and normalized."""
    folder = new_folder(t.spark, "responses")
    responses(t).write.json(folder)
    read = hits_source.normalize_hits(hits_source.explode_results(hits_source.read_search_results(t.spark, folder)), per_query=10)
    return read.withColumns({c: F.col(c).cast("bigint") for c in ("claim_id", "query_ord", "hit_ord")})


@query("a11_search_evidence_ids", f"""WITH {_HITS}
SELECT claim_id, query_ord, hit_ord, 'search:web:' || coalesce(provider_result_id, sha256(url)[:24]) AS evidence_id,
  'submission:text:' || sha256(claim)[:24] AS claim_evidence_id FROM hits JOIN claims USING (claim_id)""")
def a11(t):
    leads = discovery.search_evidence_ids(hits(t), "web").select(
        "claim_id", F.col("query_ord").cast("bigint"), F.col("hit_ord").cast("bigint"), "evidence_id")
    told = claims(t).select("claim_id", discovery.claim_evidence_id(F.col("claim")).alias("claim_evidence_id"))
    return leads.join(told, "claim_id")


@query("d03_merge_hits", f"""WITH {_MERGED}
SELECT claim_id, key, url, publisher, domain, title, description, provider_score, provider_result_id, published_date, queries, idx FROM sources""")
def d03(t):
    return discovery.merge_hits(hits(t)).select(
        "claim_id", "key", "url", "publisher", "domain", "title", "description", "provider_score", "provider_result_id",
        "published_date", F.array_join("discovered_by_queries", "|").alias("queries"), F.col("idx").cast("bigint"))


@query("d04_dedup_ranked_hits", f"WITH {_RANKED} SELECT claim_id, key, idx, round(relevance, 6) AS relevance FROM one WHERE n = 1")
def d04(t):
    scored = discovery.scored_hits(discovery.merge_hits(hits(t)), claims(t))
    return discovery.deduplicate_hits(scored).select(
        "claim_id", "key", F.col("idx").cast("bigint"), F.round("retrieval_relevance", 6).alias("relevance"))


@query("e01_rank_hits", f"WITH {_RANKED} SELECT claim_id, key, rank, round(relevance, 6) AS relevance FROM ranked WHERE rank <= 12")
def e01(t):
    return ranked(t).select(
        "claim_id", "key", F.col("rank").cast("bigint"), F.round("retrieval_relevance", 6).alias("relevance"))


@query("e02_domain_cap", f"WITH {_RANKED} SELECT claim_id, key, domain, rank, place AS selected FROM selected")
def e02(t):
    return selected(t).select(
        "claim_id", "key", "domain", F.col("rank").cast("bigint"), F.col("selected").cast("bigint"))


# ---------------------------------------------------------------- fetched pages

@query("a04_classify_fetch", f"WITH {_FETCHED} SELECT page_id, status AS acquisition_status, CASE WHEN status IN ('acquired', 'partial') THEN length(html) ELSE 0 END AS html_size FROM fetched")
def a04(t):
    return fetched(t).select("page_id", "acquisition_status", F.length("html").cast("bigint").alias("html_size"))


@query("b09_html_integrity", f"WITH {_FETCHED} SELECT page_id, integrity FROM judged")
def b09(t):
    return fetched(t).select("page_id", "integrity")


@query("b10_readable_text", f"SELECT page_id, {S.readable('html')} AS text FROM pages")
def b10(t):
    return t.pages.select("page_id", P.readable_text(F.col("html")).alias("text"))


def _marked(t) -> DataFrame:
    """Pages with metadata of their own, so that every branch is met."""
    n, number = F.col("page_id"), F.col("page_id").cast("string")
    day = F.concat(F.lit("2023-0"), (n % 9 + 1).cast("string"), F.lit("-1"), (n % 9).cast("string"))
    site = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    link = F.when(n % 4 == 0, F.concat(site, F.lit("/c/"), number)).when(n % 4 == 1, F.concat(F.lit("https://elsewhere.example/"), number)).when(
        n % 4 == 2, F.concat(F.lit("/rel/"), number))
    json = F.concat(F.lit('{"@type":"NewsArticle","headline":"Head '), number, F.lit('","datePublished":"'), day,
                    F.lit('","author":[{"name":"Ann '), number, F.lit('"}]}'))
    ld = (
        F.when(n % 6 == 0, json).when(n % 6 == 1, F.concat(F.lit('{"@graph":[{"@type":"WebPage"},'), json, F.lit("]}")))
        .when(n % 6 == 2, F.concat(F.lit('[{"@type":"VideoObject","uploadDate":"'), day, F.lit('"}]'))))
    tags = F.concat_ws(
        "",
        F.concat(F.lit("<meta property=\"og:site_name\" content=\"Site &amp; "), number, F.lit("\">")),
        F.concat(F.lit("<meta name=author content='By "), number, F.lit("'>")),
        F.when(n % 6 == 3, F.concat(F.lit("<meta property=\"article:published_time\" content=\""), day, F.lit("T10:00:00+02:00\">"))),
        F.when(n % 6 == 4, F.concat(F.lit("<meta itemprop=\"datePublished\" content=\""), day, F.lit("\">"))),
        F.when(n % 6 == 5, F.concat(F.lit("<time class=\"published\" datetime=\""), day, F.lit("\">then</time>"))),
        F.concat(F.lit("<link rel=\"canonical\" href=\""), link, F.lit("\">")),
        F.concat(F.lit("<script type=\"application/ld+json\">"), ld, F.lit("</script>")),
    )
    return t.pages.select("page_id", "url", F.concat(tags, F.col("html")).alias("html"))


@query("b11_meta_entries", """
SELECT page_id, 0 AS pos, 'og:site_name' AS key, 'Site & ' || page_id AS value FROM pages
UNION ALL SELECT page_id, 1, 'author', 'By ' || page_id FROM pages
UNION ALL SELECT page_id, 2, 'article:published_time', '2023-0' || (page_id % 9 + 1) || '-1' || (page_id % 9) || 'T10:00:00+02:00' FROM pages WHERE page_id % 6 = 3
UNION ALL SELECT page_id, 2, 'datepublished', '2023-0' || (page_id % 9 + 1) || '-1' || (page_id % 9) FROM pages WHERE page_id % 6 = 4""")
def b11(t):
    return _marked(t).select("page_id", F.posexplode(P.meta_entries(F.col("html"))).alias("pos", "_e")).select(
        "page_id", F.col("pos").cast("bigint"), "_e.key", "_e.value")


@query("b12_json_ld", """
SELECT page_id, CASE WHEN page_id % 6 < 2 THEN 'Head ' || page_id END AS headline, CASE WHEN page_id % 6 < 2 THEN 'Ann ' || page_id END AS author,
  CASE WHEN page_id % 6 < 2 THEN '2023-0' || (page_id % 9 + 1) || '-1' || (page_id % 9) END AS published,
  CASE WHEN page_id % 6 = 2 THEN '2023-0' || (page_id % 9 + 1) || '-1' || (page_id % 9) END AS uploaded FROM pages""")
def b12(t):
    rows = _marked(t).select("page_id", P.article_object(P.json_ld_objects(F.col("html"))).alias("_a"))
    wanted = ("headline", "author", "datePublished", "uploadDate")
    texts = rows.select("page_id", P.json_scalars(F.col("_a"), wanted).alias("_t"))
    named = ("headline", "author", "published", "uploaded")
    return texts.select("page_id", *[F.get("_t", F.lit(i)).alias(n) for i, n in enumerate(named)])


@query("b13_canonical_url", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^(https?://[^/]+)', 1) || '/c/' || page_id
  WHEN 2 THEN regexp_extract(url, '^(https?://[^/]+)', 1) || '/rel/' || page_id END AS canonical FROM pages""")
def b13(t):
    return _marked(t).select("page_id", P.canonical_url(F.col("html"), F.col("url")).alias("canonical"))


@query("b14_evidence_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 15 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 15 IN (3, 5, 9, 10, 11, 12) THEN strftime(o_orderdate, '%Y-%m-%dT08:30:00.000Z')
  WHEN o_orderkey % 15 = 4 THEN strftime(o_orderdate, '%Y-%m-%dT06:30:00.000Z') WHEN o_orderkey % 15 IN (13, 14) THEN strftime(o_orderdate, '%Y-%m-%dT08:30:07.000Z') END AS normalized FROM orders""")
def b14(t):
    """Order dates in fifteen spellings, three of them unusable."""
    kind = F.col("o_orderkey") % 15
    shown = lambda f: F.date_format("o_orderdate", f)
    raw = (
        F.when(kind == 0, shown("yyyy-MM-dd")).when(kind == 1, shown("MMMM d, yyyy")).when(kind == 2, shown("d MMMM yyyy"))
        .when(kind == 3, shown("yyyy-MM-dd'T08:30:00Z'")).when(kind == 4, shown("yyyy-MM-dd'T08:30:00+02:00'"))
        .when(kind == 5, shown("yyyy-MM-dd' 08:30'")).when(kind == 6, shown("MMMM yyyy")).when(kind == 7, "3 hours ago")
        .when(kind == 9, shown("MMM d, yyyy' 08:30'")).when(kind == 10, shown("MMMM d, yyyy' 08:30'"))
        .when(kind == 11, shown("d MMMM yyyy' 08:30'")).when(kind == 12, shown("EEE, d MMM yyyy' 08:30 UTC'"))
        .when(kind == 13, shown("MMMM d, yyyy' 08:30:07'")).when(kind == 14, shown("d MMM yyyy' 08:30:07 +0000'"))
        .otherwise(F.concat(shown("yyyy"), F.lit("-02-30"))))
    rows = t.orders.select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", D.normalize_evidence_date(F.col("raw"), AS_OF).alias("normalized"))


@query("b15_date_cascade", """
SELECT page_id, CASE WHEN page_id % 6 = 3 THEN '2023-0' || (page_id % 9 + 1) || '-1' || (page_id % 9) || 'T08:00:00.000Z'
    ELSE '2023-0' || (page_id % 9 + 1) || '-1' || (page_id % 9) END AS published,
  CASE WHEN page_id % 6 = 2 THEN 'upload' ELSE 'publication' END AS date_type,
  [0.96e0, 0.96e0, 0.9e0, 0.91e0, 0.84e0, 0.74e0][page_id % 6 + 1] AS confidence,
  ['json_ld', 'json_ld', 'json_ld', 'opengraph', 'html_metadata', 'article_metadata'][page_id % 6 + 1] AS date_source FROM pages""")
def b15(t):
    rows = evidence.page_facts(_marked(t).withColumns({
        "final_url": F.col("url"), "acquisition_status": F.lit("acquired"), "acquisition_error": F.lit(None).cast("string")}), AS_OF, ("page_id",))
    best = rows.select("page_id", F.get("_said_dates", F.lit(0)).alias("_d"))
    return best.select(
        "page_id", F.col("_d.value").alias("published"), F.col("_d.type").alias("date_type"),
        F.col("_d.confidence").alias("confidence"), F.col("_d.source").alias("date_source"))


_DOMAINS = ("cdc.gov", "x.com", "en.wikipedia.org", "arxiv.org", "snopes.com", "emro.who.int", "cs.mit.edu")


@query("b16_source_type", f"""
WITH d AS (SELECT page_id, coalesce({S.strings(_DOMAINS)}[page_id % 9 + 1], regexp_extract(url, '//([^/?#:]+)', 1)) AS domain,
  regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title, html FROM pages)
SELECT page_id, domain, {S.source_type('domain', 'title', "regexp_matches(html, '(?i)<article') AND page_id % 2 = 0")} AS source_type FROM d""")
def b16(t):
    given = F.array(*[F.lit(d) for d in _DOMAINS])
    name = F.coalesce(F.try_element_at(given, (F.col("page_id") % 9 + 1).cast("int")), U.host(F.col("url")))
    rows = pages(t).select("page_id", name.alias("domain"), "page_title", "html")
    like = F.col("html").rlike("(?i)<article") & (F.col("page_id") % 2 == 0)
    return rows.select("page_id", "domain", P.source_type(F.col("domain"), F.col("page_title"), like).alias("source_type"))


@query("b20_extraction_confidence", f"""WITH {_FETCHED},
sized AS (SELECT page_id, status, CASE WHEN status IN ('acquired', 'partial') THEN length({S.readable('html')}) ELSE 0 END AS size FROM fetched)
SELECT page_id, round(least(1e0, CASE status WHEN 'acquired' THEN CASE WHEN size >= 1000 THEN 0.82e0 WHEN size >= 200 THEN 0.68e0 ELSE 0.45e0 END
  WHEN 'partial' THEN CASE WHEN size >= 500 THEN 0.62e0 ELSE 0.42e0 END ELSE 0e0 END
  + CASE WHEN page_id % 2 = 0 THEN 0.06e0 ELSE 0e0 END + CASE WHEN page_id % 3 = 0 THEN 0.04e0 ELSE 0e0 END + CASE WHEN page_id % 5 = 0 THEN 0.03e0 ELSE 0e0 END), 6) AS confidence
FROM sized""")
def b20(t):
    n = F.col("page_id")
    sized = fetched(t).select("page_id", "acquisition_status", F.length(P.readable_text(F.col("html"))).alias("size"))
    return sized.select("page_id", F.round(P.extraction_confidence(
        F.col("acquisition_status"), F.col("size"), n % 2 == 0, n % 3 == 0, n % 5 == 0), 6).alias("confidence"))


# ---------------------------------------------------------------- snapshots

@query("c04_acquire_sources", f"WITH {_SNAP_HEAD} SELECT claim_id, url, status AS acquisition_status, length(html) AS html_size FROM joined")
def c04(t):
    return acquired(t).select("claim_id", "url", "acquisition_status", "html_size")


@query("b21_snapshots", f"""WITH {_SNAP_HEAD}
SELECT claim_id, source_id, idx, title, domain, source_type, status AS acquisition_status, text_size, passages,
  round(claim_relevance, 6) AS claim_relevance, round(evidence_relevance, 6) AS evidence_relevance, round(extraction_confidence, 6) AS extraction_confidence,
  'crawl_index' AS date_type FROM snaps""")
def b21(t):
    return snapshots(t).select(
        "claim_id", "source_id", F.col("idx").cast("bigint"), "title", "domain", "source_type", "acquisition_status",
        F.length("text").cast("bigint").alias("text_size"), F.size("passages").cast("bigint").alias("passages"),
        F.round("claim_relevance", 6).alias("claim_relevance"), F.round("evidence_relevance", 6).alias("evidence_relevance"),
        F.round("extraction_confidence", 6).alias("extraction_confidence"), "date_type")


@query("e06_date_passage", f"""WITH {_SNAP_HEAD},
d AS (SELECT t.claim_id, t.source_id, 1 AS place, 'date' AS kind, 0.25e0 AS relevance,
  'ev_' || sha256(t.source_id || chr(0) || 'date' || chr(0) || 'search-provider date (not publication evidence): ' || t.published_date)[:16] AS passage_id FROM texts t WHERE usable),
k AS (SELECT t.claim_id, t.source_id, k.place, k.kind, k.relevance, k.passage_id FROM kept_p k JOIN texts t USING (sid) WHERE usable)
SELECT claim_id, source_id, place, kind, round(relevance, 6) AS relevance, passage_id FROM (SELECT * FROM d UNION ALL SELECT * FROM k)""")
def e06(t):
    return evidence.passages_of(snapshots(t)).select(
        "claim_id", "source_id", (F.col("ord") + 1).cast("bigint").alias("place"), "kind", F.round("relevance", 6).alias("relevance"),
        "passage_id")


_RANKED_SNAPS = f"""{_SNAP_HEAD},
weighed AS (SELECT *, {S.clamp('CASE WHEN usable THEN evidence_relevance ELSE 0e0 END * 0.68e0 + CASE WHEN usable THEN claim_relevance ELSE 0e0 END * 0.32e0')} AS relevance FROM snaps),
ranked_snaps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY relevance DESC, idx, source_id) AS place FROM weighed)
"""


@query("e04_rank_snapshots", f"WITH {_RANKED_SNAPS} SELECT claim_id, source_id, place AS rank, round(relevance, 6) AS relevance FROM ranked_snaps")
def e04(t):
    return evidence.rank_snapshots(snapshots(t)).select(
        "claim_id", "source_id", F.col("rank").cast("bigint"), F.round("relevance", 6).alias("relevance"))


@query("d15_mean_relevance", f"WITH {_RANKED_SNAPS} SELECT claim_id, round(sum(round(relevance * 1e6)::BIGINT)::DOUBLE / (count(*) * 1e6), 6) AS mean_relevance, count(*) AS sources FROM ranked_snaps WHERE place <= 5 GROUP BY claim_id")
def d15(t):
    return evidence.mean_relevance(evidence.rank_snapshots(snapshots(t))).select(
        "claim_id", F.round("mean_relevance", 6).alias("mean_relevance"), "sources")


def _copies(t) -> DataFrame:
    """Every snapshot twice: the copy came through another query and was read a little worse."""
    snaps = snapshots(t)
    copy = snaps.withColumns({
        "idx": F.col("idx") + 100, "discovered_by_queries": F.array(F.lit("extra")),
        "provider_score": F.when(F.col("idx") % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.0)),
    })
    return snaps.unionByName(copy)


@query("d05_dedup_snapshots", f"""WITH {_SNAP_HEAD},
both_ AS (SELECT claim_id, url, idx, status, extraction_confidence, provider_score, queries FROM snaps
  UNION ALL SELECT claim_id, url, idx + 100, status, extraction_confidence, CASE WHEN idx % 2 = 0 THEN 1e0 ELSE 0e0 END, 'extra' FROM snaps),
q AS (SELECT *, {S.url_key('url')} AS key, CASE status WHEN 'acquired' THEN 3e0 WHEN 'partial' THEN 2e0 ELSE 1e0 END + extraction_confidence + coalesce(provider_score, 0e0) / 10 AS quality FROM both_),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id, key ORDER BY quality DESC, idx) AS n FROM q),
l AS (SELECT claim_id, key, string_agg(queries, '|' ORDER BY idx) AS queries FROM q GROUP BY ALL)
SELECT r.claim_id, r.key, r.idx, l.queries FROM r JOIN l USING (claim_id, key) WHERE n = 1""")
def d05(t):
    kept = evidence.deduplicate_snapshots(_copies(t))
    return kept.select(
        "claim_id", U.url_key(F.col("original_url")).alias("key"), F.col("idx").cast("bigint"),
        F.array_join("discovered_by_queries", "|").alias("queries"))


_COUNTS = """count(*) AS sources, count(*) FILTER (status <> 'not_attempted') AS attempted, count(*) FILTER (status = 'acquired') AS acquired,
  count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'blocked') AS blocked,
  count(*) FILTER (status <> 'not_attempted') > 0 AND count(*) FILTER (status <> 'not_attempted') = count(*) FILTER (status = 'blocked') AS all_blocked"""


@query("d24_acquisition_counts", f"WITH {_SNAP_HEAD} SELECT claim_id, {_COUNTS} FROM joined GROUP BY claim_id")
def d24(t):
    return evidence.acquisition_counts(acquired(t))


@query("d13_all_blocked", f"""WITH {_FETCHED}, x AS (SELECT page_id // 2 AS claim_id, status FROM fetched)
SELECT claim_id, {_COUNTS} FROM x GROUP BY claim_id""")
def d13(t):
    pairs = fetched(t).select(F.expr("page_id div 2").alias("claim_id"), "acquisition_status")
    return evidence.acquisition_counts(pairs)


@query("a08_public_snapshots", f"WITH {_SNAP_HEAD} SELECT claim_id, source_id, title, status AS acquisition_status FROM snaps")
def a08(t):
    return evidence.public(snapshots(t)).select("claim_id", "source_id", "title", "acquisition_status")


@query("c15_evidence_lookup", f"""WITH {_SNAP_HEAD},
refs AS (SELECT DISTINCT t.claim_id, k.passage FROM kept_p k JOIN texts t USING (sid))
SELECT claim_id, 'all' AS item_id, count(DISTINCT passage) AS texts, sum(length(passage)) AS size FROM refs GROUP BY claim_id""")
def c15(t):
    """All passages of a claim looked up again by their ids (date passages left out)."""
    snaps = snapshots(t)
    ids = evidence.passages_of(snaps).filter(F.col("kind") != "date").groupBy("claim_id").agg(
        F.collect_set("passage_id").alias("evidence_ids")).withColumn("item_id", F.lit("all"))
    texts = evidence.evidence_texts(ids, snaps)
    return texts.select(
        "claim_id", "item_id", F.size("texts").cast("bigint").alias("texts"),
        F.aggregate("texts", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("size"))
