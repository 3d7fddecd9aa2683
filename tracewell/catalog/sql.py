"""Fragments for the comparison SQL (DuckDB): the same rules, written for another engine."""

from __future__ import annotations

from tracewell import constants as K
from tracewell.functions.patterns import CONTROL, SPACE, SPACE_SET


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def members(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def re2(pattern: str, ignore_case: bool = False) -> str:
    out = pattern.replace(r"\S", f"[^{SPACE_SET}]").replace(r"\s", SPACE).replace(r"[\x{0}-\x{10FFFF}]", "(?s:.)")
    return text("(?i)" + out if ignore_case else out)


def replaced(x: str, pattern: str, by: str, ignore_case: bool = False) -> str:
    return f"regexp_replace({x}, {re2(pattern, ignore_case)}, {text(by)}, 'g')"


def found(x: str, pattern: str, ignore_case: bool = True) -> str:
    return f"regexp_matches({x}, {re2(pattern, ignore_case)})"


def squeeze(x: str) -> str:
    return f"trim({replaced(x, SPACE + '+', ' ')})"


def clean(x: str) -> str:
    return squeeze(replaced(x, CONTROL, " "))


def strip(x: str) -> str:
    return replaced(x, rf"^{SPACE}+|{SPACE}+\z", "")


def captured(x: str, pattern: str, ignore_case: bool = True, group: int = 1) -> str:
    return f"nullif({squeeze(f'regexp_extract({x}, {re2(pattern, ignore_case)}, {group})')}, '')"


def first_captured(x: str, patterns) -> str:
    return "coalesce(" + ", ".join(captured(x, p) for p in patterns) + ")"


def first_label(x: str, rules, ignore_case: bool = True) -> str:
    return "CASE " + " ".join(f"WHEN {found(x, p, ignore_case)} THEN {text(label)}" for label, p in rules) + " END"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def round3(x: str) -> str:
    return f"floor(greatest(0e0, least(1e0, {x})) * 1000e0 + 0.5e0) / 1000e0"


def clamp(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def mean3(x: str, when: str | None = None) -> str:
    only = f" FILTER ({when})" if when else ""
    return f"floor(sum(round({x} * 1e6)::BIGINT){only}::DOUBLE / (count({x}){only} * 1000) + 0.5e0) / 1000e0"


def match_terms(x: str) -> str:
    stop = members(K.MATCH_STOPWORDS)
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN {stop}))"


def letter_terms(x: str, lowered: bool = True) -> str:
    stop = members(K.RANK_STOPWORDS)
    value = f"lower({x})" if lowered else x
    return f"list_distinct(list_filter(string_split_regex({value}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1 AND w NOT IN {stop}))"


def rank_terms(x: str) -> str:
    return letter_terms(f"nfc_normalize(lower({x}))", lowered=False)


def compare_key(x: str) -> str:
    return f"regexp_replace(lower({squeeze(x)}), '[^\\p{{L}}\\p{{N}} ]', '', 'g')"


def compare_terms(x: str) -> str:
    stop = members(K.COMPARE_STOPWORDS)
    return f"list_distinct(list_filter(string_split_regex({compare_key(x)}, ' +'), lambda w: length(w) > 1 AND w NOT IN {stop}))"


def dice_of(a: str, b: str) -> str:
    return (
        f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN 2e0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) ELSE 0e0 END)"
    )


def keyed_dice(ka: str, ta: str, kb: str, tb: str) -> str:
    return (
        f"(CASE WHEN len({ta}) > 0 AND len({tb}) > 0 THEN 2e0 * len(list_intersect({ta}, {tb})) / (len({ta}) + len({tb})) "
        f"WHEN {ka} = {kb} THEN 1e0 ELSE 0e0 END)"
    )


def semantically_equal(a: str, b: str) -> str:
    return f"({compare_key(a)} = {compare_key(b)} OR {keyed_dice(compare_key(a), compare_terms(a), compare_key(b), compare_terms(b))} >= 0.86e0)"


def extract_claim(x: str) -> str:
    """Sentence ends are marked with a line feed (squeezed text has none), then split."""
    cleaned = squeeze(replaced(replaced(x, K.URL_IN_TEXT, " "), K.EMOJI, " "))
    parts = f"list_filter(string_split(regexp_replace({cleaned}, '([.!?]) +', '\\1' || chr(10), 'g'), chr(10)), lambda s: regexp_matches(s, '[a-zA-Z]'))"
    return (
        f"coalesce(list_max(list_transform({parts}, lambda s, i: {{'size': length(s), 'earliest': -i, 'text': s}}))['text'], {cleaned})"
    )


def negated_terms(x: str) -> str:
    skip = members(K.MATCH_STOPWORDS + K.NEGATION_WORDS + K.NEGATION_MODIFIERS)
    words = (
        f"list_filter(string_split_regex({replaced(f'lower({x})', K.CONTRACTION, ' not ')}, '[^a-z0-9]+'), lambda w: w <> '')"
    )
    return (
        f"(SELECT list_distinct(list_filter(list_transform(range(1, len(ws) + 1), lambda i: CASE "
        f"WHEN ws[i] IN {members(K.NEGATION_WORDS)} AND (i = 1 OR ws[i - 1] <> 'do') "
        f"THEN list_filter(ws[i + 1:], lambda v: length(v) > 1 AND v NOT IN {skip})[1] END), lambda t: t IS NOT NULL)) "
        f"FROM (SELECT {words} AS ws))"
    )


def overlap_relevance(ct: str, dt: str, phrase: str, low: str) -> str:
    inter = f"len(list_intersect({ct}, {dt}))::DOUBLE"
    union = f"(len({ct}) + len({dt}) - {inter})"
    bonus = f"CASE WHEN length({phrase}) >= 12 AND contains({low}, {phrase}) THEN 0.12e0 ELSE 0e0 END"
    score = f"{inter} / len({ct}) * 0.72e0 + {inter} / {union} * 0.16e0 + {bonus}"
    return f"(CASE WHEN len({ct}) > 0 AND len({dt}) > 0 THEN {clamp(score)} ELSE 0e0 END)"


def url_parts(x: str) -> str:
    """Named parts of a URL, from plain string positions."""
    u = strip(x)
    rest = f"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*:/*(.*)$', 1)"
    authority = f"regexp_extract({rest}, '^[^/?#]*')"
    host_port = f"regexp_replace({authority}, '^.*@', '')"
    return (
        f"{{'scheme': lower(regexp_extract({u}, '^([a-zA-Z]+):', 1)), 'who': regexp_extract({authority}, '^(.*)@', 1), "
        f"'host': lower(regexp_extract({host_port}, '^(\\[[^\\]]*\\]|[^:]*)', 1)), "
        f"'port': regexp_extract({host_port}, ':([0-9]+)$', 1), "
        f"'path': CASE WHEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) END, "
        f"'query': regexp_extract({rest}, '^[^?#]*(\\?[^#]*)', 1)}}"
    )


def url_key(x: str) -> str:
    """For http(s) URLs of plain ASCII on standard ports, as the test tables have them."""
    tracked = members(K.TRACKING_PARAMETERS)
    is_tracked = f"(lower(split_part(q, '=', 1)) LIKE 'utm\\_%' ESCAPE '\\' OR lower(split_part(q, '=', 1)) IN {tracked})"
    return (
        f"(SELECT p.scheme || '://' || p.host || CASE WHEN regexp_replace(p.path, '/+$', '') = '' THEN '/' "
        f"ELSE regexp_replace(p.path, '/+$', '') END || CASE WHEN p.query = '' THEN '' "
        f"WHEN len(list_filter(string_split(p.query[2:], '&'), lambda q: {is_tracked})) = 0 THEN p.query "
        f"WHEN len(list_filter(string_split(p.query[2:], '&'), lambda q: NOT {is_tracked} AND q <> '')) = 0 THEN '' "
        f"ELSE '?' || array_to_string(list_filter(string_split(p.query[2:], '&'), lambda q: NOT {is_tracked} AND q <> ''), '&') END "
        f"FROM (SELECT {url_parts(x)} AS p))"
    )


def passage_kind(x: str) -> str:
    return f"coalesce({first_label(x, K.PASSAGE_KIND)}, 'claim')"


def passages(source: str, key: str, body: str) -> str:
    """Common table expressions ending in ``passages(key, ord, passage)``."""
    return f"""
lines AS (SELECT {key}, i AS line_no, {strip('l')} AS line FROM (
  SELECT {key}, unnest(string_split_regex({body}, '\\n+')) AS l, generate_subscripts(string_split_regex({body}, '\\n+'), 1) AS i FROM {source})),
kept AS (SELECT * FROM lines WHERE length(line) >= 40),
parts AS (
  SELECT {key}, line_no, 1 AS part, 0 AS piece, line AS passage FROM kept WHERE length(line) <= 1200
  UNION ALL
  SELECT {key}, line_no, part, piece, p[piece * 1200 + 1:piece * 1200 + 1200] FROM (
    SELECT *, unnest(range(0, (length(p) - 1) // 1200 + 1)) AS piece FROM (
    SELECT {key}, line_no, {strip('s')} AS p, part FROM (
      SELECT {key}, line_no, unnest(ss) AS s, generate_subscripts(ss, 1) AS part FROM (
        SELECT {key}, line_no, string_split(regexp_replace(line, '([.!?]){SPACE}+', '\\1' || chr(10), 'g'), chr(10)) AS ss
        FROM kept WHERE length(line) > 1200))) WHERE length(p) >= 40)),
passages AS MATERIALIZED (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY line_no, part, piece) - 1 AS ord, passage FROM parts)
"""


def without_elements(x: str, names) -> str:
    out = x
    for name in names:
        out = f"regexp_replace({out}, '(?is)<{name}\\b[^>]*>.*?</{name}\\s*>', ' ', 'g')"
    return out


HIDDEN = ("script", "style", "noscript", "svg", "canvas")
NOISE = HIDDEN + ("form", "nav", "footer", "aside")


def element(x: str, name: str) -> str:
    return f"nullif(regexp_extract({x}, '(?is)<{name}\\b[^>]*>.*?</{name}\\s*>'), '')"


def no_comments(x: str) -> str:
    return f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"


def no_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def decoded(x: str) -> str:
    out = x
    for name, char in K.NAMED_ENTITIES.items():
        out = f"regexp_replace({out}, '(?i)&{name};', {text(char)}, 'g')"
    return f"regexp_replace({out}, '(?i)&(?:amp|#38);', '&', 'g')"


def clean_lines(x: str) -> str:
    soft = f"regexp_replace({x}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g')"
    spaced = f"regexp_replace({soft}, '[ \\t]+', ' ', 'g')"
    joined = f"regexp_replace({spaced}, '{SPACE}*\\n{SPACE}*', chr(10), 'g')"
    return f"nullif({strip(joined)}, '')"


def readable(x: str) -> str:
    body = f"coalesce({element(x, 'article')}, {element(x, 'main')}, {element(x, 'body')}, {x})"
    bare = without_elements(no_comments(body), NOISE)
    blocks = f"regexp_replace({bare}, '(?i)<(?:br|/p|/div|/li|/h[1-6]|/section|/article)>', chr(10), 'g')"
    return f"coalesce({clean_lines(decoded(no_tags(blocks)))}, '')"


def page_text(x: str) -> str:
    bare = no_tags(without_elements(no_comments(x), HIDDEN))
    spaced = f"regexp_replace({bare}, '(?i)&(?:nbsp|#160);', ' ', 'g')"
    return squeeze(f"regexp_replace({spaced}, '(?i)&(?:amp|#38);', '&', 'g')")


def integrity(html: str) -> str:
    """A barrier kind; needs columns ``t`` (text), ``ti`` (title), ``bs`` and ``az`` (sizes)."""
    m = lambda x, p: found(x, p)
    return f"""CASE
 WHEN (az < 300 AND length(t) < 3000 AND {m(html, K.CAPTCHA_MARKUP)}) OR (az < 300 AND {m('t', K.CAPTCHA_TEXT)}) THEN 'captcha'
 WHEN {m(html, K.CHALLENGE_MARKUP)} OR ({m('ti', K.CHALLENGE_TITLE)} AND {m(html, K.CHALLENGE_VENDOR)}) THEN 'cloudflare_challenge'
 WHEN az < 300 AND ({m('t', K.BOT_TEXT)} OR {m(html, K.BOT_MARKUP)}) THEN 'bot_verification'
 WHEN {m('ti', K.DENIED_TITLE)} OR (az < 300 AND {m(html, K.DENIED_MARKUP)}) OR (az < 300 AND length(t) < 2500 AND {m('t', K.DENIED_TEXT)}) THEN 'access_denied'
 WHEN az < 300 AND length(t) < 3000 AND ({m('ti', K.LOGIN_TITLE)} OR (({m(html, K.PASSWORD_INPUT)} OR {m(html, K.LOGIN_MARKUP)}) AND {m('t', K.LOGIN_TEXT)})) THEN 'login_wall'
 WHEN az < 300 AND length(t) < 3000 AND ({m('ti', K.CONSENT_TITLE)} OR ({m('t', K.CONSENT_TEXT)} AND {m('t', K.CONSENT_WORDS)})) THEN 'consent_interstitial'
 WHEN az < 300 AND length(t) < 3000 AND ({m('ti', K.ERROR_TITLE)} OR {m('t', K.ERROR_TEXT)}) THEN 'error_page'
 WHEN bs < 80 AND az = 0 AND ({m(html, K.EMPTY_ROOT)} OR regexp_matches({html}, '(?i)<script\\b')) THEN 'empty_application_shell'
 ELSE 'content' END"""


def source_type(domain: str, title: str, article_like: str) -> str:
    both = f"lower({domain} || ' ' || {title})"
    return f"""CASE WHEN {found(domain, K.SOURCE_OFFICIAL_DOMAIN, False)} OR {found(both, K.SOURCE_OFFICIAL_TEXT, False)} THEN 'official'
 WHEN {found(domain, K.SOURCE_ACADEMIC, False)} THEN 'academic' WHEN {found(both, K.SOURCE_FACT_CHECK, False)} THEN 'fact_check'
 WHEN {found(domain, K.SOURCE_SOCIAL, False)} THEN 'social' WHEN {found(domain, K.SOURCE_REFERENCE, False)} THEN 'reference'
 WHEN {article_like} THEN 'news' ELSE 'other' END"""


# ---------------------------------------------------------------- claim fields

def quotes(x: str) -> str:
    both = f"list_concat(regexp_extract_all({x}, {re2(K.DOUBLE_QUOTED)}, 1), regexp_extract_all({x}, {re2(K.SINGLE_QUOTED)}, 1))"
    return f"list_filter(list_transform({both}, lambda q: {clean('q')}), lambda q: q <> '')"


def fields(source: str, name: str) -> str:
    """A common table expression adding every claim field to ``source`` (columns claim, title)."""
    verb = found("claim", K.FINITE_VERB)
    head = f"regexp_extract(claim, {re2('^([' + chr(92) + 'x{0}-' + chr(92) + 'x{10FFFF}]*?)' + K.FINITE_VERB, True)}, 1)"
    tail = clean(f"regexp_extract(claim, {re2(K.FINITE_VERB + '[' + chr(92) + 'x{0}-' + chr(92) + 'x{10FFFF}]*', True)})")
    bare = clean("claim")
    for pattern in K.FRAMING:
        bare = f"regexp_replace({bare}, {re2(pattern, True)}, '')"
    named = f"regexp_replace(regexp_extract(claim, {re2(K.EVENT_DATE_NAMED, True)}, 1), '(?i)(\\d)(?:st|nd|rd|th)', '\\1')"
    labels = "[" + ", ".join(f"CASE WHEN {found('claim', p)} THEN {text(label)} END" for p, label in K.QUALIFIERS)
    genuine = f"({found('claim', K.GENUINE_MEDIA)} OR ({found('claim', K.WAS_PHOTOGRAPHED)} AND NOT {found('claim', K.SYNTHETIC_MEDIA)}))"
    contexts = (
        f"[CASE WHEN {found('claim', K.SYNTHETIC_MEDIA)} THEN {text(K.SYNTHETIC_LABEL)} END, CASE WHEN {genuine} THEN {text(K.GENUINE_LABEL)} END, "
        f"'Presented as ' || {captured('claim', K.PRESENTED_AS)}, 'Caption: ' || {captured('claim', K.QUOTED_CAPTION)}]"
    )
    return f"""
{name}_a AS MATERIALIZED (SELECT *, {first_captured('claim', K.ATTRIBUTION)} AS attribution,
  CASE WHEN len({quotes('claim')}) > 0 THEN {first_captured('claim', K.SPEAKERS)} END AS quoted_speaker,
  coalesce({first_label('claim', K.VERDICT)}, 'not_applicable') AS correction_verdict, {bare} AS bare FROM {source}),
{name}_b AS MATERIALIZED (SELECT *, list_max(list_transform({quotes('bare')}, lambda q, i: {{'size': length(q), 'earliest': -i, 'text': q}}))['text'] AS longest FROM {name}_a),
{name} AS MATERIALIZED (SELECT *,
  CASE WHEN correction_verdict IN ('false', 'misleading') THEN CASE WHEN {found('claim', K.CORRECTING)} THEN 'corrects' ELSE 'rejects' END
    WHEN correction_verdict IN ('mixed', 'unverified') THEN 'corrects' WHEN quoted_speaker IS NOT NULL THEN 'quotes'
    WHEN trim(claim) LIKE '%?' THEN 'questions' WHEN {found('claim', K.REPORTING)} THEN 'reports' WHEN {verb} THEN 'asserts' ELSE 'unknown' END AS source_stance,
  CASE WHEN {found('claim', K.FACT_CHECK_LABEL)} THEN 'fact_check_framing'
    WHEN correction_verdict <> 'not_applicable' AND {found('claim', K.CORRECTION_WORDS)} THEN 'correction' WHEN quoted_speaker IS NOT NULL THEN 'quotation'
    WHEN {found('claim', K.CAPTION_WORDS)} THEN 'caption' WHEN {compare_key('claim')} = {compare_key('title')} THEN 'headline'
    WHEN {verb} THEN 'claim' ELSE 'unknown' END AS claim_type,
  lower(regexp_replace(replace(regexp_replace({clean(f"CASE WHEN quoted_speaker IS NOT NULL AND longest IS NOT NULL THEN longest ELSE regexp_replace(bare, {re2(K.NARRATION, True)}, '') END")}, '[“”]', '"', 'g'), '’', chr(39)), '[.!?]+$', '')) AS normalized_proposition,
  CASE WHEN length({head}) >= 2 AND length({clean(head)}) BETWEEN 2 AND 120 THEN {clean(head)} END AS subject,
  CASE WHEN length({tail}) >= 2 THEN {tail} END AS event,
  CASE WHEN regexp_extract(claim, {re2(K.EVENT_DATE_ISO)}, 1) <> '' THEN strftime(try_cast(regexp_extract(claim, {re2(K.EVENT_DATE_ISO)}, 1) AS DATE), '%Y-%m-%d')
    ELSE strftime(try_strptime(replace({named}, ',', ''), '%B %d %Y'), '%Y-%m-%d') END AS event_date,
  {captured('claim', K.LOCATION, False)} AS location, coalesce({captured('claim', K.ACTOR)}, attribution) AS actor,
  {first_captured('claim', K.CAUSE)} AS causal_language,
  coalesce({first_label('claim', K.CERTAINTY)}, CASE WHEN {verb} THEN 'asserted' ELSE 'unknown' END) AS certainty,
  CASE WHEN {found('claim', K.MEDIA_WORDS)} THEN nullif(array_to_string(list_filter({contexts}, lambda c: c IS NOT NULL), '; '), '') END AS caption_context,
  list_filter({labels}, 'according to ' || attribution], lambda q: q IS NOT NULL) AS qualifiers
FROM {name}_b)"""


FIELD_NAMES = (
    "attribution quoted_speaker correction_verdict source_stance claim_type normalized_proposition subject event event_date "
    "location actor causal_language certainty caption_context"
).split()
