"""Columns of one fetched page: barriers, readable text, metadata, dates, passages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import urls
from tracewell.functions.dates import normalize_evidence_date
from tracewell.functions.fields import passage_kind
from tracewell.functions.patterns import SPACE, found, java
from tracewell.functions.text import (
    clean_lines, let, overlap_relevance, phrase_of, rank_terms, sentences, squeeze, strip_space,
)

_ANY = r"[\x{0}-\x{10FFFF}]"
_COMMENT = rf"<!--{_ANY}*?-->"
_HIDDEN = rf"(?i)<(script|style|noscript|svg|canvas)(?![A-Za-z0-9_])[^>]*>{_ANY}*?</\1{SPACE}*>"
_NOISE = (
    rf"(?i)<(script|style|noscript|svg|canvas|form|nav|footer|aside)(?![A-Za-z0-9_])[^>]*>{_ANY}*?</\1{SPACE}*>"
)
_BLOCK_END = r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/section|/article)>"
_TAG = r"<[^>]+>"


def _element(name: str) -> str:
    return rf"(?i)<{name}(?![A-Za-z0-9_])[^>]*>{_ANY}*?</{name}{SPACE}*>"


def element(html: Column, name: str) -> Column:
    """The first whole element of a name (tags included), null when there is none."""
    return F.regexp_substr(html, F.lit(_element(name)))


def inner(html: Column, name: str) -> Column:
    """What the first element of a name contains, empty when there is none."""
    return F.regexp_extract(html, rf"(?i)<{name}(?![A-Za-z0-9_])[^>]*>({_ANY}*?)</{name}{SPACE}*>", 1)


# ---------------------------------------------------------------- text

def decode_entities(text: Column) -> Column:
    """Decode the common named and all numeric entities, each exactly once.

    Ampersands come last, so that an escaped entity is not decoded twice.
    """
    return F.when(~text.contains("&"), text).otherwise(_decoded(text))


def _decoded(text: Column) -> Column:
    out = text
    for name, char in K.NAMED_ENTITIES.items():
        out = F.regexp_replace(out, f"(?i)&{name};", char)
    number = r"^&#(?:x([0-9a-fA-F]{1,8})|([0-9]{1,9}));"

    def decoded(piece: Column) -> Column:
        code = F.coalesce(
            F.conv(F.nullif(F.regexp_extract(piece, number, 1), F.lit("")), 16, 10),
            F.nullif(F.regexp_extract(piece, number, 2), F.lit("")),
        ).try_cast("bigint")
        char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
        return F.coalesce(
            let(code, lambda c: F.when(
                c.between(0, 0x10FFFF) & ~c.between(0xD800, 0xDFFF) & (c != 38),
                F.concat(char(c), F.regexp_replace(piece, number, "")),
            )),
            piece,
        )

    out = F.array_join(F.transform(F.split(out, "(?=&#)"), decoded), "")
    return F.regexp_replace(out, "(?i)&(?:amp|#0*38|#x0*26);", "&")


def strip_markup(html: Column) -> Column:
    """Readable text of a fragment: one line per block, never null."""
    bare = F.regexp_replace(F.regexp_replace(html, _COMMENT, " "), _NOISE, " ")
    lines = F.regexp_replace(F.regexp_replace(bare, _BLOCK_END, "\n"), _TAG, " ")
    return F.coalesce(clean_lines(decode_entities(lines)), F.lit(""))


def readable_text(html: Column) -> Column:
    """Text of the article, else main, else body, else the whole page."""
    return strip_markup(
        F.coalesce(element(html, "article"), element(html, "main"), element(html, "body"), html)
    )


def page_text(html: Column) -> Column:
    """All visible text on one line, as the barrier tests read it."""
    bare = F.regexp_replace(F.regexp_replace(html, _COMMENT, " "), _HIDDEN, " ")
    spaced = F.regexp_replace(F.regexp_replace(bare, _TAG, " "), "(?i)&(?:nbsp|#160);", " ")
    return squeeze(F.regexp_replace(spaced, "(?i)&(?:amp|#38);", "&"))


def integrity_columns(html: Column) -> dict[str, Column]:
    """The inputs of :func:`html_integrity`, each computed once per page."""
    return {
        "_text": page_text(html),
        "_title": page_text(inner(html, "title")),
        "_body_size": F.length(page_text(F.coalesce(element(html, "body"), html))),
        "_article_size": F.length(page_text(F.coalesce(element(html, "article"), element(html, "main"), F.lit("")))),
    }


def html_integrity(html: Column) -> Column:
    """``content`` or the first barrier the page shows; needs :func:`integrity_columns`."""
    text, title = F.col("_text"), F.col("_title")
    thin = F.col("_article_size") < 300
    short = F.length(text) < 3000
    login_form = found(html, K.PASSWORD_INPUT) | found(html, K.LOGIN_MARKUP)
    return (
        F.when(
            (thin & short & found(html, K.CAPTCHA_MARKUP)) | (thin & found(text, K.CAPTCHA_TEXT)),
            "captcha",
        )
        .when(
            found(html, K.CHALLENGE_MARKUP)
            | (found(title, K.CHALLENGE_TITLE) & found(html, K.CHALLENGE_VENDOR)),
            "cloudflare_challenge",
        )
        .when(thin & (found(text, K.BOT_TEXT) | found(html, K.BOT_MARKUP)), "bot_verification")
        .when(
            found(title, K.DENIED_TITLE)
            | (thin & found(html, K.DENIED_MARKUP))
            | (thin & (F.length(text) < 2500) & found(text, K.DENIED_TEXT)),
            "access_denied",
        )
        .when(
            thin & short & (found(title, K.LOGIN_TITLE) | (login_form & found(text, K.LOGIN_TEXT))),
            "login_wall",
        )
        .when(
            thin & short
            & (found(title, K.CONSENT_TITLE) | (found(text, K.CONSENT_TEXT) & found(text, K.CONSENT_WORDS))),
            "consent_interstitial",
        )
        .when(thin & short & (found(title, K.ERROR_TITLE) | found(text, K.ERROR_TEXT)), "error_page")
        .when(
            (F.col("_body_size") < 80) & (F.col("_article_size") == 0)
            & (found(html, K.EMPTY_ROOT) | html.rlike(r"(?i)<script(?![A-Za-z0-9_])")),
            "empty_application_shell",
        )
        .otherwise("content")
    )


def with_integrity(frame, html: str = "html"):
    """Add ``integrity``, the page's barrier kind, in one projection over the page."""
    helpers = integrity_columns(F.col(html))
    return (
        frame.withColumns(helpers)
        .withColumn("integrity", html_integrity(F.col(html)))
        .drop(*helpers)
    )


# ---------------------------------------------------------------- metadata

_ATTRIBUTE = (
    rf"([^{SPACE[1:-1]}=/>]+)(?:{SPACE}*={SPACE}*(?:\"([^\"]*)\"|'([^']*)'|([^{SPACE[1:-1]}\"'=<>`]+)))?"
)


def attributes(tag: Column) -> Column:
    """The attributes of a tag as an array of (name, value), values decoded."""
    part = lambda g: F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), g)
    zipped = F.arrays_zip(
        part(1).alias("name"), part(2).alias("double"), part(3).alias("single"), part(4).alias("bare")
    )
    return F.transform(
        zipped,
        lambda a: F.struct(
            F.lower(a["name"]).alias("name"),
            decode_entities(F.concat(a["double"], a["single"], a["bare"])).alias("value"),
        ),
    )


def attribute(pairs: Column, name: str) -> Column:
    """The last value given for an attribute, null when it is absent."""
    return F.try_element_at(F.filter(pairs, lambda a: a["name"] == name), F.lit(-1))["value"]


def meta_entries(html: Column) -> Column:
    """Ordered (key, value) pairs of the page's meta tags."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta(?![A-Za-z0-9_])[^>]*>"), 0)

    def entry(pairs: Column) -> Column:
        key = F.coalesce(*[attribute(pairs, n) for n in ("property", "name", "itemprop", "http-equiv")])
        return F.struct(F.lower(key).alias("key"), attribute(pairs, "content").alias("value"))

    return F.filter(
        F.transform(F.transform(tags, attributes), entry), lambda e: (F.length(e["key"]) > 0) & (F.length(e["value"]) > 0)
    )


def first_meta(entries: Column, keys) -> Column:
    """The value of the first entry whose key is wanted."""
    return F.get(F.filter(entries, lambda e: e["key"].isin(*keys)), F.lit(0))["value"]


def _objects(values: Column) -> Column:
    return F.filter(values, lambda v: F.schema_of_variant(v).startswith("OBJECT"))


def _children(values: Column) -> Column:
    """One breadth-first step: elements of arrays and of ``@graph`` arrays."""
    nested = F.transform(
        values,
        lambda v: F.coalesce(
            F.try_variant_get(v, "$", "array<variant>"),
            F.try_variant_get(v, "$['@graph']", "array<variant>"),
        ),
    )
    return F.flatten(F.filter(nested, lambda a: a.isNotNull()))


def json_ld_objects(html: Column) -> Column:
    """JSON-LD objects in breadth-first order, at any depth of nested lists and graphs.

    Every level of nesting has a ``[`` of its own, so a page needs at most as many steps as
    its blocks have such characters.
    """
    pattern = rf"(?i)<script(?![A-Za-z0-9_])([^>]*)>({_ANY}*?)</script{SPACE}*>"
    blocks = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(pattern), 1).alias("head"),
        F.regexp_extract_all(html, F.lit(pattern), 2).alias("body"),
    )
    wanted = F.filter(
        blocks, lambda b: F.lower(attribute(attributes(b["head"]), "type")) == "application/ld+json"
    )
    level = F.filter(
        F.transform(
            wanted,
            lambda b: F.try_parse_json(
                strip_space(F.regexp_replace(strip_space(b["body"]), "^<!--|-->\\z", ""))
            ),
        ),
        lambda v: v.isNotNull(),
    )
    steps = F.array_max(F.concat(F.array(F.lit(0)), F.transform(wanted, lambda b: F.regexp_count(b["body"], F.lit(r"\[")))))
    first = let(level, lambda v: F.struct(v.alias("level"), _objects(v).alias("found")))
    return F.aggregate(
        F.slice(F.sequence(F.lit(0), steps), F.lit(2), steps), first,
        lambda s, _: F.when(F.size(s["level"]) == 0, s).otherwise(let(_children(s["level"]), lambda v: F.struct(
            v.alias("level"), F.concat(s["found"], _objects(v)).alias("found")))),
        lambda s: s["found"])


def _scalar_text(value: Column) -> Column:
    """A string value on one line; numbers, flags and containers do not count."""
    return F.when(
        F.schema_of_variant(value) == "STRING",
        F.substring(clean_lines(F.try_variant_get(value, "$", "string")), 1, 1000),
    )


#: The properties that page metadata is taken from.
JSON_KEYS = (
    "headline", "name", "publisher", "author", "creator", "datePublished", "uploadDate", "dateModified", "@type",
)


def json_scalars(value: Column, keys=JSON_KEYS) -> Column:
    """The texts of several properties of an object, in the order of the keys.

    A property's text is itself, or the first text of its list, or its name, headline or
    value.  The object is read as a map once; one expression serves all keys.
    """
    def options(v: Column) -> Column:
        """The value, the items of a list, then what either is called."""
        items = F.concat(
            F.array(v), F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")))
        named = F.flatten(F.transform(items, lambda i: F.array(
            i, *[F.try_variant_get(i, f"$.{n}", "variant") for n in ("name", "headline", "value")])))
        return F.transform(named, _scalar_text)

    properties = F.try_variant_get(value, "$", "map<string, variant>")
    wanted = F.transform(F.array(*[F.lit(k) for k in keys]), lambda k: F.try_element_at(properties, k))
    return F.transform(wanted, lambda v: F.get(F.array_compact(options(v)), F.lit(0)))


def article_object(objects: Column) -> Column:
    """The first object of an article type, else the first that carries a date."""
    def rank(o: Column) -> Column:
        dated = [F.try_variant_get(o, f"$.{n}", "variant").isNotNull() for n in ("datePublished", "uploadDate", "dateModified")]
        kind = F.lower(F.get(json_scalars(o, ("@type",)), F.lit(0)))
        return F.when(kind.isin(*K.ARTICLE_TYPES), 0).when(dated[0] | dated[1] | dated[2], 1)

    ranked = F.transform(objects, lambda o: F.struct(rank(o).alias("rank"), o.alias("object")))
    first = lambda r: F.get(F.filter(ranked, lambda x: x["rank"] == r), F.lit(0))["object"]
    return F.coalesce(first(0), first(1))


def canonical_url(html: Column, base: Column) -> Column:
    """The first ``rel=canonical`` link on the page's own host, made absolute."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<link(?![A-Za-z0-9_])[^>]*>"), 0)

    def absolute(href: Column, p: Column) -> Column:
        site = F.concat(p["scheme"], F.lit("://"), p["host"],
                        F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(""))
        return (
            F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(p["scheme"], F.lit(":"), href))
            .when(href.startswith("/"), F.concat(site, href))
            .when(href.startswith("?"), F.concat(site, p["path"], href))
            .when(href.startswith("#"), F.concat(site, p["path"], p["query"], href))
            .otherwise(F.concat(site, F.regexp_replace(p["path"], "[^/]*$", ""), F.regexp_replace(href, r"^\./", "")))
        )

    is_canonical = lambda pairs: F.array_contains(
        F.split(F.lower(attribute(pairs, "rel")), SPACE + "+"), "canonical")

    def own(p: Column) -> Column:
        links = F.transform(
            F.filter(F.transform(tags, attributes), is_canonical),
            lambda pairs: urls.normal_url(absolute(attribute(pairs, "href"), p)),
        )
        same = F.filter(links, lambda u: urls.host(u) == p["host"])
        return F.when(p["web"], F.get(same, F.lit(0)))

    return F.when(~html.rlike("(?i)canonical"), None).otherwise(let(urls.parts(base), own))


# ---------------------------------------------------------------- dates

_CANDIDATE = "struct<raw: string, type: string, confidence: double, place: string, source: string>"


def _candidate(raw: Column, kind, confidence: float, place: str, source: str) -> Column:
    return F.struct(
        raw.alias("raw"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("type"),
        F.lit(confidence).alias("confidence"), F.lit(place).alias("place"), F.lit(source).alias("source"),
    ).cast(_CANDIDATE)


def first_dates(lists: Column, as_of: int) -> Column:
    """For each list of candidates the first whose raw text is a usable date, else null."""
    def dated(c: Column) -> Column:
        return let(normalize_evidence_date(c["raw"], as_of), lambda value: F.when(
            value.isNotNull(),
            F.struct(
                value.alias("value"), c["type"].alias("type"), c["confidence"].alias("confidence"),
                F.concat(c["place"], F.lit(": "), F.substring(c["raw"], 1, 120)).alias("evidence"),
                c["source"].alias("source"),
            ),
        ))

    return F.transform(lists, lambda cs: F.get(F.array_compact(F.transform(
        F.filter(cs, lambda c: F.length(c["raw"]) > 0), dated)), F.lit(0)))


def time_elements(html: Column) -> Column:
    """The ``<time>`` elements: raw date, and what markup or surroundings say they date."""
    pattern = (
        rf"(?i)({_ANY}{{0,180}}?)<time(?![A-Za-z0-9_])([^>]*)>({_ANY}*?)</time{SPACE}*>(?=({_ANY}{{0,180}}))"
    )
    part = lambda g: F.regexp_extract_all(html, F.lit(pattern), g)
    zipped = F.arrays_zip(
        part(1).alias("before"), part(2).alias("head"), part(3).alias("body"), part(4).alias("after")
    )
    near = lambda t: F.concat(
        t["before"], F.lit("<time"), t["head"], F.lit(">"), t["body"], F.lit("</time>"), t["after"])
    read = F.transform(zipped, lambda t: F.struct(
        attributes(t["head"]).alias("pairs"), strip_markup(near(t)).alias("nearby"), strip_markup(t["body"]).alias("body")))

    def judged(t: Column) -> Column:
        prop = F.lower(F.coalesce(attribute(t["pairs"], "itemprop"), F.lit("")))
        css = F.lower(F.coalesce(attribute(t["pairs"], "class"), F.lit("")))
        return F.struct(
            F.coalesce(attribute(t["pairs"], "datetime"), t["body"]).alias("raw"),
            (prop.isin("datepublished", "uploaddate") | found(css, K.TIME_PUBLISHED_CLASS)
             | found(t["nearby"], K.TIME_PUBLISHED_TEXT)).alias("published"),
            ((prop == "datemodified") | found(css, K.TIME_MODIFIED_CLASS)
             | found(t["nearby"], K.TIME_MODIFIED_TEXT)).alias("modified"),
            ((prop == "uploaddate") | found(t["nearby"], r"\buploaded\b")).alias("uploaded"),
        )

    return F.when(html.rlike(r"(?i)<time(?![A-Za-z0-9_])"), F.transform(read, judged))


def page_dates(text: Column, entries: Column, json: dict, times: Column) -> Column:
    """Two candidate lists of what a page says, best first: published, modified."""
    c = K.DATE_CONFIDENCE
    none = F.array().cast(f"array<{_CANDIDATE}>")
    from_times = lambda field, kind: F.coalesce(F.transform(
        F.filter(times, lambda t: t[field]),
        lambda t: _candidate(
            t["raw"], F.when(t["uploaded"] & F.lit(kind == "publication"), "upload").otherwise(kind), c["time_element"],
            f"contextual HTML <time> ({kind})", "article_metadata")), none)
    visible = F.transform(
        F.array(*[F.regexp_extract(text, java(p, True), 1) for p in K.VISIBLE_DATES]),
        lambda raw: _candidate(raw, "publication", c["visible_label"], "visible publication label", "visible_text"))
    published = F.concat(
        F.array(
            _candidate(json["datePublished"], "publication", c["json_ld_published"], "JSON-LD datePublished", "json_ld"),
            _candidate(json["uploadDate"], "upload", c["json_ld_uploaded"], "JSON-LD uploadDate", "json_ld"),
            _candidate(first_meta(entries, K.META_OPENGRAPH_DATE), "publication", c["opengraph"],
                       "OpenGraph article:published_time", "opengraph"),
            _candidate(first_meta(entries, K.META_PUBLISHED), "publication", c["html_published"],
                       "HTML publication metadata", "html_metadata"),
        ),
        from_times("published", "publication"), visible,
    )
    modified = F.concat(
        F.array(
            _candidate(json["dateModified"], "modified", c["json_ld_modified"], "JSON-LD dateModified", "json_ld"),
            _candidate(first_meta(entries, K.META_MODIFIED), "modified", c["html_modified"],
                       "HTML modification metadata", "html_metadata"),
        ),
        from_times("modified", "modified"),
    )
    return F.array(published, modified)


def provider_dates(provider: Column) -> Column:
    """One candidate list; a provider's date is an index date, never evidence of publication."""
    return F.array(F.array(_candidate(
        provider, "crawl_index", K.DATE_CONFIDENCE["provider"], "search-provider date (not publication evidence)", "provider")))


# ---------------------------------------------------------------- classification

def source_type(domain: Column, title: Column, article_like: Column) -> Column:
    both = F.lower(F.concat_ws(" ", domain, title))
    return (
        F.when(found(domain, K.SOURCE_OFFICIAL_DOMAIN, False) | found(both, K.SOURCE_OFFICIAL_TEXT, False), "official")
        .when(found(domain, K.SOURCE_ACADEMIC, False), "academic")
        .when(found(both, K.SOURCE_FACT_CHECK, False), "fact_check")
        .when(found(domain, K.SOURCE_SOCIAL, False), "social")
        .when(found(domain, K.SOURCE_REFERENCE, False), "reference")
        .when(article_like, "news")
        .otherwise("other")
    )


def extraction_confidence(status: Column, size: Column, dated: Column, canonical: Column, author: Column) -> Column:
    """How well a page was read: its status and text size, plus what it says of itself."""
    base = (
        F.when(status == "acquired", F.when(size >= 1000, 0.82).when(size >= 200, 0.68).otherwise(0.45))
        .when(status == "partial", F.when(size >= 500, 0.62).otherwise(0.42))
        .otherwise(0.0)
    )
    extras = (
        F.when(dated, 0.06).otherwise(0.0) + F.when(canonical, 0.04).otherwise(0.0)
        + F.when(author, 0.03).otherwise(0.0)
    )
    return F.least(F.lit(1.0), base + extras)


# ---------------------------------------------------------------- passages

def passage_candidates(text: Column) -> Column:
    """Lines of at least 40 characters; over-long lines by sentence, and over-long sentences
    in consecutive pieces.  Passages have at most 1,200 characters; nothing is left out."""
    lines = F.filter(
        F.transform(F.split(text, "\n+"), strip_space), lambda l: F.length(l) >= K.MIN_LINE_CHARACTERS
    )

    def parts(line: Column) -> Column:
        long_enough = F.filter(
            F.transform(sentences(line), strip_space), lambda s: F.length(s) >= K.MIN_LINE_CHARACTERS
        )
        size = K.MAX_PASSAGE_CHARACTERS
        cut = F.flatten(F.transform(long_enough, lambda s: F.transform(
            F.sequence(F.lit(0), F.floor((F.length(s) - 1) / F.lit(size)).cast("int")),
            lambda i: F.substring(s, i * size + 1, F.lit(size)))))
        return F.when(F.length(line) <= K.MAX_PASSAGE_CHARACTERS, F.array(line)).otherwise(cut)

    return F.flatten(F.transform(lines, parts))


def relevant_passages(source_id: Column, claim: Column, text: Column, limit: int = K.MAX_PASSAGES) -> Column:
    """The passages of one page worth keeping as evidence, best first.

    The page's own array is ranked in place: nothing is exploded or shuffled.
    """
    asked = F.struct(rank_terms(claim, normalize=False).alias("terms"), phrase_of(claim).alias("phrase"))
    relevance = lambda c, p: let(
        rank_terms(p, normalize=False),
        lambda terms: overlap_relevance(c["terms"], terms, c["phrase"], F.lower(p)),
    )
    scored = let(asked, lambda c: F.transform(
        passage_candidates(text),
        lambda p, i: F.struct(
            (-relevance(c, p)).alias("sort"),
            i.alias("ord"),
            p.alias("text"),
            passage_kind(p).alias("kind"),
        ),
    ))
    kept = F.filter(scored, lambda p: (p["sort"] < 0) | (p["ord"] == 0) | (p["kind"] != "claim"))
    return F.transform(
        F.slice(F.array_sort(kept), 1, limit),
        lambda p: F.struct(
            passage_id(source_id, p["text"]).alias("passage_id"),
            p["text"].alias("text"),
            p["kind"].alias("kind"),
            (-p["sort"]).alias("relevance"),
        ),
    )


def passage_id(source_id: Column, text: Column, marker: str = "") -> Column:
    """Content-addressed id of a passage."""
    return F.concat(
        F.lit("ev_"),
        F.substring(F.sha2(F.concat(source_id, F.lit("\0" + marker), text).cast("binary"), 256), 1, 16),
    )


def source_id(url: Column) -> Column:
    """Content-addressed id of a page."""
    return F.concat(F.lit("src_"), F.substring(F.sha2(urls.url_key(url).cast("binary"), 256), 1, 16))


def with_date_passage(source: Column, passages: Column, date: Column, limit: int = K.MAX_PASSAGES) -> Column:
    """Put the passage that dates the page in front, keeping the bound."""
    text = F.substring(date["evidence"], 1, K.MAX_PASSAGE_CHARACTERS)
    dated = F.struct(
        passage_id(source, text, "date\0").alias("passage_id"),
        text.alias("text"),
        F.lit("date").alias("kind"),
        date["confidence"].alias("relevance"),
    )
    return F.when(date.isNull(), passages).otherwise(F.slice(F.concat(F.array(dated), passages), 1, limit))
