"""URL columns: parts, canonical key, acquisition policy.

URLs are taken apart with one expression per part instead of ``try_parse_url``, which
refuses many URLs found on the web (spaces, pipes, non-ASCII letters).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions.patterns import found
from tracewell.functions.text import let, strip_space

_DEFAULT_PORT = {"http": "80", "https": "443"}
_WHOLE = r"(?i)^(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def parts(url: Column) -> Column:
    """Scheme, credentials, host, port, path, query and fragment of an http(s) URL.

    Parts that are absent are empty; ``web`` tells whether the URL is absolute and http(s).
    The port is empty when it is the scheme's own.
    """
    piece = lambda text, group: F.regexp_extract(text, _WHOLE, group)

    def split_authority(text: Column, authority: Column, scheme_: Column) -> Column:
        host_port = F.regexp_replace(authority, r"^.*@", "")
        name = F.lower(F.regexp_extract(host_port, r"^(\[[^\]]*\]|[^:]*)", 1))
        explicit = F.regexp_extract(host_port, r":([0-9]+)$", 1)
        own = F.when(scheme_ == "https", _DEFAULT_PORT["https"]).otherwise(_DEFAULT_PORT["http"])
        raw_path = F.replace(piece(text, 3), F.lit("\\"), F.lit("/"))
        return F.struct(
            text.alias("raw"),
            scheme_.alias("scheme"),
            F.regexp_extract(authority, r"^(.*)@", 1).alias("credentials"),
            name.alias("host"),
            F.when(explicit == own, "").otherwise(explicit).alias("port"),
            F.when(raw_path == "", "/").otherwise(raw_path).alias("path"),
            piece(text, 4).alias("query"),
            piece(text, 5).alias("fragment"),
            F.coalesce((scheme_ != "") & ~name.rlike(r"^$|[\s<>\\^|%]"), F.lit(False)).alias("web"),
        )

    return let(strip_space(url), lambda text: let(
        F.struct(piece(text, 2).alias("authority"), F.lower(piece(text, 1)).alias("scheme")),
        lambda found_: split_authority(text, found_["authority"], found_["scheme"]),
    ))


_HOST = r"(?i)^https?:[/\\]*(?:[^/\\?#]*@)?(\[[^\]]*\]|[^:/\\?#]*)"
_WEB = (
    r"(?i)^https?:[/\\]*(?:[^/\\?#]*@)?(?:\[[0-9a-f:.%]+\]|[^\s<>\\^|%:/?#@\[\]]+)(?::[0-9]*)?(?:[/\\?#]|$)"
)
_TRACKED = r"(?i)([?&])(?:utm_[^=&]*|" + "|".join(K.TRACKING_PARAMETERS) + r")(?:=[^&]*)?(?=&|$)"
_MARK = "\x01"


def scheme(url: Column) -> Column:
    """``http`` or ``https``, else an empty string."""
    return F.lower(F.regexp_extract(strip_space(url), "(?i)^(https?):", 1))


def host(url: Column) -> Column:
    """Lower-case host name; an IPv6 literal keeps its brackets."""
    return F.lower(F.regexp_extract(strip_space(url), _HOST, 1))


def is_web_url(url: Column) -> Column:
    """An absolute http(s) URL with a host."""
    return F.coalesce(strip_space(url).rlike(_WEB), F.lit(False))


def percent_encode(part: Column) -> Column:
    """Percent-encode white space and non-ASCII characters, leaving the rest alone."""
    encoded = F.array_join(
        F.transform(
            F.split(part, ""),
            lambda c: F.when(
                c.rlike(r"[^\x21-\x7e]"),
                F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"),
            ).otherwise(c),
        ),
        "",
    )
    return F.when(part.rlike(r"[^\x21-\x7e]"), encoded).otherwise(part)


def _origin(text: Column) -> Column:
    """Scheme, credentials, host and port of a stripped URL, without the scheme's own port."""
    whole = F.concat(
        F.lower(F.regexp_extract(text, "(?i)^(https?):", 1)), F.lit("://"),
        F.regexp_extract(text, r"(?i)^https?:[/\\]*([^/\\?#]*@)?", 1),
        F.lower(F.regexp_extract(text, r"(?i)^https?:[/\\]*(?:[^/\\?#]*@)?([^/\\?#]*)", 1)),
    )
    return F.regexp_replace(whole, r"^(http://.*):80$|^(https://.*):443$|:$", "$1$2")


def _path(text: Column) -> Column:
    raw = F.regexp_extract(text, r"(?i)^https?:[/\\]*[^/\\?#]*([^?#]*)", 1)
    return F.regexp_replace(F.replace(raw, F.lit("\\"), F.lit("/")), "^$", "/")


def normal_url(url: Column) -> Column:
    """The URL as a browser would write it; null unless it is an absolute http(s) URL."""
    text = strip_space(url)
    rest = F.concat(_path(text), F.regexp_extract(text, "([?#].*)$", 1))
    return F.when(is_web_url(url), F.concat(_origin(text), percent_encode(rest)))


def url_key(url: Column) -> Column:
    """The identity of a page: no fragment, no tracking parameters, no trailing slash.

    Tracking parameters become a mark first; then the marks go with their separators.
    """
    text = strip_space(url)
    query = F.regexp_extract(text, r"^[^?#]*(\?[^#]*)", 1)
    marked = F.regexp_replace(query, _TRACKED, f"$1{_MARK}")
    kept = F.regexp_replace(
        F.regexp_replace(marked, rf"&{_MARK}|^\?{_MARK}$", ""), rf"^\?{_MARK}&?", "?")
    shown = F.regexp_replace(F.regexp_replace(_path(text), "/+$", ""), "^$", "/")
    rest = F.concat(shown, F.when(query == "", "").otherwise(F.regexp_replace(kept, r"^\?$", "")))
    return F.when(is_web_url(url), F.concat(_origin(text), percent_encode(rest))).otherwise(text)


def domain(url: Column, fallback: Column | None = None) -> Column:
    """Host of the URL; the fallback (lower-case) where the URL is not absolute."""
    other = F.lower(fallback) if fallback is not None else F.lit("")
    return F.when(is_web_url(url), host(url)).otherwise(other)


def has_specific_target(url: Column) -> Column:
    """The URL names an item (a path or a query), not just a site."""
    text = strip_space(url)
    return (_path(text) != "/") | (F.length(F.regexp_extract(text, r"^[^?#]*(\?[^#]*)", 1)) > 1)


def is_bare_origin(url: Column) -> Column:
    return F.coalesce(is_web_url(url) & (_path(strip_space(url)) == "/"), F.lit(False))


def has_credentials(url: Column) -> Column:
    return F.coalesce(strip_space(url).rlike(r"(?i)^https?:[/\\]*[^/\\?#]*@"), F.lit(False))


# ---------------------------------------------------------------- network policy

def _number(part: Column) -> Column:
    """One part of a numeric host: decimal, 0x hexadecimal or 0-led octal."""
    return (
        F.when(part.rlike("^0x[0-9a-f]*$"), F.conv(F.concat(F.lit("0"), F.substring(part, 3, 16)), 16, 10))
        .when(part.rlike("^0[0-7]+$"), F.conv(part, 8, 10))
        .when(part.rlike("^[0-9]{1,15}$"), part)
        .cast("bigint")
    )


_NUMERIC_HOST = r"^(?:0x[0-9a-f]*|[0-9]+)(?:\.(?:0x[0-9a-f]*|[0-9]+)){0,3}\.?$"


def ipv4_number(name: Column) -> Column:
    """A numeric host as one number (short and hexadecimal spellings included), else null."""
    def combined(numbers: Column) -> Column:
        leading = F.aggregate(
            F.slice(numbers, 1, F.size(numbers) - 1), F.lit(0).cast("bigint"),
            lambda acc, n: acc * 256 + F.when(n.between(0, 255), n),
        )
        room = F.element_at(F.array(*[F.lit(256 ** n).cast("bigint") for n in (4, 3, 2, 1)]), F.size(numbers))
        last = F.element_at(numbers, -1)
        return leading * room + F.when((last >= 0) & (last < room), last)

    numbers = F.transform(F.split(F.regexp_replace(name, r"\.$", ""), r"\."), _number)
    return F.when(name.rlike(_NUMERIC_HOST), let(numbers, combined))


def _reserved_range(network: str, prefix: int) -> tuple[int, int]:
    base = 0
    for part in network.split("."):
        base = base * 256 + int(part)
    return base, base + 2 ** (32 - prefix) - 1


def is_public_ipv4(number: Column) -> Column:
    """Not in any reserved network: one range test each, folded into the scan's filter."""
    ranges = [_reserved_range(network, prefix) for network, prefix in K.RESERVED_IPV4]

    def outside(n: Column) -> Column:
        reserved = F.lit(False)
        for low, high in ranges:
            reserved = reserved | n.between(low, high)
        return ~reserved

    return let(number, outside)


def ipv6_groups(address: Column) -> Column:
    """The eight 16-bit groups of an IPv6 literal as numbers; null when malformed."""
    piece = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    none = F.array().cast("array<string>")

    def with_hex_tail(bare: Column) -> Column:
        tail = F.regexp_extract(bare, r":(\d+\.\d+\.\d+\.\d+)$", 1)
        as_groups = let(ipv4_number(tail), lambda v: F.concat(
            F.lower(F.hex(F.shiftright(v, 16))), F.lit(":"), F.lower(F.hex(v % 65536))))
        return F.when(
            tail != "", F.concat(F.regexp_replace(bare, r"\d+\.\d+\.\d+\.\d+$", ""), as_groups)
        ).otherwise(bare)

    def filled(halves: Column) -> Column:
        both = F.size(halves) == 2
        left = piece(F.get(halves, F.lit(0)))
        right = F.when(both, piece(F.get(halves, F.lit(1)))).otherwise(none)
        return let(F.struct(left.alias("left"), right.alias("right")), lambda h: F.when(
            (F.size(halves) <= 2)
            & F.when(both, F.size(h["left"]) + F.size(h["right"]) <= 8).otherwise(F.size(h["left"]) == 8),
            F.concat(
                h["left"],
                F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(h["left"]) - F.size(h["right"]), F.lit(0))),
                h["right"],
            ),
        ))

    bare = F.regexp_replace(F.lower(address), "%.*$", "")
    groups = let(F.split(let(bare, with_hex_tail), "::"), filled)
    return let(groups, lambda gs: F.when(
        F.forall(gs, lambda g: g.rlike("^[0-9a-f]{1,4}$")),
        F.transform(gs, lambda g: F.conv(g, 16, 10).cast("bigint")),
    ))


def is_public_ipv6(address: Column) -> Column:
    """Global unicast (2000::/3) without the documentation prefix; mapped IPv4 follows IPv4."""
    def public(gs: Column) -> Column:
        at = lambda i: F.get(gs, F.lit(i))
        mapped = F.forall(F.slice(gs, 1, 5), lambda g: g == 0) & (at(5) == 0xFFFF)
        unicast = at(0).between(0x2000, 0x3FFF) & ~((at(0) == 0x2001) & (at(1) == 0x0DB8))
        return F.when(mapped, is_public_ipv4(at(6) * 65536 + at(7))).otherwise(unicast)

    return F.coalesce(let(ipv6_groups(address), public), F.lit(False))


def url_policy(*urls: Column) -> Column:
    """Why a URL (the first refused of several) may not be acquired; null when all may.

    Host names are not resolved here.
    """
    def verdict(p: Column) -> Column:
        name = F.regexp_replace(p["host"], r"\.$", "")
        literal6 = F.regexp_extract(name, r"^\[(.*)\]$", 1)
        return (
            F.when(p["raw"].isNull() | ~found(p["raw"], r"^[a-z][a-z0-9+.-]*:"), "invalid")
            .when(p["scheme"] == "", "scheme")
            .when(~p["web"], "invalid")
            .when(p["credentials"] != "", "credentials")
            .when((name == "localhost") | name.rlike(r"\.(?:localhost|local|internal|home|lan)$"), "local_host")
            .when(p["port"] != "", "port")
            .when((literal6 != "") & ~is_public_ipv6(literal6), "private_address")
            .when(name.rlike(_NUMERIC_HOST), let(ipv4_number(name), lambda n:
                F.when(n.isNull(), "invalid").when(~is_public_ipv4(n), "private_address")))
        )

    judged = F.transform(F.array(*urls), lambda u: F.coalesce(
        F.when(u.isNull(), "invalid"), let(parts(u), verdict)))
    return F.get(F.array_compact(judged), F.lit(0))
