"""Web addresses as column expressions: serialise, resolve, normalise.

Limits, by choice: hosts outside ASCII are kept in lower case rather than encoded, and
numeric hosts are not rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazetide.functions.exprs import let, text_array
from gazetide.functions.text import clean_text

# Query keys that only track where a reader came from.
TRACKING_KEYS = [
    "fbclid", "gclid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term",
]

_WEB = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_HOST_OK = r"^[^\x00-\x20#/:<>?@\[\\\]^|%\x7F]+$"
# Characters that percent-encoding touches but a path keeps as they are; "%" comes last
# so that escapes already present survive.
_PATH_KEEPS = "/:@!$&'(),;=+~[]|^%"
_QUERY_KEEPS = "/:@!$&(),;=+~[]|^?{}`\\%"
_FRAGMENT_KEEPS = "/:@!$&'(),;=+~[]|^?{}#\\%"


def _escape(c: Column, keeps: str) -> Column:
    """Percent-encode what does not belong into a URL part."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for ch in keeps:
        out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return F.when(c.rlike(r"[^A-Za-z0-9_.~/:@!$&(),;=+%?*\-]"), out).otherwise(c)


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""

    def fold(p: Column) -> Column:
        segments = F.split(F.substr(p, F.lit(2)), "/")
        kept = F.aggregate(
            segments,
            text_array([]),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
            .otherwise(F.concat(acc, F.array(s))),
        )
        tail = F.when(p.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
        joined = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
        return F.when(joined == "//", F.lit("/")).otherwise(joined)

    return F.when(path.rlike(r"/\.{1,2}(?:/|$)"), let(path, fold)).otherwise(path)


def _pieces(c: Column) -> Column:
    group = lambda i: F.regexp_extract(c, _WEB, i)
    authority = group(2)
    return F.struct(
        F.lower(group(1)).alias("scheme"),
        F.regexp_extract(authority, r"^(.*@)?", 1).alias("user"),
        F.lower(F.regexp_extract(authority, r"^(?:.*@)?([^@]*?)(?::\d*)?$", 1)).alias("host"),
        F.regexp_extract(authority, r":(\d+)$", 1).alias("port"),
        F.translate(group(3), "\\", "/").alias("path"),
        group(4).alias("query"),
        group(5).alias("fragment"),
    )


def _origin(p: Column) -> Column:
    """``scheme://host[:port]`` or NULL when the parts make no web address."""
    number = p.port.try_cast("int")
    default = F.when(p.scheme == "https", 443).otherwise(80)
    valid = (
        p.scheme.isin("http", "https")
        & p.host.rlike(_HOST_OK)
        & ((p.port == "") | (number <= 65535))
    )
    port = F.when((p.port == "") | (number == default), F.lit("")).otherwise(F.concat(F.lit(":"), number.cast("string")))
    return F.when(valid, F.concat(p.scheme, F.lit("://"), p.user, p.host, port))


def _path(p: Column) -> Column:
    return F.when(p.path == "", F.lit("/")).otherwise(_escape(_without_dots(p.path), _PATH_KEEPS))


def _decoded(c: Column) -> Column:
    lenient = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.rlike(r"[%+]"), F.url_decode(lenient)).otherwise(c)


def _clean_query(query: Column) -> Column:
    """Query without tracking keys, re-encoded as form pairs; ``''`` when nothing is left."""
    parts = F.filter(F.split(F.substr(query, F.lit(2)), "&"), lambda x: x != "")
    pairs = F.transform(
        parts,
        lambda x: F.struct(
            _decoded(F.regexp_extract(x, r"(?s)^([^=]*)", 1)).alias("k"),
            _decoded(F.regexp_extract(x, r"(?s)^[^=]*=?(.*)$", 1)).alias("v"),
        ),
    )
    wanted = F.filter(pairs, lambda p: ~F.lower(p.k).isin(TRACKING_KEYS))
    encoded = F.transform(wanted, lambda p: F.concat(F.url_encode(p.k), F.lit("="), F.url_encode(p.v)))
    return F.when(query.isin("", "?"), F.lit("")).otherwise(
        let(encoded, lambda e: F.when(F.size(e) == 0, F.lit("")).otherwise(
            F.concat(F.lit("?"), F.array_join(e, "&"))))
    )


def normalize_url(c: Column) -> Column:
    """Comparison form of a web address, NULL when it is none: lower-case host, no default
    port, no tracking keys, no fragment."""
    return let(
        clean_text(c),
        lambda s: F.when(
            s.rlike(r"(?i)^https?:"),
            let(_pieces(s), lambda p: F.concat(_origin(p), _path(p), _clean_query(p.query))),
        ),
    )


def serialize_url(c: Column) -> Column:
    """Standard spelling of a web address, keeping query and fragment; anything else is
    returned as it came."""

    def spell(p: Column) -> Column:
        return F.concat(
            _origin(p), _path(p), _escape(p.query, _QUERY_KEEPS), _escape(p.fragment, _FRAGMENT_KEEPS)
        )

    trimmed = F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\r\n]", "")
    return let(
        trimmed,
        lambda s: F.when(s.rlike(r"(?i)^https?:"), F.coalesce(let(_pieces(s), spell), c)).otherwise(c),
    )


def resolve_url(base: Column, link: Column) -> Column:
    """Address of ``link`` as seen from the page ``base``."""
    bare_base = F.regexp_extract(base, r"(?s)^([^#]*)", 1)
    no_query = F.regexp_extract(bare_base, r"(?s)^([^?]*)", 1)
    origin = F.regexp_extract(no_query, r"^([A-Za-z][A-Za-z0-9+.\-]*:[/\\]*[^/\\]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    folder = F.when(no_query.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*[^/\\]*$"), F.concat(no_query, F.lit("/"))).otherwise(
        F.regexp_replace(no_query, r"[^/\\]*$", "")
    )

    def join(s: Column) -> Column:
        absolute = (
            F.when(s.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), s)
            .when(s.rlike(r"^[/\\]{2}"), F.concat(scheme, s))
            .when(s.rlike(r"^[/\\]"), F.concat(origin, s))
            .when(s.startswith("?"), F.concat(no_query, s))
            .when(s.startswith("#"), F.concat(bare_base, s))
            .when(s == "", bare_base)
            .otherwise(F.concat(folder, s))
        )
        return serialize_url(absolute)

    trimmed = F.regexp_replace(link, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\r\n]", "")
    return F.when(base.rlike(r"(?i)^https?:"), let(trimmed, join)).otherwise(link)


def url_host(c: Column) -> Column:
    """Lower-case host, ``''`` when there is none."""
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]+(?:[^/\\?#]*@)?([^/\\?#:@]+)", 1))
