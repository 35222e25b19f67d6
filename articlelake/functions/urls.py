"""URL columns.

The built-in ``parse_url`` follows java.net.URI, which refuses many URLs that crawls
contain (underscores in hosts, spaces, stray percent signs) and keeps the host's case.
Here one regular expression cuts the URL into its five parts and the rest is derived
from them with string functions. The long expressions are SQL text: it is parsed in one
call, and its lambdas give names to values that are used more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articlelake.functions.hosts import IPV4, article_host
from articlelake.functions.text import WS_CLASS, has_control, strip

# Line breaks and tabs are removed from an URL first, so a newline can mark the cuts.
_CUT = r"\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
_CUT_MARKS = "$1\n$2\n$3\n$4\n$5"
_LEADING = "".join(chr(code) for code in range(0x21))

# Characters whose compatibility form holds one of  / ? # @ :
_SPOOF = (
    r"[\u2047\u2048\u2049\u2100\u2101\u2105\u2106\u2a74\ufe13\ufe16\ufe55\ufe56\ufe5f\ufe6b"
    r"\uff03\uff0f\uff1a\uff1f\uff20]"
)


def _ipv6_pattern() -> str:
    """IPv6 text forms, built from the rule: eight groups, one run may be ``::``."""
    group = "[0-9A-Fa-f]{1,4}"
    forms = [f"(?:{group}:){{7}}{group}", f"(?:{group}:){{6}}{IPV4}"]
    for high in range(8):
        head = f"{group}(?::{group}){{{high - 1}}}" if high else ""
        tails = []
        if high < 7:
            tails.append(f"{group}(?::{group}){{0,{6 - high}}}")
        if high < 6:
            tails.append(f"(?:{group}:){{0,{5 - high}}}{IPV4}")
        tail = f"(?:{'|'.join(tails)})?" if tails else ""
        forms.append(f"{head}::{tail}")
    return rf"\A(?:{'|'.join(forms)})(?:%[^%]+)?\z"


_IP_LITERAL = _ipv6_pattern()
_FUTURE_LITERAL = r"(?s)\Av[0-9A-Fa-f]+\..+\z"
_INNER = r"\[([^\]]*)"
_LITERAL_PORT = r"(?s)\[[^\]]*\][^:]*:(.*)\z"
_PLAIN_PORT = r"(?s)\A[^:]*:(.*)\z"


def _raw(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    return f"r'{pattern}'"


def let_sql(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once under ``name`` and uses it many times."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def netloc_valid_sql(netloc: str) -> str:
    """SQL test of the authority: balanced and readable brackets, no look-alike marks."""
    inner = f"regexp_extract({netloc}, {_raw(_INNER)}, 1)"
    return f"""(
        contains({netloc}, '[') = contains({netloc}, ']')
        AND NOT {netloc} RLIKE {_raw(_SPOOF)}
        AND CASE WHEN NOT contains({netloc}, '[') THEN true
                 WHEN startswith({inner}, 'v') THEN {inner} RLIKE {_raw(_FUTURE_LITERAL)}
                 ELSE {inner} RLIKE {_raw(_IP_LITERAL)} END
    )"""


def fields_sql(pieces: str) -> str:
    """SQL for the struct of URL parts.

    ``host`` is lower case and null when absent; ``port`` is null when absent;
    ``valid`` is false for URLs whose brackets, host text or port cannot be read, and
    ``netloc_valid`` is the same without the port.
    """
    netloc = f"{pieces}[1]"
    hostport = f"substring_index({netloc}, '@', -1)"
    host = f"""CASE WHEN contains({hostport}, '[')
        THEN regexp_extract({hostport}, {_raw(_INNER)}, 1)
        ELSE substring_index({hostport}, ':', 1) END"""
    port = f"""CASE WHEN contains({hostport}, '[')
        THEN regexp_extract({hostport}, {_raw(_LITERAL_PORT)}, 1)
        ELSE regexp_extract({hostport}, {_raw(_PLAIN_PORT)}, 1) END"""
    # A zone after '%' keeps its case.
    lowered = let_sql(
        host,
        "h",
        """CASE WHEN contains(h, '%')
            THEN concat(lower(substring_index(h, '%', 1)), substring(h, instr(h, '%')))
            ELSE lower(h) END""",
    )
    checks = f"""named_struct(
        'port_text', {port}, 'netloc_ok', {netloc_valid_sql(netloc)}, 'host', {lowered})"""
    port_number = "IF(n.port_text RLIKE r'\\A0*[0-9]{1,5}\\z', CAST(right(n.port_text, 5) AS int), -1)"
    return let_sql(
        checks,
        "n",
        f"""named_struct(
            'scheme', lower({pieces}[0]), 'netloc', {netloc}, 'path', {pieces}[2],
            'query', {pieces}[3], 'fragment', {pieces}[4],
            'has_userinfo', contains({netloc}, '@'),
            'host', nullif(n.host, ''),
            'port', IF({port_number} BETWEEN 0 AND 65535, {port_number}, NULL),
            'netloc_valid', n.netloc_ok,
            'valid', n.netloc_ok AND (n.port_text = '' OR {port_number} BETWEEN 0 AND 65535))""",
    )


def let(value: Column, body) -> Column:
    """The Column form of ``let_sql``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def url_cut(url: Column) -> Column:
    """``[scheme, netloc, path, query, fragment]`` with absent parts as ''."""
    cleaned = F.regexp_replace(F.ltrim(url, F.lit(_LEADING)), r"[\t\r\n]", "")
    return F.split(F.regexp_replace(cleaned, F.lit("(?s)" + _CUT), F.lit(_CUT_MARKS)), "\n")


def url_fields(pieces: str) -> Column:
    return F.expr(fields_sql(pieces))


def with_urls(frame: DataFrame, names: dict[str, str]) -> DataFrame:
    """Add one struct of URL parts per entry of ``names`` (struct name to URL column).

    Two projections, so that the optimizer keeps each cut as one shared value.
    """
    cuts = {name: f"_{name}_cut" for name in names}
    cut = frame.withColumns({cuts[name]: url_cut(F.col(url)) for name, url in names.items()})
    return cut.withColumns({name: url_fields(cuts[name]) for name in names}).drop(*cuts.values())


def with_url(frame: DataFrame, url: str, name: str) -> DataFrame:
    return with_urls(frame, {name: url})


def with_first_image(frame: DataFrame, images: Column, name: str) -> DataFrame:
    """Add the first URL of a list that is https, has a host, no user info, no fragment."""
    listed, cuts = f"_{name}_list", f"_{name}_cuts"
    test = """f.valid AND f.scheme = 'https' AND f.host IS NOT NULL
        AND NOT f.has_userinfo AND f.fragment = ''"""
    passed = f"transform({cuts}, p -> coalesce({let_sql(fields_sql('p'), 'f', test)}, false))"
    first = f"nullif(array_position({passed}, true), 0)"
    return (
        frame.withColumn(listed, images)
        .withColumn(cuts, F.transform(listed, url_cut))
        .withColumn(name, F.expr(f"try_element_at({listed}, CAST({first} AS int))"))
        .drop(listed, cuts)
    )


def _no(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def fetch_target_reason(parts: Column) -> Column:
    """Why an URL cannot be fetched at all, or null."""
    complete = (
        (parts["scheme"] != "")
        & parts["host"].isNotNull()
        & ~parts["netloc"].rlike(f"[{WS_CLASS}]")
    )
    return F.when(~_no(parts["valid"]), F.lit("target_url_malformed")).when(
        ~_no(complete), F.lit("target_url_incomplete")
    )


def origin(parts: Column) -> Column:
    """``scheme://host[:port]``; user info is dropped and default ports are kept."""
    host = F.when(
        F.contains(parts["host"], F.lit(":")), F.concat(F.lit("["), parts["host"], F.lit("]"))
    ).otherwise(parts["host"])
    authority = F.concat(
        host, F.coalesce(F.concat(F.lit(":"), parts["port"].cast("string")), F.lit(""))
    )
    return F.when(
        fetch_target_reason(parts).isNull(), F.concat(parts["scheme"], F.lit("://"), authority)
    )


def page_url_reason(url: Column, parts: Column, domains: Column) -> Column:
    """Why an URL cannot be the canonical URL of a page of these domains, or null."""
    inside = (
        (parts["scheme"] == "https")
        & F.array_contains(domains, F.rtrim(parts["host"], F.lit(".")))
        & ~parts["has_userinfo"]
        & (parts["fragment"] == "")
    )
    return F.when(url.isNull() | ~_no(parts["valid"]), F.lit("canonical_invalid")).when(
        ~_no(inside), F.lit("canonical_out_of_bounds")
    )


def is_article_url(url: Column, parts: Column, *, allow_fragment: bool) -> Column:
    """The strict URL rule of the article contract (null URL: false)."""
    ok = (
        (url == strip(url))
        & ~has_control(url)
        & parts["valid"]
        & (parts["scheme"] == "https")
        & ~parts["has_userinfo"]
        & article_host(parts["host"]).isNotNull()
    )
    if not allow_fragment:
        ok = ok & (parts["fragment"] == "")
    return _no(ok)


def resolvable_host(url: Column, parts: Column) -> Column:
    """Host of an URL that may be looked up in the source registry, else null."""
    ok = (
        (url == strip(url))
        & parts["valid"]
        & (parts["scheme"] == "https")
        & ~parts["has_userinfo"]
    )
    return F.when(ok, parts["host"])


def percent_decode(value: Column) -> Column:
    """Undo percent-encoding; stray percent signs stay, bad UTF-8 becomes U+FFFD."""
    safe = F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(F.regexp_replace(safe, r"\+", "%2B"))
    return F.when(F.contains(value, F.lit("%")), decoded).otherwise(value)


def percent_encode(value: Column) -> Column:
    """Percent-encode all but letters, digits and ``_ . - ~ /``."""
    encoded = F.regexp_replace(F.url_encode(value), r"\+", "%20")
    encoded = F.regexp_replace(encoded, r"\*", "%2A")
    encoded = F.regexp_replace(encoded, "%2F", "/")
    encoded = F.regexp_replace(encoded, "%7E", "~")
    return F.when(value.rlike(r"[^A-Za-z0-9_.~/\-]"), encoded).otherwise(value)
