"""Text columns: stripping, control characters, language tags and redaction.

Everything here is a plain Column expression, so it stays on the JVM. Java regular
expressions differ from the wanted rules in three ways that matter, and each is
spelled out instead of relying on a default: ``$`` may match before a last newline
(``\\A``/``\\z`` are used), ``\\s`` and ``\\w`` are ASCII (classes are listed), and
``.`` stops at several line ends (``[^\\n]`` is used).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Keys whose values never reach a log.
SENSITIVE_KEYS = (
    "access_token",
    "api-key",
    "api_key",
    "apikey",
    "authorization",
    "client_secret",
    "cookie",
    "password",
    "passwd",
    "proxy-authorization",
    "refresh_token",
    "secret",
    "set-cookie",
    "token",
)
REDACTED = "[REDACTED]"

_CONTROL = r"[\x00-\x1f\x7f]"
_LANGUAGE = r"\A[A-Za-z]{2,3}(?:-[A-Za-z]{2})?\z"
_WORD = r"[\p{L}\p{N}_-]"
_VALUE = rf"[^{WS_CLASS},;}}\]]+"
_SECRET = (
    rf"(?iu)((?<!{_WORD})(?:{'|'.join(SENSITIVE_KEYS)})(?!{_WORD})"
    rf"[{WS_CLASS}]*[:=][{WS_CLASS}]*)"
    rf"(?:\"[^\n\"]*\"|'[^\n']*'|(?:Bearer|Basic)[{WS_CLASS}]+{_VALUE}|(?!%\(){_VALUE})"
)


def strip(value: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.btrim(value, F.lit(WHITESPACE))


def is_blank(value: Column) -> Column:
    return strip(value) == ""


def has_control(value: Column) -> Column:
    """True when a character below 32 or 127 is left inside."""
    return value.rlike(_CONTROL)


def present(value: Column) -> Column:
    """The value itself, unstripped, or null when it is null or blank."""
    return F.when(~is_blank(value), value)


def optional_text(value: Column) -> Column:
    """Stripped value, with blank turned into null. Test ``bad_text`` beside it."""
    return F.nullif(strip(value), F.lit(""))


def bad_text(value: Column) -> Column:
    """True when the stripped value holds a control character (null: false)."""
    return F.coalesce(has_control(strip(value)), F.lit(False))


def bad_required_text(value: Column) -> Column:
    """True when a required text is null, blank or holds a control character."""
    return F.coalesce(is_blank(value) | has_control(strip(value)), F.lit(True))


def language_tag(value: Column) -> Column:
    """``xx``/``xxx`` lower with an optional ``-YY`` upper; anything else is null."""
    region = F.upper(F.substring_index(value, "-", -1))
    return F.when(
        value.rlike(_LANGUAGE),
        F.when(
            F.contains(value, F.lit("-")),
            F.concat_ws("-", F.lower(F.substring_index(value, "-", 1)), region),
        ).otherwise(F.lower(value)),
    )


def ordered_distinct_text(values: Column) -> Column:
    """Strip every element, drop blanks, keep the first of equal ones in order."""
    stripped = F.transform(values, strip)
    return F.array_distinct(F.filter(stripped, lambda name: name != ""))


def redact_text(value: Column) -> Column:
    """Replace the value of every sensitive ``key: value`` or ``key=value`` pair."""
    return F.regexp_replace(value, F.lit(_SECRET), F.lit("$1" + REDACTED.replace("$", "\\$")))


def redact_map(values: Column) -> Column:
    """Replace the values of sensitive keys in a map; other entries stay as they are."""

    def fold(key: Column) -> Column:
        # The only case foldings beyond lower() that can produce a listed key.
        key = F.regexp_replace(key, "[\u00df\u1e9e]", "ss")
        return F.lower(F.regexp_replace(key, "\u017f", "s"))

    return F.transform_values(
        values,
        lambda key, value: F.when(
            fold(key).isin(*SENSITIVE_KEYS), F.lit(REDACTED)
        ).otherwise(value),
    )
