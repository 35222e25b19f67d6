"""Hostname rules. Three rule sets exist side by side and are not interchangeable.

* ``profile_host``: a domain declared by, or looked up in, a source profile.
* ``article_host``: the host of an URL inside an article.
* ``parser_domain``: a domain handed to a parser as its boundary.

Each returns the normal form, or null when the host is refused.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articlelake.functions.text import WS_CLASS, has_control, strip

# The repeated group is possessive: Java then loops instead of recursing, so a host
# with very many labels cannot overflow the stack of a task.
LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
HOSTNAME = rf"\A(?:{LABEL}\.)++{LABEL}\z"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_IPV4_HOST = rf"\A{IPV4}\z"
_LOCAL = r"(?:\A|\.)localhost\z|\.(?:home|internal|lan|local)\z"
_OUTER_SPACE = rf"\A[{WS_CLASS}]|[{WS_CLASS}]\z"


def _encode_idna(host: str | None) -> str | None:
    if host is None:
        return None
    try:
        return host.encode("idna").decode("ascii").lower()
    except UnicodeError:
        return None


@F.arrow_udf(T.StringType())
def _idna_ascii(hosts: pa.Array) -> pa.Array:
    """ASCII form of international hostnames; null where IDNA refuses one."""
    return pa.array([_encode_idna(host) for host in hosts.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _idna_ascii_lists(lists: pa.Array) -> pa.Array:
    encoded = [
        None if hosts is None else [_encode_idna(host) for host in hosts]
        for hosts in lists.to_pylist()
    ]
    return pa.array(encoded, pa.list_(pa.string()))


def is_ascii(value: Column) -> Column:
    return F.length(value) == F.octet_length(value)


def _bare(value: Column) -> Column:
    """The host without trailing dots, null when it holds anything but a host."""
    bare = F.rtrim(value, F.lit("."))
    refused = value.rlike(_OUTER_SPACE) | value.rlike(r"[\x00-\x1f/?#@:*\\]")
    return F.when(~refused & (bare != ""), bare)


def _public(host: Column) -> Column:
    ok = ~host.rlike(_IPV4_HOST) & (F.length(host) <= 253) & host.rlike(HOSTNAME)
    return F.when(ok & ~host.rlike(_LOCAL), host)


def profile_host(value: Column, *, idna: bool = True) -> Column:
    """Normal form of one host.

    Only non-ASCII hosts reach Python; all others pass it as null. ``idna=False`` keeps
    the plan on the JVM for tables known to hold ASCII hosts, and refuses the rest.
    """
    bare = _bare(value)
    ascii_form = F.when(is_ascii(bare), F.lower(bare))
    if idna:
        ascii_form = F.coalesce(ascii_form, _idna_ascii(F.when(~is_ascii(bare), bare)))
    return _public(ascii_form)


def profile_hosts(values: Column) -> Column:
    """``profile_host`` of every element of a list; refused elements become null."""
    bare = F.transform(values, _bare)
    foreign = F.exists(bare, lambda host: F.coalesce(~is_ascii(host), F.lit(False)))
    encoded = F.coalesce(
        _idna_ascii_lists(F.when(foreign, bare)), F.transform(bare, F.lower)
    )
    return F.transform(encoded, _public)


def article_host(value: Column) -> Column:
    stripped = strip(value)
    host = F.rtrim(F.lower(stripped), F.lit("."))
    return F.when(
        ~has_control(stripped) & ~host.rlike(_IPV4_HOST) & host.rlike(HOSTNAME), host
    )


def parser_domain(value: Column) -> Column:
    host = F.rtrim(F.lower(strip(value)), F.lit("."))
    return F.when(host.rlike(HOSTNAME), host)
