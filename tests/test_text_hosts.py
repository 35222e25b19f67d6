"""Text, redaction and host rules, each value table as one Spark job."""

import re
import sys

import pytest
from pyspark.sql import functions as F

from articlelake.functions import hosts, text
from articlelake.operators import profiles


def column(spark, values, expression, kind="string"):
    rows = list(enumerate(values))
    frame = spark.createDataFrame(rows, f"n int, v {kind}")
    return [row[0] for row in frame.orderBy("n").select(expression(F.col("v"))).collect()]


def test_strip_equals_python_over_all_white_space(spark):
    spaces = [chr(code) for code in range(sys.maxunicode + 1) if chr(code).isspace()]
    assert set(text.WHITESPACE) == set(spaces)
    values = ["".join(spaces) + "a b" + "".join(reversed(spaces)), "\u200ba", "", " "]
    assert column(spark, values, text.strip) == [value.strip() for value in values]
    inside = re.compile(f"[{text.WS_CLASS}]")
    assert all(inside.match(space) for space in spaces)


def test_required_and_optional_text(spark):
    values = ["", " ", "unsafe\nheadline", "unsafe\0headline", "a\x7fb", "\n fine \t", None]
    assert column(spark, values, text.bad_required_text) == [True, True, True, True, True, False, True]
    assert column(spark, values, text.bad_text) == [False, False, True, True, True, False, False]
    assert column(spark, values, text.optional_text)[-2:] == ["fine", None]


def test_language_tags(spark):
    values = ["EN", "en-us", "ID-id", "eng", "e", "engl", "en-USA", "en_US", " en", "en\n", None]
    want = ["en", "en-US", "id-ID", "eng", None, None, None, None, None, None, None]
    assert column(spark, values, text.language_tag) == want


# message and what is left of it
MESSAGES = [
    ('login failed for ola, password = s3same',
     'login failed for ola, password = [REDACTED]'),
    ('retry with Token:q9/xx; next',
     'retry with Token:[REDACTED]; next'),
    ("secret='two words' kept",
     'secret=[REDACTED] kept'),
    ('cookie="a b" path=/',
     'cookie=[REDACTED] path=/'),
    ('authorization=Basic QWxh, host=x',
     'authorization=[REDACTED], host=x'),
    ('AUTHORIZATION : bearer zz.yy.xx]',
     'AUTHORIZATION : [REDACTED]]'),
    ('the cookies are fine and so is a secretary',
     'the cookies are fine and so is a secretary'),
    ('passwordless=1 tokens=2',
     'passwordless=1 tokens=2'),
    ('password=%(pw)s stays',
     'password=%(pw)s stays'),
    ('x-token=1 _secret=2 cookie-jar=3',
     'x-token=1 _secret=2 cookie-jar=3'),
    ('{token: 12, secret: 34}',
     '{token: [REDACTED], secret: [REDACTED]}'),
    ('secret=',
     'secret='),
    ('token="" and token=\'\'',
     'token=[REDACTED] and token=[REDACTED]'),
    ("token='open end",
     'token=[REDACTED] end'),
    ('a=1 password=p\nb=2',
     'a=1 password=[REDACTED]\nb=2'),
    ('Password\t=\tp tail',
     'Password\t=\t[REDACTED] tail'),
    ('set-cookie: id=7; Path=/',
     'set-cookie: [REDACTED]; Path=/'),
    ('api_key=k1 api-key=k2 apikey=k3',
     'api_key=[REDACTED] api-key=[REDACTED] apikey=[REDACTED]'),
    ('refresh_token = r, access_token = t',
     'refresh_token = [REDACTED], access_token = [REDACTED]'),
    ('client_secret=c}',
     'client_secret=[REDACTED]}'),
    ('proxy-authorization: Bearer abc',
     'proxy-authorization: [REDACTED]'),
    ('TOKEN=kelvin ſecret=long',
     'TOKEN=[REDACTED] ſecret=[REDACTED]'),
    ('token\x1c=\x1fv',
     'token\x1c=\x1f[REDACTED]'),
    ('',
     ''),
]


def test_redacted_text(spark):
    got = column(spark, [given for given, _ in MESSAGES], text.redact_text)
    assert got == [left for _, left in MESSAGES]


def test_redacted_maps_fold_case(spark):
    given = {"password": "x", "user": "alice", "Paßword": "x", "TOKEN": "x", "ſecret": "x", "api key": "y"}
    frame = spark.createDataFrame([(given,)], "m map<string,string>")
    got = frame.select(text.redact_map(F.col("m"))).first()[0]
    assert got == {
        key: "[REDACTED]" if key.casefold() in text.SENSITIVE_KEYS else value
        for key, value in given.items()
    }


REFUSED = [
    "", "http://paper.example", "paper.example:80", "paper.example/a", "paper.example?b", "paper.example#c",
    "me@paper.example", "paper.*", "-paper.example", "paper-.example", "localhost", "10.1.2.3", "fe80::1",
    "paper.example ", "\tpaper.example", "paper\\x.example", ".", "paper..example", "paper.example\r", "p" * 70 + ".example",
]


def test_profile_hosts(spark):
    values = REFUSED + ["service.local", "service.internal", "a.localhost", "my.lan", "x.home"]
    values += [".".join(["a" * 60] * 5), "b\u00fccher\u3002.example", "ü" * 64 + ".example"]
    assert column(spark, values[:-2], hosts.profile_host) == [None] * len(values[:-2])
    good = ["NEWS.EXAMPLE.", "münchen.example", "MÜNCHEN.EXAMPLE.", "256.1.1.1", "locals.example"]
    want = ["news.example", "xn--mnchen-3ya.example", "xn--mnchen-3ya.example", "256.1.1.1", "locals.example"]
    assert column(spark, good, hosts.profile_host) == want
    assert column(spark, good, lambda v: hosts.profile_host(v, idna=False))[1:3] == [None, None]
    assert column(spark, [good, None, [None]], hosts.profile_hosts, "array<string>") == [want, None, [None]]


def test_article_and_parser_hosts_differ(spark):
    values = [" NEWS.Example. ", "service.local", "127.0.0.1", "münchen.example", "localhost", "a b.example"]
    assert column(spark, values, hosts.article_host) == ["news.example", "service.local", None, None, None, None]
    assert column(spark, values, hosts.parser_domain) == ["news.example", "service.local", "127.0.0.1", None, None, None]
    long_host = "a." * 30_000 + "example"
    assert column(spark, [long_host], hosts.article_host) == [long_host]


def test_identifiers(spark):
    good = ["daily", "daily_post", "z", "lives_9", "q" * 64, "a1_b2", "daily_", "two__lines"]
    bad = ["Daily", "9_lives", "daily-post", "daily.post", "daily post", "_daily", "daily\n", "q" * 65, ""]
    got = column(spark, [*good, *bad, None], profiles.is_identifier)
    assert got[: len(good)] == [True] * len(good) and not any(got[len(good) :])
    assert column(spark, ["p__q", "q_", "7up", "\tz ", "p_q", "P"], profiles.article_source) == [
        None, None, "7up", "z", "p_q", None,
    ]


SCHEMA = "source string, domains array<string>, parser_family string, adapter_key string, enabled boolean, position int"


def profile(source="example", domains=("news.example",), family="jsonld_article", key=None, enabled=True, position=0):
    return (source, list(domains), family, key, enabled, position)


def test_validation_and_registry_order(spark):
    rows = [
        profile("b", ["NEWS.EXAMPLE.", "regional.news.example", "news.example"], position=1),
        profile("a", ["a.example"], enabled=False, position=0),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert [row["source"] for row in profiles.registry(frame).collect()] == ["a", "b"]
    checked = {row["source"]: row for row in profiles.validate_profiles(frame).collect()}
    assert checked["b"]["domains"] == ["news.example", "regional.news.example"]
    for bad, message in [
        (profile("b", ["x.example"]), "two profiles are named"),
        (profile("c", ["A.example"]), "two profiles own the host"),
        (profile("c", []), "domains_invalid"),
        (profile("c", ["d.example"], key="Bad"), "adapter_key_invalid"),
    ]:
        with pytest.raises(ValueError, match=message):
            profiles.registry(spark.createDataFrame([*rows, bad], SCHEMA))


def test_url_lookup_is_exact_and_scales(spark):
    rows = [profile(f"source_{n}", [f"news-{n}.example"], position=n) for n in range(0, 3000, 3)]
    hosts_table = profiles.profile_hosts(spark.createDataFrame(rows, SCHEMA)).select(
        "profile_host", F.col("source").alias("found")
    )
    cases = {
        "https://NEWS-6.EXAMPLE/x?y=2": "source_6", "https://news-2997.example./b#t": "source_2997",
        "https://sub.news-6.example/": None, "http://news-6.example/": None,
        "https://who:ever@news-6.example/": None, "/relative": None, "https:///a": None,
        "https://news-6.example:bad/": None, "https://news-6.example:8443/": "source_6",
        "": None, " https://news-6.example/": None, "https://news-6.example/ ": None,
    }
    frame = spark.createDataFrame([(url,) for url in cases], "url string")
    got = {row["url"]: row["found"] for row in profiles.resolve_by_url(frame, "url", hosts_table).collect()}
    assert got == cases
