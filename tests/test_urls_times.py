"""URL cutting and ISO timestamps against the interpreter, with random mutations."""

import random
from datetime import datetime
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from articlelake.functions import times, urls

STAMPS = """2026-08-06T12+07|2026-08-06T12.5+07:00|2026-08-06T12:30.5+07:00|2026-08-06T123045123+07:00
2026-08-06T12:+07:00|2026-08-06T12:30:45.123456abc+07:00|2026-08-06T12:30:45.1234567+07:00
2026-08-06T24:00:00+07:00|2026-08-06T12:30+07:99|2026-08-06T12:30+24:00|2026-08-06T12:30+23:59:59.999999
2026-08-06T12:30+0700|2026-08-06T12:30+07.5|2026-W32-4T12:30+07:00|2026W324T12:30+07:00|2026-W32T12+00:00
2026W32 12+00|2026-W54-1T12+00|2026-08-06T12:30:45Z|2026-08-06T12:30:45z|2020-W53-7T12:30:00Z
0001-01-01T00:00+01:00|9999-12-31T23:59:59-01:00|0000-01-01T00:00Z|2026-02-29T00:00Z|2024-02-29é10:00Z
2026-08-06T12:30:45:123+07:00| 2026-08-06T12:30+07:00|2026W3211230+07|2026W32112+07|2026W32511230+07
2026-W32-12:30+07:00|0001-W01-1T00Z|9999-W52-7T00Z|20260806T123045Z|2026-08-06|2026-08-06T12:30:45""".replace(
    "\n", "|"
).split("|")
URLS = """https://news.example/a?b#c|HTTP://User@Host.Example:080/x|https://@h/|https://h/#|https://[::1]:80/
https://[::1/|https://a]b/|https://x[::1]y:9/|https://[v1.x]/|https://[1.2.3.4]/|https://[fe80::1%25eth0]/
https://h:99999/|https://h:8a/|https://h:/|//h/p|mailto:x@y|https:///p|https://h h/|https://bücher.example/p
https://my_host.example/%zz|https://h%41B/|a:b|1a:b|https://[1:2:3:4:5:6:7::]/|https://[::ffff:1.2.3.4]:1/
https://[1::2::3]/|https://u:p@h@k:1/|https://h:00000000000000000080/|https://h:65535|https://h:65536
http://a/b;c?d;e#f#g?h|https://h/?|https://H.EXAMPLE./""".replace("\n", "|").split("|") + [
    "", "  https://h/p\n", "https://h\uff1a80/", "https://\u24d0\uff0fb/", "https://\u0130x.example/",
]


def mutated(base, letters, count, rng):
    out = list(base)
    for _ in range(count):
        text = list(rng.choice(base))
        for _ in range(rng.randint(1, 2)):
            action, at, letter = rng.random(), rng.randint(0, len(text)), rng.choice(letters)
            if action < 0.4:
                text[at : at + 1] = letter
            elif action < 0.7:
                text.insert(at, letter)
            else:
                del text[at : at + 1]
        out.append("".join(text))
    return out


def expected_micros(text):
    if not text.strip():
        return None
    try:
        parsed = datetime.fromisoformat(text[:-1] + "+00:00" if text.endswith(("Z", "z")) else text)
    except ValueError:
        return None
    if parsed.utcoffset() is None:
        return None
    delta = parsed.replace(tzinfo=None) - datetime(1970, 1, 1) - parsed.utcoffset()
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def test_iso_timestamps(spark):
    texts = mutated(STAMPS, "0123456789:.,+-ZzWT xé\n", 8000, random.Random(1))
    rows = [(text, expected_micros(text)) for text in texts]
    assert sum(want is not None for _, want in rows) > 800
    frame = spark.createDataFrame(rows, "text string, want bigint")
    got = frame.withColumn("got", times.iso_micros("array(text)")[0])
    assert got.where(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


def test_iso_text(spark):
    frame = spark.sql(
        "select timestamp'2026-08-06 05:30:00Z' a, timestamp'2026-08-06 05:30:00.25Z' b"
    )
    row = frame.select(times.iso_text(F.col("a")).alias("a"), times.iso_text(F.col("b")).alias("b")).first()
    assert tuple(row) == ("2026-08-06T05:30:00+00:00", "2026-08-06T05:30:00.250000+00:00")


def expected_parts(url):
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError:
        return None
    return (
        parts.scheme, parts.netloc, parts.path, parts.query, parts.fragment,
        parts.username is not None, parts.hostname, port,
    )


def test_url_parts(spark):
    texts = mutated(URLS, "[]:@/?#%.a1:0 \t\nZf\uff05\uff20?", 6000, random.Random(2))
    rows = urls.with_url(spark.createDataFrame([(u,) for u in texts], "u string"), "u", "p").collect()
    for row in rows:
        part = row["p"]
        got = (
            part["scheme"], part["netloc"], part["path"], part["query"], part["fragment"],
            part["has_userinfo"], part["host"], part["port"],
        )
        want = expected_parts(row["u"])
        assert (got if part["valid"] else None) == want, row["u"]
