"""Timestamp columns: reading ISO 8601 with an offset, and writing it.

A cast would accept date-only and zone-less strings, which must be refused, and would
refuse basic, hour-only, comma-fraction and week-date forms, which must be read. So the
string is cut by patterns, put into one plain form, and only then cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from articlelake.functions.urls import let_sql

# Instants of 0001-01-01T00:00:00Z and 9999-12-31T23:59:59.999999Z in microseconds.
MIN_MICROS = -62_135_596_800_000_000
MAX_MICROS = 253_402_300_799_999_999
_DAY_MICROS = 86_400_000_000

# A date, one separator character, the clock up to the first sign or Z, sign, offset.
# Calendar dates, then week dates; in compact week dates the separator may itself be a
# digit, and the length of the run decides.
_TEXT = (
    r"(?s)\A(\d{4})(?:-(\d\d)-(\d\d)|(\d\d)(\d\d)|-W(\d\d)-(\d)(?!\d)|-W(\d\d)"
    r"|W(\d\d)(?:(?!\d)|(?=\d(?:\d\d)++(?!\d)))"
    r"|W(\d\d)(\d)(?:(?!\d)|(?=\d(?:\d\d)*+(?!\d))))"
    r".([^+\-Z]*)([+\-])(.*)\z"
)
# year, month, day, week, weekday, clock, sign, offset
_TEXT_PARTS = "$1\\n$2$4\\n$3$5\\n$6$8$9$10\\n$7$11\\n$12\\n$13\\n$14"

# The clock with or without colons. It tolerates one stray ASCII character at its end,
# and any text after six digits of fraction; the offset tolerates neither.
_CLOCK = (
    r"(?s)\A(\d\d)(?:(?::(\d\d)(?::(\d\d))?)?(?:[.,](\d{1,5}|\d{6}.*)|[\x00-\x7f])?"
    r"|:(\d\d):(\d\d):(\d{1,5}|\d{6}.*)"
    r"|(\d\d)(\d\d)?(?:[.,](\d{1,5}|\d{6}.*)|[\x00-\x7f])?"
    r"|(\d\d)(\d\d)(\d{1,5}|\d{6}.*))\z"
)
_OFFSET = (
    r"\A(\d\d)(?:(?::(\d\d)(?::(\d\d))?)?(?:[.,](\d+))?"
    r"|:(\d\d):(\d\d):(\d+)"
    r"|(\d\d)(\d\d)?(?:[.,](\d+))?"
    r"|(\d\d)(\d\d)(\d{2,}))\z"
)
# hours, minutes, seconds, fraction
_CLOCK_PARTS = "$1\\n$2$5$8$11\\n$3$6$9$12\\n$4$7$10$13"


def _parts(value: str, pattern: str, parts: str) -> str:
    """SQL for the parts of a text that matches, as an array, else null."""
    cut = f"split(regexp_replace({value}, r'{pattern}', '{parts}'), '\\n')"
    return f"CASE WHEN {value} RLIKE r'{pattern}' THEN {cut} END"


def _micros(part: str) -> str:
    """SQL for the microseconds of ``[hh, mm, ss, fraction]``."""
    whole = " + ".join(
        f"{unit} * CAST(concat('0', {part}[{index}]) AS bigint)"
        for index, unit in enumerate((3_600_000_000, 60_000_000, 1_000_000))
    )
    return f"{whole} + CAST(rpad(left({part}[3], 6), 6, '0') AS bigint)"


def _day(part: str) -> str:
    """SQL for the date as days since the epoch, or null when it does not exist."""
    calendar = f"try_cast(concat_ws('-', {part}[0], {part}[1], {part}[2]) AS date)"
    week, weekday = f"CAST({part}[3] AS int)", f"CAST(coalesce(nullif({part}[4], ''), '1') AS int)"
    # The first week holds January 4th; a week belongs to the year of its Thursday.
    monday = "date_sub(j, weekday(j))"
    exists = (
        f"{week} BETWEEN 1 AND 53 AND {weekday} BETWEEN 1 AND 7 "
        f"AND year(date_add({monday}, 7 * {week} - 4)) = CAST({part}[0] AS int)"
    )
    week_day = let_sql(
        f"try_cast(concat({part}[0], '-01-04') AS date)",
        "j",
        f"CASE WHEN {exists} THEN date_add({monday}, 7 * {week} + {weekday} - 8) END",
    )
    day = f"CASE WHEN {part}[3] = '' THEN {calendar} ELSE {week_day} END"
    return let_sql(
        f"CASE WHEN {part}[0] >= '0001' THEN {day} END",
        "x",
        "CASE WHEN year(x) BETWEEN 1 AND 9999 THEN unix_date(x) END",
    )


def iso_micros_sql(value: str) -> str:
    """SQL for the microseconds of an ISO 8601 text with an offset, else null."""
    # A line break can only be a separator or a stray character; any letter reads alike.
    flat = f"translate({value}, '\\n', 'x')"
    zulu = f"IF({flat} RLIKE r'[Zz]\\z', concat(left({flat}, length({flat}) - 1), '+00:00'), {flat})"
    clock = let_sql(
        _parts("p[5]", _CLOCK, _CLOCK_PARTS),
        "c",
        f"CASE WHEN c[0] <= '23' AND c[1] <= '59' AND c[2] <= '59' THEN {_micros('c')} END",
    )
    offset = let_sql(
        let_sql(_parts("p[7]", _OFFSET, _CLOCK_PARTS), "o", _micros("o")),
        "z",
        f"CASE WHEN z < {_DAY_MICROS} THEN IF(p[6] = '-', -z, z) END",
    )
    instant = f"{_day('p')} * {_DAY_MICROS} + {clock} - {offset}"
    return let_sql(let_sql(zulu, "s", _parts("s", _TEXT, _TEXT_PARTS)), "p", instant)


def iso_micros(texts: str) -> Column:
    """``iso_micros_sql`` of every element of an array column.

    A result may lie outside the years 1 to 9999 by less than a day; see ``in_range``.
    """
    return F.expr(f"transform({texts}, v -> {iso_micros_sql('v')})")


def in_range(micros: Column) -> Column:
    """True when the instant falls into the years 1 to 9999 (null: true)."""
    return F.coalesce(micros.between(MIN_MICROS, MAX_MICROS), F.lit(True))


def to_timestamp(micros: Column) -> Column:
    return F.timestamp_micros(F.when(in_range(micros), micros))


def iso_text(value: Column) -> Column:
    """ISO 8601 in UTC with ``+00:00``; microseconds only when they are not zero."""
    micros = F.unix_micros(value)
    utc = F.to_utc_timestamp(value, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(
        F.when(F.pmod(micros, F.lit(1_000_000)) == 0, whole).otherwise(fraction),
        F.lit("+00:00"),
    )
