"""Log tables and streams as text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articlelake.functions.text import redact_text

# Levels by severity, and the line format.
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
SEPARATOR = " | "
NO_CORRELATION = "-"


def level_rank(level: Column) -> Column:
    ranks = F.create_map(*[F.lit(part) for pair in LEVELS.items() for part in pair])
    return F.try_element_at(ranks, F.upper(level))


def log_lines(events: DataFrame, level: str = "INFO") -> DataFrame:
    """Add ``line`` to the events at or above a level; works on batch and stream.

    time | level | logger | correlation | message, with secrets removed from the message
    and ``-`` for a missing correlation id. Another missing field is empty, so a line always
    has five fields. Events of an unknown or missing level have no rank and are kept.
    """
    correlation = F.coalesce(F.nullif(F.col("correlation_id"), F.lit("")), F.lit(NO_CORRELATION))
    fields = (
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssxx"),
        F.upper("level"),
        F.col("logger"),
        correlation,
        redact_text(F.col("message")),
    )
    line = F.concat_ws(SEPARATOR, *(F.coalesce(field, F.lit("")) for field in fields))
    shown = F.coalesce(level_rank(F.col("level")) >= LEVELS[level.upper()], F.lit(True))
    return events.where(shown).withColumn("line", line)
