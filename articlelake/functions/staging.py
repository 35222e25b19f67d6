"""Keeping an expensive column to one evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(frame: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns moved to the end and settled.

    A filter on a computed column is pushed towards the scan by copying the expression
    into it, and with columns built upon columns the copies multiply. A generator with
    one output row cannot be passed, so the filter stays above it and reads the value.
    """
    kept = [name for name in frame.columns if name not in names]
    return frame.select(*kept, F.inline(F.array(F.struct(*names))))
