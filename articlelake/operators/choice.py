"""Choosing one row per key of a table with wide rows, on its narrow columns alone.

The winners' places (file and row number) come from a partial aggregation over narrow
columns, so the scan of that pass leaves wide columns unread. Places become bit maps, one of
4 KiB for each file and 32,768 rows, and the second scan keeps the rows whose bit is set. Bit
maps are broadcast only if they fit (an eighth of a byte per row of the table), so wide
values are neither sorted nor shuffled; beyond that, rows meet their bit map in a shuffled
hash join that holds only bit maps in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articlelake.operators.joins import MAX_BROADCAST_BYTES, fits_broadcast
from articlelake.session import stored

#: Rows of a bit map; fixed by ``bitmap_construct_agg``.
MAP_ROWS = 32768


def first_rows(
    table: DataFrame,
    key: str,
    order: dict[str, Column],
    *,
    in_files: bool = False,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """The first row of every ``key`` by ``order``; rows of a null key are one group.

    ``order`` names narrow columns; ties go by the place in the files. ``in_files`` says that
    ``table`` is a scan of Parquet files, filtered or projected at most. Any other frame is
    stored first, because its rows have no place. The result is partitioned like the files.
    """
    if not in_files:
        table = stored(table, "choice")
    columns = table.columns
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    narrow = table.select(F.col(key).alias("_key"), *(c.alias(f"_by_{n}") for n, c in order.items()), *place)
    ranked = F.min(F.struct(*(f"_by_{n}" for n in order), "_file", "_row")).alias("_first")
    winners = narrow.groupBy("_key").agg(ranked).select("_first._file", "_first._row")
    maps = winners.groupBy("_file", F.expr(f"_row div {MAP_ROWS}").alias("_block")).agg(
        F.bitmap_construct_agg(F.col("_row") % MAP_ROWS).alias("_bits")
    )
    maps = stored(maps, "choice-maps")
    placed = table.select("*", *place).withColumn("_block", F.expr(f"_row div {MAP_ROWS}"))
    small = fits_broadcast(maps, max_bytes=max_bytes, max_rows=max_bytes)
    met = placed.join(F.broadcast(maps) if small else maps.hint("shuffle_hash"), ["_file", "_block"])
    return met.where(_bit_set(F.col("_bits"), F.col("_row") % MAP_ROWS)).select(*(F.col(f"`{c}`") for c in columns))


def _bit_set(bits: Column, position: Column) -> Column:
    """Whether a bit of a map is set; the lowest bit of the first byte is position 0."""
    byte = F.substring(bits, F.expr("1") + F.shiftright(position, 3).cast("int"), F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    powers = F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (position % 8).cast("int") + 1)
    return value.bitwiseAND(powers) != 0
