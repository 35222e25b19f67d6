"""Left joins to lookup tables that hold at most one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articlelake.functions.staging import once
from articlelake.session import stored

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
#: Rows, and bytes of joined rows, of one key that one task takes; a key of more is split.
HOT_ROWS = 5_000_000
HOT_BYTES = 2 * 1024 * 1024 * 1024
#: Cells of each of the two hashes of a sketch of loads; as many at most come to the driver.
SKETCH_CELLS = 16_384


def fits_broadcast(
    frame: DataFrame,
    *,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> bool:
    """Measure a stored table; every task sends two numbers, no rows move."""
    size = F.octet_length(F.to_json(F.struct("*")))
    rows, width = frame.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and width <= max_bytes


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    spread: str,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join that broadcasts ``right`` only after measuring it.

    Beyond the bound the join shuffles and spreads hot keys (``skewed_left_join``). The keys
    of a stream cannot be counted; give this function its batches instead.
    """
    # A settled key keeps the optimizer from tracing it through the whole plan below.
    left = once(left, key)
    if fits_broadcast(right, max_rows=max_rows, max_bytes=max_bytes):
        return left.join(F.broadcast(right), key, "left")
    if left.isStreaming:
        return left.join(right, key, "left")
    hot = hot_keys(left, key, hot_rows=hot_rows)
    return skewed_left_join(left, right, key, spread=spread, hot=hot)


def hot_keys(
    frame: DataFrame,
    key: str,
    *,
    hot_rows: int = HOT_ROWS,
    weight: Column | None = None,
    sizes: DataFrame | None = None,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame | None:
    """Keys that one task should not take alone, with ``_salts``, the tasks that share them.

    ``weight`` is the bytes of a row of ``frame``. ``sizes`` has ``key`` and ``_bytes`` of the
    row that each key is joined to. A key is hot by its rows, by their own bytes or by the
    bytes joined to them. The result is a stored table, or None when it is empty.

    A sketch of fixed size comes first: rows and bytes are summed in tasks by two hashes of
    the key, and a key can only be hot if both of its cells are. Usually no cell is, and
    nothing else runs. Else only keys of hot cells are counted, exactly.
    """
    own = F.lit(0).cast("long") if weight is None else F.coalesce(weight.cast("long"), F.lit(0).cast("long"))
    loaded = frame.where(F.col(key).isNotNull()).select(key, own.alias("_own"))
    cells = [F.pmod(F.xxhash64(F.lit(hashed), F.col(key)), F.lit(SKETCH_CELLS)).alias(f"_cell_{hashed}") for hashed in (0, 1)]
    load = F.greatest(F.col("_rows") / hot_rows, F.col("_sum") / hot_bytes)
    largest = None
    if sizes is not None:
        # What one key is joined to is at most the largest of all.
        largest = sizes.agg(F.max("_bytes")).first()[0] or 0
        load = F.greatest(load, F.col("_rows") * F.lit(float(largest)) / hot_bytes)
    counted = [F.count(F.lit(1)).alias("_rows"), F.sum("_own").alias("_sum")]
    sketch = (
        loaded.select("_own", F.posexplode(F.array(*cells)).alias("_hash", "_cell"))
        .groupBy("_hash", "_cell").agg(*counted).where(load > 1).select("_hash", "_cell")
    )
    found = [(row["_hash"], row["_cell"]) for row in sketch.collect()]
    if not {0, 1} <= {hashed for hashed, _ in found}:
        return None
    possible = loaded.select("*", *cells)
    for hashed in (0, 1):
        hot_cells = frame.sparkSession.createDataFrame([(cell,) for at, cell in found if at == hashed], f"_cell_{hashed} long")
        possible = possible.join(F.broadcast(hot_cells), f"_cell_{hashed}", "left_semi")
    counts = possible.groupBy(key).agg(*counted)
    load = F.greatest(F.col("_rows") / hot_rows, F.col("_sum") / hot_bytes)
    if sizes is not None:
        counts = counts.join(sizes, key, "left")
        load = F.greatest(load, F.col("_rows") * F.coalesce("_bytes", F.lit(0)) / hot_bytes)
    split = counts.withColumn("_salts", F.ceil(load).cast("int")).where(F.col("_salts") > 1)
    hot = stored(split.select(key, "_salts"), "hot-keys")
    return None if hot.isEmpty() else hot


def skewed_left_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    spread: str,
    hot: DataFrame | None,
) -> DataFrame:
    """Shuffled left join on a string key in which the ``hot`` keys are salted.

    ``spread`` names the left column that decides the salt; it comes from the row, so a
    task that runs again gives the same salt. Only the right rows of hot keys are
    copied. Null keys match nothing, and are spread by the same column. Without hot keys
    the join uses the key alone, and so reuses a partitioning that ``right`` already has.
    """
    marked = F.concat(F.lit("\x00"), F.xxhash64(spread).cast("string"))
    keyed = left.withColumn("_left_key", F.coalesce(F.col(key), marked))
    renamed = right.withColumnRenamed(key, "_right_key")
    match = (F.col("_left_key") == F.col("_right_key")) & F.col(key).isNotNull()
    if hot is not None:
        listed = F.broadcast(hot) if fits_broadcast(hot) else hot
        salts = F.coalesce("_salts", F.lit(1))
        keyed = keyed.join(listed, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts))
        renamed = renamed.join(
            listed.withColumnRenamed(key, "_right_key"), "_right_key", "left"
        ).withColumn("_right_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        keyed, renamed = keyed.drop("_salts"), renamed.drop("_salts")
        match = match & (F.col("_salt") == F.col("_right_salt"))
    return keyed.join(renamed, match, "left").drop(
        "_left_key", "_right_key", "_salt", "_right_salt"
    )
