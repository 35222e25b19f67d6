"""Tables of numbered versions, each made visible by its manifest.

A version is a list of data folders. A commit writes its rows to a folder of its own, and
then a manifest that names the folders of the version: those of the version before and the
new one, or the new one alone. Readers see a version whole or not at all, and one that pins
a number is not disturbed by later commits or by compaction, which commits a version of its
own and removes nothing. There is one writer at a time; its manifests are tiny files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "batch bigint, folders array<string>, version int"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The manifests: ``version, batch, folders``; no rows before the first commit."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/versions")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], _MANIFEST)
        raise


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Row | None:
    """One manifest, by default the latest."""
    listed = versions(spark, path)
    if version is not None:
        listed = listed.where(F.col("version") == version)
    return listed.orderBy(F.col("version").desc()).first()


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version with ``added``, the version that wrote them; None if there is none."""
    found = manifest(spark, path, version)
    if found is None:
        return None
    data = f"{path}/data"
    rows = spark.read.option("basePath", data).parquet(*(f"{data}/{name}" for name in found["folders"]))
    return rows.withColumn("added", F.col("added").cast("int"))


def commit(frame: DataFrame, path: str, *, replace: bool = False, batch: int | None = None) -> int:
    """Write rows as a new version and return its number.

    ``replace`` leaves the rows of earlier versions out. A ``batch`` that some version already
    holds is not written again, so a stream may repeat its last batch.
    """
    spark = frame.sparkSession
    last = manifest(spark, path)
    if batch is not None:
        done = versions(spark, path).where(F.col("batch") >= batch).agg(F.min("version")).first()[0]
        if done is not None:
            return done
    number = 0 if last is None else last["version"] + 1
    # A folder left by a failed commit of this number is replaced.
    frame.write.mode("overwrite").parquet(f"{path}/data/added={number}")
    kept = [] if replace or last is None else list(last["folders"])
    row = spark.createDataFrame([(batch, [*kept, f"added={number}"])], "batch bigint, folders array<string>")
    row.coalesce(1).write.mode("overwrite").json(f"{path}/versions/version={number}")
    return number
