"""Session helpers: shipping the package and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on executors. No other setting of the session changes."""
    if spark.conf.get("spark.articlelake.shipped", "") != spark.sparkContext.applicationId:
        spark.sparkContext.addPyFile(_package_zip())
        spark.conf.set("spark.articlelake.shipped", spark.sparkContext.applicationId)
    return spark


def _package_zip() -> str:
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="articlelake-"), "articlelake.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    return target


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables and stream state that all executors can reach.

    It lies under ``spark.checkpoint.dir``. Only a local session may go without that
    setting; it then gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", ""
    )
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="articlelake-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a lookup table once to the shared scratch folder and read it back.

    A lookup is measured and then joined; stored, it is computed once for both, and the
    plans that use it start from a scan.
    """
    path = scratch_folder(frame.sparkSession, name)
    frame.write.option("compression", compression).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
