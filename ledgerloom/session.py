"""Session construction and the few settings the plans rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerloom", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use.

    On a cluster the caller brings its own session; no plan depends on more than
    UTC as session time zone and adaptive execution being on (both Spark defaults
    apart from the zone, which :func:`prepare` sets).
    """
    return prepare(
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LEDGERLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Set what every plan needs on a session made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One driver table, a file or a folder of part files."""
    return prepare(spark).read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; where that is unset, as in
    tests, a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = os.path.join(tempfile.gettempdir(), "ledgerloom-shared")
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: worked out once, whatever reads it and
    whichever executor is lost. For small results that several branches of a plan read."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
