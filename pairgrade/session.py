"""Session helpers.

The library never builds a session by itself: every operator takes
DataFrames.  These helpers are for tests, the benchmark and small jobs.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  name: str = "pairgrade") -> SparkSession:
    """Local session with the settings the library expects of a cluster."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "16m")
        .config("spark.driver.memory", os.environ.get("PAIRGRADE_DRIVER_MEM", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the
    session, else the warehouse; a cluster without either has none, since a
    folder of one machine is not seen by the others."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    folder = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and folder.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share; the warehouse is a local folder")
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    For inputs that several passes read: later passes scan pruned columns of
    a table with known size instead of recomputing the plan, and a lost
    executor costs nothing.
    """
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, column: str) -> tuple[DataFrame, Callable[[Iterable], DataFrame]]:
    """``df`` written once with a folder for each value of ``column``, for passes that each need a few values: the table,
    and a function that reads the folders of some values that occur, without ``column``, and nothing else."""
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    rest = df.drop(column).schema
    return df.sparkSession.read.schema(df.schema).parquet(path), lambda values: df.sparkSession.read.schema(rest).parquet(*[f"{path}/{column}={v}" for v in values])


def drop_table(table: DataFrame) -> None:
    """Delete a table that ``materialize`` or ``materialize_by`` wrote, once nothing reads it again."""
    spark = table.sparkSession
    home = _tables(spark)
    for f in table.inputFiles()[:1]:
        name = f.split(f"{home.split(':', 1)[-1].rstrip('/')}/")[-1].split("/")[0]
        if re.fullmatch("[0-9a-f]{32}", name):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{name}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _tables(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/pairgrade/{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> bool:
    """Delete the intermediate tables of this application, for use when its results are written; DataFrames that read
    them end.  False where there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
