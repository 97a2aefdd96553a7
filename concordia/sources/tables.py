"""Table readers. Only Spark opens paths, so any store it knows will do; columns and filters reach the scan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a session on one machine that names no shared folder, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table with the place of each row: ``_file`` and ``_row``, which don't depend on how files are split.

    Spark gives a path as a URI, in which a blank, # or % is coded and would be ordered as another character is.
    """
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return table(spark, sf_dir, name).select(*columns, path.alias("_file"), F.col("_metadata.row_index").alias("_row"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a session on one machine gets a local folder; on a cluster that is an error, as
    each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder shared by driver and executors (master {master})")
    spark.sparkContext.setCheckpointDir(LOCAL_FOLDER)
    return f"file://{LOCAL_FOLDER}"
