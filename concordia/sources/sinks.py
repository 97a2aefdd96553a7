"""Sinks: a folder that appears whole or not at all, named below one base, as Parquet or as JSON for inspection."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def artifact_path(base: str, *names: str) -> str:
    """A place below ``base``. Names that would lead out of it, or that hide something, are refused."""
    for name in names:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name) or ".." in name:
            raise ValueError(f"not a name of an artifact: {name!r}")
    return "/".join([base.rstrip("/"), *names])


def write_whole(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Writes beside ``path`` and renames, so a reader sees the old rows or all of the new ones; what failed leaves
    nothing behind. Returns the stored rows."""
    spark = df.sparkSession
    fresh = f"{path}.{uuid.uuid4().hex}.new"
    try:
        df.write.format(fmt).options(**options).save(fresh)
        _replace(spark, fresh, path)
    except Exception:
        _files(spark, fresh)[0].delete(_files(spark, fresh)[1], True)
        raise
    return spark.read.schema(df.schema).format(fmt).options(**options).load(path)


def write_debug(df: DataFrame, path: str) -> DataFrame:
    """The rows as JSON lines, nulls included, for people to read."""
    return write_whole(df, path, "json", ignoreNullFields="false")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _replace(spark: SparkSession, fresh: str, path: str) -> None:
    fs, source = _files(spark, fresh)
    _, target = _files(spark, path)
    _, old = _files(spark, f"{path}.{uuid.uuid4().hex}.old")
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"can't set aside {path}")
    if not fs.rename(source, target):
        if fs.exists(old):
            fs.rename(old, target)
        raise OSError(f"can't store {path}")
    fs.delete(old, True)
