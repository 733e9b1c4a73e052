"""Planning tables as Parquet: reading, appending, replacing, and cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession


def read(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Chosen columns of rows that meet a condition; both reach the scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def append(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def replace(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Replaces a table, or with ``by`` only the partitions that ``df`` has rows of (such as a run's)."""
    writer = df.write.mode("overwrite").partitionBy(*by)
    if by:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def create_workspace(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `ws_{_slug(name)}`")


def drop_workspace(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS `ws_{_slug(name)}` CASCADE")


def _slug(name: str) -> str:
    out = "".join(c if c.isalnum() and c.isascii() else "_" for c in name.lower()).strip("_")[:40]
    if not out:
        raise ValueError("a workspace needs a name with letters or digits")
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset (tests), a local one is made, once a session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, written to the shared folder."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
