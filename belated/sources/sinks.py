"""Sinks, stage tables, optional and globbed sources, fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report as one CSV file with a header: only for tables of a few rows."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A parquet table, or None where there is none; see ``prepare.joined``."""
    return spark.read.parquet(path) if exists(spark, path) else None


def cached_stage(spark: SparkSession, path: str, make) -> DataFrame:
    """The stage's table, made by ``make()`` where it was not yet written whole."""
    if not exists(spark, f"{path}/_SUCCESS"):
        write_parquet(make(), path)
    return spark.read.parquet(path)


def results(spark: SparkSession, pattern: str) -> DataFrame:
    """All CSV reports that match, with the file of each row."""
    return spark.read.csv(pattern, header=True, inferSchema=True).withColumn("file", F.input_file_name())


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    """A fitted pipeline or model, of the class that wrote it."""
    from pyspark.ml.util import DefaultParamsReader
    from pyspark.sql import SparkSession as S

    meta = DefaultParamsReader.loadMetadata(path, S.getActiveSession())
    module, name = meta["class"].replace("org.apache.spark.ml", "pyspark.ml").rsplit(".", 1)
    import importlib

    return getattr(importlib.import_module(module), name).load(path)
