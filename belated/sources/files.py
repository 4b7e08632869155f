"""Whitespace text, TSV, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whitespace_rows(lines: DataFrame, names: list[str], least: int = 6) -> DataFrame:
    """``value`` lines split at white space; lines of fewer than ``least`` tokens
    go, a missing last token is an empty string."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    out = lines.select(parts.alias("p")).filter(F.size("p") >= least)
    return out.select(*(F.coalesce(F.get("p", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings; the reader prunes to those selected."""
    return spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True).select(*columns)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
