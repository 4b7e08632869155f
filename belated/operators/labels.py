"""Tail labels, percentile ranks, folds and encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import curves


def scored(curve: DataFrame, digits: int | None = None) -> DataFrame:
    b = curves.beauty(F.col("c"))
    return curve.select("entity_id", (F.round(b, digits) if digits else b).alias("b"), curves.peak_age(F.col("c")).alias("t_m"), curves.awakening_age(F.col("c")).alias("t_a"), curves.total(F.col("c")).alias("total_citations"), F.array_max("c").alias("peak_citations"))


def tail_labels(scores: DataFrame, classes: DataFrame, tail: float, min_class: int = 10) -> DataFrame:
    """psb = 1 at or above the exact 1 - tail quantile of the class; no positive
    in classes of fewer than ``min_class`` or with a quantile of zero.  Quantiles
    are one row a class, joined back."""
    s = scores.join(classes, "entity_id", "left").withColumn("class", F.coalesce("class", F.lit("UNKNOWN")))
    q = s.groupBy("class").agg(F.count("*").alias("n"), F.percentile("b", 1 - tail).alias("q"))
    hit = (F.col("n") >= min_class) & (F.col("q") > 0) & (F.col("b") >= F.col("q"))
    return s.join(q, "class").withColumn("psb", hit.cast("int")).drop("n", "q")


def percentile_rank(df: DataFrame, value: Column, *keys: str) -> Column:
    """Average rank over the size of the group (ties share their mean rank)."""
    w = Window.partitionBy(*keys)
    return (F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2) / F.count("*").over(w)


def fold(year: Column, cfg: Config = Config()) -> Column:
    return F.when(year.between(*cfg.train_years), "train").when(year == cfg.val_year, "val").when(year.between(*cfg.test_years), "test")


def frequency_encoding(df: DataFrame, columns: list[str], year: str = "grant_year", cfg: Config = Config()) -> DataFrame:
    """Counts of each category in the training fold alone; unseen: 0."""
    train = df.filter(fold(F.col(year), cfg) == "train")
    for c in columns:
        counts = train.groupBy(c).agg(F.count("*").alias(f"{c}_enc"))
        df = df.join(counts, c, "left").withColumn(f"{c}_enc", F.coalesce(f"{c}_enc", F.lit(0)))
    return df


def finite(x: Column) -> Column:
    """Null and infinite to 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
