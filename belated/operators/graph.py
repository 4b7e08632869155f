"""Aggregates over the edge table (cited, citing, age, ...), entity by entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def annual_counts(edges: DataFrame) -> DataFrame:
    """Citations of each entity in each year, whatever their age."""
    return edges.groupBy("entity_id", "cite_year").agg(F.count("*").alias("fwd_count"))


def curves(edges: DataFrame, max_age: int) -> DataFrame:
    """(entity_id, c): counts by age 0..max_age of entities with any citation at
    those ages.  One shuffle of one partly aggregated row an entity and task."""
    inside = edges.filter(F.col("age").between(0, max_age))
    ages = [F.count_if(F.col("age") == a).alias(f"a{a}") for a in range(max_age + 1)]
    return inside.groupBy("entity_id").agg(*ages).select("entity_id", F.array(*(f"a{a}" for a in range(max_age + 1))).alias("c"))


def backward_counts(edges: DataFrame, by: str = "citing") -> DataFrame:
    """Of each citing entity: citations made, and those of two categories."""
    return edges.groupBy(by).agg(F.count("cited").alias("bwd_total"), F.count_if(F.col("category") == "examiner").alias("bwd_examiner"), F.count_if(F.col("category") == "applicant").alias("bwd_applicant"))


def keep_first(df: DataFrame, key: str, *order) -> DataFrame:
    """One row a key, the first by an explicit order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def citer_quality(edges: DataFrame, cutoff_age: int) -> DataFrame:
    """Features of the citing side up to an age.  The three category features
    share one shuffle by entity: counts by value are taken as maps' rows below."""
    e = edges.filter(F.col("age").between(0, cutoff_age))
    h = cutoff_age // 2
    late, cross = F.col("age") > h, F.col("cross")
    flags = e.groupBy("entity_id").agg(
        F.count("*").alias("n_citers"), F.avg("age").alias("citer_recency_mean"),
        F.avg(cross.cast("double")).alias("citer_ipc_cross_rate"), F.avg(F.col("same_assignee").cast("double")).alias("citer_self_rate"),
        F.avg((F.col("category") == "examiner").cast("double")).alias("citer_examiner_rate"),
        F.count_if(late).alias("nl"), F.count_if(late & cross).alias("xl"), F.count_if(~late).alias("ne"), F.count_if(~late & cross).alias("xe"))
    slope = F.coalesce(F.col("xl") / F.nullif(F.col("nl"), F.lit(0)) - F.col("xe") / F.nullif(F.col("ne"), F.lit(0)), F.lit(0.0))
    flags = flags.withColumn("cross_ipc_slope", slope).withColumn("n_citers_log", F.log1p(F.col("n_citers").cast("double"))).drop("nl", "xl", "ne", "xe")
    # counts by value of all three categories in one pass, then by entity
    values = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in ((0, "citing_class"), (1, "citing_assignee"), (2, "citing_location"))))
    counted = e.select("entity_id", F.explode(values).alias("v")).groupBy("entity_id", "v.kind", "v.value").agg(F.count("*").alias("n"))
    # ln and squares of shares need the entity's total: sum n ln n and sum n² give both without a second pass
    kinds = counted.groupBy("entity_id").agg(*(f(F.when(F.col("kind") == k, x)).alias(f"{name}{k}") for k in range(3) for f, x, name in ((F.sum, F.col("n"), "n"), (F.sum, F.col("n") * F.log(F.col("n").cast("double")), "l"), (F.sum, F.col("n") * F.col("n"), "q"), (F.count, F.col("n"), "d"))))
    share = lambda k: F.log(F.col(f"n{k}").cast("double")) - F.col(f"l{k}") / F.col(f"n{k}")
    kinds = kinds.select("entity_id", share(0).alias("citer_ipc_diversity"), share(2).alias("citer_loc_diversity"), (F.col("q1") / (F.col("n1") * F.col("n1"))).alias("citer_assignee_hhi"), (F.col("d1") / F.col("n1")).alias("citer_assignee_unique_rate"))
    return flags.join(kinds, "entity_id")


def maintenance(events: DataFrame, universe: DataFrame) -> DataFrame:
    """Paid flags by windows of age, and the age at which an entity lapses."""
    windows = (("paid_3_5", 3, 5), ("paid_7_5", 6.5, 9), ("paid_11_5", 10.5, 13.5))
    paid = events.groupBy("entity_id").agg(*(F.bool_or(F.col("age").between(a, b)).alias(name) for name, a, b in windows))
    out = universe.join(paid, "entity_id", "left").select("entity_id", *(F.coalesce(F.col(name).cast("int"), F.lit(0)).alias(name) for name, _, _ in windows))
    lapsed = F.when(F.col("paid_3_5") == 0, 3.5).when(F.col("paid_7_5") == 0, 7.5).when(F.col("paid_11_5") == 0, 11.5).otherwise(17.0)
    return out.withColumn("lapsed_age", lapsed)
