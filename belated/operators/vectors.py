"""Distances of embedding vectors to class centroids and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return 1 - dot(a, b) / ((F.sqrt(dot(a, a)) + eps) * (F.sqrt(dot(b, b)) + eps))


def centroid(df: DataFrame, by: list[str], dims: int) -> DataFrame:
    """Mean vector of each group: one partly aggregated row a group and task."""
    means = [F.avg(F.col("v")[i].cast("double")).alias(f"m{i}") for i in range(dims)]
    return df.groupBy(*by).agg(F.count("*").alias("members"), *means).select(*by, "members", F.array(*(f"m{i}" for i in range(dims))).alias("centre"))


#: Centroids that one broadcast array holds.
MOST = 20_000


def class_distances(vectors: DataFrame, dims: int, least: int = 5, most: int = MOST) -> DataFrame:
    """vectors: id, class, v, train.  Own-class distance (the global centroid for
    classes with fewer than ``least`` training rows), nearest other class, margin
    and outlier score.  Centroids are one row a class; they are broadcast as arrays
    of at most about ``most`` of them, one after another where there are more."""
    train = vectors.filter("train")
    centres = centroid(train, ["class"], dims).filter(F.col("members") >= least)
    one = centroid(train, [], dims).select(F.col("centre").alias("g"))
    out = vectors.crossJoin(F.broadcast(one)).withColumn("outlier", cosine_distance(F.col("v"), F.col("g"))).drop("g")
    chunks = -(-train.select("class").distinct().count() // most)
    for c in range(chunks):
        part = centres.filter(F.pmod(F.xxhash64("class"), F.lit(chunks)) == c) if chunks > 1 else centres
        many = part.agg(F.collect_list(F.struct("class", "centre")).alias("cs"))
        dist = F.transform("cs", lambda x: F.struct(x["class"].alias("class"), cosine_distance(F.col("v"), x["centre"]).alias("d")))
        own = F.get(F.transform(F.filter("ds", lambda x: x["class"] == F.col("class")), lambda x: x["d"]), F.lit(0))
        other = F.array_min(F.transform(F.filter("ds", lambda x: x["class"] != F.col("class")), lambda x: x["d"]))
        out = out.crossJoin(F.broadcast(many)).withColumn("ds", dist).withColumns({f"own{c}": own, f"other{c}": other}).drop("cs", "ds")

    def over(name, f):
        columns = [F.col(f"{name}{c}") for c in range(chunks)]
        return f(*columns) if len(columns) > 1 else columns[0] if columns else F.lit(None).cast("double")

    out = out.select("id", "class", F.coalesce(over("own", F.coalesce), "outlier").alias("own"), over("other", F.least).alias("other"), "outlier")
    return out.withColumn("margin", F.col("other") - F.col("own"))


#: Rows of a class that meet in a task, squared.
CELL = 2048


def density(vectors: DataFrame, k: int = 20, cell: int = CELL) -> DataFrame:
    """Mean distance to the k nearest training rows of the class (a training row
    counts itself); 0.5 in classes with at most k rows or k training rows.  A class
    is cut into blocks of about ``cell`` rows; each pair of a block of rows and one
    of training rows is a task's group of its own, which yields the k least
    distances of each row as one product of matrices."""
    size = vectors.groupBy("class").agg(F.count("*").alias("n"), F.count_if("train").alias("t"))
    large = size.filter((F.col("n") > k) & (F.col("t") > k)).select("class", F.ceil(F.col("n") / cell).cast("int").alias("nx"), F.ceil(F.col("t") / cell).cast("int").alias("ny"))
    v = F.col("v").cast("array<double>").alias("v")
    rows = vectors.join(large, "class")

    def block(n):
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    x = rows.select("class", "id", v, block("nx").alias("xb"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("yb"))
    y = rows.filter("train").select(F.col("class").alias("class"), v, block("ny").alias("yb"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("xb"))
    cells = ["class", "xb", "yb"]

    def nearest(left, right):
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "d": []})
        a, b = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)
        d = 1 - unit(a) @ unit(b).T
        least = np.sort(np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k], axis=1)
        return pd.DataFrame({"id": left["id"], "d": list(least)})

    best = x.groupBy(*cells).cogroup(y.groupBy(*cells)).applyInPandas(nearest, "id long, d array<double>")
    merged = best.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k).alias("d"))
    near = merged.select("id", (F.aggregate("d", F.lit(0.0), lambda s, e: s + e) / F.size("d")).alias("density"))
    return vectors.select("id").join(near, "id", "left").withColumn("density", F.coalesce("density", F.lit(0.5)))
