"""Resampling and tests of ranked lists."""

from __future__ import annotations

from math import exp, lgamma, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def head(df: DataFrame, models: list[str], m: int) -> DataFrame:
    """(model, rank, id, y): the first m rows by each score column (ties: least id).
    A limit for each model; no rank is taken over all rows."""
    out = None
    for model in models:
        top = df.select(F.col(model).alias("score"), "id", "y").orderBy(F.desc("score"), "id").limit(m)
        ranked = top.select(F.lit(model).alias("model"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), "id", F.col("y").cast("int").alias("y"))
        out = ranked if out is None else out.unionByName(ranked)
    return out


def precision_draws(heads: DataFrame, weights: DataFrame, base_rate: float, ks: list[int]) -> DataFrame:
    """(rep, model, k, hits, p, lift) in resamples of fixed size.  weights: (rep, id,
    w), how often the resample has a row of ``heads``; a row whose copies straddle
    the k-th place counts with those before it.  ``base_rate`` is that of the data,
    not of the resample."""
    w = Window.partitionBy("rep", "model").orderBy("rank")
    run = heads.join(weights, "id").withColumn("upto", F.sum("w").over(w))
    taken = run.select("rep", "model", "y", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.greatest(F.lit(0), F.least(F.col("w"), F.lit(k) - (F.col("upto") - F.col("w")))).alias("t")) for k in ks))).alias("x"))
    hits = taken.groupBy("rep", "model", F.col("x.k").alias("k")).agg(F.sum(F.col("x.t") * F.col("y")).alias("hits"))
    p = F.col("hits") / F.col("k")
    return hits.select("rep", "model", "k", "hits", p.alias("p"), (p / base_rate if base_rate > 0 else F.lit(0.0)).alias("lift"))


def multinomial_weights(heads: DataFrame, n: int, replicates: int, seed: int) -> DataFrame:
    """(rep, id, w) of the rows of ``heads`` in resamples of n rows out of n.  Counts
    of a few rows of a resample are one multinomial draw, whatever n is, the same
    for all models."""
    import numpy as np
    import pandas as pd

    ids = sorted(r["id"] for r in heads.select("id").distinct().collect())  # bounded by models times m

    def run(parts):
        for part in parts:
            for rep in part["rep"]:
                share = np.full(len(ids) + 1, 1.0 / n)
                share[-1] = max(0.0, 1.0 - len(ids) / n)
                w = np.random.default_rng([seed, int(rep)]).multinomial(n, share)[:-1]
                at = np.flatnonzero(w)
                yield pd.DataFrame({"rep": int(rep), "id": np.array(ids, "int64")[at], "w": w[at].astype("int64")})

    return heads.sparkSession.range(replicates).withColumnRenamed("id", "rep").mapInPandas(run, "rep long, id long, w long")


def bootstrap(df: DataFrame, models: list[str], ks: list[int], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Draws of P@k, hits and lift, paired over the models.  df: id, y and a score
    column a model.  The first k places of a resample come from the first rows of
    the data, about k of them; ``head`` takes k and twelve standard deviations, so
    that fewer than k copies among them have no chance worth a number."""
    n, positives = df.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n:
        return df.sparkSession.createDataFrame([], "rep long, model string, k int, hits long, p double, lift double")
    ks = sorted({min(k, n) for k in ks})
    heads = head(df, models, min(n, ks[-1] + 12 * int(sqrt(ks[-1]) + 1)))
    return precision_draws(heads, multinomial_weights(heads, n, replicates, seed), positives / n, ks)


def intervals(draws: DataFrame, value: str, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Percentile interval, mean and population deviation over the replicates."""
    q = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return draws.groupBy(*by).agg(q.alias("q"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")).select(*by, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "mean", "sd")


def paired_deltas(draws: DataFrame, value: str, against: str, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Each model less the model ``against``, replicate by replicate: mean, interval,
    share above 0, and whether the interval leaves 0 out."""
    b = draws.filter(F.col("model") == against).select("rep", *by, F.col(value).alias("other"))
    d = draws.filter(F.col("model") != against).join(b, ["rep", *by]).withColumn("delta", F.col(value) - F.col("other"))
    share = d.groupBy("model", *by).agg(F.avg((F.col("delta") > 0).cast("double")).alias("above"))
    out = intervals(d, "delta", ["model", *by], alpha).join(share, ["model", *by])
    return out.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def hypergeometric(n: int, positives: int, k: int, hits: int) -> float:
    """P(at least ``hits`` positives among k drawn of n)."""

    def choose(a, b):
        return lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)

    return sum(exp(choose(positives, i) + choose(n - positives, k - i) - choose(n, k)) for i in range(hits, min(positives, k) + 1) if n - positives >= k - i)


def top_k_test(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """counts: n, p (positives), k, hits of each tested list, one row a test.  Adds
    the hypergeometric p-value and whether it passes after Bonferroni's division by
    the number of tests."""
    n, p, drawn = (F.col(c).cast("double") for c in ("n", "p", "k"))

    def choose(a, b):
        return _log_gamma(a + 1) - _log_gamma(b + 1) - _log_gamma(a - b + 1)

    possible = F.filter(F.sequence(F.col("hits").cast("long"), F.greatest(F.col("hits"), F.least(F.col("p"), F.col("k"))).cast("long")), lambda i: (i <= F.least(F.col("p"), F.col("k"))) & (F.col("k") - i <= F.col("n") - F.col("p")))
    terms = F.transform(possible, lambda i: F.exp(choose(p, i.cast("double")) + choose(n - p, drawn - i) - choose(n, drawn)))
    out = counts.withColumn("p_value", F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))
    tests = out.agg(F.count("*").alias("tests"))
    return out.crossJoin(F.broadcast(tests)).withColumn("significant", F.col("p_value") < alpha / F.col("tests"))


def _log_gamma(x):
    """Stirling's series from x + 8 down, as SQL; error under 1e-12 for x of 1 or more."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    product = F.lit(1.0)
    for k in range(8):
        product = product * (x + k)
    return series - F.log(product)


def rmse(df: DataFrame, by: list[str], prediction: str = "score", target: str = "y") -> DataFrame:
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col(prediction) - F.col(target), 2))).alias("rmse"))
