"""Backward-induction targets, backups and policies."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config


def terminal(psb: Column, cfg: Config = Config()) -> Column:
    return -cfg.costs[11.5] + cfg.reward * psb


def backup(kind: str, q_next: Column, cost: float, psb: Column | None = None, alpha: float = 0.0, cfg: Config = Config()) -> Column:
    """Target of an earlier stage: clip, no_clip, softplus or reward_shaping."""
    q = F.coalesce(q_next, F.lit(0.0))
    if kind == "clip":
        return -cost + cfg.gamma * F.greatest(q, F.lit(0.0))
    if kind == "no_clip":
        return -cost + cfg.gamma * q
    if kind == "softplus":
        return -cost + cfg.gamma * F.when(q > 30, q).otherwise(F.log1p(F.exp(F.least(q, F.lit(30.0)))))
    if kind == "reward_shaping":
        return -cost + alpha * cfg.reward * psb + cfg.gamma * F.greatest(q, F.lit(0.0))
    raise ValueError(kind)


def flags(df: DataFrame, qs: list[str]) -> DataFrame:
    """policy_<q> where Q > 0 (null: 0), and whether all stages keep."""
    out = df.withColumns({f"policy_{q}": F.coalesce((F.col(q) > 0).cast("int"), F.lit(0)) for q in qs})
    return out.withColumn("policy_full", F.least(*(f"policy_{q}" for q in qs)) if len(qs) > 1 else F.col(f"policy_{qs[0]}"))


def policy_statistics(df: DataFrame, policies: list[str], by: list[str] = ()) -> DataFrame:
    """Of each policy flag: rows selected, hits, precision and recall (0 if empty).
    One pass over the rows."""
    sums = [a for p in policies for a in (F.coalesce(F.sum(p), F.lit(0)).alias(f"{p}_s"), F.coalesce(F.sum(F.col(p) * F.col("y")), F.lit(0)).alias(f"{p}_h"))]
    a = df.groupBy(*by).agg(F.coalesce(F.sum("y"), F.lit(0)).alias("positives"), *sums)
    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.col(f"{p}_s").alias("selected"), F.col(f"{p}_h").alias("hits")) for p in policies)))
    a = a.select(*by, "positives", rows.alias("x")).select(*by, "positives", "x.*")
    share = lambda n: F.when(F.col(n) > 0, F.col("hits") / F.col(n)).otherwise(0.0)
    return a.select(*by, "policy", "selected", "hits", share("selected").alias("precision"), share("positives").alias("recall"))


def sweep(settings: dict[str, dict], stages: dict[float, DataFrame], features: dict[float, list[str]], psb: DataFrame, first: str = "q35") -> DataFrame:
    """(entity_id, psb, one column of first-stage values a setting): the cascade
    fitted anew with each setting, which are keyword arguments of ``cascade``
    (a reward, a weight of positives, a kind of backup)."""
    out = psb
    for name, options in settings.items():
        out = out.join(cascade(stages, features, psb, **options).select("entity_id", F.col(first).alias(name)), "entity_id", "left")
    return out


#: Settings of the three sweeps.
REWARDS = {f"reward_{x}": {"cfg": replace(Config(), reward=float(x))} for x in (4, 8, 12, 16, 20, 24)}
WEIGHTS = {f"weight_{x}": {"cfg": replace(Config(), positive_weight=float(x))} for x in (50, 100, 200, 300, 500, 664, 1000, 2000)}
BACKUPS = {x: {"kind": x} for x in ("clip", "no_clip", "softplus", "reward_shaping")}


def _values(data: DataFrame, trees: int):
    """x -> Q: boosted trees fitted on the training fold; data: fold, x, target,
    weight."""
    from pyspark.ml.regression import GBTRegressor

    from . import learners
    from . import trees as ensembles

    spark, train = data.sparkSession, data.filter("fold = 'train'")
    rows = ensembles.different(train, "target")
    if rows:
        model = ensembles.boosted(rows, trees, 42)
        return lambda df: df.withColumn("prediction", ensembles.score(spark, model, F.col("x")))
    learners.cut_lineage(data)
    return GBTRegressor(featuresCol="x", labelCol="target", weightCol="weight", maxIter=trees, maxDepth=6, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=5, seed=42).fit(train).transform


def cascade(stages: dict[float, DataFrame], features: dict[float, list[str]], psb: DataFrame, kind: str = "clip", trees: int = 20, cfg: Config = Config()) -> DataFrame:
    """Fit Q at the last cutoff, predict all folds, back up, and so on to the
    first.  stages: entity_id, fold and features at each cutoff."""
    from pyspark.ml.feature import VectorAssembler

    q_next, out = None, psb
    for cutoff in sorted(stages, reverse=True):
        df = stages[cutoff].join(psb, "entity_id")
        if q_next is None:
            df = df.withColumn("target", terminal(F.col("psb"), cfg))
        else:
            alpha = 0.3 if cutoff == 7.5 else 0.1
            df = df.join(q_next, "entity_id", "left").withColumn("target", backup(kind, F.col("q_next"), cfg.costs[cutoff], F.col("psb"), alpha, cfg))
        df = df.withColumn("weight", F.when(F.col("psb") == 1, cfg.positive_weight).otherwise(1.0))
        assemble = VectorAssembler(inputCols=features[cutoff], outputCol="x").transform
        predict = _values(assemble(df), trees)
        q = predict(assemble(stages[cutoff])).select("entity_id", F.col("prediction").alias(f"q{str(cutoff).replace('.', '')}"))
        q_next = q.select("entity_id", F.col(q.columns[1]).alias("q_next"))
        out = out.join(q, "entity_id", "left")
    return out
