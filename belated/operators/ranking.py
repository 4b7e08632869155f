"""Ranking metrics.  Ties: score descending, id ascending; rows without a score are
left out.  Scores are grouped by value before any running sum, and running sums
are dealt to ranges of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of scores that running sums are dealt to.
RANGES = 256


def running(g: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """g (by, score, ...), one row a group and score, with the sums ``cum_<c>`` of
    each column down to the score.  Scores are dealt to ranges by quantiles of them
    (one broadcast row of ``RANGES`` numbers); sums run inside a range, and the
    totals of the ranges above, one row a group and range, are joined back, so no
    task sees all scores of a large group."""
    edges = g.agg(F.percentile_approx("score", F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), F.lit(10_000)).alias("_edges"))
    placed = g.crossJoin(F.broadcast(edges)).withColumn("_range", F.size(F.filter("_edges", lambda e: e > F.col("score")))).drop("_edges")
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc("score"))
    placed = placed.select("*", *(F.sum(c).over(inside).alias(f"_in_{c}") for c in sums))
    totals = g.crossJoin(F.broadcast(edges)).withColumn("_range", F.size(F.filter("_edges", lambda e: e > F.col("score")))).groupBy(*by, "_range").agg(*(F.sum(c).alias(c) for c in sums))
    above = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_range", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_up_{c}") for c in sums))
    out = placed.join(offsets, [*by, "_range"])
    return out.select(*g.columns, *((F.col(f"_in_{c}") + F.col(f"_up_{c}")).alias(f"cum_{c}") for c in sums))


def _curve(df: DataFrame, by: list[str]) -> DataFrame:
    """By group and distinct score: cumulative hits and rows, and totals."""
    df = df.filter("score is not null")
    g = df.groupBy(*by, "score").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    totals = g.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("n").alias("total"), F.count("*").alias("distinct_scores"))
    run = running(g, by, ["pos", "n"])
    both = run.join(totals, by) if by else run.crossJoin(F.broadcast(totals))
    return both.select(*by, "score", "pos", "n", F.col("cum_pos").alias("tp"), F.col("cum_n").alias("k"), "p", "total", "distinct_scores")


def average_precision(df: DataFrame, by: list[str], guard: bool = True) -> DataFrame:
    """Sum of recall steps times precision; 0 with fewer than two distinct scores
    (``guard``) or without positives."""
    c = _curve(df, by)
    ap = F.sum(F.col("pos") / F.nullif(F.col("p"), F.lit(0)) * F.col("tp") / F.col("k"))
    flat = F.max("distinct_scores") < 2 if guard else F.lit(False)
    return c.groupBy(*by).agg(F.when(flat, 0.0).otherwise(F.coalesce(ap, F.lit(0.0))).alias("ap"), F.max("p").alias("positives"), F.max("total").alias("n"))


def auroc(df: DataFrame, by: list[str]) -> DataFrame:
    """Rank-sum form: ties count half; null without both classes."""
    c = _curve(df, by)
    wins = F.sum((F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0))
    return c.groupBy(*by).agg((wins / F.nullif(F.max("p") * (F.max("total") - F.max("p")), F.lit(0))).alias("auroc"))


def recall_at_precision(df: DataFrame, by: list[str], least: float = 0.05) -> DataFrame:
    c = _curve(df, by)
    ok = F.when(F.col("tp") / F.col("k") >= least, F.col("tp") / F.col("p"))
    return c.groupBy(*by).agg(F.coalesce(F.max(ok), F.lit(0.0)).alias("recall_at_precision"))


def top_k(df: DataFrame, by: list[str], ks: list[int], plain: bool = False) -> DataFrame:
    """hits, precision (of the rows there are; ``plain``: of k), recall and lift at
    each k.  Only the largest k rows of a
    group are ranked: a limit pushed below the window."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(F.desc("score"), F.asc("id"))
    ranked = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max(ks))
    base = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    hits = ranked.groupBy(*by).agg(*(F.sum(F.when(F.col("rn") <= k, F.col("y")).otherwise(0)).alias(f"h{k}") for k in ks))
    both = base.join(hits, by) if by else base.crossJoin(hits)
    long_ = both.select(*by, "n", "p", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks))).alias("x")).select(*by, "n", "p", "x.*")
    prec = F.col("hits") / (F.col("k") if plain else F.least("k", "n"))
    return long_.select(*by, "k", "hits", prec.alias("precision"), (F.col("hits") / F.nullif(F.col("p"), F.lit(0))).alias("recall"), (prec / F.nullif(F.col("p") / F.col("n"), F.lit(0))).alias("lift"))


def recall_curve(df: DataFrame, ks: list[int]) -> DataFrame:
    out = top_k(df, [], ks)
    base = df.agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    return out.crossJoin(base).select("k", F.col("recall"), (F.least(F.col("k") * F.col("p") / F.col("n"), F.col("p")) / F.col("p")).alias("random_recall"))


def economics(df: DataFrame, by: list[str], reward: float, cost: float) -> DataFrame:
    """df has the flag ``kept`` and y."""
    a = df.groupBy(*by).agg(F.sum("kept").alias("maintained"), F.sum(F.col("kept") * F.col("y")).alias("hits"))
    c, b = F.col("maintained") * cost, F.col("hits") * reward
    return a.select(*by, "maintained", "hits", c.alias("cost"), b.alias("benefit"), (b - c).alias("net"), F.when(c > 0, b / c).otherwise(0.0).alias("ratio"))


def profit(df: DataFrame, ks: list[int], reward: float = 8.0) -> DataFrame:
    t = top_k(df, [], ks)
    return t.select("k", "hits", (F.col("hits") * reward - F.col("k")).alias("profit"), ((F.col("hits") * reward - F.col("k")) / F.col("k")).alias("per_item"))


def calibration(df: DataFrame, bins: int = 10, cost: float = 1.0, reward: float = 8.0) -> DataFrame:
    """Quantile bins (edges that coincide are merged; the first bin is closed on
    the left): rows, mean score and outcome, mean value (reward of positives less
    the cost) and the error of the score as its prediction."""
    edges = df.agg(F.array_distinct(F.percentile("score", F.array(*(F.lit(i / bins) for i in range(bins + 1))))).alias("e"))
    placed = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("e", lambda x: x < F.col("score")))))
    out = placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("rate"), F.avg("score").alias("mean_score"), (F.avg("y") * reward - cost).alias("mean_actual"))
    return out.withColumn("error", F.col("mean_score") - F.col("mean_actual"))


def melted(df: DataFrame, models: list[str], keep: list[str]) -> DataFrame:
    """One row a model: (keep, model, score); rows without a score go."""
    both = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("score")) for m in models)))
    return df.select(*keep, both.alias("m")).select(*keep, "m.*").filter("score is not null")


def class_tables(df: DataFrame, by: str, models: list[str], ks: list[int], least: int = 50) -> DataFrame:
    """By class of ``least`` rows or more: rows, positives, and of each model the
    average precision and precision at each k (0 without positives), one row a
    class.  df: id, y, ``by`` and a score column a model."""
    size = df.groupBy(by).agg(F.count("*").alias("count"), F.sum("y").alias("positives")).filter(F.col("count") >= least)
    rows = melted(df.join(size.select(by), by, "left_semi"), models, ["id", "y", by])
    ap = average_precision(rows, [by, "model"], guard=False).groupBy(by).pivot("model", models).agg(F.first("ap"))
    ap = ap.select(by, *(F.col(m).alias(f"{m}_ap") for m in models))
    prec = top_k(rows, [by, "model"], ks).withColumn("c", F.concat_ws("_p_at_", "model", "k"))
    columns = [f"{m}_p_at_{k}" for m in models for k in ks]
    prec = prec.groupBy(by).pivot("c", columns).agg(F.first("precision"))
    out = size.join(ap, by, "left").join(prec, by, "left")
    return out.select(by, "count", "positives", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in [*(f"{m}_ap" for m in models), *columns]))


def model_profit(df: DataFrame, models: list[str], ks: list[int], reward: float = 8.0, cost: float = 1.0) -> DataFrame:
    """Profit of keeping the first k rows of each model.  df: id, y, a score a model."""
    t = top_k(melted(df, models, ["id", "y"]), ["model"], ks).join(melted(df, models, ["id"]).groupBy("model").agg(F.count("*").alias("n")), "model")
    drawn = F.least("k", "n")
    gain = F.col("hits") * reward - drawn * cost
    return t.select("model", "k", "hits", gain.alias("profit"), F.when(drawn > 0, gain / drawn).otherwise(0.0).alias("per_item"))


def best_marked(df: DataFrame, key: str, value: str, against: str) -> DataFrame:
    """Rows of a sweep with the difference to the row ``against`` and a mark on the
    best; a sweep has a row a setting."""
    base = df.agg(F.max(F.when(F.col(key) == against, F.col(value))).alias("base"), F.max(value).alias("best"))
    return df.crossJoin(F.broadcast(base)).select(*df.columns, (F.col(value) - F.col("base")).alias("delta"), (F.col(value) == F.col("best")).alias("is_best"))
