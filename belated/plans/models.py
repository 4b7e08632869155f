"""Registered queries of the learners, and of the tables around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, labels, learners, networks, prepare, ranking, trees
from . import roles
from .registry import CFG, QUERIES, query, r


@query("""SELECT CASE WHEN p_partkey % 10 BETWEEN 2 AND 6 THEN 'train' WHEN p_partkey % 10 = 7 THEN 'val' WHEN p_partkey % 10 IN (8, 9) THEN 'test' END AS fold,
count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS sd, min(p_retailprice) AS low, max(p_retailprice) AS high, count(DISTINCT p_size) AS sizes FROM part GROUP BY ALL""")
def fold_diagnostics(spark, sf):
    e = roles.entities(spark, sf).withColumn("fold", labels.fold(F.col("grant_year")))
    p = F.col("p_retailprice")
    return r(e.groupBy("fold").agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("sd"), F.min(p).alias("low"), F.max(p).alias("high"), F.countDistinct("p_size").alias("sizes")), 6)


@query("SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_distinct, max(first) AS first_supplier FROM (SELECT *, first_value(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY nullif(l_linenumber, 1) ASC NULLS LAST, l_suppkey) AS first FROM lineitem) GROUP BY l_orderkey")
def first_in_sequence(spark, sf):
    """Rows, distinct parties and the party of least sequence number (nulls, which
    stand for the 1 here, last; ties: the least party) of each entity."""
    li = roles.table(spark, sf, "lineitem").withColumn("sequence", F.nullif(F.col("l_linenumber"), F.lit(1)))
    return li.groupBy("l_orderkey").agg(F.count("*").alias("n_rows"), F.countDistinct("l_suppkey").alias("n_distinct"), F.min_by("l_suppkey", prepare.least_in_sequence(F.col("sequence"), F.col("l_suppkey"))).alias("first_supplier"))


@query("SELECT l_shipmode_year AS y, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 4) AS A, round(sum(l_quantity) FILTER (l_returnflag = 'N'), 4) AS N, round(sum(l_quantity) FILTER (l_returnflag = 'R'), 4) AS R FROM (SELECT *, CAST(year(l_shipdate) AS INT) AS l_shipmode_year FROM lineitem) GROUP BY ALL")
def pivot_report(spark, sf):
    li = roles.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("y"), "l_returnflag", "l_quantity")
    return r(li.groupBy("y").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")), 4)


_BENCH = f"""WITH {roles.SCORES.format(label='toxic')}, t AS (SELECT 'length' AS model, dscore AS score, y, id FROM s UNION ALL SELECT 'length_band', tscore, y, id FROM s),
c AS (SELECT model, score, sum(y) AS pos, count(*) AS n FROM t GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY model ORDER BY score DESC) AS k, sum(pos) OVER (PARTITION BY model) AS p FROM c),
a AS (SELECT model, round(sum(pos / CAST(p AS DOUBLE) * tp / k), 8) AS ap FROM w GROUP BY model),
o AS (SELECT model, y, row_number() OVER (PARTITION BY model ORDER BY score DESC, id) AS rn FROM t),
h AS (SELECT model, count(*) AS n, sum(y) AS p, sum(y) FILTER (rn <= 50) AS h50, sum(y) FILTER (rn <= 100) AS h100 FROM o GROUP BY model)
SELECT model, ap, round(h50 / least(50, n)::DOUBLE / (p / CAST(n AS DOUBLE)), 8) AS lift_at_50, round(h100 / least(100, n)::DOUBLE / (p / CAST(n AS DOUBLE)), 8) AS lift_at_100 FROM a JOIN h USING (model)"""


@query(_BENCH)
def model_benchmark(spark, sf):
    """Several score columns turned into rows, and the lifts of each at each k into columns."""
    s = roles.scores(spark, sf, "toxic")
    both = s.select("id", "y", F.explode(F.array(F.struct(F.lit("length").alias("model"), F.col("score").alias("score")), F.struct(F.lit("length_band").alias("model"), F.floor(F.col("score") / 500).cast("double").alias("score")))).alias("m")).select("id", "y", "m.*")
    lifts = ranking.top_k(both, ["model"], [50, 100]).groupBy("model").pivot("k", [50, 100]).agg(F.first("lift")).select("model", F.col("50").alias("lift_at_50"), F.col("100").alias("lift_at_100"))
    return r(ranking.average_precision(both, ["model"]).select("model", "ap").join(lifts, "model"))


@query(f"""WITH {roles.SCORES.format(label='toxic')}, a AS (SELECT sum(CAST(dscore > 2000 AS INT)) AS m, sum(CAST(dscore > 2000 AS INT) * y) AS h FROM s), w AS (SELECT unnest([4.0, 8.0, 12.0, 16.0, 20.0, 24.0])::DOUBLE AS reward)
SELECT reward, CAST(m AS BIGINT) AS maintained, CAST(h AS BIGINT) AS hits, round(h * reward - m * 6.73::DOUBLE, 4) + 0.0 AS net, round(CASE WHEN m > 0 THEN h * reward / (m * 6.73::DOUBLE) ELSE 0.0 END, 6) AS ratio FROM a CROSS JOIN w""")
def reward_sweep(spark, sf):
    """Economics of one policy at each reward: one aggregated row, taken six times."""
    s = roles.scores(spark, sf, "toxic").agg(F.sum((F.col("score") > 2000).cast("int")).alias("m"), F.sum((F.col("score") > 2000).cast("int") * F.col("y")).alias("h"))
    s = s.withColumn("reward", F.explode(F.array(*(F.lit(float(x)) for x in (4, 8, 12, 16, 20, 24)))))
    cost, gain = F.col("m") * CFG.total_cost, F.col("h") * F.col("reward")
    return s.select("reward", F.col("m").alias("maintained"), F.col("h").alias("hits"), (F.round(gain - cost, 4) + 0.0).alias("net"), F.round(F.when(cost > 0, gain / cost).otherwise(0.0), 6).alias("ratio"))


@query(f"""WITH {roles.SCORES.format(label='quality')}, k AS (SELECT id, tscore, rank() OVER (ORDER BY tscore DESC) + (count(*) OVER (PARTITION BY tscore) - 1) / 2.0::DOUBLE AS rk FROM s)
SELECT id, round(rk, 2) AS rank, CAST(rk <= 100 AS INT) AS policy FROM k""")
def top_rank_policy(spark, sf):
    """Kept if the average descending rank is at most 100.  Ranks come from counts
    by distinct score."""
    s = roles.scores(spark, sf, tied=True)
    g = s.groupBy("score").agg(F.count("*").alias("n"))
    ranks = ranking.running(g, [], ["n"]).select("score", F.round(F.col("cum_n") - (F.col("n") - 1) / 2.0, 2).alias("rank"))
    return s.join(ranks, "score").select("id", "rank", (F.col("rank") <= 100).cast("int").alias("policy"))


def _table(spark, sf):
    """Features at 3.5 years, labels within sections and folds of every entity."""
    s = labels.scored(graph.curves(roles.edges(spark, sf), CFG.label_age), 9)
    e = roles.entities(spark, sf)
    psb = labels.tail_labels(s, e.select("entity_id", F.col("section").alias("class")), 0.1, CFG.min_class).select("entity_id", "psb")
    f = QUERIES["citation_features_3_5"](spark, sf)
    df = f.join(psb, "entity_id").join(e.select("entity_id", labels.fold(F.col("grant_year")).alias("fold")), "entity_id")
    return df, [c for c in f.columns if c != "entity_id"]


@query()
def classifier_scores(spark, sf):
    """Forest, boosted trees and logistic regression, one row an entity."""
    df, features = _table(spark, sf)
    data = learners.assemble(df, features)
    rows = trees.different(data.filter("fold = 'train'"), "y")
    out = df.select("entity_id", "fold", "psb")
    for kind, size in (("forest", 500), ("boosted", 500), ("logistic", 0)):
        out = out.join(learners.classify(data, kind, trees=size, rows=rows).select("entity_id", F.col("score").alias(kind)), "entity_id")
    return out


@query()
def network_scores(spark, sf):
    """Value network (squared and Huber loss) and reward-maximising network."""
    df, features = _table(spark, sf)
    df = df.withColumn("target", -CFG.costs[11.5] + CFG.reward * F.col("psb")).withColumn("weight", F.when(F.col("psb") == 1, CFG.positive_weight).otherwise(1.0))
    out, sample = df.select("entity_id", "fold", "psb"), networks.sampled(df, features, "target", "weight")
    for loss in networks.LOSSES:
        q = networks.fit_predict(df, features, "target", "weight", loss=loss, balance=loss == "reward", sample=sample, epochs=20)
        out = out.join(q.withColumnRenamed("score", loss), "entity_id")
    return out


@query()
def vector_clusters(spark, sf):
    """Fifty principal components of the vectors and their cluster, of fifty."""
    v = learners.components(roles.vectors(spark, sf), 50)
    return learners.clusters(v, k=50, starts=10).select("id", "cluster", "cluster_distance")


@query()
def oversampled(spark, sf):
    v = roles.vectors(spark, sf).select("id", F.col("v").cast("array<double>").alias("v"), (F.col("class") == 0).cast("int").alias("y"))
    return learners.oversample(v, ratio=0.5)
