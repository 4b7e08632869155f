"""Registered queries of evaluation: policies, class tables, profits, resamples, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference, policy, ranking
from . import roles
from .registry import CFG, query, r

#: Three scores of one row, which play three models.
_S3 = f"""{roles.SCORES.format(label='toxic')},
m AS (SELECT id, grp, y, dscore AS length, tscore AS band, CAST((id * 48271) % 1009 AS DOUBLE) AS scattered FROM s),
l AS (SELECT id, grp, y, unnest(['length', 'band', 'scattered']) AS model, unnest([length, band, scattered]) AS score FROM m)"""
MODELS = ["length", "band", "scattered"]


def three(spark, sf):
    s = roles.scores(spark, sf, "toxic")
    return s.select("id", "grp", "y", F.col("score").alias("length"), F.floor(F.col("score") / 500).cast("double").alias("band"), (F.col("id") * 48271 % 1009).cast("double").alias("scattered"))


@query(f"""WITH {_S3}, q AS (SELECT id, y, length / 1000 - 2 AS q35, band / 2 - 1 AS q75, CASE WHEN id % 5 <> 0 THEN scattered / 500 - 1 END AS q115 FROM m),
f AS (SELECT id, y, CAST(q35 > 0 AS INT) AS a, CAST(q75 > 0 AS INT) AS b, CAST(coalesce(q115 > 0, false) AS INT) AS c FROM q),
p AS (SELECT y, unnest(['policy_q35', 'policy_q75', 'policy_q115', 'policy_full']) AS policy, unnest([a, b, c, least(a, b, c)]) AS keep FROM f),
g AS (SELECT policy, sum(keep) AS s, sum(keep * y) AS h, sum(y) AS n FROM p GROUP BY policy)
SELECT policy, CAST(s AS BIGINT) AS selected, CAST(h AS BIGINT) AS hits, round(CASE WHEN s > 0 THEN h / CAST(s AS DOUBLE) ELSE 0.0 END, 8) AS precision, round(CASE WHEN n > 0 THEN h / CAST(n AS DOUBLE) ELSE 0.0 END, 8) AS recall FROM g""")
def policy_statistics(spark, sf):
    """Flags of three stages' values (a missing value keeps nothing), and what each
    policy selects."""
    q = three(spark, sf).select("id", "y", (F.col("length") / 1000 - 2).alias("q35"), (F.col("band") / 2 - 1).alias("q75"), F.when(F.col("id") % 5 != 0, F.col("scattered") / 500 - 1).alias("q115"))
    names = ["q35", "q75", "q115"]
    return r(policy.policy_statistics(policy.flags(q, names), [*(f"policy_{n}" for n in names), "policy_full"]))


_KS = [10, 50]


@query(f"""WITH {_S3}, z AS (SELECT grp, count(*) AS n, sum(y) AS p FROM m GROUP BY grp HAVING count(*) >= 50),
c AS (SELECT grp, model, score, sum(y) AS pos, count(*) AS n FROM l GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER (PARTITION BY grp, model ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY grp, model ORDER BY score DESC) AS k, sum(pos) OVER (PARTITION BY grp, model) AS p FROM c),
a AS (SELECT grp, model, coalesce(sum(pos / CAST(nullif(p, 0) AS DOUBLE) * tp / k), 0.0) AS ap FROM w GROUP BY ALL),
o AS (SELECT grp, model, y, row_number() OVER (PARTITION BY grp, model ORDER BY score DESC, id) AS rn FROM l),
h AS (SELECT grp, model, {', '.join(f'sum(y) FILTER (rn <= {k}) / CAST(least({k}, count(*)) AS DOUBLE) AS p{k}' for k in _KS)} FROM o GROUP BY ALL)
SELECT z.grp, z.n AS count, CAST(z.p AS BIGINT) AS positives, {', '.join(f"round(max(ap) FILTER (a.model = '{m}'), 8) AS {m}_ap" for m in MODELS)},
{', '.join(f"round(max(p{k}) FILTER (a.model = '{m}'), 8) AS {m}_p_at_{k}" for m in MODELS for k in _KS)}
FROM z JOIN a ON z.grp = a.grp JOIN h ON h.grp = a.grp AND h.model = a.model GROUP BY ALL""")
def class_tables(spark, sf):
    """Metrics of three models in each class of fifty rows or more."""
    return r(ranking.class_tables(three(spark, sf).filter("grp is not null"), "grp", MODELS, _KS))


@query(f"""WITH {_S3}, o AS (SELECT model, y, row_number() OVER (PARTITION BY model ORDER BY score DESC, id) AS rn, count(*) OVER (PARTITION BY model) AS n FROM l), k AS (SELECT unnest([100, 200, 500, 1000]) AS k),
h AS (SELECT model, k, coalesce(sum(y) FILTER (rn <= k), 0) AS hits, least(k, max(n)) AS d FROM o CROSS JOIN k GROUP BY model, k)
SELECT model, k, CAST(hits AS BIGINT) AS hits, round(hits * 8.0::DOUBLE - d, 6) + 0.0 AS profit, round((hits * 8.0::DOUBLE - d) / d, 6) + 0.0 AS per_item FROM h""")
def model_profit(spark, sf):
    """Profit of three models' first rows, side by side."""
    return r(ranking.model_profit(three(spark, sf), MODELS, [100, 200, 500, 1000], CFG.reward, CFG.costs[3.5]), 6)


@query(f"""WITH {_S3}, c AS (SELECT model, score, sum(y) AS pos, count(*) AS n FROM l GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY model ORDER BY score DESC) AS k, sum(pos) OVER (PARTITION BY model) AS p FROM c),
a AS (SELECT model, round(sum(pos / CAST(p AS DOUBLE) * tp / k), 8) AS ap FROM w GROUP BY model)
SELECT model, ap, round(ap - max(ap) FILTER (model = 'length') OVER (), 8) + 0.0 AS delta, ap = max(ap) OVER () AS is_best FROM a""")
def sweep_report(spark, sf):
    """Average precision of the settings of a sweep, with the difference to one of
    them and a mark on the best, best first."""
    ap = r(ranking.average_precision(ranking.melted(three(spark, sf), MODELS, ["id", "y"]), ["model"]).select("model", "ap"))
    return r(ranking.best_marked(ap, "model", "ap", "length")).orderBy(F.desc("ap"), "model")


@query(f"""WITH {roles.SCORES.format(label='quality')} SELECT grp, round(sqrt(avg(power(dscore / 1000 - y, 2))), 8) AS rmse FROM s GROUP BY grp""")
def rmse_by_group(spark, sf):
    return r(inference.rmse(roles.scores(spark, sf).withColumn("score", F.col("score") / 1000), ["grp"]))


@query(f"""WITH {_S3}, o AS (SELECT model, y, row_number() OVER (PARTITION BY model ORDER BY score DESC, id) AS rn, count(*) OVER (PARTITION BY model) AS n, sum(y) OVER (PARTITION BY model) AS p FROM l), k AS (SELECT unnest([10, 50, 100]) AS k),
h AS (SELECT model, k, max(n) AS n, CAST(max(p) AS BIGINT) AS p, CAST(sum(y) FILTER (rn <= k) AS BIGINT) AS hits FROM o CROSS JOIN k GROUP BY ALL),
t AS (SELECT h.*, (SELECT coalesce(sum(exp(lgamma(p + 1.0) - lgamma(i + 1.0) - lgamma(p - i + 1.0) + lgamma(n - p + 1.0) - lgamma(k - i + 1.0) - lgamma(n - p - k + i + 1.0) - lgamma(n + 1.0) + lgamma(k + 1.0) + lgamma(n - k + 1.0))), 0.0)
        FROM (SELECT unnest(range(hits, least(p, k) + 1)) AS i) WHERE k - i <= n - p) AS pv FROM h)
SELECT model, k, hits, round(least(1.0, pv), 8) AS p_value, least(1.0, pv) < 0.05 / count(*) OVER () AS significant FROM t""")
def top_k_significance(spark, sf):
    """Hypergeometric test of each model's first k rows, with Bonferroni's step."""
    rows = ranking.melted(three(spark, sf), MODELS, ["id", "y"])
    base = rows.groupBy("model").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    counts = ranking.top_k(rows, ["model"], [10, 50, 100]).select("model", "k", "hits").join(base, "model")
    return r(inference.top_k_test(counts).select("model", "k", "hits", "p_value", "significant"))


#: A draw of a resample: row number z % n of draw i (from 1) in replicate r (from 1),
#: by arithmetic that both engines do exactly.
REPLICATES, _P = 200, 2147483647
_DRAWS = f"""{_S3}, rows AS (SELECT id, y, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM m),
x AS (SELECT r, place, n, ((place + 1) * 48271 + r * 69621) % {_P} AS x FROM rows CROSS JOIN (SELECT unnest(range(1, {REPLICATES + 1})) AS r)),
d AS (SELECT r AS rep, ((x * x + 16807) % {_P} * 48271 + x) % {_P} % n AS place FROM x),
g AS (SELECT rep, id, count(*) AS w FROM d JOIN rows USING (place) GROUP BY ALL),
v AS (SELECT rep, model, y, w, sum(w) OVER (PARTITION BY rep, model ORDER BY score DESC, l.id) AS upto FROM g JOIN l ON g.id = l.id),
dr AS (SELECT rep, model, sum(greatest(0, least(w, 50 - (upto - w))) * y) / 50.0::DOUBLE AS p FROM v GROUP BY ALL)"""


def given_draws(spark, sf):
    s = three(spark, sf)
    n, positives = s.agg(F.count("*"), F.sum("y")).first()
    heads = inference.head(s, MODELS, n)
    place = ranking.F.row_number().over(inference.Window.orderBy("id")) - 1
    rows = s.select("id", place.alias("place"))
    x = spark.range(n).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(REPLICATES)))).select("rep", ((F.col("id") + 1) * 48271 + F.col("rep") * 69621).alias("x")).withColumn("x", F.col("x") % _P)
    d = x.select("rep", (((F.col("x") * F.col("x") + 16807) % _P * 48271 + F.col("x")) % _P % n).alias("place"))
    weights = d.groupBy("rep", "place").agg(F.count("*").alias("w")).join(rows, "place").select("rep", "id", "w")
    return inference.precision_draws(heads, weights, positives / n, [50])


@query(f"""WITH {_DRAWS} SELECT model, 50 AS k, round(quantile_cont(p, 0.025), 8) AS lo, round(quantile_cont(p, 0.975), 8) AS hi, round(avg(p), 8) AS mean, round(stddev_pop(p), 8) AS sd FROM dr GROUP BY model""")
def bootstrap_intervals(spark, sf):
    """Percentile intervals of P@50 over given draws of whole resamples."""
    return r(inference.intervals(given_draws(spark, sf), "p", ["model", "k"]))


@query(f"""WITH {_DRAWS}, e AS (SELECT a.model, a.p - b.p AS delta FROM dr a JOIN dr b ON a.rep = b.rep AND b.model = 'length' WHERE a.model <> 'length'),
q AS (SELECT model, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi, avg(delta) AS mean, stddev_pop(delta) AS sd, avg(CAST(delta > 0 AS INT)) AS above FROM e GROUP BY model)
SELECT model, 50 AS k, round(lo, 8) + 0.0 AS lo, round(hi, 8) + 0.0 AS hi, round(mean, 8) + 0.0 AS mean, round(sd, 8) AS sd, round(above, 8) AS above, lo > 0 OR hi < 0 AS significant FROM q""")
def bootstrap_deltas(spark, sf):
    """Paired differences of P@50 to one model over the same draws."""
    return r(inference.paired_deltas(given_draws(spark, sf), "p", "length", ["k"]))
