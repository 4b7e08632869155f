"""All registered queries with their SQL.  Floating results are rounded on both
sides to digits that both engines agree on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import curves
from ..operators import graph, inference, labels, policy, ranking, vectors
from . import roles

CFG = Config()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def r(df: DataFrame, digits: int = 8) -> DataFrame:
    """Round the doubles (and make -0.0 plain)."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"WITH {roles.EDGES} SELECT entity_id, cite_year, count(*) AS fwd_count FROM e GROUP BY ALL")
def annual_counts(spark, sf):
    return graph.annual_counts(roles.edges(spark, sf))


@query(f"WITH {roles.EDGES.replace(' WHERE l_quantity > 45', '')} SELECT entity_id, cite_year, count(*) AS fwd_count FROM e GROUP BY ALL")
def annual_counts_all(spark, sf):
    """Annual counts over all rows of the edge table."""
    return graph.annual_counts(roles.all_edges(spark, sf))


@query(f"WITH {roles.EDGES} SELECT citing, count(*) AS bwd_total, count(*) FILTER (category = 'examiner') AS bwd_examiner, count(*) FILTER (category = 'applicant') AS bwd_applicant FROM e GROUP BY citing")
def backward_counts(spark, sf):
    return graph.backward_counts(roles.edges(spark, sf))


def _labels(spark, sf, tail):
    s = labels.scored(graph.curves(roles.edges(spark, sf), CFG.label_age), 9)
    return labels.tail_labels(s, roles.entities(spark, sf).select("entity_id", F.col("subclass").alias("class")), tail, CFG.min_class)


def _label_sql(tail):
    return f"""WITH {roles.beauty_sql(CFG.label_age)},
t AS (SELECT s.*, coalesce(p_type || '/' || p_brand, 'UNKNOWN') AS class FROM s LEFT JOIN part ON p_partkey = entity_id),
q AS (SELECT class, count(*) AS n, quantile_cont(b, {1 - tail}) AS q FROM t GROUP BY class)
SELECT class, entity_id, b, t_m, t_a, total_citations, peak_citations, CAST(n >= {CFG.min_class} AND q > 0 AND b >= q AS INT) AS psb FROM t JOIN q USING (class)"""


for _tail in CFG.tails:
    _name = "beauty_labels" if _tail == 0.010 else f"beauty_labels_{int(_tail * 1000):03d}"
    query(_label_sql(_tail), _name)(lambda spark, sf, tail=_tail: _labels(spark, sf, tail))


def _scored(top):
    def f(spark, sf):
        return labels.scored(graph.curves(roles.edges(spark, sf), top), 9)

    return f


for _name, _top in (("beauty_11yr", 11), ("beauty_early", 3)):
    query(f"WITH {roles.beauty_sql(_top)} SELECT entity_id, b, t_m, t_a, total_citations, peak_citations FROM s", _name)(_scored(_top))


def _citation_features(cutoff):
    n = int(cutoff)

    def f(spark, sf):
        c = graph.curves(roles.edges(spark, sf), CFG.feature_age)
        feats = curves.citation_features(F.col("c"), n)
        out = roles.entities(spark, sf).select("entity_id").join(c, "entity_id", "left").select("entity_id", *(F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in feats.items()))
        return r(out.withColumns({"decision_point": F.lit(cutoff), "maint_cost": F.lit(CFG.costs[cutoff])}))

    x = lambda a: f"sum(x) FILTER (age = {a})"
    cum = f"sum(x) FILTER (age <= {n})"
    parts = {"cum_citations": cum} | {f"cite_yr{a}": x(a) for a in range(n + 1)}
    parts |= {"cite_last1yr": x(n), "cite_last3yr": f"sum(x) FILTER (age BETWEEN {n - 2} AND {n})", "cite_growth_rate": f"({x(n)} - {x(0)}) / ({x(0)} + 1.0)", "cite_growth_last3": f"({x(n)} - {x(n - 3)}) / ({x(n - 3)} + 1.0)", "cite_acceleration": f"({x(n)} - {x(n - 1)}) - ({x(n - 1)} - {x(n - 2)})", "cite_peak_ratio": f"max(x) FILTER (age <= {n}) / greatest({cum}, 1.0)", "cite_active_years": f"count(*) FILTER (age <= {n} AND x > 0)", "zero_citation": f"CAST({cum} = 0 AS INT)"}
    sql = f"""WITH {roles.curve_sql(CFG.feature_age)},
f AS (SELECT entity_id, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in parts.items())} FROM c GROUP BY entity_id)
SELECT p_partkey AS entity_id, {', '.join(f'round(coalesce({k}, 0.0), 8) + 0.0 AS {k}' for k in parts)}, CAST({cutoff} AS DOUBLE) AS decision_point, CAST({CFG.costs[cutoff]} AS DOUBLE) AS maint_cost
FROM part LEFT JOIN f ON p_partkey = entity_id"""
    return f, sql


for _cut in CFG.cutoffs:
    _f, _sql = _citation_features(_cut)
    query(_sql, f"citation_features_{str(_cut).replace('.', '_')}")(_f)


@query(f"""WITH {roles.curve_sql(20)},
d AS (SELECT * FROM c WHERE age <= 7),
g AS (SELECT entity_id, sum(x) AS s, avg(x) AS mean, stddev_pop(x) AS sd, min(age) FILTER (x > 0) AS first FROM d GROUP BY entity_id),
o AS (SELECT entity_id, sum((8 - rn + 1) * x) AS cs FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY x) AS rn FROM d) GROUP BY entity_id),
z AS (SELECT entity_id, max(n) AS run FROM (SELECT entity_id, grp, count(*) AS n FROM (SELECT *, age - row_number() OVER (PARTITION BY entity_id ORDER BY age) AS grp FROM d WHERE x = 0) GROUP BY ALL) GROUP BY entity_id),
v AS (SELECT entity_id, count(*) FILTER (x > 0 AND p = 0) AS up FROM (SELECT *, lag(x) OVER (PARTITION BY entity_id ORDER BY age) AS p FROM d) GROUP BY entity_id)
SELECT g.entity_id, round(CASE WHEN s = 0 THEN 0.0 ELSE sd / mean END, 8) AS burstiness, round(CASE WHEN s = 0 THEN 0.0 ELSE (9 - 2.0 * cs / s) / 8 END, 8) + 0.0 AS gini,
       CAST(coalesce(first, -1) AS INT) AS first_nonzero_age, CAST(coalesce(run, 0) AS INT) AS zero_run, CAST(up AS INT) AS resurgences
FROM g JOIN o USING (entity_id) LEFT JOIN z USING (entity_id) JOIN v USING (entity_id)""")
def shape_features(spark, sf):
    c = graph.curves(roles.edges(spark, sf), CFG.feature_age).select("entity_id", F.slice("c", 1, 8).alias("c"))
    x = F.col("c")
    return r(c.select("entity_id", curves.burstiness(x).alias("burstiness"), curves.gini(x).alias("gini"), curves.first_nonzero_age(x).alias("first_nonzero_age"), curves.longest_zero_run(x).alias("zero_run"), curves.resurgences(x).alias("resurgences")))


@query(f"""WITH {roles.EDGES}, k AS (SELECT entity_id, count(*) AS n FROM e WHERE age BETWEEN 0 AND 7 GROUP BY ALL),
t AS (SELECT p_partkey AS entity_id, p_type || '/' || p_brand AS subclass, 1980 + p_partkey % 10 AS y, coalesce(n, 0) AS n FROM part LEFT JOIN k ON entity_id = p_partkey)
SELECT entity_id, round((rank() OVER (PARTITION BY subclass, y ORDER BY n) + (count(*) OVER (PARTITION BY subclass, y, n) - 1) / 2.0) / count(*) OVER (PARTITION BY subclass, y), 8) AS pct FROM t""")
def class_percentile(spark, sf):
    k = roles.edges(spark, sf).filter("age between 0 and 7").groupBy("entity_id").agg(F.count("*").alias("n"))
    t = roles.entities(spark, sf).join(k, "entity_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return r(t.select("entity_id", labels.percentile_rank(t, F.col("n"), "subclass", "grant_year").alias("pct")))


_SEG = "['" + "', '".join(roles.SEGMENTS) + "']"


def _citer(n):
    h = n // 2

    def f(spark, sf):
        return r(graph.citer_quality(roles.rich_edges(spark, sf), n), 7)

    sql = f"""WITH {roles.EDGES},
x AS (SELECT e.entity_id, age, category, coalesce(c_mktsegment, 'UNK') AS seg, supplier, c_nationkey AS loc,
        coalesce(c_mktsegment, 'UNK') <> ({_SEG})[p_size % 5 + 1] AND c_mktsegment IS NOT NULL AS xc, supplier = e.entity_id % (SELECT count(*) FROM supplier) AS sa
      FROM e LEFT JOIN orders ON citing = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON p_partkey = e.entity_id WHERE age BETWEEN 0 AND {n}),
a AS (SELECT entity_id, count(*) AS n_citers, avg(age) AS rec, avg(CAST(xc AS INT)) AS xr, avg(CAST(sa AS INT)) AS sr, avg(CAST(category = 'examiner' AS INT)) AS er,
        coalesce(avg(CAST(xc AS INT)) FILTER (age > {h}) - avg(CAST(xc AS INT)) FILTER (age <= {h}), 0.0) AS slope, count(DISTINCT supplier) / CAST(count(*) AS DOUBLE) AS uq FROM x GROUP BY entity_id),
b AS (SELECT entity_id, sum(-p * ln(p)) AS d FROM (SELECT entity_id, count(*) / CAST(sum(count(*)) OVER (PARTITION BY entity_id) AS DOUBLE) AS p FROM x GROUP BY entity_id, seg) GROUP BY entity_id),
l AS (SELECT entity_id, sum(-p * ln(p)) AS d FROM (SELECT entity_id, count(*) / CAST(sum(count(*)) OVER (PARTITION BY entity_id) AS DOUBLE) AS p FROM x GROUP BY entity_id, loc) GROUP BY entity_id),
s AS (SELECT entity_id, sum(p * p) AS d FROM (SELECT entity_id, count(*) / CAST(sum(count(*)) OVER (PARTITION BY entity_id) AS DOUBLE) AS p FROM x GROUP BY entity_id, supplier) GROUP BY entity_id)
SELECT a.entity_id, n_citers, round(rec, 7) AS citer_recency_mean, round(xr, 7) AS citer_ipc_cross_rate, round(sr, 7) AS citer_self_rate, round(er, 7) AS citer_examiner_rate, round(slope, 7) + 0.0 AS cross_ipc_slope,
       round(ln(1 + n_citers), 7) AS n_citers_log, round(b.d, 7) + 0.0 AS citer_ipc_diversity, round(l.d, 7) + 0.0 AS citer_loc_diversity, round(s.d, 7) AS citer_assignee_hhi, round(uq, 7) AS citer_assignee_unique_rate
FROM a JOIN b USING (entity_id) JOIN l USING (entity_id) JOIN s USING (entity_id)"""
    return f, sql


for _cut in CFG.cutoffs:
    _f, _sql = _citer(int(_cut))
    query(_sql, f"citer_quality_{str(_cut).replace('.', '_')}")(_f)


@query("""WITH f AS (SELECT user_id, CAST(min(ts) AS DATE) AS anchor FROM events GROUP BY user_id),
p AS (SELECT e.user_id, CAST(CAST(ts AS DATE) - anchor AS DOUBLE) AS age FROM events e JOIN f USING (user_id) WHERE event_type LIKE 'pu%' AND value > 20),
g AS (SELECT f.user_id AS entity_id, coalesce(bool_or(age BETWEEN 3 AND 5), false) AS a, coalesce(bool_or(age BETWEEN 6.5 AND 9), false) AS b, coalesce(bool_or(age BETWEEN 10.5 AND 13.5), false) AS c FROM f LEFT JOIN p USING (user_id) GROUP BY f.user_id)
SELECT entity_id, CAST(a AS INT) AS paid_3_5, CAST(b AS INT) AS paid_7_5, CAST(c AS INT) AS paid_11_5, CAST(CASE WHEN NOT a THEN 3.5 WHEN NOT b THEN 7.5 WHEN NOT c THEN 11.5 ELSE 17 END AS DOUBLE) AS lapsed_age FROM g""")
def maintenance_flags(spark, sf):
    users = roles.table(spark, sf, "events").select(F.col("user_id").alias("entity_id")).filter("entity_id is not null").distinct()
    return graph.maintenance(roles.paid_events(spark, sf), users)


@query("""WITH t AS (SELECT p_partkey AS entity_id, 1980 + p_partkey % 10 AS y, substr(p_type, 1, 1) AS section, p_type AS class_full, p_type || '/' || p_brand AS subclass FROM part),
x AS (SELECT section, count(*) AS n FROM t WHERE y BETWEEN 1982 AND 1986 GROUP BY ALL), z AS (SELECT class_full, count(*) AS n FROM t WHERE y BETWEEN 1982 AND 1986 GROUP BY ALL), w AS (SELECT subclass, count(*) AS n FROM t WHERE y BETWEEN 1982 AND 1986 GROUP BY ALL)
SELECT entity_id, CASE WHEN y BETWEEN 1982 AND 1986 THEN 'train' WHEN y = 1987 THEN 'val' WHEN y >= 1988 THEN 'test' END AS fold, coalesce(x.n, 0) AS section_enc, coalesce(z.n, 0) AS class_full_enc, coalesce(w.n, 0) AS subclass_enc
FROM t LEFT JOIN x USING (section) LEFT JOIN z USING (class_full) LEFT JOIN w USING (subclass)""")
def frequency_encoding(spark, sf):
    out = labels.frequency_encoding(roles.entities(spark, sf), ["section", "class_full", "subclass"])
    return out.select("entity_id", labels.fold(F.col("grant_year")).alias("fold"), "section_enc", "class_full_enc", "subclass_enc")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def keep_first(spark, sf):
    return graph.keep_first(roles.table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


_V = "v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, vec_id % 10 BETWEEN 2 AND 6 AS train FROM embeddings)"
_COS = "1 - list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-12) * (sqrt(list_dot_product({b}, {b})) + 1e-12))"


@query(f"""WITH {_V}, d AS (SELECT label, train, i.range AS i, v[i.range + 1] AS x FROM v CROSS JOIN range(64) i),
cl AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m, count(*) AS n FROM d WHERE train GROUP BY ALL) WHERE n >= 5 GROUP BY label),
gl AS (SELECT list(m ORDER BY i) AS g FROM (SELECT i, avg(x) AS m FROM d WHERE train GROUP BY i)),
p AS (SELECT id, v.label AS class, cl.label = v.label AS own, {_COS.format(a='v', b='c')} AS d FROM v CROSS JOIN cl),
q AS (SELECT id, class, min(d) FILTER (own) AS own, min(d) FILTER (NOT own) AS other FROM p GROUP BY ALL)
SELECT q.id, class, round(coalesce(own, {_COS.format(a='v', b='g')}), 7) AS own, round(other, 7) AS other, round({_COS.format(a='v', b='g')}, 7) AS outlier, round(other - coalesce(own, {_COS.format(a='v', b='g')}), 7) + 0.0 AS margin
FROM q JOIN v ON q.id = v.id CROSS JOIN gl""")
def class_distances(spark, sf):
    return r(vectors.class_distances(roles.vectors(spark, sf), 64), 7)


@query(f"""WITH {_V}, z AS (SELECT label FROM v GROUP BY label HAVING count(*) > 20 AND count(*) FILTER (train) > 20),
p AS (SELECT x.id, {_COS.format(a='x.v', b='y.v')} AS d, row_number() OVER (PARTITION BY x.id ORDER BY {_COS.format(a='x.v', b='y.v')}, y.id) AS rn FROM v x JOIN v y ON x.label = y.label AND y.train WHERE x.label IN (SELECT label FROM z)),
k AS (SELECT id, avg(d) AS m FROM p WHERE rn <= 20 GROUP BY id) SELECT v.id, round(coalesce(m, 0.5), 6) AS density FROM v LEFT JOIN k USING (id)""")
def class_density(spark, sf):
    return r(vectors.density(roles.vectors(spark, sf)), 6)


@query(f"""WITH {roles.SCORES.format(label='quality')}, q AS (SELECT id, y, dscore / 1000 - 2 AS q FROM s)
SELECT id, CAST(-3.85 + 8.0 * y AS DOUBLE) AS terminal, round(-1.0 + greatest(q, 0), 8) AS clip, round(-1.0 + q, 8) AS no_clip, round(-1.0 + CASE WHEN q > 30 THEN q ELSE ln(1 + exp(least(q, 30))) END, 8) AS softplus, round(-1.0 + 0.8 * y + greatest(q, 0), 8) AS shaped FROM q""")
def backup_targets(spark, sf):
    s = roles.scores(spark, sf).withColumn("q", F.col("score") / 1000 - 2)
    q = F.col("q")
    return r(s.select("id", policy.terminal(F.col("y")).alias("terminal"), policy.backup("clip", q, 1.0).alias("clip"), policy.backup("no_clip", q, 1.0).alias("no_clip"), policy.backup("softplus", q, 1.0).alias("softplus"), policy.backup("reward_shaping", q, 1.0, F.col("y"), 0.1).alias("shaped")))


_AP = """c AS (SELECT grp, score, sum(y) AS pos, count(*) AS n FROM t GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER (PARTITION BY grp ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY grp ORDER BY score DESC) AS k, sum(pos) OVER (PARTITION BY grp) AS p, sum(n) OVER (PARTITION BY grp) AS total FROM c)"""


@query(f"""WITH {roles.SCORES.format(label='quality')}, t AS (SELECT grp, tscore AS score, y FROM s), {_AP}
SELECT grp, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE sum(pos / CAST(p AS DOUBLE) * tp / k) END, 8) AS ap, CAST(max(p) AS BIGINT) AS positives, CAST(max(total) AS BIGINT) AS n,
       round(sum((n - pos) * (tp - pos + pos / 2.0)) / nullif(max(p) * (max(total) - max(p)), 0), 8) AS auroc, round(coalesce(max(tp / CAST(p AS DOUBLE)) FILTER (tp / CAST(k AS DOUBLE) >= 0.9), 0.0), 8) AS recall_at_precision FROM w GROUP BY grp""")
def ranking_by_group(spark, sf):
    s = roles.scores(spark, sf, tied=True).select("grp", "score", "y")
    out = ranking.average_precision(s, ["grp"]).join(ranking.auroc(s, ["grp"]), "grp").join(ranking.recall_at_precision(s, ["grp"], 0.9), "grp")
    return r(out)


@query(f"""WITH {roles.SCORES.format(label='toxic')}, b AS (SELECT grp, count(*) AS n, sum(y) AS p FROM s GROUP BY grp),
o AS (SELECT grp, y, row_number() OVER (PARTITION BY grp ORDER BY tscore DESC, id) AS rn FROM s), k AS (SELECT unnest([10, 50, 100]) AS k),
h AS (SELECT b.grp, k.k, n, p, coalesce(sum(y), 0) AS hits FROM b CROSS JOIN k LEFT JOIN o ON o.grp = b.grp AND rn <= k.k GROUP BY ALL)
SELECT grp, k, CAST(hits AS BIGINT) AS hits, round(hits / CAST(least(k, n) AS DOUBLE), 8) AS precision, round(hits / CAST(nullif(p, 0) AS DOUBLE), 8) AS recall, round(hits / CAST(least(k, n) AS DOUBLE) / (nullif(p, 0) / CAST(n AS DOUBLE)), 8) AS lift FROM h""")
def top_k_by_group(spark, sf):
    return r(ranking.top_k(roles.scores(spark, sf, "toxic", tied=True), ["grp"], [10, 50, 100]))


@query(f"""WITH {roles.SCORES.format(label='toxic')}, o AS (SELECT y, row_number() OVER (ORDER BY dscore DESC, id) AS rn, count(*) OVER () AS n, sum(y) OVER () AS p FROM s), k AS (SELECT unnest([1, 10, 100, 200]) AS k)
SELECT k, round(sum(y) FILTER (rn <= k) / CAST(max(p) AS DOUBLE), 8) AS recall, round(least(k * max(p) / CAST(max(n) AS DOUBLE), max(p)) / max(p), 8) AS random_recall FROM o CROSS JOIN k GROUP BY k""")
def recall_curve(spark, sf):
    return r(ranking.recall_curve(roles.scores(spark, sf, "toxic"), [1, 10, 100, 200]))


@query(f"""WITH {roles.SCORES.format(label='toxic')}, a AS (SELECT grp, sum(CAST(dscore > 2000 AS INT)) AS m, sum(CAST(dscore > 2000 AS INT) * y) AS h FROM s GROUP BY grp)
SELECT grp, CAST(m AS BIGINT) AS maintained, CAST(h AS BIGINT) AS hits, round(m * 6.73::DOUBLE, 6) AS cost, round(h * 8.0::DOUBLE, 6) AS benefit, round(h * 8.0::DOUBLE - m * 6.73::DOUBLE, 6) + 0.0 AS net, round(CASE WHEN m > 0 THEN h * 8.0::DOUBLE / (m * 6.73::DOUBLE) ELSE 0.0 END, 6) AS ratio FROM a""")
def economics(spark, sf):
    s = roles.scores(spark, sf, "toxic").withColumn("kept", (F.col("score") > 2000).cast("int"))
    return r(ranking.economics(s, ["grp"], CFG.reward, CFG.total_cost), 6)


@query(f"""WITH {roles.SCORES.format(label='toxic')}, o AS (SELECT y, row_number() OVER (ORDER BY dscore DESC, id) AS rn FROM s), k AS (SELECT unnest([50, 100, 200]) AS k)
SELECT k, CAST(sum(y) FILTER (rn <= k) AS BIGINT) AS hits, round(sum(y) FILTER (rn <= k) * 8.0::DOUBLE - k, 6) + 0.0 AS profit, round((sum(y) FILTER (rn <= k) * 8.0::DOUBLE - k) / k, 6) + 0.0 AS per_item FROM o CROSS JOIN k GROUP BY k""")
def portfolio_profit(spark, sf):
    return r(ranking.profit(roles.scores(spark, sf, "toxic"), [50, 100, 200]), 6)


@query(f"""WITH {roles.SCORES.format(label='quality')}, g AS (SELECT list_distinct(quantile_cont(tscore, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM s),
b AS (SELECT greatest(1, len(list_filter(e, lambda x: x < tscore))) AS bin, y, tscore FROM s CROSS JOIN g)
SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(y), 8) AS rate, round(avg(tscore), 8) AS mean_score, round(-1.0 + 8.0 * avg(y), 8) AS mean_actual, round(avg(tscore) - (-1.0 + 8.0 * avg(y)), 8) + 0.0 AS error FROM b GROUP BY bin""")
def calibration(spark, sf):
    return r(ranking.calibration(roles.scores(spark, sf, tied=True), 10, CFG.costs[3.5], CFG.reward))


@query("""WITH a AS (SELECT o_custkey AS model, sum(o_totalprice) AS total, 'old' AS src FROM orders WHERE year(o_orderdate) < 1997 GROUP BY ALL),
b AS (SELECT o_custkey AS model, sum(o_totalprice) AS total, 'new' AS src FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY ALL)
SELECT model, round(total, 2) AS total, src FROM a WHERE model NOT IN (SELECT model FROM b) UNION ALL SELECT model, round(total, 2), src FROM b""")
def upsert(spark, sf):
    """Totals of customers by the earlier orders, replaced by those of the later."""
    from ..sources import files

    orders = roles.table(spark, sf, "orders").withColumn("src", F.when(F.year("o_orderdate") < 1997, "old").otherwise("new"))
    total = r(orders.groupBy(F.col("o_custkey").alias("model"), "src").agg(F.sum("o_totalprice").alias("total")), 2)
    return files.upsert(total.filter("src = 'old'"), total.filter("src = 'new'"), "model")


@query()
def bootstrap_precision(spark, sf):
    """Draws of resamples of fixed size, paired over two models."""
    s = roles.scores(spark, sf, "toxic").select("id", "y", F.col("score").alias("length"), F.floor(F.col("score") / 500).cast("double").alias("length_band"))
    return inference.bootstrap(s, ["length", "length_band"], [100], 1000, 42)


@query()
def value_cascade(spark, sf):
    """Three-stage backward induction over the citation features."""
    psb = _labels(spark, sf, 0.01).select("entity_id", "psb")
    folds = roles.entities(spark, sf).select("entity_id", labels.fold(F.col("grant_year")).alias("fold"))
    stages = {c: QUERIES[f"citation_features_{str(c).replace('.', '_')}"](spark, sf).join(folds, "entity_id") for c in CFG.cutoffs}
    feats = {c: [x for x in df.columns if x.startswith(("cum", "cite", "zero"))] for c, df in stages.items()}
    out = policy.cascade(stages, feats, psb, trees=500)
    return policy.flags(out, ["q35", "q75", "q115"])


from . import build, evaluation, models  # noqa: E402, F401  register their queries here
