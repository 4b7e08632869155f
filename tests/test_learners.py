"""Learners on small separable data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from belated.operators import learners, networks


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, "train" if i % 3 else "test", float(i % 7), float(i % 7 > 4), int(i % 7 > 4)) for i in range(210)]
    return spark.createDataFrame(rows, "entity_id long, fold string, a double, b double, psb int")


@pytest.mark.parametrize("kind", ["forest", "boosted", "logistic"])
def test_classifiers_separate(data, kind):
    got = learners.classify(learners.assemble(data, ["a", "b"]), kind, trees=5).filter("fold = 'test'").collect()
    assert len(got) == 70
    assert min(r["score"] for r in got if r["y"] == 1) > max(r["score"] for r in got if r["y"] == 0)


def test_one_class_gives_its_rate(data):
    got = learners.classify(learners.assemble(data.withColumn("psb", F.lit(0)), ["a"]), "forest").select("score").distinct().collect()
    assert [r[0] for r in got] == [0.0]


def test_scale_is_population(spark, data):
    x = learners.scale(d := learners.assemble(data, ["a"]), d).select(learners.vector_to_array("x")[0].alias("x"))
    mean, sd = x.agg(F.avg("x"), F.stddev_pop("x")).first()
    assert mean == pytest.approx(0, abs=1e-9) and sd == pytest.approx(1)


def test_components_are_centred(spark):
    v = spark.createDataFrame([(i, [float(i), 2.0 * i + 1, 0.0], True) for i in range(10)], "id long, v array<double>, train boolean")
    got = sorted(abs(r["v"][0]) for r in learners.components(v, 1).collect())
    want = sorted(abs((i - 4.5) * 5**0.5) for i in range(10))
    assert got == pytest.approx(want)


def test_oversampled_rows_lie_between(spark):
    rows = [(i, [0.0, float(i)], 0) for i in range(100)] + [(200 + i, [1.0, float(i)], 1) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    made = learners.oversample(df, ratio=0.2).filter("id IS NULL").collect()
    assert 1 <= len(made) <= 16 and all(r["v"][0] == 1.0 and 0 <= r["v"][1] <= 3 for r in made)


@pytest.mark.parametrize("loss", networks.LOSSES)
def test_gradients(loss):
    rng = np.random.default_rng(1)
    s, t, w = rng.normal(size=6), rng.normal(size=6), rng.uniform(1, 3, 6)
    g = networks.LOSSES[loss](s, t, w)[1]
    for i in range(6):
        d = np.zeros(6)
        d[i] = 1e-6
        assert g[i] == pytest.approx((networks.LOSSES[loss](s + d, t, w)[0] - networks.LOSSES[loss](s - d, t, w)[0]) / 2e-6, abs=1e-5)


def test_network_learns(data):
    df = data.withColumn("target", -3.85 + 8.0 * F.col("psb")).withColumn("weight", F.lit(1.0))
    got = {r["entity_id"]: r["score"] for r in networks.fit_predict(df, ["a", "b"], "target", "weight", epochs=200).collect()}
    assert len(got) == 210 and all((q > 0) == (i % 7 > 4) for i, q in got.items())


@pytest.mark.parametrize("cell", [8192, 7])
def test_nearest_are_exact(spark, cell):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 4, (40, 3)).astype(float)  # many ties and copies
    got = {r["id"]: r["near"] for r in learners.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>"), 5, cell).collect()}
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    assert got == {i: sorted((j for j in range(40) if j != i), key=lambda j: (d[i, j], j))[:5] for i in range(40)}


def test_oversample_makes_no_pairs_of_rows(spark):
    """A join of all positives with all took them as rows through one key."""
    rows = [(i, [float(i), 0.0], int(i < 30)) for i in range(300)] + [(500, None, 1), (None, [1.0, 1.0], 1)]
    out = learners.oversample(spark.createDataFrame(rows, "id long, v array<double>, y int"), ratio=0.5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "FlatMapCoGroupsInPandas" in plan
    made = out.filter("id IS NULL").collect()
    assert 70 < len(made) < 140 and all(r["v"] is not None and (r["v"][1] == 0.0 or r["v"] == [1.0, 1.0]) for r in made)


def test_sample_is_the_least_hashes_and_no_more_is_sent(spark):
    df = spark.range(20_000).selectExpr("id AS entity_id", "if(id % 2 = 0, 'train', 'val') AS fold", "id AS a", "1.0D AS t", "1.0D AS w").repartition(8)
    want = [r["a"] for r in df.orderBy(F.xxhash64("entity_id")).limit(500).collect()]
    sent = []
    table = type(df).toArrow
    type(df).toArrow = lambda self: sent.append(self.count()) or table(self)
    try:
        got = networks.sampled(df, ["a"], "t", "w", max_rows=500)
    finally:
        type(df).toArrow = table
    assert got["a"].tolist() == want and 500 <= sent[0] < 600
    assert len(networks.sampled(df, ["a"], "t", "w")) == 20_000 and not len(networks.sampled(df.filter("a < 0"), ["a"], "t", "w"))
