"""Trees on different rows with their counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from belated.operators import learners, policy, trees


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, "train" if i % 3 else "test", float(i % 7), float(i % 5), int(i % 7 > 4)) for i in range(420)]
    return spark.createDataFrame(rows, "entity_id long, fold string, a double, b double, psb int").cache()


def test_thresholds_are_midpoints_or_equal_shares():
    assert trees.thresholds(np.array([0.0, 1, 1, 3]), np.ones(4)).tolist() == [0.5, 2.0]
    assert trees.thresholds(np.arange(64.0), np.ones(64)).tolist() == [2 * i + 1.5 for i in range(31)]


def test_counts_stand_for_repeated_rows():
    rng = np.random.default_rng(0)
    b, t, n = rng.integers(0, 6, (80, 4)).astype(np.uint8), rng.normal(size=80), rng.integers(0, 5, 80)
    w = rng.uniform(1, 3, 80)
    few = trees.grow(b, t, w, n, 4, 4, 5, np.random.default_rng(1))
    many = trees.grow(*(np.repeat(x, n, 0) for x in (b, t, w)), np.ones(n.sum(), int), 4, 4, 5, np.random.default_rng(1))
    assert [x.tolist() for x in few[:3]] == [x.tolist() for x in many[:3]] and len(few[0]) > 7
    assert few[3] == pytest.approx(many[3])


def test_least_rows_of_a_leaf():
    b = np.array([[0], [1]], np.uint8)
    t, w = np.array([0.0, 1.0]), np.ones(2)
    assert len(trees.grow(b, t, w, np.array([4, 9]), 6, 1, 5, np.random.default_rng(0))[0]) == 1
    assert trees.grow(b, t, w, np.array([5, 9]), 6, 1, 5, np.random.default_rng(0))[3].tolist() == [9 / 14, 0.0, 1.0]


def test_cascade_takes_few_jobs(spark, data):
    """A job a level of a tree was over 700 jobs here."""
    stages = {c: data.select("entity_id", "fold", "a", "b") for c in (3.5, 7.5, 11.5)}
    run = lambda: policy.cascade(stages, dict.fromkeys(stages, ["a", "b"]), data.select("entity_id", "psb"), trees=40).collect()
    got, n = jobs(spark, "cascade", run)
    assert n < 100 and len(got) == 420
    assert all((r["q115"] > 0) == (r["q35"] > 0) == bool(r["psb"]) for r in got)


def test_classifiers_take_few_jobs(spark, data):
    """Boosting took over 500 jobs here."""
    x = learners.assemble(data, ["a", "b"])
    rows = trees.different(x.filter("fold = 'train'"), "y")
    for kind, most in (("boosted", 5), ("forest", 5)):
        got, n = jobs(spark, kind, lambda kind=kind: learners.classify(x, kind, trees=80, rows=rows).collect())
        assert n < most and min(r["score"] for r in got if r["y"]) > max(r["score"] for r in got if not r["y"])


def test_fits_are_those_of_mllib(data, monkeypatch):
    """Equal up to the draws."""
    x = learners.assemble(data, ["a", "b"])
    score = lambda kind: {r["entity_id"]: r["score"] for r in learners.classify(x, kind, trees=12).collect()}
    own = {kind: score(kind) for kind in ("forest", "boosted", "logistic")}
    monkeypatch.setattr(trees, "different", lambda *a: None)
    for kind, near in (("forest", 0.1), ("boosted", 0.01), ("logistic", 1e-3)):
        want = score(kind)
        assert own[kind].keys() == want.keys() and max(abs(own[kind][i] - want[i]) for i in want) < near


def test_more_different_rows_than_most_go_to_mllib(data):
    x = learners.assemble(data, ["a", "b"]).filter("fold = 'train'")
    assert trees.different(x, "y", most=34) is None
    assert int(trees.different(x, "y", most=35)[3].sum()) == x.count()
    assert trees.different(x.filter(F.lit(False)), "y") is None
