"""Hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from belated.functions import curves
from belated.operators import inference, labels, policy, ranking
from belated.sources import files


@pytest.mark.parametrize("c, b, tm, ta", [([1, 0, 0, 4], 5.0, 3, 2), ([3, 1, 0], 0.0, 0, 0), ([0, 2, 2], 0.0, 1, 0)])
def test_beauty(spark, c, b, tm, ta):
    df = spark.createDataFrame([(c,)], "c array<bigint>")
    x = F.col("c")
    assert tuple(df.select(curves.beauty(x), curves.peak_age(x), curves.awakening_age(x)).first()) == (pytest.approx(b), tm, ta)


def test_shape(spark):
    x = F.col("c")
    df = spark.createDataFrame([([1, 0, 0, 4],)], "c array<bigint>")
    got = df.select(curves.burstiness(x), curves.gini(x), curves.first_nonzero_age(x), curves.longest_zero_run(x), curves.resurgences(x)).first()
    assert tuple(got) == (pytest.approx(1.311488, abs=1e-6), pytest.approx(0.65), 0, 2, 1)


def test_percentile_rank(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("a", 5)], "g string, n int")
    assert sorted(r[0] for r in df.select(labels.percentile_rank(df, F.col("n"), "g")).collect()) == [0.5, 0.5, 1.0]


def test_average_precision(spark):
    df = spark.createDataFrame([(1, 3.0, "a"), (0, 2.0, "a"), (1, 1.0, "a"), (1, 2.0, "b"), (0, 2.0, "b")], "y int, score double, g string")
    assert {r["g"]: r["ap"] for r in ranking.average_precision(df, ["g"]).collect()} == {"a": pytest.approx(0.833333, abs=1e-6), "b": 0.0}


def test_backups(spark):
    df = spark.createDataFrame([(-2.0,), (None,)], "q double")
    got = df.select(*(policy.backup(k, F.col("q"), 1.0).alias(k) for k in ("clip", "no_clip", "softplus"))).collect()
    assert tuple(got[0]) == (-1.0, -3.0, pytest.approx(-0.873072, abs=1e-6)) and got[1]["clip"] == -1.0


def test_hypergeometric():
    assert inference.hypergeometric(166665, 425, 100, 6) == pytest.approx(2.584e-07, rel=1e-3)


def test_whitespace_rows(spark):
    lines = spark.createDataFrame([(" a b  c d e f ",), ("a b c d e f g h",), ("a b",)], "value string")
    got = files.whitespace_rows(lines, list("1234567")).collect()
    assert sorted(r[6] for r in got) == ["", "g"]
