"""Feature build, sinks, sweeps and resampling on hand-made rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from belated.operators import inference, policy, prepare, ranking, vectors
from belated.sources import files, sinks


def test_coercion(spark):
    df = spark.createDataFrame([("007", "19850230", "1e3", "Y"), ("000", "19850228", "x", None), ("10", None, None, "N")], "i string, d string, n string, f string")
    got = df.select(prepare.strip_zeros(F.col("i")), prepare.day(F.col("d")).cast("string"), prepare.number(F.col("n"), 999), prepare.flag(F.col("f") == "Y"), prepare.code(F.col("d"), F.col("f"))).collect()
    assert [tuple(r) for r in got] == [("7", None, 1000.0, 1, "19850230Y"), ("", "1985-02-28", 999.0, 0, "19850228"), ("10", None, 999.0, 0, "N")]


def test_granted_after_left_joins(spark):
    df = spark.createDataFrame([(1, "utility", 0.0), (2, "utility", 1.0), (3, None, None), (4, "design", 0.0)], "i int, kind string, withdrawn double")
    assert [r["i"] for r in prepare.granted(df).collect()] == [1]


def test_least_in_sequence_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 2, "c"), (1, 2, "b"), (2, None, "z"), (2, None, "y")], "k int, s int, v string")
    got = df.groupBy("k").agg(F.min_by("v", prepare.least_in_sequence(F.col("s"), F.col("v"))).alias("v")).collect()
    assert {r["k"]: r["v"] for r in got} == {1: "b", 2: "y"}


def test_optional_blocks_and_survivors(spark):
    base = spark.createDataFrame([(1,), (2,)], "entity_id int")
    block = spark.createDataFrame([(1, float("inf"), None)], "entity_id int, x double, y int")
    lab = base.withColumn("psb", F.lit(1))
    got = {r["entity_id"]: (r["x"], r["y"]) for r in prepare.model_table(lab, base, block, None).collect()}
    assert got == {1: (0.0, 0.0), 2: (0.0, 0.0)}
    assert prepare.feature_columns(block, ["y", "z"], ["x", "y"]) == ["y", "x"]
    paid = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 1)], "entity_id int, paid_3_5 int, paid_7_5 int")
    assert [r[0] for r in prepare.survivors(paid, 11.5, True).collect()] == [2] and prepare.survivors(paid, 7.5, True).count() == 2 and prepare.survivors(paid, 11.5).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.write_parquet(df, f"{tmp_path}/p", "v")
    assert sinks.optional(spark, f"{tmp_path}/p").count() == 2 and sinks.optional(spark, f"{tmp_path}/none") is None
    for n in "xy":
        sinks.write_csv(df.withColumn("n", F.lit(n)), f"{tmp_path}/r/{n}")
    got = sinks.results(spark, f"{tmp_path}/r/*")
    assert got.count() == 4 and got.select("file").distinct().count() == 2
    made = []
    for _ in range(2):
        assert sinks.cached_stage(spark, f"{tmp_path}/c", lambda: made.append(1) or df).count() == 2
    assert made == [1]
    (tmp_path / "t.tsv").write_text('id\tname\tx\n01\t"a ""b"""\t\n')
    assert [tuple(r) for r in files.read_tsv(spark, f"{tmp_path}/t.tsv", ["id", "name"]).collect()] == [("01", 'a "b"')]


def test_saved_models_score_alike(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df = VectorAssembler(inputCols=["a"], outputCol="x").transform(spark.createDataFrame([(float(i), 2.0 * i) for i in range(9)], "a double, y double"))
    model = LinearRegression(featuresCol="x", labelCol="y").fit(df)
    sinks.save_model(model, f"{tmp_path}/m")
    assert sinks.load_model(f"{tmp_path}/m").transform(df).first()["prediction"] == model.transform(df).first()["prediction"]


def test_sweep_refits_with_each_setting(spark):
    r = random.Random(1)
    rows = [(i, r.random(), i % 3 == 0) for i in range(90)]
    psb = spark.createDataFrame([(i, int(p)) for i, _, p in rows], "entity_id int, psb int")
    stage = spark.createDataFrame([(i, x + 2 * p, "train" if i % 2 else "test") for i, x, p in rows], "entity_id int, f double, fold string")
    stages = {c: stage for c in (3.5, 7.5, 11.5)}
    settings = {"clip": {"kind": "clip", "trees": 2}, "no_clip": {"kind": "no_clip", "trees": 2}, "reward_24": {**policy.REWARDS["reward_24"], "trees": 2}, "weight_50": {**policy.WEIGHTS["weight_50"], "trees": 2}}
    out = policy.sweep(settings, stages, dict.fromkeys(stages, ["f"]), psb).toPandas()
    assert list(out.columns) == ["entity_id", "psb", *settings] and len(out) == 90 and not out[list(settings)].isna().any().any()
    assert out["reward_24"].mean() > out["clip"].mean() >= out["no_clip"].mean()
    assert len(policy.REWARDS) == 6 and len(policy.WEIGHTS) == 8 and len(policy.BACKUPS) == 4
    flags = policy.flags(spark.createDataFrame([(1.0, None), (2.0, 3.0), (-1.0, 1.0)], "a double, b double"), ["a", "b"]).collect()
    assert [(x["policy_a"], x["policy_b"], x["policy_full"]) for x in flags] == [(1, 0, 0), (1, 1, 1), (0, 1, 0)]


def test_bootstrap_of_fixed_size(spark):
    """All positive: 1 in every resample.  Else as often as whole resamples give."""
    r = random.Random(2)
    rows = [(i, float(r.random()), float(i % 7), int(r.random() < 0.3)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    every = inference.bootstrap(df.withColumn("y", F.lit(1)), ["a"], [10], 50)
    assert {x["p"] for x in every.collect()} == {1.0} and every.count() == 50
    draws = inference.bootstrap(df, ["a", "b"], [10, 30], 400).toPandas()
    rng, y = np.random.default_rng(0), np.array([x[3] for x in rows])
    for model, col in (("a", 1), ("b", 2)):
        order = sorted(range(120), key=lambda i: (-rows[i][col], i))
        rank = np.empty(120, int)
        rank[order] = range(120)
        want = []
        for _ in range(2000):
            idx = rng.integers(0, 120, 120)
            top = idx[np.argsort(rank[idx], kind="stable")]
            want.append([y[top[:k]].mean() for k in (10, 30)])
        for j, k in enumerate((10, 30)):
            got = draws[(draws.model == model) & (draws.k == k)].p
            assert got.mean() == pytest.approx(np.mean(want, 0)[j], abs=0.03) and got.std() == pytest.approx(np.std(want, 0)[j], rel=0.25)
    same = inference.paired_deltas(spark.createDataFrame(draws).withColumn("p", F.lit(0.5)), "p", "a", ["k"]).collect()
    assert all((x["mean"], x["above"], x["significant"]) == (0.0, 0.0, False) for x in same)


def test_top_k_test(spark):
    got = inference.top_k_test(spark.createDataFrame([(166665, 425, 100, 6), (100, 10, 10, 0), (20, 20, 5, 5)], "n long, p long, k int, hits long")).collect()
    p = {r["hits"]: r["p_value"] for r in got}
    assert p[6] == pytest.approx(inference.hypergeometric(166665, 425, 100, 6), rel=1e-6) and p[0] == pytest.approx(1.0) and p[5] == pytest.approx(1.0)
    assert {r["hits"]: r["significant"] for r in got} == {6: True, 0: False, 5: False}


def test_running_sums_over_ranges(spark):
    r = random.Random(3)
    rows = [(g, r.choice([r.random(), float(r.randint(0, 5))]), 1) for g in "ab" for _ in range(700)]
    g = spark.createDataFrame(rows, "g string, score double, n int").groupBy("g", "score").agg(F.sum("n").alias("n"))
    got = {(x["g"], x["score"]): x["cum_n"] for x in ranking.running(g, ["g"], ["n"]).collect()}
    assert got == {(a, s): sum(b == a and t >= s for b, t, _ in rows) for a, s, _ in rows}


def test_density_and_distances_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, rng.standard_normal(8).tolist(), i % 2 == 0) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, class int, v array<double>, train boolean")
    one = {r["id"]: r["density"] for r in vectors.density(df, 5).collect()}
    cut = {r["id"]: r["density"] for r in vectors.density(df, 5, cell=8).collect()}
    assert one == pytest.approx(cut) and len(one) == 150
    whole, parts = ({r["id"]: tuple(r)[1:] for r in vectors.class_distances(df, 8, most=m).collect()} for m in (100, 1))
    assert whole.keys() == parts.keys() and all(whole[k] == pytest.approx(parts[k]) for k in whole)


def test_command_line(spark, tmp_path, capsys):
    from belated import __main__ as cli

    cli.main(["list"])
    assert "model_table (SQL)" in capsys.readouterr().out
    data = "/root/testdata/sf0.001"
    cli.main(["run", "cohort", "fold_diagnostics", "--data", data, "--out", str(tmp_path), "--csv"])
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "cohort").iterdir()}
    cli.main(["run", "cohort", "--data", data, "--out", str(tmp_path)])
    assert first == {p: p.stat().st_mtime_ns for p in (tmp_path / "cohort").iterdir()}
    assert spark.read.csv(f"{tmp_path}/fold_diagnostics.csv", header=True).count() == spark.read.parquet(f"{tmp_path}/fold_diagnostics").count() > 0
    assert set(cli.BUILD) <= set(cli.QUERIES)
