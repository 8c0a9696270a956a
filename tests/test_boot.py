import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondage.operators import boot, plotdata


STATS = {"mean": np.mean, "median": np.median, "var": lambda v: np.var(v, ddof=1), "sd": lambda v: np.std(v, ddof=1)}


@pytest.mark.parametrize("stat", STATS)
def test_acceleration_by_hand(spark, stat):
    """Against leaving each value out, one at a time."""
    data = {"a": [1.0, 2, 2, 3, 9], "b": [0.5, 1, 4, 4, 4, 7.25], "c": [1.0, 1, 1], "d": [1.0, 5, 6, 8], "e": [3.0, 4.0]}
    df = spark.createDataFrame([(g, v) for g, x in data.items() for v in map(float, x)], "g string, x double")
    got = {r.g: r.acc for r in boot.acceleration(df, "x", ["g"], stat).collect()}
    for g, x in data.items():
        if stat in ("var", "sd") and len(x) < 3:
            assert got[g] == 0
            continue
        jack = np.array([STATS[stat](np.delete(x, i)) for i in range(len(x))])
        d = jack.mean() - jack
        want = (d**3).sum() / (6 * (d**2).sum() ** 1.5) if (d**2).sum() > 1e-20 else 0
        assert np.isclose(got[g], want, atol=1e-9)


@pytest.mark.parametrize("stat", STATS)
def test_replicates_against_resampling(spark, stat):
    """60,000 different values with a heavy tail, and a small group with ties."""
    rng = np.random.default_rng(11)
    data = {"big": rng.lognormal(0, 1, 60_000), "small": rng.integers(0, 6, 41).astype(float), "even": rng.integers(0, 9, 10).astype(float)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"g": g, "x": x}) for g, x in data.items()]))
    got = boot.draws(df, "x", ["g"], stat, R=1500).toPandas().groupby("g").value
    rows = {r.g: r for r in boot.boot_ci(df, "x", ["g"], stat, R=400).collect()}
    for g, x in data.items():
        want = np.array([STATS[stat](rng.choice(x, len(x))) for _ in range(500 if g == "big" else 4000)])
        mine = got.get_group(g).to_numpy()
        assert len(mine) == 1500
        sd = want.std()
        assert abs(mine.mean() - want.mean()) < 0.25 * sd and abs(mine.std() / sd - 1) < 0.2
        for q in (0.05, 0.5, 0.95):
            assert abs(np.quantile(mine, q) - np.quantile(want, q)) <= 0.4 * sd + 1e-12
        assert np.isclose(rows[g].observed, STATS[stat](x)) and rows[g].lower <= rows[g].observed <= rows[g].upper and rows[g].upper > rows[g].lower


def test_statistic_of_the_callers_own(spark):
    rng = np.random.default_rng(3)
    x = rng.exponential(2, 300)
    df = spark.createDataFrame([("a", float(v)) for v in x], "g string, x double")
    share = lambda x, w: F.sum(F.when(x > 2, w).otherwise(0)) / F.sum(w)
    r = boot.boot_ci(df, "x", ["g"], share, R=800).first()
    want = [(rng.choice(x, 300) > 2).mean() for _ in range(2000)]
    assert r.stat == "custom" and np.isclose(r.observed, (x > 2).mean())
    assert abs(r.lower - np.quantile(want, 0.025)) < 0.02 and abs(r.upper - np.quantile(want, 0.975)) < 0.02
    t, _ = boot.boot_diff(df.unionByName(df.withColumns({"g": F.lit("b"), "x": F.col("x") + 5})), "x", "g", share, R=200)
    assert t.excludes_zero.tolist() == [True] and t.stat.tolist() == ["custom"]


def test_bad_arguments(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    for bad in ({"ci_type": "exact"}, {"conf": 1.0}, {"R": 1}):
        with pytest.raises(ValueError):
            boot.boot_ci(df, "x", **bad)
    r = boot.boot_ci(df, "x").first()
    assert (r.observed, r.lower, r.n) == (1.0, None, 1)


def test_bca_of_a_skewed_mean(spark):
    """Towards the long tail, both ends lie above those of the percentile interval."""
    x = np.random.default_rng(5).lognormal(0, 1, 80)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0)], "g string, x double")
    got = {k: {r.g: r for r in boot.boot_ci(df, "x", ["g"], ci_type=k, R=1000).collect()} for k in ("percentile", "bca")}
    p, b = got["percentile"]["a"], got["bca"]["a"]
    assert p.lower < b.lower < b.observed < p.upper < b.upper
    assert got["bca"]["b"].lower is None and got["bca"]["b"].n == 1


def test_differences(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(g, float(rng.normal(m, 1))) for g, m in (("a", 0), ("b", 0.05), ("c", 3)) for _ in range(120)], "g string, x double")
    for kind in ("percentile", "bca", "normal", "basic"):
        t, draws = boot.boot_diff(df, "x", "g", R=500, adjust="bonferroni", ci_type=kind)
        assert draws.shape == (500, 3) and t.excludes_zero.tolist() == [False, True, True]
        assert ((t.lower < t.observed) & (t.observed < t.upper)).all()


def test_density_of_a_difference(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(g, float(rng.normal(m, 1))) for g, m in (("a", 0), ("b", 0.1), ("c", 3)) for _ in range(100)], "g string, x double")
    t, draws = boot.boot_diff(df, "x", "g", R=400)
    table, marks = plotdata.diff_density(t, draws, 0, ref=0.05)
    assert marks["label"] == "b - a (mean)" and np.isclose(marks["share_above"], (draws[:, 0] > 0.05).mean())
    assert abs(np.trapezoid(table.y, table.x) - 1) < 0.01 and abs(table.x[table.y.idxmax()] - draws[:, 0].mean()) < 0.2
    assert marks["title"].startswith("400 replicates; ") and marks["lower"] == t.lower[0]
    with np.testing.assert_raises(ValueError):
        plotdata.diff_density(t, draws, 3)


def test_verdict_lines(spark):
    rng = np.random.default_rng(7)
    rows = [(float(rng.lognormal(0, 1)), float(rng.normal()), True, "one" if i else "two", None) for i in range(500)]
    df = spark.createDataFrame(rows, "skewed double, even double, flag boolean, kind string, none double")
    assert plotdata.verdict_line(df, "skewed").startswith("gauss 0.") and "skewed to the right" in plotdata.verdict_line(df, "kind", "skewed")
    assert plotdata.verdict_line(df, "even").startswith("gauss ") and ":" not in plotdata.verdict_line(df, "even")
    assert plotdata.verdict_line(df, "flag") == "p(true) = 1.000: near-constant"
    assert plotdata.verdict_line(df, "kind") == "1 rare levels; nearly one value" and plotdata.verdict_line(df, "none") == ""


def test_values_do_not_carry_the_weights_of_parts(spark):
    """Else what is shuffled grows with the square of the different values."""
    df = spark.range(20_000).select(F.lit("a").alias("g"), (F.col("id") * 1.5).alias("x"))
    plan = boot.draws(df, "x", ["g"], "sd", R=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "Window" not in plan and plan.count("Join") == 1
    # the acceleration needs no table of value counts
    plan = boot.acceleration(df, "x", ["g"], "sd")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in line and "x#" in line.split("], [")[0] for line in plan.splitlines())
