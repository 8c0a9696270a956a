import numpy as np
import pandas as pd
import pytest

from sondage.functions.dist import chi2_sf, norm_sf2
from sondage.operators import missing


def newton(x, y):
    b = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x.T * (mu * (1 - mu))) @ x, x.T @ (y - mu))
    mu = 1 / (1 + np.exp(-x @ b))
    return b, mu, float(np.log(np.where(y == 1, mu, 1 - mu)).sum())


def by_hand(z, covs, outs):
    """p of the likelihood ratio, and sqrt(R^2) of the residuals on the residualised outcome."""
    x0 = np.column_stack([np.ones(len(z)), *covs])
    x1 = np.column_stack([x0, *outs])
    _, mu, small = newton(x0, z)
    _, _, large = newton(x1, z)
    r = (z - mu) / np.sqrt(mu * (1 - mu))
    e = np.column_stack(outs)
    e = e - x0 @ np.linalg.lstsq(x0, e, rcond=None)[0]
    fitted = np.column_stack([np.ones(len(z)), e])
    rest = r - fitted @ np.linalg.lstsq(fitted, r, rcond=None)[0]
    return chi2_sf(2 * (large - small), e.shape[1]), float(np.sqrt(1 - rest @ rest / ((r - r.mean()) ** 2).sum()))


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(8)
    n = 900
    cov, e = rng.normal(size=n), rng.normal(size=n)
    site = rng.choice(["a", "b", "c"], n)
    level = np.array(["low", "mid", "top"])[np.clip(np.digitize(cov + 0.8 * rng.normal(size=n), [-0.5, 0.6]), 0, 2)]
    gone = rng.random(n) < 1 / (1 + np.exp(-1.2 * e))
    odd = rng.random(n) < 0.3
    return pd.DataFrame({"cov": cov, "site": site, "y": 3 * cov + e, "level": level, "gap": np.where(gone, np.nan, 1.5), "odd": np.where(odd, np.nan, rng.normal(size=n)), "unit": rng.integers(0, 45, n)})


def test_outcome_test_by_hand(spark, panel):
    """Outcome and covariates are related; the outcome is a number or has three levels."""
    df = spark.createDataFrame(panel)
    sites = [(panel.site == s).to_numpy(float) for s in "bc"]
    for y, outs in (("y", [panel.y.to_numpy()]), ("level", [(panel.level == s).to_numpy(float) for s in ("mid", "top")])):
        got = missing.outcome_tests(df, ["gap", "odd"], y, ["cov", "site"])
        for t in got:
            p, effect = by_hand(panel[t["missing_in"]].isna().to_numpy(float), [panel["cov"].to_numpy(), *sites], outs)
            assert np.isclose(t["p_value"], p, rtol=1e-4, atol=1e-12) and np.isclose(t["effect"], effect, atol=1e-6) and t["n"] == 900
    alone = missing.outcome_test(df, "gap", "y")
    assert np.isclose(alone["effect"], abs(np.corrcoef(panel.gap.isna(), panel.y)[0, 1]), atol=1e-6)


def test_verdicts(spark, panel):
    df = spark.createDataFrame(panel)
    got = missing.check_missing(df.drop("odd", "unit"), "y", ["cov", "site"])
    assert got["verdict"] == "RELATED_TO_OUTCOME" and got["outcome_test"][0]["effect"] > 0.3
    got = missing.check_missing(df.drop("gap", "unit"), "y", ["cov", "site"])
    assert got["verdict"] == "MCAR_NOT_REJECTED" and got["unit_hint"] == []
    assert missing.check_missing(df.select("cov", "site"))["verdict"] == "NONE"
    with pytest.raises(ValueError):
        missing.check_missing(df, "y", ["y"])


def sandwich(x, y, unit, at):
    b, mu, _ = newton(x, y)
    bread = np.linalg.inv((x.T * (mu * (1 - mu))) @ x)
    s = pd.DataFrame(x * (y - mu)[:, None]).groupby(unit).sum().to_numpy()
    u = len(s)
    v = bread @ (s.T @ s) @ bread * u / (u - 1)
    b, v = b[at], v[np.ix_(at, at)]
    return norm_sf2(abs(b[0]) / v[0, 0] ** 0.5) if len(at) == 1 else chi2_sf(b @ np.linalg.solve(v, b), len(at))


def test_units_by_hand(spark, panel):
    df = spark.createDataFrame(panel)
    z, unit = panel.gap.isna().to_numpy(float), panel.unit.to_numpy()
    got = missing.outcome_test(df, "gap", "y", ["cov"], unit="unit")
    x = np.column_stack([np.ones(900), panel["cov"], panel.y])
    assert got["method"] == "clusters" and np.isclose(got["p_value"], sandwich(x, z, unit, [2]), rtol=1e-4)
    pairs = {(t["missing_in"], t["related_to"]): t for t in missing.screen(df, list(panel), unit="unit")}
    levels = np.column_stack([np.ones(900), panel.level == "mid", panel.level == "top"]).astype(float)
    assert np.isclose(pairs["gap", "level"]["p_value"], sandwich(levels, z, unit, [1, 2]), rtol=1e-4)
    assert not any("unit" in k for k in pairs)
    few = df.where("unit < 20")
    assert missing.outcome_test(few, "gap", "y", ["cov"], unit="unit")["p_value"] is None


def test_units_whose_rows_agree(spark):
    """Three rows a unit that say the same are one row."""
    rng = np.random.default_rng(2)
    one = pd.DataFrame({"unit": range(120), "y": rng.normal(size=120), "site": rng.choice(["a", "b"], 120)})
    one["gap"] = np.where(rng.random(120) < 1 / (1 + np.exp(-one.y)), np.nan, 1.0)
    rows = pd.concat([one] * 3)
    alone, again = (missing.outcome_test(spark.createDataFrame(d), "gap", "y", ["site"], unit="unit") for d in (one, rows))
    assert alone["method"] == again["method"] == "units" and again["n"] == 120
    assert np.isclose(alone["p_value"], again["p_value"]) and np.isclose(alone["p_value"], missing.outcome_test(spark.createDataFrame(one), "gap", "y", ["site"])["p_value"])
    assert missing.outcome_test(spark.createDataFrame(rows), "gap", "y", ["site"])["p_value"] < alone["p_value"]
    t = [x for x in missing.screen(spark.createDataFrame(rows), list(rows), unit="unit") if x["related_to"] == "y"]
    assert t[0]["method"] == "units"


def test_unit_hint(spark):
    df = spark.createDataFrame([(f"u{i // 4}", float(i // 4 % 7), float(i), None if i % 5 else 1.0) for i in range(80)], "who string, age double, x double, gap double")
    assert missing.check_missing(df)["unit_hint"] == ["who"]


def test_aliased_outcome(spark, panel):
    df = spark.createDataFrame(panel).selectExpr("*", "2 * cov + 1 as twice")
    t = missing.outcome_test(df, "gap", "twice", ["cov"])
    assert t["p_value"] is None and t["effect"] is None
