import numpy as np
import pandas as pd
import pytest

from sondage.operators import reduce


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(3)
    f = rng.normal(size=160)
    d = pd.DataFrame({"id": np.arange(160), "a": f + rng.normal(0, 0.5, 160), "b": -f + rng.normal(0, 0.5, 160), "c": rng.normal(size=160), "k": np.where(f > 0.3, "x", np.where(f < -0.6, "y", "z")), "w": rng.choice(["p", "q"], 160)})
    d.loc[::11, "c"] = np.nan
    d.loc[5::13, "w"] = None
    return d


def by_hand(d, numbers, factors):
    """The coded table, decomposed at once."""
    z, owner = [], []
    for c in numbers:
        x = d[c].to_numpy(float)
        x = np.where(np.isnan(x), np.nanmean(x), x)
        z.append((x - x.mean()) / x.std())
        owner.append(c)
    for c in factors:
        for level in sorted(d[c].dropna().unique()):
            on = (d[c] == level).to_numpy(float)
            z.append((on - on.mean()) / np.sqrt(on.mean()))
            owner.append(c)
    z = np.column_stack(z)
    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    at = np.argsort(-values)
    return z, values[at], vectors[:, at], owner


@pytest.mark.parametrize("numbers, factors, method", [(["a", "b", "c"], [], "pca"), ([], ["k", "w"], "mca"), (["a", "b", "c"], ["k", "w"], "famd")])
def test_against_one_decomposition(spark, mixed, numbers, factors, method):
    got = reduce.reduce(spark.createDataFrame(mixed), "id", [*numbers, *factors], 2)
    z, values, vectors, owner = by_hand(mixed, numbers, factors)
    assert got.method == method and got.n == 160
    assert np.allclose(got.eig.eigenvalue, values[:2], atol=1e-10)
    kept = values[values > 1e-10]
    assert np.allclose(got.eig.pct_var, 100 * kept[:2] / kept.sum())
    coords = got.coords.toPandas().sort_values("id")[["dim1", "dim2"]].to_numpy()
    want = (z - z.mean(0)) @ vectors[:, :2]
    want *= np.sign((coords * want).sum(0))
    assert np.allclose(coords, want, atol=1e-8)
    # a number's squared loading is its squared correlation with the dimension
    for r in got.contrib[got.contrib.variable.isin(numbers)].itertuples():
        x = z[:, owner.index(r.variable)]
        assert np.isclose(r.sqload, np.corrcoef(x, want[:, r.dim - 1])[0, 1] ** 2, atol=1e-8)


def test_missing_markers(spark, mixed):
    got = reduce.reduce_na(spark.createDataFrame(mixed), "id", ["a", "c", "w"], 2)
    marks = pd.DataFrame({"id": mixed.id, "c": np.where(mixed.c.isna(), "missing", "present"), "w": np.where(mixed.w.isna(), "missing", "present")})
    assert np.allclose(got.eig.eigenvalue, by_hand(marks, [], ["c", "w"])[1][:2])
    with pytest.raises(ValueError):
        reduce.reduce_na(spark.createDataFrame(mixed), "id", ["a", "c"])
    with pytest.raises(ValueError):
        reduce.reduce(spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, x double"), "id", ["x"])
