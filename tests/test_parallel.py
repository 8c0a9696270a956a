import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import linalg, parallel
from sondage.operators.linalg import interpolated, order_statistics, quantile_of


def table(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"c{j} double" for j in range(x.shape[1])))


def factors(n, seed=4):
    rng = np.random.default_rng(seed)
    f = rng.normal(size=(n, 2))
    x = np.column_stack([f[:, 0] + rng.normal(0, 0.5, n) for _ in range(3)] + [f[:, 1] + rng.normal(0, 0.5, n) for _ in range(3)] + [rng.normal(size=n)])
    return (x - x.mean(0)) / x.std(0)


@pytest.mark.parametrize("stratum", [1 << 15, 250])
def test_as_whole_columns_permuted(spark, monkeypatch, stratum):
    monkeypatch.setattr(parallel, "STRATUM", stratum)
    x = factors(2000)
    cols = [f"c{j}" for j in range(7)]
    got = parallel.parallel_analysis(table(spark, x).repartition(5), "id", cols, len(x))
    rng = np.random.default_rng(0)
    null = [np.sort(np.linalg.eigvalsh(np.corrcoef(np.column_stack([rng.permutation(c) for c in x.T]).T)))[::-1] for _ in range(200)]
    assert got.ndim == 2 and np.allclose(got.table.eigenvalue, np.sort(np.linalg.eigvalsh(x.T @ x / len(x)))[::-1])
    assert np.allclose(got.table.threshold, np.quantile(null, 0.95, axis=0), atol=0.02)


def test_columns_of_one_owner_move_together(spark):
    x = factors(1500)
    cols = [f"c{j}" for j in range(7)]
    grams = parallel.permuted_grams(table(spark, x), "id", cols, ["a", "a", "a", "b", "b", "b", "c"], len(x), 3, 1)
    assert np.allclose(grams[:, :3, :3], x[:, :3].T @ x[:, :3]) and np.allclose(grams[1:, :3, 3:6] / len(x), 0, atol=0.1)
    again = parallel.permuted_grams(table(spark, x).repartition(9), "id", cols, ["a", "a", "a", "b", "b", "b", "c"], len(x), 3, 1)
    assert np.allclose(grams, again)


def test_one_path_for_any_size(spark):
    for n in (19_999, 20_001):
        x = factors(n, 5)
        assert parallel.parallel_analysis(table(spark, x), "id", [f"c{j}" for j in range(7)], n, B=10).ndim == 2


@pytest.mark.parametrize("fetched", [20_000, 4])
def test_order_statistics(spark, monkeypatch, fetched):
    monkeypatch.setattr(linalg, "FETCHED", fetched)
    rng = np.random.default_rng(6)
    n = 3000
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), rng.lognormal(0, 9, n), np.full(n, -7.25), -rng.lognormal(0, 30, n)])
    x[::7, 0] = np.nan
    df = spark.range(n).repartition(4)
    at = lambda ids: x[ids[:, 0].astype(int)]
    probs = (0.0, 0.25, 0.5, 0.99, 1.0)
    for prob in probs:
        pairs, sizes = order_statistics(df, ["id"], at, [interpolated(prob)] * 5)
        for j in range(5):
            own = x[~np.isnan(x[:, j]), j]
            assert sizes[j] == len(own) and np.isclose(quantile_of(pairs[j], prob, sizes[j]), np.quantile(own, prob), rtol=1e-12)
    none, sizes = order_statistics(df.where(F.lit(False)), ["id"], at, [interpolated(0.5)] * 5)
    assert sizes == [0] * 5 and all(len(x) == 0 for x in none)
