import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators.glrm import choose_lambda, encode, fitted, glrm, rotated
from sondage.operators.reduce import reduce


def planted(spark, n=600):
    rng = np.random.default_rng(3)
    f = rng.normal(size=n)
    rows = [(i, float(v + rng.normal(0, 0.3)), float(-v + rng.normal(0, 0.3)), bool(rng.random() < 1 / (1 + np.exp(-3 * v))), int(rng.poisson(np.exp(0.8 * v + 0.5))), "abc"[int(np.argmax([3 * v, 0, -3 * v] + rng.gumbel(size=3)))]) for i, v in enumerate(f)]
    rows[5] = (5, None, None, None, None, None)
    return spark.createDataFrame(rows, "id long, x double, y double, flag boolean, visits int, kind string"), f


def test_quadratic_loss_is_principal_components(spark):
    df, _ = planted(spark)
    m = glrm(df, "id", ["x", "y", "visits"], 1, lam=1e-6, maxit=100, tol=1e-12)
    z = df.dropna().select("x", "y", "visits").toPandas().to_numpy(float)
    z = (z - z.mean(0)) / z.std(0)
    first = np.linalg.svd(z, full_matrices=False)[2][0]
    got = m.archetypes[:, 0] / np.linalg.norm(m.archetypes[:, 0])
    assert abs(got @ first) > 0.99999


def test_all_losses_find_the_factor(spark):
    df, f = planted(spark)
    names = ["x", "y", "flag", "visits", "kind"]
    m = glrm(df, "id", names, 1, lam=1.0, maxit=40, poisson=["visits"])
    assert m.losses == ["quadratic", "quadratic", "logistic", "poisson", *["multinomial"] * 3]
    assert m.columns[-3:] == ["kind=a", "kind=b", "kind=c"]
    assert all(b <= a + 1e-6 * abs(a) for a, b in zip(m.objective[:-1], m.objective[1:], strict=True))
    got = m.scores.toPandas().set_index("id").dim1
    assert got[5] == 0.0 and abs(np.corrcoef(got.to_numpy(), f[got.index])[0, 1]) > 0.93
    a = m.archetypes[:, 0] * np.sign(m.archetypes[0, 0])
    assert a[1] < 0 < a[2] and a[3] > 0 and a[4] > a[5] > a[6]


def test_partitions_and_bad_columns(spark):
    df, _ = planted(spark, 200)
    names = ["x", "flag", "visits", "kind"]
    a, b = (glrm(d, "id", names, 2, maxit=5, poisson=["visits"]).archetypes for d in (df, df.repartition(7)))
    assert np.allclose(a, b)
    with pytest.raises(ValueError):
        glrm(df, "id", ["x", "y"], 1, poisson=["x"])
    assert choose_lambda(df, "id", names, 1, poisson=["visits"]) < 50


def coordinates(red):
    return red.coords.toPandas().set_index("id").sort_index()


def test_rotation_of_quadratic_losses_is_the_reduction(spark):
    df, _ = planted(spark)
    df = df.dropna().select("id", "x", "y", "visits", (df.x * df.visits + df.id % 7).alias("w"))
    names = ["x", "y", "visits", "w"]
    a = reduce(df, "id", names, 3)
    b = reduce(df, "id", names, 3, method="glrm", lam=1e-9, tol=1e-14)
    assert np.allclose(coordinates(a), coordinates(b), atol=1e-6)
    assert np.allclose(a.eig.eigenvalue * a.n, b.eig.eigenvalue, rtol=1e-6) and np.allclose(a.eig.pct_var, b.eig.pct_var, rtol=1e-6)
    assert np.allclose(np.abs(a.vectors), np.abs(b.vectors), atol=1e-6) and b.eig.pct_categorical.isna().all()
    assert np.allclose(b.contrib.groupby("dim").sqload.sum(), 1)


def test_rotation_keeps_the_product(spark):
    df, _ = planted(spark)
    names = ["x", "y", "flag", "visits", "kind"]
    m = glrm(df, "id", names, 3, poisson=["visits"])
    assert m.converged
    turn = rotated(m)
    x = m.scores.toPandas().set_index("id").sort_index().to_numpy()
    whole = (x - x.mean(0)) @ m.archetypes.T
    assert np.allclose(turn.values, np.linalg.svd(whole, compute_uv=False)[: turn.kept], rtol=1e-6)
    red = reduce(df, "id", names, 3, method="glrm", poisson=["visits"])
    assert np.allclose(coordinates(red).to_numpy() @ red.vectors.T, whole, atol=1e-6)
    dims = coordinates(red).to_numpy()
    assert np.allclose(dims.T @ dims, np.diag(red.eig.eigenvalue), atol=1e-6 * red.eig.eigenvalue.max())
    assert abs(red.eig.pct_categorical.sum() - 100) < 1e-6 and red.eig.pct_var.sum() <= 100
    assert set(red.contrib.variable) == set(names) and red.fitted == 3


def test_shrunk_dimensions_are_left_out(spark):
    df, _ = planted(spark)
    red = reduce(df, "id", ["x", "y", "visits"], 2, method="glrm", lam=60.0, tol=1e-12, maxit=300)
    assert len(red.eig) == 1 and red.note == "dimension 2 of 2 carries no variation"
    with pytest.raises(ValueError):
        reduce(df, "id", ["x", "y"], 2, method="glrm")
    with pytest.raises(ValueError):
        reduce(df, "id", ["x", "y"], 2, lam=1.0)


def test_weights_are_repeated_rows(spark):
    df, _ = planted(spark, 120)
    df = df.where("id <> 5").withColumn("times", (df.id % 3).cast("int"))
    names = ["x", "y", "visits"]
    enc = encode(df, names)
    a = glrm(df, "id", names, 1, lam=1e-8, weights="times", encoding=enc, tol=1e-14)
    copies = df.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    b = glrm(copies, "id", names, 1, lam=1e-8, encoding=enc, tol=1e-14)
    u, v = a.archetypes[:, 0], b.archetypes[:, 0]
    assert abs(u @ v) / np.linalg.norm(u) / np.linalg.norm(v) > 1 - 1e-8
    with pytest.raises(ValueError):
        glrm(df.withColumn("bad", F.lit(-1.0)), "id", names, 1, weights="bad")


def test_fitted_values_are_on_the_columns_scales(spark):
    df, f = planted(spark)
    got = fitted(glrm(df, "id", ["x", "y", "flag", "visits", "kind"], 2, poisson=["visits"])).toPandas().set_index("id")
    want = df.toPandas().set_index("id").drop(5)
    got = got.loc[want.index]
    assert np.corrcoef(got.x, want.x)[0, 1] > 0.9 and abs(got.x.mean() - want.x.mean()) < 0.05
    assert (got.flag == want.flag).mean() > 0.7 and (got.kind == want.kind).mean() > 0.6 and got.visits.min() > 0


def test_scores_are_at_their_minimum(spark):
    """Archetypes far from zero, where steps of bounds above the loss need thousands."""
    from sondage.operators.glrm import Loss

    rng = np.random.default_rng(2)
    kind = np.array(["poisson", "quadratic", "quadratic", *["multinomial"] * 3, "logistic"])
    loss = Loss(kind, np.array([0, 1, 2, 3, 3, 3, 4]), np.array([1.4, 2, 2, 0.9, 0.9, 0.9, 1.4]), np.zeros(7))
    y = np.array([[0.02, -0.04], [1.3, -5.0], [-0.7, 16.2], [-25.9, -6.1], [-0.1, 8.6], [26.0, -2.4], [9.0, 3.0]])
    offset, lam = np.array([1.4, 0.5, -1.4, -2.2, 1.0, -2.1, 0.0]), 1.0
    a = np.column_stack([rng.integers(1, 8, 300), rng.normal(size=(300, 2)), np.eye(3)[rng.integers(0, 3, 300)], rng.integers(0, 2, 300)]).astype(float)
    a[7], a[8, 3:6] = np.nan, np.nan
    x = loss.scores(a, y, offset, lam)
    mu = loss.means(x @ y.T + offset)
    slope = (np.where(np.isnan(a), 0, a - mu) * loss.weight) @ y - lam * x
    assert np.abs(slope).max() < 1e-3 and not x[7].any()


def unstructured(spark, n):
    """Columns that have nothing in common, as a benchmark's: the objective is flat and far
    from a bowl in many directions."""
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(1, 8)), float(rng.uniform(900, 105000)), float(rng.integers(1, 51)), "ANR"[rng.integers(0, 3)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, number int, price double, quantity double, kind string"), ["number", "price", "quantity", "kind"]


def test_passes_are_few(spark, monkeypatch):
    from sondage.operators import glrm as module

    passes, own = [], module.matrix_sum
    monkeypatch.setattr(module, "matrix_sum", lambda *a: passes.append(1) or own(*a))
    df, names = unstructured(spark, 3000)
    m = glrm(df, "id", names, poisson=["number"])
    assert m.converged and len(passes) < 40
    assert all(b <= a for a, b in zip(m.objective[:-1], m.objective[1:], strict=True))


@pytest.mark.parametrize("weights", [False, True])
def test_sums_are_the_derivatives_of_the_objective(weights):
    """Against differences, with scores that follow the archetypes."""
    from sondage.operators.glrm import Cells, Loss

    rng = np.random.default_rng(4)
    loss = Loss(np.array(["quadratic", "logistic", "poisson", *["multinomial"] * 3]), np.array([0, 1, 2, 3, 3, 3]), np.array([2, 1.4, 0.8, 0.9, 0.9, 0.9]), np.zeros(6))
    a = np.column_stack([rng.normal(size=40), rng.integers(0, 2, 40), rng.poisson(2, 40), np.eye(3)[rng.integers(0, 3, 40)]]).astype(float)
    a[3, 0], a[4, 3:] = np.nan, np.nan
    cells = Cells(loss, a, rng.uniform(0, 2, 40) if weights else None)
    at = np.column_stack([rng.normal(size=(6, 2)), rng.normal(0, 0.3, 6)])

    def found(at):
        got = cells.sums(at[:, :2], at[:, 2], 0.7, True)
        return got[0], got[1:19], got[-18 * 18 :].reshape(18, 18)

    _, slope, second = found(at)
    for i in range(18):
        step = np.zeros(18)
        step[i] = 1e-4
        up, down = found(at + step.reshape(6, 3)), found(at - step.reshape(6, 3))
        here = slope.copy()
        assert np.isclose((up[0] - down[0]) / 2e-4, here[i], rtol=1e-5, atol=1e-5)
        assert np.allclose((up[1] - down[1]) / 2e-4, second[i], rtol=1e-4, atol=1e-4)


def test_parts_only_say_where_to_start(spark, monkeypatch):
    """A start from parts of the rows, and mixing in place of second derivatives, end at the same minimum."""
    from sondage.operators import glrm as module

    df, _ = planted(spark)
    names = ["x", "y", "flag", "visits", "kind"]
    want = glrm(df, "id", names, 2, poisson=["visits"], tol=1e-10)
    monkeypatch.setattr(module, "WIDE", 0)
    mixed = glrm(df, "id", names, 2, poisson=["visits"], tol=1e-10)
    monkeypatch.undo()
    monkeypatch.setattr(module, "NESTED", 3)
    monkeypatch.setattr(module, "FEWEST", 60)
    parts = glrm(df, "id", names, 2, poisson=["visits"], tol=1e-10)
    for m in (mixed, parts):
        assert m.converged and np.isclose(m.objective[-1], want.objective[-1], rtol=1e-6) and m.scores.count() == 600
    assert len(parts.objective) < len(want.objective)
